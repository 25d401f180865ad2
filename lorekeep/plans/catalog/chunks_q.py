"""Text measures, chunking, titles, metadata, numbering and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import ids
from lorekeep.functions import text as tx
from lorekeep.functions import titles as mx
from lorekeep.operators import chunking, embed, html, quality
from lorekeep.plans.catalog.registry import (
    CTE_DOCS,
    CTE_LINES,
    SQL_SPACE,
    SQL_TOKEN,
    SQL_WORD,
    docs,
    joined,
    lines,
    query,
    split_lines,
    sql_stable_id,
    sql_words,
    table,
)
from lorekeep.schemas import VECTOR_DIM

BIG = "bigint"


# ---- measures -----------------------------------------------------------------------------------


@query("word_count", f"SELECT doc_id, CAST({sql_words('text')} AS BIGINT) AS n_words FROM documents")
def word_count(spark, folder):
    return docs(spark, folder).select("doc_id", tx.word_count(F.col("text")).cast(BIG).alias("n_words"))


@query("char_count", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents")
def char_count(spark, folder):
    return docs(spark, folder).select("doc_id", tx.char_count(F.col("text")).cast(BIG).alias("chars"))


@query("token_count", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{SQL_TOKEN}')) AS BIGINT) AS tokens FROM documents")
def token_count(spark, folder):
    return docs(spark, folder).select("doc_id", tx.token_count(F.col("text")).cast(BIG).alias("tokens"))


@query("error_trim", "SELECT doc_id, left(text, 100) AS error FROM documents")
def error_trim(spark, folder):
    return docs(spark, folder).select("doc_id", tx.error_trim(F.col("text")).alias("error"))


@query("entry_id", f"WITH {CTE_DOCS} SELECT doc_id, {sql_stable_id('source', 'url', 'text')} AS id FROM docs")
def entry_id(spark, folder):
    return docs(spark, folder).select("doc_id", ids.stable_id(F.col("source"), F.col("url"), F.col("text")).alias("id"))


# ---- chunking -----------------------------------------------------------------------------------


@query("chunks_all", f"""
WITH {CTE_LINES}
SELECT 'documents' AS origin, doc_id AS id, text FROM lines
UNION ALL SELECT 'conversations', conv_id, text FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS text FROM conversations) WHERE text <> ''
""")
def chunks_all(spark, folder):
    of_docs = lines(spark, folder).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    talk = table(spark, folder, "conversations").select(
        F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.explode(split_lines(F.col("text"))).alias("text")
    )
    return of_docs.unionByName(talk)


@query("chunk_min_words", f"WITH {CTE_LINES} SELECT doc_id, CAST(ix AS BIGINT) AS ix, text FROM lines WHERE {sql_words('text')} >= 15")
def chunk_min_words(spark, folder):
    return chunking.drop_tiny(lines(spark, folder)).select("doc_id", F.col("ix").cast(BIG).alias("ix"), "text")


def _sql_pieces(limit: int, trail: str) -> str:
    """Pieces of at most ``limit`` words; ``trail`` is the heading trail of a body line."""
    return f"""{CTE_LINES},
typed AS (SELECT *, {sql_words('text')} AS n, regexp_extract_all(text, '{SQL_WORD}') AS ws FROM lines),
trailed AS (SELECT *, {trail} AS trail FROM typed),
body AS (SELECT * FROM trailed WHERE NOT is_heading(n)),
pieces AS (
  SELECT doc_id, ix, trail, 0 AS part, n AS size, regexp_replace(text, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g') AS piece FROM body WHERE n <= {limit}
  UNION ALL
  SELECT doc_id, ix, trail, k, least({limit}, n - k * {limit}), array_to_string(ws[k * {limit} + 1 : (k + 1) * {limit}], ' ')
  FROM (SELECT *, unnest(generate_series(0, CAST(ceil(n / {limit}.0) AS BIGINT) - 1)) AS k FROM body WHERE n > {limit}))"""


def _sql_packed(limit: int, trail: str, heading: str) -> str:
    """Greedy left-to-right packing as a recursion over the pieces of each document."""
    return f"""WITH RECURSIVE {_sql_pieces(limit, trail).replace('is_heading(n)', heading)},
seated AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix, part) AS seat FROM pieces),
packed(doc_id, seat, chunk_ix, total, trail) AS (
  SELECT doc_id, seat, 0, size, trail FROM seated WHERE seat = 1
  UNION ALL
  SELECT s.doc_id, s.seat,
         CASE WHEN s.trail = p.trail AND p.total + s.size <= {limit} THEN p.chunk_ix ELSE p.chunk_ix + 1 END,
         CASE WHEN s.trail = p.trail AND p.total + s.size <= {limit} THEN p.total + s.size ELSE s.size END, s.trail
  FROM packed p JOIN seated s ON s.doc_id = p.doc_id AND s.seat = p.seat + 1)
SELECT p.doc_id, CAST(p.chunk_ix AS BIGINT) AS chunk_ix, any_value(p.trail) AS trail, CAST(sum(s.size) AS BIGINT) AS n_tokens,
       string_agg(s.piece, chr(10) ORDER BY s.seat) AS text
FROM packed p JOIN seated s ON p.doc_id = s.doc_id AND p.seat = s.seat GROUP BY p.doc_id, p.chunk_ix"""


def _packed(spark, folder, limit: int, heading_words: int, min_words: int = 0):
    blocks = docs(spark, folder).select("doc_id", html.text_blocks(F.col("text"), heading_words).alias("blocks"))
    chunks = chunking.chunk_documents(blocks, limit, min_chunk_words=min_words, counter="word")
    return chunks.select(
        "doc_id", F.col("chunk_ix").cast(BIG).alias("chunk_ix"), joined(F.col("headings")).alias("trail"),
        F.col("n_tokens").cast(BIG).alias("n_tokens"), "text",
    )


# Lines of at most two words are headings here; a line's trail is the last heading above it.
_TRAIL = "coalesce(last_value(CASE WHEN n <= 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ix ROWS UNBOUNDED PRECEDING), '')"


@query("chunk_hybrid", f"SELECT * FROM ({_sql_packed(60, _TRAIL, '(n <= 2)')}) WHERE {sql_words('text')} >= 15")
def chunk_hybrid(spark, folder):
    """Structural chunking: 60-word chunks within heading trails, tiny chunks dropped."""
    return _packed(spark, folder, 60, heading_words=2, min_words=15)


@query("chunk_merge", _sql_packed(120, "''", "(n < 0)"))
def chunk_merge(spark, folder):
    """Greedy merging of neighbours under one trail."""
    return _packed(spark, folder, 120, heading_words=0)


@query(
    "chunk_split",
    f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '{SQL_WORD}') AS ws FROM documents),
k AS (SELECT *, unnest(generate_series(0, CAST(ceil(len(ws) / 100.0) AS BIGINT) - 1)) AS k FROM w)
SELECT doc_id, CAST(k AS BIGINT) AS piece_ix, array_to_string(ws[k * 100 + 1 : (k + 1) * 100], ' ') AS text FROM k
""",
)
def chunk_split(spark, folder):
    """Each document as one over-long block, cut at word boundaries."""
    block = F.struct(
        F.lit(0).alias("ix"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"),
        F.array().cast("array<string>").alias("headings"), F.lit(None).cast("int").alias("page_no"),
        joined(tx.words(F.col("text")), " ").alias("text"),
    )
    blocks = docs(spark, folder).select("doc_id", F.array(block).alias("blocks"))
    cut = chunking.explode_chunks(blocks, 100, merge_peers=False, counter="word")
    return cut.select("doc_id", F.col("chunk_ix").cast(BIG).alias("piece_ix"), "text")


SQL_STATS = f"""count(*) FILTER (WHERE n >= 15) AS chunks_kept, count(*) FILTER (WHERE n < 15) AS chunks_filtered,
  CAST(coalesce(sum(n) FILTER (WHERE n >= 15) // nullif(count(*) FILTER (WHERE n >= 15), 0), 0) AS BIGINT) AS avg_words"""
CTE_SIZED = f"{CTE_LINES}, sized AS (SELECT *, {sql_words('text')} AS n FROM lines)"


@query("chunk_stats_doc", f"WITH {CTE_SIZED} SELECT doc_id, {SQL_STATS} FROM sized GROUP BY doc_id")
def chunk_stats_doc(spark, folder):
    return chunking.chunk_stats(lines(spark, folder), ["doc_id"])


@query("chunk_stats_total", f"WITH {CTE_SIZED} SELECT {SQL_STATS} FROM sized")
def chunk_stats_total(spark, folder):
    return chunking.chunk_stats(lines(spark, folder), [])


CTE_NUMBERED = f"""{CTE_LINES},
numbered AS (
  SELECT source, url, ix, row_number() OVER (PARTITION BY source ORDER BY substr(md5(url), 1, 4), url, ix) AS chunk_index,
         count(*) OVER (PARTITION BY source) AS total_chunks FROM lines)"""


def _numbered(spark, folder):
    rows = docs(spark, folder).select("source", "url", split_lines(F.col("text")).alias("lines"))
    rows = rows.select("source", "url", F.transform("lines", lambda x, i: i).alias("chunks"))
    numbered = chunking.number_chunks(rows, ["source"], "url", "url")
    return numbered.select("source", "url", F.col("chunk").cast(BIG).alias("ix"), "chunk_index", "total_chunks")


@query("chunk_index", f"WITH {CTE_NUMBERED} SELECT source, url, CAST(ix AS BIGINT) AS ix, chunk_index FROM numbered")
def chunk_index(spark, folder):
    return _numbered(spark, folder).drop("total_chunks")


@query("total_chunks", f"WITH {CTE_NUMBERED} SELECT source, url, CAST(ix AS BIGINT) AS ix, total_chunks FROM numbered")
def total_chunks(spark, folder):
    return _numbered(spark, folder).drop("chunk_index")


@query(
    "embed_batches",
    f"""
WITH {CTE_NUMBERED}, b AS (SELECT *, (chunk_index - 1) // 100 AS batch_no FROM numbered)
SELECT source, url, CAST(ix AS BIGINT) AS ix, CAST(batch_no AS BIGINT) AS batch_no,
       CAST(least((batch_no + 1) * 100, total_chunks) AS BIGINT) AS batch_end,
       round(least((batch_no + 1) * 100, total_chunks) / total_chunks * 100.0, 6) AS progress FROM b
""",
)
def embed_batches(spark, folder):
    batched = chunking.embed_batches(_numbered(spark, folder))
    return batched.drop("chunk_index", "total_chunks").withColumn("progress", F.round("progress", 6))


@query(
    "heading_path",
    """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 AS level,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seat FROM lineitem),
h AS (SELECT *,
        max(CASE WHEN level = 1 THEN seat END) OVER w AS at1, last_value(CASE WHEN level = 1 THEN l_partkey END IGNORE NULLS) OVER w AS h1,
        max(CASE WHEN level = 2 THEN seat END) OVER w AS at2, last_value(CASE WHEN level = 2 THEN l_partkey END IGNORE NULLS) OVER w AS h2
      FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY seat ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       concat_ws('|', CAST(h1 AS VARCHAR), CASE WHEN at2 > coalesce(at1, 0) THEN CAST(h2 AS VARCHAR) END) AS headings
FROM h WHERE level = 0
""",
)
def heading_path(spark, folder):
    """Each order as a page of headings and paragraphs, read by the page parser; every line is one block."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def element(x):
        level = x["l_linenumber"] % 3
        tag = F.when(level == 0, "p").otherwise(F.concat(F.lit("h"), level.cast("string")))
        return F.concat(F.lit("<"), tag, F.lit(">"), x["l_partkey"].cast("string"), F.lit("</"), tag, F.lit(">"))

    pages = orders.withColumn("html", F.array_join(F.transform("lines", element), "\n"))
    blocks = html.html_blocks(pages).select("l_orderkey", "lines", F.inline("blocks")).filter("kind <> 'heading'")
    return blocks.select("l_orderkey", F.col("lines")[F.col("ix")].alias("line"), joined(F.col("headings")).alias("headings")).select("l_orderkey", "line.*", "headings")


# ---- titles and metadata ------------------------------------------------------------------------

# Headings of a document: its lines of at most three words; English documents have a file name.
CTE_TITLED = f"""{CTE_DOCS},
titled AS (
  SELECT doc_id, source, url, lang, text, CASE WHEN lang = 'en' THEN doc_id || '.html' END AS filename,
         list_filter(string_split(text, chr(10)), lambda x: x <> '' AND {sql_words('x')} <= 3) AS hs FROM docs)"""


def _titled(spark, folder):
    short = F.filter(F.split("text", "\n"), lambda x: (x != "") & (tx.word_count(x) <= 3))
    name = F.when(F.col("lang") == "en", F.concat(F.col("doc_id").cast("string"), F.lit(".html")))
    return docs(spark, folder).select("doc_id", "source", "url", "lang", "text", name.alias("filename"), short.alias("hs"))


SQL_FIRST_LINE = f"left(regexp_replace(string_split(text, chr(10))[1], '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g'), 50)"


@query(
    "title_hier",
    f"""
WITH {CTE_TITLED}
SELECT doc_id, coalesce(nullif(left(CASE WHEN len(hs) > 1 THEN hs[-2] || ' > ' || hs[-1] WHEN len(hs) = 1 THEN hs[1]
       WHEN filename <> '' THEN filename ELSE {SQL_FIRST_LINE} END, 255), ''), 'Untitled Document') AS title FROM titled
""",
)
def title_hier(spark, folder):
    rows = _titled(spark, folder)
    return rows.select("doc_id", mx.title_hierarchical(F.col("hs"), F.col("filename"), F.col("text")).alias("title"))


@query(
    "title_simple",
    f"""
WITH {CTE_TITLED}
SELECT doc_id, coalesce(nullif(left(CASE WHEN len(hs) > 0 THEN hs[1] ELSE filename END, 255), ''), 'Untitled Document') AS title FROM titled
""",
)
def title_simple(spark, folder):
    return _titled(spark, folder).select("doc_id", mx.title_simple(F.col("hs"), F.col("filename")).alias("title"))


@query(
    "page_numbers",
    f"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{SQL_WORD}'), lambda x: CASE WHEN length(x) > 4 THEN length(x) END) AS ps FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(ps, lambda p: p IS NOT NULL))), '|') AS pages FROM w
""",
)
def page_numbers(spark, folder):
    lengths = F.transform(tx.words(F.col("text")), lambda w: F.when(F.char_length(w) > 4, F.char_length(w)))
    return docs(spark, folder).select("doc_id", joined(mx.page_numbers(lengths).cast("array<string>")).alias("pages"))


SQL_METADATA = """to_json({'source_url': url, 'filename': coalesce(filename, 'unknown'), 'page_numbers': NULL::INTEGER[],
  'original_title': hs[1], 'chunk_index': doc_id, 'total_chunks': len(hs)})::VARCHAR"""


def _metadata():
    nothing = F.lit(None).cast("array<int>")
    return mx.metadata_json(F.col("url"), F.col("filename"), nothing, F.col("hs"), F.col("doc_id"), F.size("hs"))


@query("metadata_json", f"WITH {CTE_TITLED} SELECT doc_id, {SQL_METADATA} AS metadata FROM titled")
def metadata_json(spark, folder):
    return _titled(spark, folder).select("doc_id", _metadata().alias("metadata"))


@query(
    "metadata_read",
    f"""
WITH {CTE_TITLED}
SELECT doc_id, CASE WHEN lang <> 'fr' THEN url END AS source_url, CASE WHEN lang <> 'fr' THEN hs[1] END AS original_title,
       CASE WHEN lang <> 'fr' THEN CAST(len(hs) AS INTEGER) END AS total_chunks FROM titled
""",
)
def metadata_read(spark, folder):
    stored = F.when(F.col("lang") != "fr", _metadata())
    read = mx.metadata_read(stored)
    return _titled(spark, folder).select("doc_id", read["source_url"].alias("source_url"), read["original_title"].alias("original_title"), read["total_chunks"].alias("total_chunks"))


# ---- embedding ----------------------------------------------------------------------------------


# A word adds its sign to the place its code names; lengths and quotients are single precision, as in the vectors.
@query(
    "embed_chunks",
    f"""
WITH {CTE_LINES},
said AS (SELECT doc_id, ix, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM lines),
coded AS (SELECT doc_id, ix, CAST('0x' || left(md5(w), 8) AS BIGINT) AS c FROM said),
places AS (SELECT doc_id, ix, c % 1536 AS place, sum(CASE WHEN c >= 2147483648 THEN 1 ELSE -1 END) AS v FROM coded GROUP BY ALL),
sized AS (SELECT *, sqrt(CAST(sum(v * v) OVER (PARTITION BY doc_id, ix) AS DOUBLE)) AS size FROM places),
units AS (SELECT doc_id, ix, place, CAST(round(CAST(CAST(v AS FLOAT) / CAST(size AS FLOAT) AS DOUBLE) * 10000) AS BIGINT) AS x FROM sized WHERE v <> 0),
vectors AS (SELECT doc_id, ix, string_agg(place || ':' || x, ',' ORDER BY place) AS s FROM units GROUP BY ALL)
SELECT doc_id, CAST(ix AS BIGINT) AS ix, sha256(coalesce(s, '')) AS vector_sha256 FROM lines LEFT JOIN vectors USING (doc_id, ix)
""",
)
def embed_chunks(spark, folder):
    """Every line embedded: the digest of the places and ten-thousandths of its vector."""
    rows = embed.embed_chunks(lines(spark, folder))
    vector = F.col("embedding")
    filled = F.filter(F.sequence(F.lit(0), F.lit(VECTOR_DIM - 1)), lambda i: vector[i] != 0)
    shown = F.transform(filled, lambda i: F.concat_ws(":", i.cast("string"), F.round(vector[i].cast("double") * 10000).cast(BIG).cast("string")))
    return rows.select("doc_id", F.col("ix").cast(BIG).alias("ix"), F.sha2(F.array_join(shown, ","), 256).alias("vector_sha256"))


@query(
    "chunk_embed_join",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(embedding) AS BIGINT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM documents JOIN embeddings ON doc_id = vec_id",
)
def chunk_embed_join(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    paired = embed.attach_vectors(docs(spark, folder), vectors, "doc_id")
    return paired.select(
        "doc_id", F.char_length("text").cast(BIG).alias("chars"), F.size("embedding").cast(BIG).alias("dim"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
    )


# ---- quality reports ----------------------------------------------------------------------------

# A line of ten words or more has its first twenty characters as a second heading.
CTE_HEADED = f"{CTE_SIZED}, headed AS (SELECT *, CASE WHEN n >= 10 THEN [lang, left(text, 20)] ELSE [lang] END AS hs FROM sized)"
SQL_TITLE = "CASE WHEN len(hs) > 1 THEN hs[-2] || ' > ' || hs[-1] ELSE hs[1] END"
TOPICS = {"has_physio_content": ("physio", "the "), "has_team_info": ("team", " de la "), "has_services": (" und ",)}
ARTIFACT = " of the the "
FRAGMENTS = ("tion", "ment")


def _headed(spark, folder):
    long = tx.word_count(F.col("text")) >= 10
    return lines(spark, folder).withColumn("headings", F.when(long, F.array("lang", F.left("text", F.lit(20)))).otherwise(F.array("lang")))


def _sql_has(terms) -> str:
    return "bool_or(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


SQL_REPORT = "count(*) AS total_chunks, round_even(avg(n), 1) AS avg_words, min(n) AS min_words, max(n) AS max_words, round_even(avg(length(text)), 1) AS avg_chars"
SQL_FLAGS = (
    ", ".join(f"{_sql_has(terms)} AS {name}" for name, terms in TOPICS.items())
    + f", NOT {_sql_has([ARTIFACT])} AS no_right_txt_artifact"
    + f", NOT bool_or(n < 10 AND ({' OR '.join(f'''contains(lower(text), '{t}')''' for t in FRAGMENTS)})) AS no_fragmented_stats"
)


@query("chunk_report", f"WITH {CTE_SIZED} SELECT source, {SQL_REPORT} FROM sized GROUP BY source")
def chunk_report(spark, folder):
    return quality.chunk_report(lines(spark, folder), ["source"])


@query("content_flags", f"WITH {CTE_SIZED} SELECT source, {SQL_FLAGS} FROM sized GROUP BY source")
def content_flags(spark, folder):
    return quality.content_flags(lines(spark, folder), ["source"], TOPICS, ARTIFACT, FRAGMENTS)


CTE_TITLES = f"""{CTE_HEADED}, t AS (SELECT *, {SQL_TITLE} AS title FROM headed),
totals AS (SELECT source, count(*) FILTER (WHERE contains(title, ' > ')) AS hierarchical_titles, count(DISTINCT title) AS unique_titles FROM t GROUP BY source)"""


@query(
    "title_report",
    f"""
WITH {CTE_TITLES},
r AS (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY url, ix) AS k FROM t WHERE contains(title, ' > ')),
e AS (SELECT source, string_agg(title, '|' ORDER BY k) AS examples FROM r WHERE k <= 5 GROUP BY source)
SELECT totals.source, hierarchical_titles, unique_titles, examples FROM totals LEFT JOIN e ON totals.source = e.source
""",
)
def title_report(spark, folder):
    found = quality.title_report(_headed(spark, folder), ["source"], ["url", "ix"])
    return found.withColumn("examples", joined(F.col("examples")))


@query(
    "quality_issues",
    f"""
WITH {CTE_TITLES}, rep AS (SELECT source, round(avg(n), 6) AS avg_words, {SQL_FLAGS} FROM sized GROUP BY source)
SELECT rep.source, concat_ws('|', CASE WHEN avg_words < 50 THEN 'chunks too small' END, CASE WHEN avg_words > 600 THEN 'chunks too large' END,
  CASE WHEN NOT has_physio_content THEN 'missing physio content' END, CASE WHEN NOT no_right_txt_artifact THEN 'right txt artifacts' END,
  CASE WHEN NOT no_fragmented_stats THEN 'fragmented stats' END, CASE WHEN hierarchical_titles = 0 THEN 'no hierarchical titles' END) AS issues
FROM rep JOIN totals ON rep.source = totals.source
""",
)
def quality_issues(spark, folder):
    report = quality.full_report(_headed(spark, folder), ["source"], ["url", "ix"], 6, TOPICS, ARTIFACT, FRAGMENTS)
    return report.select("source", joined(F.col("issues")).alias("issues"))


@query(
    "chunk_samples",
    f"""
WITH {CTE_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY url, ix) AS k FROM sized)
SELECT source, k AS sample_no, left(text, 200) || '...' AS content_preview, n AS word_count FROM r WHERE k <= 5
""",
)
def chunk_samples(spark, folder):
    shown = quality.chunk_samples(lines(spark, folder), ["source"], ["url", "ix"])
    return shown.select("source", F.col("sample_no").cast(BIG).alias("sample_no"), "content_preview", F.col("word_count").cast(BIG).alias("word_count"))


# Sites: document sources, and page hosts, which have no documents. Chunks have 15 words or more.
CTE_SITES = f"""{CTE_HEADED},
sites AS (SELECT source AS site, min(doc_id) AS seq FROM documents GROUP BY source
          UNION ALL SELECT regexp_extract(url, '//([^/?#]*)', 1), 1000000000 + min(page_id) FROM pages GROUP BY 1),
d AS (SELECT source AS site, count(*) AS docs FROM documents GROUP BY source),
c AS (SELECT source AS site, count(*) AS chunks, avg(n) AS a, min(n) AS mn, max(n) AS mx, count(*) FILTER (WHERE len(hs) > 1) AS hier,
             count(*) FILTER (WHERE n < 20) AS tiny, count(*) FILTER (WHERE n BETWEEN 30 AND 200) AS good FROM headed WHERE n >= 15 GROUP BY source),
quality AS (
  SELECT sites.site, seq,
    CASE WHEN docs IS NULL THEN 'FAILED' WHEN chunks IS NULL THEN 'POOR' WHEN a < 30 THEN 'POOR' WHEN a < 50 THEN 'FAIR' WHEN a < 100 THEN 'GOOD' ELSE 'EXCELLENT' END AS status,
    coalesce(docs, 0) AS docs_extracted, coalesce(chunks, 0) AS chunks, round_even(coalesce(a, 0), 1) AS avg_words, mn AS min_words, mx AS max_words,
    round_even(coalesce(100.0 * hier / chunks, 0)::DOUBLE, 1) AS hierarchical_pct, coalesce(tiny, 0) AS tiny_chunks, coalesce(good, 0) AS quality_chunks,
    CASE WHEN docs IS NULL THEN 'No documents extracted' WHEN chunks IS NULL THEN 'No chunks created' END AS error
  FROM sites LEFT JOIN d ON sites.site = d.site LEFT JOIN c ON sites.site = c.site)"""


def _sites(spark, folder):
    named = table(spark, folder, "documents").groupBy(F.col("source").alias("site")).agg(F.min("doc_id").alias("seq"))
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    hosts = table(spark, folder, "pages").groupBy(host.alias("site")).agg((F.min("page_id") + 1000000000).alias("seq"))
    chunks = chunking.drop_tiny(_headed(spark, folder)).withColumnRenamed("source", "site")
    of_docs = table(spark, folder, "documents").select(F.col("source").alias("site"))
    return quality.site_quality(named.unionAll(hosts), of_docs, chunks)


@query("site_quality", f"WITH {CTE_SITES} SELECT * FROM quality")
def site_quality(spark, folder):
    return _sites(spark, folder)


@query(
    "site_summary",
    f"""
WITH {CTE_SITES}
SELECT count(*) FILTER (WHERE chunks > 0) AS successful, count(*) FILTER (WHERE chunks = 0) AS failed,
       round_even(avg(chunks) FILTER (WHERE chunks > 0), 1) AS avg_chunks, round_even(avg(avg_words) FILTER (WHERE chunks > 0), 1) AS avg_words,
       round_even(avg(hierarchical_pct) FILTER (WHERE chunks > 0), 1) AS avg_hierarchical_pct FROM quality
""",
)
def site_summary(spark, folder):
    return quality.site_summary(_sites(spark, folder))


@query(
    "site_best_worst",
    f"""
WITH {CTE_SITES}, g AS (SELECT site, seq, avg_words FROM quality WHERE chunks > 0), n AS (SELECT count(*) AS n FROM g),
b AS (SELECT site, avg_words FROM g ORDER BY avg_words DESC, seq LIMIT 1), w AS (SELECT site, avg_words FROM g ORDER BY avg_words, seq LIMIT 1)
SELECT b.site AS best, b.avg_words AS best_avg_words, CASE WHEN n > 1 THEN w.site END AS worst, CASE WHEN n > 1 THEN w.avg_words END AS worst_avg_words FROM b, w, n
""",
)
def site_best_worst(spark, folder):
    return quality.site_best_worst(_sites(spark, folder))
