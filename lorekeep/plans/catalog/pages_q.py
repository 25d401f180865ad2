"""Page cleaning, links, blocks, gates and crawling."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import crawl, html
from lorekeep.plans.catalog.registry import SQL_WORD, docs, query, sql_words, table
from lorekeep.plans.catalog.urls_q import CTE_LINKS, _links
from lorekeep.session import cut_lineage, dealt, tasks_for

#: Parts that a task reads as pages.
PAGE_ROWS = 20_000

SQL_CLEAN = "regexp_replace(html, '<nav\\b.*?</nav>|<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>', '', 'gis')"
SQL_UNESCAPE = "regexp_replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&amp;?', '&', 'g')"
SQL_TEXT = f"regexp_replace({SQL_CLEAN}, '<!--.*?-->|<[^>]*>', '', 'gs')"
SQL_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _escaped(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def _noisy(spark, folder, before: str, after: str):
    body = F.concat(F.lit(before + "<p>"), _escaped(F.col("text")), F.lit("</p>" + after))
    return docs(spark, folder).select("doc_id", body.alias("html"))


@query("link_extract", f"WITH {CTE_LINKS} SELECT url, link_ix, href FROM links")
def link_extract(spark, folder):
    found = html.extract_links(table(spark, folder, "pages"))
    return found.withColumn("link_ix", F.col("link_ix").cast("bigint"))


@query(
    "link_preview",
    f"""
WITH {CTE_LINKS}, g AS (SELECT url, list(target ORDER BY link_ix) AS ts FROM targets GROUP BY url)
SELECT url, array_to_string(ts[1:3], ' ') AS first_links, CAST(greatest(len(ts) - 3, 0) AS BIGINT) AS more FROM g
""",
)
def link_preview(spark, folder):
    return html.link_preview(cut_lineage(_links(spark, folder)))


@query("html_clean", f"SELECT url, {SQL_CLEAN} AS clean FROM pages")
def html_clean(spark, folder):
    return html.clean_html(table(spark, folder, "pages")).select("url", "clean")


@query("html_clean_noise", f"SELECT doc_id, '<p>' || {SQL_ESCAPED} || '</p><div class=\"ad\">kept</div>' AS clean FROM documents")
def html_clean_noise(spark, folder):
    noisy = _noisy(
        spark, folder,
        '<div class="Big-Cookie">x<div>y</div></div>',
        '<div class="ad">kept</div><section class="wide MODAL"><b>z</section><img class="ad-banner">',
    )
    return html.clean_html(noisy).select("doc_id", "clean")


@query(
    "html_clean_hidden",
    f"SELECT doc_id, '<div style=\"display: none\">shown</div><p>' || {SQL_ESCAPED} || '</p>' AS clean FROM documents",
)
def html_clean_hidden(spark, folder):
    noisy = _noisy(
        spark, folder,
        '<div style="display:none">x<p>y</div><div style="display: none">shown</div>',
        '<span style="color:red;visibility:hidden">z</span>',
    )
    return html.clean_html(noisy).select("doc_id", "clean")


@query("html_text", "SELECT doc_id, text FROM documents")
def html_text(spark, folder):
    noisy = _noisy(spark, folder, '<!-- c --><nav>n<nav>m</nav></nav><script>if (a < b) {}</script>', "<noscript>o</noscript>")
    return html.html_text(noisy).select("doc_id", "text")


@query(
    "html_blocks",
    f"""
WITH body AS (
  SELECT url, regexp_replace(regexp_replace({SQL_CLEAN}, '<!--.*?-->|<title>.*?</title>|<!DOCTYPE[^>]*>', '', 'gs'), '<br>', chr(10), 'g') AS h FROM pages),
cut AS (SELECT url, regexp_split_to_array(h, '</?(?:p|h1|div|article|footer|body|html|ul|li)\\b[^>]*>') AS ps FROM body),
inline_gone AS (SELECT url, list_transform(ps, lambda p: regexp_replace(p, '<[^>]*>', '', 'g')) AS ps FROM cut),
plain AS (SELECT url, list_filter(list_transform(ps, lambda p: array_to_string(regexp_extract_all({SQL_UNESCAPE.format('p')}, '{SQL_WORD}'), ' ')), lambda p: p <> '') AS ps FROM inline_gone)
SELECT url, unnest(generate_series(0, len(ps) - 1)) AS ix, unnest(ps) AS text FROM plain
""",
)
def html_blocks(spark, folder):
    blocks = html.html_blocks(table(spark, folder, "pages")).select("url", F.inline("blocks"))
    return blocks.select("url", F.col("ix").cast("bigint").alias("ix"), "text")


@query(
    "size_gate",
    f"WITH w AS (SELECT url, {sql_words(SQL_TEXT)} AS n_words FROM pages) SELECT url, n_words FROM w WHERE n_words <= 400",
)
def size_gate(spark, folder):
    parsed = table(spark, folder, "pages").select("url", html.read_page(F.col("html"), "n_words")["n_words"].cast("bigint").alias("n_words"))
    return html.size_gate(parsed, F.col("n_words"), 400)


@query(
    "size_gate_doc",
    f"WITH w AS (SELECT doc_id, {sql_words('text')} AS n_words FROM documents) SELECT doc_id, n_words FROM w WHERE n_words <= 400",
)
def size_gate_doc(spark, folder):
    written = html.markdown(html.text_blocks(F.col("text")))
    sized = docs(spark, folder).select("doc_id", tx.word_count(written).cast("bigint").alias("n_words"))
    return html.size_gate(sized, F.col("n_words"), 400)


@query(
    "table_sentences",
    """
WITH t AS (SELECT p_partkey, p_name, ['Brand', 'Type', 'Size', 'Price'] AS names,
                  [p_brand, p_type, CAST(p_size AS VARCHAR), CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)] AS vals FROM part),
u AS (SELECT p_partkey, p_name, unnest([1, 2, 3, 4]) AS column_ix, unnest(names) AS name, unnest(vals) AS val FROM t)
SELECT p_partkey, CAST(column_ix AS BIGINT) AS column_ix, p_name || ', ' || name || ' = ' || val AS sentence FROM u
""",
)
def table_sentences(spark, folder):
    """Each part as a page with a table of a header and one row, read by the page parser."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    cells = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"), cents)
    header = "".join(f"<th>{name}</th>" for name in ("Name", "Brand", "Type", "Size", "Price"))
    row = F.array_join(F.transform(cells, lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))), "")
    page = F.concat(F.lit(f"<p>Parts</p><table><tr>{header}</tr><tr>"), row, F.lit("</tr></table>"))
    # Many parts fit into a file of one row group, which would be one task.
    parts = dealt(table(spark, folder, "part"), PAGE_ROWS, "p_partkey")
    blocks = html.html_blocks(parts.select("p_partkey", page.alias("html"))).select("p_partkey", F.inline("blocks"))
    said = blocks.filter("kind = 'table'").select("p_partkey", F.posexplode(F.split("text", r"\. ")).alias("at", "sentence"))
    return said.select("p_partkey", (F.col("at") + 1).cast("bigint").alias("column_ix"), "sentence")


# ---- crawling over a link graph -----------------------------------------------------------------

# Every customer is a site whose home page links the first part of each order; each part of an order
# links the next one. Parts bought in several orders make the graph branch and meet.
CTE_GRAPH = """li AS (
  SELECT o.o_custkey AS site, l.l_partkey AS part,
         lag(l.l_partkey) OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS prev
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
edges AS (
  SELECT DISTINCT 'https://c' || site || '.test/' || CASE WHEN prev IS NULL THEN '' ELSE 'p' || prev END AS src,
         'https://c' || site || '.test/p' || part AS dst FROM li WHERE prev IS NULL OR prev <> part)"""
CTE_CRAWL = """roots AS (SELECT DISTINCT 'https://c' || c_custkey || '.test/' AS root FROM customer),
walk(root, url, depth) AS (
  SELECT root, root, 0 FROM roots
  UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.url = e.src WHERE w.depth < 3),
nearest AS (SELECT root, url, min(depth) AS depth FROM walk GROUP BY root, url),
level_sizes AS (SELECT root, depth, count(*) AS n FROM nearest GROUP BY root, depth),
level_starts AS (SELECT root, depth, sum(n) OVER (PARTITION BY root ORDER BY depth) - n AS before FROM level_sizes),
crawled AS (
  SELECT n.root, n.url, n.depth FROM nearest n JOIN level_starts s ON n.root = s.root AND n.depth = s.depth
  WHERE n.depth = 0 OR s.before < 20)"""


def _graph(spark, folder):
    tasks = tasks_for(table(spark, folder, "lineitem"), crawl.TASK_ROWS)
    line = table(spark, folder, "lineitem").repartition(tasks, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("site"))
    prev = F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    step = line.join(order, "l_orderkey").withColumn("prev", prev)
    host = F.concat(F.lit("https://c"), F.col("site").cast("string"), F.lit(".test/"))
    come = F.when(F.col("prev").isNull(), host).otherwise(F.concat(host, F.lit("p"), F.col("prev").cast("string")))
    go = F.concat(host, F.lit("p"), F.col("l_partkey").cast("string"))
    return crawl.accepted_edges(step.select(come.alias("src"), go.alias("dst")).filter("src <> dst"), tasks)


def _crawled(spark, folder):
    home = F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".test/"))
    roots = table(spark, folder, "customer").select(home.alias("root"))
    return crawl.reachable(roots, _graph(spark, folder), max_depth=4, max_urls=20)


@query("crawl_reachable", f"WITH RECURSIVE {CTE_GRAPH}, {CTE_CRAWL} SELECT root, url, CAST(depth AS BIGINT) AS depth FROM crawled")
def crawl_reachable(spark, folder):
    return _crawled(spark, folder).withColumn("depth", F.col("depth").cast("bigint"))


@query("crawl_listing", f"WITH RECURSIVE {CTE_GRAPH}, {CTE_CRAWL} SELECT root, url FROM crawled ORDER BY root, url")
def crawl_listing(spark, folder):
    return crawl.listing(_crawled(spark, folder)).select("root", "url")


@query(
    "crawl_budget",
    f"""
WITH RECURSIVE {CTE_GRAPH}, {CTE_CRAWL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, url) AS r FROM crawled)
SELECT root, url, CAST(depth AS BIGINT) AS depth FROM ranked WHERE r <= 5
""",
)
def crawl_budget(spark, folder):
    return crawl.budget(_crawled(spark, folder), 5).withColumn("depth", F.col("depth").cast("bigint"))


@query("crawl_new_links", f"WITH {CTE_GRAPH} SELECT dst AS url FROM edges EXCEPT SELECT src FROM edges")
def crawl_new_links(spark, folder):
    edges = cut_lineage(_graph(spark, folder))
    return crawl.new_links(edges.select(F.col("dst").alias("url")), edges.select(F.col("src").alias("url")), ["url"], tasks_for(edges, crawl.TASK_ROWS))
