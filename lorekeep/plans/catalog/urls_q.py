"""Sources, URLs, sitemaps and fetch logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lorekeep.functions import ids
from lorekeep.functions import text as tx
from lorekeep.functions import urls as ux
from lorekeep.operators import html
from lorekeep.plans.catalog.registry import CTE_DOCS, docs, query, sql_strip, sql_uuid, sql_words, table
from lorekeep.session import scratch_path
from lorekeep.sources import lists, pages, sitemap

SQL_ORIGIN = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
CTE_LINKS = f"""hrefs AS (
  SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
links AS (
  SELECT url, unnest(generate_series(0, len(hs) - 1)) AS link_ix, unnest(hs) AS href FROM hrefs),
resolved AS (
  SELECT url, link_ix, href, {SQL_ORIGIN} || href AS full_url FROM links),
targets AS (
  SELECT url, link_ix, href, full_url,
         string_split(string_split(regexp_replace(full_url, '/+$', ''), '#')[1], '?')[1] AS target FROM resolved)"""
# URLs of pages and links, and deep www spellings of document URLs.
CTE_POOL = f"""{CTE_DOCS}, {CTE_LINKS},
pool AS (
  SELECT url FROM pages
  UNION ALL SELECT full_url FROM resolved
  UNION ALL SELECT 'https://www.' || source || '.test/' || lang || '/' || doc_id || '/' || n_chars || '/' FROM docs)"""


def _links(spark, folder):
    return html.resolve_links(html.extract_links(table(spark, folder, "pages")))


def _pool(spark, folder):
    found = html.extract_links(table(spark, folder, "pages"))
    c = F.col
    deep = F.concat(F.lit("https://www."), c("source"), F.lit(".test/"), c("lang"), F.lit("/"), c("doc_id"), F.lit("/"), c("n_chars"), F.lit("/"))
    return (
        table(spark, folder, "pages").select("url")
        .unionAll(found.select(ux.resolve(c("url"), c("href")).alias("url")))
        .unionAll(docs(spark, folder).select(deep.alias("url")))
    )


def _sql_path(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '{ux._PATH}', 1), ';[^/]*$', '')"


def _sql_netloc(url: str) -> str:
    return f"regexp_extract({url}, '{ux._NETLOC}', 1)"


def _sql_any(url: str, patterns) -> str:
    return "(" + " OR ".join(f"contains(lower({url}), '{p}')" for p in patterns) + ")"


def _sql_should_crawl(url: str) -> str:
    path = _sql_path(url)
    shallow = f"len(regexp_extract_all({path}, '[^/]+')) <= 2"
    return f"(NOT {_sql_any(url, ux.SKIP_PATTERNS)} AND ({path} IN ('', '/') OR {_sql_any(url, ux.CONTENT_PATTERNS)} OR {shallow}))"


# ---- source lists -------------------------------------------------------------------------------


@query(
    "source_list",
    f"""
WITH parts AS (
  SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p
  FROM conversations)
SELECT conv_id, turn, unnest(generate_series(0, len(p) - 1)) AS seq, unnest(p) AS source_url FROM parts
""",
)
def source_list(spark, folder):
    rows = lists.source_list(table(spark, folder, "conversations"), "text", ["conv_id", "turn"])
    return rows.withColumn("seq", F.col("seq").cast("bigint"))


@query("source_distinct", "SELECT DISTINCT 'https://' || source || '.test/' || lang AS source_url FROM documents")
def source_distinct(spark, folder):
    named = F.concat(F.lit("https://"), F.col("source"), F.lit(".test/"), F.col("lang"))
    return lists.distinct_sources(table(spark, folder, "documents").select(named.alias("source_url")))


CTE_MIXED = f"""{CTE_DOCS},
mixed AS (
  SELECT url AS source_url FROM pages
  UNION ALL
  SELECT CASE lang WHEN 'en' THEN url WHEN 'fr' THEN 'files/' || doc_id || '.PDF'
         WHEN 'es' THEN 'C:/' || doc_id || '.docx' ELSE doc_id || '.md' END FROM docs)"""
SQL_TYPE = """CASE WHEN lower(source_url) LIKE '%.pdf' THEN 'pdf'
     WHEN lower(source_url) LIKE 'http://%' OR lower(source_url) LIKE 'https://%' THEN 'website'
     WHEN lower(source_url) LIKE '%.doc' OR lower(source_url) LIKE '%.docx' THEN 'document' ELSE 'text' END"""


def _mixed(spark, folder):
    number = F.col("doc_id").cast("string")
    named = (
        F.when(F.col("lang") == "en", F.col("url"))
        .when(F.col("lang") == "fr", F.concat(F.lit("files/"), number, F.lit(".PDF")))
        .when(F.col("lang") == "es", F.concat(F.lit("C:/"), number, F.lit(".docx")))
        .otherwise(F.concat(number, F.lit(".md")))
    )
    return table(spark, folder, "pages").select(F.col("url").alias("source_url")).unionAll(
        docs(spark, folder).select(named.alias("source_url"))
    )


@query("source_type", f"WITH {CTE_MIXED} SELECT source_url, {SQL_TYPE} AS source_type FROM mixed")
def source_type(spark, folder):
    return _mixed(spark, folder).select("source_url", ux.source_type(F.col("source_url")).alias("source_type"))


@query(
    "source_route",
    f"""
WITH {CTE_MIXED}, typed AS (SELECT source_url, {SQL_TYPE} AS source_type FROM mixed)
SELECT source_url, source_type, starts_with(source_url, 'http') AS is_http,
       CASE WHEN source_type IN ('pdf', 'document') THEN 'quarantine'
            WHEN starts_with(source_url, 'http') THEN 'html' ELSE 'file' END AS route
FROM typed
""",
)
def source_route(spark, folder):
    return lists.route(_mixed(spark, folder))


@query(
    "sources_union",
    f"WITH {CTE_LINKS} SELECT url AS source_url FROM pages UNION SELECT target FROM targets",
)
def sources_union(spark, folder):
    listed = table(spark, folder, "pages").select(F.col("url").alias("source_url"))
    return lists.union_sources(listed, _links(spark, folder).select(F.col("target").alias("source_url")))


# ---- scans --------------------------------------------------------------------------------------


@query("page_scan", "SELECT url, html FROM pages")
def page_scan(spark, folder):
    """Bodies as bytes with a stray byte at either end, which decoding leaves out."""
    raw = table(spark, folder, "pages").select("url", F.concat(F.unhex(F.lit("FF")), F.encode("html", "utf-8"), F.unhex(F.lit("C3"))).alias("content"))
    return pages.page_scan(raw)


#: Files that the documents of a language are written to.
TEXT_FILES = 8


@query(
    "text_scan",
    f"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, count(*) AS n_lines, CAST(sum({sql_words('line')}) AS BIGINT) AS n_words FROM l GROUP BY lang
""",
)
def text_scan(spark, folder):
    """Documents written as text files, some for each language, and read back through one scan of bytes. Beside each
    folder of texts lies a file of another kind, which the scan leaves out."""
    path = scratch_path(spark, "text")
    rows = table(spark, folder, "documents").select("lang", "text").repartition("lang", F.pmod(F.xxhash64("doc_id"), F.lit(TEXT_FILES)))
    rows.write.partitionBy("lang").text(path)
    rows.select("lang").distinct().select("lang", F.lit("not a text").alias("value")).write.mode("append").partitionBy("lang").json(path)
    read = pages.text_scan(spark, path, "*.txt").select(F.regexp_extract("url", "/lang=([^/]*)/", 1).alias("lang"), "text")
    # Every line ends with a line break, the last too.
    lines = read.select("lang", F.explode(F.split(F.expr("left(text, length(text) - 1)"), "\n")).alias("line")).where("line is not null")
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(tx.word_count(F.col("line"))).cast("bigint").alias("n_words"))


@query(
    "fetch_outcome",
    """
WITH log AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS attempt,
         CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 500 WHEN 'click' THEN 200 END AS status,
         CASE event_type WHEN 'view' THEN 'timeout' WHEN 'purchase' THEN 'dns' END AS error
  FROM events),
kinds AS (
  SELECT *, CASE WHEN status = 403 THEN 'bot_protected' WHEN status = 200 THEN 'ok' WHEN status IS NOT NULL THEN 'http_error'
                 WHEN error = 'timeout' THEN 'timeout' ELSE 'error' END AS kind FROM log WHERE attempt <= 2),
one AS (SELECT * FROM kinds WHERE attempt = 1), two AS (SELECT * FROM kinds WHERE attempt = 2),
pick AS (
  SELECT one.user_id, one.day,
         CASE WHEN one.kind IN ('ok', 'bot_protected', 'error') OR two.kind IS NULL THEN 1 ELSE 2 END AS attempts,
         one.kind AS k1, two.kind AS k2, one.status AS s1, two.status AS s2
  FROM one LEFT JOIN two ON one.user_id = two.user_id AND one.day = two.day)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE attempts WHEN 1 THEN k1 ELSE k2 END AS outcome,
       CASE attempts WHEN 1 THEN s1 ELSE s2 END AS status, CAST(attempts AS BIGINT) AS attempts FROM pick
""",
)
def fetch_outcome(spark, folder):
    kind = F.col("event_type")
    log = table(spark, folder, "events").select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "event_id",
        F.when(kind == "error", 403).when(kind == "signup", 500).when(kind == "click", 200).alias("status"),
        F.when(kind == "view", "timeout").when(kind == "purchase", "dns").alias("error"),
    )
    numbered = log.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("event_id")))
    found = pages.fetch_outcome(numbered, ["user_id", "day"])
    return found.withColumn("attempts", F.col("attempts").cast("bigint"))


# ---- sitemaps -----------------------------------------------------------------------------------

# Every page stands for a site with a sitemap that lists the page and its links.
CTE_SITEMAP = f"""{CTE_LINKS},
located AS (
  SELECT url AS base_url, url FROM pages WHERE NOT contains(url, '?')
  UNION ALL SELECT url, full_url FROM resolved WHERE NOT contains(url, '?')
  UNION ALL SELECT url, regexp_replace(url, '/+$', '') FROM pages WHERE contains(url, '?'))"""


def _sitemaps(spark, folder):
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    locs = F.transform(hrefs, lambda h: F.concat(F.lit("<url><loc>"), origin, h, F.lit("</loc></url>")))
    own = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'),
        own, F.lit("</loc></url>"), F.array_join(locs, ""), F.lit("</urlset>"),
    )
    status = F.when(F.col("url").contains("?"), 404).otherwise(200)
    return table(spark, folder, "pages").select(F.col("url").alias("base_url"), status.alias("status"), xml.alias("xml"))


@query(
    "sitemap_location",
    "SELECT url AS base_url, regexp_replace(string_split(string_split(url, '#')[1], '?')[1], '[^/]*$', 'sitemap.xml') AS sitemap_url FROM pages",
)
def sitemap_location(spark, folder):
    return sitemap.sitemap_location(table(spark, folder, "pages").select(F.col("url").alias("base_url")))


@query("sitemap_urls", f"WITH {CTE_SITEMAP} SELECT base_url, url FROM located")
def sitemap_urls(spark, folder):
    return sitemap.sitemap_urls(_sitemaps(spark, folder))


@query(
    "sitemap_extract",
    f"""
WITH {CTE_SITEMAP}
SELECT base_url, count(*) FILTER (WHERE {_sql_should_crawl('url')}) AS kept, count(*) AS total FROM located GROUP BY base_url
""",
)
def sitemap_extract(spark, folder):
    return sitemap.filter_report(sitemap.sitemap_urls(_sitemaps(spark, folder)), ["base_url"])


@query(
    "sitemap_pages",
    f"""
WITH {CTE_SITEMAP}
SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM located WHERE {_sql_should_crawl('url')})
""",
)
def sitemap_pages(spark, folder):
    return sitemap.sitemap_pages(_sitemaps(spark, folder), table(spark, folder, "pages")).select("page_id", "url")


# ---- URL expressions ----------------------------------------------------------------------------


@query("should_crawl", f"WITH {CTE_POOL} SELECT url, {_sql_should_crawl('url')} AS accepted FROM pool")
def should_crawl(spark, folder):
    return _pool(spark, folder).select("url", ux.should_crawl(F.col("url")).alias("accepted"))


@query(
    "path_depth",
    f"WITH {CTE_POOL} SELECT url, {_sql_path('url')} AS path, CAST(len(list_filter(string_split({_sql_path('url')}, '/'), lambda x: x <> '')) AS BIGINT) AS depth FROM pool",
)
def path_depth(spark, folder):
    return _pool(spark, folder).select("url", ux.path(F.col("url")).alias("path"), ux.path_depth(F.col("url")).cast("bigint").alias("depth"))


@query(
    "url_normalize",
    f"WITH {CTE_POOL} SELECT url, string_split(string_split(regexp_replace(url, '/+$', ''), '#')[1], '?')[1] AS normalized FROM pool",
)
def url_normalize(spark, folder):
    return _pool(spark, folder).select("url", ux.normalize(F.col("url")).alias("normalized"))


@query(
    "url_canonical",
    f"""
WITH {CTE_POOL}
SELECT url, regexp_replace(lower(string_split(url, ':')[1]) || '://' || replace({_sql_netloc('url')}, 'www.', '') || {_sql_path('url')}, '/+$', '') AS canonical
FROM pool
""",
)
def url_canonical(spark, folder):
    return _pool(spark, folder).select("url", ux.canonical(F.col("url")).alias("canonical"))


@query(
    "same_site",
    f"""
WITH {CTE_LINKS},
pairs AS (
  SELECT url AS base, full_url AS url FROM resolved
  UNION ALL SELECT p.url, q.url FROM pages p JOIN pages q ON p.page_id = q.page_id + 1
  UNION ALL SELECT url, regexp_replace(url, '^(https?://)', '\\1www.') FROM pages)
SELECT base, url, replace({_sql_netloc('url')}, 'www.', '') = replace({_sql_netloc('base')}, 'www.', '') AS same FROM pairs
""",
)
def same_site(spark, folder):
    page = table(spark, folder, "pages")
    found = html.extract_links(page)
    after = page.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("other"))
    pairs = (
        found.select(F.col("url").alias("base"), ux.resolve(F.col("url"), F.col("href")).alias("url"))
        .unionAll(page.join(after, "page_id").select("url", "other"))
        .unionAll(page.select("url", F.regexp_replace("url", "^(https?://)", "$1www.")))
    )
    return pairs.select("base", "url", ux.same_site(F.col("url"), F.col("base")).alias("same"))


@query("link_resolve", f"WITH {CTE_LINKS} SELECT url, link_ix, href, full_url AS resolved, target FROM targets")
def link_resolve(spark, folder):
    return _links(spark, folder).withColumn("link_ix", F.col("link_ix").cast("bigint"))


@query(
    "uuid_valid",
    f"""
WITH c AS (
  SELECT doc_id, lang, md5(text) AS h FROM documents),
v AS (
  SELECT doc_id, h, lang, CASE lang WHEN 'en' THEN {sql_uuid('upper(h)')} WHEN 'fr' THEN '{{' || h || '}}' WHEN 'es' THEN 'urn:uuid:' || h ELSE left(h, 31) END AS candidate FROM c)
SELECT doc_id, candidate, lang <> 'de' AS valid, CASE WHEN lang <> 'de' THEN {sql_uuid('h')} END AS canonical FROM v
""",
)
def uuid_valid(spark, folder):
    digest = F.md5("text")
    spelled = (
        F.when(F.col("lang") == "en", ids._hyphenate(F.upper(digest)))
        .when(F.col("lang") == "fr", F.concat(F.lit("{"), digest, F.lit("}")))
        .when(F.col("lang") == "es", F.concat(F.lit("urn:uuid:"), digest))
        .otherwise(F.left(digest, F.lit(31)))
    )
    rows = table(spark, folder, "documents").select("doc_id", spelled.alias("candidate"))
    return rows.withColumns(
        {"valid": ids.uuid_valid(F.col("candidate")), "canonical": ids.uuid_canonical(F.col("candidate"))}
    )
