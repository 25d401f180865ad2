"""Registered queries with their DuckDB counterparts, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.schemas import CATEGORIES
from lorekeep.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Texts and pages are dealt out over the cores when they are small, since the work
    per row outweighs the move; see ``spread``."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def joined(array: Column, mark: str = "|") -> Column:
    return F.array_join(array, mark)


# ---- SQL fragments ------------------------------------------------------------------------------

# The same whitespace as ``text.SPACE``, listed for a regex engine without (?U).
SQL_SPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SQL_WORD = f"[^{SQL_SPACE}]+"
SQL_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + SQL_SPACE + "]"


def sql_words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{SQL_WORD}'))"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')"


def sql_uuid(digits: str) -> str:
    return f"regexp_replace({digits}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def sql_stable_id(*parts: str) -> str:
    glued = ", ".join(f"length({p}), ':', {p}" for p in parts)
    return sql_uuid(f"md5(concat({glued}))")


DOC_URL = "'https://' || source || '.test/' || lang || '/' || doc_id"
CTE_DOCS = f"docs AS (SELECT *, {DOC_URL} AS url FROM documents)"
# Lines of a document stand for chunks in the reports: one row per non-empty line, ix from 0.
CTE_LINES = f"""{CTE_DOCS},
doc_lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM docs),
lines AS (SELECT doc_id, source, lang, url, unnest(generate_series(0, len(ls) - 1)) AS ix, unnest(ls) AS text FROM doc_lines)"""

CTE_ENTRIES = """entries AS (
  SELECT d.doc_id AS id, 'biz-' || coalesce(e.label, d.doc_id % 10) AS business_id, d.text AS content, e.embedding,
         CASE d.lang WHEN 'en' THEN 'website' WHEN 'fr' THEN 'faq' WHEN 'es' THEN 'policy' ELSE 'technical' END AS category,
         left(d.text, 50) AS title, d.source AS source_id, d.lang, d.n_chars, coalesce(l.toxic, 0) = 0 AS is_active
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# ---- the same inputs in Spark -------------------------------------------------------------------


def doc_url() -> Column:
    return F.concat(F.lit("https://"), F.col("source"), F.lit(".test/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumn("url", doc_url())


def split_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", "source", "lang", "url", F.posexplode(split_lines(F.col("text"))).alias("ix", "text"))


def category_of_lang() -> Column:
    return F.when(F.col("lang") == "en", CATEGORIES[0]).when(F.col("lang") == "fr", CATEGORIES[1]).when(F.col("lang") == "es", CATEGORIES[2]).otherwise(CATEGORIES[5])


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an entry, its vector null where it has none: label (or last digit) = tenant, a toxic
    label = switched off."""
    toxic = table(spark, folder, "labels").select("doc_id", "toxic")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    joined_rows = table(spark, folder, "documents").join(vectors, "doc_id", "left").join(toxic, "doc_id", "left")
    return joined_rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("biz-"), F.coalesce(F.col("label").cast("bigint"), F.col("doc_id") % 10).cast("string")).alias("business_id"),
        F.col("text").alias("content"),
        "embedding",
        category_of_lang().alias("category"),
        F.left("text", F.lit(50)).alias("title"),
        F.col("source").alias("source_id"),
        "lang",
        "n_chars",
        (F.coalesce("toxic", F.lit(0)) == 0).alias("is_active"),
    )
