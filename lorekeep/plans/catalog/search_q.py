"""Search, index and lookup queries over entries made from documents and their vectors."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import functions as F

from lorekeep.functions import vectors as vx
from lorekeep.operators import search
from lorekeep.plans import ask
from lorekeep.plans.catalog.registry import CTE_ENTRIES, docs, entries, query, table
from lorekeep.session import cut_lineage, scratch_path

THRESHOLD = 0.1
BIG = "bigint"

CTE_QUESTION = "question AS (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)"
SQL_COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
CTE_HITS = f"""{CTE_ENTRIES},
scored AS (
  SELECT q.vec_id AS question_id, e.id, {SQL_COSINE.format('q.embedding', 'e.embedding')} AS s
  FROM embeddings q JOIN entries e ON e.business_id = 'biz-' || q.label WHERE e.is_active),
hits AS (
  SELECT question_id, id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS hit_rank
  FROM scored WHERE s >= {THRESHOLD})"""


def _question(spark, folder):
    """The one question of the single-question searches: the vector with the smallest id."""
    vector = table(spark, folder, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]
    return list(vector)


def _questions(spark, folder):
    """Every vector asks within its own tenant."""
    tenant = F.concat(F.lit("biz-"), F.col("label").cast("string"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), tenant.alias("business_id"), "embedding")


def _hits(spark, folder):
    return search.search_batch(entries(spark, folder), _questions(spark, folder), THRESHOLD)


def _shown(hits):
    return hits.select("question_id", "id", F.round("similarity", 6).alias("similarity"), F.col("hit_rank").cast(BIG).alias("hit_rank"))


def _stored(spark, folder):
    """Entries in the shape of the stored table, metadata missing for French documents."""
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    meta = F.when(F.col("lang") != "fr", F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')))
    return entries(spark, folder).withColumns({"metadata": meta, "created_at": when, "updated_at": F.when(F.col("lang") == "en", when)})


@query(
    "kb_scan",
    f"WITH {CTE_ENTRIES} SELECT id, business_id, category, title, content AS text, CASE WHEN lang <> 'fr' THEN '{{\"lang\":\"' || lang || '\"}}' END AS metadata FROM entries",
)
def kb_scan(spark, folder):
    return search.kb_scan(_stored(spark, folder)).drop("created_at", "updated_at")


@query("cosine", f"SELECT a.vec_id, round({SQL_COSINE.format('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")
def cosine(spark, folder):
    vectors = table(spark, folder, "embeddings")
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(before, "vec_id").select("vec_id", F.round(vx.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"))


CTE_ONE = f"""{CTE_ENTRIES}, {CTE_QUESTION},
one AS (SELECT id, category, {SQL_COSINE.format('embedding', 'q')} AS s FROM entries, question WHERE business_id = 'biz-3' AND is_active)"""


@query("kb_search_filter", f"WITH {CTE_ONE} SELECT id, round(s, 6) AS similarity FROM one WHERE s >= {THRESHOLD}")
def kb_search_filter(spark, folder):
    found = search.eligible(entries(spark, folder), "biz-3", _question(spark, folder), THRESHOLD)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


@query("kb_search", f"WITH {CTE_ONE} SELECT id, category, round(s, 6) AS similarity FROM one WHERE s >= {THRESHOLD} ORDER BY s DESC, id LIMIT 3")
def kb_search(spark, folder):
    found = search.search(entries(spark, folder), "biz-3", _question(spark, folder), THRESHOLD)
    return found.select("id", "category", F.round("similarity", 6).alias("similarity"))


@query("kb_search_batch", f"WITH {CTE_HITS} SELECT * FROM hits WHERE hit_rank <= 3")
def kb_search_batch(spark, folder):
    return _shown(_hits(spark, folder))


@query(
    "context_count",
    f"WITH {CTE_HITS} SELECT e.vec_id AS question_id, count(h.id) AS context_count FROM embeddings e LEFT JOIN hits h ON e.vec_id = h.question_id AND h.hit_rank <= 3 GROUP BY e.vec_id",
)
def context_count(spark, folder):
    return search.context_count(_questions(spark, folder), _hits(spark, folder))


@query(
    "search_format",
    f"""
WITH {CTE_HITS},
f AS (SELECT h.*, e.title, e.content, e.lang, to_timestamp(1700000000 + e.id) AT TIME ZONE 'UTC' AS t FROM hits h JOIN entries e ON h.id = e.id WHERE hit_rank <= 3)
SELECT question_id, hit_rank, CAST(id AS VARCHAR) AS id, title, content AS text, similarity,
       CASE WHEN lang <> 'fr' THEN '{{\"lang\":\"' || lang || '\"}}' ELSE '{{}}' END AS metadata,
       strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at,
       CASE WHEN lang = 'en' THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS updated_at
FROM f
""",
)
def search_format(spark, folder):
    shown = search.format_hits(search.with_entries(_hits(spark, folder), _stored(spark, folder)))
    return shown.select(
        "question_id", F.col("hit_rank").cast(BIG).alias("hit_rank"), "id", "title", "text",
        F.round("similarity", 6).alias("similarity"), "metadata", "created_at", "updated_at",
    )


def _sql_vectors(name: str, source: str) -> str:
    """Places and values of the offline vectors of texts (key, text), and their lengths."""
    return f"""
{name}_said AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ({source})),
{name}_coded AS (SELECT key, CAST('0x' || left(md5(w), 8) AS BIGINT) AS c FROM {name}_said),
{name}_places AS (SELECT key, c % 1536 AS place, sum(CASE WHEN c >= 2147483648 THEN 1 ELSE -1 END) AS v FROM {name}_coded GROUP BY ALL),
{name}_sized AS (SELECT *, sqrt(CAST(sum(v * v) OVER (PARTITION BY key) AS DOUBLE)) AS size FROM {name}_places),
{name}_v AS (SELECT key, place, CAST(CAST(v AS FLOAT) / CAST(size AS FLOAT) AS DOUBLE) AS x FROM {name}_sized WHERE v <> 0),
{name}_n AS (SELECT key, sqrt(sum(x * x)) AS n FROM {name}_v GROUP BY key)"""


@query(
    "kb_search_text",
    f"""
WITH {_sql_vectors("e", "SELECT doc_id AS key, text FROM documents")},
{_sql_vectors("q", "SELECT conv_id || '-' || turn AS key, text FROM conversations")},
dots AS (SELECT q_v.key AS question_id, e_v.key AS id, sum(e_v.x * q_v.x) AS d FROM e_v JOIN q_v USING (place) GROUP BY ALL),
scored AS (SELECT question_id, id, round(d / e_n.n / q_n.n, 12) AS s FROM dots JOIN e_n ON e_n.key = id JOIN q_n ON q_n.key = question_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS hit_rank FROM scored WHERE s >= 0.3)
SELECT question_id, CAST(hit_rank AS INTEGER) AS hit_rank, CAST(id AS VARCHAR) AS id, round(s, 6) AS similarity, left(text, 50) AS title,
       strftime(to_timestamp(1700000000 + id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at
FROM hits JOIN documents ON doc_id = id WHERE hit_rank <= 3""",
)
def kb_search_text(spark, folder):
    """Every turn as a question against all documents, embedded offline. One tenant."""
    from lorekeep.operators.embed import embed_chunks

    stored = embed_chunks(_corpus(spark, folder), text="content")
    talk = table(spark, folder, "conversations")
    number = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = talk.select(number.alias("question_id"), F.lit("all").alias("business_id"), F.col("text").alias("question"))
    found = ask.query_knowledge(stored, asked, 0.3)
    return found.select("question_id", "hit_rank", "id", F.round("similarity", 6).alias("similarity"), "title", "created_at")


def _corpus(spark, folder):
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return docs(spark, folder).select(
        F.col("doc_id").alias("id"), F.lit("all").alias("business_id"), F.col("lang").alias("category"),
        F.left("text", F.lit(50)).alias("title"), F.col("text").alias("content"),
        F.to_json(F.struct("source", "lang")).alias("metadata"), F.lit(True).alias("is_active"),
        when.alias("created_at"), when.alias("updated_at"),
    )


@query("ann_build")
def ann_build(spark, folder):
    """Entries per cell after building ten inverted lists."""
    celled, _ = search.ann_build(entries(spark, folder), lists=10)
    return celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n_entries"))


@query("ann_search")
def ann_search(spark, folder):
    """Approximate search of all questions in the three nearest of ten cells."""
    celled, index = search.ann_build(entries(spark, folder), lists=10)
    return _shown(search.search_batch(celled, _questions(spark, folder), THRESHOLD, index=index, nprobe=3))


@query("ann_search_all_cells", f"WITH {CTE_HITS} SELECT * FROM hits WHERE hit_rank <= 3")
def ann_search_all_cells(spark, folder):
    """Probing every cell gives the exact result."""
    celled, index = search.ann_build(entries(spark, folder), lists=10)
    return _shown(search.search_batch(celled, _questions(spark, folder), THRESHOLD, index=index, nprobe=10))


#: Given centroids: the ten vectors of the smallest ids; the nearest by cosine is a vector's cell, the first of equal ones.
CTE_CELLS = f"""{CTE_ENTRIES},
given AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding AS c FROM embeddings QUALIFY cell < 10),
near AS (SELECT vec_id, label, embedding, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round({SQL_COSINE.format('embedding', 'c')}, 9) DESC, cell) AS place FROM embeddings, given),
celled AS (SELECT e.*, n.cell FROM entries e LEFT JOIN near n ON e.id = n.vec_id AND n.place = 1)"""


def _celled(spark, folder):
    """Entries saved by cell, and an index that was saved and read again."""
    given = table(spark, folder, "embeddings").orderBy("vec_id").limit(10).select("embedding").collect()
    path = scratch_path(spark, "centroids")
    search.CellIndex(np.array([list(r[0]) for r in given], np.float64)).save(spark, path)
    index = search.CellIndex.load(spark, path)
    rows = entries(spark, folder).withColumn("cell", index.assign(F.col("embedding")))
    return search.save_by(rows, scratch_path(spark, "cells"), "cell"), index


@query("ann_cells", f"WITH {CTE_CELLS} SELECT id, CAST(cell AS INTEGER) AS cell FROM celled")
def ann_cells(spark, folder):
    """The cell of each entry under given centroids."""
    return _celled(spark, folder)[0].select("id", "cell")


@query(
    "ann_search_cells",
    f"""
WITH {CTE_CELLS},
scored AS (
  SELECT q.vec_id AS question_id, e.id, {SQL_COSINE.format('q.embedding', 'e.embedding')} AS s
  FROM near q JOIN celled e ON e.business_id = 'biz-' || q.label AND e.cell = q.cell WHERE q.place <= 3 AND e.is_active),
hits AS (SELECT question_id, id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS hit_rank FROM scored WHERE s >= {THRESHOLD})
SELECT * FROM hits WHERE hit_rank <= 3""",
)
def ann_search_cells(spark, folder):
    """Every question in the three nearest of ten given cells, of a table partitioned by cell: a search reads the cells
    it probes."""
    stored, index = _celled(spark, folder)
    return _shown(search.search_batch(stored, _questions(spark, folder), THRESHOLD, index=index, nprobe=3))


@query("ann_recall")
def ann_recall(spark, folder):
    """Of the exact hits, the share that ten fitted cells give for each number of probed cells."""
    # What a search reads, without the texts; written once, since the fit and each search read it again.
    searched = cut_lineage(entries(spark, folder).select("id", "business_id", "is_active", "embedding"))
    asked = _questions(spark, folder)
    celled, index = search.ann_build(searched, lists=10)
    stored, exact = cut_lineage(celled), cut_lineage(search.search_batch(searched, asked, THRESHOLD))
    shares = [
        search.recall(search.search_batch(stored, asked, THRESHOLD, index=index, nprobe=n), exact).withColumn("probes", F.lit(n)) for n in (1, 3, 7, 10)
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), shares)


@query("metadata_filter", "SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 42")
def metadata_filter(spark, folder):
    return search.metadata_filter(table(spark, folder, "events"), "props", "k", 42, "int").select("event_id", "user_id")


@query(
    "keyword_search",
    """
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS ws FROM documents)
SELECT doc_id FROM t WHERE list_contains(ws, 'the') AND list_contains(ws, 'with') AND list_contains(ws, 'for')
""",
)
def keyword_search(spark, folder):
    posted = search.postings(table(spark, folder, "documents"), key="doc_id", text="text")
    return search.keyword_search(posted, ["The", "with", "for"], key="doc_id")
