"""One query per operator, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, decontaminate, langid, licenses, merkle, prefix, quality, runindex, simhash, substring, targeting, toxicity, warc

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
    return spark.read.parquet(f"{folder}/{name}.parquet")


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, folder, "documents"), path, pattern), path))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "text", "removed")


SQL_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])"""


@query(
    "op1_benchmark_decontamination",
    f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, s, least(s + 9, len(w))) AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS m FROM iw),
dw AS (SELECT doc_id, s, m, list_slice(w, s, s + m - 1) AS win
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, s, m, win FROM dw WHERE win IN (SELECT win FROM iw)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM hits) GROUP BY 1),
pairs AS (SELECT DISTINCT doc_id, item_id FROM hits JOIN iw USING (win)),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM pairs GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))[0]


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_prefix_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return prefix.fingerprints(table(spark, folder, "documents"))


@query(
    "op8_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN o USING (d)""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    templates = licenses.NOTICES | licenses.TEXTS
    return licenses.best_in_place(licenses.scan(table(spark, folder, "documents"), templates), templates)


@query(
    "op11_suffix_array_dedup",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT r, j, substr(h, 2 * j + 1, 2 * (255 + {runindex.LENGTH})) AS part
           FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {runindex.LENGTH} + 1, 256)) AS j FROM d)),
w AS (SELECT r, j + i AS i, md5(substr(part, 2 * i + 1, {2 * runindex.LENGTH})) AS m
      FROM (SELECT r, j, part, unnest(range(0, len(part) // 2 - {runindex.LENGTH} + 1)) AS i FROM blocks)),
often AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w WHERE m IN (SELECT m FROM often)),
runs AS (SELECT r, i, count(*) FILTER (WHERE before IS NULL OR i > before + {runindex.LENGTH}) OVER (PARTITION BY r ORDER BY i) AS run FROM hits),
spans AS (SELECT r, min(i) AS a, max(i) + {runindex.LENGTH} AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y, a, b FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
        FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return runindex.long_matches(table(spark, folder, "documents")).drop("removed")


#: SQL: the table of the reflected CRC-32, and the crc32 of the UTF-8 bytes of the column w.
SQL_CRC_TABLE = """list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
SQL_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(t[xor(a % 256, b) + 1], a // 256)), 4294967295)"""


def merkle_sql(depth: int = 5, top_depth: int = 4) -> str:
    """The manifest's SQL for up to 16 to the ``depth`` rows a source and 16 to the ``top_depth`` sources."""

    def h(text: str) -> str:
        fields = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    parts = [
        f"crc AS (SELECT {SQL_CRC_TABLE} AS t)",
        f"rows AS (SELECT coalesce('=' || source, '') AS s, source, doc_id, {h('text')} AS leaf, {SQL_CRC} % 5 = 0 AS hit, {h("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low"
        " FROM (SELECT *, doc_id::VARCHAR AS w FROM documents), crc)",
        "a0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, leaf AS d, source, doc_id, CASE WHEN hit THEN low ELSE leaf END AS claimed FROM rows)",
    ]

    def tree(name: str, height: int) -> None:
        for k in range(height):
            parts.append(f"{name}run{k} AS (SELECT s, i // 16 AS i, (max(n) + 15) // 16 AS n, list(d ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY s, i // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT s, i, n, sha256(array_to_string(run, '')) AS d FROM {name}run{k} UNION ALL SELECT s, i, n, d FROM {name}{k} WHERE n = 1)")

    tree("a", depth)
    parts.append(f"b0 AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n, d, s AS source_key FROM a{depth})")
    tree("b", top_depth)
    parts.append("f0 AS (SELECT s, i, source, doc_id, d AS leaf, claimed AS folded, '' AS proof FROM a0)")

    def fold(name: str, height: int, start: int, before: str) -> None:
        for k in range(height):
            slot = f"(f.i // {16**k}) % 16"
            left, right = f"array_to_string(run[:{slot}], '')", f"array_to_string(run[{slot} + 2:], '')"
            parts.append(
                f"f{start + k + 1} AS (SELECT f.* EXCLUDE (folded, proof), CASE WHEN run IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded,"
                f" proof || CASE WHEN run IS NULL THEN '' ELSE {left} || {right} END AS proof FROM {before} f LEFT JOIN {name}run{k} g ON g.s = f.s AND g.i = f.i // {16 ** (k + 1)})"
            )
            before = f"f{start + k + 1}"

    fold("a", depth, 0, "f0")
    parts.append(f"g0 AS (SELECT '' AS s, b0.i, source, doc_id, leaf, folded, proof, b0.d AS subroot FROM f{depth} f JOIN b0 ON b0.source_key = f.s)")
    fold("b", top_depth, depth, "g0")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, source, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.d AS verified FROM f{depth + top_depth} f, b{top_depth} t"""


@query("op12_merkle_manifest", merkle_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


@query(
    "op13_importance_resampling",
    f"""
WITH crc AS (SELECT {SQL_CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest({SQL_WORDS}) AS w FROM benchmark),
v AS (SELECT w, {SQL_CRC} % 10000 AS k FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT k, count(*) AS n FROM dw JOIN v USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN v USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT k FROM v) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
weights AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (k) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return targeting.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
