"""Chunk quality reports per source and per site. All of them reduce before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx

# Thresholds of the reports.
FRAGMENT_WORDS = 10
TINY_WORDS = 20
QUALITY_WORDS = (30, 200)
SMALL_AVERAGE, LARGE_AVERAGE = 50, 600
GRADE_STEPS = ((30, "POOR"), (50, "FAIR"), (100, "GOOD"))
TOP_GRADE = "EXCELLENT"
ARTIFACT = "right txt"
FRAGMENT_TERMS = ("years", "experience")
TOPICS = {"has_physio_content": ("physio",), "has_team_info": ("team", "staff"), "has_services": ("service",)}

NO_TITLE = "No title"


def _avg(value: Column, digits: int) -> Column:
    return tx.round_half_even(F.avg(value), digits)


def report_title(headings: Column) -> Column:
    depth = F.coalesce(F.size(headings), F.lit(0))
    return (
        F.when(depth > 1, F.array_join(F.slice(headings, -2, 2), " > "))
        .when(depth == 1, F.element_at(headings, 1))
        .otherwise(F.lit(NO_TITLE))
    )


def _size_columns(digits: int, text: str) -> list[Column]:
    n = tx.word_count(F.col(text))
    return [
        F.count(F.lit(1)).alias("total_chunks"),
        _avg(n, digits).alias("avg_words"),
        F.min(n).cast("bigint").alias("min_words"),
        F.max(n).cast("bigint").alias("max_words"),
        _avg(tx.char_count(F.col(text)), digits).alias("avg_chars"),
    ]


def _any_contains(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def _flag_columns(topics: dict[str, tuple[str, ...]] | None, artifact: str, fragments: tuple[str, ...], text: str) -> list[Column]:
    lowered = F.lower(F.col(text))
    flags = [F.bool_or(_any_contains(lowered, terms)).alias(name) for name, terms in (topics or TOPICS).items()]
    torn = _any_contains(lowered, fragments) & (tx.word_count(F.col(text)) < FRAGMENT_WORDS)
    return [
        *flags,
        (~F.bool_or(lowered.contains(artifact))).alias("no_right_txt_artifact"),
        (~F.bool_or(torn)).alias("no_fragmented_stats"),
    ]


def _title_columns() -> list[Column]:
    return [
        F.count_if(F.col("title").contains(" > ")).alias("hierarchical_titles"),
        F.count_distinct("title").alias("unique_titles"),
    ]


def chunk_report(chunks: DataFrame, by: list[str], digits: int = 1, text: str = "text") -> DataFrame:
    """Chunks, average/min/max words and average characters per source."""
    return chunks.groupBy(*by).agg(*_size_columns(digits, text))


def content_flags(
    chunks: DataFrame,
    by: list[str],
    topics: dict[str, tuple[str, ...]] | None = None,
    artifact: str = ARTIFACT,
    fragments: tuple[str, ...] = FRAGMENT_TERMS,
    text: str = "text",
) -> DataFrame:
    """Whether any chunk mentions each topic, and that none shows the artefact or a bare statistic."""
    return chunks.groupBy(*by).agg(*_flag_columns(topics, artifact, fragments, text))


def title_examples(chunks: DataFrame, by: list[str], order: list[str], examples: int = 5, headings: str = "headings") -> DataFrame:
    """First hierarchical titles of each source. Map tasks cut their share of a source to ``examples``
    rows before the shuffle, so titles are never collected by source."""
    titled = chunks.withColumn("title", report_title(F.col(headings))).filter(F.col("title").contains(" > "))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = titled.withColumn("_rank", rank).filter(F.col("_rank") <= examples)
    return first.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda s: s["title"]).alias("examples")
    )


def title_report(chunks: DataFrame, by: list[str], order: list[str], examples: int = 5, headings: str = "headings") -> DataFrame:
    """Hierarchical and distinct titles per source, with the first hierarchical ones as examples."""
    titled = chunks.withColumn("title", report_title(F.col(headings)))
    return titled.groupBy(*by).agg(*_title_columns()).join(title_examples(chunks, by, order, examples, headings), by, "left")


def full_report(
    chunks: DataFrame,
    by: list[str],
    order: list[str],
    digits: int = 1,
    topics: dict[str, tuple[str, ...]] | None = None,
    artifact: str = ARTIFACT,
    fragments: tuple[str, ...] = FRAGMENT_TERMS,
) -> DataFrame:
    """Size report, content flags, title report and issue list in one row per source.

    Texts are read for one aggregation that computes everything but the title examples; those read
    headings only.
    """
    titled = chunks.withColumn("title", report_title(F.col("headings")))
    columns = _size_columns(digits, "text") + _flag_columns(topics, artifact, fragments, "text") + _title_columns()
    report = titled.groupBy(*by).agg(*columns).join(title_examples(chunks, by, order), by, "left")
    return report.withColumn("issues", quality_issues(report))


def quality_issues(report: DataFrame) -> Column:
    """Issues of one report row with avg_words, the content flags and hierarchical_titles."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("avg_words") < SMALL_AVERAGE, "chunks too small"),
            F.when(c("avg_words") > LARGE_AVERAGE, "chunks too large"),
            F.when(~c("has_physio_content"), "missing physio content"),
            F.when(~c("no_right_txt_artifact"), "right txt artifacts"),
            F.when(~c("no_fragmented_stats"), "fragmented stats"),
            F.when(c("hierarchical_titles") == 0, "no hierarchical titles"),
        )
    )


def chunk_samples(chunks: DataFrame, by: list[str], order: list[str], n: int = 5, text: str = "text") -> DataFrame:
    """First ``n`` chunks of each source with a shortened text."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return chunks.withColumn("sample_no", rank).filter(F.col("sample_no") <= n).withColumns(
        {"content_preview": tx.preview(F.col(text)), "word_count": tx.word_count(F.col(text))}
    )


def grade(n_docs: Column, n_chunks: Column, avg_words: Column) -> Column:
    graded = F.when(n_docs == 0, "FAILED").when(n_chunks == 0, "POOR")
    for limit, name in GRADE_STEPS:
        graded = graded.when(avg_words < limit, name)
    return graded.otherwise(TOP_GRADE)


def site_quality(
    sites: DataFrame, docs: DataFrame, chunks: DataFrame, site: str = "site", digits: int = 1, text: str = "text", headings: str = "headings"
) -> DataFrame:
    """Grade and statistics of every listed site; sites without documents or chunks are kept.

    The grade looks at the unrounded average.
    """
    n = tx.word_count(F.col(text))
    per_doc = docs.groupBy(site).agg(F.count(F.lit(1)).alias("_docs"))
    per_chunk = chunks.groupBy(site).agg(
        F.count(F.lit(1)).alias("_chunks"),
        F.avg(n).alias("_avg"),
        F.min(n).alias("min_words"),
        F.max(n).alias("max_words"),
        F.count_if(F.size(headings) > 1).alias("_layered"),
        F.count_if(n < TINY_WORDS).alias("tiny_chunks"),
        F.count_if(n.between(*QUALITY_WORDS)).alias("quality_chunks"),
    )
    joined = sites.join(per_doc, site, "left").join(per_chunk, site, "left")
    n_docs, n_chunks = F.coalesce("_docs", F.lit(0)), F.coalesce("_chunks", F.lit(0))
    error = F.when(n_docs == 0, "No documents extracted").when(n_chunks == 0, "No chunks created")
    return joined.select(
        *sites.columns,
        grade(n_docs, n_chunks, F.col("_avg")).alias("status"),
        n_docs.alias("docs_extracted"),
        n_chunks.alias("chunks"),
        tx.round_half_even(F.coalesce("_avg", F.lit(0.0)), digits).alias("avg_words"),
        F.col("min_words").cast("bigint"),
        F.col("max_words").cast("bigint"),
        tx.round_half_even(tx.percentage(F.coalesce("_layered", F.lit(0)), n_chunks), digits).alias("hierarchical_pct"),
        F.coalesce("tiny_chunks", F.lit(0)).alias("tiny_chunks"),
        F.coalesce("quality_chunks", F.lit(0)).alias("quality_chunks"),
        error.alias("error"),
    )


def site_summary(quality: DataFrame, digits: int = 1) -> DataFrame:
    """Successful and failed sites, and means over the successful ones."""
    good = F.col("chunks") > 0

    def mean(name: str) -> Column:
        return tx.round_half_even(F.avg(F.when(good, F.col(name))), digits)

    return quality.agg(
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        mean("chunks").alias("avg_chunks"),
        mean("avg_words").alias("avg_words"),
        mean("hierarchical_pct").alias("avg_hierarchical_pct"),
    )


def site_best_worst(quality: DataFrame, site: str = "site", seq: str = "seq") -> DataFrame:
    """Best and worst successful site by average words, the earlier site on ties; worst only when
    more than one site succeeded."""
    good = quality.filter(F.col("chunks") > 0)
    return good.agg(
        F.max_by(site, F.struct("avg_words", -F.col(seq))).alias("best"),
        F.max("avg_words").alias("best_avg_words"),
        F.when(F.count(F.lit(1)) > 1, F.min_by(site, F.struct("avg_words", seq))).alias("worst"),
        F.when(F.count(F.lit(1)) > 1, F.min("avg_words")).alias("worst_avg_words"),
    )


def load_totals(results: DataFrame) -> DataFrame:
    """Totals of a load from its per-source rows (status, entry_count). A load that returns has no
    failed source unless failures were asked to be recorded."""
    return results.agg(
        F.coalesce(F.sum("entry_count"), F.lit(0)).cast("bigint").alias("total_entries"),
        F.count(F.lit(1)).alias("sources_processed"),
        F.count_if(F.col("status") == "loaded").alias("sources_successful"),
        F.count_if(F.col("status") == "failed").alias("sources_failed"),
    )
