"""Asking: question texts to ranked, formatted entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import embed, search
from lorekeep.session import cut_lineage


def embed_questions(questions: DataFrame, model: Callable | None = None, text: str = "question") -> DataFrame:
    return questions.withColumn("embedding", embed.embed(F.col(text), model))


def query_knowledge(
    entries: DataFrame,
    questions: DataFrame,
    threshold: float = search.MATCH_THRESHOLD,
    k: int = search.MATCH_COUNT,
    model: Callable | None = None,
    **options,
) -> DataFrame:
    """Formatted hits of question texts (question_id, business_id, question), best first by
    ``hit_rank``. Use ``search.context_count`` for questions without hits."""
    # written once: the plan looks at the vectors more than once, and a model may be costly
    asked = cut_lineage(embed_questions(questions, model).select("question_id", "business_id", "embedding"))
    hits = search.search_batch(entries, asked, threshold, k, **options)
    return search.format_hits(search.with_entries(hits, entries))


def query_knowledge_base(
    entries: DataFrame,
    question: str,
    business_id: str,
    threshold: float = search.MATCH_THRESHOLD,
    k: int = search.MATCH_COUNT,
    model: Callable | None = None,
) -> dict:
    """One question, answered on the driver with at most ``k`` sources. Errors become a result."""
    try:
        asked = entries.sparkSession.createDataFrame(
            [("q", business_id, question)], "question_id string, business_id string, question string"
        )
        rows = query_knowledge(entries, asked, threshold, k, model).orderBy("hit_rank").collect()
        names = ["id", "category", "title", "text", "similarity", "metadata", "created_at", "updated_at"]
        found = [{name: row[name] for name in names} for row in rows]
        return {"sources": found, "context_count": len(found), "business_id": business_id}
    except Exception as error:
        return {"sources": [], "context_count": 0, "error": str(error)}
