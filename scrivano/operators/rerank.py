"""Re-ranking of hits: adjusted score, stable order, new rank; the reported distance stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions.scoring import CONFUSABLE_TERMS, definition_score, marked_score


def rerank(hits: DataFrame, score: Column, content: str = "content") -> DataFrame:
    """Order each query's hits by ``score``; equal scores keep their former rank order."""
    order = Window.partitionBy("query_id").orderBy("_score", "_before")
    return (
        hits.withColumn("_score", score)
        .withColumnRenamed("rank", "_before")
        .withColumn("rank", F.row_number().over(order))
        .drop("_score", "_before")
    )


def boost_definitions(
    hits: DataFrame,
    when: Column | None = None,
    content: str = "content",
    topic_penalties: bool = False,
    marks: str | None = None,
) -> DataFrame:
    """Prefer defining sections, for the queries where ``when`` holds (default: all).

    ``topic_penalties`` adds the penalty for sections on a confusable term. Queries with and
    without the boost share one plan: without it the score is the distance. Hits that carry the
    ``marks`` of their contents (``definition_marks``) need no content.
    """
    penalties = CONFUSABLE_TERMS if topic_penalties else ()
    if marks:
        score = marked_score(F.col("distance"), F.col(marks), penalties)
    else:
        score = definition_score(F.col("distance"), F.col(content), penalties)
    if when is not None:
        score = F.when(when, score).otherwise(F.col("distance"))
    return rerank(hits, score, content)


def cut(hits: DataFrame, n: Column | int) -> DataFrame:
    limit = F.lit(n) if isinstance(n, int) else n
    return hits.filter(F.col("rank") <= limit)
