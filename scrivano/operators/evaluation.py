"""Retrieval metrics: precision, recall, reciprocal rank and normalised gain per case, and means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.functions.scoring import is_relevant
from scrivano.session import cut_lineage

DEFAULT_KS = (1, 3, 5)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal_gain(n_expected: Column, k: int) -> Column:
    """Sum of the first ``min(n_expected, k)`` gains; ``k`` is small, so the terms are spelled out."""
    total = F.lit(0.0)
    for place in range(1, k + 1):
        total = total + F.when(n_expected >= place, _gain(F.lit(place))).otherwise(0.0)
    return total


def judge(cases: DataFrame, hits: DataFrame, match: str = "contains") -> DataFrame:
    """Every case with its hits and a ``relevant`` flag; cases without hits keep one empty row."""
    joined = cases.join(
        hits.select(F.col("query_id").alias("case_id"), "rank", "section_path"), "case_id", "left"
    )
    expected = F.coalesce("expected_sections", F.array().cast("array<string>"))
    path = F.coalesce("section_path", F.lit(""))
    found = F.col("rank").isNotNull()
    return joined.withColumn("expected_sections", expected).withColumn(
        "relevant", found & is_relevant(path, expected, match)
    )


def evaluate(
    cases: DataFrame, hits: DataFrame, ks: Sequence[int] = DEFAULT_KS, match: str = "contains"
) -> DataFrame:
    """One row per case with all metrics, the retrieved paths and the top hit's path.

    ``cases``: ``case_id, query, expected_sections, category``; ``hits``: ``query_id, rank,
    section_path`` with at most ``max(ks)`` hits per case. Relevance is a substring test, so recall
    and gain above one are possible.
    """
    judged = judge(cases, hits, match)
    relevant = F.col("relevant")
    n_expected = F.size(F.first("expected_sections"))
    aggregates = [
        F.first("query").alias("query"),
        F.coalesce(F.first("category"), F.lit("unknown")).alias("category"),
        F.first("expected_sections").alias("expected_sections"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("rank").isNotNull(), F.struct("rank", "section_path"))
                )
            ),
            lambda h: h["section_path"],
        ).alias("retrieved_sections"),
        F.min_by("section_path", "rank").alias("top_section"),
        F.coalesce(F.lit(1.0) / F.min(F.when(relevant, F.col("rank"))), F.lit(0.0)).alias("mrr"),
    ]
    for k in ks:
        within = relevant & (F.col("rank") <= k)
        found = F.count_if(within)
        gain = F.coalesce(F.sum(F.when(within, _gain(F.col("rank")))), F.lit(0.0))
        ideal = _ideal_gain(n_expected, k)
        aggregates += [
            (found / F.lit(k) if k else F.lit(0.0)).alias(f"precision_at_{k}"),
            F.when(n_expected > 0, found / n_expected).otherwise(0.0).alias(f"recall_at_{k}"),
            F.when(ideal > 0, gain / ideal).otherwise(0.0).alias(f"ndcg_at_{k}"),
        ]
    return judged.groupBy("case_id").agg(*aggregates)


def mean_metrics(per_case: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    names = [f"{m}_at_{k}" for k in ks for m in ("precision", "recall", "ndcg")] + ["mrr"]
    return per_case.agg(
        F.count(F.lit(1)).alias("total_queries"),
        *[F.avg(name).alias(f"mean_{name}") for name in names],
    )


def _summary_text(ks: Sequence[int]) -> Column:
    lines = [F.format_string("Mean Reciprocal Rank (MRR): %.3f", F.col("mean_mrr"))]
    for label, name in (("Precision", "precision"), ("Recall", "recall"), ("NDCG", "ndcg")):
        lines.append(F.lit(f"{label}@K:"))
        lines += [
            F.format_string(f"  - {label}@{k}: %.3f", F.col(f"mean_{name}_at_{k}")) for k in ks
        ]
    return F.concat_ws("\n", *lines)


def summary(means: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """The report text, three decimals per figure, for any list of k."""
    return means.select(_summary_text(ks).alias("summary"))


def run(
    cases: DataFrame, hits: DataFrame, ks: Sequence[int] = DEFAULT_KS
) -> tuple[DataFrame, DataFrame]:
    """Per-case rows, and one row with the number of cases, the k list, the means and the report.

    Both come from one search: the per-case rows are kept in the shared checkpoint folder.
    """
    per_case = cut_lineage(evaluate(cases, hits, ks))
    report = (
        mean_metrics(per_case, ks)
        .withColumn("k_values", F.array(*[F.lit(k) for k in ks]))
        .withColumn("summary", _summary_text(ks))
    )
    return per_case, report
