"""Retrieval metrics over labelled vectors: relevant means a path of the same label."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.functions.scoring import is_relevant
from scrivano.operators import evaluation as ev
from scrivano.operators import knn as nn
from scrivano.workloads import Registry, table

REGISTRY = Registry()

# A hit's path is label//number; a case expects one to three paths, some cases expect none.
_PATH = "label || '//' || (vec_id % 13)"
_EXPECTED = """case vec_id % 4 when 0 then array() when 1 then array(label || '//1')
  when 2 then array(label || '//1', label || '//2')
  else array(label || '//0', label || '//3', label || '//5') end"""
_EXPECTED_SQL = _EXPECTED.replace("array()", "[]::varchar[]").replace("array(", "list_value(")
_CATEGORY = "case when vec_id % 5 <> 0 then 'c' || (vec_id % 3) end"


def _cases_and_hits(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    cases = vecs.select(
        F.col("vec_id").alias("case_id"),
        F.expr("'vector ' || vec_id").alias("query"),
        F.expr(_EXPECTED).cast("array<string>").alias("expected_sections"),
        F.expr(_CATEGORY).alias("category"),
    )
    queries = vecs.select(
        F.col("vec_id").alias("query_id"), "embedding", (F.col("vec_id") % 7).alias("k")
    )
    collection = vecs.select(F.col("vec_id").alias("embedding_index"), "embedding")
    nearest = nn.knn(collection, queries, "k")
    paths = vecs.select(
        F.col("vec_id").alias("embedding_index"), F.expr(_PATH).alias("section_path")
    )
    hits = nn.fetch_hits(nearest, paths, "section_path", max_hits=nn.hit_rows(queries, "k"))
    return cases, hits


_SQL_JUDGED = f"""pairs as (select b.vec_id as case_id, a.vec_id as hit, b.vec_id % 7 as k,
      list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z:
        (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))::float::double as distance
      from embeddings a cross join embeddings b),
    ranked as (select *, row_number() over (partition by case_id order by distance, hit) as rank
      from pairs),
    cases as (select vec_id as case_id, {_EXPECTED_SQL} as expected, {_CATEGORY} as category
      from embeddings),
    paths as (select vec_id, {_PATH} as path from embeddings),
    judged as (select c.case_id, c.expected, c.category, r.rank, p.path,
        coalesce(len(list_filter(c.expected, lambda e: contains(p.path, e))) > 0, false) as rel
      from cases c left join (select * from ranked where rank <= k) r using (case_id)
      left join paths p on p.vec_id = r.hit)"""


def _sql_metrics():
    parts = ["coalesce(1.0::double / min(case when rel then rank end), 0) as mrr"]
    for k in ev.DEFAULT_KS:
        found = f"count(*) filter (where rel and rank <= {k})"
        n = "max(len(expected))"
        gain = f"coalesce(sum(1.0::double / log2(rank + 1)) filter (where rel and rank <= {k}), 0)"
        ideal = " + ".join(
            f"case when {n} >= {i} then 1.0::double / log2({i} + 1) else 0 end"
            for i in range(1, k + 1)
        )
        parts += [
            f"{found} / {k}::double as precision_at_{k}",
            f"case when {n} > 0 then {found} / {n}::double else 0 end as recall_at_{k}",
            f"case when {n} > 0 then {gain} / ({ideal}) else 0 end as ndcg_at_{k}",
        ]
    return parts


_METRICS = [f"{m}_at_{k}" for k in ev.DEFAULT_KS for m in ("precision", "recall", "ndcg")] + ["mrr"]
_SQL_PER_CASE = f"""{_SQL_JUDGED}, per_case as (select case_id,
    coalesce(any_value(category), 'unknown') as category,
    coalesce(string_agg(path, ' ' order by rank), '') as retrieved, min_by(path, rank) as top_section,
    {', '.join(_sql_metrics())} from judged group by case_id)"""


@REGISTRY.add(
    "relevant_hits",
    f"""with {_SQL_JUDGED} select case_id, path, rel as relevant,
      list_contains(expected, path) as exact from judged where path is not null""",
)
def relevant_hits(spark, sf_dir):
    cases, hits = _cases_and_hits(spark, sf_dir)
    judged = ev.judge(cases, hits).filter(F.col("section_path").isNotNull())
    return judged.select(
        "case_id",
        F.col("section_path").alias("path"),
        "relevant",
        is_relevant(F.col("section_path"), F.col("expected_sections"), "exact").alias("exact"),
    )


@REGISTRY.add(
    "evaluate_cases",
    f"""with {_SQL_PER_CASE} select case_id, category, retrieved, top_section,
      {', '.join(f'round({m}, 6) as {m}' for m in _METRICS)} from per_case""",
)
def evaluate_cases(spark, sf_dir):
    per_case = ev.evaluate(*_cases_and_hits(spark, sf_dir))
    return per_case.select(
        "case_id",
        "category",
        F.array_join("retrieved_sections", " ").alias("retrieved"),
        "top_section",
        *[F.round(m, 6).alias(m) for m in _METRICS],
    )


@REGISTRY.add(
    "mean_metrics",
    f"""with {_SQL_PER_CASE} select count(*) as total_queries,
      {', '.join(f'round(avg({m}), 6) as mean_{m}' for m in _METRICS)} from per_case""",
)
def mean_metrics(spark, sf_dir):
    _, report = ev.run(*_cases_and_hits(spark, sf_dir))
    return report.select(
        "total_queries", *[F.round(f"mean_{m}", 6).alias(f"mean_{m}") for m in _METRICS]
    )


def _sql_summary():
    lines = ["printf('Mean Reciprocal Rank (MRR): %.3f', avg(mrr))"]
    for label in ("Precision", "Recall", "NDCG"):
        lines.append(f"'{label}@K:'")
        lines += [
            f"printf('  - {label}@{k}: %.3f', avg({label.lower()}_at_{k}))" for k in ev.DEFAULT_KS
        ]
    return " || chr(10) || ".join(lines)


@REGISTRY.add(
    "evaluation_summary", f"with {_SQL_PER_CASE} select {_sql_summary()} as summary from per_case"
)
def evaluation_summary(spark, sf_dir):
    _, report = ev.run(*_cases_and_hits(spark, sf_dir))
    return report.select("summary")
