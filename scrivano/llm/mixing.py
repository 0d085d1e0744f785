"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` of all
words; a target stops at ``cap`` times its source and the excess is shared again by weight. Solved in
closed form over sources ordered by cap per weight.

Copies: documents of a source are ranked by (size, id) and each is expected target / source size
times. Expected copies are prefix-summed, one offset per source is added, and a document is emitted
once per integer that its step crosses. Ordering by size keeps the words taken within one long
document of the target. Ranks come from a range partitioning and per-partition counts, so that no
source, however large, meets in one task.

Nulls: a null text has size 0, a null source is a source of its own, a null id ranks first. Repeated
rows count each. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
_ROW = (1 << 33) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) per source, the same on every run."""
    head = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, cap=CAP) -> DataFrame:
    """``source``, ``source_size`` -> and ``target``. One row per source."""
    everywhere = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("ratio", (F.col("source_size") * cap).cast("double") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everywhere).cast("double") * share_percent / 100)
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.sum("weight").over(after))
        .withColumn("_open", F.when(F.col("level") <= F.col("ratio"), F.struct(F.row_number().over(by_ratio), "level")))
        .withColumn("_level", F.min("_open").over(everywhere)["level"])
    )
    capped = (F.col("source_size") * cap).cast("double")
    level = F.coalesce(F.col("_level"), F.lit(float("inf")))
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("ratio") <= level, capped).otherwise(level * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share_percent=SHARE_PERCENT, cap=CAP,
        seed=SEED, carry: bool = False) -> DataFrame:
    """Per document: id, size, its source's size and target, ``copies`` and words ``taken``.

    ``carry`` also keeps every input column, as a struct ``row``.
    """
    parts = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")]
    if carry:
        parts.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first()]
    placed = scratch.keep(
        docs.select(*parts)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))),
        "mix",
    )
    runs = placed.groupBy("source", "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"), F.min("_at").alias("_from")
    )
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    wanted = targets(
        runs.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share_percent, cap
    )
    # One row per source and partition that it reaches: sources + partitions rows, not documents.
    known = runs.alias("r").join(
        wanted.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source"))
    ).select(F.col("r.source").alias("source"), "_part", "_from", "_before", "w.source_size", "target")
    joined = placed.alias("p").join(
        known.alias("k"),
        (F.col("p._part") == F.col("k._part")) & F.col("p.source").eqNullSafe(F.col("k.source")),
    )
    rank = F.col("k._before") + F.col("p._at") - F.col("k._from")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("p.source"), seed)
    copies = (F.floor(start + (rank + 1) * step) - F.floor(start + rank * step)).cast("long")
    return joined.select(
        "p.doc_id",
        "p.size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        copies.alias("copies"),
        (copies * F.col("p.size")).alias("taken"),
        *([F.col("p.row")] if carry else []),
    )


def mixed_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mix itself: every input column, a row per copy."""
    out = mix(docs, scratch, carry=True, **options).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = rf"""with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from totals),
rated as (select *, (source_size * 2)::double / weight as ratio,
    (sum(source_size) over ())::double * 150 / 100 as wanted from weighed),
leveled as (select *, (wanted - coalesce(sum(source_size * 2) over (order by ratio, source nulls last
      rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(weight) over (order by ratio, source nulls last
      rows between current row and unbounded following))::double as level,
    row_number() over (order by ratio, source nulls last) as place from rated),
chosen as (select arg_min(level, place) as level from leveled where level <= ratio),
wanted as (select source, source_size, case when ratio <= coalesce((select level from chosen), 'inf'::double)
    then (source_size * 2)::double else (select level from chosen) * weight end as target from leveled),
ranked as (select s.doc_id, s.size, w.source_size, w.target,
    row_number() over (partition by s.source order by s.size, s.doc_id nulls first) - 1 as rank,
    case when w.source_size > 0 then w.target / w.source_size else 0.0::double end as step,
    ('0x' || substr(md5('{SEED}' || coalesce(s.source, '')), 1, 8))::bigint / 4294967296.0::double as start
  from sized s join wanted w on s.source is not distinct from w.source)
select doc_id, size, source_size, target,
  ((floor(start + (rank + 1) * step) - floor(start + rank * step))::bigint * size)::bigint as taken
from ranked"""
