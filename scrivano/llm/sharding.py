"""Uniform shuffle into shards of exact size, in DataFrame operations only.

Rows are dealt into logical parts by a hash. A communication matrix says how many rows of each part go
to each shard: it is drawn from the multivariate hypergeometric law, so that its row sums are the
parts' counts and its column sums the shards' exact sizes. Within a part rows are permuted and cut by
the matrix; after the exchange they are permuted again inside the shard. The second permutation works
in buckets of a random key with prefix-summed counts, so a shard never meets in one task.

Only the parts' counts (at most ``MAX_PARTS``) reach the driver. Law: ``rows``, counts at most one
apart. A null text has no bytes; null ids and repeated rows are dealt like any others, fully equal
rows in any order among themselves. An empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch

SHARDS = 8
PART_ROWS = 10_000
MAX_PARTS = 1 << 16
EXACT_DRAW = 10**9


def _draw(rng, chosen: int, others: int, taken: int) -> int:
    """Hypergeometric count. Beyond the generator's range its normal limit, kept feasible."""
    if taken <= 0 or chosen <= 0:
        return 0
    if chosen < EXACT_DRAW and others < EXACT_DRAW:
        return int(rng.hypergeometric(chosen, others, taken))
    total = chosen + others
    share = chosen / total
    spread = (taken * share * (1 - share) * (total - taken) / max(total - 1, 1)) ** 0.5
    return int(min(max(round(rng.normal(taken * share, spread)), taken - others, 0), taken, chosen))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows: parts, columns: shards. Columns sum to sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for count in counts:
        row, rest, open_rows = [], count, sum(left)
        for j in range(shards):
            open_rows -= left[j]
            row.append(_draw(rng, left[j], open_rows, rest))
            rest -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def shard(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    rows = scratch.keep(rows, "shard-rows")
    total = rows.count()
    parts = max(1, min(MAX_PARTS, -(-total // PART_ROWS)))
    key = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int"))
    rows = rows.withColumn("_first", F.xxhash64(F.lit(seed + 1), *key)).withColumn(
        "_second", F.xxhash64(F.lit(seed + 2), *key)
    )
    counted = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    cuts = [{"_part": p, "cuts": np.cumsum(row[:-1]).tolist()} for p, row in enumerate(matrix)]
    lookup = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(cuts)), "array<struct<_part: int, cuts: array<bigint>>>"))
    )
    local = Window.partitionBy("_part").orderBy("_first", *key)
    dealt = (
        rows.withColumn("_at", F.row_number().over(local) - 1)
        .join(F.broadcast(lookup), "_part")  # at most MAX_PARTS rows
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("_at"))).cast("int"))
    )
    # Buckets are the leading bits of the second key: ordering by it orders buckets as well.
    bits = max(0, (max(1, total // shards // PART_ROWS)).bit_length())
    bucket = F.shiftright("_second", 63 - bits) if bits else F.lit(0).cast("long")
    dealt = scratch.keep(
        dealt.select("doc_id", "size", "text_crc32", "shard", "_second", bucket.alias("_bucket")), "shard-dealt"
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("_second", *key)
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_at")).cast("long").alias("slot"))
    )
