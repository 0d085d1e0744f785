"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are brought to one length by one more component (queries get a zero there), so that
the angle orders like the inner product whatever their lengths. Rotations learned on a bounded sample
(principal axes, then iterative quantisation) then give ``BITS_PER_AXIS`` bits per component, split
into substrings of 16. Search goes in blocks of queries against blocks of
vectors. In a block every substring is indexed by its value; a query probes all values within
radius // substrings of its own, which by the pigeonhole principle reaches every code within the
Hamming radius. Codes inside the radius are ranked again by inner product in double precision.
The radius is learned on the sample, as the distance within which ``REACH`` of true neighbours lie; a
query that finds fewer than k in a block widens its radius there until it has them.

Rows without a ``vec_id``, and vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Equal scores go to the smaller id; repeated ids count as rows of their own, and a query's own
id is no candidate. Without valid vectors the result is empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8_000
BITS_PER_AXIS = 2
REACH = 0.985
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 4_096
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def learn_rotations(sample: np.ndarray, sets: int, rounds: int = 30, seed: int = 3) -> list[np.ndarray]:
    """Iterative quantisation from different random starts."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    out = []
    for _ in range(sets):
        turn = np.linalg.qr(rng.normal(size=(sample.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(sample @ axes @ turn).T @ (sample @ axes))
            turn = (u @ v).T
        out.append(axes @ turn)
    return out


def encode(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as substrings of 16 bits: one row per vector."""
    bits = vectors @ rotations > 0
    spare = -bits.shape[1] % 16
    if spare:
        bits = np.hstack([bits, np.zeros((len(bits), spare), bool)])
    return np.packbits(bits, axis=1).view(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _ONES[codes ^ code].sum(axis=1, dtype=np.int16)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that gives every vector the length of the longest."""
    rest = np.maximum(longest**2 - (vectors**2).sum(axis=1, keepdims=True), 0)
    return np.hstack([vectors, np.sqrt(rest)]) / longest


def asked(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.hstack([vectors / length, np.zeros_like(length)])


def learn_radius(sample: np.ndarray, codes: np.ndarray, questions: np.ndarray, k: int) -> int:
    """Hamming distance that holds ``REACH`` of the k nearest of sample queries."""
    found = []
    for i in range(0, len(sample), max(1, len(sample) // 500)):
        near = sample @ sample[i]
        near[i] = -np.inf
        top = np.argsort(-near)[: min(k, len(sample) - 1)]
        found.append(distances(codes[top], questions[i]))
    return int(np.quantile(np.concatenate(found), REACH)) if found and len(found[0]) else 0


class Block:
    """One block of vectors with an index per substring: vectors ordered by the substring's value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.parts = codes.shape[1]
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(self.parts)]
        self.values = []
        for p in range(self.parts):
            value, count = np.unique(codes[:, p], return_counts=True)
            self.values.append((value, np.cumsum(count) - count, count))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``: all substrings probed, then the whole code."""
        reached = np.zeros(len(self.ids), bool)
        for p in range(self.parts):
            value, first, count = self.values[p]
            probed = _ONES[value ^ code[p]] <= radius // self.parts
            lens = count[probed]
            if lens.sum():
                at = np.arange(lens.sum()) + np.repeat(first[probed] - np.cumsum(lens) + lens, lens)
                reached[self.order[p][at]] = True
        rows = np.flatnonzero(reached)
        return rows[distances(self.codes[rows], code) <= radius]

    def search(self, own: int, query: np.ndarray, code: np.ndarray, radius: int, k: int):
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != own]
            if len(rows) >= k or radius >= 16 * self.parts:
                break
            radius = min(radius + 2 * self.parts, 16 * self.parts)
        scores = (self.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def search(table: DataFrame, k: int = 20, every: int = 20, vector_block: int = VECTOR_BLOCK,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; queries: rows whose id is divisible by ``every``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & some).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    names = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return table.sparkSession.createDataFrame([], names)
    rows = rows.filter(F.size("embedding") == widths["width"])
    total = widths["count"]
    sample = np.array(
        [r[0] for r in rows.select("embedding", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    )
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    longest = float(rows.agg(F.sqrt(F.max(squares))).first()[0])
    rotations = np.hstack(learn_rotations(lifted(sample, longest), BITS_PER_AXIS))
    radius = learn_radius(sample, encode(lifted(sample, longest), rotations), encode(asked(sample), rotations), k)
    blocks = max(1, -(-total // vector_block))
    groups = max(1, -(-total // every // query_block))
    # Each block of vectors meets each block of the stated queries: no pair of rows is ever a row.
    vectors = rows.withColumn("_v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    ).withColumn("_is_query", F.lit(False))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn(
        "_q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    ).withColumn("_v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn(
        "_is_query", F.lit(True)
    )

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        query = frame["_is_query"].to_numpy()
        ids, data = frame["vec_id"].to_numpy(), np.stack(frame["embedding"].to_numpy())
        out = []
        if query.any() and not query.all():
            block = Block(ids[~query], data[~query], encode(lifted(data[~query], longest), rotations))
            for own, vector, code in zip(ids[query], data[query], encode(asked(data[query]), rotations)):
                near, scores = block.search(own, vector, code, radius, k)
                out.append((np.full(len(near), own), near, scores))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        parts = [np.concatenate(x) for x in zip(*(out or [empty]))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))

    columns = ["vec_id", "embedding", "_v", "_q", "_is_query"]
    both = vectors.select(*columns).unionByName(queries.select(*columns))
    near = both.groupBy("_v", "_q").applyInPandas(tile, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
