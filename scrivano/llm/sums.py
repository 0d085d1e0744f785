"""Distributed sums of matrices of fixed shape: each task adds up its own, rows of blocks are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.words import give_back

BLOCK_ROWS = 1024


def matrix_sum(frame: DataFrame, rows: int, columns: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """Sum over all tasks of the (rows, columns) matrix that ``add`` fills from batches.

    What is shuffled and returned depends on the shape and the number of tasks only. Partial sums are
    added in two steps, so that no reducer reads those of all tasks.
    """
    blocks = -(-rows // BLOCK_ROWS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((rows, columns), np.float32), False
        for batch in batches:
            add(total, batch)
            seen = True
        give_back()
        if seen:
            parts = [total[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].astype(np.float64) for b in range(blocks)]
            for b, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["block", "data"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                part = np.frombuffer(data, np.float32)
                held[b] = held[b] + part if b in held else part.astype(np.float64)
        for b, part in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["block", "data"]
            )

    schema = "block int, data binary"
    partial = frame.mapInArrow(local, schema).withColumn("_salt", (F.rand(7) * 4).cast("int"))
    merged = partial.repartition(4 * blocks, "block", "_salt").select("block", "data").mapInArrow(merge, schema)
    out = np.zeros((rows, columns), np.float64)
    for block, data in merged.collect():  # at most a few copies of the matrix
        part = np.frombuffer(data, np.float32).reshape(-1, columns)
        out[block * BLOCK_ROWS : block * BLOCK_ROWS + len(part)] += part
    return out
