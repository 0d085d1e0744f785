"""CSV records with line breaks inside quotes, read by many tasks per file.

Whether a line break ends a record depends on the quotes before it: an even number since the start of the
file. A first scan over byte ranges counts, per range, its quotes and the records that would start in it
if it began outside and if it began inside of quotes. The parities of the ranges before it then tell which
of the two holds, and a second scan cuts the records. Only the pieces of records that cross a range's edge,
at most two a range, are brought together.

Quotes inside quoted cells are doubled, as RFC 4180 has it, so they do not change the parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "file string, start long"
SCANNED = f"{RANGE}, quotes long, starts_outside long, starts_inside long"
PIECES = f"{RANGE}, record long, whole boolean, text string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of a batch by range; a task may read several ranges one after the other."""
    if not batch.num_rows:
        return
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    edges = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.column("file")[int(lo)].as_py(), int(start[lo]), batch.slice(int(lo), int(hi - lo))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each range, and the lines that begin with an even or an odd number of them before."""
    held: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, start, part in _runs(batch):
            total = held.setdefault((file, start), [0, 0, 0])
            quotes = pc.count_substring(part.column("value"), '"').to_numpy()
            before = total[0] + np.cumsum(quotes) - quotes
            even = int((before % 2 == 0).sum())
            total[0] += int(quotes.sum())
            total[1] += even
            total[2] += len(before) - even
    for (file, start), total in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([file]), *(pa.array([x], pa.int64()) for x in (start, *total))],
            names=["file", "start", "quotes", "starts_outside", "starts_inside"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range. Its first piece, if it goes on a record, and its last record are not whole."""
    now, lines, number, inside = None, [], 0, False

    def piece(whole: bool) -> tuple:
        return (*now, number, whole, "\n".join(lines))

    for batch in batches:
        out = []
        for file, start, part in _runs(batch):
            if (file, start) != now:
                if lines:
                    out.append(piece(False))
                now, lines, number, inside = (file, start), [], 0, part.column("inside")[0].as_py()
            for line, quotes in zip(part.column("value").to_pylist(), pc.count_substring(part.column("value"), '"').to_pylist()):
                if not inside:
                    if lines:
                        out.append(piece(number > 0))
                    lines, number = [], number + 1
                lines.append(line)
                inside ^= quotes % 2 == 1
        yield _pieces(out)
    if lines:
        yield _pieces([piece(False)])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    names = ["file", "start", "record", "whole", "text"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, record, text``: one row per CSV record, header lines included.

    ``start`` and ``record`` are the byte range and the place in it where the record begins.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    scanned = lines.mapInArrow(_scan, SCANNED)
    # One row per byte range; a file's ranges are few beside its lines.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scanned.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    found = F.when(F.col("inside"), F.col("starts_inside")).otherwise(F.col("starts_outside"))
    ranges = ranges.withColumn("found", found)
    # The first piece of a range goes on the last record of the last range before it in which one begins.
    owner = F.last(F.when(F.col("found") > 0, F.struct("start", "found")), ignorenulls=True).over(before)
    ranges = ranges.select("file", "start", "inside", owner.alias("owner"), "found")
    marked = lines.join(F.broadcast(ranges.select("file", "start", "inside")), ["file", "start"])
    pieces = marked.select("file", "start", "value", "inside").mapInArrow(_cut, PIECES)
    whole = pieces.filter("whole").select("file", "start", "record", "text")
    torn = pieces.filter(~F.col("whole")).join(F.broadcast(ranges.select("file", "start", "owner")), ["file", "start"])
    goes_on = F.col("record") == 0
    torn = torn.select(
        "file",
        F.when(goes_on, F.col("owner.start")).otherwise(F.col("start")).alias("at"),
        F.when(goes_on, F.col("owner.found")).otherwise(F.col("record")).alias("record"),
        F.struct("start", "text").alias("piece"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "\n")
    mended = torn.groupBy("file", "at", "record").agg(joined.alias("text"))
    return whole.unionByName(mended.select("file", F.col("at").alias("start"), "record", "text"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Rows of all files under ``path``; the first record of each file is its header and blank lines are none."""
    records = read_records(spark, path)
    body = records.filter(~((F.col("start") == 0) & (F.col("record") == 1)) & (F.col("text") != ""))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    # A line may end with a carriage return too; those within quotes are text.
    parsed = F.from_csv(F.regexp_replace("text", "\r$", ""), columns, options)
    return body.select(parsed.alias("row")).select("row.*")
