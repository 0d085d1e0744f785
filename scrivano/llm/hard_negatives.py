"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

Rows are ordered along a Hilbert curve through their components of largest variance and written as
Parquet blocks of bounded size, one row per block: packed ids, labels and integer vectors beside the
zone map, the least and largest value of every component and of the label. Anchors are the stated
query set. They travel in packs of bounded size, and a pack meets chunks of zone maps only: interval
arithmetic on an anchor and a zone map bounds every score in the block from both sides, and a block is
read for an anchor only if these bounds let it matter.

1. An anchor's own block gives its first scores with its label; their fifth is a floor for its positives.
2. Blocks whose upper bound reaches the floor are read for the positives.
3. Blocks whose bounds meet a window ``least share * positive <= score <= positive`` are read for the
   negatives. Zone maps of nearest-to-window blocks are not trusted for more: the best five of every
   block read are merged by a window function.

Blocks and packs are joined on the chosen (block, pack) pairs, so a popular block is read by many tasks,
one a pack. The order of rows decides only how much is read: any order gives the same result.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do empty
vectors or components beyond 2**24 in the integer form, whose products no long can hold. Rows whose
vectors differ in length never meet. A row with a null ``vec_id`` is a candidate, after all others among
ties, and no anchor. Repeated ids are rows of their own: each is mined, and the other is one of its
candidates. No anchor has rows without a positive or without a negative in the window; no anchors, no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scrivano.llm.scratch import Scratch

SCALE = 256
EVERY = 100
KEEP = 5
LEAST_SHARE = 80
BLOCK_ROWS = 512
PACK = 256
ZONES = 1024
CURVE_AXES = 16
CURVE_BITS = 4
LARGEST = 1 << 24
_NO_ID = np.iinfo(np.int64).max
_EXACT = 2.0**53

ORACLE = """
with q as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scores as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score
    from q a join q c on a.vec_id <> c.vec_id and len(a.e) = len(c.e) where a.vec_id % 100 = 0),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
pairs as (
    select p.anchor_id, p.positive_id, p.positive_score, n.vec_id as negative_id, n.score as negative_score,
           row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank
    from positives p join scores n on n.anchor_id = p.anchor_id and not n.same
     and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from pairs where rank <= 5
"""


def curve_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer cells (rows x axes, ``bits`` each) on the Hilbert curve; at most 64 bits in all.

    From the highest bit down, the low bits of earlier axes are inverted or exchanged so that every
    part of the curve is entered where the one before was left; what remains is read in Gray order.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        below = bit - 1
        for i in range(axes):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        turn = np.where(x[-1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    place = np.zeros(cells.shape[0], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << np.uint64(1)) | ((x[i] >> level) & 1).astype(np.uint64)
    return place


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold them exactly, else in longs."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < _EXACT:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score (anchors x blocks) that the zone maps allow."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def best(scores: np.ndarray, order: np.ndarray, allowed: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best allowed scores, ties to the smaller ``order``."""
    at = np.flatnonzero(allowed)
    if len(at) > 4 * keep:
        least = np.partition(scores[at], len(at) - keep)[len(at) - keep]
        at = at[scores[at] >= least]
    return at[np.lexsort((order[at], -scores[at]))[:keep]]


def _spread(rows: DataFrame) -> tuple[list[int], list[float], list[float]]:
    """Components of largest variance, with their least and largest values, over all rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            flat, size = batch.column("vector").flatten().to_numpy(), pc.list_value_length(batch.column("vector")).to_numpy()
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            for width in np.unique(size):
                x = flat[(start[size == width][:, None] + np.arange(width)[None, :])].astype(np.float64)
                part = [np.full(width, len(x), float), x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
                if width in held:
                    a = held[width]
                    part = [a[0] + part[0], a[1] + part[1], a[2] + part[2], np.minimum(a[3], part[3]), np.maximum(a[4], part[4])]
                held[width] = part
        for width, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *(pa.array(p) for p in part)],
                                             names=["axis", "n", "s", "ss", "low", "high"])

    parts = rows.select("vector").mapInArrow(local, "axis int, n double, s double, ss double, low double, high double")
    axes = parts.groupBy("axis").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")), F.min("low").alias("low"), F.max("high").alias("high"))
    wide = axes.withColumn("spread", F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    chosen = wide.orderBy(F.desc("spread"), "axis").limit(CURVE_AXES).collect()
    return [r["axis"] for r in chosen], [r["low"] for r in chosen], [r["high"] for r in chosen]


def _ordered(rows: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """Write the blocks, in Hilbert order."""
    axes, low, high = _spread(rows)
    cells = 1 << CURVE_BITS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column("vector").flatten().to_numpy(), pc.list_value_length(batch.column("vector")).to_numpy()
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            grid = np.zeros((len(size), max(1, len(axes))), np.int64)
            for i, axis in enumerate(axes):
                has = size > axis
                value = flat[start[has] + axis].astype(np.float64)
                grid[has, i] = np.clip((value - low[i]) * cells / max(1.0, high[i] - low[i] + 1), 0, cells - 1)
            # Shifted into the range of a long, so that longs sort like places.
            at = (curve_place(grid, CURVE_BITS) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            while held is not None and held.num_rows:
                size = pc.list_value_length(held.column("vector")).to_numpy()
                run = int(np.argmax(size != size[0])) if (size != size[0]).any() else len(size)
                if run < block_rows and run == len(size):
                    break  # more of this block may come
                yield block(held.slice(0, min(run, block_rows)), (part << 24) + made)
                held, made = held.slice(min(run, block_rows)), made + 1
        if held is not None and held.num_rows:
            yield block(held, (part << 24) + made)

    def block(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        column = batch.column("vector")
        vectors = column.flatten().to_numpy().reshape(batch.num_rows, -1)
        label = batch.column("label").to_numpy()
        ids = batch.column("vec_id").fill_null(_NO_ID).to_numpy()
        one = {
            "block": [number], "width": [vectors.shape[1]], "rows": [len(ids)],
            "low": [vectors.min(0).tolist()], "high": [vectors.max(0).tolist()],
            "label_low": [int(label.min())], "label_high": [int(label.max())],
            "ids": [ids.astype(np.int64).tobytes()], "labels": [label.astype(np.int64).tobytes()],
            "known": [batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False).tobytes()],
            "vectors": [vectors.astype(np.int32).tobytes()],
        }
        return pa.RecordBatch.from_pydict(one, schema=BLOCK_ARROW)

    placed = rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("place", LongType())])).withColumn("width", F.size("vector"))
    placed = scratch.keep(placed, "hilbert-places")
    parts = max(1, -(-placed.count() // (64 * block_rows)))
    order = ["width", "place", "vec_id"]
    curve = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "vector")
    return scratch.keep(curve.mapInArrow(pack, BLOCK_SCHEMA), "hilbert-blocks")


BLOCK_SCHEMA = ("block long, width int, rows int, low array<int>, high array<int>, label_low long, label_high long, "
                "ids binary, labels binary, known binary, vectors binary")
BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("width", pa.int32()), ("rows", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
    ("label_low", pa.int64()), ("label_high", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("known", pa.binary()),
    ("vectors", pa.binary()),
])
ANCHOR = "row long, anchor_id long, label long, width int, vector binary, floors array<long>"


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """Ids, labels, vectors and whether ids are known, of the block in row ``i``."""
    ids, labels, vectors = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("ids", np.int64), ("labels", np.int64), ("vectors", np.int32)))
    known = np.frombuffer(batch.column("known")[i].as_py(), bool)
    return ids, labels, vectors.reshape(len(ids), -1), known


def _anchors(every: int, keep: int):
    """Anchor rows of the blocks; the fifth best score of the own block with the same label is the floor."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, vectors, known = _opened(batch, i)
                at = np.flatnonzero(known & (ids % every == 0))
                scores = products(vectors[at], vectors)
                rows = []
                for j, own in enumerate(at):
                    same = labels == labels[own]
                    same[own] = False
                    top = best(scores[j], ids, same, keep)
                    floor = [int(scores[j][top[-1]])] if len(top) == keep else []
                    rows.append((batch.column("block")[i].as_py() * (1 << 16) + int(own), int(ids[own]), int(labels[own]),
                                 vectors.shape[1], vectors[own].tobytes(), floor))
                yield pa.RecordBatch.from_pydict({k: [r[c] for r in rows] for c, k in enumerate(ANCHOR_ARROW.names)}, schema=ANCHOR_ARROW)

    return read


ANCHOR_ARROW = pa.schema([("row", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()),
                          ("vector", pa.binary()), ("floors", pa.list_(pa.int64()))])
CHOICE = "block long, pack array<struct<row: long, label: long, vector: binary, floors: array<long>>>"


def _choose(positives: bool, share: int):
    """Which blocks each anchor of a pack needs, by the zone maps of a chunk."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, zones = batch.column("pack")[i].as_py(), batch.column("zones")[i].as_py()
                vectors = np.stack([np.frombuffer(a["vector"], np.int32) for a in pack])
                low, high = (np.array([z[c] for z in zones], np.int64) for c in ("low", "high"))
                least, most = bounds(vectors, low, high)
                label = np.array([a["label"] for a in pack])[:, None]
                label_low, label_high = (np.array([z[c] for z in zones])[None, :] for c in ("label_low", "label_high"))
                if positives:
                    floor = np.array([a["floors"][0] if a["floors"] else np.iinfo(np.int64).min for a in pack])[:, None]
                    wanted = (most >= floor) & (label_low <= label) & (label <= label_high)
                else:
                    wanted = np.zeros(least.shape, bool)
                    for j, anchor in enumerate(pack):
                        for score in anchor["floors"]:
                            # Whole numbers from share % of the score on, up to the score.
                            wanted[j] |= (most[j] >= -(-share * score // 100)) & (least[j] <= score)
                    wanted &= (label_low != label) | (label_high != label)
                need = np.flatnonzero(wanted.any(axis=0))
                yield pa.RecordBatch.from_pydict(
                    {"block": [zones[z]["block"] for z in need], "pack": [[pack[j] for j in np.flatnonzero(wanted[:, z])] for z in need]},
                    schema=CHOICE_ARROW,
                )

    return choose


CHOICE_ARROW = pa.schema([("block", pa.int64()), ("pack", pa.list_(pa.struct([
    ("row", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("floors", pa.list_(pa.int64()))])))])
FOUND = "row long, place int, vec_id long, known boolean, score long"
FOUND_ARROW = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("known", pa.bool_()), ("score", pa.int64())])


def _read(positives: bool, share: int, keep: int):
    """The best ``keep`` of a block for each anchor that chose it, or for each of its windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, vectors, known = _opened(batch, i)
                number, pack = batch.column("block")[i].as_py(), batch.column("pack")[i].as_py()
                scores = products(np.stack([np.frombuffer(a["vector"], np.int32) for a in pack]), vectors)
                out = []
                for j, anchor in enumerate(pack):
                    same, own = labels == anchor["label"], anchor["row"] - number * (1 << 16)
                    if positives:
                        if 0 <= own < len(ids):
                            same[own] = False
                        floor = anchor["floors"][0] if anchor["floors"] else np.iinfo(np.int64).min
                        tops = [(0, best(scores[j], ids, same & (scores[j] >= floor), keep))]
                    else:
                        tops = [(place, best(scores[j], ids, ~same & (scores[j] >= -(-share * score // 100)) & (scores[j] <= score), keep))
                                for place, score in enumerate(anchor["floors"])]
                    out += [(np.full(len(t), anchor["row"]), np.full(len(t), place), ids[t], known[t], scores[j][t]) for place, t in tops]
                columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND_ARROW.types)], schema=FOUND_ARROW)

    return read


def _packs(anchors: DataFrame, size: int, total: int) -> DataFrame:
    """Anchors in packs of about ``size``, each of one vector length, in the order of the curve."""
    parts = max(1, -(-total // size))
    ranged = anchors.repartitionByRange(parts, "row").withColumn("part", F.spark_partition_id())
    return ranged.groupBy("part", "width").agg(F.collect_list(F.struct("row", "label", "vector", "floors")).alias("pack"))


def _visit(anchors: DataFrame, total: int, blocks: DataFrame, chunks: int, positives: bool, share: int, keep: int, pack: int,
           scratch: Scratch) -> DataFrame:
    """Choose blocks by zone maps, read them, and return their best rows."""
    zones = blocks.select("block", "width", "low", "high", "label_low", "label_high").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
    zones = zones.groupBy("chunk", "width").agg(F.collect_list(F.struct("block", "low", "high", "label_low", "label_high")).alias("zones"))
    packs = _packs(anchors, pack, total).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    met = packs.join(zones, ["chunk", "width"]).select("pack", "zones")
    chosen = scratch.keep(met.mapInArrow(_choose(positives, share), CHOICE), "chosen-blocks")
    # Files of chosen anchors are small, as vectors repeat in them, but not what is read from them.
    read = blocks.select("block", "ids", "labels", "known", "vectors").hint("merge").join(chosen, "block")
    return read.mapInArrow(_read(positives, share, keep), FOUND)


def mine(table: DataFrame, scratch: Scratch, every: int = EVERY, keep: int = KEEP, share: int = LEAST_SHARE,
         block_rows: int = BLOCK_ROWS, pack: int = PACK, zones: int = ZONES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``table`` has ``vec_id``, ``label`` (whole numbers) and ``embedding``. Anchors are rows whose id is
    divisible by ``every``; each has up to ``keep`` positives and each of these up to ``keep`` negatives
    that score at least ``share`` percent of it and not more than it.
    """
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("a block has 1 to 65,536 rows")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < LARGEST))
    rows = table.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("vector"),
    )
    blocks = _ordered(rows, scratch, block_rows)
    anchors = scratch.keep(blocks.select("block", "ids", "labels", "known", "vectors").mapInArrow(_anchors(every, keep), ANCHOR), "anchors")
    total, chunks = anchors.count(), max(1, -(-blocks.count() // zones))
    found = _visit(anchors, total, blocks, chunks, True, share, keep, pack, scratch)
    # Known ids go before unknown ones of the same place in the order.
    first = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", F.desc("known"))
    ranked = found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep)
    positive_id = F.when(F.col("known"), F.col("vec_id"))
    positives = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", positive_id.alias("id"), "score"))).alias("positives"))
    positives = positives.join(anchors.drop("floors"), "row").withColumn("floors", F.col("positives.score"))
    positives = scratch.keep(positives, "positives")
    met = _visit(positives, total, blocks, chunks, False, share, keep, pack, scratch)
    best_of = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id", F.desc("known"))
    kept = met.withColumn("rank", F.row_number().over(best_of)).filter(F.col("rank") <= keep)
    out = kept.join(positives.select("row", "anchor_id", "positives"), "row").withColumn("_positive", F.col("positives")[F.col("place")])
    return out.select(
        "anchor_id", F.col("_positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.when(F.col("known"), F.col("vec_id")).alias("negative_id"),
        F.col("_positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
