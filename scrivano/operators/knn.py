"""Exact and approximate nearest neighbours of a query table in a vector collection.

Four plans share one contract, ``(query_id, embedding_index, distance, rank)``:

``scan``
    The query table is measured first. While its vectors fit ``max_query_bytes`` they are broadcast
    and every task streams its part of the collection past them, keeping the best *k* per query.
    One pass over two columns, no shuffle of the collection; only the winners are shuffled.
``rounds``
    For query tables beyond that bound: the scan again for every part of the queries that fits it. The vectors are
    written once and read by every round, and a round's partial results are gone before the next one starts, so
    what lies on disk grows with the tables, not with their product.
``tiles``
    For query tables beyond that bound where few copies move, as one side is small. Queries are dealt to tiles and the collection to splits, both
    of bounded size, and blocks of them move together; a task compares a block's tiles with its splits and
    keeps *k* rows per query, and the partial results of a query are merged in two levels. The result is exact.
``hashed``
    Locality-sensitive hashing: fixed hyperplanes give every vector one bucket per table, a query
    probes its own bucket and those a few bits away, and vectors are compared bucket by bucket, in
    the same tiles and splits. Recall below one; :func:`recall` measures it against an exact plan.

No plan materialises query-vector pairs: a task emits at most *k* rows per query and split.
Distances are single precision, as a vector store reports them; ties break on the smaller index.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivano.functions.vectors import METRICS
from scrivano.session import cut_lineage, scratch_path

MAX_QUERY_BYTES = 64 << 20
TILE_BYTES = 4 << 20
SPLIT_ROWS = 16_384
TABLES = 8
BITS = 6
FLIPS = 1
MAX_BITS = 16
MAX_BROADCAST_HITS = 500_000
MAX_BROADCAST_FOUND = 2_000_000
HOT_HITS = 10_000
HOT_SALTS = 64
MAX_HOT_BYTES = 64 << 20
SCAN_TASKS_PER_CORE = 4
MIN_SCAN_TASKS = 4_096
SIDE_BLOCKS = 8
BLOCK_BYTES = 32 << 20
MOST_COPIES = 4
ROUND_TASKS = 64
PROBE_BYTES = 4 << 20
_CELLS_PER_MATRIX = 2_000_000
_CELLS_PER_PAIRS = 1_000_000
_FRESH_PAIRS = 100_000
_MOST_SINGLE = 1e15
MERGE_SPLITS = 64

HIT_SCHEMA = "query_id long, embedding_index long, distance double, k int"


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column as a matrix of its own floats; other numbers become doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype not in (np.float32, np.float64):
        flat = flat.astype(np.float64)
    if len(column) == 0:
        return flat.reshape(0, 0)
    if flat.size % len(column) or column.null_count:
        raise ValueError("vectors must be non-null and of one dimension")
    return flat.reshape(len(column), -1)


def _pair_distance(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distance of row i of ``x`` to row i of ``q``, in double precision, rounded as it is reported."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == "sqeuclidean":
        d = ((x - q) ** 2).sum(axis=1)
    else:
        d = 1.0 - (x * q).sum(axis=1)
        if metric == "cosine":
            lengths = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
            d = 1.0 - np.divide(1.0 - d, lengths, out=np.zeros_like(d), where=lengths > 0)
    return d.astype(np.float32).astype(np.float64)


def _factors(x: np.ndarray, metric: str, asks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products order by distance, and their lengths.

    A vector's row times a query's row is the cosine or inner product, and for ``sqeuclidean`` the inner
    product less half the vector's squared length.
    """
    x = x.astype(np.float64)
    lengths = np.sqrt((x * x).sum(axis=1))
    if metric == "cosine":
        x = np.divide(x, lengths[:, None], out=np.zeros_like(x), where=lengths[:, None] > 0)
        lengths = np.minimum(lengths, 1.0)
    if metric == "sqeuclidean":
        last = np.ones(len(x)) if asks else -0.5 * lengths * lengths
        x = np.column_stack([x, last])
    return x, lengths


def _surplus_free(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The batch without surplus copies: of equal vectors only the ``k`` smallest indices can win.

    Rows are grouped by a hash of their bits; where a hash stands for two vectors, all its rows stay.
    """
    column = batch.column("embedding")
    bits = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint32)
    bits = bits.reshape(len(column), -1)
    weights = np.random.default_rng(1).integers(1, 1 << 62, bits.shape[1], dtype=np.uint64) | 1
    key = bits.astype(np.uint64) @ weights
    order = np.lexsort((batch.column("embedding_index").to_numpy(zero_copy_only=False), key))
    first = np.append(True, key[order][1:] != key[order][:-1])
    if first.all():
        return batch
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    differs = (bits[order] != bits[order[starts[group]]]).any(axis=1)
    mixed = np.bincount(group, weights=differs) > 0
    keep = (np.arange(len(order)) - starts[group] < k) | mixed[group]
    return batch if keep.all() else batch.take(pa.array(np.sort(order[keep])))


class _Best:
    """Running best k per query over the vectors seen so far."""

    def __init__(self, queries: np.ndarray, ks: np.ndarray, metric: str):
        self.queries, self.ks, self.metric = queries, ks.astype(np.int64), metric
        self.bound = np.full(len(queries), np.inf)
        self.kmax = int(self.ks.max()) if len(queries) else 0
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.n_fresh = 0
        factors, self.lengths = _factors(queries, metric, True)
        self.longest = float(np.fmax.reduce(self.lengths, initial=0.0))
        single = self.longest < _MOST_SINGLE
        self.factors = factors.astype(np.float32).T if single else factors.T

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, _CELLS_PER_MATRIX // max(1, len(self.queries)))
        for lo in range(0, len(ids), step):
            self._add(ids[lo : lo + step], x[lo : lo + step])

    def _add(self, ids: np.ndarray, x: np.ndarray, single: bool = True) -> None:
        """Products in single precision choose the pairs, with room for their error; distances are scored in double."""
        rows, lengths = _factors(x, self.metric, False)
        longest = float(np.fmax.reduce(lengths[np.isfinite(lengths)], initial=0.0))
        factors = self.factors
        if single and longest < _MOST_SINGLE and factors.dtype == np.float32:
            rows, unit = rows.astype(np.float32), 2.0**-24
        else:
            single, unit = False, 2.0**-53
            if factors.dtype == np.float32:
                factors = _factors(self.queries, self.metric, True)[0].T
        products = rows @ factors
        offset, scale = (self.lengths**2, 2.0) if self.metric == "sqeuclidean" else (1.0, 1.0)
        # A product of n terms is off by at most n units of the sum of its terms' sizes, the inputs' rounding included.
        error = (rows.shape[1] + 8) * unit * (longest * self.lengths + 0.5 * longest * longest) + 1e-36
        if len(ids) > self.kmax and not np.isfinite(self.bound).all():
            head = np.partition(-products, self.kmax - 1, axis=0)[self.kmax - 1].astype(np.float64)
            self.bound = np.fmin(self.bound, offset + scale * (head + error))
        # What is reported is rounded to single precision: a pair that ties after rounding stays in.
        margin = 1e-6 * np.maximum(1.0, np.abs(self.bound))
        least = (offset - self.bound - margin) / scale - error
        if single:
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        row, col = np.nonzero(products >= least)
        if single and len(row) > max(_FRESH_PAIRS, products.size // 8) and np.isfinite(self.bound).all():
            return self._add(ids, x, False)  # lengths differ so much that the room for errors admits too many
        del products
        pairs = max(1_024, _CELLS_PER_PAIRS // x.shape[1])
        for lo in range(0, len(row), pairs):
            r, c = row[lo : lo + pairs], col[lo : lo + pairs]
            self.fresh.append((c, ids[r], _pair_distance(x[r], self.queries[c], self.metric)))
            self.n_fresh += len(r)
            if self.n_fresh > max(_FRESH_PAIRS, len(self.best[0])):
                self._shrink()

    def _shrink(self) -> None:
        q, ids, d = (np.concatenate(part) for part in zip(self.best, *self.fresh))
        order = np.lexsort((ids, d, q))
        sorted_q = q[order]
        place = np.arange(len(q)) - np.searchsorted(sorted_q, sorted_q, side="left")
        keep = order[place < self.ks[sorted_q]]
        self.best, self.fresh, self.n_fresh = (q[keep], ids[keep], d[keep]), [], 0
        full = np.bincount(q[keep], minlength=len(self.ks)) >= self.ks
        worst = np.full(len(self.ks), -np.inf)
        np.maximum.at(worst, q[keep], d[keep])
        self.bound = np.where(full, np.minimum(self.bound, worst), self.bound)

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        self._shrink()
        q, ids, d = self.best
        return pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[q]),
                pa.array(ids),
                pa.array(d),
                pa.array(self.ks[q].astype(np.int32)),
            ],
            names=["query_id", "embedding_index", "distance", "k"],
        )


def _ranked(candidates: DataFrame) -> DataFrame:
    """Best k per query over the partial results, ranked 1..k."""
    order = Window.partitionBy("query_id").orderBy("distance", "embedding_index")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("k"))
        .drop("k")
    )


def _merged(partial: DataFrame, splits: int) -> DataFrame:
    """Merge the partial results of very many splits in two levels, so no task holds all of a query's."""
    if splits > MERGE_SPLITS:
        part = F.pmod(F.col("split"), F.lit(int(splits**0.5)))
        order = Window.partitionBy("query_id", "part").orderBy("distance", "embedding_index")
        partial = partial.withColumn("part", part).withColumn("place", F.row_number().over(order))
        partial = partial.filter(F.col("place") <= F.col("k")).drop("part", "place")
    return _ranked(partial.drop("split"))


def _with_k(queries: DataFrame, k: int | str) -> DataFrame:
    k_col = F.lit(k) if isinstance(k, int) else F.col(k)
    return queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        "embedding",
        k_col.cast("int").alias("k"),
    ).filter(F.col("k") > 0)


def query_bytes(queries: DataFrame) -> int:
    """Bytes of the query vectors as doubles, measured."""
    row = queries.agg(F.sum(F.size("embedding").cast("long") * 8 + 24).alias("b")).first()
    return int(row.b or 0)


def knn(
    collection: DataFrame,
    queries: DataFrame,
    k: int | str = 5,
    metric: str = "sqeuclidean",
    plan: str = "auto",
    max_query_bytes: int = MAX_QUERY_BYTES,
    **options,
) -> DataFrame:
    """The ``k`` nearest vectors of every query; ``k`` is a number or a column of ``queries``.

    ``collection`` has ``embedding_index, embedding``; ``queries`` has ``query_id, embedding``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    if plan not in ("auto", "scan", "rounds", "tiles", "hashed"):
        raise ValueError(f"unknown plan {plan!r}")
    vectors = collection.select(F.col("embedding_index").cast("long"), "embedding")
    wanted = _with_k(queries, k)
    if plan in ("auto", "scan"):
        size = query_bytes(wanted)
        if size <= max_query_bytes:
            return _scan(vectors, wanted, metric)
        if plan == "scan":
            raise ValueError(f"{size} bytes of query vectors exceed the broadcast bound; use rounds or tiles")
        plan = "tiles" if options or _copies(vectors, wanted) <= MOST_COPIES else "rounds"
    if plan == "rounds":
        return _rounds(vectors, wanted, metric, max_query_bytes)
    return (_tiles if plan == "tiles" else _hashed)(vectors, wanted, metric, **options)


def _scan(vectors: DataFrame, wanted: DataFrame, metric: str) -> DataFrame:
    """Measured, small query table: broadcast it and stream the collection past it."""
    # Every task emits up to k rows per query. Fewer, longer tasks (still several per core) keep
    # these partial results small beside the collection; coalescing moves no rows.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return _scanned(vectors, wanted, metric, max(cores * SCAN_TASKS_PER_CORE, MIN_SCAN_TASKS))[0]


def _scanned(vectors: DataFrame, wanted: DataFrame, metric: str, tasks: int) -> tuple[DataFrame, Broadcast]:
    """The scan in at most so many tasks, and the queries that it broadcasts."""
    table = wanted.toArrow()
    columns = (
        table.column("query_id").to_numpy(),
        table.column("k").to_numpy(),
        _matrix(table.column("embedding")),
    )
    shared = vectors.sparkSession.sparkContext.broadcast(columns)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, limits, matrix = shared.value
        tile = max(1, TILE_BYTES // (8 * max(1, matrix.shape[1]) + 24))
        starts = range(0, len(query_ids), tile)
        tiles = [_Best(matrix[lo : lo + tile], limits[lo : lo + tile], metric) for lo in starts]
        most = max((best.kmax for best in tiles), default=0)
        for batch in batches:
            if batch.num_rows and tiles:
                batch = _surplus_free(batch, most)
                index, x = batch.column("embedding_index").to_numpy(zero_copy_only=False), _matrix(batch.column("embedding"))
                for best in tiles:
                    best.add(index, x)
        for lo, best in zip(starts, tiles):
            yield best.batch(query_ids[lo : lo + tile])

    return _ranked(vectors.coalesce(tasks).mapInArrow(nearest, HIT_SCHEMA)), shared


def _copies(vectors: DataFrame, wanted: DataFrame) -> float:
    """How often the tiles' plan copies a row, on average."""
    rows, asked = vectors.count(), wanted.count()
    width = _width(wanted)
    block = _rows(2 * BLOCK_BYTES, width)
    splits, tiles = (
        min(-(-n // part), max(SIDE_BLOCKS, -(-n // block))) for n, part in ((rows, SPLIT_ROWS), (asked, _rows(TILE_BYTES, width)))
    )
    return (asked * splits + rows * tiles) / max(1, asked + rows)


def _rounds(vectors: DataFrame, wanted: DataFrame, metric: str, max_query_bytes: int) -> DataFrame:
    """A scan for every part of the queries that can be broadcast, one after the other.

    Few tasks of a round emit ``k`` rows a query each; more than ``ROUND_TASKS`` only where the vectors are many.
    """
    spark = vectors.sparkSession
    rounds = max(1, -(-query_bytes(wanted) // max_query_bytes))
    most, width = wanted.agg(F.max("k")).first()[0] or 1, _width(wanted)
    root = scratch_path(spark, "knn-rounds")
    part = F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int")
    wanted.withColumn("part", part).repartition(rounds, "part").write.partitionBy("part").parquet(f"{root}/queries")
    _without_surplus(vectors, most).write.parquet(f"{root}/vectors")
    schema = T.StructType([*wanted.schema.fields, T.StructField("part", T.IntegerType())])
    asked = spark.read.schema(schema).parquet(f"{root}/queries")
    held = spark.read.schema(vectors.schema).parquet(f"{root}/vectors")
    tasks = max(min(spark.sparkContext.defaultParallelism, ROUND_TASKS), -(-held.count() // _rows(2 * BLOCK_BYTES, width)))
    for i in range(rounds):
        hits, shared = _scanned(held, asked.filter(F.col("part") == i).drop("part"), metric, tasks)
        hits.write.mode("append").parquet(f"{root}/hits")
        shared.destroy()
        # What the round shuffled is freed as its plan is collected.
        schema = hits.schema
        del hits
        gc.collect()
        spark._jvm.System.gc()
    for name in ("queries", "vectors"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(schema).parquet(f"{root}/hits")


def _without_surplus(vectors: DataFrame, most: int) -> DataFrame:
    """Surplus copies, which cannot be among the best ``most``, leave batch by batch, before any shuffle."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _surplus_free(batch, most)

    return vectors.mapInArrow(thin, vectors.schema)


def _meet(
    vectors: DataFrame, probes: DataFrame, metric: str, tile_rows: int, split_rows: int, block_rows: int,
    side: int = 1, counted: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, int]:
    """Best k per query and block of every bucket; also the largest number of a bucket's blocks of vectors.

    ``vectors``: ``bucket, embedding_index, embedding``; ``probes``: ``bucket, query_id, embedding, k``.
    Both sides of a bucket are counted first (on ``counted``, where that is cheaper) and dealt by hash. What
    is compared at once is a tile with a split. What moves together is a block of whole tiles and one of whole
    splits, ``side`` blocks or more a bucket and about ``block_rows`` rows each: a row is copied once per block
    of the other side, however small the tiles are.
    """
    count = F.count(F.lit(1))

    def blocks(part: int):
        return F.least(F.ceil(count / part), F.greatest(F.lit(side), F.ceil(count / block_rows)))

    held_vectors, held_probes = counted or (vectors, probes)
    sizes = (
        held_vectors.groupBy("bucket").agg(blocks(split_rows).alias("splits"))
        .join(held_probes.groupBy("bucket").agg(blocks(tile_rows).alias("tiles")), "bucket")
    )
    # At most TABLES * 2**MAX_BITS buckets, three numbers each.
    held = sizes.collect()
    plan = F.broadcast(vectors.sparkSession.createDataFrame(held, sizes.schema))
    split = F.pmod(F.xxhash64("embedding_index", "embedding"), F.col("splits"))
    tile = F.pmod(F.xxhash64("query_id"), F.col("tiles"))
    numbers = {"splits": F.sequence(F.lit(0).cast("long"), F.col("splits") - 1), "tiles": F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)}
    left = vectors.join(plan, "bucket").select(
        "bucket", F.explode(numbers["tiles"]).alias("tile"), split.alias("split"), F.lit(False).alias("asks"),
        F.col("embedding_index").alias("id"), "embedding", F.lit(0).alias("k"),
    )
    right = probes.join(plan, "bucket").select(
        "bucket", tile.alias("tile"), F.explode(numbers["splits"]).alias("split"), F.lit(True).alias("asks"),
        F.col("query_id").alias("id"), "embedding", "k",
    )

    def compare(table: pa.Table) -> pa.Table:
        asks, at = table.column("asks").combine_chunks(), table.column("split")[0].as_py()
        queries, rows = table.filter(asks), table.filter(pc.invert(asks))
        del table
        ids, x = rows.column("id").to_numpy(), _matrix(rows.column("embedding"))
        asked, ks, wanted = queries.column("id").to_numpy(), queries.column("k").to_numpy(), _matrix(queries.column("embedding"))
        found = []
        for lo in range(0, max(1, len(asked)), tile_rows):
            best = _Best(wanted[lo : lo + tile_rows], ks[lo : lo + tile_rows], metric)
            for row in range(0, len(ids) if len(asked) else 0, split_rows):
                best.add(ids[row : row + split_rows], x[row : row + split_rows])
            found.append(best.batch(asked[lo : lo + tile_rows]))
        hits = pa.Table.from_batches(found)
        return hits.append_column("split", pa.array(np.full(hits.num_rows, at, np.int64)))

    met = left.unionByName(right).groupBy("bucket", "tile", "split")
    return met.applyInArrow(compare, HIT_SCHEMA + ", split long"), max([r.splits for r in held], default=0)


def _width(wanted: DataFrame) -> int:
    """Components of the largest query vector."""
    return wanted.agg(F.max(F.size("embedding"))).first()[0] or 1


def _rows(size: int, width: int) -> int:
    """Vectors that fit ``size`` bytes as doubles."""
    return max(1, size // (8 * width + 24))


def partial_hits(
    vectors: DataFrame, wanted: DataFrame, metric: str = "sqeuclidean", tile_bytes: int = TILE_BYTES, split_rows: int = SPLIT_ROWS
) -> tuple[DataFrame, int]:
    """Best k of every query and block of splits, before the merge, and the number of these blocks."""
    most, width = wanted.agg(F.max("k")).first()[0] or 1, _width(wanted)
    whole = F.lit(0).alias("bucket")
    thin = _without_surplus(vectors, most)
    # Counting the vectors before the surplus leaves reads no vector.
    return _meet(
        thin.select(whole, "*"), wanted.select(whole, "*"), metric, _rows(tile_bytes, width), split_rows,
        _rows(2 * BLOCK_BYTES, width), SIDE_BLOCKS, (vectors.select(whole), wanted.select(whole)),
    )


def _tiles(vectors: DataFrame, wanted: DataFrame, metric: str, tile_bytes: int = TILE_BYTES, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Every tile of queries against every split of the collection."""
    return _merged(*partial_hits(vectors, wanted, metric, tile_bytes, split_rows))


def hyperplanes(width: int, count: int) -> np.ndarray:
    """Fixed hyperplanes of plus and minus one, as columns: the sign at (i, j) is a bit of a product's remainder.

    Any tool can compute them again: bit = ((31 i + 17 j + 7) * (j + 3) * (i + 11) * 40503 + 12289 i) mod 65521 is odd.
    """
    i, j = np.arange(width, dtype=np.int64)[:, None], np.arange(count, dtype=np.int64)[None, :]
    mixed = ((31 * i + 17 * j + 7) * (j + 3) * (i + 11) * 40503 + 12289 * i) % 65521
    return np.where(mixed % 2 == 1, 1.0, -1.0)


def _buckets(frame: DataFrame, tables: int, bits: int, flips: int) -> DataFrame:
    """``frame`` once per table with the vector's bucket and, for ``flips`` above 0, each bucket so many bits away."""
    masks = [sum(1 << b for b in turned) for n in range(flips + 1) for turned in combinations(range(bits), n)]
    names = frame.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding")).astype(np.float64)
            above = (x @ hyperplanes(x.shape[1], tables * bits) > 0).reshape(len(x), tables, bits)
            code = (above << np.arange(bits)).sum(axis=2)
            code = (code[:, :, None] ^ np.array(masks)[None, None, :]) + (np.arange(tables) << bits)[None, :, None]
            # The copies leave in batches of bounded size, however many buckets a vector has.
            step = max(1, PROBE_BYTES // (8 * x.shape[1] * tables * len(masks)))
            for lo in range(0, len(x), step):
                some = code[lo : lo + step]
                row = pa.array(np.repeat(np.arange(lo, lo + len(some)), tables * len(masks)))
                copies = [c.take(row) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(some.ravel().astype(np.int32)), *copies], names=["bucket", *names])

    return frame.mapInArrow(deal, T.StructType([T.StructField("bucket", T.IntegerType()), *frame.schema.fields]))


def _hashed(
    vectors: DataFrame, wanted: DataFrame, metric: str, tables: int = TABLES, bits: int = BITS, flips: int = FLIPS,
    tile_bytes: int = TILE_BYTES, split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Compare a query with the vectors that share or nearly share a bucket with it in some table.

    More ``bits`` make buckets smaller, more ``tables`` and ``flips`` find more. Vectors are replicated
    once a table, queries once a probe.
    """
    if not 0 < bits <= MAX_BITS or not 0 <= flips <= bits or tables < 1:
        raise ValueError(f"need at least one table, 1 to {MAX_BITS} bits and no more flips than bits")
    most, width = wanted.agg(F.max("k")).first()[0] or 1, _width(wanted)
    dealt = _buckets(_without_surplus(vectors, most), tables, bits, 0)
    found, splits = _meet(
        dealt, _buckets(wanted, tables, bits, flips), metric, _rows(tile_bytes, width), split_rows, _rows(2 * BLOCK_BYTES, width)
    )
    # A vector found in several tables is one hit.
    once = found.groupBy("query_id", "embedding_index").agg(
        F.min("distance").alias("distance"), F.max("k").alias("k"), F.min("split").alias("split")
    )
    return _merged(once, splits)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: hits of the exact result, how many of them were found, and the share."""
    mark = found.select("query_id", "embedding_index", F.lit(1).alias("_hit"))
    return exact.join(mark, ["query_id", "embedding_index"], "left").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"), (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )


def hit_rows(queries: DataFrame, k: int | str) -> int:
    """Upper bound of the number of hits, measured on the query table."""
    return int(_with_k(queries, k).agg(F.sum("k").alias("n")).first().n or 0)


def first_rows(collection: DataFrame, *columns: str) -> DataFrame:
    """One row per ``embedding_index``: of several, the least by ``columns`` in order, nulls first.

    On a collection bucketed by the index this moves no rows.
    """
    picked = collection.groupBy("embedding_index").agg(F.min(F.struct(*columns)).alias("_row"))
    return picked.select("embedding_index", *[F.col(f"_row.{c}").alias(c) for c in columns])


def fetch_hits(
    hits: DataFrame, collection: DataFrame, *columns: str, max_hits: int | None = None, unique: bool = False,
    derive: dict[str, Column] | None = None,
) -> DataFrame:
    """Join text and metadata to the winners only, after the cut; unmatched indices drop out.

    With ``max_hits`` known and small, the winners are broadcast and the collection's text is read in
    place. Otherwise winners are shuffled on the index: a collection bucketed on it (see
    ``writers.write_bucketed``) is read in place again, without an exchange of its texts. Winners of an
    index that very many queries found are joined apart, with a broadcast of those few rows while they
    are small, so no task holds all of them. Where an index is not ``unique`` its least row by
    ``columns`` counts, and of the collection only rows that some winner has are shuffled, while the winners'
    distinct indices fit a broadcast; then only rows of an index that is there more than once are moved to find the
    least. ``derive`` gives columns to take from a row in place of ``columns``,
    before it is copied to its hits.
    """
    texts = collection.select("embedding_index", *columns)

    def rows_of(texts: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
        if repeated is not None:
            single = texts.join(F.broadcast(repeated), "embedding_index", "left_anti")
            texts = single.unionByName(first_rows(texts.join(F.broadcast(repeated), "embedding_index", "left_semi"), *columns))
        elif not unique:
            texts = first_rows(texts, *columns)
        return texts.select("embedding_index", *[c.alias(n) for n, c in derive.items()]) if derive else texts

    if max_hits is not None and max_hits <= MAX_BROADCAST_HITS:
        found = texts.join(F.broadcast(hits.select("embedding_index").distinct()), "embedding_index", "left_semi")
        return rows_of(found).join(F.broadcast(hits), "embedding_index")
    hits = cut_lineage(hits)
    counted = cut_lineage(hits.groupBy("embedding_index").agg(F.count(F.lit(1)).alias("n")))
    repeated = None
    if not unique and counted.count() <= MAX_BROADCAST_FOUND:
        texts = texts.join(F.broadcast(counted.select("embedding_index")), "embedding_index", "left_semi")
        # Numbers alone tell which indices come again: only their texts are moved to find the least row.
        again = texts.groupBy("embedding_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        repeated = cut_lineage(again.select("embedding_index"))
    texts = rows_of(texts, repeated)
    columns = [c for c in texts.columns if c != "embedding_index"]
    hot = cut_lineage(counted.filter(F.col("n") > HOT_HITS).select("embedding_index"))
    rows = cut_lineage(texts.join(hot, "embedding_index", "left_semi"))
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    if not (size := rows.agg(F.sum(width)).first()[0]):
        return texts.join(hits, "embedding_index")
    cold = texts.join(hits.join(hot, "embedding_index", "left_anti"), "embedding_index")
    # Too large to broadcast: each hot row goes to as many tasks as it has salts.
    if size * 4 <= MAX_HOT_BYTES:
        warm = F.broadcast(rows).join(hits, "embedding_index")
    else:
        salted = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))))
        salt = F.pmod(F.xxhash64("query_id"), F.lit(HOT_SALTS)).cast("int")
        warm = salted.join(hits.withColumn("_salt", salt), ["embedding_index", "_salt"]).drop("_salt")
    return cold.unionByName(warm)


class ExactStore:
    """Vector store over a collection table: nearest neighbours and a count."""

    def __init__(self, collection: DataFrame, metric: str = "sqeuclidean", **options):
        self.collection, self.metric, self.options = collection, metric, options

    def query(self, queries: DataFrame, k: int | str = 5) -> DataFrame:
        return knn(self.collection, queries, k, self.metric, **self.options)

    def count(self) -> int:
        return self.collection.count()


class ApproximateStore(ExactStore):
    """The same contract by locality-sensitive hashing."""

    def query(self, queries: DataFrame, k: int | str = 5) -> DataFrame:
        return knn(self.collection, queries, k, self.metric, plan="hashed", **self.options)
