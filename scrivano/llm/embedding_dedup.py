"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of one label are one class, so copies are compared once and never paired. Second
moments over all rows give the principal axes; in these coordinates the leading ones hold most of a
vector. A short tree of cuts along the leading axes deals classes to leaves: a class is at home in one
leaf and a guest in every later leaf whose box lies within the distance that two linked unit vectors
can have, so each pair of classes that may link meets once. A leaf is compared in tiles of bounded
sides, home classes against guests. A tile adds up the products of leading coordinates first; what is
left of a product is at most the product of the suffix norms (Cauchy-Schwarz), so rows, columns and at
last pairs that cannot reach the threshold leave before the later coordinates are read. Pairs at the
threshold to within rounding are decided by the original vectors in double precision. A tile returns a
row per linked class (partners' number, least class of its part of the graph), never pairs.

The axes and cuts only order the work: the result is exact for any of them. Vectors that are null,
empty, zero or hold null or non-finite components, and rows with a null label, link with nothing and
are their own component. Vectors of different lengths never link. Repeated ids count as rows of their
own. A null ``vec_id`` is left out of the minimum; where no id of a component is known,
``component_id`` is null and the row is kept. An empty table gives an empty result. Other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from scrivano.llm.components import components
from scrivano.llm.scratch import Scratch, hinted
from scrivano.llm.sums import matrix_sum

THRESHOLD = 0.98
SAMPLE = 20_000
MOST_LEVELS = 12
HOME = 1024
GUESTS = 2048
STEPS = (4, 8, 16, 32)
HOT = 4096
SLACK = 1e-9

ORACLE = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
    where len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, root) as (
    select a, a from links union select l.b, r.root from reach r join links l on l.a = r.vec_id),
least as (select vec_id, min(root) as root from reach group by 1),
degree as (select a as vec_id, count(*) as n from links group by 1)
select t.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.root, t.vec_id)::bigint as component_id,
       t.vec_id = coalesce(l.root, t.vec_id) as kept
from embeddings t left join degree d using (vec_id) left join least l using (vec_id)
"""


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length without nulls, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _valid() -> F.Column:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound & F.exists("embedding", lambda x: x != 0)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give every vector a 128-bit name by its components; zero of either sign is one value."""
    for batch in batches:
        keys = []
        for vector in batch.column("embedding"):
            if not vector.is_valid:
                keys.append(None)
                continue
            data = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            keys.append(hashlib.blake2b(data.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])


def learn_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all unit vectors, as columns, leading first."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        rows = units(matrix(batch.column("embedding")))
        total += rows.T @ rows

    moments = matrix_sum(classes.filter(F.size("embedding") == width).select("embedding"), width, width, add)
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def learn_cuts(sample: np.ndarray, levels: int) -> np.ndarray:
    """Cuts of a tree in heap order: level ``d`` halves each part of the sample along axis ``d``."""
    cuts = np.zeros(1 << levels)
    parts = [sample]
    for level in range(levels):
        below = []
        for i, part in enumerate(parts):
            cut = float(np.median(part[:, level])) if len(part) else 0.0
            cuts[(1 << level) + i] = cut
            right = part[:, level] >= cut
            below += [part[~right], part[right]]
        parts = below
    return cuts


def leaves(points: np.ndarray, cuts: np.ndarray, levels: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, at home): each point's own leaf and all later leaves within ``reach`` of it."""
    row = np.arange(len(points))
    node, gap, home = np.ones(len(points), np.int64), np.zeros(len(points)), np.ones(len(points), bool)
    for level in range(levels):
        off = points[row, level] - cuts[node]
        own = (off >= 0).astype(np.int64)
        far = gap + off * off
        over = np.flatnonzero(far <= reach * reach + SLACK)
        row, gap = np.concatenate([row, row[over]]), np.concatenate([gap, far[over]])
        node = np.concatenate([2 * node + own, 2 * node[over] + 1 - own[over]])
        home = np.concatenate([home, np.zeros(len(over), bool)])
    leaf = node - (1 << levels)
    at_home = np.zeros(len(points), np.int64)
    at_home[row[home]] = leaf[home]
    later = leaf >= at_home[row]
    return row[later], leaf[later], home[later]


def linked(home: np.ndarray, guest: np.ndarray, axes: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``pairs`` (home x guest) have a cosine of at least ``threshold``."""
    a, b = units(home), units(guest)
    x, y = a @ axes, b @ axes
    width = x.shape[1]
    out = np.zeros(pairs.shape, bool)
    rows, columns, open_, total = np.arange(len(x)), np.arange(len(y)), pairs, np.zeros(pairs.shape)
    done = 0
    for end in [*[s for s in STEPS if s < width], width]:
        if not open_.any():
            return out
        keep, held = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        rows, columns = rows[keep], columns[held]
        open_, total = open_[np.ix_(keep, held)], total[np.ix_(keep, held)]
        total = total + x[rows, done:end] @ y[columns, done:end].T
        rest = np.outer(np.sqrt((x[rows, end:] ** 2).sum(axis=1)), np.sqrt((y[columns, end:] ** 2).sum(axis=1)))
        open_ = open_ & (total + rest >= threshold - SLACK)
        done = end
    close = open_ & (np.abs(total - threshold) <= SLACK)
    for i, j in zip(*np.nonzero(close)):
        p, q = home[rows[i]], guest[columns[j]]
        open_[i, j] = float(p @ q) / (float(np.sqrt(p @ p)) * float(np.sqrt(q @ q))) >= threshold
    out[np.ix_(rows, columns)] = open_
    return out


def least_reached(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id reachable from each row and each column of a link matrix."""
    most = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(links, right[None, :], most).min(axis=1, initial=most))
        new_right = np.minimum(right, np.where(links, new_left[:, None], most).min(axis=0, initial=most))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _tile(threshold: float, width: int, axes: np.ndarray):
    def compare(table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("embedding"))
        node, count = table.column("node").to_numpy(), table.column("n").to_numpy()
        at_home, is_guest, native = (np.asarray(table.column(c).to_numpy(), bool) for c in ("at_home", "is_guest", "native"))
        h, g = np.flatnonzero(at_home), np.flatnonzero(is_guest)
        turn = axes if vectors.shape[1] == width else np.eye(vectors.shape[1])
        pairs = ~native[g][None, :] | (node[h][:, None] < node[g][None, :])
        links = linked(vectors[h], vectors[g], turn, pairs, threshold)
        i, j = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        links, h, g = links[np.ix_(i, j)], h[i], g[j]
        # Rows and columns may be the same class: meet in one id space, then follow to the least.
        low_h, low_g = least_reached(links, node[h], node[g])
        return pa.table(
            {
                "node": pa.array(np.concatenate([node[h], node[g]]), pa.int64()),
                "links": pa.array(np.concatenate([links @ count[g], links.T @ count[h]]), pa.int64()),
                "root": pa.array(np.concatenate([low_h, low_g]), pa.int64()),
            }
        )

    return compare


def _tiles() -> F.Column:
    """The tiles of a row, ``blocks`` x ``slices`` a leaf: all of its own block, and those its slice meets."""
    block, piece = "pmod(xxhash64(node), blocks)", "pmod(xxhash64(node, 1), slices)"
    own = f"transform(sequence(0L, slices - 1), s -> struct({block} as b, s as s, true as at_home, s = {piece} as is_guest))"
    met = (f"transform(filter(sequence(0L, blocks - 1), b -> not native or b <> {block}), "
           f"b -> struct(b as b, {piece} as s, false as at_home, true as is_guest))")
    return F.explode(F.expr(f"if(native, concat({own}, {met}), {met})"))


def link_classes(classes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, home: int = HOME,
                 guests: int = GUESTS, sample: int = SAMPLE) -> DataFrame:
    """``node``, ``links``, ``root`` from ``node, label, n, embedding``; nodes may come more than once.

    ``links`` adds up to the number of rows linked with a class (its own copies aside) and the edges
    ``node`` - ``root`` connect exactly what is linked. ``home`` and ``guests`` bound a tile's sides,
    ``sample`` the classes that place the cuts.
    """
    widths = classes.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width")
    most = widths.first()
    if most is None:
        return classes.sparkSession.createDataFrame([], "node long, links long, root long")
    width, total = most["width"], most["n"]
    labels = max(1, classes.agg(F.approx_count_distinct("label")).first()[0])
    axes = learn_axes(classes, width)
    levels = int(min(MOST_LEVELS, width, max(0, np.ceil(np.log2(total / (labels * home))))))
    drawn = classes.filter(F.size("embedding") == width).orderBy(F.xxhash64("node")).limit(sample if levels else 0)
    points = [r[0] for r in drawn.select("embedding").collect()]
    cuts = learn_cuts(units(np.array(points, float)) @ axes, levels) if points else np.zeros(1)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(size == width)
            points = units(matrix(batch.column("embedding").take(pa.array(fits)))) @ axes if len(fits) else np.zeros((0, width))
            row, leaf, own = leaves(points, cuts, levels, reach)
            rest = np.flatnonzero(size != width)
            row = pa.array(np.concatenate([fits[row], rest]))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(row) for c in batch.columns),
                 pa.array(np.concatenate([leaf, np.zeros(len(rest), np.int64)]), pa.int64()),
                 pa.array(np.concatenate([own, np.ones(len(rest), bool)]))],
                names=[*batch.schema.names, "leaf", "native"],
            )

    columns = classes.select("node", "label", "n", "embedding")
    schema = StructType([*columns.schema.fields, StructField("leaf", LongType()), StructField("native", BooleanType())])
    dealt = columns.mapInArrow(deal, schema).withColumn("width", F.size("embedding"))
    leaf = ["label", "width", "leaf"]
    sizes = dealt.groupBy(*leaf).agg(
        F.ceil(F.sum(F.col("native").cast("long")) / home).alias("blocks"), F.ceil(F.count(F.lit(1)) / guests).alias("slices")
    ).filter("blocks > 0")
    sizes = scratch.keep(sizes, "leaf-sizes")
    tiles = dealt.join(hinted(sizes), leaf).withColumn("_tile", _tiles())
    tiles = tiles.select("node", "n", "embedding", "native", *leaf, "_tile.*")
    found = tiles.groupBy(*leaf, "b", "s").applyInArrow(_tile(threshold, width, axes), "node long, links long, root long")
    return scratch.keep(found, "tile-links")


def dedup(table: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, home: int = HOME, guests: int = GUESTS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``: one row per row of ``table``."""
    chosen = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    chosen = chosen.withColumn("embedding", F.when(_valid(), F.col("embedding")))
    named = chosen.mapInArrow(_named, StructType([*chosen.schema.fields, StructField("key", BinaryType())]))
    rows = scratch.keep(named, "vectors")
    classes = rows.filter("key is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding")
    )
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = link_classes(classes, scratch, threshold, home, guests)
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("label", "key", "least", "n", "node").join(links, "node", "left").join(roots, "node", "left")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    joined = scratch.keep(joined.withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0))), "linked-classes")
    grouped = joined.filter("links > 0").groupBy("root").agg(F.min("least").alias("component_id"))
    answer = joined.join(grouped, "root", "left").select(
        "label", "key", "n", "n_links", F.when(F.col("links") > 0, F.col("component_id")).otherwise(F.col("least")).alias("component_id")
    )
    answer = scratch.keep(answer, "class-components")
    # Classes of many rows are few, at most rows / HOT; their rows do not meet in one task.
    hot = hinted(answer.filter(F.col("n") > HOT).drop("n").withColumn("hot", F.lit(True)))
    plain = rows.select("vec_id", "label", "key")
    tagged = plain.join(hot, ["label", "key"], "left")
    cold = tagged.filter("hot is null").select("vec_id", "label", "key").join(
        answer.filter(F.col("n") <= HOT).drop("n"), ["label", "key"], "left")
    out = tagged.filter("hot").drop("hot").unionByName(cold)
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
