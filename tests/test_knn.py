"""Nearest neighbours against brute force, with ties, copies, hot cells and variable k."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivano.functions import vectors
from scrivano.operators import knn as nn


def data(n=400, m=60, dim=8, seed=0, copies=0.35):
    """A third of the collection is one vector, and some queries equal it."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[rng.random(n) < copies] = x[0]
    q = rng.normal(size=(m, dim)).astype(np.float32)
    q[:5] = x[0]
    q[5:10] = x[10 : 10 + len(q[5:10])]
    return x, q


def frames(spark, x, q, ks):
    collection = spark.createDataFrame(
        [(i * 3, v.tolist()) for i, v in enumerate(x)], "embedding_index long, embedding array<float>"
    ).repartition(5)
    queries = spark.createDataFrame(
        [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(q, ks))],
        "query_id long, embedding array<float>, k int",
    )
    return collection, queries


def brute(x, q, ks, metric="sqeuclidean"):
    x, q = x.astype(np.float64), q.astype(np.float64)
    out = {}
    for i, (v, k) in enumerate(zip(q, ks)):
        if metric == "sqeuclidean":
            d = ((x - v) ** 2).sum(axis=1)
        else:
            d = 1 - x @ v
            if metric == "cosine":
                lengths = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
                d = 1 - np.divide(x @ v, lengths, out=np.zeros(len(x)), where=lengths > 0)
        d = np.float32(np.round(d, 12)).astype(np.float64)
        order = np.lexsort((np.arange(len(x)), d))[:k]
        out[i] = [(int(j) * 3, round(float(d[j]), 5)) for j in order]
    return out


def collected(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.embedding_index, round(r.distance, 5)))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_scan_equals_brute_force(spark, metric):
    x, q = data()
    ks = np.arange(len(q)) % 9 + 1
    collection, queries = frames(spark, x, q, ks)
    assert collected(nn.knn(collection, queries, "k", metric)) == brute(x, q, ks, metric)


@pytest.mark.parametrize("options", [{}, {"tile_bytes": 1}, {"tile_bytes": 700, "split_rows": 16}, {"split_rows": 3}])
def test_tiles_equal_brute_force(spark, options):
    x, q = data(seed=1)
    ks = np.arange(len(q)) % 9 + 1
    collection, queries = frames(spark, x, q, ks)
    got = collected(nn.knn(collection, queries, "k", plan="tiles", **options))
    assert got == brute(x, q, ks)


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_tiles_serve_every_metric(spark, metric):
    x, q = data(seed=8)
    x[20:23], q[11] = 0, 0
    x[30:60] *= 50  # lengths differ, as inner products without normalisation would see them
    ks = np.arange(len(q)) % 9 + 1
    collection, queries = frames(spark, x, q, ks)
    got = collected(nn.knn(collection, queries, "k", metric, plan="tiles", tile_bytes=900, split_rows=50))
    want = brute(x, q, ks, metric)
    assert {i: [h for h, _ in v] for i, v in got.items()} == {i: [h for h, _ in v] for i, v in want.items()}


def test_tiles_return_k_rows_per_query_and_split(spark):
    x, q = data(400, 60, copies=0)
    collection, queries = frames(spark, x, q, np.full(60, 3))
    partial, splits = nn.partial_hits(collection, nn._with_k(queries, "k"), tile_bytes=1000, split_rows=50)
    assert splits == 8
    counts = [r["count"] for r in partial.groupBy("query_id", "split").count().collect()]
    assert len(counts) == 60 * 8 and set(counts) == {3}


def test_many_splits_merge_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(nn, "MERGE_SPLITS", 4)
    x, q = data(seed=4)
    ks = np.arange(len(q)) % 9 + 1
    collection, queries = frames(spark, x, q, ks)
    assert collected(nn.knn(collection, queries, "k", plan="tiles", split_rows=20)) == brute(x, q, ks)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_rounds_equal_brute_force(spark, metric):
    x, q = data(seed=9)
    ks = np.arange(len(q)) % 9 + 1
    collection, queries = frames(spark, x, q, ks)
    got = collected(nn.knn(collection, queries, "k", metric, plan="rounds", max_query_bytes=2000))
    assert got == brute(x, q, ks, metric)
    for some, asked in ((collection.limit(0), queries), (collection, queries.limit(0))):
        assert nn.knn(some, asked, 3, plan="rounds").count() == 0


def test_tables_of_many_blocks_are_searched_without_copies(spark, monkeypatch):
    monkeypatch.setattr(nn, "SPLIT_ROWS", 20)
    monkeypatch.setattr(nn, "TILE_BYTES", 700)
    rounds, search = [], nn._rounds
    monkeypatch.setattr(nn, "_rounds", lambda *all: rounds.append(1) or search(*all))
    x, q = data(seed=10)
    ks = np.full(len(q), 4)
    collection, queries = frames(spark, x, q, ks)
    assert nn._copies(collection, nn._with_k(queries, 4)) == 8
    assert collected(nn.knn(collection, queries, 4, max_query_bytes=2000)) == brute(x, q, ks) and rounds == [1]
    # One side is small: tiles move few copies.
    got = collected(nn.knn(collection.filter("embedding_index < 45"), queries, 4, max_query_bytes=2000))
    assert got == brute(x[:15], q, ks) and rounds == [1]


def test_large_query_tables_leave_the_broadcast_plan(spark):
    x, q = data(120, 30, seed=2)
    ks = np.full(len(q), 4)
    collection, queries = frames(spark, x, q, ks)
    got = collected(nn.knn(collection, queries, 4, max_query_bytes=100))
    assert got == brute(x, q, ks)
    with pytest.raises(ValueError, match="broadcast bound"):
        nn.knn(collection, queries, 4, plan="scan", max_query_bytes=100)


def test_k_beyond_the_collection_and_empty_sides(spark):
    x, q = data(6, 3, seed=3)
    collection, queries = frames(spark, x, q, [10, 0, 2])
    for plan in ("scan", "tiles", "hashed"):
        got = collected(nn.knn(collection, queries, "k", plan=plan))
        if plan != "hashed":
            assert [len(got.get(i, [])) for i in range(3)] == [6, 0, 2]
        assert nn.knn(collection.limit(0), queries, 3, plan=plan).count() == 0
        assert nn.knn(collection, queries.limit(0), 3, plan=plan).count() == 0


def test_self_query_returns_itself_first(spark):
    x, _ = data(50, 20, seed=4, copies=0)
    collection, _ = frames(spark, x, x, np.full(50, 3))
    queries = collection.withColumnRenamed("embedding_index", "query_id")
    first = nn.knn(collection, queries, 3).filter("rank = 1")
    assert first.filter("embedding_index = query_id and distance = 0").count() == 50


def test_approximate_store_keeps_the_contract(spark):
    x, q = data(600, 40, seed=5, copies=0)
    q[:20] = x[:20] + np.float32(0.2) * q[:20]
    ks = np.full(len(q), 5)
    collection, queries = frames(spark, x, q, ks)
    store = nn.ApproximateStore(collection)
    hits = store.query(queries, 5)
    got, want = collected(hits), brute(x, q, ks)
    assert all(len(got[i]) == 5 and len({h for h, _ in got[i]}) == 5 for i in want)
    found = sum(len(set(got[i]) & set(want[i])) for i in want)
    row = nn.recall(hits, nn.knn(collection, queries, 5)).first()
    assert (row.wanted, row.found) == (200, found) and row.recall == found / 200 > 0.85
    assert store.count() == 600


def test_more_tables_and_flips_find_everything(spark):
    x, q = data(200, 20, seed=6)
    ks = np.full(len(q), 4)
    collection, queries = frames(spark, x, q, ks)
    got = collected(nn.knn(collection, queries, 4, plan="hashed", tables=2, bits=3, flips=3, split_rows=17, tile_bytes=300))
    assert got == brute(x, q, ks)
    with pytest.raises(ValueError):
        nn.knn(collection, queries, 4, plan="hashed", bits=40)


def test_buckets_prune_separated_groups(spark):
    """A query meets few vectors of other groups."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 800)] + 0.05 * rng.normal(size=(800, 16))).astype(np.float32)
    collection, _ = frames(spark, x, x[:1], [1])
    dealt = nn._buckets(collection, 1, 10, 0)
    largest = dealt.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert dealt.count() == 800 and largest < 120


def test_fetch_takes_the_least_row_and_splits_hot_indices(spark, monkeypatch):
    hits = spark.createDataFrame([(i, 7 if i % 3 else i, 0.5, 1) for i in range(60)] + [(99, 12345, 0.1, 1)],
                                 "query_id long, embedding_index long, distance double, rank int")
    texts = spark.createDataFrame([(i, f"t{i}", i) for i in range(60)] + [(7, "a", 3), (7, None, 9), (7, None, 8)],
                                  "embedding_index long, document string, n long")
    want = {(i, 7 if i % 3 else i, None if i % 3 else f"t{i}", 8 if i % 3 else i) for i in range(60) if i % 3 or i != 7}

    def rows(**options):
        found = nn.fetch_hits(hits, texts, "document", "n", **options)
        return {(r.query_id, r.embedding_index, r.document, r.n) for r in found.collect()}, found.count()

    assert rows(max_hits=61) == (want, 60)
    assert rows() == (want, 60)
    monkeypatch.setattr(nn, "HOT_HITS", 5)
    assert rows() == (want, 60)
    monkeypatch.setattr(nn, "MAX_HOT_BYTES", 1)
    assert rows() == (want, 60)


def test_surplus_copies_leave_early():
    x = np.zeros((9, 3), np.float32)
    x[7:] = [[1, 2, 3], [3, 2, 1]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(9, 0, -1)), pa.array(x.tolist(), pa.list_(pa.float32()))],
        names=["embedding_index", "embedding"],
    )
    kept = nn._surplus_free(batch, 2)
    assert sorted(kept.column("embedding_index").to_pylist()) == [1, 2, 3, 4]
    assert nn._surplus_free(batch, 7).num_rows == 9


def test_distance_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.6, 0.8])],
                               "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(*[vectors.distance(a, b, m).alias(m) for m in vectors.METRICS]).collect()
    assert tuple(round(v, 5) for v in rows[0]) == (25.0, 1.0, 1.0)
    assert tuple(round(v, 5) for v in rows[1]) == (0.8, 0.4, 0.4)
    unit = df.select(vectors.l2_normalize(a).alias("u"), vectors.l2_normalize(b).alias("z")).first()
    assert [round(v, 6) for v in unit.u] == [0.6, 0.8] and unit.z == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.distance(a, b, "manhattan")


def test_scan_plan_has_no_join_and_reads_two_columns(spark, tmp_path):
    x, q = data(50, 5, seed=6)
    collection, queries = frames(spark, x, q, np.full(5, 2))
    wide = collection.withColumn("document", F.lit("long text"))
    wide.write.parquet(str(tmp_path / "c"))
    hits = nn.knn(spark.read.parquet(str(tmp_path / "c")), queries, 2, plan="scan")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "document" not in plan
    assert plan.count("Exchange") == 1


def test_small_tiles_move_in_few_blocks(spark):
    """However small tiles and splits are, a vector is copied once per block of queries only."""
    x, q = data(400, 60, copies=0)
    collection, queries = frames(spark, x, q, np.full(60, 3))
    partial, splits = nn.partial_hits(collection, nn._with_k(queries, "k"), tile_bytes=1, split_rows=3)
    assert splits == nn.SIDE_BLOCKS
    counts = [r["count"] for r in partial.groupBy("query_id", "split").count().collect()]
    assert len(counts) == 60 * splits and set(counts) == {3}


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("plan", ["scan", "tiles"])
def test_single_precision_products_lose_no_neighbour(spark, metric, plan):
    """Vectors far from the origin and close to each other, some much longer: products alone cannot order them."""
    rng = np.random.default_rng(9)
    x = (1000 + rng.integers(0, 64, size=(300, 8)) / 64).astype(np.float32)
    x[::50] *= 1e6
    x[7], x[60:63] = 0, x[59]
    q = x[np.arange(0, 300, 7)]
    collection, queries = frames(spark, x, q, np.full(len(q), 6))
    got = nn.knn(collection, queries, 6, metric, plan=plan)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.distance, r.embedding_index))
    for i, v in enumerate(q):
        d = nn._pair_distance(x, np.repeat(v[None, :], len(x), axis=0), metric)
        assert rows[i] == sorted((float(e), 3 * j) for j, e in enumerate(d))[:6]
