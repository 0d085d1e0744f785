"""Call-log operators against plain Python on random and hand-made logs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scrivano.operators import calllog as cl
from scrivano.operators import sweep

S = 1_000_000


def cache_hits(calls, ttl):
    stored, hits = {}, {}
    for event_id, key, us in sorted(calls, key=lambda c: (c[2], c[0])):
        hits[event_id] = key in stored and us - stored[key] < ttl
        if not hits[event_id]:
            stored[key] = us
    return hits


def log(seed, n=3000):
    rng = random.Random(seed)
    out, now = [], 0
    for event_id in range(n):
        now += rng.choice([0, 0, 1, 5, S // 2, S, 3 * S, 40 * S if rng.random() < 0.05 else S])
        # One key holds most of the calls.
        out.append((event_id, rng.choice(["hot"] * 6 + ["a", "b", "c"]), now))
    return out


@pytest.mark.parametrize("ttl", [1, 10, 100, 10**6])
def test_ttl_hits_follow_the_chain(spark, ttl):
    calls = log(ttl)
    df = spark.createDataFrame(calls, "event_id long, key string, us long").repartition(3)
    got = {r.event_id: r.is_hit for r in cl.ttl_hits(df, ttl_seconds=ttl).collect()}
    assert got == cache_hits(calls, ttl * S)


def test_ttl_boundaries(spark):
    calls = [(1, "k", 0), (2, "k", 10 * S - 1), (3, "k", 10 * S), (4, "k", 15 * S), (5, "k", 20 * S)]
    df = spark.createDataFrame(calls, "event_id long, key string, us long")
    rows = cl.ttl_hits(df, ttl_seconds=10).orderBy("event_id").collect()
    assert [r.is_hit for r in rows] == [False, True, False, True, False]


def test_one_key_inside_one_ttl_spreads_over_tasks(spark):
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("hot").alias("key"), (F.col("id") * 7).alias("us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    swept = sweep.next_instants(df, "key", "us", 7 * 1000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = swept.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1600
    assert swept.filter("next <> us + 7000").count() == 0 and swept.count() == 3000
    assert cl.ttl_hits(df).filter("is_hit").count() == 3999


def test_next_instants_of_small_batches(spark):
    rng = random.Random(2)
    pairs = sorted({(rng.choice("aabc"), rng.randrange(3000)) for _ in range(900)})
    df = spark.createDataFrame(pairs, "key string, us long").repartition(5)
    got = {(r.key, r.us): r.next for r in sweep.next_instants(df, "key", "us", 50).collect()}
    want = {}
    for key, us in pairs:
        later = [u for k, u in pairs if k == key and u >= us + 50]
        if later:
            want[key, us] = min(later)
    assert got == want


def test_running_total_crosses_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), F.lit(2).cast("long").alias("n"))
    rows = sweep.running_total(df, ["v"], "n").collect()
    assert all(r.upto == 2 * (r.v + 1) for r in rows) and len(rows) == 1000


def test_call_rate_across_slices(spark):
    calls = log(5) + [(9001, "x", 0), (9002, "x", 60 * S), (9003, "x", 60 * S), (9004, "x", 119 * S)]
    df = spark.createDataFrame(calls, "event_id long, key string, us long")
    got = {r.event_id: (r.calls_in_window, r.over_limit) for r in cl.call_rate(df).collect()}
    assert len(got) == len(calls)
    for event_id, key, us in calls:
        n = sum(k == key and us - 60 * S < u <= us for _, k, u in calls)
        assert got[event_id] == (n, n > 15)


def test_call_rate_of_hot_instants_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(sweep, "HOT_ROWS", 20)
    calls = [(i, "k", 5 * S) for i in range(50)] + [(60, "k", 6 * S), (61, None, 5 * S), (62, None, 5 * S), (63, "k", None)]
    df = spark.createDataFrame(calls, "event_id long, key string, us long")
    got = {r.event_id: (r.calls_in_window, r.over_limit) for r in cl.call_rate(df).collect()}
    assert got == {**{i: (50, True) for i in range(50)}, 60: (51, True), 61: (2, False), 62: (2, False), 63: (None, False)}


def test_request_key_is_canonical_json(spark):
    df = spark.createDataFrame([("f", 3, "x y")], "name string, a int, b string")
    key = cl.request_key(F.col("name"), [F.col("a")], {"z": F.col("b"), "c": F.lit(True)})
    want = json.dumps({"args": ["f", 3], "kwargs": {"z": "x y", "c": True}}, sort_keys=True)
    assert df.select(key).first()[0] == hashlib.md5(want.encode()).hexdigest()


def test_errors(spark):
    messages = ["429", "Quota!", "retry in 12.5s", "rate limit, retry in 12.5s", "exceeded", "other"]
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    rows = {r.message: (r.is_quota_error, r.retry_delay) for r in cl.classify_errors(df).collect()}
    assert rows["rate limit, retry in 12.5s"] == (True, 14.5)
    assert rows["retry in 12.5s"] == (False, None) and rows["other"] == (False, None)
    assert all(rows[m] == (True, None) for m in ("429", "Quota!", "exceeded"))


def test_summary(spark):
    df = spark.createDataFrame([("f", 1.0, False), ("f", 3.0, True), ("g", 2.0, False)],
                               "name string, duration double, failed boolean")
    f = cl.call_summary(df).filter("name = 'f'").first()
    assert (f.calls, f.failures, f.successes, f.mean_duration) == (2, 1, 1, 2.0)


def test_calls_without_a_key_are_no_hits(spark):
    rows = [(None, 0, 1), (None, 10, 2), ("a", 0, 3), ("a", 10, 4), ("a", None, 5)]
    calls = spark.createDataFrame(rows, "key string, us long, event_id long")
    hits = {r.event_id: r.is_hit for r in cl.ttl_hits(calls).collect()}
    assert hits == {1: False, 2: False, 3: False, 4: True, 5: False}


def test_request_key_escapes_characters_beyond_ascii(spark):
    rows = [("é",), ("plain",), ("a😀\"b\u00a0",), ("你好",)]
    frame = spark.createDataFrame(rows, "x string")
    keys = [r[0] for r in frame.select(cl.request_key(F.col("x"), kwargs={"k": F.col("x")})).collect()]
    for (x,), key in zip(rows, keys):
        whole = json.dumps({"args": [x], "kwargs": {"k": x}}, sort_keys=True)
        assert key == hashlib.md5(whole.encode()).hexdigest()
