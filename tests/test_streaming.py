"""Stateful streams over several micro-batches: results, carried state, and state that is gone after its time."""

from pyspark.sql import functions as F

from scrivano.session import scratch_path
from scrivano.streaming.calllog import closing_row, stream_rates, stream_ttl_hits
from scrivano.streaming.memory import stream_contexts

S = 1_000_000


def drained(spark, frames, build, name):
    """Run ``build`` over the frames, a file each; the result and where its state is."""
    source, marks = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-marks")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (build(stream).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", marks).trigger(availableNow=True).start())
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(frames)
    return spark.table(name), marks


def keys_held(spark, marks, variable):
    state = spark.read.format("statestore").option("path", marks).option("stateVarName", variable).load()
    return {r[0] for r in state.select("key.*").collect()}


def test_ttl_state_is_carried_and_goes_after_the_ttl(spark):
    batches = [
        [(1, "old", 0), (2, "k", 5 * S), (3, "k", 9 * S)],
        [(4, "k", 14 * S), (5, "k", 15 * S), (6, "old", 9 * S + 1)],
        [(7, "k", 25 * S), (8, "new", 100 * S), (9, "new", 109 * S)],
        [(10, "new", 110 * S)],
    ]
    frames = [spark.createDataFrame([(e, k, us + 1000 * S) for e, k, us in b], "event_id long, key string, us long") for b in batches]
    out, marks = drained(spark, frames, lambda s: stream_ttl_hits(s, ttl_seconds=10, watermark="2 seconds"), "ttl")
    hits = {r.event_id: r.is_hit for r in out.collect()}
    assert hits == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: False, 9: True, 10: False}
    assert keys_held(spark, marks, "stored") == {"new"}


def test_sessions_go_when_idle(spark):
    def turn(session, number, second):
        return session, number, f"q{number}", f"r{number}", second + 1000

    batches = [[turn("a", 1, 0), turn("b", 1, 0)], [turn("a", 2, 50)], [turn("b", 2, 500), turn("a", 3, 100)], [turn("c", 1, 2000)]]
    schema = "session_id string, turn_no long, query string, response string, second long"
    frames = [spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_seconds("second")) for b in batches]
    out, marks = drained(spark, frames, lambda s: stream_contexts(s, watermark="10 seconds", idle="2 minutes"), "idle")
    got = {(r.session_id, r.turn_no): r.context for r in out.collect()}
    assert got[("a", 2)] == "User: q1\n\nAssistant: r1" and got[("b", 2)] == ""
    assert got[("a", 3)] == "User: q1\n\nAssistant: r1\n\nUser: q2\n\nAssistant: r2"
    assert keys_held(spark, marks, "newest") == {"c"}


def test_every_window_is_closed(spark):
    rows = [(i, "k" if i % 3 else "j", 1000 + i * 7) for i in range(60)]
    calls = spark.createDataFrame(rows, "event_id long, key string, second long").withColumn("ts", F.timestamp_seconds("second"))
    frames = [calls.filter("second < 1200"), calls.filter("second >= 1200"), closing_row(calls, seconds=400)]
    out, _ = drained(spark, frames, lambda s: stream_rates(s, window_seconds=60, step_seconds=20), "windows")
    got = {(r.key, int(r.window_start.timestamp())): r.calls for r in out.collect()}
    want = {}
    for _, key, second in rows:
        for back in range(3):
            start = (second // 20 - back) * 20
            want[key, start] = want.get((key, start), 0) + 1
    assert got == want
