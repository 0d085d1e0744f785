"""Conversation memory against a sequential fold, in batch and streaming form; prompts, records."""

import json
import random

from pyspark.sql import functions as F

from scrivano.operators import memory as mem
from scrivano.operators import prompts
from scrivano.plans import jobs
from scrivano.session import scratch_path
from scrivano.streaming.memory import stream_contexts

SCHEMA = (
    "session_id string, turn_no long, query string, response string, "
    "metadata struct<standards_found:int,standards:array<string>,query_type:string>"
)


def render(turn, with_metadata):
    _, _, query, response, metadata = turn
    parts = [f"User: {query}", f"Assistant: {response}"]
    if with_metadata and metadata:
        kept = {k: v for k, v in metadata.items() if v is not None}
        parts.append("Context: " + json.dumps(kept, indent=2))
    return "\n\n".join(parts)


def contexts(turns, limit=4000, last=5, with_metadata=False):
    """Context before each turn and after the last one, by walking every session."""
    before, seen = {}, {}
    for turn in sorted(turns, key=lambda t: (t[0], t[1])):
        history = seen.setdefault(turn[0], [])
        before[turn[:2]] = "\n\n".join(render(t, with_metadata) for t in history[-last:])[-limit:]
        history.append(turn)
    after = {s: "\n\n".join(render(t, with_metadata) for t in h[-last:])[-limit:] for s, h in seen.items()}
    return before, after


def turns(seed=1):
    rng = random.Random(seed)
    out = []
    # One session is as long as all others together, and its numbers have gaps.
    for session, n in [("hot", 400)] + [(f"s{i}", rng.choice([1, 2, 5, 6, 10, 11])) for i in range(60)]:
        number = 0
        for _ in range(n):
            number += rng.choice([1, 1, 2, 37])
            metadata = rng.choice([
                None,
                {"standards_found": 2, "standards": ["2//1", "3//1"], "query_type": "question"},
                {"standards_found": 0, "standards": [], "query_type": None},
            ])
            out.append((session, number, f"q{number}", "r" * rng.choice([10, 600, 1500]) + str(number), metadata))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_contexts_equal_the_fold(spark):
    rows = turns()
    df = frame(spark, rows)
    for with_metadata, limit, slice_turns in ((False, 1500, 50), (True, 4000, 1000), (True, 4000, 3)):
        before, after = contexts(rows, limit, with_metadata=with_metadata)
        got = mem.context_before_turn(df, with_metadata, max_chars=limit, slice_turns=slice_turns)
        assert {(r.session_id, r.turn_no): r.context for r in got.collect()} == before
        got = mem.session_context(df, with_metadata, max_chars=limit)
        assert {r.session_id: r.context for r in got.collect()} == after
    before, _ = contexts(rows, last=2)
    got = mem.context_before_turn(df, max_history=2, slice_turns=10)
    assert {(r.session_id, r.turn_no): r.context for r in got.collect()} == before


def test_retention_recent_queries_and_clearing(spark):
    rows = turns(2)
    df = frame(spark, rows)
    by_session = {}
    for r in sorted(rows, key=lambda t: t[1]):
        by_session.setdefault(r[0], []).append(r)
    kept = mem.last_turns(df).groupBy("session_id").agg(F.array_sort(F.collect_list("turn_no")).alias("t"))
    assert {r.session_id: r.t for r in kept.collect()} == {
        s: [t[1] for t in h[-10:]] for s, h in by_session.items()}
    for n in (3, 0, 25):
        got = {r.session_id: r.recent_queries for r in mem.recent_queries(df, n).collect()}
        assert got == {s: [t[2] for t in h[-10:][-n:]] for s, h in by_session.items()}
    cleared = spark.createDataFrame([("hot", 500), ("hot", 100), ("s1", None)], "session_id string, cleared_at long")
    left = mem.clear_sessions(df, cleared)
    assert left.filter("session_id = 's1' or (session_id = 'hot' and turn_no <= 500)").count() == 0
    assert left.count() == sum(t[0] != "s1" and not (t[0] == "hot" and t[1] <= 500) for t in rows)


def test_retention_is_limited_before_the_shuffle(spark):
    plan = mem.last_turns(frame(spark, turns()))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_stream_equals_batch(spark):
    rows = [t for t in turns(3) if t[0] != "hot"] + [t for t in turns(3) if t[0] == "hot"][:60]
    source = scratch_path(spark, "turns")
    ordered = sorted(rows, key=lambda t: t[1])
    for lo in range(0, len(ordered), 150):  # one file, one micro-batch each
        part = frame(spark, ordered[lo : lo + 150]).withColumn("ts", F.timestamp_seconds("turn_no"))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    stream = stream.option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream_contexts(stream, max_chars=1500, idle="30 days").writeStream.format("memory").queryName("ctx")
        .option("checkpointLocation", scratch_path(spark, "marks"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len(query.recentProgress) > 1
    before, _ = contexts(rows, 1500)
    got = {(r.session_id, r.turn_no): r.context for r in spark.table("ctx").collect()}
    assert got == before


def test_stream_with_watermark_drops_late_and_idle(spark):
    source = scratch_path(spark, "timed")
    batches = [
        [("a", 1, "q1", "r1", "2024-01-01 00:00:00"), ("b", 1, "x1", "y1", "2024-01-01 00:00:00")],
        [("a", 2, "q2", "r2", "2024-01-01 05:00:00")],
        [("a", 3, "q3", "r3", "2024-01-01 00:10:00"), ("b", 2, "x2", "y2", "2024-01-01 05:01:00")],
        [("b", 3, "x3", "y3", "2024-01-01 05:02:00")],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "session_id string, turn_no long, query string, response string, ts string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    stream = stream.option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    query = (
        stream_contexts(stream, watermark="10 minutes", idle="1 hour")
        .writeStream.format("memory").queryName("timed")
        .option("checkpointLocation", scratch_path(spark, "marks"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.session_id, r.turn_no): r.context for r in spark.table("timed").collect()}
    assert ("a", 3) not in got  # older than the watermark
    assert got[("b", 2)] == ""  # the session had been idle for hours and was forgotten
    assert got[("b", 3)] == "User: x2\n\nAssistant: y2"


HITS = ("query_id long, rank int, section_number string, section_path string, content string, "
        "relevance_score double, content_length int")


def test_prompts_and_records(spark):
    hits = spark.createDataFrame(
        [(1, i, f"{i}", f"{i}//1", f"text {i}", 0.5, 6) for i in (7, 2, 1, 3, 5, 4, 6)]
        + [(2, 1, None, None, None, None, None)], HITS)
    requests = spark.createDataFrame(
        [(1, "q" * 4000, "s1", "User: a"), (2, "short", "s2", ""), (3, "none", "s3", None)],
        "query_id long, query string, session_id string, context string")
    template = "T:{text}|H:{history}|S:{sections}|{other}"
    asked = {r.query_id: r.prompt for r in prompts.build_prompts(requests, hits, template=template).collect()}
    quoted = "\n\n".join(f"Standard {i}//1 ({i}):\ntext {i}" for i in range(1, 8))
    block = "\n\nPREVIOUS CONVERSATION:\nUser: a\n"
    assert asked[1] == f"T:{'q' * 4000}|H:{block}|S:{quoted}|{{other}}"
    assert asked[2] == "T:short|H:|S:Standard N/A (N/A):\n|{other}"
    assert asked[3] == "T:none|H:|S:|{other}"
    contract = {r.query_id: r.prompt
                for r in prompts.build_prompts(requests, hits, "contract", template).collect()}
    assert contract[1] == asked[1]
    cut = prompts.build_prompts(requests, hits, "contract", template, max_chars=3000, top=5)
    cut = {r.query_id: r.prompt for r in cut.collect()}
    assert cut[1].startswith(f"T:{'q' * 3000}|") and "text 5" in cut[1] and "text 6" not in cut[1]

    responses = spark.createDataFrame([(1, "yes", "m", "p", 9), (3, "no", "m", "p", None)],
                                      "query_id long, text string, model string, provider string, tokens_used int")
    records, new_turns = jobs.finish_requests(requests, hits, responses, "contract")
    parsed = {r.query_id: json.loads(r.json) for r in prompts.as_json(records).collect()}
    assert sorted(parsed) == [1, 2, 3]
    assert parsed[2]["analysis"] is None and parsed[2]["summary"]["llm_model"] is None and parsed[2]["contract_length"] == 5
    assert parsed[1]["contract_length"] == 4000 and parsed[1]["analysis"]["analysis"] == "yes"
    assert [h["rank"] for h in parsed[1]["relevant_standards"]] == [1, 2, 3, 4, 5, 6, 7]
    assert parsed[1]["summary"] == {"standards_found": 7, "llm_provider": "p", "llm_model": "m", "session_id": "s1"}
    assert parsed[3]["relevant_standards"] == []
    turn = {r.query_id: r for r in new_turns.collect()}
    assert turn[1].query == "Analyze contract (4000 chars)" and turn[1].metadata.standards_found == 7
    assert turn[2].response is None and turn[2].metadata.standards_found == 1
    assert turn[3].metadata.standards == [] and turn[1].metadata.query_type is None
    records, new_turns = jobs.finish_requests(requests, hits, responses)
    assert records.filter("query_id = 1").first().answer.answer == "yes"
    assert {r.metadata.query_type for r in new_turns.collect()} == {"question"}


def test_listing(spark):
    rows = [("s", i, i % 2 == 0, f"preview {i} " + "z" * 80, i, 100 + i) for i in range(1, 13)]
    history = spark.createDataFrame(
        rows, "session_id string, turn_no long, is_question boolean, preview string, standards_found int, text_length int")
    listed = mem.history_listing(history).orderBy("position").collect()
    assert len(listed) == 10 and [r.number for r in listed] == list(range(10, 0, -1))
    assert listed[0].label == f"Question #10 - {('preview 12 ' + 'z' * 80)[:60]}... (12 standards)"
    assert listed[1].label.endswith("... (11 standards, 111 chars)")


def test_pairs_follow_the_order_across_gaps(spark):
    rows = [("a", 1, "user", "q1"), ("a", 5, "assistant", "r1"), ("a", 9, "user", "lost"), ("a", 12, "user", "q2"),
            ("a", 40, "assistant", "r2"), ("a", 41, "assistant", "extra"), ("b", 2, "user", "last"), ("c", 1, "assistant", "first"),
            (None, 3, "user", "q3"), (None, 8, "assistant", "r3"), ("d", 1, "system", "x"), ("d", 2, "user", "q4"), ("d", 9, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(4)
    got = {(r.session_id, r.turn_no): (r.query, r.response) for r in mem.turns_from_messages(df).collect()}
    assert got == {("a", 1): ("q1", "r1"), ("a", 12): ("q2", "r2"), (None, 3): ("q3", "r3"), ("d", 2): ("q4", None)}


def test_contexts_of_turns_without_session_or_number(spark):
    rows = [(None, i, f"q{i}", f"r{i}", None) for i in (1, 30, 61)] + [("s", 5, "x", "y", None), ("s", None, "first", "f", None)]
    got = {(r.session_id, r.turn_no): r.context for r in mem.context_before_turn(frame(spark, rows), slice_turns=10).collect()}
    assert got[None, 61] == "User: q1\n\nAssistant: r1\n\nUser: q30\n\nAssistant: r30" and got[None, 1] == ""
    assert got["s", 5] == "User: first\n\nAssistant: f" and got["s", None] == "" and len(got) == 5


def test_metadata_is_ascii(spark):
    meta = {"standards_found": 1, "standards": ["é//1", "a\"b"], "query_type": "ß😀"}
    df = frame(spark, [("s", 1, "q", "r", meta)])
    got = df.select(mem.metadata_json(F.col("metadata"))).first()[0]
    assert got == json.dumps(meta, indent=2)
