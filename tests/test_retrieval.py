"""Routing, variants, re-ranking, composed retrieval and evaluation on hand-made rows."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from scrivano.functions import routing, scoring
from scrivano.operators import evaluation as ev
from scrivano.operators import embedding, knn, prompts
from scrivano.operators.rerank import boost_definitions
from scrivano.plans import jobs, retrieval
from scrivano.session import cut_lineage
from scrivano.sources import readers, vector_files, writers


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_routes_of_known_queries(spark):
    known = {
        "What is Murabahah?": ("definition", 0.253667, 3, True, False),
        "What are the rules for currency trading?": ("definition", 0.258095, 3, True, False),
        "Salam contract": ("simple", 0.211, 3, False, False),
        "Mudarabah": ("simple", 0.3535, 3, False, False),
        "": ("simple", 0.04, 3, False, False),
        "compare murabahah versus salam": ("complex", 0.8, 12, False, True),
        "Steps for the canvas": ("rules", None, 7, False, False),
        "is it forbidden": ("prohibition", None, 5, False, False),
    }
    for r in retrieval.route(frame(spark, list(known))).collect():
        qtype, score, n, boost, rerank = known[r.query]
        assert (r.query_type, r.strategy.n_results) == (qtype, n), r
        assert (r.strategy.boost_definitions, r.strategy.rerank) == (boost, rerank)
        assert r.strategy.use_query_expansion == (qtype != "simple")
        if score is not None:
            assert abs(r.complexity - score) < 1e-6, (r, score)


def own_score(q):
    words = q.split()
    mean = sum(map(len, words)) / len(words) if words else 0
    clauses = 1 + sum(q.count(c) for c in ".!?")
    asked = sum(w in q.lower() for w in ("what", "why", "how", "when", "where", "which", "who"))
    parts = (
        0.3 * min(len(q) / 200, 1), 0.2 * min(clauses / 5, 1), 0.2 * min(asked / 3, 1),
        max(0.0, 0.3 * min((mean - 4) / 5, 1)),
    )
    return min(sum(parts), 1)


def test_complexity_equals_own_formula(spark):
    rng = random.Random(2)
    words = ["what", "WHY", "who?", "a", "responsibility", "x.y!", "\n", " ", "é", "extraordinary"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = frame(spark, texts).select("query", routing.text_complexity(F.col("query")).alias("c"))
    for r in rows.collect():
        assert abs(r.c - own_score(r.query)) < 1e-9, r


def test_variants(spark):
    rows = frame(spark, ["What is Riba? really", "explain", "the meaning of  gold ", "trade"])
    got = {}
    for r in retrieval.expand(rows).orderBy("query_id", "variant_no").collect():
        got.setdefault(r.query_id, []).append(r.query)
    assert got[0] == ["What is Riba? really", "Definition of riba", "riba definition", "riba is",
                      "riba means", "Concept of riba"]
    assert got[1] == ["explain"] and got[3] == ["trade"]
    assert got[2][1] == "Definition of gold"


def test_boost_rules_and_stable_order(spark):
    contents = [
        "x" * 60, "y" * 60, "Definition: " + "x" * 60, "x" * 91 + "definition", "x" * 89 + "definition ",
        "a is b " + "x" * 60, "x" * 49, "x" * 50, "mudarabah " + "x" * 60, "mudarabah murabahah " + "x" * 60,
    ]
    hits = spark.createDataFrame(
        [(1, i + 1, c, 0.5) for i, c in enumerate(contents)],
        "query_id long, rank int, content string, distance double",
    )
    def scores(**limits):
        score = scoring.definition_score(F.col("distance"), F.col("content"), scoring.CONFUSABLE_TERMS, **limits)
        return [round(r.s, 6) for r in hits.orderBy("rank").select(score.alias("s")).collect()]

    assert scores() == [0.5, 0.5, 0.3, 0.3, 0.3, 0.4, 0.5, 0.5, 0.65, 0.5]
    assert scores(head_chars=100, short_below=50) == [0.5, 0.5, 0.3, 0.5, 0.3, 0.4, 0.6, 0.5, 0.65, 0.5]
    plain = boost_definitions(hits).orderBy("rank").collect()
    assert [contents.index(r.content) for r in plain] == [2, 3, 4, 5, 0, 1, 6, 7, 8, 9]
    off = boost_definitions(hits, F.lit(False)).orderBy("rank").collect()
    assert [r.content for r in off] == contents and {r.distance for r in off} == {0.5}


def own_metrics(paths, expected, k):
    rel = [any(e in p for e in expected) for p in paths]
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(expected), k) + 1))
    gain = sum(1 / math.log2(i + 1) for i, r in enumerate(rel[:k], 1) if r)
    return (
        sum(rel[:k]) / k, sum(rel[:k]) / len(expected) if expected else 0.0,
        gain / ideal if ideal else 0.0, next((1 / i for i, r in enumerate(rel, 1) if r), 0.0),
    )


def test_metrics_equal_own_python(spark):
    rng = random.Random(4)
    pool = ["2//1", "12//1", "2//10", "2", "5//1//1", "7"]
    cases, hits = [], []
    for case_id in range(150):
        expected = rng.sample(pool, rng.randrange(4))
        paths = [rng.choice(pool) for _ in range(rng.randrange(6))]
        cases.append((case_id, f"q{case_id}", expected, rng.choice([None, "rules"])))
        hits += [(case_id, i, p) for i, p in enumerate(paths, 1)]
    got = ev.evaluate(
        spark.createDataFrame(
            cases, "case_id long, query string, expected_sections array<string>, category string"
        ),
        spark.createDataFrame(hits, "query_id long, rank int, section_path string"),
    ).collect()
    assert len(got) == 150
    for r in got:
        _, query, expected, category = cases[r.case_id]
        paths = [p for c, _, p in hits if c == r.case_id]
        assert r.retrieved_sections == paths and r.category == (category or "unknown")
        assert r.top_section == (paths[0] if paths else None)
        for k in ev.DEFAULT_KS:
            want = own_metrics(paths, expected, k)
            have = (r[f"precision_at_{k}"], r[f"recall_at_{k}"], r[f"ndcg_at_{k}"], r.mrr)
            assert have == pytest.approx(want), r
    assert any(r.recall_at_5 > 1 for r in got)


def test_benchmark_over_a_small_corpus(spark):
    docs = spark.createDataFrame(
        [(1, "Shari'ah Standard No. (1)\n3//1 Murabahah is a sale with a known margin\n"
             "2//1 Currency trading rules\n2//2 Riba is prohibited\n5//1 Mudarabah is a partnership")],
        "doc_id long, text string",
    )
    collection = jobs.build_collection(jobs.build_sections(docs), dimension=64)
    assert [r.id for r in collection.orderBy("embedding_index").collect()] == [
        "section_0", "section_1", "section_2", "section_3"]
    cases = readers.read_test_cases(spark)
    per_case, report = jobs.run_benchmark(
        cases, collection, retrieval.default_embedder(dimension=64)
    )
    assert per_case.count() == 8
    row = report.first()
    assert row.total_queries == 8 and list(row.k_values) == [1, 3, 5]
    assert 0 < row.mean_mrr <= 1 and "Precision@3: " in row.summary
    hit = per_case.filter("query = 'What is Murabahah?'").first()
    assert "3//1" in hit.retrieved_sections and hit.mrr > 0


def test_retrieve_without_router(spark):
    rows = [(i, [1.0, float(i)], f"doc {i} is long enough to be no stub, as the rule wants it") for i in range(9)]
    collection = spark.createDataFrame(
        [(f"section_{i}", i, v, d, None, f"{i}//1", None, 1) for i, v, d in rows],
        "id string, embedding_index long, embedding array<float>, document string, "
        "section_number string, section_path string, content_length int, line_number int",
    )
    queries = spark.createDataFrame([(1, "q", [1.0, 3.2])], "query_id long, query string, embedding array<float>")
    hits = retrieval.retrieve(queries, collection, router=None, n_results=4).orderBy("rank").collect()
    assert [h.id for h in hits] == ["section_3", "section_4", "section_2", "section_5"]
    assert hits[0].section_number == "" and hits[0].content_length == len(rows[3][2])
    assert hits[3].relevance_score == pytest.approx(1 - 3.24, abs=1e-5)


def test_router_and_store_plug_in(spark):
    rows = [(f"section_{i}", i, [1.0, float(i)], "d" * 60, "s", "p", 60, 1) for i in range(30)]
    collection = spark.createDataFrame(
        rows, "id string, embedding_index long, embedding array<float>, document string, "
        "section_number string, section_path string, content_length int, line_number int")
    queries = spark.createDataFrame(
        [(i, "q", [1.0, i * 7 + 0.2]) for i in range(4)], "query_id long, query string, embedding array<float>")

    def two_results(df):
        plan = F.struct(F.lit(2).alias("n_results"), F.lit(True).alias("boost_definitions"))
        return df.withColumn("strategy", plan)

    exact = retrieval.retrieve(queries, collection, router=two_results)
    near = retrieval.retrieve(
        queries, collection, router=two_results,
        store=knn.ApproximateStore(collection, bits=2, flips=2))
    for hits in (exact, near):
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {i: [f"section_{i * 7}", f"section_{i * 7 + 1}"] for i in range(4)}


def test_bucketed_collection_is_read_in_place(spark, tmp_path):
    rows = [(f"section_{i}", i, [1.0, float(i)], "d" * 60, "s", "p", 60, 1) for i in range(200)]
    collection = spark.createDataFrame(
        rows, "id string, embedding_index long, embedding array<float>, document string, "
        "section_number string, section_path string, content_length int, line_number int")
    table = writers.write_bucketed(collection, "bucketed_test", str(tmp_path / "b"), 4)
    hits = spark.createDataFrame([(i, i * 3, 0.5, 1) for i in range(50)], "query_id long, embedding_index long, distance double, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = knn.fetch_hits(hits, table, "document", "section_path", unique=True)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == 50
    # The winners alone are exchanged, not the texts.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    twice = collection.unionByName(collection.limit(1))
    with pytest.raises(ValueError, match="not unique"):
        writers.write_bucketed(twice, "bucketed_twice", str(tmp_path / "c"), 2)
    spark.sql("drop table bucketed_test")
    spark.sql("drop table bucketed_twice")


def test_file_store_commits_whole_collections(spark, tmp_path):
    path = str(tmp_path / "vectors")
    with pytest.raises(FileNotFoundError, match="build it first"):
        retrieval.FileStore(spark, path)
    frame = spark.range(300, numPartitions=5).select(
        F.col("id").alias("embedding_index"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    vector_files.write_vectors(frame.limit(0), path)
    assert retrieval.FileStore(spark, path).count() == 0
    vector_files.write_vectors(frame, path)
    store = retrieval.FileStore(spark, path)
    assert store.count() == 300 == store.collection.count() and store.collection.rdd.getNumPartitions() == 5
    (tmp_path / "vectors" / "stray.arrow").write_bytes(b"of an attempt that failed")
    queries = spark.createDataFrame([(1, [7.2, 1.0])], "query_id long, embedding array<float>")
    assert [r.embedding_index for r in store.query(queries, 3).orderBy("rank").collect()] == [7, 8, 6]
    vector_files.write_vectors(frame.filter("embedding_index < 10"), path, append=True)
    assert retrieval.FileStore(spark, path).count() == 310
    vector_files.write_vectors(frame.filter("embedding_index < 10"), path)
    assert retrieval.FileStore(spark, path).count() == 10

    @F.udf("long")
    def fails(x):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        vector_files.write_vectors(frame.withColumn("embedding_index", fails("embedding_index")), path)
    assert retrieval.FileStore(spark, path).count() == 10


def test_every_row_is_encoded_once(spark, tmp_path):
    # An encoder outlives a task, so it counts in files: a byte per text, a byte per load.
    encoded, loaded = str(tmp_path / "encoded"), str(tmp_path / "loaded")

    def mark(path, times):
        with open(path, "ab", buffering=0) as file:
            file.write(b"x" * times)

    def factory():
        mark(loaded, 1)

        def encode(texts):
            mark(encoded, len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    docs = spark.range(500, numPartitions=8).select(F.col("id").alias("embedding_index"), F.col("id").cast("string").alias("content"))
    frame = embedding.embed(docs, "content", "own", factory)
    writers.write_embeddings(frame, str(tmp_path / "v"), str(tmp_path / "s"), str(tmp_path / "m"), "own")
    assert os.path.getsize(encoded) == 500 and os.path.getsize(loaded) <= 4  # workers
    assert readers.read_embedded_sections(spark, str(tmp_path / "s"), str(tmp_path / "v")).count() == 500


def test_a_run_searches_once_for_cases_and_report(spark):
    searched = spark.sparkContext.accumulator(0)

    def search(batches):
        for batch in batches:
            searched.add(batch.num_rows)
            yield batch

    cases = spark.createDataFrame([(i, "q", ["a//1"], "c") for i in range(6)], "case_id long, query string, expected_sections array<string>, category string")
    hits = spark.createDataFrame([(i, 1, f"a//{i % 3}") for i in range(6)], "query_id long, rank int, section_path string")
    per_case, report = ev.run(cases, hits.mapInArrow(search, hits.schema))
    assert per_case.filter("mrr = 1").count() == 2 and report.first().total_queries == 6
    assert searched.value == 6


@pytest.mark.parametrize("limit", [None, 100])
def test_marks_rank_like_texts_and_move_in_their_place(spark, limit):
    texts = ["A definition is", "mudarabah means", "plain", None, "mudarabah or murabahah refers to", "definition"]
    table = spark.createDataFrame(list(enumerate(texts)) + [(0, "b"), (9, "never found")], "embedding_index long, content string")
    rows = [(q, i, 0.1 * ((i * 5 + q) % 4), r + 1) for q in range(3) for r, i in enumerate([(q + s) % 6 for s in range(6)])]
    hits = spark.createDataFrame(rows, "query_id long, embedding_index long, distance double, rank int")
    plain = boost_definitions(knn.fetch_hits(hits, table, "content", max_hits=limit), topic_penalties=True)
    marks = {"marks": scoring.definition_marks(F.col("content"), scoring.CONFUSABLE_TERMS)}
    carried = knn.fetch_hits(hits, table, "content", max_hits=limit, derive=marks)
    assert "content" not in carried.columns
    marked = boost_definitions(carried, topic_penalties=True, marks="marks")
    names = ["query_id", "rank", "embedding_index", "distance"]
    assert sorted(map(tuple, marked.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))


def test_prompts_in_blocks_equal_prompts_of_hits_and_move_texts_packed(spark):
    words = ["salam", "ijarah", "riba", "definition", "mudarabah", "is", "means", "gold"]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(40)] + [None, "", "é x"]
    rows = [(i, f"{i}//1" if i % 3 else None, t) for i, t in enumerate(texts)] + [(7, "7//2", "again")]
    sections = spark.createDataFrame(rows, "embedding_index long, section_path string, document string")
    sections = sections.withColumn("section_number", F.lit("1")).withColumn("content_length", F.lit(1))
    vectors = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(len(texts))}
    vector = F.udf(lambda i: vectors[i], "array<float>")
    collection = sections.withColumn("embedding", vector("embedding_index"))
    asked = [(i, f"what is {rng.choice(words)} {i}" if i % 2 else f"{i}", str(i % 3)) for i in range(60)] + [(60, " ", "1")]
    requests = spark.createDataFrame(asked, "query_id long, query string, session_id string")
    turns = spark.createDataFrame([("1", 1, "q", "r"), ("2", 1, "q2", None)], "session_id string, turn_no long, query string, response string")
    embed = lambda q: q.withColumn("embedding", vector(F.col("query_id") % 40))
    _, want = jobs.prepare_prompts(requests, collection, turns, "contract", embed)
    have = jobs.request_prompts(requests, collection, turns, "contract", embed)
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect())) and have.count() == 60
    # Many blocks, and no winner broadcast.
    query, nearest, _ = retrieval.routed_nearest(requests.select("query_id", "query"), collection, embed)
    boosted = cut_lineage(nearest.join(query.select("query_id", "_boost"), "query_id"))
    some = requests.select("query_id", "query")
    many = prompts.build_prompts_in_blocks(some, boosted, collection, block_requests=4)
    plain = prompts.build_prompts(some, retrieval.retrieve(some, collection, embed))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, plain.collect()))
    # Packed texts move to their block, and nothing moves after that.
    plan = have._jdf.queryExecution().executedPlan().toString()
    assert "packed" in plan and "hashpartitioning(block" in plan
    assert not re.search(r"hashpartitioning\(block#\d+, query_id", plan)


def test_long_texts_move_to_few_blocks_of_prompts(spark, monkeypatch):
    texts = [(i, "1", f"{i}//1", "short text" if i < 60 else f"long text {i} " * 50) for i in range(64)]
    collection = spark.createDataFrame(texts, "embedding_index long, section_number string, section_path string, document string")
    requests = spark.createDataFrame([(i, f"asked {i}") for i in range(60)], "query_id long, query string")
    hits = [(i, at, float(rank), rank, False) for i in range(60) for rank, at in ((1, (i * 7) % 60), (2, 60 + i % 4))]
    nearest = cut_lineage(spark.createDataFrame(hits, "query_id long, embedding_index long, distance double, rank int, _boost boolean"))
    moved, fetch = [], prompts.fetch_hits
    monkeypatch.setattr(prompts, "fetch_hits", lambda asks, *more, **options: moved.extend(asks.collect()) or fetch(asks, *more, **options))
    out = prompts.build_prompts_in_blocks(requests, nearest, collection, block_requests=15).collect()
    assert len(out) == 60 and all(f"long text {60 + r.query_id % 4} " in r.prompt and "short text" in r.prompt for r in out)
    copies = [r.embedding_index for r in moved if r.embedding_index >= 60]
    assert len(moved) > 60 and 4 <= len(copies) <= 7  # four long texts, one more for every end of a block


def test_only_texts_of_repeated_indices_move_to_be_told_apart(spark):
    rows = [(i, f"text {i}") for i in range(20)] + [(3, "a text"), (5, None)]
    collection = spark.createDataFrame(rows, "embedding_index long, document string")
    hits = spark.createDataFrame([(i, i % 25) for i in range(40)], "query_id long, embedding_index long")
    out = knn.fetch_hits(hits, collection, "document")
    want = {(i, i % 25, {3: "a text", 5: None}.get(i % 25, f"text {i % 25}")) for i in range(40) if i % 25 < 20}
    assert {(r.query_id, r.embedding_index, r.document) for r in out.collect()} == want and out.count() == len(want)
    assert "LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()
