"""Readers and writers: round trips, required columns, defaults, clear errors, and encoders."""

import csv
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivano.operators import embedding as emb
from scrivano.plans import jobs
from scrivano.session import cut_lineage
from scrivano.sources import quoted_csv, readers, text_files, writers
from scrivano.streaming.calllog import stream_first_calls
from scrivano.workloads import tables


def test_corpus_and_contracts(spark, tmp_path):
    (tmp_path / "one.txt").write_text("line 1\nline 2", encoding="utf-8")
    (tmp_path / "one-cleaned.txt").write_text("output", encoding="utf-8")
    (tmp_path / "two.md").write_text("other", encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" \n", encoding="utf-8")
    rows = {r.filename: r for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["blank.txt", "one.txt"]
    assert rows["one.txt"].text == "line 1\nline 2" and rows["one.txt"].stem == "one"
    paths = [str(tmp_path / n) for n in ("one.txt", "blank.txt")]
    assert [r.query for r in readers.read_contracts(spark, *paths).collect()] == ["line 1\nline 2"]


def test_text_files_are_written_in_folders_and_read_without_listing_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_files, "FOLDER_FILES", 4)
    path = f"file://{tmp_path}/texts"
    rows = [(f"t{i % 7}.txt", None if i == 3 else f"text {i}\r\né") for i in range(20)] + [("x-cleaned.txt", "out"), ("y.md", "out")]
    df = spark.createDataFrame(rows, "name string, value string").coalesce(1)
    text_files.write_texts(df, path)
    back = readers.read_corpus(spark, path)
    assert sorted((r.filename, r.text) for r in back.collect()) == sorted((n, (v or "") + "\n") for n, v in rows[:20])
    assert readers.read_contracts(spark, path).count() == 21  # the null text is a blank file
    # The driver knows folders of files, and a folder of a failed attempt is in no list.
    parts = text_files.TextReader(path).partitions()
    assert sum(p.files for p in parts) == 22 and len(parts) < 22
    (stray := tmp_path / "texts" / "texts-failed" / "0").mkdir(parents=True)
    (stray / "t0.txt").write_text("stray")
    assert back.count() == 20
    # A lost file raises.
    next((tmp_path / "texts" / parts[0].name).glob("*.txt")).unlink()
    with pytest.raises(Exception, match="files instead of"):
        back.count()


def test_no_text_file_outside_its_folder(spark, tmp_path):
    for name in ("../a.txt", "", None):
        with pytest.raises(Exception, match="no file can be named"):
            text_files.write_texts(spark.createDataFrame([(name, "x")], "name string, value string"), str(tmp_path / "t"))
    assert not text_files.holds(str(tmp_path / "t")) and not text_files.holds("viewfs://store/in")
    text_files.write_texts(spark.createDataFrame([], "name string, value string"), str(tmp_path / "t"))
    assert readers.read_corpus(spark, str(tmp_path / "t")).count() == 0


def test_file_queries_start_no_process_for_a_file(spark, tmp_path):
    """A thousand documents and messages a second at least; equal numbers leave no row out."""
    docs = spark.range(20_000).selectExpr("if(id < 2, 0, id) as doc_id", "'text ' || id as text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id % 50 as turn", "doc_id as conv_id", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    for query in (tables.corpus_files, tables.contract_files):
        started = time.time()
        back = query(spark, str(tmp_path))
        column = "text" if "text" in back.columns else "query"
        assert back.select(column).distinct().count() == 20_000
        assert time.time() - started < 40


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)], "doc_id long, page_no int, text string")
    rows = {r.doc_id: (r.text, r.pages) for r in readers.join_pages(pages).collect()}
    assert rows == {1: ("a\n\nb\n\n", 3), 2: ("", 1)}
    kept = readers.drop_empty(readers.join_pages(pages))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_sections_csv_round_trip(spark, tmp_path):
    rows = [("2//1", "2//1", 'He said "x",\nthen NA\n', 22, 4), ("3", "3", "NA", 2, 9), ("4", "4", "null", 4, 10)]
    df = spark.createDataFrame(
        rows, "section_number string, section_path string, content string, content_length int, line_number int")
    writers.write_sections(df, str(tmp_path / "p"), str(tmp_path / "c"))
    back = readers.read_sections_csv(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == sorted(rows)
    (tmp_path / "bad.csv").write_text("section_number,content\n1,x\n")
    with pytest.raises(ValueError, match="section_path"):
        readers.read_sections_csv(spark, str(tmp_path / "bad.csv"))


def test_embeddings_manifest_and_alignment(spark, tmp_path):
    sections = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "embedding_index long, content string")
    embedded = emb.embed(sections, "content", dimension=32)
    v, s, m = (str(tmp_path / n) for n in "vsm")
    writers.write_embeddings(embedded, v, s, m, processing_time=1.5)
    row = readers.read_manifest(spark, m).first()
    assert (row.model_name, row.embedding_dimension, row.num_embeddings, row.processing_time) == (
        emb.DEFAULT_MODEL, 32, 5, 1.5)
    assert readers.read_manifest(spark, str(tmp_path / "none")).first().model_name == emb.DEFAULT_MODEL
    joined = readers.read_embedded_sections(spark, s, v)
    assert joined.count() == 5 and "embedding" in joined.columns
    spark.read.parquet(v).filter("embedding_index < 3").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="2 rows without a vector, 0 vectors"):
        readers.read_embedded_sections(spark, s, str(tmp_path / "short"))
    stats = emb.throughput(embedded, 2.0).first()
    assert (stats.texts, stats.texts_per_second) == (5, 2.5)


def test_collection_lifecycle(spark, tmp_path):
    path = str(tmp_path / "collection")
    with pytest.raises(FileNotFoundError, match="build it first"):
        readers.open_collection(spark, path)
    docs = spark.createDataFrame([(1, "Shari'ah Standard No. (1)\n2//1 First\n2//2 Second")], "doc_id long, text string")
    built = jobs.build_collection(jobs.build_sections(docs), dimension=16)
    assert writers.create_collection(built, path) is True
    assert writers.create_collection(built.limit(0), path) is False
    bare = tmp_path / "bare"
    bare.mkdir()
    assert writers.create_collection(built, str(bare)) is True
    assert readers.open_collection(spark, str(bare)).count() == 2
    assert readers.open_collection(spark, path).count() == 2
    writers.replace_collection(built.filter("embedding_index = 0"), path)
    assert readers.open_collection(spark, path).count() == 1
    out = jobs.publish_corpus(spark, docs, str(tmp_path / "corpus"), dimension=16)
    assert [r.document for r in out.orderBy("embedding_index").collect()] == ["First", "Second"]


def test_cases_and_results(spark, tmp_path):
    assert readers.read_test_cases(spark).count() == 8
    assert readers.read_test_cases(spark, str(tmp_path / "absent.json")).count() == 8
    cases = [{"query": "a", "expected_sections": ["1"]}, {"query": "b", "category": "rules"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    rows = {r.query: r for r in readers.read_test_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert rows["a"].category == "unknown" and rows["b"].expected_sections == []
    frame = spark.createDataFrame([(1, [1.0])], "case_id long, m array<double>")
    writers.write_evaluation(frame, frame, str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval" / "report")).count() == 1


def test_history_file(spark, tmp_path):
    meta = {"standards_found": 1, "standards": ["é//1"], "query_type": None}
    turns = spark.createDataFrame(
        [("s", i, f"t{i}", f"q{i}", "é", meta if i % 2 else None) for i in range(12)],
        "session_id string, turn_no long, timestamp string, query string, response string, "
        "metadata struct<standards_found:int,standards:array<string>,query_type:string>")
    writers.write_history(turns, str(tmp_path / "h"), saved_at="now")
    saved = json.loads(next((tmp_path / "h").glob("part-*.json")).read_text(encoding="utf-8"))
    assert saved["session_id"] == "s" and len(saved["conversation_history"]) == 10
    back = readers.read_history(spark, str(tmp_path / "h")).orderBy("turn_no").collect()
    assert [r.query for r in back] == [f"q{i}" for i in range(2, 12)]
    assert back[1].metadata.standards == ["é//1"] and back[0].metadata is None


def test_manifest_csv(spark, tmp_path):
    docs = spark.createDataFrame([("/a/b.c.txt", 3), ("plain", 1)], "path string, pages int")
    writers.write_manifest_csv(docs, str(tmp_path / "m"))
    rows = sorted(map(tuple, spark.read.csv(str(tmp_path / "m"), header=True).collect()))
    assert rows == [("b.c.txt", "b.c", "/a/b.c.txt", "3"), ("plain", "plain", "plain", "1")]


def test_pluggable_encoder_and_prefix(spark):
    def lengths_encoder():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id long, t string")
    rows = {r.id: r for r in emb.embed(df, "t", "other", lengths_encoder).collect()}
    assert rows[1].embedding == pytest.approx([3 / 10**0.5, 1 / 10**0.5, 0.0], abs=1e-6)
    assert rows[2].embedding == pytest.approx([0, 1, 0]) and rows[1].t == "abc"
    raw = emb.encode_with(df, "t", lengths_encoder, normalize=False, batch_size=2).filter("id = 1").first()
    assert raw.embedding == [3.0, 1.0, 0.0]
    prefixed = df.select(emb.with_instruction(F.col("t"), "x-BGE-y").alias("p")).first().p
    assert prefixed == f"{emb.INSTRUCTION} abc"
    hashed = emb.encode_hashed(df, "t", 8).filter("id = 2").first()
    assert hashed.embedding == [0.0] * 8


def test_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "doc_id long, line long").repartition(6)
    rows = emb.with_embedding_index(df, "doc_id", "line").collect()
    want = {pair: i for i, pair in enumerate(sorted((i % 7, i) for i in range(500)))}
    assert {(r.doc_id, r.line): r.embedding_index for r in rows} == want


def test_stream_deduplication_is_streaming(spark, tmp_path):
    calls = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:05")], "key string, t string")
    calls.withColumn("ts", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, t string, ts timestamp").parquet(str(tmp_path / "in"))
    query = (stream_first_calls(stream).writeStream.format("memory").queryName("first")
             .option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("first").count() == 1


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        text = "".join(rng.choices(["word ", '"', "\n", ",", "é", "\r", '""\n"', " "], k=rng.randrange(30)))
        if i in (50, 51):
            text = "\n" * 900 + "x"  # longer than a range
        rows.append((f"n{i}", f"p{i}", text, len(text), i))
    path = tmp_path / "sections.csv"
    with open(path, "w", newline="") as file:
        out = csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator="\n")
        out.writerow(["section_number", "section_path", "content", "content_length", "line_number"])
        out.writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    records = quoted_csv.read_records(spark, str(path))
    starts = records.select("start").distinct().count()
    got = {tuple(r) for r in readers.read_sections_csv(spark, str(path)).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert starts > 10
    assert got == set(rows)


def test_packed_corpus_keeps_every_character(spark, tmp_path):
    texts = ["plain", "", None, "a\x1eb\x1fc\x1dd", "\x1d0\x1d1\x1d2", "line\nbreak\r\n", "é" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "name long, text string").repartition(2)
    writers.write_packed(df, str(tmp_path / "packed"))
    got = {int(r.name): r.text for r in readers.read_packed(spark, str(tmp_path / "packed")).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_documents_that_share_an_id_are_numbered_by_order(spark):
    rows = [(i % 3, i, i, f"c{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, line_number int, content_length int, content string").repartition(4)
    numbered = emb.number_sections(cut_lineage(emb.with_slot(df)))
    want = {c: i for i, (_, _, _, c) in enumerate(sorted(rows))}
    assert {r.content: r.embedding_index for r in numbered.collect()} == want


def test_numbering_moves_counts_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Shari'ah Standard No. ({i})\n2//1 A{i}\n2//2 B\ntext") for i in range(40)], "doc_id long, text string")
    writers.write_sections(emb.with_slot(jobs.build_sections(docs.repartition(3))), str(tmp_path / "s"))
    sections = spark.read.parquet(str(tmp_path / "s"))
    numbered = emb.number_sections(sections)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    ranked = sorted((r.doc_id, r.line_number, r.embedding_index) for r in numbered.collect())
    assert [r[2] for r in ranked] == list(range(80))
    starts = emb.document_starts(sections).orderBy("doc_id").collect()
    assert [r.start for r in starts] == [2 * i for i in range(40)]


def test_split_csv_is_written_by_every_task(spark, tmp_path, monkeypatch):
    from scrivano.workloads import tables

    rows = [(i, f"text {i} of many words", "en", "s", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setitem(tables.__dict__, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").repartition(5))
    written, write = [], tables.writers.write_sections
    monkeypatch.setattr(tables.writers, "write_sections", lambda frame, *to: (written.append(frame), write(frame, *to)))
    back = tables.sections_csv_split(spark, str(tmp_path)).collect()
    assert written[0].rdd.getNumPartitions() == 5
    assert sorted(r.content for r in back) == sorted(t.replace(" ", ' "\n') for _, t, *_ in rows)
