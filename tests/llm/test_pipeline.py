"""Every stage of the corpus pipeline on its own input, against brute force and planted rows."""

import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from scrivano.llm import jaccard_join, token_files

random.seed(12)
WORDS = ["".join(random.choices("abcdefghijklm", k=random.randint(3, 7))) for _ in range(600)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


def junk(n):
    return " ".join(random.choices(["click", "here", "$$$", "win", "!!!"], k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts, junk, near copies, exact copies, a benchmark passage, no text at all."""
    at = str(tmp_path_factory.mktemp("sf"))
    items = [prose(30) for _ in range(3)]
    rows, labels = [], []
    for i in range(240):
        rows.append((i, junk(50) if i % 4 == 0 else prose(60)))
        labels.append((i, int(i % 4 != 0), 0))
    good = [r for r in rows if r[0] % 4]
    for i in range(300, 330):
        words = good[i % 5][1].split(" ")
        if i % 2:
            words[random.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, prose(50) + " " + items[i % 3] + " " + prose(40)) for i in range(6)]
    rows += [(500, None), (501, ""), (None, prose(70))]
    docs = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_one_after_another(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs, outputs = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        made = stage(spark, docs, folder)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outputs[name] = docs.collect()
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    kept = {r.doc_id for r in outputs["quality_classifier"]}
    labelled = range(240)
    assert sum((i in kept) == (i % 4 != 0) for i in labelled) >= 236
    assert set(range(400, 406)) <= kept

    name = "ngram_jaccard_join"
    rows, left = inputs[name], Counter(outputs[name])
    assert not left - Counter(rows)
    sets = [shingles(r.text) for r in rows]
    groups = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = groups[i], groups[j]
                groups = [new if g == old else g for g in groups]
    stays = Counter()
    for g in set(groups):
        members = [r for r, own in zip(rows, groups) if own == g]
        stays[min(members, key=lambda r: (r.doc_id is None, r.doc_id or 0))] += 1
    assert left == stays

    name = "benchmark_decontamination"
    gone = {r.doc_id for r in inputs[name]} - {r.doc_id for r in outputs[name]}
    assert gone == set(range(400, 406)) & {r.doc_id for r in inputs[name]} and len(gone) == 6

    name = "mixing_sources"
    have, size = Counter(inputs[name]), Counter()
    taken = Counter(outputs[name])
    assert set(taken) <= set(have) and all(n <= 2 * have[r] for r, n in taken.items())
    for r in inputs[name]:
        size[r.source] += len((r.text or "").split())
    target = dict.fromkeys(size, 0.0)
    weights = dict(zip(sorted(size), (5, 2, 1)))
    room, open_ = 1.5 * sum(size.values()), set(size)
    while open_:
        share = {s: room * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * size[s]
        room, open_ = room - sum(target[s] for s in full), open_ - full
    for s in size:
        words = sum(len((r.text or "").split()) * n for r, n in taken.items() if r.source == s)
        assert abs(words - target[s]) <= 150

    name = "token_files"
    tokenizer = token_files.WordEncoder(token_files.tokenizer_path()).tokenizer
    want, start = Counter(), 0
    digests = sorted(outputs[name], key=lambda r: r.start)
    for r in inputs[name]:
        want[r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1] += 1
    assert Counter((r.doc_id, r.n_tokens) for r in digests) == want
    for r in digests:
        assert r.start == start
        start += r.n_tokens


def test_an_empty_corpus_runs_through(spark, folder, tmp_path):
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_bound_what_a_task_holds_of_texts(spark, folder):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 90, 1, 1).selectExpr("repeat('word ', 50000 + int(id)) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(limit)
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        found = [r["size"] for r in texts.mapInArrow(sizes, "size long").collect()]
        assert max(found) < 6_000_000 and sum(found) > 20_000_000
    spark.conf.set(limit, "1m")
    corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert spark.conf.get(limit) == "1m"  # a limit the session names stays
    spark.conf.unset(limit)


def test_often_found_shingles_are_counted_over_batches(spark):
    rows = spark.range(0, 500, 1, 1).selectExpr("id as doc_id", "concat('a b c d e ', id) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        often = jaccard_join._survey(rows).filter("often is not null").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    assert [r["n"] for r in often] == [500]
