"""Operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivano.llm import (
    ann,
    components,
    decontamination,
    html_text,
    jaccard_join,
    line_dedup,
    mixing,
    quality,
    sharding,
    substring_dedup,
    suffix_array,
    token_files,
)
from scrivano.llm.scratch import Scratch

random.seed(4)
WORDS = ["".join(random.choices("abcdefghij", k=random.randint(2, 6))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


def table():
    base = [prose(random.randint(20, 80)) for _ in range(30)]
    rows = [(i, t, "en", "s%d" % (i % 4), len(t)) for i, t in enumerate(base)]
    for i in range(30, 60):  # near copies
        words = base[i % 7].split(" ")
        words[random.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s0", 1))
    rows += [(60 + i, base[3], None, None, None) for i in range(12)]
    rows += [(80, None, "en", "s1", 0), (81, "", "en", "s1", 0), (82, " \n ", "en", None, 3), (83, "One two", "en", "s2", 7),
             (84, "one TWO", "en", "s2", 7), (None, base[5], "en", "s3", 9), (85, prose(6000), "en", "s0", 1), (3, base[3], "en", "s3", 1)]
    return rows


ROWS = table()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked_groups():
    sets = [shingles(r[1]) for r in ROWS]
    root, links = list(range(len(ROWS))), [0] * len(ROWS)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(ROWS))], links


@pytest.mark.parametrize("block", [1 << 21, 150])
def test_jaccard_join_equals_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "MIN_OFTEN", 2)
    sets, roots, links = linked_groups()
    least = {}
    for r, root in zip(ROWS, roots):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    expected = Counter(
        (r[0], len(s), least.get(root), n) for r, s, root, n in zip(ROWS, sets, roots, links)
    )
    found = jaccard_join.link_classes(docs, Scratch(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found) == expected


def test_one_document_of_each_component_stays(spark, docs):
    sets, roots, _ = linked_groups()
    kept = jaccard_join.one_per_component(docs, Scratch(spark))
    assert kept.columns == docs.columns
    rows = [r.doc_id for r in kept.collect()]
    assert len(rows) == len({root for s, root in zip(sets, roots) if s}) + sum(not s for s in sets)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    root = {r.node: r.root for r in found.collect()}
    assert all(root[i] == 0 for i in range(1, 51)) and all(root[i] == 100 for i in range(101, 140))


def test_suffix_array_orders_all_suffixes():
    for n in range(1, 60):
        text = [random.randint(1, random.choice([1, 2, 4])) for _ in range(n)] + [0]
        order = suffix_array.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_arrays_of_many_texts_equal_those_of_each():
    for _ in range(60):
        texts = [[random.randint(1, random.choice([1, 2, 9])) for _ in range(random.randint(0, 80))] + [0] for _ in range(random.randint(1, 6))]
        texts.sort(key=len, reverse=True)
        end = np.cumsum([len(t) for t in texts]) + 1
        begin = end - [len(t) for t in texts]
        order = suffix_array.suffix_arrays(np.concatenate([[0], *texts]), begin, end)
        assert [(order[b:e] - b).tolist() for b, e in zip(begin, end)] == [suffix_array.suffix_array(t) for t in texts]


@pytest.mark.parametrize("few", [0, 1 << 60])
def test_repeated_starts_equal_counts_of_strings(few, monkeypatch):
    monkeypatch.setattr(suffix_array, "FEW", few)
    groups = [[bytes(random.choices(b"ab", k=random.randint(0, 60))) for _ in range(random.randint(1, 4))] for _ in range(30)]
    for texts, found in zip(groups, suffix_array.repeated_starts(groups, 7)):
        seen = Counter(t[i : i + 7] for t in texts for i in range(len(t) - 6))
        assert [f.tolist() for f in found] == [[seen[t[i : i + 7]] > 1 for i in range(len(t) - 6)] for t in texts]


def test_a_large_group_alone_is_not_sorted_in_lists(monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 30_000).astype(np.uint8)
    text[20_000:20_500] = text[300:800]
    held = suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda t: held(t) if len(t) < 20_000 else pytest.fail("lists"))
    (found,), = suffix_array.repeated_starts([[text.tobytes()]], 200)
    seen = Counter(text[i : i + 200].tobytes() for i in range(len(text) - 199))
    assert found.tolist() == [seen[text[i : i + 200].tobytes()] > 1 for i in range(len(text) - 199)] and found.sum() >= 602


@pytest.mark.parametrize("limit", [1, 1000, 1 << 30])
def test_groups_are_sorted_whole_wherever_batches_end(limit, monkeypatch):
    class Groups:
        repartition = sortWithinPartitions = lambda self, *names: self

        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(6)
    base = [bytes(rng.choices(b"abcd", k=90)) for _ in range(3)]
    rows = []
    for anchor in range(12):
        for _ in range(rng.randint(1, 6)):
            context = rng.choice(base)[rng.randint(0, 30) :] + bytes(rng.choices(b"abcd", k=9)) + rng.choice(base)[: rng.randint(0, 90)]
            rows.append((anchor, rng.choice([1, 1, 2]), len(rows), rng.randint(0, 50), context))
    monkeypatch.setattr(substring_dedup, "SORTED_BYTES", limit)
    monkeypatch.setattr(substring_dedup, "give_back", lambda: None)
    table = pa.table(dict(zip(("anchor", "n", "uid", "first", "context"), zip(*rows))))
    found = pa.Table.from_batches(list(substring_dedup._sorted_groups(Groups(), 40)(table.to_batches(max_chunksize=4)))).to_pylist()
    expected = Counter()
    for anchor in range(12):
        seen = Counter()
        for _, n, _, _, text in (r for r in rows if r[0] == anchor):
            seen.update({k: n * c for k, c in Counter(text[i : i + 40] for i in range(len(text) - 39)).items()})
        for _, n, uid, first, text in (r for r in rows if r[0] == anchor and r[1] == 1):
            gone = {first + i + k for i in range(len(text) - 39) if seen[text[i : i + 40]] > 1 for k in range(40)}
            expected.update({(uid, at): 1 for at in gone})
    assert set(expected) == {(r["uid"], at) for r in found for at in range(r["a"], r["b"])} and len(expected) > 300


@pytest.mark.parametrize("group", [3000, 3, 1])
def test_substring_removal_equals_brute_force(spark, docs, group):
    length = 200
    data = [(r[1] or "").encode() for r in ROWS]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    expected = Counter()
    for r, d in zip(ROWS, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        expected[(r[0], len(d), len(d) - len(kept), spans, kept)] += 1
    found = substring_dedup.remove_repeats(docs, Scratch(spark), group=group).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in found) == expected


def test_mixing_meets_targets(spark, docs):
    rows = mixing.mix(docs, Scratch(spark)).collect()
    assert len(rows) == len(ROWS)
    taken = Counter()
    for r, row in zip(sorted(rows, key=lambda r: str(r.doc_id)), range(len(rows))):
        taken[r.source_size, r.target] += r.taken
    for (size, target), words in taken.items():  # within the words of one more copy of the largest document
        assert abs(words - target) <= max((r.size for r in rows if (r.source_size, r.target) == (size, target)), default=0)
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    again = mixing.mix(docs.repartition(2), Scratch(spark)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    copies = mixing.mixed_documents(docs, Scratch(spark))
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.copies for r in rows)


def test_shards_are_even_and_slots_gapless(spark, docs):
    rows = sharding.shard(docs, Scratch(spark)).collect()
    by_shard = Counter(r.shard for r in rows)
    assert len(rows) == len(ROWS) and max(by_shard.values()) - min(by_shard.values()) <= 1
    for shard, n in by_shard.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    sums = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == sums


def test_communication_matrix_has_exact_margins():
    counts = [5, 0, 17, 1000, 3]
    matrix = sharding.communication_matrix(counts, 8, 3)
    assert [sum(r) for r in matrix] == counts
    columns = [sum(c) for c in zip(*matrix)]
    assert max(columns) - min(columns) <= 1


@pytest.mark.parametrize("n", [1, 63, 65, 5000, 70_001])
def test_blocks_of_ids_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_408).astype(np.int64)
    assert (token_files.decode_block(token_files.encode_block(ids), n) == ids).all()


def test_a_changed_byte_is_noticed():
    data = bytearray(token_files.pack([1, None], np.array([3, 2]), np.array([7, 8, 2, 9, 2])))
    names, lengths, ids = token_files.unpack(bytes(data))
    assert names == [1, None] and lengths.tolist() == [3, 2] and ids.tolist() == [7, 8, 2, 9, 2]
    data[-3] ^= 255
    data[-9] ^= 255
    with pytest.raises(ValueError):
        token_files.unpack(bytes(data))


def test_token_files_hold_the_tokenizers_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    rows = token_files.document_digests(docs, Scratch(spark), str(tmp_path / "ids")).collect()
    expected = Counter()
    for r in ROWS:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        expected[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.append(0, np.cumsum([r.n_tokens for r in ordered])[:-1]).tolist()
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r[0] for r in ROWS if r[0] is not None)


def test_words_with_marks_and_scripts_encode_like_whole_texts():
    encoder = token_files.WordEncoder(token_files.tokenizer_path())
    texts = ["It's 3.5% Été!! don't re-do 'll \tx y 你好 á İI ﬁn??? (a)b", "", "  \n\n "]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [w.ids for w in whole]


def test_letters_that_grow_in_lower_case_encode_like_whole_texts():
    rnd = random.Random(3)
    encoder = token_files.WordEncoder(token_files.tokenizer_path())
    letters = "abcİIıßÉÀÇŞĞÖÜΑΣςЖЁקあ가ﬁ"
    texts = ["DENİZCİ. x", "REHBERİ: TEKİ, iki", "İ", "İ.", "aİ-"]
    for _ in range(3000):
        words = ["".join(rnd.choices(letters, k=rnd.randint(1, 5))) + "".join(rnd.choices(".,;:!?-/'\u0307", k=rnd.randint(0, 2))) for _ in range(3)]
        texts.append(" ".join(words))
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids, whole in zip(texts, encoder.encode(texts), want):
        assert np.frombuffer(ids, "<u2").tolist() == whole.ids, text


def test_columns_with_clashing_names_stay(spark):
    item = prose(30)
    names = ["_row", "_doc", "_removed", "_id", "_hash", "_text_hash", "_leaked", "score", "_score", "n_lines", "n_removed",
             "row_number", "leaked", "LEAKED_HASH", "own_hash", "other_id", "removed_lines", "other_row"]
    texts = [prose(30), prose(30), "a line\na line", prose(40) + " " + item, None]
    rows = [(i % 3, t, "en", "s", 1, *range(i, i + len(names))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in names))
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    kept = decontamination.clean_documents(docs, benchmark, Scratch(spark))
    assert kept.columns == docs.columns and sorted(r["_row"] for r in kept.collect()) == [0, 1, 2, 4]
    one = jaccard_join.one_per_component(docs, Scratch(spark))
    assert one.columns == docs.columns and one.count() == 5 and one.filter("_text_hash is null").count() == 0
    lines = line_dedup.dedup_lines(docs, Scratch(spark))
    assert lines.columns == [*docs.columns, "n_lines_", "n_removed_"]
    assert {r["_row"]: r["n_removed_"] for r in lines.collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
    scored = quality.score(docs, labels, carry=True)
    assert scored.columns == [*docs.columns, "score_"] and scored.filter("score_ between 0 and 1").count() == 5


def test_tasks_of_decontamination_need_no_copy_of_the_package(spark):
    """What is broadcast holds plain values only."""
    sent = []
    context = type(spark.sparkContext)
    held = context.broadcast
    try:
        context.broadcast = lambda self, value: sent.append(value) or held(self, value)
        docs = spark.createDataFrame([(1, prose(60))], "doc_id long, text string")
        decontamination.contaminated(docs, spark.createDataFrame([(0, prose(20))], "item_id long, text string")).collect()
    finally:
        context.broadcast = held
    (space, items), = sent
    assert isinstance(space, np.ndarray) and [type(x) for x in items[0]] == [int, str]


def test_benchmark_items_are_found_and_others_are_not(spark, docs):
    items = [prose(30), prose(20) + ". " + prose(6)]
    leaked = prose(70).split(" ") + items[0].upper().split(" ") + prose(40).split(" ")
    words = items[1].split(" ")
    words[4] = "other"  # a paraphrase
    extra = [(200, " ".join(leaked), "en", "s0", 1), (201, prose(30) + " " + " ".join(words), "en", "s0", 1)]
    whole = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    benchmark = spark.createDataFrame([(0, items[0]), (1, items[1]), (2, None), (3, "")], "item_id long, text string")
    found = decontamination.contaminated(whole, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(200, 0), (201, 1)}
    clean = decontamination.clean_documents(whole, benchmark, Scratch(spark))
    assert clean.columns == docs.columns and clean.count() == len(ROWS)


def test_clean_rows_stay_when_another_of_their_id_is_contaminated(spark):
    item = prose(30)
    leaked = prose(40) + " " + item + " " + prose(20)
    rows = [(None, leaked), (None, prose(60)), (None, None), (7, leaked), (7, prose(50)), (7, ""), (8, prose(70))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    clean = decontamination.clean_documents(frame, benchmark, Scratch(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter(r for r in rows if r[1] != leaked)


def test_rows_of_one_id_do_not_share_the_fate_of_their_lines(spark):
    line = prose(30)
    rows = [(None, f"{prose(25)}\n{line}"), (None, f"{prose(25)}\nunlike any other"), (7, line), (7, prose(28)), (7, line),
            (8, prose(20)), (9, None)]
    rows.append(rows[5])
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    gone = Counter((r.doc_id, r.text, r.n_removed) for r in out)
    kept = [(i, t, 0) for i, t in (rows[0], rows[1], rows[3], rows[5], rows[6])]
    assert gone == Counter(kept + [(7, "", 1), (7, "", 1), (8, "", 1)])


def test_lines_that_differ_little_stay_once(spark):
    line = prose(40)
    near = line.replace(line.split(" ")[20], line.split(" ")[20] + "x", 1)
    rows = [(1, f"{line}\nonly here\n\n{prose(8)}"), (2, f"{near}\n{line.upper()}!\nalone"), (3, None), (4, "")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert out[1].text == rows[0][1] and out[1].n_removed == 0
    assert out[2].text.endswith("alone") and line.upper() not in out[2].text and out[2].n_removed >= 1
    assert out[3].text is None and out[4].text == ""


def test_anchors_of_texts_longer_than_the_place_modulus():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 123, 6000).astype(np.uint8)
    data[5000:5400] = data[700:1100]
    hashes, places, first, last = substring_dedup.anchors(data, 200, places=256)
    assert ((places >= first) & (places <= last + 200 - substring_dedup.GRAM)).all()
    for found, whole in zip((hashes, places, first, last), substring_dedup.anchors(data, 200)):
        assert found.tolist() == whole.tolist()
    assert set(hashes[(first >= 700) & (last <= 900)].tolist()) <= set(hashes[first >= 4900].tolist())


def test_near_lines_are_linked_when_hash_and_edits_agree(spark):
    lines = spark.createDataFrame([(1, "\n".join(prose(30) for _ in range(5)))], "doc_id long, text string")
    assert line_dedup.linked_lines(line_dedup._lines(lines), Scratch(spark)).count() == 0


def test_line_links_match_brute_force(spark):
    base = [prose(40) for _ in range(4)]
    texts = []
    for i in range(60):  # groups of near lines, some of them changed beyond the similarity
        words = base[i % 4].split(" ")
        for _ in range(i % 3):
            words[random.randrange(len(words))] = random.choice(WORDS)
        texts.append(" ".join(words + [random.choice(WORDS)] * (i % 7 == 0)))
    lines = line_dedup._lines(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    sims = {r.name: r for r in line_dedup._simhashes(lines).join(lines.select("name", "norm").distinct(), "name").collect()}
    hashed = {}
    for row in spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", F.xxhash64("w").alias("h")).collect():
        hashed[row.w] = row.h
    mask = (1 << 64) - 1
    for r in sims.values():
        words = r.norm.split(" ")
        want = sum(1 << k for k in range(64) if 2 * sum((hashed[w] & mask) >> k & 1 for w in words) > len(words))
        assert r.sim & mask == want

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    names, root = sorted(sims), {n: n for n in sims}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, u in enumerate(names):
        for v in names[i + 1 :]:
            a, b = sims[u], sims[v]
            near = ((a.sim ^ b.sim) & mask).bit_count() <= line_dedup.BITS
            if near and edits(a.norm, b.norm) <= int(max(len(a.norm), len(b.norm)) * 0.2 + 1e-9):
                x, y = sorted((find(u), find(v)))
                root[y] = x
    got = {r.node: r.root for r in line_dedup.linked_lines(lines, Scratch(spark)).collect()}
    assert len(got) > 10 and got == {n: find(n) for n in names if find(n) != n}


def test_lines_of_ordinary_length_are_linked_by_edits_alone(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for n in (1, 2, 3, 5, 8, 10, 14, 20, 30, 40, 60):  # a line and a copy with one word, or a tenth of them, replaced
        for _ in range(12):
            words = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n)]
            changed = list(words)
            for at in rng.sample(range(n), max(1, n // 10)):
                if n < 8:  # one letter
                    changed[at] = changed[at][:-1] + rng.choice(letters)
                else:
                    changed[at] = "".join(rng.choices(letters, k=len(changed[at])))
            texts += [" ".join(words), " ".join(changed)]
    lines = line_dedup._lines(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    names = lines.select("name", "norm").distinct()
    a, b = names.select(F.col("name").alias("u"), F.col("norm").alias("l")), names.select(F.col("name").alias("v"), F.col("norm").alias("r"))
    near = a.crossJoin(b).filter(
        (F.col("u") < F.col("v")) & (F.levenshtein("l", "r") <= F.floor(F.greatest(F.length("l"), F.length("r")) * 0.2 + 1e-9))
    )
    pairs = near.select("u", "v").collect()
    root = {r.node: r.root for r in line_dedup.linked_lines(lines, Scratch(spark)).collect()}
    assert len(pairs) > 110
    assert [(u, v) for u, v in pairs if root.get(u, u) != root.get(v, v)] == []


def test_lines_with_a_run_at_other_places_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    passage = " ".join(word() for _ in range(12))
    rest = [" ".join(word() for _ in range(30)) for _ in range(40)]
    texts = [f"{passage} {r}" if i % 2 else f"{r} {passage}" for i, r in enumerate(rest)]
    texts += [f"{word()} {word()} {texts[0]}", f"{texts[1]} {word()}"]  # two near copies, shifted
    compared, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *more: compared.extend(pairs.collect()) or similar(pairs, *more))
    lines = line_dedup._lines(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    names = {r.norm: r.name for r in lines.select("name", "norm").collect()}
    at_start = {names[t] for t in texts if t.startswith(passage)}
    root = {r.node: r.root for r in line_dedup.linked_lines(lines, Scratch(spark)).collect()}
    assert [p for p in compared if (p.u in at_start) != (p.v in at_start)] == []
    assert len(root) == 2
    for one, other in ((texts[0], texts[-2]), (texts[1], texts[-1])):
        assert root.get(names[one], names[one]) == root.get(names[other], names[other])


def test_pairs_of_lines_are_decided_as_by_their_whole_distance(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    rows = [("", "a"), ("a b", "a b"), ("abcd", "abcde"), ("abcd", "abce")]
    rows += [(f"{a} " * 700, f"{b} " * 680 + c) for a, b, c in (("abc", "dde", "abc"), ("abc", "abd", "e"), ("aé", "aa", "b"))]
    for n in (3, 8, 30, 120, 700):  # changed letters, words put in and left out, at rates around the similarity
        for rate in (0.02, 0.1, 0.17, 0.2, 0.23, 0.3, 1):
            for _ in range(4):
                words = [word() for _ in range(n)]
                other = [w for w in words if rng.random() > rate / 4]
                other = [w if rng.random() > rate / 4 else f"{w} {word()}" for w in other]
                text = "".join(c if rng.random() > rate / 2 else rng.choice("abcdeé") for c in " ".join(other))
                ahead = " ".join(word() for _ in range(rng.choice((0, 0, n // 8))))
                rows.append((" ".join(words), " ".join((ahead + " " + text).split())))
    pairs = spark.createDataFrame(rows, "l string, r string").repartition(8)
    longest = F.greatest(F.length("l"), F.length("r"))
    whole = F.levenshtein("l", "r") <= F.floor(longest * (1 - line_dedup.SIMILARITY) + 1e-9)
    ways = [line_dedup._alike(F.col("l"), F.col("r"), likely).alias(f"got{likely:d}") for likely in (False, True)]
    out = pairs.select(whole.alias("want"), *ways).collect()
    assert [r for r in out if r.got0 != r.want or r.got1 != r.want] == [] and 20 < sum(r.want for r in out) < len(out) - 20


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    data = (centers[rng.integers(0, 20, 400)] + 0.3 * rng.normal(size=(400, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, 2.0]), (404, data[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(frame, k=10, vector_block=150, query_block=7).collect()
    valid = np.vstack([data, data[:1]]).astype(float)
    ids = np.append(np.arange(400), 404)
    hit = 0
    for q in range(0, 400, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        scores = (valid * valid[q]).sum(axis=1)
        assert all(abs(s - scores[ids == v][0]) < 1e-12 for _, v, s in mine)
        scores[ids == q] = -np.inf
        hit += len({v for _, v, _ in mine} & set(ids[np.lexsort((ids, -scores))[:10]].tolist()))
    assert hit >= 0.9 * 200
    assert ann.search(frame.filter("vec_id >= 400 and vec_id < 403")).count() == 0


def test_classifier_separates_and_keeps_columns(spark):
    rows = [(i, prose(60) if i % 4 else " ".join([random.choice(WORDS)] * 20) * 3) for i in range(600)]
    rows += [(900, None), (901, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)], "doc_id long, quality int")
    scored = quality.score(frame, labels, carry=True).withColumn("held", quality.held_out(F.col("doc_id")))
    found = scored.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held and r.doc_id < 600]
    assert len(held) > 50 and np.mean([(r.score >= 0.3) == (r.doc_id % 4 > 0) for r in held]) > 0.95
    assert {r.score for r in quality.score(frame, labels.limit(0)).collect()} == {0.5}


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>menu</a></nav>
<div class="cookie-notice"><p>We use cookies, all of them, and more, and more.</p></div>
<article><h1>Head &amp; line</h1><p><b>First   para</b>graph, with commas, and words, and more words here.<p>Second
paragraph&nbsp;is, also, long enough to count as text of the page.</p><aside>side</aside>
<section id="comments"><p>A reader, says, something, long, here, indeed.</p></section></article><footer>foot</footer></body></html>"""


def test_main_text_of_pages(spark):
    assert html_text.main_text(PAGE) == (
        "Head & line\nFirst paragraph, with commas, and words, and more words here.\n"
        "Second paragraph is, also, long enough to count as text of the page."
    )
    body = "".join(f"<p>Sentence {i}, with a comma, and quite a few more words in it.</p>" for i in range(4))
    plain = f"<div id=wrap><div class=menu><a href=1>one</a></div><div>{body}</div><div><a href=2>a link, with, commas, inside of it all</a></div></div>"
    assert html_text.main_text(plain).count("\n") == 3
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>cut &am")], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert out[2].text == "" == out[3].text and out[4].n_chars == len(out[4].text)


def test_wrappers_with_listed_names_keep_their_text():
    body = "".join(f"<p>Sentence {i}, with a comma, and quite a few more words in it.</p>" for i in range(4))
    want = html_text.main_text(f"<article>{body}</article>")
    assert want.count("\n") == 3
    menu = "<div class=menu><a href=1>one</a><p>Short, but a menu entry, of some words.</p></div>"
    for name in ("has-sidebar", "no-sidebar", "layout_with_menu", "page-widget-area", "widget"):
        assert html_text.main_text(f'<div class="{name}">{menu}<article>{body}</article></div>') == want
        assert html_text.main_text(f'<div id="{name}">{menu}<div>{body}</div></div>') == want
    assert html_text.main_text(f"<form action=x>{menu}<article>{body}</article></form>") == want
    advert = "<div class=ad>Buy this, and that, and more of it, today, for less than ever before.</div>"
    assert html_text.main_text(f"{advert}<article><h1>A short one</h1><p>Few words.</p></article>") == "A short one\nFew words."
    many = "".join(f"<article><p>Reader {i} says, something, long, here, indeed.</p></article>" for i in range(9))
    comments = f'<div class="comment-list">{many}</div>'
    assert html_text.main_text(f"<article>{body}</article>{comments}") == want
    assert html_text.main_text(f"<div class=has-sidebar><div>{body}</div></div>{comments.replace('article', 'div')}") == want
    assert html_text.main_text(f"<article>{body}{comments}</article>") == want


def test_empty_tables_give_empty_results(spark, empty, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for out in (
        jaccard_join.link_classes(empty, Scratch(spark)), mixing.mix(empty, Scratch(spark)), sharding.shard(empty, Scratch(spark)),
        quality.score(empty, labels), decontamination.contaminated(empty, benchmark), line_dedup.dedup_lines(empty, Scratch(spark)),
        substring_dedup.remove_repeats(empty, Scratch(spark)), token_files.document_digests(empty, Scratch(spark), str(tmp_path / "t")),
        ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0


