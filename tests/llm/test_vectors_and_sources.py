"""Tiled vector dedup, source audit and negative mining against brute force, with every odd row there is."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scrivano.llm import divergence, embedding_dedup, hard_negatives
from scrivano.llm.scratch import Scratch

VECTORS = "vec_id long, label int, embedding array<float>, n long, links string, node int, row int, key int"


def vector_rows(seed=5, count=240, width=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        base = rng.normal(size=width)
        rows.append([i, int(rng.integers(0, 3)), base])
    for i in range(count, count + 60):  # a tight group and chains
        rows.append([i, 1, rows[7][2] + rng.normal(size=width) * 0.06])
    for i in range(count + 60, count + 100):
        rows.append([i, 2, rows[i % 5][2] * rng.uniform(0.5, 3) + rng.normal(size=width) * 0.05])
    rows += [[500 + i, 1, rows[7][2]] for i in range(25)]  # copies
    rows = [(i, label, [float(np.float32(x)) for x in v], 1, "x", 1, 2, 3) for i, label, v in rows]
    odd = [
        (600, 1, None), (601, None, [1.0] * width), (602, 1, [0.0] * width), (603, 1, [1.0, None] + [0.0] * (width - 2)),
        (604, 1, [float("nan")] * width), (605, 1, [float("inf")] + [0.0] * (width - 1)), (606, 1, []), (607, 1, [1.0, 1.0]),
        (608, 1, [2.0, 2.0]), (None, 1, rows[7][2]), (None, 0, [50.0] + [0.0] * (width - 1)), (3, rows[3][1], rows[3][2]),
        (700, 2, rows[4][2]), (700, 2, rows[4][2]), (609, 1, [-0.0, 1.0] + [0.0] * (width - 2)), (610, 1, [0.0, 1.0] + [-0.0] * (width - 2)),
    ]
    return rows + [(i, label, v, None, None, None, None, None) for i, label, v in odd]


def sound(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(x != 0 for x in v))


def brute_components(rows, threshold=0.98):
    n = len(rows)
    links = [set() for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        a, b = rows[i], rows[j]
        if a[1] is None or a[1] != b[1] or not sound(a[2]) or not sound(b[2]) or len(a[2]) != len(b[2]):
            continue
        x, y = np.array(a[2]), np.array(b[2])
        if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
            links[i].add(j)
            links[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return Counter(out)


@pytest.mark.parametrize("home,guests", [(1024, 2048), (16, 24)])
def test_embedding_dedup_equals_brute_force(spark, home, guests):
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = embedding_dedup.dedup(table, Scratch(spark), home=home, guests=guests)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, found.collect())) == brute_components(rows)


def test_embedding_dedup_hot_copies_and_empty(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOT", 10)
    rows = vector_rows()
    found = embedding_dedup.dedup(spark.createDataFrame(rows, VECTORS), Scratch(spark), home=64, guests=64)
    assert Counter(map(tuple, found.collect())) == brute_components(rows)
    assert embedding_dedup.dedup(spark.createDataFrame([], VECTORS), Scratch(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, [1.0], 0, "", 0, 0, 0), (None, 1, None, 0, "", 0, 0, 0)], VECTORS)
    got = {tuple(r) for r in embedding_dedup.dedup(nothing, Scratch(spark)).collect()}
    assert got == {(1, 0, 1, True), (None, 0, None, True)}


def test_leaves_hold_every_pair_once():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    cuts = embedding_dedup.learn_cuts(points, 5)
    row, leaf, home = embedding_dedup.leaves(points, cuts, 5, 0.4)
    at_home, held = dict(zip(row[home], leaf[home])), defaultdict(set)
    for r, at in zip(row[~home], leaf[~home]):
        held[r].add(at)
    assert len(at_home) == len(points) and len(row) < 16 * len(points)
    for i, j in itertools.combinations(range(len(points)), 2):
        if np.linalg.norm(points[i] - points[j]) <= 0.4 and at_home[i] != at_home[j]:
            assert (at_home[j] in held[i]) != (at_home[i] in held[j])


def test_linked_is_exact_whatever_the_axes():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 40))
    b = np.vstack([a[:30] + rng.normal(size=(30, 40)) * 0.2, rng.normal(size=(20, 40))])
    cosine = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    for axes in (np.eye(40), np.linalg.qr(rng.normal(size=(40, 40)))[0]):
        got = embedding_dedup.linked(a, b, axes, np.ones((60, 50), bool), 0.97)
        assert (got == (cosine >= 0.97)).all() and got.any()


TEXTS = "doc_id long, text string, lang string, source string, n long, term string, total long"


def source_rows():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdeéßĀ", k=rnd.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(160):
        picked = rnd.choices(words, weights=[1 / (j + 1) for j in range(120)], k=rnd.randint(0, 60))
        text = rnd.choice([" ", "-", "1", "\u0000", "\n"]).join(picked)
        rows.append((i, text.upper() if i % 9 == 0 else text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "é", None]), 1, "a", 2))
    rows += [(200, None, "xx", "a", 1, "t", 1), (201, "", "xx", "b", 1, "t", 1), (202, "one two", "xx", "c", None, None, None)]
    rows += [(None, "Éa éa a", "yy", "q", 0, "", 0)] * 3 + [(7, "z " * 5000, "yy", "r", 0, "", 0), (8, "x", "yy", "t", 0, "", 0)]
    return rows


def brute_audit(rows, least=3, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        sources = sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())
        whole = Counter()
        for s in sources:
            whole.update({t: groups[lang, s][t] for t in kept})

        def p(count):
            size = sum(count[t] for t in kept) + v
            return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept}

        ps = {s: p(groups[lang, s]) for s in sources}
        q = p(whole)
        for s in sources:
            pairs = [(-sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -value, rank) for rank, (value, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(-((ps[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and ps[s][t] > q[t]]
            out |= {(lang, s, "term", t, -value, rank) for rank, (value, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("segment,top", [(8192, 200), (7, 3)])
def test_source_audit_equals_brute_force(spark, monkeypatch, segment, top):
    if segment == 7:
        monkeypatch.setattr(divergence, "SOURCES", 2)
        monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rows = source_rows()
    found = divergence.audit(spark.createDataFrame(rows, TEXTS).repartition(4), Scratch(spark), top=top, segment=segment).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute_audit(rows, top=top)


def test_source_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], TEXTS), Scratch(spark)).count() == 0


def test_equal_subtrees_are_one_node_and_large_counts_stay_exact():
    heights, root = divergence.consed(np.array([[5, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 5, 0, 0, 0], [5, 0, 0, 0, 0, 0, 0, 0]]))
    assert [len(nodes) for nodes in heights] == [2, 2, 2] and root[0] == root[2] != root[1]
    huge = np.array([3 * 10**10, 1])
    assert divergence.scaled(huge, np.array([7 * 10**10 + 1, 10])).tolist() == [1 + 10**9 * (3 * 10**10 + 1) // (7 * 10**10 + 1), 1 + 10**9 * 2 // 10]


def brute_negatives(rows, every=10, keep=5, share=80):
    held = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows if label is not None and sound(v, zero=True)]

    def order(pair):
        return -pair[0], pair[1] is None, pair[1] or 0

    out = Counter()
    for a in held:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in held if r is not a and len(r[2]) == len(a[2])]
        for score, name, _ in sorted((s for s in scored if s[2] == a[1]), key=order)[:keep]:
            near = sorted((s for s in scored if s[2] != a[1] and share * score <= 100 * s[0] <= 100 * score), key=order)[:keep]
            out.update((a[0], name, rank, s[1], score, s[0]) for rank, s in enumerate(near, 1))
    return out


@pytest.mark.parametrize("block_rows,pack,zones", [(512, 256, 1024), (16, 4, 3)])
def test_hard_negatives_equal_brute_force(spark, block_rows, pack, zones):
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = hard_negatives.mine(table, Scratch(spark), every=10, block_rows=block_rows, pack=pack, zones=zones).collect()
    assert Counter(map(tuple, found)) == brute_negatives(rows) and len(found) > 100


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), Scratch(spark)).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0, 2.0], 1, "", 1, 1, 1)], VECTORS)
    assert hard_negatives.mine(one, Scratch(spark)).count() == 0


def test_curve_visits_every_cell_by_single_steps():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = hard_negatives.curve_place(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_bounds_hold_and_skip_blocks():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 16))
    rows = [c + rng.integers(-10, 10, (30, 16)) for c in centres]
    anchors = centres[:5] + 3
    low, high = np.stack([r.min(0) for r in rows]), np.stack([r.max(0) for r in rows])
    least, most = hard_negatives.bounds(anchors, low, high)
    for b, block in enumerate(rows):
        scores = anchors @ block.T
        assert (least[:, b] <= scores.min(1)).all() and (scores.max(1) <= most[:, b]).all()
    own = [np.sort(anchors[i] @ rows[i].T)[-5] for i in range(5)]
    assert (most >= np.array(own)[:, None]).mean() < 0.3


def test_divergence_sends_each_term_of_a_task_once():
    random.seed(4)
    words = ["".join(random.choices("abcDEFé", k=12)) for _ in range(300_000)]
    texts = [" ".join(words[i::30]) + ", 12 Ab\tAB" for i in range(30)] * 2 + ["", "7 @[`{", "Z"]
    langs, sources = ["x", "y"] * 31 + ["x"], ["", "s", "t"] * 21
    columns = [pa.array(c, pa.string()) for c in (langs, sources, texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])
    rows = pa.Table.from_batches(divergence._counted(iter([batch.slice(0, 20), batch.slice(20)]))).to_pylist()
    n, docs = Counter(), Counter()
    for lang, source, text in zip(langs, sources, texts):
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in text))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, source, t) for t in set(terms))
    key = [(r["lang"], r["source"], r["term"]) for r in rows]
    assert len(set(key)) == len(key)
    assert {k: (r["n"], r["docs"]) for k, r in zip(key, rows)} == {k: (n[k], docs[k]) for k in n}
