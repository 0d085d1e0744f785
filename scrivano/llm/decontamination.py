"""Benchmark decontamination by latent semantic retrieval.

Words (letters and digits, case folded) hash into ``FEATURES`` columns. Passages of ``PASSAGE`` words
of all documents, weighted by inverse passage frequency, form a matrix A whose leading right singular
vectors are found by a distributed randomised SVD: the tasks add up A'A times a random sketch, and
the driver solves the small problem of the sketch's width. The first ``DROPPED`` directions, which
hold language and common words, are left out; the others count alike. Windows of every document, in
the sizes of the benchmark's items, are compared with the items by cosine in that space. Candidates
are checked on the words of the surrounding region: it must hold enough of the item's words at all,
and the longest common subsequence must hold ``SHARE`` of the item, or ``ANSWER_SHARE`` of it where
the item's last sentence, its answer, stands in the region whole.

All sums cover all documents; what reaches the driver has the size of the word space. Items are
searched in blocks of ``ITEM_BLOCK``. Null, empty and wordless texts are clean, and items without words
match nothing; documents shorter than a window are one window. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch, hinted, unused
from scrivano.llm.sums import matrix_sum
from scrivano.llm.words import MARKS, give_back, text_chunks, word_bounds, word_hashes

FEATURES = 1 << 14
PASSAGE = 40
RANK = 48
DROPPED = 12
SPARE = 4
HOT = 256
PASSAGE_BLOCK = 512
SCALES = (8, 16, 32, 64, 128, 256)
COSINE = 0.6
SHARE = 0.8
ANSWER_SHARE = 0.6
ITEM_BLOCK = 1_000


def chunk_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, offsets, MARKS)
    return word_hashes(data, starts, ends), first


def folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.uint16)


def _passage_heads(first: np.ndarray) -> np.ndarray:
    """First word of every passage; passages do not cross documents."""
    counts = np.diff(first)
    pieces = -(-counts // PASSAGE)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(first[:-1], pieces) + within * PASSAGE


def inverse_frequency(texts: DataFrame) -> np.ndarray:
    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, data, offsets in text_chunks(folded(batch.column(0))):
            hashes, first = chunk_words(data, offsets)
            if not len(hashes):
                continue
            heads = _passage_heads(first)
            passage = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(hashes))))
            seen = np.sort((passage * FEATURES + features_of(hashes)).astype(np.uint32))
            seen = seen[np.append(True, seen[1:] != seen[:-1])] & np.uint32(FEATURES - 1)
            total[:FEATURES, 0] += np.bincount(seen, minlength=FEATURES)
            total[FEATURES, 0] += len(heads)

    found = matrix_sum(texts, FEATURES + 1, 1, add)[:, 0]
    return np.log((found[FEATURES] + 1) / (found[:FEATURES] + 1)).astype(np.float32) + np.float32(0.01)


def _sketch(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(FEATURES, width))


def _gram_times_sketch(texts: DataFrame, weights: np.ndarray, seed: int, width: int) -> np.ndarray:
    """A'A times a random sketch, for the matrix A of unit-length passages. Tasks draw the sketch anew.

    Passages are rows of ``PASSAGE`` words, short ones filled up with a feature of weight nought. Their
    images go back to the ``HOT`` most frequent features by a product with counts, to the others word by word.
    """
    made: list[np.ndarray] = []
    hot = np.argsort(weights, kind="stable")[:HOT]
    column = np.full(FEATURES + 1, HOT)
    column[hot] = np.arange(HOT)
    squared = np.append(weights, np.float32(0)) ** 2
    spot = np.arange(PASSAGE)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        if not made:
            made.append(np.zeros((FEATURES + 1, width), np.float32))
            made[0][:FEATURES] = _sketch(seed, width) * weights[:, None]
        weighted = made[0]
        for _, data, offsets in text_chunks(folded(batch.column(0)), 1 << 18):
            hashes, first = chunk_words(data, offsets)
            if not len(hashes):
                continue
            every, sizes = features_of(hashes), np.diff(np.append(_passage_heads(first), len(hashes)))
            heads = np.cumsum(sizes) - sizes
            for lo in range(0, len(heads), PASSAGE_BLOCK):
                size = sizes[lo : lo + PASSAGE_BLOCK, None]
                words = every[np.minimum(heads[lo : lo + PASSAGE_BLOCK, None] + spot, len(every) - 1)].astype(np.intp)
                words[spot >= size] = FEATURES
                images = weighted.take(words, axis=0).sum(axis=1) / squared.take(words).sum(axis=1)[:, None]
                columns = column.take(words)
                cells = columns + np.arange(len(words))[:, None] * (HOT + 1)
                counts = np.bincount(cells.ravel(), minlength=len(words) * (HOT + 1)).reshape(-1, HOT + 1)
                total[hot] += counts[:, :HOT].T.astype(np.float32) @ images
                row, at = np.nonzero((columns == HOT) & (words < FEATURES))
                _add_rows(total, words[row, at], images, row)

    return matrix_sum(texts, FEATURES, width, add) * weights[:, None]


def _add_rows(total: np.ndarray, target: np.ndarray, rows: np.ndarray, source: np.ndarray) -> None:
    """``total[target] += rows[source]`` for repeated targets: one round per repetition, few of them long."""
    order = np.argsort(target.astype(np.uint16), kind="stable")
    target, source = target[order], source[order]
    begin = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.intp)
    often = np.diff(np.append(begin, len(target)))
    begin = begin[np.argsort(-often, kind="stable")]
    left = np.cumsum(np.bincount(often)[::-1])[::-1]  # targets with at least so many sources
    for repeat in range(len(left) - 1):
        now = begin[: left[repeat + 1]] + repeat
        total[target[now]] += rows[source[now]]


def latent_space(texts: DataFrame, weights: np.ndarray, seed: int = 17) -> np.ndarray:
    """Right singular vectors (features, RANK), after the dropped ones."""
    width = RANK + DROPPED + SPARE
    image = _gram_times_sketch(texts, weights, seed, width)
    small = _sketch(seed, width).T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    good = values > max(values.max(), 1e-12) * 1e-10
    if not good.any():
        return np.zeros((FEATURES, RANK))
    left, sizes, _ = np.linalg.svd(image @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    chosen = slice(DROPPED, DROPPED + RANK) if len(sizes) > DROPPED else slice(0, RANK)
    return left[:, chosen] / np.maximum(sizes[chosen], sizes[0] * 1e-6)


class Items:
    """Benchmark items: words, bit masks for subsequences, unit vectors, by window size."""

    def __init__(self, rows: list, space: np.ndarray) -> None:
        self.names, self.words, self.masks, self.answers = [], [], [], []
        vectors = []
        for name, text in rows:
            column = pa.array([text or ""])
            hashes = np.zeros(0, np.uint64)
            for _, data, offsets in text_chunks(folded(column)):
                hashes = chunk_words(data, offsets)[0]
            if not len(hashes):
                continue
            masks: dict[int, int] = {}
            for i, h in enumerate(hashes.tolist()):
                masks[h] = masks.get(h, 0) | (1 << i)
            sentences = [s for s in (text or "").replace("?", ".").replace("\n", ".").split(".") if s.strip()]
            answer = np.zeros(0, np.uint64)
            for _, data, offsets in text_chunks(folded(pa.array([sentences[-1] if sentences else ""]))):
                answer = chunk_words(data, offsets)[0]
            self.names.append(name)
            self.words.append(hashes)
            self.masks.append(masks)
            self.answers.append(answer.tobytes() if 3 <= len(answer) < len(hashes) else None)
            vectors.append(space[features_of(hashes)].sum(axis=0))
        v = np.array(vectors, np.float32).reshape(len(vectors), space.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        sizes = np.array([len(w) for w in self.words], float).reshape(-1)
        nearest = np.abs(np.log(sizes)[:, None] - np.log(SCALES)).argmin(axis=1) if len(sizes) else sizes
        self.by_scale = {s: np.flatnonzero(nearest == i) for i, s in enumerate(SCALES) if (nearest == i).any()}
        self.sizes = sizes
        self.vocabulary = np.unique(np.concatenate(self.words or [np.zeros(0, np.uint64)]))
        # Per item: place of a word among its distinct words (0: none), and how often it has that word.
        widest = max((len(m) for m in self.masks), default=0)
        self.place = np.zeros((len(vectors), len(self.vocabulary) + 1), np.uint8 if widest < 255 else np.uint32)
        self.often = np.zeros((len(vectors), widest + 1), np.float32)
        for i, words in enumerate(self.words):
            distinct, counts = np.unique(words, return_counts=True)
            self.place[i, np.searchsorted(self.vocabulary, distinct)] = np.arange(1, len(distinct) + 1)
            self.often[i, 1 : len(distinct) + 1] = counts

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers in the items' vocabulary; its length for others."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def enough(self, item: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Do the regions (rows of vocabulary numbers) hold as many of the items' words as a match needs?"""
        held = self.place.ravel().take(region + (item * self.place.shape[1])[:, None])
        held.sort(axis=1)
        often = self.often.ravel().take(held + (item * self.often.shape[1])[:, None])
        often[:, 1:][held[:, 1:] == held[:, :-1]] = 0
        return often.sum(axis=1) >= ANSWER_SHARE * self.sizes[item] - 1e-6

    def common(self, item: int, region: list[int]) -> int:
        """Length of the longest common subsequence, bit-parallel."""
        masks, full = self.masks[item], (1 << len(self.words[item])) - 1
        open_bits = full
        for word in region:
            hit = open_bits & masks.get(word, 0)
            if hit:
                open_bits = ((open_bits + hit) | (open_bits - hit)) & full
        return len(self.words[item]) - open_bits.bit_count()


def matches(column: pa.Array, space: np.ndarray, items: Items) -> list[dict]:
    """Per text: benchmark item -> share of its words found in order."""
    out: list[dict] = [{} for _ in range(len(column))]
    for at, data, offsets in text_chunks(folded(column), 1 << 17):
        hashes, first = chunk_words(data, offsets)
        if not len(hashes):
            continue
        sums = _running_sums(space, features_of(hashes))
        counts, numbers = np.diff(first), items.known(hashes)
        shapes = {s: (s, max(2, s // 3), int(items.sizes[chosen].max()) // 2 + 2) for s, chosen in items.by_scale.items()}
        # Documents lie so far apart here that a window with its margins sees words of its own one only.
        gap = max((scale + margin for scale, _, margin in shapes.values()), default=0)
        apart = np.full(len(numbers) + gap * (len(counts) + 1), len(items.vocabulary), np.intp)
        apart[np.arange(len(numbers)) + np.repeat(np.arange(1, len(counts) + 1) * gap, counts)] = numbers
        for scale, stride, margin in shapes.values():
            chosen = items.by_scale[scale]
            pieces = np.where(counts > 0, -(-np.maximum(counts - scale, 0) // stride) + 1, 0)
            doc = np.repeat(np.arange(len(counts)), pieces)
            begin = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stride
            end = np.minimum(begin + scale, first[doc + 1])
            regions = np.lib.stride_tricks.sliding_window_view(apart, scale + 2 * margin)
            for lo in range(0, len(doc), 1 << 15):
                part = slice(lo, lo + (1 << 15))
                window = sums[end[part]] - sums[begin[part]]
                least = COSINE * np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
                near = window @ items.vectors[chosen].T >= least[:, None]
                at_window, which = np.divmod(np.flatnonzero(near), len(chosen))
                for cut in range(0, len(which), 1 << 14):
                    w, i = at_window[cut : cut + (1 << 14)] + lo, chosen[which[cut : cut + (1 << 14)]]
                    passed = items.enough(i, regions[begin[w] + (doc[w] + 1) * gap - margin])
                    for w, i in zip(w[passed].tolist(), i[passed].tolist()):
                        _check(out[at + doc[w]], items, i, hashes, max(begin[w] - margin, first[doc[w]]),
                               min(begin[w] + scale + margin, first[doc[w] + 1]))
    return out


def _running_sums(space: np.ndarray, words: np.ndarray, step: int = 16, block: int = 256) -> np.ndarray:
    """Sums of the words' rows before every word, and before the end: within steps of rows, then over steps."""
    steps = len(words) // step + 1
    sums = np.empty((steps * step, space.shape[1]), np.float32)
    sums[0] = sums[len(words) + 1 :] = 0
    space.take(words, axis=0, out=sums[1 : len(words) + 1], mode="clip")
    parts, before = sums.reshape(steps, step, -1), 0
    for lo in range(0, steps, block):
        some = parts[lo : lo + block]
        for i in range(1, step):
            some[:, i] += some[:, i - 1]
        ends = np.cumsum(some[:, -1], axis=0) + before
        some[1:] += ends[:-1, None]
        some[0] += before
        before = ends[-1]
    return sums


def _check(known: dict, items: Items, i: int, hashes: np.ndarray, begin: int, end: int) -> None:
    """Record the item where the words from ``begin`` to ``end`` hold it."""
    name = items.names[i]
    if known.get(name, 0) >= 1:
        return
    region = hashes[begin:end]
    share = items.common(i, region.tolist()) / len(items.words[i])
    if share >= SHARE or share >= ANSWER_SHARE and items.answers[i] and _holds(region, items.answers[i]):
        known[name] = max(share, known.get(name, 0))


def _holds(region: np.ndarray, answer: bytes) -> bool:
    data, at = region.tobytes(), -1
    while (at := data.find(answer, at + 1)) >= 0:
        if at % 8 == 0:
            return True
    return False


def _item_blocks(benchmark: DataFrame) -> Iterator[list]:
    total = benchmark.count()
    blocks = -(-total // ITEM_BLOCK)
    for b in range(blocks):
        rows = benchmark.select("item_id", "text")
        if blocks > 1:
            rows = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield rows.collect()  # about ITEM_BLOCK rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``share`` for every document that holds a benchmark item."""
    return _found(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same for every row that holds one, with ``text_hash``, the hash of its text."""
    texts = docs.select("text")
    weights = inverse_frequency(texts)
    space = latent_space(texts, weights) * weights[:, None]
    space = (space / max(np.abs(space).max(), 1e-12)).astype(np.float16)
    context = docs.sparkSession.sparkContext
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for rows in _item_blocks(benchmark):
        # The word space and one block of items, as plain values: tasks build what they search with.
        shared = context.broadcast((space, [(r["item_id"], r["text"]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, asked = shared.value
            space = space.astype(np.float32)
            items = Items(asked, space)
            for batch in batches:
                found = matches(batch.column("text"), space, items) if items.names else []
                at = [i for i, known in enumerate(found) for _ in known]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "text_hash")),
                     pa.array([name for known in found for name in known]).cast(item_arrow),
                     pa.array([share for known in found for share in known.values()], pa.float64())],
                    names=["doc_id", "text_hash", "item_id", "share"],
                )
            give_back()

        item_arrow = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        part = rows.mapInArrow(run, f"doc_id {doc_type}, text_hash long, item_id {item_type}, share double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {doc_type}, text_hash long, item_id {item_type}, share double")
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. An id and its text are clean or not."""
    name, code = unused(docs.columns, "leaked", "leaked_hash")
    found = _found(docs, benchmark).select(F.col("doc_id").alias(name), F.col("text_hash").alias(code)).distinct()
    found = hinted(scratch.keep(found, "leaked"))
    leaked = F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(code))
    return docs.join(found, leaked, "left_anti")
