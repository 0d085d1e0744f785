"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector; a word's vector is the sum of the index vectors of its
neighbours (two on each side) over all documents, plus its own. Words hash into ``BUCKETS`` rows, so
the vectors have a fixed size whatever the corpus. A document is the mean and spread of its word
vectors with a few pooled similarities. The network is trained with numpy on at most
``max_labels`` labelled documents; a temperature fitted on a part left out calibrates its scores.

A null or empty text, or one of white space, is a document without words and scored from zero vectors.
Repeated rows score alike. Without any labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.scratch import unused
from scrivano.llm.sums import matrix_sum
from scrivano.llm.words import give_back, mix, text_chunks, word_bounds, word_hashes

BUCKETS = 1 << 15
WIDTH = 32
NONZERO = 4
MAX_LABELS = 20_000
HIDDEN = 32
THRESHOLD = 0.3


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS + 1, WIDTH), np.float32)
    places = rng.random((BUCKETS, WIDTH)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out[:BUCKETS], places, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), axis=1)
    return out  # the last row stands between documents


def buckets_of(data, offsets):
    starts, ends, first = word_bounds(data, offsets)
    return (word_hashes(data, starts, ends, fold=False) & np.uint64(BUCKETS - 1)).astype(np.uint16), first


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Vectors of all word buckets, learned from every document."""
    made: list[np.ndarray] = []  # drawn anew by each task

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        if not made:
            made.append(index_vectors())
        index = made[0]
        for _, data, offsets in text_chunks(batch.column(0)):
            words, first = buckets_of(data, offsets)
            if not len(words):
                continue
            padded = np.full(len(words) + 2 * len(first), BUCKETS, np.uint16)
            place = np.arange(len(words)) + 2 * np.repeat(np.arange(1, len(first)), np.diff(first))
            padded[place] = words
            near = index[padded]
            context = np.zeros_like(near)
            for step in (1, 2):
                context[step:] += near[:-step]
                context[:-step] += near[step:]
            order = np.argsort(padded, kind="stable")
            ordered = padded[order]
            heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            sums = np.add.reduceat(context[order], heads, axis=0)
            held = ordered[heads]
            total[held[held < BUCKETS]] += sums[held < BUCKETS]

    context, index = matrix_sum(texts, BUCKETS, WIDTH, add), index_vectors()
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = np.zeros((BUCKETS + 1, WIDTH), np.float32)
    vectors[:BUCKETS] = context / np.maximum(length, 1e-9) + index[:BUCKETS] / NONZERO**0.5
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float16)


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of every text of the column."""
    vectors = vectors.astype(np.float32)
    out = np.zeros((len(column), 2 * WIDTH + 6), np.float32)
    for at, data, offsets in text_chunks(column):
        words, first = buckets_of(data, offsets)
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        heads, n = first[full], counts[full, None].astype(np.float32)
        each = vectors[words]
        mean = np.add.reduceat(each, heads, axis=0) / n
        square = np.add.reduceat(each * each, heads, axis=0) / n
        alike = np.zeros((len(words), 3), np.float32)
        for k, step in enumerate((1, 2)):
            alike[step:, k] = np.einsum("ij,ij->i", each[step:], each[:-step])
            for gap in range(step):
                alike[np.minimum(heads + gap, len(words) - 1), k] = 0
        alike[1:, 2] = words[1:] == words[:-1]
        alike[heads, 2] = 0
        close = np.add.reduceat(alike, heads, axis=0) / n
        bytes_each = np.diff(offsets)[full, None] / n
        out[at + full] = np.hstack([
            mean, np.sqrt(np.maximum(square - mean * mean, 0)), close,
            np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(n), np.log1p(bytes_each),
        ])
    return out


class Network:
    """Two layers, Adam, logistic loss; then a temperature for the logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 40) -> None:
        rng = np.random.default_rng(seed)
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.middle) / self.scale, -8, 8)
        fit = rng.random(len(z)) < 0.85
        fit[:1] = True
        n = z.shape[1]
        self.w = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        zf, yf, step = z[fit], y[fit], 0
        for _ in range(epochs):
            order = rng.permutation(len(zf))
            for lo in range(0, len(order), 256):
                pick, step = order[lo : lo + 256], step + 1
                a = zf[pick]
                h = np.tanh(a @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - yf[pick]) / len(pick)
                back = np.outer(error, self.w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)]
                for w, m, g in zip(self.w, moments, grads):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= 3e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        held = ~fit if (~fit).sum() >= 50 else fit
        logit, target = self._logit(z[held]), y[held]
        losses = {t: np.logaddexp(0, np.where(target > 0.5, -logit, logit) / t).mean() for t in np.geomspace(0.3, 6, 40)}
        self.temperature = min(losses, key=losses.get)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -8, 8)
        return 1 / (1 + np.exp(np.clip(-self._logit(z) / self.temperature, -60, 60)))


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: Broadcast, max_labels: int = MAX_LABELS) -> Network | None:
    """Learn from labelled rows that are not held out: at most ``max_labels``, in hash order."""
    rows = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_label_id")).agg(F.avg("quality").alias("_quality"))
        .orderBy(F.xxhash64("_label_id")).limit(max_labels)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_quality"), batch.column("_place"), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["y", "place", "x"],
            )
        give_back()

    joined = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_label_id"))
    placed = joined.select("_quality", F.xxhash64("text", "_label_id").alias("_place"), "text")
    # An id may have several texts; those of the first hashes are taken, so reruns agree and the bound holds.
    # Only pooled features come together, not texts.
    pooled = placed.mapInArrow(run, "y double, place long, x binary")
    found = pooled.orderBy("place", "y").limit(4 * max_labels).collect()
    if not found:
        return None
    found.sort()
    y = np.array([r["y"] for r in found])
    return Network(np.stack([np.frombuffer(r["x"], np.float32) for r in found]).astype(np.float64), y)


def score(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, carry: bool = False) -> DataFrame:
    """Score of every document in ``score``, the last column; ``carry`` keeps all columns, else ``doc_id`` alone.

    Where a carried column has that name, the score's ends in underscores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs.select("text")))  # of fixed size
    network = train(docs, labels, shared, max_labels)
    names = docs.columns if carry else ["doc_id"]
    taken = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            if network is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = network.score(features(batch.column("_text"), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(scores, pa.float64())],
                names=[f"c{i}" for i in range(len(names))] + ["score"],
            )
        give_back()

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    scored = taken.mapInArrow(run, f"{kinds}, score double")
    clash = unused(names, "score")[0]
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("score").alias(clash))
