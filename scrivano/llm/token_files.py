"""Token ids in compressed files: adaptive context mixing drives a range coder.

Texts are tokenised in ascending id order and their ids, with an end id per document, are cut into
segments of about ``SEGMENT`` ids. A segment is a row of a Parquet table (``part``, ``segment``,
``data``): so Spark's own writers and readers reach any store. ``data`` is

    magic b"CMR1", counts of documents and ids (u32), then per document its id (i64, with a byte that
    tells null) and length (u32), then blocks of ``BLOCK`` ids.

A block is coded on its own: models start empty, and its count, checksum of ids and payload length
stand before it. An id is four symbols of four bits. Each symbol is predicted by counts in the
contexts of order 0, 1 and 2 (the leading symbols of the id, with no, one or two ids before); the
three are mixed with shares that follow how well each has predicted, and the mixture drives a range
coder of 48 bits. A block is dealt into lanes that share the models and are coded side by side in
numpy, each with a coder of its own.

Null texts are empty and hold only the end id; null ids come first; repeated rows are written each.
An empty table writes an empty table and reads back as one.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch
from scrivano.llm.words import give_back

MAGIC = b"CMR1"
END_ID = 2
BLOCK = 1 << 19
LANES = 1024
SEGMENT = 1 << 20
ROWS = (4369, 1 << 14, 1 << 14)
NODES = (0, 1, 17, 273)
TOKENIZER = "word_bpe_49k.json"
CACHE = 150_000
MARKS = ".,;:!?*#$%&()[]{}+=-/@"
_K = [np.uint32(k) for k in (40_503, 60_013, 977, 0x9E3779B1, 0x85EBCA77, 0x1F123BB5, 0xC2B2AE35)]
_FIRST, _SECOND = np.uint32(18), np.uint32((1 << 14) - 1)
_EACH, _BYTE = np.uint64(0x0101010101010101), np.uint64(56)
_TOP = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_MASK = np.uint64((1 << 48) - 1)
_SHIFT, _TWO = np.uint64(32), np.uint64(16)


class _Model:
    """Counts of the sixteen symbols in the contexts of three orders, and tables mixed from them.

    The tables change between groups of steps only, from the symbols of the group just coded, so that
    coder and decoder work on many lanes at once and still see the same numbers. ``scale`` is the
    share of each order in the mixture; it follows the probability the order gave to what came.
    """

    def __init__(self) -> None:
        self.counts = [np.zeros((rows, 16), np.int32) for rows in ROWS]
        self.table = [np.zeros((rows, 17), np.uint16) for rows in ROWS]
        self.scale = [16_000, 16_000, 32_000]

    def rows(self, depth: int, head: np.ndarray, last: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        """Rows of the tables; all numbers are unsigned and of 32 bits."""
        one = (last * _K[0] + head * _K[1] + _K[2] * np.uint32(depth + 1)) * _K[3]
        two = (one + before * _K[4] + _K[5]) * _K[6]
        return [head + np.uint32(NODES[depth]), one >> _FIRST, (two ^ (two >> _FIRST)) & _SECOND]

    def learn(self, rows: list[np.ndarray], symbols: np.ndarray) -> None:
        """Add a group's symbols, set the shares, mix the tables again."""
        if not len(symbols):
            return
        seen, gain = [], []
        for at, table, scale in zip(rows, self.table, self.scale):
            # Every cell counts how often it was met; the sums over cells are those over symbols.
            seen.append(np.bincount(at * np.uint32(16) + symbols, minlength=16 * len(table)).reshape(-1, 16))
            given = int((seen[-1] * np.diff(table)).sum())
            gain.append(1 + 4096 * given // (len(symbols) * scale))
        whole = sum(g * g for g in gain)
        self.scale = [2_000 + 58_000 * g * g // whole for g in gain]
        for own, counts, table, scale in zip(seen, self.counts, self.table, self.scale):
            counts += own.astype(np.int32)
            sums = np.cumsum(counts, axis=1, dtype=np.int32)
            table[:, 1:] = sums * (scale / (sums[:, 15:] + 1.5))


def _groups(steps: int):
    """Runs of steps between two changes of the tables: short at first."""
    at, size = 0, 1
    while at < steps:
        yield at, min(at + size, steps)
        at += size
        size = min(max(1, at), 128)


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and steps of the last lane, for a block of n ids."""
    steps = max(1, min(BLOCK // LANES, -(-n // 64)), -(-n // LANES))
    lanes = -(-n // steps)
    return lanes, steps, n - (lanes - 1) * steps


def encode_block(ids: np.ndarray) -> bytes:
    """Payload of one block of ids below 65,536: lengths of its lanes, then their bytes."""
    lanes, steps, rest = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    past = np.vstack([np.zeros((2, lanes), np.uint32), grid + np.uint32(1)])
    model = _Model()
    out = np.zeros((lanes, 4 * steps + 8), np.uint32)
    used = np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    for lo, hi in _groups(steps):
        met, symbols = [], []
        for at in range(lo, hi, 8):
            upto = min(at + 8, hi)
            real = None
            if upto > rest:
                real = np.ones((upto - at, lanes), bool)
                real[max(rest - at, 0) :, -1] = False
            value, bounds = grid[at:upto], []
            for depth in range(4):
                symbol = (value >> np.uint32(12 - 4 * depth)) & np.uint32(15)
                rows = model.rows(depth, value >> np.uint32(16 - 4 * depth), past[at + 1 : upto + 1], past[at:upto])
                start, high, total = symbol.copy(), symbol + np.uint32(1), np.full(symbol.shape, 16, np.uint32)
                for row, table in zip(rows, model.table):
                    flat, spot = table.reshape(-1), row * np.uint32(17)
                    total += flat.take(spot + np.uint32(16))
                    spot += symbol
                    start += flat.take(spot)
                    high += flat.take(spot + np.uint32(1))
                bounds.append((start.astype(np.uint64), (high - start).astype(np.uint64), total.astype(np.uint64)))
                met.append([row.reshape(-1) if real is None else row[real] for row in rows])
                symbols.append(symbol.reshape(-1) if real is None else symbol[real])
            for t in range(upto - at):
                n = lanes if at + t < rest else lanes - 1
                lows, spans = low[:n], span[:n]
                for start, width, total in bounds:
                    step = spans // total[t, :n]
                    lows += step * start[t, :n]
                    np.multiply(step, width[t, :n], out=spans)
                    over = (lows > _MASK).nonzero()[0]
                    if len(over):
                        out[over, used[over] - 1] += 1
                        lows[over] &= _MASK
                    short = (spans < _TOP).nonzero()[0]
                    if len(short):
                        taken = lows[short]
                        out[short, used[short]] = taken >> _SHIFT
                        used[short] += 1
                        lows[short] = (taken & _LOW) << _TWO
                        spans[short] <<= _TWO
        model.learn([np.concatenate(x) for x in zip(*met)], np.concatenate(symbols))
    for _ in range(3):
        out[np.arange(lanes), used] = low >> _SHIFT
        used += 1
        low = (low & _LOW) << _TWO
    for at in range(int(used.max()) - 1, 0, -1):  # carries that ran over a word
        out[:, at - 1] += out[:, at] >> 16
        out[:, at] &= 0xFFFF
    words = out.astype("<u2")
    return used.astype("<u4").tobytes() + b"".join(words[i, : used[i]].tobytes() for i in range(lanes))


def decode_block(payload: bytes, n_ids: int) -> np.ndarray:
    lanes, steps, rest = _shape(n_ids)
    lengths = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    stream = np.append(np.frombuffer(payload, "<u2", offset=4 * lanes).astype(np.uint64), np.zeros(8, np.uint64))
    used = np.append(0, np.cumsum(lengths)[:-1])
    model = _Model()
    value = (stream[used] << _SHIFT) | (stream[used + 1] << _TWO) | stream[used + 2]
    used += 3
    span = np.full(lanes, (1 << 48) - 1, np.uint64)
    last, before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    grid = np.zeros((steps, lanes), np.int64)
    base, lane = np.arange(1, 17, dtype=np.uint16), np.arange(lanes) * 16
    for lo, hi in _groups(steps):
        met, symbols = [], []
        # Where the symbols end, without the zero before them; the first order brings the one each symbol has at least.
        ends = [np.ascontiguousarray(table[:, 1:]) for table in model.table]
        ends[0] += base
        for t in range(lo, hi):
            n = lanes if t < rest else lanes - 1
            head, values, spans = np.zeros(n, np.uint32), value[:n], span[:n]
            for depth in range(4):
                rows = model.rows(depth, head, last[:n], before[:n])
                mixed = ends[0].take(rows[0], axis=0)
                mixed += ends[1].take(rows[1], axis=0)
                mixed += ends[2].take(rows[2], axis=0)
                total = mixed[:, 15].astype(np.uint64)
                step = spans // total
                target = np.minimum(values // step, total - np.uint64(1)).astype(np.uint16)
                # The symbols that end at or before the target, counted eight bytes at a time.
                past = (mixed <= target[:, None]).view(np.uint64)
                symbol = (((past[:, 0] + past[:, 1]) * _EACH) >> _BYTE).astype(np.uint32)
                flat, spot = mixed.reshape(-1), lane[:n] + symbol
                start = flat.take(np.maximum(spot - 1, 0))
                start[symbol == 0] = 0
                values -= step * start.astype(np.uint64)
                np.multiply(step, (flat.take(spot) - start).astype(np.uint64), out=spans)
                short = (spans < _TOP).nonzero()[0]
                if len(short):
                    values[short] = (values[short] << _TWO) | stream[used[short]]
                    used[short] += 1
                    spans[short] <<= _TWO
                met.append(rows)
                symbols.append(symbol)
                head = (head << np.uint32(4)) | symbol
            grid[t, :n] = head
            before[:n], last[:n] = last[:n], head + np.uint32(1)
        model.learn([np.concatenate(x) for x in zip(*met)], np.concatenate(symbols))
    return grid.T.reshape(-1)[:n_ids] if rest == steps else np.concatenate([grid.T[:-1].reshape(-1), grid.T[-1, :rest]])


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of the file format."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        MAGIC, struct.pack("<II", len(doc_ids), len(ids)), known.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<u4").tobytes(),
    ]
    for at in range(0, len(ids), BLOCK):
        own = ids[at : at + BLOCK]
        payload = encode_block(own)
        parts += [struct.pack("<III", len(own), zlib.crc32(own.astype("<u4").tobytes()), len(payload)), payload]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a segment; a wrong checksum raises."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, total = struct.unpack_from("<II", data, 4)
    at = 12
    known = np.frombuffer(data, np.uint8, docs, at)
    names = np.frombuffer(data, "<i8", docs, at + docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    blocks = [np.zeros(0, np.int64)]
    while at < len(data):
        n, check, size = struct.unpack_from("<III", data, at)
        blocks.append(decode_block(data[at + 12 : at + 12 + size], n))
        if zlib.crc32(blocks[-1].astype("<u4").tobytes()) != check:
            raise ValueError(f"checksum of block {len(blocks) - 2} does not match")
        at += 12 + size
    ids = np.concatenate(blocks)
    if len(ids) != total or lengths.sum() != total:
        raise ValueError("a segment's counts do not match")
    return [int(n) if k else None for n, k in zip(names, known)], lengths, ids


class WordEncoder:
    """Ids of whole texts, as little-endian 16-bit numbers.

    White space always ends a token of this tokenizer and is dropped, so a text's ids are those of its
    words in order. Each word is encoded once per task and kept; words of letters alone are a single
    unit of the tokenizer, so many are encoded in one string and told apart by the ids that end one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}

    def _each(self, words: list[str]) -> None:
        for word, code in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.kept[word] = np.array(code.ids, "<u2").tobytes()

    def _together(self, words: list[str]) -> None:
        for at in range(0, len(words), 512):
            few = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(few)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(few):
                self._each(few)
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(few, (2 * ends).tolist()):
                self.kept[word] = data[begin:end]
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        kept = self.kept
        if len(kept) > CACHE:
            kept.clear()
            kept[""] = b""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(kept)
        if new:
            # A run of marks after letters is a unit of its own.
            cut = {}
            for word in new:
                stem = word.rstrip(MARKS)
                # Only where lower case leaves one letter for each, so that no mark of a letter comes between.
                if len(stem) < len(word) and stem.isalpha() and len(stem.lower()) == len(stem):
                    cut[word] = (stem, word[len(stem) :])
            plain = [w for w in new if w not in cut]
            plain += {x for pair in cut.values() for x in pair}.difference(kept, plain)
            self._together([w for w in plain if w.isalpha()])
            self._each([w for w in plain if not w.isalpha()])
            for word, (stem, mark) in cut.items():
                kept[word] = kept[stem] + kept[mark]
        return [b"".join(map(kept.__getitem__, words)) for words in split]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Tokenise every text and write the segments in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path(tokenizer))
        names, lengths, held, size, number = [], [], [], 0, 0
        end = np.array([end_id], "<u2").tobytes()

        def finish():
            ids = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
            data = pack(names, np.array(lengths), ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())],
                names=["part", "segment", "data"],
            )
            for x in (names, lengths, held):
                x.clear()
            return row

        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                texts = [t or "" for t in few.column("text").to_pylist()]
                for name, ids in zip(few.column("doc_id").to_pylist(), encoder.encode(texts)):
                    names.append(name)
                    lengths.append(len(ids) // 2 + 1)
                    held += (ids, end)
                    size += lengths[-1]
                    if size >= SEGMENT:
                        yield finish()
                        size, number = 0, number + 1
        if names:
            yield finish()
        encoder.kept.clear()
        give_back()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    ordered.mapInArrow(run, "part int, segment int, data binary").write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Per document of the files: ``part``, ``segment``, ``place``, ``doc_id``, ``n_tokens``, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, lengths, ids = unpack(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names), pa.int32()), pa.array([segment] * len(names), pa.int32()),
                     pa.array(np.arange(len(names)), pa.int32()), pa.array(names, pa.int64()), pa.array(lengths),
                     pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), ids.astype(np.int32))],
                    names=["part", "segment", "place", "doc_id", "n_tokens", "ids"],
                )
        give_back()

    table = spark.read.schema("part int, segment int, data binary").parquet(path)
    return table.mapInArrow(
        run, "part int, segment int, place int, doc_id long, n_tokens long, ids array<int>"
    )


def read_digests(spark, path: str) -> DataFrame:
    """As :func:`read_ids`, with ``ids_crc32``, the checksum of a document's ids as read, in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, lengths, ids = unpack(data)
                raw, edge = memoryview(ids.astype("<u4").tobytes()), np.append(0, np.cumsum(lengths) * 4).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names), pa.int32()), pa.array([segment] * len(names), pa.int32()),
                     pa.array(np.arange(len(names)), pa.int32()), pa.array(names, pa.int64()), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["part", "segment", "place", "doc_id", "n_tokens", "ids_crc32"],
                )
        give_back()

    table = spark.read.schema("part int, segment int, data binary").parquet(path)
    return table.mapInArrow(run, "part int, segment int, place int, doc_id long, n_tokens long, ids_crc32 long")


def document_digests(docs: DataFrame, scratch: Scratch, path: str) -> DataFrame:
    """Write, read back, and give ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document.

    ``start`` comes from sums per part, then per segment, then within the segment: no step sees more
    than one of them whole.
    """
    write_ids(docs, path)
    rows = scratch.keep(read_digests(docs.sparkSession, path), "token-digest")
    before = (Window.unboundedPreceding, -1)
    segments = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("_n"))
    parts = segments.groupBy("part").agg(F.sum("_n").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("_part_base")
    )
    segments = segments.select(
        "part", "segment",
        F.coalesce(F.sum("_n").over(Window.partitionBy("part").orderBy("segment").rowsBetween(*before)), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy("part", "segment").orderBy("place").rowsBetween(*before)
    return (
        rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(segments, ["part", "segment"]).join(parts, "part")
        .select("doc_id", (F.col("_part_base") + F.col("_base") + F.col("_in")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )
