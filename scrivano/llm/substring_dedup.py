"""Exact repeated-substring removal over all documents with suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere else as well.

1. Anchors. Among the grams inside each such string the one with the least hash is its anchor, so
   equal strings have equal anchors. Consecutive strings share anchors; grams that anchor once only
   hold nothing repeated.
2. Contexts. What an anchor's strings cover in a document is its context, named by a 128-bit hash.
   Contexts move as places, without their bytes. Those found twice are repeated throughout.
3. Suffix arrays. Different contexts of one anchor, less the parts whose short grams stand nowhere
   else, are sorted by their suffixes, by grouping on Lyndon prefixes, many anchors at once (see
   ``suffix_array``). A start whose suffix shares ``LENGTH`` bytes with a neighbour in that order is
   repeated. Only these contexts are cut from their texts.
4. An anchor with more than ``GROUP`` contexts is split: by how far before the anchor a string starts,
   in steps of ``STEPS``, and by the bytes that all strings of such a step share. Equal strings stay
   together. Step 3 follows for the parts; at a step of one byte a part is one string, and names decide.

Anchors are found by 64-bit hashes, which only decides what is compared. Null texts are empty; shorter
texts hold nothing. Repeated rows are different documents with equal text, so all of it goes if it has
``LENGTH`` bytes. Null and repeated ids take part like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch, hinted
from scrivano.llm.suffix_array import repeated_starts
from scrivano.llm.words import _VALUES, _powers, give_back, mix, text_chunks

LENGTH = 200
GRAM = 32
SHORT = 64
GROUP = 3_000  # contexts, about a megabyte of text
STEPS = (16, 1)  # bytes before the anchor, for the parts of larger groups and the parts of these
SORTED_BYTES = 1 << 21
BATCH_BYTES = 1 << 23
PLACES = 1 << 24  # places are known modulo this


def gram_hashes(data: np.ndarray, size: int, values: np.ndarray = _VALUES) -> np.ndarray:
    """Hash of the gram at every start."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: len(data) - size + 1])


def anchors(data: np.ndarray, length: int, places: int = PLACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the anchors of one text's strings, in order."""
    grams = gram_hashes(data, GRAM)
    wide = length - GRAM + 1
    n = len(grams)
    low = np.uint64(places - 1)
    key = (grams & ~low) | (np.arange(n, dtype=np.uint64) & low)
    rows = -(-n // wide)
    padded = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    tiles = padded.reshape(rows, wide)
    ahead = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(n - wide + 1)
    least = np.minimum(back[starts], ahead[starts + wide - 1])
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(cut[1:], len(starts)) - 1
    place = cut + ((least[cut] & low).astype(np.int64) - cut) % places  # at the start or after it
    return grams[place], place, cut, last


_OTHERS = mix(_VALUES)


class Hashes:
    """128-bit hashes of any strings of one run of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros((2, len(data) + 1), np.uint64)
        for sums, values in zip(self.sums, (_VALUES, _OTHERS)):
            np.cumsum(values[data] * power[: len(data)], out=sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        sized = (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return [mix((sums[last] - sums[first]) * self.inverse[first] + sized).view(np.int64) for sums in self.sums]


CONTEXT = "anchor long, one long, two long, uid long, first int, last int, place int"


def _context_rows(texts: DataFrame, length: int, named: bool) -> DataFrame:
    """The contexts of every text; without names and places, the anchors alone."""
    names = [c.split()[0] for c in CONTEXT.split(", ")] if named else ["anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, parts = batch.column("uid").to_numpy(), []
            for at, data, offsets in text_chunks(batch.column("text")):
                hashes = Hashes(data) if named else None
                for i in np.flatnonzero(np.diff(offsets) >= length):
                    anchor, place, first, last = anchors(data[offsets[i] : offsets[i + 1]], length)
                    part = [anchor.view(np.int64)]
                    if named:
                        part += hashes.of(first + offsets[i], last + length + offsets[i])
                        part += [np.full(len(first), uids[at + i]), *(x.astype(np.int32) for x in (first, last, place))]
                    parts.append(part)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names)
        give_back()

    return texts.mapInArrow(run, CONTEXT if named else "anchor long")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``text`` and ``spots``, the rows of the text as structures; texts without rows do not move."""
    held = hinted(rows.select("uid").distinct())
    spots = rows.groupBy("uid").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "uid"])).alias("spots"))
    return texts.select("uid", "text").join(held, "uid", "left_semi").join(spots, "uid").select("uid", "text", "spots")


def _per_text(one: Callable[[int, bytes, dict[str, np.ndarray]], list[pa.Array]], names: list[str]):
    """Task function: ``one`` makes the columns ``names`` of a text and its spots; they leave in batches of some size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, parts, size = batch.column("spots"), [], 0
            flat, offsets = spots.flatten(), np.append(0, np.cumsum(spots.value_lengths().to_numpy()))
            columns = {f.name: flat.field(i).to_numpy() for i, f in enumerate(flat.type)}
            for row, (uid, text) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("text"))):
                mine = {k: v[offsets[row] : offsets[row + 1]] for k, v in columns.items()}
                parts.append(one(uid, text.as_py().encode(), mine))
                size += sum(x.nbytes for x in parts[-1])
                if size >= BATCH_BYTES or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts)], names=names)
                    parts, size = [], 0
        give_back()

    return run


def _cut(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``anchor``, ``n``, ``uid``, ``first`` and the bytes of the contexts."""

    def one(uid: int, data: bytes, spot: dict[str, np.ndarray]) -> list[pa.Array]:
        held = [data[a : b + length] for a, b in zip(spot["first"].tolist(), spot["last"].tolist())]
        columns = (spot["anchor"], spot["n"], np.full(len(held), uid), spot["first"])
        return [*map(pa.array, columns), pa.array(held, pa.binary())]

    run = _per_text(one, ["anchor", "n", "uid", "first", "context"])
    joined = _with_texts(rows.select("uid", "anchor", "n", "first", "last"), texts)
    return joined.mapInArrow(run, "anchor long, n long, uid long, first int, context binary")


def _split(rows: DataFrame, texts: DataFrame, length: int, step: int) -> DataFrame:
    """The contexts' parts, under anchors of their own; ``n`` is the context's."""

    def one(uid: int, data: bytes, spot: dict[str, np.ndarray]) -> list[pa.Array]:
        hashes, place = Hashes(np.frombuffer(data, np.uint8)), spot["place"].astype(np.int64)
        least, most = (place - spot["last"]) // step, (place - spot["first"]) // step
        which = np.repeat(np.arange(len(place)), most - least + 1)
        before = np.arange(len(which)) - (np.cumsum(most - least + 1) - 1 - most)[which]
        low = place[which] - before * step - step + 1  # the first start of the step, perhaps outside the context
        first, last = np.maximum(spot["first"][which], low), np.minimum(spot["last"][which], low + step - 1)
        shared = hashes.of(low + step - 1, low + length)[0].view(np.uint64)
        anchor = mix(shared ^ mix(spot["anchor"][which].view(np.uint64) + before.astype(np.uint64)))
        spots = (x.astype(np.int32) for x in (first, last, place[which]))
        columns = (anchor.view(np.int64), *hashes.of(first, last + length), np.full(len(which), uid), *spots, spot["n"][which])
        return [pa.array(x) for x in columns]

    run = _per_text(one, [c.split()[0] for c in CONTEXT.split(", ")] + ["n"])
    joined = _with_texts(rows.select("uid", "anchor", "n", "first", "last", "place"), texts)
    return joined.mapInArrow(run, CONTEXT + ", n long")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _shared_pieces(
    data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, group: np.ndarray, counts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first byte, end in ``data``) of the runs whose every short gram also stands elsewhere in the
    group; the rest cannot repeat."""
    size = min(SHORT, length)
    inside = np.zeros(len(data) + 1, np.int64)  # grams do not run from one text into the next
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + np.maximum(sizes - size + 1, 0), -1)
    spots = np.flatnonzero(np.cumsum(inside[: max(len(data) - size + 1, 0)]))
    if not len(spots):
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - size + 1, 0))
    names = gram_hashes(data, size)[spots] ^ mix(group.astype(np.uint64) + np.uint64(1))[owner]
    order = np.argsort(names)
    names = names[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    often = np.add.reduceat(counts[owner[order]], first) > 1
    shared = np.zeros(len(data), bool)
    shared[spots[order[np.repeat(often, np.diff(np.append(first, len(names))))]]] = True
    # A run ends with its text, as the last starts of a text hold no gram.
    starts, ends = _runs(shared)
    wide = ends - starts >= length - size + 1
    starts, ends = starts[wide], ends[wide] + size - 1
    return np.searchsorted(begins, starts, "right") - 1, starts, ends


def _sorted_groups(groups: DataFrame, length: int) -> DataFrame:
    """(uid, a, b): runs covered by repeated strings in the contexts that were found once."""

    def finish(rows: pa.Table) -> pa.RecordBatch:
        anchor, counts, uid, first = (rows.column(c).to_numpy() for c in ("anchor", "n", "uid", "first"))
        context = pa.concat_arrays(rows.column("context").cast(pa.large_binary()).chunks)
        offsets = np.frombuffer(context.buffers()[1], np.int64)[context.offset : context.offset + len(context) + 1]
        data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begins = offsets[:-1] - offsets[0]
        group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
        found = _shared_pieces(data, begins, np.diff(offsets), group, counts, length)
        often: dict[int, dict[bytes, int]] = {}
        pieces = []
        for i, x, y in zip(*(c.tolist() for c in found)):
            mine, piece = often.setdefault(int(group[i]), {}), data[x:y].tobytes()
            mine[piece] = mine.get(piece, 0) + int(counts[i])
            if counts[i] == 1:
                pieces.append((i, x - int(begins[i]), mine, piece))
        flags = repeated_starts([list(x) for x in often.values()], length)
        again = {id(x): dict(zip(x, f)) for x, f in zip(often.values(), flags)}
        out = [np.zeros((3, 0), np.int64)]
        for i, at, mine, piece in pieces:
            same = again[id(mine)][piece]
            x, y = _runs(same) if mine[piece] == 1 else (np.zeros(1, np.int64), np.array([len(same)]))
            at += int(first[i])
            out.append(np.stack([np.full(len(x), uid[i]), at + x, at + y + length - 1]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["uid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= SORTED_BYTES:
                rows = pa.Table.from_batches(held)
                anchor = rows.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
                if whole:
                    yield finish(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield finish(pa.Table.from_batches(held))
        give_back()

    return groups.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "uid long, a long, b long")


def _level(rows: DataFrame, texts: DataFrame, scratch: Scratch, length: int, group: int, steps: tuple[int, ...]) -> list[DataFrame]:
    """The spans (uid, a, b) that repeated strings cover in the written contexts ``rows``, each found ``n`` times."""
    name = ["anchor", "one", "two"]
    some = (F.first(c).alias(c) for c in ("uid", "first", "last", "place"))  # any one of them: their bytes are equal
    distinct = scratch.keep(rows.groupBy(*name).agg(F.sum("n").alias("n"), *some), "distinct")
    twice = distinct.filter("n > 1").select(*name)
    spans = [scratch.keep(rows.filter("n = 1").join(twice, name, "left_semi").select(
        "uid", F.col("first").cast("long").alias("a"), (F.col("last") + F.lit(length)).cast("long").alias("b")
    ), "spans")]
    if not group:
        scratch.drop(distinct)
        return spans
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_g"), F.min("n").alias("_least"))
    sizes = scratch.keep(sizes.filter("_g > 1 and _least = 1").select("anchor", "_g"), "sizes")
    members = scratch.keep(distinct.join(sizes, "anchor"), "members")
    scratch.drop(distinct, sizes)
    # Written one by one, so that what a step shuffled is gone before the next one.
    spans.append(scratch.keep(_sorted_groups(_cut(members.filter(F.col("_g") <= group), texts, length), length), "spans"))
    large = members.filter(F.col("_g") > group)
    if steps and not large.isEmpty():
        parts = scratch.keep(_split(large, texts, length, steps[0]), "parts")
        spans += _level(parts, texts, scratch, length, group if steps[1:] else 0, steps[1:])
        scratch.drop(parts)
    scratch.drop(members)
    return spans


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``text`` with the repeated bytes removed (binary), ``n_bytes``, ``n_removed``, ``n_spans``."""
    texts = scratch.keep(
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid")), "texts"
    )
    cut_from = texts.select("uid", "text")
    twice = _context_rows(cut_from, length, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    twice = twice.filter("_n > 1").select("anchor")
    rows = _context_rows(cut_from, length, True).join(twice, "anchor", "left_semi").withColumn("n", F.lit(1).cast("long"))
    rows = scratch.keep(rows, "contexts")
    spans = _level(rows, texts, scratch, length, group, STEPS)
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    gone = scratch.keep(every.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("gone")), "gone")
    scratch.drop(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole, lost, spans = [], [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                data, parts, at, runs = (text or "").encode(), [], 0, 0
                for span in gone or ():
                    if span["a"] > at or not runs:
                        parts.append(data[at : span["a"]])
                        runs += 1
                    at = max(at, span["b"])
                parts.append(data[at:])
                kept.append(b"".join(parts))
                whole.append(len(data))
                lost.append(len(data) - len(kept[-1]))
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (whole, lost, spans))],
                names=["doc_id", "text", "n_bytes", "n_removed", "n_spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = texts.join(gone, "uid", "left").select("doc_id", "text", "gone")
    return both.mapInArrow(cut, f"doc_id {kind}, text binary, n_bytes long, n_removed long, n_spans long")
