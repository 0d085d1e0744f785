"""Exact Jaccard self-join of word n-gram sets in metric space.

1. Sets. A text's set holds the hashes of its distinct five-word shingles (the whole word sequence
   where it is shorter). Documents with equal sets form one class; classes go on.
2. Pivots. Under any fixed order of shingles two linked sets share at least m of their first
   n - ceil(0.8 n) + m shingles, for m up to ceil(0.8 n). With m a tenth of n, a class that shares
   less than a tenth of 0.8 n of these with others is linked with nothing and leaves. Then every
   shingle that two classes have there elects the smallest of them as pivot, and each class joins the
   regions of the pivots it meets: linked classes meet in at least one region. Shingles found very
   often come last in the order, so that passages shared by many documents elect no pivots; the order
   changes cost, never results.
3. Regions. Within a region members lie at their Jaccard distance from the pivot. By the triangle
   inequality members whose distances add up to at most 0.2 are linked without a look, members
   whose distances differ by more than 0.2 are not, and only the window between is counted exactly.
   A region over ``BLOCK_SHINGLES`` is divided into blocks that join pair by pair, with boundary
   members replicated to each, in tasks of bounded size.
4. A link is counted in the smallest region that both its ends share. Tasks return, per class, one
   edge towards its region's component and its number of links, never pairs.

Shingles are 64-bit hashes, as is the name of a set: among 10**9 sets one false class is expected
about once in forty runs.

Documents without text or words have the empty set and link with nothing. A null id takes part like
any other; its component is the smallest known id of the component. Repeated rows link as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.components import components
from scrivano.llm.scratch import Scratch, hinted, unused
from scrivano.llm.words import mix, text_chunks, tidy, word_bounds, word_hashes

WORDS = 5
PERCENT = 80
OFTEN = 4  # of those counted together, to be counted as an often-found shingle
COUNTED = 3 << 20  # shingles counted together
KNOWN_NAMES = 20_000  # sets a task remembers, so that it sends their copies once
MIN_OFTEN = 64
MAX_OFTEN = 200_000
BLOCK_SHINGLES = 1 << 21
HEAD_SHARE = 10
PRUNINGS = 2
BROADCAST_IDS = 2_000_000

_STEP = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64) | 1) for k in range(WORDS)]


def shingle_sets(column: pa.Array, words: int = WORDS):
    """(row, sorted distinct shingle hashes) of every text that has words."""
    for at, data, offsets in text_chunks(column):
        starts, ends, first = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        counts = np.diff(first)
        total = len(hashes) - words + 1
        rolled = np.zeros(max(total, 0), np.uint64)
        for k in range(words):
            if total > 0:
                rolled += hashes[k : k + total] * _STEP[k]
        rolled = mix(rolled)
        for row in np.flatnonzero(counts):
            n, lo = counts[row], first[row]
            if n >= words:
                yield at + row, np.unique(rolled[lo : lo + n - words + 1])
            else:
                short = (hashes[lo : lo + n] * np.array(_STEP[:n])).sum(dtype=np.uint64, keepdims=True)
                yield at + row, mix(short + np.array([n], np.uint64) * np.uint64(0xA24BAED4963EE407))


def set_name(shingles: np.ndarray) -> int:
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(shingles)], np.uint64)).view(np.int64)[0])


def least_common(n):
    """Shingles that two linked sets share at least, from the size of either."""
    return -(-n * PERCENT // 100)


def needed(n):
    """Shingles of its head that a set of size n has in common with any set it is linked with."""
    return -(-n * PERCENT // (100 * HEAD_SHARE))


def head_length(n):
    return n - least_common(n) - (-n // HEAD_SHARE)


def _survey(texts: DataFrame) -> DataFrame:
    """Per document: id, hash of the text, set size, set name; other rows count shingles found often."""

    def counted(seen: dict[int, np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        values, counts = values[counts >= OFTEN], counts[counts >= OFTEN]
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.array(counts.astype(np.int64)), none, pa.array(values.view(np.int64))],
            names=columns,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            sizes, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, shingles in shingle_sets(batch.column("text")):
                sizes[row], names[row] = len(shingles), set_name(shingles)
                if int(names[row]) not in seen:
                    seen[int(names[row])] = shingles
                    held += len(shingles)
                if held > COUNTED:
                    yield counted(seen)
                    seen, held = {}, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes),
                 pa.array(names, mask=sizes == 0), pa.nulls(len(sizes), pa.int64())],
                names=columns,
            )
        if seen:
            yield counted(seen)

    columns = ["doc_id", "text_hash", "n", "name", "often"]
    return texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        tidy(run), "doc_id long, text_hash long, n long, name long, often long"
    )


def _prefixes(texts: DataFrame, often: np.ndarray) -> DataFrame:
    """(shingle, class, shared shingles needed) for the first shingles of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            heads, names, least = [], [], []
            if len(done) > KNOWN_NAMES:
                done.clear()
            for _, shingles in shingle_sets(batch.column("text")):
                name = set_name(shingles)
                if name in done:
                    continue
                done.add(name)
                if len(often):
                    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
                    late = often[at] == shingles
                    if late.any():
                        shingles = np.concatenate([shingles[~late], shingles[late]])
                n = len(shingles)
                heads.append(shingles[: head_length(n)])
                names.append(name)
                least.append(needed(n))
            if heads:
                sizes = [len(h) for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), sizes)),
                     pa.array(np.repeat(np.array(least, np.int32), sizes))],
                    names=["shingle", "name", "least"],
                )

    return texts.mapInArrow(tidy(run), "shingle long, name long, least int")


def _class_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, sets = [], []
                for _, shingles in shingle_sets(batch.column("text").slice(at, 256)):
                    names.append(set_name(shingles))
                    sets.append(shingles)
                if names:
                    offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                    held = pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), held], names=["name", "shingles"])

    return texts.mapInArrow(tidy(run), "name long, shingles array<long>")


def join_region(region: pd.DataFrame, pivot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, root, links) of the members of one region, or of one pair of its blocks.

    ``side`` is 0 or 1 for members of the first and second block and 2 for the pivot's set where the
    region has blocks; with one block there is only side 0.
    """
    member = region["side"].to_numpy() < 2
    if not member.any():
        return (np.zeros(0, np.int64),) * 3
    center = region["shingles"].to_numpy()[(region["name"].to_numpy() == pivot).argmax()]
    region = region[member]
    sets = region["shingles"].to_numpy()
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(owner, np.isin(flat, center), len(sets))
    far = 1 - shared / (sizes + len(center) - shared)
    order = np.argsort(far, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    far, sizes = far[order], sizes[order]
    names, copies = region["name"].to_numpy()[order], region["copies"].to_numpy()[order].astype(np.int64)
    side = region["side"].to_numpy()[order]
    crossed = bool(region["one"].iat[0] != region["two"].iat[0])
    regions = [tuple(r) for r in region["regions"].to_numpy()[order]]
    lists = {r: i for i, r in enumerate(dict.fromkeys(regions))}
    list_of, as_sets = np.array([lists[r] for r in regions]), [frozenset(r) for r in lists]
    counted: dict[int, np.ndarray] = {}

    def counts_here(i: int) -> np.ndarray:
        """For each region list: is this the smallest region it has in common with member i's?"""
        own = list_of[i]
        if own not in counted:
            mine = as_sets[own]
            counted[own] = np.array([True if len(mine) == 1 else min(mine & s) == pivot for s in as_sets])
        return counted[own]

    _, token = np.unique(flat, return_inverse=True)
    by_place = np.argsort(place[owner], kind="stable")
    token = token[by_place]
    holder = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.append(0, np.cumsum(sizes))
    posting = np.argsort(token, kind="stable")
    posted = holder[posting]
    first = np.append(0, np.cumsum(np.bincount(token)))
    links = np.zeros(len(sizes), np.int64)
    root = np.arange(len(sizes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    limit = 1 - PERCENT / 100
    for i in range(len(sizes)):
        sure = int(np.searchsorted(far, limit - 1e-9 - far[i], "right"))
        end = int(np.searchsorted(far, far[i] + limit + 1e-9, "right"))
        if sure > i + 1:  # linked by the triangle inequality
            ok = counts_here(i)[list_of[i + 1 : sure]]
            if crossed:
                ok = ok & (side[i + 1 : sure] != side[i])
            links[i] += (copies[i + 1 : sure] * ok).sum()
            links[i + 1 : sure] += copies[i] * ok
        low = max(i + 1, sure)
        if low >= end:
            continue
        own = token[begin[i] : begin[i + 1]]
        starts, lens = first[own], first[own + 1] - first[own]
        held = lens > 1
        starts, lens = starts[held], lens[held]
        if not len(lens):
            continue
        at = np.arange(lens.sum()) + np.repeat(starts - np.cumsum(lens) + lens, lens)
        met = posted[at]
        both = np.bincount(met[(met >= low) & (met < end)] - low, minlength=end - low)
        linked = 100 * both >= PERCENT * (sizes[i] + sizes[low:end] - both)
        if crossed:
            linked &= side[low:end] != side[i]
        found = np.flatnonzero(linked) + low
        if len(found):
            ok = counts_here(i)[list_of[found]]
            links[i] += (copies[found] * ok).sum()
            links[found] += copies[i] * ok
            for j in set(root[found].tolist()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    roots = np.array([names[find(i)] for i in range(len(root))], np.int64)
    near = far <= limit - 1e-9  # all of them are linked to the pivot
    to_pivot = np.where(near, pivot, roots)
    return (
        np.concatenate([names, names[near]]),
        np.concatenate([to_pivot, roots[near]]),
        np.concatenate([links, np.zeros(near.sum(), np.int64)]),
    )


def _join_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in, one region or pair of blocks at a time."""
    held: list[pd.DataFrame] = []

    def finish():
        whole = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        held.clear()
        names, roots, links = join_region(whole, int(whole["pivot"].iat[0]))
        return pd.DataFrame({"name": names, "root": roots, "links": links})

    for frame in batches:
        key = frame[["pivot", "one", "two"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        out = []
        if held and (held[0][["pivot", "one", "two"]].to_numpy()[0] != key[0]).any():
            out.append(finish())
        edges = [0, *cuts, len(frame)]
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            held.append(frame.iloc[lo:hi])
            if i < len(edges) - 2:
                out.append(finish())
        if out:
            yield pd.concat(out, ignore_index=True)
    if held:
        yield finish()


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose shingle two classes have, with the smallest of them as pivot."""
    buckets = rows.groupBy("shingle").agg(F.min("name").alias("pivot"), F.max("name").alias("_last"))
    return rows.join(buckets.filter("pivot <> _last").drop("_last"), "shingle")


def link_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``n_links`` of every document.

    ``text_hash`` and ``component`` name its text and its component, the latter null without words.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = scratch.keep(_survey(texts), "sets")
    rows = survey.filter("often is null").select("doc_id", "text_hash", "n", "name")
    often = np.sort(
        np.array(
            [r[0] for r in survey.filter("often is not null").groupBy("often").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= MIN_OFTEN).orderBy(F.desc("n"), "often").limit(MAX_OFTEN).collect()],
            np.int64,
        ).view(np.uint64)
    )  # bounded by MAX_OFTEN; it only orders shingles
    classes = rows.filter("name is not null").groupBy("name").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    prefixes = _prefixes(texts, often)
    shared = scratch.keep(_shared(prefixes), "shared")
    for _ in range(PRUNINGS):  # what leaves may leave others alone
        enough = (
            shared.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max("least").alias("_least"))
            .filter("_n >= _least").select("name")
        )
        fewer = scratch.keep(_shared(shared.drop("pivot").join(enough, "name")), "shared")
        scratch.drop(shared)
        shared = fewer
    members = scratch.keep(shared.select("name", "pivot").distinct(), "members")
    scratch.drop(shared)
    regions_of = members.groupBy("name").agg(F.collect_set("pivot").alias("regions"))
    wanted = scratch.keep(regions_of.join(classes, "name"), "wanted")
    ids = wanted.select(F.col("first_id").alias("_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # 16 MB at most
    chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = _class_sets(chosen).dropDuplicates(["name"])
    known = scratch.keep(
        sets.join(wanted, "name").withColumn("n", F.size("shingles").cast("long")), "class-sets"
    )
    blocks = (
        members.join(known.select("name", "n"), "name").groupBy("pivot").agg(F.sum("n").alias("_all"))
        .select("pivot", F.ceil(F.col("_all") / BLOCK_SHINGLES).cast("long").alias("_blocks"))
    )
    placed = members.join(blocks, "pivot").withColumn("_own", F.pmod(F.xxhash64("name"), F.col("_blocks")))
    last = F.col("_blocks") - 1
    pairs = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "name", "pivot", F.least("_own", "_other").alias("one"), F.greatest("_own", "_other").alias("two"),
        F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("side"),
    )
    centers = (
        blocks.filter("_blocks > 1")
        .withColumn("one", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("two", F.explode(F.sequence(F.col("one"), last)))
        .select(F.col("pivot").alias("name"), "pivot", "one", "two", F.lit(2).alias("side"))
    )
    tasks = pairs.unionByName(centers).join(known.select("name", "copies", "regions", "shingles"), "name")
    found = scratch.keep(
        tasks.repartition("pivot", "one", "two").sortWithinPartitions("pivot", "one", "two")
        .mapInPandas(tidy(_join_regions), "name long, root long, links long"),
        "links",
    )
    roots = components(found.filter("name <> root").select(F.col("name").alias("u"), F.col("root").alias("v")), scratch)
    linked = found.groupBy("name").agg(F.sum("links").alias("links"))
    grouped = (
        classes.join(roots, F.col("name") == F.col("node"), "left").drop("node")
        .join(linked, "name", "left")
        .select("name", "first_id", "copies", F.coalesce("root", "name").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = grouped.join(least, "root").select(
        "name", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component")
    )
    out = scratch.keep(
        rows.join(answer, "name", "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "text_hash",
            "component",
        ),
        "jaccard",
    )
    scratch.drop(survey, members, wanted, known, found)
    return out


def one_per_component(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with one of each component, that of the smallest id; those without words all stay.

    A text and its id stay or go together. Fully repeated rows are copies like others, so one stays.
    """
    rows = link_classes(docs, scratch)
    named = rows.filter("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    best = named.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = named.join(best, "component").select("doc_id", "text_hash", (order == F.col("best")).alias("stays"))
    fates = scratch.keep(placed.groupBy("doc_id", "text_hash", "stays").agg(F.count(F.lit(1)).alias("n")), "fates")
    own, other, code = unused(docs.columns, "own_hash", "other_id", "other_hash")
    hashed = docs.withColumn(own, F.xxhash64("text"))

    def same(frame: DataFrame) -> tuple:
        ids = scratch.keep(frame.select(F.col("doc_id").alias(other), F.col("text_hash").alias(code)), "ids")
        return hinted(ids), F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(own) == F.col(code))

    kept = hashed.join(*same(fates.filter("not stays")), "left_anti")
    repeated = fates.filter("stays and n > 1")
    if not repeated.isEmpty():
        again, condition = same(repeated)
        copies = kept.join(again, condition, "left_semi").dropDuplicates(["doc_id", own])
        kept = kept.join(again, condition, "left_anti").unionByName(copies)
    return kept.drop(own)
