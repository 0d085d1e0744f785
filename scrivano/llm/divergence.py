"""Source divergence audit with hash-consed segment trees over term ids.

Each task counts the terms of its documents, so that what is shuffled is a row per task, group and term;
one exchange by (language, term) then gives the counts of all groups and the number of documents. Terms
are dealt to segments of bounded size by their hash. In a segment a term's id is its rank by total
count, so that rare terms are neighbours; every group has a segment tree over these ids whose leaves are
counts, and nodes with the same two children are one node, whichever group they belong to. Two trees are
followed together from the root: all equal pairs of nodes met at a level are one pair with a
multiplicity, so each is priced once, and at the leaves a pair of counts has one price in either
direction. Sums over segments are long additions in Spark. Segments are also split by blocks of sources,
so a task holds at most ``SEGMENT`` terms of ``2 * SOURCES`` groups.

Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, with only A-Z lower-cased; null text, language or source
is ''. A language keeps the terms of at least ``least_documents`` of its documents (rows; repeated rows
count each). Numbers are whole throughout. A group without terms has counts of zero; a language without
kept terms prices every pair at 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch
from scrivano.llm.words import give_back, text_chunks, word_bounds

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SEGMENT = 8192
SOURCES = 64
HELD_TERMS = 800_000
HELD_GROUPS = 100_000
SENT_TERMS = 50_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LONG_SAFE = (2**63 - 1) // UNIT - 1

ORACLE = r"""
with d as (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
           row_number() over () as row,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
tokens as (select lang, source, row, unnest(terms) as term from d),
kept as (select lang, term, count(*)::hugeint as total from tokens group by 1, 2 having count(distinct row) >= 3),
grp as (select distinct lang, source from d),
counts as (select t.lang, t.source, t.term, count(*)::hugeint as n from tokens t join kept k on k.lang = t.lang and k.term = t.term group by all),
v as (select g.lang, count(k.term)::hugeint as v, coalesce(sum(k.total), 0)::hugeint as n
      from (select distinct lang from grp) g left join kept k on k.lang = g.lang group by 1),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n, any_value(v.v) as v
       from grp g join v on v.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p
      from gn g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
lq as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.total + 1)) // (v.n + v.v) as q from kept k join v on v.lang = k.lang),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (select a.lang, a.source, b.source as item, coalesce(p.value, 0)::bigint as value
              from grp a join grp b on a.lang = b.lang and a.source <> b.source
              left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select p.lang, p.source, p.term as item, (((p.p - l.q) * (p.p - l.q)) // l.q)::bigint as value
          from p join lq l on l.lang = p.lang and l.term = p.term where p.n > 0 and p.p > l.q)
select lang, source, 'pair' as part, item, value,
       row_number() over (partition by lang, source order by value desc, item)::int as rank from all_pairs
union all
select * from (select lang, source, 'term' as part, item, value,
       row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
"""


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of the texts in order, each distinct one held once, and the text each is of."""
    starts, ends, first = word_bounds(data, offsets, _BETWEEN)
    letters = np.delete(data, np.flatnonzero(_BETWEEN[data])) if len(starts) else data[:0]
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[letters]))
    return terms.dictionary_encode(), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins among sorted ones."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.intp)


def _summed(group: np.ndarray, terms: pa.DictionaryArray, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    """``group, term, n, docs`` with the rows of a group and term added up."""
    width = max(len(terms.dictionary), 1)
    keys = group * width + terms.indices.to_numpy()
    order = np.argsort(keys)
    keys = keys[order]
    begin = _runs(keys)
    group, code = np.divmod(keys[begin], width)
    sums = [np.add.reduceat(x[order], begin) if len(begin) else x[:0] for x in (n, docs)]
    columns = [pa.array(group), terms.dictionary.take(pa.array(code)), *map(pa.array, sums)]
    return pa.table(columns, names=["group", "term", "n", "docs"])


def _chunk_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> pa.Table:
    """:func:`_summed` for the texts; ``groups`` numbers the group of each."""
    terms, text = _terms(data, offsets)
    width = max(len(terms.dictionary), 1)
    cells = np.sort(text * width + terms.indices.to_numpy())
    begin = _runs(cells)
    text, code = np.divmod(cells[begin], width)
    met = pa.DictionaryArray.from_arrays(pa.array(code), terms.dictionary)
    return _summed(groups[text], met, np.diff(np.append(begin, len(cells))), np.ones(len(begin), np.int64))


def _combined(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    group, n, docs = (whole.column(c).to_numpy() for c in ("group", "n", "docs"))
    return _summed(group, whole.column("term").combine_chunks().dictionary_encode(), n, docs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task; sent whenever many terms are held."""
    known: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    whole = size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        names = [pa.array([name[i] for name in known], pa.string()) for i in (0, 1)]
        table = _combined(held)
        for part in table.to_batches(max_chunksize=SENT_TERMS):
            lang, source = (each.take(part.column("group")) for each in names)
            yield pa.RecordBatch.from_arrays(
                [lang, source, part.column("term").cast(pa.string(), safe=False), part.column("n"), part.column("docs")],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        rows = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        groups = np.array([known.setdefault(row, len(known)) for row in rows], np.int64)
        for at, data, offsets in text_chunks(batch.column("text")):
            held.append(_chunk_counts(data, offsets, groups[at : at + len(offsets) - 1]))
            size += held[-1].num_rows
            # Tables are combined when they have doubled, so each row is seen a few times at most.
            if size > max(2 * whole, HELD_TERMS // 4):
                held[:] = [_combined(held)]
                whole = size = held[0].num_rows
                if size > HELD_TERMS:
                    yield from sent()
                    held.clear()
                    whole = size = 0
        if not held and len(known) > HELD_GROUPS:
            known.clear()
    if held:
        yield from sent()
    held.clear()
    give_back()


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n, total``, and ``first``: one row of each kept term of a language has it true."""
    parts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # The tasks have combined already; dealt by term, neither the sums nor the windows move rows again.
    dealt = parts.repartition("lang", "term")
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = summed.withColumn("total", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term))
    wide = wide.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return wide.filter(F.col("docs") >= least_documents).drop("docs")


def scaled(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / size), exactly; ``size`` is one for each count."""
    if counts.max(initial=0) < _LONG_SAFE:
        return 1 + (UNIT * (counts + 1)) // size
    return np.array([1 + UNIT * (int(c) + 1) // int(s) for c, s in zip(counts, size)], np.int64)


def consed(leaves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Trees over the columns of ``leaves`` (groups x ids), with equal nodes of a height shared.

    Returns per height, from the root down, the two children (rows of two) of each of its nodes, and
    the root of each group. The children above the leaves are counts. An odd node at the end of a level
    has -1 as its second child, which stands for no ids at all.
    """
    heights = []
    level = leaves
    while level.shape[1] > 1:
        if level.shape[1] % 2:
            level = np.hstack([level, np.full((len(level), 1), -1, level.dtype)])
        couples = level.reshape(-1, 2)
        # Two whole numbers name a node; the name is its place among the distinct couples.
        order = np.lexsort((couples[:, 1], couples[:, 0]))
        sorted_ = couples[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new) - 1
        nodes = sorted_[new]
        heights.append(nodes)
        level = name.reshape(len(level), -1)
    return heights[::-1], level[:, 0]


def priced(leaves: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ids of f(p of left, q of right) and of f(p of right, q of left), per pair of groups."""
    heights, root = consed(leaves)
    pair, a, b, times = np.arange(len(left)), root[left], root[right], np.ones(len(left), np.int64)
    for nodes in heights:
        pair, a, b, times = np.tile(pair, 2), nodes[a].T.ravel(), nodes[b].T.ravel(), np.tile(times, 2)
        some = a >= 0
        pair, a, b, times = pair[some], a[some], b[some], times[some]
        # Equal pairs of nodes are one from here on.
        order = np.lexsort((b, a, pair))
        pair, a, b, times = pair[order], a[order], b[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(new)
        pair, a, b, times = pair[start], a[start], b[start], np.add.reduceat(times, start) if len(start) else times
    p, q = scaled(a, size[left[pair]]), scaled(b, size[right[pair]])
    square = (p - q) * (p - q)
    out = []
    for divisor in (q, p):
        total = np.zeros(len(left), np.int64)
        np.add.at(total, pair, times * (square // divisor))
        out.append(total)
    return out[0], out[1]


def _segment(table: pa.Table) -> pa.Table:
    """Prices of all pairs of groups that meet in this tile, over the terms of one segment."""
    group, term = table.column("group").to_numpy(), table.column("term").combine_chunks()
    n, total, size = (table.column(c).to_numpy() for c in ("n", "total", "size"))
    block_a, block_b = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    groups, at = np.unique(group, return_inverse=True)
    sizes = np.zeros(len(groups), np.int64)
    sizes[at] = size
    known = term.is_valid().to_numpy(zero_copy_only=False)
    cell, width = np.flatnonzero(known), int(total[~known][0])
    coded = term.take(pa.array(cell)).dictionary_encode()
    code = coded.indices.to_numpy()
    weight = np.zeros(len(coded.dictionary), np.int64)
    weight[code] = total[cell]
    rank = np.empty(len(weight), np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    # Terms that none of these groups has are zeros at the end.
    leaves = np.zeros((len(groups), width), np.int64)
    leaves[at[cell], rank[code]] = n[cell]
    left, right = np.triu_indices(len(groups), 1)
    inside = np.isin(groups // SOURCES, [block_a]), np.isin(groups // SOURCES, [block_b])
    meets = (inside[0][left] & inside[1][right]) if block_a != block_b else np.ones(len(left), bool)
    left, right = left[meets], right[meets]
    forth, back = priced(leaves, sizes, left, right)
    lang = table.column("lang")[0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * (2 * len(left)), pa.string()),
            "group": pa.array(np.concatenate([groups[left], groups[right]]), pa.int64()),
            "other": pa.array(np.concatenate([groups[right], groups[left]]), pa.int64()),
            "value": pa.array(np.concatenate([forth, back]), pa.int64()),
        }
    )


def audit(table: DataFrame, scratch: Scratch, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
          segment: int = SEGMENT) -> DataFrame:
    """``lang, source, part, item, value, rank``: what each source differs in, from other sources and from its language."""
    docs = table.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.keep(term_counts(docs, least_documents), "term-counts")
    langs = counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["group_n", "v", "lang_n"]).withColumn("size", F.col("group_n") + F.col("v"))
    groups = groups.withColumn("group", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = scratch.keep(groups.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")

    known = ["lang", "source", "group", "size", "groups", "v"]
    cells = counts.join(groups.select(*known), ["lang", "source"]).select(*known, "term", "n", "total", "first")
    segments = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / segment))
    cells = cells.withColumn("segment", F.pmod(F.xxhash64("term"), segments))
    # Every group takes part in every segment, also where it has none of the terms; it brings their number.
    sizes = cells.groupBy("lang", "segment").agg(F.sum(F.col("first").cast("long")).alias("total"))
    marks = groups.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), segments - 1))).join(sizes, ["lang", "segment"])
    marks = marks.withColumn("term", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long"))
    own, last = F.floor(F.col("group") / SOURCES), F.floor((F.col("groups") - 1) / SOURCES)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    columns = [*known, "segment", "term", "n", "total"]
    dealt = cells.select(*columns).unionByName(marks.select(*columns)).withColumn("_tile", F.explode(tiles))
    dealt = dealt.select("lang", "segment", "group", "size", "term", "n", "total", "_tile.*")
    prices = dealt.groupBy("lang", "segment", "i", "j").applyInArrow(_segment, "lang string, group long, other long, value long")
    name = groups.select("lang", "group", "source")
    prices = prices.groupBy("lang", "group", "other").agg(F.sum("value").alias("value"))
    met = name.join(name.select("lang", F.col("group").alias("other"), F.col("source").alias("item")), "lang").filter("group <> other")
    pairs = met.join(prices, ["lang", "group", "other"], "left").fillna(0, ["value"])

    def share(n: str, size: str) -> F.Column:
        return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * {UNIT}) div cast({size} as decimal(20, 0))")

    terms = counts.join(groups.drop("group", "groups"), ["lang", "source"])
    terms = terms.withColumn("p", share("n", "size")).withColumn("q", share("total", "(lang_n + v)")).filter("p > q")
    terms = terms.withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by)).select(*out)
    terms = terms.withColumn("part", F.lit("term")).withColumn("item", F.col("term")).withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(terms.filter(F.col("rank") <= top).select(*out))
