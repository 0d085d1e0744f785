"""Suffix arrays by grouping suffixes on their Lyndon prefixes, and repeats found with them.

``suffix_array`` sorts one text in lists. ``suffix_arrays`` sorts many texts at once: each step takes the
next group of every text, in NumPy. Both construct the same groups in the same order.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of ``text`` in ascending order; the last symbol must be its only smallest one.

    Groups start as the symbols. They are taken in descending order: each member of a group finds its
    previous position of a lower group through the pointers known so far, and the positions found
    move, by how many members point to them, into new groups right after their own. In the end each
    group holds the suffixes with one Lyndon prefix; passing through the array once then emits each
    group's order, without names or recursion.
    """
    n = len(text)
    symbols = sorted(set(text))
    place = {c: i for i, c in enumerate(symbols)}
    group = [place[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    lower, upper = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    upper[-1] = -1
    done = [False] * len(symbols)
    previous = [-1] * n
    now = len(symbols) - 1
    while now >= 0:
        done[now] = True
        counts: dict[int, int] = {}
        for s in members[now]:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in counts.items():
            moved.setdefault((group[p], k), []).append(p)
        for g, k in sorted(moved, key=lambda x: -x[1]):
            found = moved[g, k]
            if len(found) == len(members[g]):
                continue  # the whole group moves: it keeps its place
            found.sort()
            gone = set(found)
            members[g] = [p for p in members[g] if p not in gone]
            new = len(members)
            members.append(found)
            done.append(False)
            lower.append(g)
            upper.append(upper[g])
            if upper[g] >= 0:
                lower[upper[g]] = new
            upper[g] = new
            for p in found:
                group[p] = new
        now = lower[now]
    start, g, at = [0] * len(members), 0, 0
    while lower[g] >= 0:
        g = lower[g]
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = upper[g]
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    start[group[n - 1]] += 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            order[start[group[s]]] = s
            start[group[s]] += 1
            s = previous[s]
    return order


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after another, and the range each belongs to."""
    sizes = last - first
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (first - np.cumsum(sizes) + sizes)[owner], owner


def _edges(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def suffix_arrays(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For texts that fill ``text`` from 1 on, longest first: their suffixes in order, in each text's own range.

    A text's last symbol is its only smallest one; place 0 stands for none. Groups are ranges of ``order``,
    named by their starts; what moves out of a group goes to its upper end, most pointed to uppermost.
    """
    n = len(text)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    key = owner * (int(text.max()) + 1) + text[1:]
    order = np.append(0, np.argsort(key, kind="stable") + 1)
    key = np.sort(key)
    group, size, at = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts = _edges(key) + 1
    size[starts] = np.diff(np.append(starts, n))
    group[order[1:]] = np.repeat(starts, size[starts])
    at[order] = np.arange(n)
    previous, moves = np.zeros(n, np.int64), np.zeros(n, bool)
    now, now_begin = end.copy(), begin
    while len(now):
        low = group[order[now - 1]]
        spots, which = _ranges(low, now)
        members, least = order[spots], low[which]
        lower = members - 1
        previous[members] = lower
        todo = np.flatnonzero(group[lower] >= least)
        while len(todo):  # pointers of this group's members jump along with those of done groups
            lower[todo] = previous[lower[todo]]
            previous[members[todo]] = lower[todo]
            todo = todo[group[lower[todo]] >= least[todo]]
        found = np.sort(lower[lower >= now_begin[which]])
        if len(found):
            cut = _edges(found)
            count, found = np.diff(np.append(cut, len(found))), found[cut]
            rank = np.lexsort((count, group[found]))
            found, count = found[rank], count[rank]
            old = group[found]
            cut = _edges(old)
            moving = np.diff(np.append(cut, len(old)))
            upper = old[cut] + size[old[cut]] - moving
            target = np.arange(len(old)) + np.repeat(upper - cut, moving)
            moves[found] = True
            holes = np.sort(at[found[at[found] < np.repeat(upper, moving)]])
            taken = target[~moves[order[target]]]
            moves[found] = False
            stay = order[taken]
            order[holes], at[stay] = stay, holes
            order[target], at[found] = found, target
            size[old[cut]] -= moving
            cut = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (count[1:] != count[:-1])))
            sizes = np.diff(np.append(cut, len(old)))
            size[target[cut]] = sizes
            group[found] = np.repeat(target[cut], sizes)
        left = low > now_begin
        now, now_begin = low[left], now_begin[left]

    cursor, placed = np.arange(n), np.zeros(n, bool)
    placed[0] = placed[end - 1] = True
    order[begin] = end - 1
    cursor[begin] += 1
    lengths = end - begin
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than the step
    for i in range(int(lengths[0])):
        suffix = order[begin[: active[i]] + i] - 1
        suffix = suffix[~placed[suffix]]
        while len(suffix):
            placed[suffix] = True
            spot = group[suffix]
            order[cursor[spot]] = suffix
            cursor[spot] += 1
            suffix = previous[suffix]
            suffix = suffix[~placed[suffix]]
    return order


FEW = 1  # so many times the longest text's symbols have to be in a batch to be worth the steps
ALONE = 1 << 14  # symbols up to which a text that is alone is sorted in lists
BATCH = 1 << 20


def repeated_starts(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """Per group and text: is the string of ``length`` at each start also at another start of the group?"""
    joined = []
    for texts in groups:
        parts = [x for t in texts for x in (np.frombuffer(t, np.uint8).astype(np.int64) + 2, [1])]
        joined.append(np.concatenate([*parts, [0]]).astype(np.int64))
    longest = sorted(range(len(groups)), key=lambda g: -len(joined[g]))
    out: list[list[np.ndarray]] = [[] for _ in groups]
    total, at = np.append(0, np.cumsum([len(joined[g]) for g in longest])), 0
    while at < len(longest):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + BATCH, "right")) - 1)
        if total[upto] - total[at] < FEW * len(joined[longest[at]]):
            upto = at + 1
        some = longest[at:upto]
        text = np.concatenate([[0], *(joined[g] for g in some)])
        end = np.cumsum([len(joined[g]) for g in some]) + 1
        begin = end - [len(joined[g]) for g in some]
        alone = len(some) == 1 and len(text) <= ALONE
        order = np.append(0, np.array(suffix_array(text[1:].tolist())) + 1) if alone else suffix_arrays(text, begin, end)
        again = _repeated(text, order, length)
        for g, b in zip(some, begin.tolist()):
            for t in groups[g]:
                out[g].append(again[b : b + max(len(t) - length + 1, 0)])
                b += len(t) + 1
        at = upto
    return out


def _repeated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Does a start share ``length`` symbols, none of them a separator, with a neighbour in its text's order?"""
    again = np.zeros(len(text), bool)
    if len(text) < length:
        return again
    ends = np.append(0, np.cumsum(text < 2))
    whole = np.zeros(len(text), bool)
    whole[: len(text) - length + 1] = ends[length:] == ends[:-length]
    left, right = order[:-1], order[1:]
    both = whole[left] & whole[right] & (text[left] == text[right])
    left, right = left[both], right[both]
    strings = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), length)
    for lo in range(0, len(left), 1 << 13):
        a, b = left[lo : lo + (1 << 13)], right[lo : lo + (1 << 13)]
        same = (strings[a] == strings[b]).all(axis=1)
        again[a[same]] = again[b[same]] = True
    return again
