"""Periodic runs of words: maximal stretches that repeat with a period at least ``REPEATS`` times.

Method: maximal pairs of the words, from a bottom-up traversal of the LCP-interval tree.  A run
of period q over length l is the maximal pair of its first position and that q words
later, with a common extension of l - q words: its left words differ (or it begins the
text), its right words differ (or it ends it).  So the maximal pairs whose distance is
at most a (REPEATS - 1)th of their common extension are exactly the runs, and nothing has to be extended.

The common extension of a run is at least max((REPEATS - 1) q, MIN_LENGTH - q) words, for the production values 5;
suffixes that share fewer with any other of their document are left out, the others are sorted
by prefix doubling from that width.  A stack over the array of common prefixes gives the LCP-intervals bottom-up.  Where intervals merge, the smaller ones' positions join the largest one's, so a
position joins no more lists than the logarithm of their number; heavy paths tell which.  The
lists keep each position with its class, the word to its left.  Two occurrences
of an extension that lie as near as a run wants have none between them when they meet, so the
neighbours in a list, of different classes, are the pairs: each position meets the nearest one on each side that is
in the list by then.  Of pairs on one stretch (periods q, 2q, ...) the least period counts.

Words are compared by 64-bit hashes of their bytes.

Defined cases: null text has no words; a text of fewer words than ``MIN_LENGTH`` has no run; runs that
overlap are each found; a word that any run holds after its first period is dropped once;
rows don't depend on each other, so repeated rows and null ids don't matter; other columns pass through,
columns named like the results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import map_arrow, others, quoted

MIN_LENGTH, REPEATS = 6, 4
_SLICE = 2 << 20
_ALONE = np.iinfo(np.int64).max  # the common prefix of a path's own lowest leaf with itself


def _shared_starts(words: tv.Words, width: int) -> np.ndarray:
    """Positions whose next ``width`` words also stand elsewhere in the same document."""
    hashes, at = words.runs(width)
    if not len(at):
        return at
    key = tv.mix(hashes + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    return np.sort(at[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]])


def _suffixes(words: tv.Words, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their suffixes, the common prefix of each with the one before; 0 where that is less than ``width`` or of another document)."""
    stop = words.first[1:][words.doc]  # the end of each word's document
    near = np.unique(np.concatenate((starts, np.minimum(starts + width, len(stop) - 1))))
    word = lambda at, ends: np.where(at < ends, words.hashes[np.minimum(at, len(stop) - 1)], np.uint64(0))
    ends = stop[near]
    order = np.lexsort([word(near + j, ends) for j in reversed(range(width))] + [words.doc[near]])
    columns = np.stack([words.doc[near].astype(np.uint64), *[word(near + j, ends) for j in range(width)]])[:, order]
    rank = np.empty(len(near), np.int64)
    rank[order] = np.flatnonzero(new := np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(axis=0))))[np.cumsum(new) - 1]
    place = np.full(len(stop) + 1, -1, np.int64)
    place[near] = np.arange(len(near))
    levels, reach = [rank], width
    while True:
        tied = new.copy()
        tied[:-1] &= new[1:]
        tied = np.flatnonzero(~tied)  # places in the order that share their rank
        if not len(tied):
            break
        at = order[tied]
        after = near[at] + reach
        nxt = np.where(after < ends[at], place[np.minimum(after, len(stop))], -1)
        nxt = np.where(nxt >= 0, rank[nxt], -1)
        own = rank[at]
        again = np.lexsort((nxt, own))
        at, nxt, own = at[again], nxt[again], own[again]
        order[tied] = at
        new = np.ones(len(near), bool)
        new[tied[1:]] = (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])
        rank = rank.copy()
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        levels.append(rank)
        reach *= 2
    a, b = near[order[:-1]].copy(), near[order[1:]].copy()
    end_a, end_b = ends[order[:-1]], ends[order[1:]]
    common = np.zeros(len(a), np.int64)
    for rank in reversed(levels):
        reach //= 2 if rank is not levels[-1] else 1
        i, j = place[np.minimum(a, len(stop))], place[np.minimum(b, len(stop))]
        equal = (a < end_a) & (b < end_b) & (i >= 0) & (j >= 0)
        equal &= rank[i] == rank[j]
        for x in (a, b, common):
            x[equal] += reach
    live = np.flatnonzero(common)
    for _ in range(width - 1):
        i, j = a[live], b[live]
        ok = (i < end_a[live]) & (j < end_b[live])
        live = live[ok]
        live = live[words.hashes[i[ok]] == words.hashes[j[ok]]]
        for x in (a, b, common):
            x[live] += 1
    return near[order], np.concatenate(([0], common))


def _intervals(common: list[int]) -> tuple[np.ndarray, ...]:
    """The LCP-interval tree, bottom-up: (parent of each leaf, parent of each interval, common prefix, number of leaves); -1 above the top."""
    prefix: list[int] = []
    first: list[int] = []
    size: list[int] = []
    parent: list[int] = []
    leaf_parent = [-1] * len(common)
    stack: list[int] = []
    for k in range(len(common)):
        nxt = common[k + 1] if k + 1 < len(common) else 0
        here = common[k]
        # The leaf belongs to the deeper of the intervals on its sides.
        if nxt > here or (not stack and nxt):
            prefix.append(nxt)
            first.append(k)
            size.append(0)
            parent.append(-1)
            stack.append(len(prefix) - 1)
        if stack:
            leaf_parent[k] = stack[-1]
        while stack and prefix[stack[-1]] > nxt:
            done = stack.pop()
            size[done] = k + 1 - first[done]
            if stack and prefix[stack[-1]] >= nxt:
                parent[done] = stack[-1]
            elif nxt:
                prefix.append(nxt)
                first.append(first[done])
                size.append(0)
                parent.append(-1)
                stack.append(len(prefix) - 1)
                parent[done] = stack[-1]
    return np.array(leaf_parent, np.int64), np.array(parent, np.int64), np.array(prefix, np.int64), np.array(size, np.int64)


def _joins(leaf_parent: np.ndarray, parent: np.ndarray, prefix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(list, leaf, common prefix, interval it comes from) for every time that a leaf joins a list: its own path's, and those of the larger intervals that its path joins."""
    n, m = len(leaf_parent), len(parent)
    up = np.concatenate((parent, np.where(leaf_parent >= 0, leaf_parent, -1)))  # intervals first, then leaves
    sizes = np.concatenate((size, np.ones(n, np.int64)))
    child = np.flatnonzero(up >= 0)
    order = child[np.lexsort((sizes[child], up[child]))]
    heavy = order[np.concatenate((up[order][1:] != up[order][:-1], [True]))] if len(order) else order
    head = np.arange(m + n)
    head[heavy] = up[heavy]
    while True:
        above = head[head]
        if (above == head).all():
            break
        head = above
    at = np.arange(m, m + n)
    lists, leaves, shared, came = [head[at]], [np.arange(n)], [np.full(n, _ALONE)], [at]
    leaf = np.arange(n)
    while True:
        tops = head[at]
        go = up[tops] >= 0
        at, leaf = up[tops[go]], leaf[go]
        if not len(at):
            break
        came.append(tops[go])
        lists.append(head[at])
        leaves.append(leaf)
        shared.append(prefix[at])
    return np.concatenate(lists), np.concatenate(leaves), np.concatenate(shared), np.concatenate(came)


def _nearest(lists: list[int], shared: list[int]) -> list[int]:
    """For each entry, the nearest one before it in its list that is in it no later (whose common prefix is no shorter); -1 if none."""
    found, stack, of = [-1] * len(lists), [], None
    for i, (a, s) in enumerate(zip(lists, shared, strict=True)):
        if a != of:
            stack, of = [], a
        while stack and shared[stack[-1]] < s:
            stack.pop()
        if stack:
            found[i] = stack[-1]
        stack.append(i)
    return found


def find(words: tv.Words, min_length: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of some documents, in order."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    width = min(max((repeats - 1) * q, min_length - q) for q in range(1, min_length + 1))
    starts = _shared_starts(words, width)
    if not len(starts):
        return none
    position, common = _suffixes(words, starts, width)
    kept = (common > 0) | np.append(common[1:] > 0, False)
    position, common = position[kept], common[kept]
    if not len(position):
        return none
    lists, leaf, shared, came = _joins(*_intervals(common.tolist()))
    order = np.lexsort((position[leaf], lists))
    lists, at, shared, came = lists[order], position[leaf[order]], shared[order], came[order]
    left = np.where(at > words.first[words.doc[at]], words.hashes[at - 1], np.uint64(0))
    opens = at == words.first[words.doc[at]]
    pairs = []
    for back in (False, True):
        turn = slice(None, None, -1) if back else slice(None)
        near = np.array(_nearest(lists[turn].tolist(), shared[turn].tolist()))
        near, entry = (np.where(near >= 0, len(lists) - 1 - near, -1)[::-1], np.arange(len(lists))) if back else (near, np.arange(len(lists)))
        ok = near >= 0
        x, y = (entry[ok], near[ok]) if back else (near[ok], entry[ok])  # x stands before y
        both = np.minimum(shared[x], shared[y])
        q = at[y] - at[x]
        good = (came[x] != came[y]) & ((repeats - 1) * q <= both) & (q + both >= min_length) & (q > 0) & (opens[x] | (left[x] != left[y]))
        pairs.append((at[x[good]], (q + both)[good], q[good]))
    start, length, period = (np.concatenate(p) for p in zip(*pairs, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.empty(0, bool)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _runs(batches: Iterator[pa.RecordBatch], min_length: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, data, off in tv.slices(batch.column(batch.num_columns - 1), _SLICE):
            words = tv.Words(data, off)
            start, length, period = find(words, min_length, repeats)
            doc = words.doc[start]
            n = np.bincount(doc, minlength=to - row)
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            stay = np.cumsum(edge)[:-1] == 0
            raw = data.tobytes()
            kept = []
            for d in range(to - row):
                mine = raw[off[d] : off[d + 1]].split()
                kept.append(b" ".join(compress(mine, stay[words.first[d] : words.first[d + 1]]) if n[d] else mine))
            first = start - words.first[doc]
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (first, length, period)], ["start", "length", "period"]))
            own = batch.slice(row, to - row)
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(words.counts, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """The other columns of ``docs`` with n_words, runs (start, length, period: by start, then period) and collapsed.

    A run has ``min_length`` words and ``repeats`` times its least period at least, and no neighbouring word extends
    it.  ``collapsed``: the words, joined by one space, but for those that a run holds after its first period.
    """
    own = others(docs, text, "n_words", "runs", "collapsed")
    return map_arrow(docs, own, [F.col(quoted(text)).alias("body")], lambda it: _runs(it, min_length, repeats), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
