"""Filter interaction audit: what each filter removes after others, in every order of the filters.

Method: a table-driven byte transducer.  One finite-state pass over the UTF-8 bytes looks up
each byte's class, and for (state, class) what the byte does: begin or end a word, count as a
code point, a capital or a symbol.  The next state depends on the class alone, so the states
of all bytes of a batch are looked up at once.  The spans of words go into an open hash table; a
hit counts as the same word only after its bytes are verified, so any hash will do.

A document's failing filters are a bit mask.  Documents are counted by part, mask and labels;
the orders of the filters are applied to those few counts.

Shuffles: rows of a hash and some numbers for each document.  Equal texts are counted
before they meet, so a text that a third of all documents share is a few rows, and the
least id of a text is found among those rows.

Defined cases: a null text is empty, a null part is the empty string; a document without
label is neither good nor toxic, one with several is what any of them says; a null id is
no copy of anything, and nothing is a copy of it; rows that repeat an id are not smaller
than each other, and count each; an empty table gives an empty table; other columns
pass through ``measure`` (those named like its results are replaced) and don't matter to ``audit``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .shared import map_arrow, others, quoted

SYMBOLS = b"#$%&*|"
_SLICE = 4 << 20

# Classes of bytes, states, and what a byte does.
_WHITE, _CAPITAL, _SYMBOL, _TAIL, _OTHER = range(5)
_OUTSIDE, _INSIDE = range(2)
_BEGINS, _ENDS, _IS_CAPITAL, _IS_SYMBOL, _IS_TAIL = 1, 2, 4, 8, 16
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE
_CLASS[65:91] = _CAPITAL
_CLASS[np.frombuffer(SYMBOLS, np.uint8)] = _SYMBOL
_CLASS[0x80:0xC0] = _TAIL
_NEXT = np.array([_OUTSIDE, _INSIDE, _INSIDE, _INSIDE, _INSIDE], np.uint8)
_DOES = np.array([[0, _BEGINS | _IS_CAPITAL, _BEGINS | _IS_SYMBOL, _BEGINS | _IS_TAIL, _BEGINS], [_ENDS, _IS_CAPITAL, _IS_SYMBOL, _IS_TAIL, 0]], np.uint8).ravel()
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def _transduce(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte does, and the begin and end of each word."""
    kind = _CLASS[data]
    state = np.empty(len(data), np.uint8)
    state[:1] = _OUTSIDE
    state[1:] = _NEXT[kind[:-1]]
    full = np.flatnonzero(np.diff(off))
    state[off[full]] = _OUTSIDE
    does = _DOES[state * np.uint8(5) + kind]
    last = off[full + 1][kind[off[full + 1] - 1] != _WHITE]  # words that a document's end ends
    return does, np.flatnonzero(does & _BEGINS), np.sort(np.concatenate((np.flatnonzero(does & _ENDS), last)))


class _Spans:
    """The bytes of words: the first and last eight of each are at hand, the rest is compared where those agree."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray):
        padded = np.concatenate((np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)))
        self.eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))  # the eight bytes from each byte on
        self.begin, self.length, self.doc = begin, end - begin, doc
        self.head = self.eight[begin + 8] & _LOW_BYTES[np.minimum(self.length, 8)]
        self.tail = np.where(self.length > 8, self.eight[end], np.uint64(0))
        self.hash = tv.mix(self.head ^ tv.mix(self.tail + (doc.astype(np.uint64) << np.uint64(24)) + self.length.astype(np.uint64)))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a and b are the same bytes of the same document."""
        result = (self.doc[a] == self.doc[b]) & (self.length[a] == self.length[b]) & (self.head[a] == self.head[b]) & (self.tail[a] == self.tail[b])
        live, at = np.flatnonzero(result & (self.length[a] > 16) & (a != b)), 8
        while len(live):
            equal = self.eight[self.begin[a[live]] + at + 8] == self.eight[self.begin[b[live]] + at + 8]
            result[live[~equal]] = False
            at += 8
            live = live[equal & (self.length[a[live]] - 8 > at)]
        return result


def _first_seen(spans: _Spans) -> np.ndarray:
    """One word of each set of equal ones: inserts all spans into a hash table, a probe of all that wait at a time."""
    n = len(spans.begin)
    size = 1 << max(4, (2 * n).bit_length())
    table = np.full(size, -1, np.int64)
    wait, slot = np.arange(n), (spans.hash & np.uint64(size - 1)).astype(np.int64)
    found = []
    while len(wait):
        free = table[slot] < 0
        table[slot[free]] = wait[free]
        owner = table[slot]
        found.append(wait[owner == wait])
        go = ~spans.same(wait, owner)
        wait, slot = wait[go], (slot[go] + 1) & (size - 1)
    return np.concatenate(found) if found else wait


def _totals(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, off))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, data, off in tv.slices(batch.column(batch.num_columns - 1), _SLICE):
            does, begin, end = _transduce(data, off)
            doc = np.searchsorted(off, begin, side="right") - 1
            seen = _first_seen(_Spans(data, begin, end, doc))
            n = to - row
            values = np.bincount(doc, minlength=n), np.bincount(doc[seen], minlength=n), _totals(does & _IS_CAPITAL, off), np.diff(off) - _totals(does & _IS_TAIL, off), _totals(does & _IS_SYMBOL, off)
            own = batch.slice(row, n)
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], *[pa.array(v, pa.int64()) for v in values]], names=[*batch.schema.names[:-1], *_MEASURES])


_MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their text, with n_words, n_distinct (words), n_capitals (A-Z), n_points (code points) and n_symbols."""
    own = others(docs, text, *_MEASURES)
    return map_arrow(docs, own, [F.col(quoted(text)).alias("body")], _measure, ", ".join(f"{c} long" for c in _MEASURES))


#: Conditions under which a document fails, on the columns of ``measure``.
FILTERS: dict[str, str] = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
}
COPIES = "E"


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, copies: str = COPIES, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): the number of documents by the filters that they fail; bit k of ``mask`` is the k-th filter, ``copies`` the last."""
    filters = FILTERS if filters is None else filters
    name, body = F.col(quoted(part)).cast("string"), F.coalesce(F.col(quoted(text)), F.lit(""))
    slim = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.coalesce(name, F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("hash"), body.alias("text"))
    bit = lambda k, failing: F.when(failing, 1 << k).otherwise(0)
    mask = sum((bit(k, F.expr(f)) for k, f in enumerate(filters.values())), F.lit(0))
    rows = measure(slim).select("id", "part", "hash", mask.alias("mask")).groupBy("hash", "id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without id find no label; a second key, 0 for any id, spreads them over the join's tasks.
    spread = lambda otherwise: F.coalesce(F.pmod("id", F.lit(1)), otherwise).alias("spread")
    no = F.lit(False)
    rows = rows.select("*", spread(F.xxhash64("hash"))).join(said.select("*", spread(F.lit(0).cast("long"))), ["id", "spread"], "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    alike = rows.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("hash"))
    alike = alike.withColumn("original", F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("original").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    split = alike.select("part", "good", "toxic", F.inline(both))
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps(letters: list[str]) -> Column:
    """All (filter_order, step, bit of its filter, bits of those before it)."""
    bits = {c: 1 << k for k, c in enumerate(letters)}
    rows = [(order, step, bits[order[step]], sum(bits[c] for c in order[:step])) for order in map("".join, permutations(letters)) for step in range(len(letters))]
    text = ",".join(f"{order}:{step + 1}:{bit}:{before}" for order, step, bit, before in rows)
    parts = F.transform(F.split(F.lit(text), ","), lambda x: F.split(x, ":"))
    return F.transform(parts, lambda p: F.struct(p[0].alias("filter_order"), p[1].cast("int").alias("step"), p[2].cast("int").alias("bit"), p[3].cast("int").alias("before")))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, copies: str = COPIES, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step (from 1; its filter is that letter of the order).

    kept after the step; removed by it; redundant (failing its filter, removed before); unique_fails (failing no
    other); good_lost and toxic_lost of the removed; shapley: what its filter removes, summed over all orders.
    """
    letters = [*(FILTERS if filters is None else filters), copies]
    if len(letters) > 7 or any(len(c) != 1 for c in letters):
        raise ValueError("filters are named by single letters; all orders of at most 7 are made")
    counts = failures(docs, labels, filters, copies, doc_id, text, part)
    n, fails = F.col("n"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    before, after = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit").bitwiseOR(F.col("before"))) != 0
    total = lambda when: F.sum(F.when(when, n).otherwise(0))
    removed = fails & ~before
    stepped = counts.select("*", F.inline(_steps(letters)))
    return stepped.groupBy("part", "filter_order", "step").agg(
        total(~after).alias("kept"),
        total(removed).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in an equal part of the orders.
        F.sum(F.when(fails, n * F.lit(factorial(len(letters))).cast("long") / F.bit_count("mask")).otherwise(0)).cast("long").alias("shapley"),
    )
