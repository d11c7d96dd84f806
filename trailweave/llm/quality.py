"""Quality rules: repetition counts and the divergence of a text from its language.

Method: a document's histograms of character classes and of common words are
compared with the references of the languages by the Jensen-Shannon distance (the
square root of the divergence in bits, between 0 and 1).  The references come from
all long enough documents of each language label that has ``MIN_DOCS`` of them, in two
passes whose results are some short rows for each label.  The first counts, in a grouped
job, how many of those documents hold each word; a label's common words are the
``COMMON`` that most hold (of equal ones the first in byte order).  The second takes, for
each character class, the median share (junk documents don't move it), and for the
common words the mean share.  A document is held against the reference nearest to it, so
a wrong label rejects nothing.  A document whose own label is null or has no
reference passes on the base rule alone, as nothing is known of its language.

Length guards: a histogram of few words says little, so the word test needs
``MIN_WORDS`` words and the character test ``MIN_CHARS`` code points in words.

Defined cases: null text has no words and fails the base rule; a null language
counts for no reference and is held against none; a corpus without any reference (few long
documents of each language, or an empty table) is judged by the base rule alone; repeated
rows are judged alike, and count as often as they stand there in the references; a null id
is passed through, as are all other columns, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .shared import map_arrow, others, pick, worker_tables

MIN_WORDS, MIN_CHARS = 60, 200
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.15, 0.35
MIN_DOCS, COMMON = 20, 25
_SLICE = 1 << 20  # bytes of text handled at once
_HELD, _ROWS = 400_000, 1 << 15  # words held before they are merged, and rows handed on at once
_STEPS = 1000  # shares of character classes are counted in steps of 1/_STEPS
_UNIT = 1 << 24  # word shares are summed as integers, so that the order of tasks doesn't matter

#: Classes: lower-case, upper-case, other letters (any code point beyond ASCII), marks of prose, symbols, controls;
#: digits count in none, as clean prose holds many or few of them.
_CLASSES = 6
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[0xC0:] = 0, 1, 2
_CLASS[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 3
_CLASS[np.frombuffer(b"#*$%&|<>!~^_=+{}[]@/\\`", np.uint8)] = 4
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TAIL = (np.arange(256) & 0xC0) == 0x80
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _histograms(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in words by class (the last column: digits), words by common word (the last bin: all others), and the number of words."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    seen = ~(_SPACE[data] | _TAIL[data])
    kind = np.where(_DIGIT, _CLASSES, _CLASS)
    chars = np.bincount(doc[seen] * (_CLASSES + 1) + kind[data[seen]], minlength=n * (_CLASSES + 1)).reshape(n, _CLASSES + 1)
    words = tv.Words(data, off, lower=True)
    bins = len(vocabulary) + 1
    at = np.searchsorted(vocabulary, words.hashes)
    at[at == len(vocabulary)] = 0
    at = np.where(vocabulary[at] == words.hashes, at, bins - 1) if len(vocabulary) else at
    common = np.bincount(words.doc * bins + at, minlength=n * bins).reshape(n, bins)
    return chars, common, words.counts


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def _of(common: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The bins of one language's common words; all other words are in the last."""
    own = common[:, columns]
    return np.column_stack((own, common.sum(axis=1) - own.sum(axis=1)))


class _Spread:
    """Long documents that hold each word, by label: gathered over slices as columns, merged when there are many, so that few rows of a task say the same word."""

    def __init__(self):
        self.labels: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.size = 0
        self.docs = np.empty(0, np.int64)

    def add(self, langs: np.ndarray, long: np.ndarray, words: tv.Words) -> None:
        code = np.array([self.labels.setdefault(x, len(self.labels)) if x is not None else -1 for x in langs.tolist()], np.int64)
        code[~long] = -1
        inside = np.flatnonzero(code[words.doc] >= 0)
        hashes, doc, label = words.hashes[inside], words.doc[inside], code[words.doc[inside]]
        order = np.lexsort((doc, hashes, label))
        hashes, doc, label = hashes[order], doc[order], label[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (label[1:] != label[:-1])
        own = new.copy()
        own[1:] |= doc[1:] != doc[:-1]
        at = inside[order[new]]
        if len(at):
            length = words.end[at] - words.begin[at]
            names = _LOWER[words.data[tv.gather(words.begin[at], length)]]
            self._keep(label[new], hashes[new], np.add.reduceat(own.astype(np.int64), np.flatnonzero(new)), names, length)
        self.docs = np.pad(self.docs, (0, len(self.labels) - len(self.docs))) + np.bincount(code[code >= 0], minlength=len(self.labels))

    def _keep(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def _merged(self) -> tuple:
        label, hashes, n, names, length = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((hashes, label))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (label[order][1:] != label[order][:-1])
        at = order[new]
        begin = np.cumsum(length) - length
        return label[at], hashes[at], np.add.reduceat(n[order], np.flatnonzero(new)), names[tv.gather(begin[at], length[at])], length[at]

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """(language, word, long documents with it) once there are many, and of the rest at the end; the null word counts the long documents."""
        if self.parts and (last or self.size > _HELD):
            merged = self._merged()
            self.parts, self.size = [], 0
            if not last and len(merged[0]) < _HELD // 2:
                self._keep(*merged)
                return
            label, _, n, names, length = merged
            labels = pa.array(list(self.labels))
            ends = np.concatenate(([0], np.cumsum(length)))
            for a in range(0, len(label), _ROWS):
                b = min(a + _ROWS, len(label))
                words = pa.StringArray.from_buffers(b - a, pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(names[ends[a] : ends[b]])))
                yield pa.RecordBatch.from_arrays([labels.take(pa.array(label[a:b])), words, pa.array(n[a:b])], names=["lang", "word", "n"])
        if last and self.labels:
            held = np.flatnonzero(self.docs)
            yield pa.RecordBatch.from_arrays([pa.array(list(self.labels), pa.string()).take(pa.array(held)), pa.nulls(len(held), pa.string()), pa.array(self.docs[held])], names=["lang", "word", "n"])


def _spread(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    worker_tables("quality")
    spread = _Spread()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for row, to, data, off in tv.slices(batch.column(1), _SLICE):
            words = tv.Words(data, off, lower=True)
            spread.add(langs[row:to], words.counts >= min_words, words)
            yield from spread.rows()
    yield from spread.rows(last=True)


def common_words(docs: DataFrame, min_words: int = MIN_WORDS) -> dict[str, list[str]]:
    """The words that most long documents of a label hold, for each label that has enough of them; COMMON + 1 short rows of each such label reach the driver."""
    spread = docs.select("lang", "text").mapInArrow(lambda it: _spread(it, min_words), "lang string, word string, n long")
    counted = spread.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("word").isNotNull(), F.desc("n"), "word"))
    first = counted.withColumn("rank", rank).where(F.col("rank") <= COMMON + 1)
    enough = first.withColumn("docs", F.max(F.when(F.col("word").isNull(), F.col("n"))).over(Window.partitionBy("lang"))).where((F.col("docs") >= MIN_DOCS) & F.col("word").isNotNull())
    found: dict[str, list] = {}
    for r in enough.orderBy("lang", "rank").collect():
        found.setdefault(r.lang, []).append(r.word)
    return found


def _hashes(words: list[str]) -> np.ndarray:
    one = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(tv.Words(one, np.array([0, len(one)]), lower=True).hashes)


def _gather(batches: Iterator[pa.RecordBatch], min_words: int, vocabulary: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    worker_tables("quality")
    sums = {lang: [0, np.zeros(_CLASSES * (_STEPS + 1), np.int64), np.zeros(len(own) + 1, np.int64)] for lang, own in columns.items()}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for row, to, data, off in tv.slices(batch.column(1), _SLICE):
            chars, common, n = _histograms(data, off, vocabulary)
            for lang, held in sums.items():
                of = (langs[row:to] == lang) & (n >= min_words)
                held[0] += int(of.sum())
                steps = np.rint(_share(chars[of, :-1]) * _STEPS).astype(np.int64) + np.arange(_CLASSES) * (_STEPS + 1)
                held[1] += np.bincount(steps.ravel(), minlength=len(held[1]))
                held[2] += np.rint(_share(_of(common[of], columns[lang])) * _UNIT).astype(np.int64).sum(axis=0)
    rows = [(lang, n, chars.tolist(), common.tolist()) for lang, (n, chars, common) in sums.items() if n]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["lang", "docs", "chars", "words"])


def references(docs: DataFrame, lang: str = "lang", text: str = "text", min_words: int = MIN_WORDS) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The vocabulary, and (character reference, word reference, its words' places in the vocabulary) of each language; some short rows of each reach the driver."""
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    lists = {k: _hashes(words) for k, words in common_words(docs, min_words).items()}
    if not lists:
        return np.empty(0, np.uint64), {}
    vocabulary = np.unique(np.concatenate(list(lists.values())))
    columns = {k: np.searchsorted(vocabulary, own) for k, own in lists.items()}
    parts = docs.mapInArrow(lambda it: _gather(it, min_words, vocabulary, columns), "lang string, docs long, chars array<long>, words array<long>")
    long = parts.select("lang", F.posexplode(F.concat("chars", "words")).alias("bin", "n"))
    found: dict[str, np.ndarray] = {}
    for r in long.groupBy("lang", "bin").agg(F.sum("n").alias("n")).where("n > 0").collect():
        found.setdefault(r.lang, np.zeros(_CLASSES * (_STEPS + 1) + len(lists[r.lang]) + 1))[r.bin] = r.n
    return vocabulary, {k: (*_reference(found[k]), columns[k]) for k in sorted(found)}


def _reference(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars = _CLASSES * (_STEPS + 1)
    steps = np.cumsum(counts[:chars].reshape(_CLASSES, _STEPS + 1), axis=1)
    return _share((2 * steps >= steps[:, -1:]).argmax(axis=1).astype(float)), _share(counts[chars:])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    log = lambda x: np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1))
    return np.sqrt(np.clip((p * log(p) + q * log(np.broadcast_to(q, p.shape))).sum(axis=-1) / 2, 0, 1))


def _repeats(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words in repeated 8-word windows, and repeated lines, of each document."""
    n = len(off) - 1
    words = tv.Words(data, off)
    hashes, at = words.runs(8)
    covered = np.zeros(n, np.int64)
    if len(hashes):
        key = tv.mix(hashes + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + 8, -1)
        covered = np.bincount(words.doc[np.cumsum(edge)[:-1] > 0], minlength=n)
    cuts = np.unique(np.concatenate((off, np.flatnonzero(data == 10) + 1)))
    lines = np.zeros(n, np.int64)
    if len(cuts) > 1:
        begin, stop = cuts[:-1], cuts[1:] - (data[np.maximum(cuts[1:] - 1, 0)] == 10)
        doc = np.searchsorted(off, begin, side="right") - 1
        has = np.searchsorted(words.begin, stop) > np.searchsorted(words.begin, begin)
        begin, stop, doc = begin[has], stop[has], doc[has]
        text = data.tobytes()
        seen: set = set()
        for b, e, d in zip(begin.tolist(), stop.tolist(), doc.tolist(), strict=True):
            key = (d, text[b:e])
            if key in seen:
                lines[d] += 1
            else:
                seen.add(key)
    return words.counts, covered, lines


def _judge(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, refs: dict, min_words: int, min_chars: int, max_char: float, max_word: float) -> Iterator[pa.RecordBatch]:
    worker_tables("quality")
    for batch in batches:
        langs = batch.column(batch.num_columns - 1).to_pylist()
        for row, to, data, off in tv.slices(batch.column(batch.num_columns - 2), _SLICE):
            n = to - row
            n_words, n_repeat, n_dup = _repeats(data, off)
            chars, common, _ = _histograms(data, off, vocabulary)
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))[off]
            word_chars = chars.sum(axis=1)
            failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
            if refs:
                by_char = by_word = np.full(n, np.inf)
                for c, w, at in refs.values():
                    by_char, by_word = np.minimum(by_char, distance(_share(chars[:, :-1]), c)), np.minimum(by_word, distance(_share(_of(common, at)), w))
            else:
                by_char = by_word = np.zeros(n)
            held = np.array([x in refs for x in langs[row:to]], bool)
            kept = ~failed & ~(held & (word_chars >= min_chars) & (by_char > max_char)) & ~(held & (n_words >= min_words) & (by_word > max_word))
            values = n_words, word_chars, np.diff(symbols), n_dup, n_repeat, by_char, by_word, failed, kept
            yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns[:-1], *map(pa.array, values)], names=batch.schema.names[:-1] + [x.split()[0] for x in _RESULT.split(", ")])


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``docs`` with the counts, the two distances, base_failed and kept; columns of those names are replaced."""
    vocabulary, refs = references(docs, lang, text, min_words)
    results = [x.split()[0] for x in _RESULT.split(", ")]
    own = others(docs, *results)
    rest = others(docs, text, *results)  # the text itself travels once
    made = map_arrow(docs, rest, [F.col(text).alias("body"), F.col(lang).cast("string").alias("lang")], lambda it: _judge(it, vocabulary, refs, min_words, min_chars, max_char, max_word), f"body string, {_RESULT}")
    return made.toDF(*rest, text, *results).select(*pick(own), *results)
