"""Substring dedup: words covered by a word window that an earlier document already holds are removed.

Method: a count-min sketch is the prefilter.  Documents are dealt into chunks by a hash;
each chunk sketches its own windows, the sketches are merged in a shuffle, block by
block, and every chunk gets back which of its entries the merged sketch estimates at two
or more.  Only windows estimated so go on to an exact grouping.  The sketch counts a
window under its *minimizer* (the smallest hash among the word grams inside it):
equal windows have equal minimizers, so an estimate is never below the true count
and no repeated window is lost, while a run of windows needs about a quarter of
the entries.

Sketch: a minimizer's hash names a block and a 32-bit mark, and each block has ``ROWS``
rows of counters that stop at two.  A chunk's sketch is kept sparse, as the sorted marks
of each block; the task of a block adds up the counters of all chunks and answers each
with one bit a mark.  Nothing of it passes through the driver, nothing is broadcast,
and the same path serves every input size: the sketch has ``CELLS_PER_BYTE`` counters a
row for each byte of text, and a block's counters fit one task.

Shuffles: the documents once, by chunk (the three steps that read them share that
exchange), the sparse sketches, the windows estimated as repeated, and the runs that go.

Skew: a chunk sends each distinct window once, for its smallest document; its other
occurrences in that chunk are settled on the spot.  So a window that a third of all
documents share reaches the exact grouping once per chunk.

Defined cases: null text or null id: the row is kept as it is (a null text has no
words; a row without id comes before and after nothing).  Documents shorter than a
window lose nothing.  Rows that repeat an id are not "smaller" than each other;
all are judged against other ids.  An empty table gives an empty table.  Any other
column is passed through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textvec as tv
from .shared import map_arrow, others, pick, worker_tables

WINDOW = 13
GRAM = 7
CELLS_PER_BYTE = 0.16
ROWS = 2
CHUNK_BYTES = 6 << 20
LEAST_BLOCK, LARGEST_BLOCK = 1 << 22, 1 << 26  # counters of a block; between them a 4096th of all
_SEEDS = (0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35)
_RUN_SCHEMA = "h1 long, h2 int, doc long, tkey long, pos int, len int, sure boolean"


def _windows(words: tv.Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and minimizer of every window."""
    hashes, at = words.runs(width)
    if not len(hashes):
        return hashes, at, hashes
    grams, gram_at = words.runs(gram)
    where = np.searchsorted(gram_at, at)
    least = grams[where].copy()
    for j in range(1, width - gram + 1):
        np.minimum(least, grams[where + j], out=least)
    return hashes, at, least


def _keys(least: np.ndarray, doc: np.ndarray, blocks: int) -> np.ndarray:
    """The entries of a chunk's sketch: block << 32 | mark, sorted, each at most twice."""
    if not len(least):
        return np.empty(0, np.uint64)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
    keys = np.sort(_key(least[new], blocks))
    return keys[np.concatenate((np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]))]


def _key(least: np.ndarray, blocks: int) -> np.ndarray:
    x = tv.mix(least ^ np.uint64(_SEEDS[0]))
    return ((x >> np.uint64(32)) * np.uint64(blocks) & np.uint64(0xFFFFFFFF << 32)) | (x & np.uint64(0xFFFFFFFF))


def _cells(marks: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (tv.mix(marks.astype(np.uint64) ^ np.uint64(_SEEDS[1] + row)) % np.uint64(cells)).astype(np.int64)


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of consecutive stretches; ``cuts`` are their borders."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sketch(chunk: pa.Table, body: str, blocks: int, window: int, gram: int) -> pa.Table:
    """A chunk's sketch, sparse: the marks of each block."""
    held = [(least, words.doc[at] + row) for row, words, _, at, least in _slices(chunk, body, window, gram)]
    keys = _keys(*(np.concatenate(x) for x in zip(*held, strict=True)), blocks) if held else np.empty(0, np.uint64)
    block = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.empty(0, np.int64)
    c = chunk.column("c")[0].as_py()
    return pa.table({"block": pa.array(block[starts], pa.int64()), "c": pa.array(np.full(len(starts), c), pa.int64()), "marks": _blobs(keys.astype(np.uint32), np.append(starts, len(keys)))})


def _slices(chunk: pa.Table, body: str, window: int, gram: int) -> Iterator[tuple]:
    """(first row, words, and the windows' hashes, first words and minimizers) of a chunk, some texts at a time."""
    worker_tables("substrings")
    for row, _, data, off in tv.slices(chunk.column(body), _SLICE):
        words = tv.Words(data, off)
        yield row, words, *_windows(words, window, gram)


_SLICE = 1 << 20


def _merge(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Adds up the counters of each block (its sketches arrive together) and answers each chunk: a bit for each mark."""
    at, held = None, []
    counts = np.zeros((ROWS, cells), np.uint8)

    def answers():
        for chunks, sizes, marks in held:
            many = np.ones(len(marks), bool)
            for row in range(ROWS):
                many &= counts[row, _cells(marks, row, cells)] >= 2
            cuts = np.cumsum([0, *sizes])
            bits = [np.packbits(many[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"c": pa.array(chunks, pa.int64()), "block": pa.array([at] * len(chunks), pa.int64()), "bits": tv.blobs(bits)})

    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if at != int(block[a]):
                if held:
                    yield from answers()
                    counts[:] = 0
                at, held = int(block[a]), []
            raw = batch.column(2).slice(a, b - a).to_pylist()
            marks = np.frombuffer(b"".join(raw), np.uint32)
            for row in range(ROWS):
                cell, n = np.unique(_cells(marks, row, cells), return_counts=True)
                counts[row, cell] = np.minimum(counts[row, cell] + np.minimum(n, 2).astype(np.uint8), 2)
            held.append((batch.column(1).slice(a, b - a).to_pylist(), [len(x) // 4 for x in raw], marks))
    if held:
        yield from answers()


def _second_hash(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for j in range(window):
        total = tv.mix(total + hashes[at + j])
    return (total >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _suspects(chunk: pa.Table, answers: pa.Table, body: str, blocks: int, window: int, gram: int) -> pa.Table:
    """The windows of a chunk that the merged sketch estimates as repeated."""
    held = [(row, words.hashes, words.doc[at] + row, at, at - words.first[words.doc[at]], h1, least) for row, words, h1, at, least in _slices(chunk, body, window, gram)] if len(chunk) else []
    held = [x for x in held if len(x[3])]
    if not held:
        return pa.Table.from_batches([], _arrow(_RUN_SCHEMA))
    keys = _keys(np.concatenate([x[6] for x in held]), np.concatenate([x[2] for x in held]), blocks)
    cuts = np.searchsorted(keys, np.unique(keys >> np.uint64(32)) << np.uint64(32)).tolist() + [len(keys)]
    bits = answers.sort_by("block").column("bits").to_pylist()
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=b - a) for x, a, b in zip(bits, cuts[:-1], cuts[1:], strict=True)]).astype(bool)
    wanted = np.unique(keys[many])
    ids, tkeys = (chunk.column(n).to_numpy() for n in ("doc", "tkey"))
    found = []
    for _, hashes, doc, at, pos, h1, least in held:
        key = _key(least, blocks)
        where = np.searchsorted(wanted, key)
        where[where == len(wanted)] = 0
        yes = np.flatnonzero(wanted[where] == key) if len(wanted) else np.empty(0, np.int64)
        found.append((h1[yes], _second_hash(hashes, at[yes], window), ids[doc[yes]], tkeys[doc[yes]], pos[yes]))
    found = [np.concatenate(x) for x in zip(*found, strict=True)]
    return _settle(*found) if len(found[0]) else pa.Table.from_batches([], _arrow(_RUN_SCHEMA))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _settle(h1, h2, doc, tkey, pos) -> pa.Table:
    """Windows of one chunk: those of the smallest document of each go on; occurrences in larger ones are sure to be removed."""
    order = np.lexsort((pos, tkey, doc, h2, h1))
    given = h1, h2, doc, tkey, pos
    h1, h2, doc, tkey, pos = (x[order] for x in given)
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    least = doc[new][np.cumsum(new) - 1]
    go, sure = np.sort(order[doc == least]), doc > least
    d, t, p = (x[sure] for x in (doc, tkey, pos))
    h1, h2, doc, tkey, pos = (x[go] for x in given)  # in the documents' order, in which they compress best
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    starts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)))) if len(d) else np.empty(0, np.int64)
    length = np.diff(np.append(starts, len(d)))
    d, t, p = d[starts], t[starts], p[starts]
    own = tv.mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ t.view(np.uint64) ^ p.astype(np.uint64))
    cat = np.concatenate
    return pa.table(
        {
            "h1": pa.array(cat((h1.view(np.int64), own.view(np.int64)))),
            "h2": pa.array(cat((h2, np.zeros(len(d), np.int32))), pa.int32()),
            "doc": pa.array(cat((doc, d)), pa.int64()),
            "tkey": pa.array(cat((tkey, t)), pa.int64()),
            "pos": pa.array(cat((pos, p)).astype(np.int32)),
            "len": pa.array(cat((np.ones(len(go), np.int32), length.astype(np.int32)))),
            "sure": pa.array(cat((np.zeros(len(go), bool), np.ones(len(d), bool)))),
        }
    )


def _cut(own: list[str], body: str, chunk: pa.Table, runs: pa.Table, window: int) -> pa.Table:
    """The rows of a chunk without the words of the runs (doc, tkey, pos, len): ``len`` windows from word ``pos`` on."""
    doc, tkey, pos, length = (runs.column(n).to_numpy() for n in ("doc", "tkey", "pos", "len"))
    of: dict[tuple, list] = {}
    order = np.lexsort((tkey, doc))
    doc, tkey, pos, length = doc[order], tkey[order], pos[order], length[order]
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])))) if len(doc) else np.empty(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=False):
        of[int(doc[a]), int(tkey[a])] = (pos[a:b], length[a:b])
    bodies = chunk.column(body).cast(pa.large_binary())
    n_words, n_removed, kept = [], [], []
    for raw, key in zip(bodies, zip(chunk.column("doc").to_pylist(), chunk.column("tkey").to_pylist(), strict=True), strict=True):
        words = raw.as_py().split()
        gone = 0
        if key in of:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, of[key][0], 1)
            np.add.at(edge, of[key][0] + of[key][1] + window - 1, -1)
            stay = np.cumsum(edge)[:-1] == 0
            gone = len(words) - int(stay.sum())
        n_words.append(len(words))
        n_removed.append(gone)
        kept.append(b" ".join(compress(words, stay) if gone else words))
    results = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
    return pa.table({n: chunk.column(n) for n in own} | results)


_RESULT = "n_words long, n_removed long, kept_text string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lose nothing."""
    for batch in batches:
        words = [(t or b"").split() for t in batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()]
        kept = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), kept], names=[*batch.schema.names[:-1], "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, least_block: int = LEAST_BLOCK) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id.
    ``chunk_bytes``: text of a chunk, the unit of work; ``least_block``: the least counters of a block.
    """
    gram = min(GRAM, window)
    own = others(docs, "n_words", "n_removed", "kept_text")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cells, chunks = int(size * CELLS_PER_BYTE), max(1, -(-size // chunk_bytes))
    block = min(max(cells // 4096, least_block), LARGEST_BLOCK)
    blocks = max(1, -(-cells // block))
    known = F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    chunk_of = lambda *key: F.pmod(F.xxhash64(*key), F.lit(chunks))
    plain = [f"own{i}" for i in range(len(own))]
    body = plain[[c.lower() for c in own].index(text.lower())]
    doc, tkey = F.col(doc_id).cast("long"), F.xxhash64(text)
    keyed = docs.where(known).select(chunk_of(doc, tkey).alias("c"), doc.alias("doc"), tkey.alias("tkey"), *[c.alias(n) for c, n in zip(pick(own), plain, strict=True)])
    sketches = keyed.groupBy("c").applyInArrow(lambda t: _sketch(t, body, blocks, window, gram), "block long, c long, marks binary")
    answers = sketches.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _merge(it, block), "c long, block long, bits binary")
    rows = keyed.groupBy("c").cogroup(answers.groupBy("c")).applyInArrow(lambda t, a: _suspects(t, a, body, blocks, window, gram), _RUN_SCHEMA)
    least = F.min("doc").over(Window.partitionBy("h1", "h2"))
    runs = rows.withColumn("least", least).where("sure or doc > least").select(chunk_of("doc", "tkey").alias("c"), "doc", "tkey", "pos", "len")
    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField(p, types[n]) for p, n in zip(plain, own, strict=True)] + T.StructType.fromDDL(_RESULT).fields)
    cut = keyed.groupBy("c").cogroup(runs.groupBy("c")).applyInArrow(lambda t, r: _cut(plain, body, t, r, window), schema).toDF(*own, "n_words", "n_removed", "kept_text")
    return cut.unionByName(map_arrow(docs.where(~known), own, [F.col(text).alias("body")], _whole, _RESULT))
