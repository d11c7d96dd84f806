"""Numpy helpers that turn an Arrow batch of texts into word, window and shingle hashes.

Used inside ``mapInArrow`` tasks.  A word is a maximal run of bytes other than
0x20 and 0x09-0x0D; multi-byte UTF-8 sequences never contain those bytes, so
working on the encoded bytes is exact.  All hashes are 64 bits wide and depend
on the content alone, never on the process, so every executor agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is its own slice.
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_MIX_LOWER = _BYTE_MIX.copy()
_BYTE_MIX_LOWER[65:91] = _BYTE_MIX[97:123]
_RADIX = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_RADIX_INV = pow(_RADIX, -1, 2**64)
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = -(-n // (1 << 20)) << 20
        out = np.full(size, _U(base), dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= SLICE_BYTES + 4096:  # those of a single longer text are not kept
            _powers[base] = have
    return have[:n]


def forget() -> None:
    """Drops the kept powers; whoever needs them makes them anew."""
    _powers.clear()


class Words:
    """Words of some consecutive documents: ``hashes``, ``begin`` and ``end`` bytes, and the ``first`` word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        n_docs = len(offsets) - 1
        solid = ~_SPACE[data]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        inside = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[1:] > offsets[:-1])]
        opens[inside] = solid[inside]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | opens[1:]
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_BYTE_MIX_LOWER if lower else _BYTE_MIX)[data] * powers(_RADIX, len(data)), out=total[1:])
        raw = (total[self.end] - total[self.begin]) * powers(_RADIX_INV, len(data) + 1)[self.begin]
        self.hashes = mix(raw + (self.end - self.begin).astype(np.uint64))
        self.first = np.searchsorted(self.begin, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n_docs), self.counts)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` consecutive words and, for each, the index of its first word; runs never cross documents."""
        n = len(self.hashes)
        if n < width:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(np.arange(n - width + 1) + width <= self.first[self.doc[: n - width + 1] + 1])
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            total *= _U(_STEP)
            total += self.hashes[j : n - width + 1 + j]
        return mix(total[at]), at


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of consecutive texts of about ``limit`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield row, to, data[off[row] : off[to]], off[row : to + 1] - off[row]
        row = to


def reduce_by_doc(op: np.ufunc, values: np.ndarray, doc: np.ndarray, n_docs: int, empty: int) -> np.ndarray:
    """``op`` over the values of each document (``doc`` ascends); ``empty`` where a document has none."""
    out = np.full(n_docs, empty, dtype=values.dtype)
    if len(values):
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[starts]] = op.reduceat(values, starts)
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the given stretches, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of consecutive stretches of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
