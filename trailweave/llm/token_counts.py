"""Token counts by rank-synchronous merging of ragged arrays.

Method: the pre-tokens of a batch lie one after the other in one array of symbols.  In
each round the rank of every adjacent pair is at hand, each pre-token's lowest rank is
taken by a reduction over its stretch, and that pair is merged in all pre-tokens at
once (wherever it stands in them; of overlapping places the left ones).  Ranks are looked
up anew only beside merged symbols.  Pre-tokens without a pair left are done; what
survives of their symbols is their number of tokens.  Every merge that uses a token comes after the one
that makes it (this is checked), so no new pair can have a rank below the one just merged.

Each distinct chunk between white space is counted once for each worker (see ``tokens``).

Defined cases: a null text is empty, with no bytes and no tokens; the file's special strings
inside texts are one token each, as in the library; rows don't depend on each other, so
ties and repeated rows don't matter; other columns pass through (those named like the
results are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from . import tokens
from .shared import map_arrow, others, pick, quoted, worker_tables

LIMIT = 512
_SLICE = 4 << 20


class Merger:
    """The merges of a byte-level file; symbols are numbered bytes first, then in the order of the merges that make them."""

    def __init__(self, spec: dict):
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        base = list(tokens.BYTE_LETTERS.values())
        number = {c: i for i, c in enumerate(base)}
        keys = np.empty(len(merges), np.int64)
        self.size = len(base) + len(merges)
        for rank, (a, b) in enumerate(merges):
            if a not in number or b not in number or a + b in number:
                raise ValueError("a merge uses a token that no earlier one makes, or two make the same")
            keys[rank] = number[a] * self.size + number[b]
            number[a + b] = len(base) + rank
        order = np.argsort(keys)
        self.keys, self.rank_of_key, self.n_base = keys[order], order, len(base)
        self.base_of_byte = np.zeros(256, np.int64)
        for i, b in enumerate(tokens.BYTE_LETTERS):
            self.base_of_byte[b] = i
        self.none = len(merges)  # above every rank

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], self.none)

    def count(self, pieces: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.base_of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), length)
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        rank = np.full(len(symbol), self.none)  # of the pair that begins at a symbol
        inner = np.flatnonzero(~last)
        rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            done = lowest == self.none
            if done.any():
                length[owner[starts[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of places that overlap (a pair of equal symbols), every second from the left.
            run = np.concatenate(([True], np.diff(hit) != 1))
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbol[hit] = self.n_base + rank[hit]
            rank[hit] = rank[hit + 1]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            hit -= np.arange(len(hit))  # one symbol before each is gone
            changed = np.concatenate((hit, hit[hit > 0] - 1))
            changed = changed[changed + 1 < len(symbol)]
            inside = owner[changed] == owner[changed + 1]
            changed = changed[inside]
            rank[changed] = self._ranks(symbol[changed], symbol[changed + 1])
        return length


class Counter:
    """Counts the tokens of whole texts, learning each distinct chunk once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level BPE")
        self.merger = Merger(spec)
        self.chunks = tokens.load(path, self._symbols)

    def _symbols(self, pieces: list[str]) -> list[bytes]:
        """As many 32-bit stand-ins as a pre-token has tokens: the chunk table asks for ids, of which only the number counts."""
        return [bytes(4 * n) for n in self.merger.count(pieces).tolist()]

    def count(self, texts: list[str]) -> np.ndarray:
        every, cuts = self.chunks.numbers(texts)
        return np.diff(np.concatenate(([0], np.cumsum(self.chunks.count[every])))[cuts])


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counters = worker_tables("token_counts")
    if path not in counters:
        counters[path] = Counter(path)
    for batch in batches:
        body = batch.column(batch.num_columns - 1)
        for row, to, _, off in tv.slices(body, _SLICE):
            n = counters[path].count([t or "" for t in body.slice(row, to - row).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.slice(row, to - row).columns[:-1], pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The other columns of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    own = others(docs, text, "n_bytes", "n_tokens", "over_limit")
    made = map_arrow(docs, own, [F.col(quoted(text)).alias("body")], lambda it: _count(it, tokenizer), "n_bytes long, n_tokens long")
    return made.select(*pick(own), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
