"""Byte-level BPE by speculation and verification, and its decoding.

Method: the longest vocabulary entry at each place is proposed greedily for all
distinct pre-tokens of a batch at once (a walk through one trie held in sorted arrays).
A proposal is the BPE encoding exactly if every adjacent pair of its tokens is
*compatible*: no merge that crosses the border comes before the merges that build the
two sides.  The test walks down the right spine of the left token and the left spine of
the right one; it runs on all adjacent pairs of the batch at once.  Only pre-tokens with
an incompatible pair are merged exactly, by rank, with a heap.

Defined cases: null text is empty (no ids, decoded to the empty string); special tokens
that stand in a text become their id, as in the library; text that is not in the
vocabulary's pieces falls back to its bytes; rows are independent of each other, so
ties and repeated rows don't matter; other columns pass through (columns named like the
results are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from . import tokens
from .shared import map_arrow, others, worker_tables

_LONG = 256  # pre-tokens of more bytes are walked one by one, so that the others don't wait for them


class Speculator:
    """Encodes pre-tokens.  Tokens are numbered inside by the order of the merges that make them."""

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [a + b for a, b in merges]
        base = [c for c in tokens.BYTE_LETTERS.values()]
        if len(set(made)) != len(made) or set(base) & set(made):
            raise ValueError("two merges make one token; pairs can't be verified")
        names = base + made
        number = {n: i for i, n in enumerate(names)}
        self.n_base, self.size = len(base), len(names)
        self.id = np.array([vocab[n] for n in names], np.uint32)
        self.left = np.array([*range(self.n_base), *(number[a] for a, _ in merges)])
        self.right = np.array([*range(self.n_base), *(number[b] for _, b in merges)])
        keys = self.left[self.n_base :] * self.size + self.right[self.n_base :]
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], order + self.n_base
        self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_made.tolist(), strict=True))
        back = {c: b for b, c in tokens.BYTE_LETTERS.items()}
        self.bytes = [bytes(back[c] for c in n) for n in names]
        self.base_of_byte = np.zeros(256, np.int64)
        for i, raw in enumerate(self.bytes[: self.n_base]):
            self.base_of_byte[raw[0]] = i
        self._trie()
        self.checked = self.failed = 0

    def _trie(self) -> None:
        child: dict[int, int] = {}
        token = [-1]
        for i, raw in enumerate(self.bytes):
            node = 0
            for b in raw:
                key = node << 8 | b
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                node = child[key]
            token[node] = i
        self.walk, self.at_node = child, token
        self.edges = np.sort(np.fromiter(child, np.int64, len(child)))
        self.child = np.fromiter((child[k] for k in self.edges.tolist()), np.int64, len(child))
        self.token = np.array(token)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.searchsorted(self.edges, key)
        at[at == len(self.edges)] = 0
        return np.where(self.edges[at] == key, self.child[at], -1)

    def propose(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, its pre-token) by greedy longest match, in order."""
        pos, active = begin.copy(), np.flatnonzero(begin < end)
        found, owner = [], []
        while len(active):
            best, best_end = np.full(len(active), -1), np.zeros(len(active), np.int64)
            live, at, node = np.arange(len(active)), pos[active], np.zeros(len(active), np.int64)
            while len(live):
                node = self._step(node, data[at].astype(np.int64))
                ok = node >= 0
                live, at, node = live[ok], at[ok] + 1, node[ok]
                token = self.token[node]
                hit = token >= 0
                best[live[hit]], best_end[live[hit]] = token[hit], at[hit]
                ok = at < end[active[live]]
                live, at, node = live[ok], at[ok], node[ok]
            found.append(best)
            owner.append(active)
            pos[active] = best_end
            active = active[best_end < end[active]]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return found[order], owner[order]

    def propose_long(self, raw: bytes) -> list[int]:
        """The same for one long pre-token."""
        out, pos, walk, token = [], 0, self.walk, self.at_node
        while pos < len(raw):
            node, at, best, best_end = 0, pos, -1, pos + 1
            while at < len(raw) and (node := walk.get(node << 8 | raw[at])) is not None:
                at += 1
                if token[node] >= 0:
                    best, best_end = token[node], at
            out.append(best)
            pos = best_end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the bytes of a and b together is just a, b."""
        result = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), self.size)  # merges from this one on come too late to cross the border
        while len(live):
            key = a * self.size + b
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            crosses = (self.pair_keys[at] == key) & (self.pair_made[at] < limit)
            result[live[crosses]] = False
            # Undo the later of the two merges; its number is the new limit (for the right side, one more: ties go to the left).
            by_left = a > b
            plain_a, plain_b = a < self.n_base, b < self.n_base
            by_left = (by_left | plain_b) & ~plain_a
            limit = np.where(by_left, a, b + 1)
            next_a, next_b = np.where(by_left, self.right[a], a), np.where(by_left, b, self.left[b])
            go = ~crosses & ~(plain_a & plain_b)
            live, a, b, limit = live[go], next_a[go], next_b[go], limit[go]
        return result

    def merge(self, raw: bytes) -> list[int]:
        """Exact merging: always the earliest merge, leftmost first."""
        token = self.base_of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(token)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                made = self.pairs.get(token[i] * self.size + token[j])
                if made is not None:
                    heapq.heappush(heap, (made, i, token[i], token[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            made, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [t for t in token if t >= 0]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        raw = [p.encode() for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= _LONG]
        ends = np.cumsum([0, *(len(raw[i]) for i in short)])
        found, owner = self.propose(np.frombuffer(b"".join(raw[i] for i in short) or b"\0", np.uint8), ends[:-1], ends[1:])
        order = short + [i for i, r in enumerate(raw) if len(r) > _LONG]
        walked = [self.propose_long(raw[i]) for i in order[len(short) :]]
        found = np.concatenate((found, *walked)).astype(np.int64)
        owner = np.concatenate((owner, np.repeat(np.arange(len(short), len(order)), [len(w) for w in walked])))
        same = np.flatnonzero(owner[1:] == owner[:-1])
        key = found[same] * self.size + found[same + 1]
        pairs, back = np.unique(key, return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.unique(owner[same[~good]])
        self.checked, self.failed = self.checked + len(order), self.failed + len(failed)
        out: list = [None] * len(raw)
        ids, cuts = self.id[found].tolist(), np.searchsorted(owner, np.arange(len(order) + 1)).tolist()
        for k, i in enumerate(order):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        for k in failed.tolist():
            out[order[k]] = self.id[self.merge(raw[order[k]])].tolist()
        return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.speculator = Speculator(spec)
        self.encoder = tokens.load(path, lambda pieces: [np.array(ids, np.uint32).tobytes() for ids in self.speculator.encode(pieces)])
        pieces = dict(zip(self.speculator.id.tolist(), self.speculator.bytes, strict=True)) | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = max(pieces) + 1
        raw = [pieces.get(i, b"") for i in range(size)]
        self.length = np.array([len(r) for r in raw])
        self.begin = np.cumsum(self.length) - self.length
        self.body = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each document; bytes that are not UTF-8 become U+FFFD."""
        n = self.length[ids]
        data = self.body[tv.gather(self.begin[ids], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    codecs = worker_tables("bpe")
    if path not in codecs:
        codecs[path] = Codec(path)
    return codecs[path]


def _round(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    both = codec(path)
    for batch in batches:
        for row, to, ids, counts in tokens.encoded(batch.column(batch.num_columns - 1), both.encoder):
            ends = np.concatenate(([0], np.cumsum(counts))).tolist()
            raw = ids.astype("<u4")
            own = batch.slice(row, to - row).columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(both.decode(ids, counts), pa.string())], names=[*batch.schema.names[:-1], "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with n_tokens, ids (little-endian uint32 bytes) and decoded (from those ids)."""
    own = others(docs, text, "n_tokens", "ids", "decoded")
    return map_arrow(docs, own, [F.col(text).alias("body")], lambda it: _round(it, tokenizer), "n_tokens long, ids binary, decoded string")
