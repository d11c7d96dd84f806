"""Encoding whole texts with the tokenizers library, one distinct chunk at a time.

A text is cut where no token can cross (at white space, as the tokenizer's own
pre-tokenizer does), each distinct chunk is encoded once for each worker with the
library's model, and the ids of a text are gathered from the chunks' ids.  The result
equals ``Tokenizer.encode(text, add_special_tokens=False).ids``, special tokens that
stand in the text included.  A chunk of letters whose classes and cases are old and
settled (``_SETTLED``) is normalised and cut here; any other chunk that is not ASCII goes
through the file's own normaliser and pre-tokeniser, so no table of letters but the library's counts.
The chunk table is bounded: when it holds more than ``MAX_CHUNKS`` chunks, those that came in one slice only are
forgotten (pre-tokens start anew at ``MAX_PIECES``), so memory doesn't grow with the input.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import regex

from . import textvec as tv
from .shared import worker_tables

MAX_CHUNKS, MAX_PIECES = 450_000, 250_000
SLICE_BYTES = 2 << 20
_WHITE = "\t-\r \x85\xa0  -     　"  # fixed values: what both files' patterns call white space
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{_WHITE}]+")
#: ASCII and the letters of Latin-1, Latin Extended-A and Russian: each is a letter, composed, with a case of one letter.
_SETTLED = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-žА-я]*")


class _Table(dict):
    """Numbers chunks in order of first sight and notes the new ones."""

    def __init__(self, owner: Chunks, kind: int):
        super().__init__()
        self.owner, self.kind = owner, kind

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = self.owner.known + len(self.owner.new)
        self.owner.new.append((self.kind, chunk))
        return n


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` after its first n values; there may be room behind them."""
    if n + len(more) > len(held):
        held = np.concatenate((held[:n], np.empty(max(len(more), n // 2), held.dtype)))
    held[n : n + len(more)] = more
    return held


class Chunks:
    """Ids of chunks.  ``pieces(kind, chunk)`` gives a chunk's pre-tokens, ``encode(pieces)`` the ids of many, as unsigned 32-bit bytes."""

    def __init__(self, split: Callable, pieces: Callable, encode: Callable, added: dict[str, int]):
        self.split, self.pieces, self.encode_pieces, self.added = split, pieces, encode, added
        self.find_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.reset()

    def reset(self) -> None:
        self.known, self.n_ids, self.new, self.of_piece = 0, 0, [], {}
        self.tables = [_Table(self, kind) for kind in range(3)]
        self.start, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.again = np.empty(0, bool)  # chunks that came in a later slice than their first, since the last ``_shrink``

    def _shrink(self) -> None:
        """Keeps the chunks that came again; if those are most of the table, it starts anew."""
        kept = np.flatnonzero(self.again[: self.known])
        if len(kept) > MAX_CHUNKS // 2:
            self.reset()
            return
        number = np.full(self.known, -1)
        number[kept] = np.arange(len(kept))
        for kind, table in enumerate(self.tables):
            old = np.fromiter(table.values(), np.int64, len(table))
            stay = number[old] >= 0
            self.tables[kind] = _Table(self, kind)
            self.tables[kind].update(zip(compress(table, stay.tolist()), number[old[stay]].tolist(), strict=True))
        self.flat = self.flat[tv.gather(self.start[kept], self.count[kept])]
        self.count = self.count[kept]
        self.start = np.cumsum(self.count) - self.count
        self.again = np.zeros(len(kept), bool)
        self.known, self.n_ids = len(kept), len(self.flat)

    def _learn(self) -> None:
        known = self.of_piece
        cut = [None if kind == 2 else self.pieces(kind, chunk) for kind, chunk in self.new]
        fresh = list({p: None for ps in cut if ps for p in ps if p not in known})
        known.update(zip(fresh, self.encode_pieces(fresh), strict=True))
        bodies = [array("I", [self.added[new[1]]]).tobytes() if ps is None else known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for new, ps in zip(self.new, cut, strict=True)]
        counts = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        self.start = _put(self.start, self.known, self.n_ids + np.cumsum(counts) - counts)
        self.count = _put(self.count, self.known, counts)
        self.again = _put(self.again, self.known, np.zeros(len(counts), bool))
        self.flat = _put(self.flat, self.n_ids, np.frombuffer(b"".join(bodies), np.uint32))
        self.known, self.n_ids, self.new = self.known + len(counts), self.n_ids + int(counts.sum()), []
        if len(known) > MAX_PIECES:
            self.of_piece = {}

    def _numbers(self, text: str) -> list[int]:
        if self.find_added is None or "<|" not in text:
            return self.split(self.tables, text)
        out, at = [], 0
        for m in self.find_added.finditer(text):
            if m.start() > at:
                out += self.split(self.tables, text[at : m.start()])
            out.append(self.tables[2][m[0]])
            at = m.end()
        return out + (self.split(self.tables, text[at:]) if at < len(text) else [])

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the chunks of all texts, where each text's begin and the last one's end); new chunks are learned."""
        if self.known > MAX_CHUNKS:
            self._shrink()
        parts = [np.array(self._numbers(t) if t else [], np.int64) for t in texts]
        every = np.concatenate([np.empty(0, np.int64), *parts])
        self.again[every[every < self.known]] = True
        if self.new:
            self._learn()
        return every, np.cumsum([0, *map(len, parts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        every, cuts = self.numbers(texts)
        n = self.count[every]
        return self.flat[tv.gather(self.start[every], n)], np.diff(np.concatenate(([0], np.cumsum(n)))[cuts])


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest is numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def letters(piece: str) -> str:
    if piece.isascii():  # by far the most common cases first
        if piece.isalnum():
            return piece
        if piece[0] == " " and piece[1:].isalnum():
            return BYTE_LETTERS[32] + piece[1:]
    return piece.encode().decode("latin-1").translate(BYTE_LETTERS)


def _library(spec: dict) -> Callable[[list[str]], list[bytes]]:
    from tokenizers import Tokenizer

    bare = spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
    model = Tokenizer.from_str(json.dumps(bare)).model
    tokenize = model.tokenize
    return lambda pieces: [array("I", [t.id for t in tokenize(letters(p))]).tobytes() for p in pieces]


def _library_pieces(spec: dict) -> Callable[[str], list[str]]:
    """The file's own normaliser and pre-tokeniser."""
    from tokenizers import Tokenizer

    bare = Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "post_processor": None, "decoder": None, "added_tokens": []}))
    normalizer, cut = bare.normalizer, bare.pre_tokenizer.pre_tokenize_str

    def pieces(text: str) -> list[str]:
        text = normalizer.normalize_str(text) if normalizer else text
        return [text[a:b] for _, (a, b) in cut(text)]

    return pieces


# The pre-tokenizers' own patterns, used on ASCII chunks.
_GPT2 = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_MARKS = frozenset(".,;:!?)")
_WIDE = re.compile(f"[{_WHITE}] (?=[{_WHITE}]|\\Z)")
_LUMPS = re.compile(f"[{_WHITE}]+(?![^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]")


def _split_byte_level(tables: list[_Table], text: str) -> list[int]:
    """Chunks with the single space before them; a text in which a space stands inside a longer run of white space is cut at such runs."""
    plain, spaced = tables[0], tables[1]
    if _WIDE.search(text):
        return [spaced[p[1:]] if len(p) > 1 and p[0] == " " and p[1] != " " else plain[p] for p in _LUMPS.findall(text)]
    first, *rest = text.split(" ")
    return ([plain[first]] if first else []) + list(map(spaced.__getitem__, rest))


def _byte_level_pieces(library: Callable[[str], list[str]]) -> Callable[[int, str], list[str]]:
    def pieces(kind: int, chunk: str) -> list[str]:
        text = " " + chunk if kind else chunk
        if not chunk.isascii():
            body = text[:-1] if chunk[-1] in _MARKS else text
            if _SETTLED.fullmatch(body, kind) and len(body) > kind:
                return [body, chunk[-1]] if len(body) < len(text) else [body]
            return library(text)
        if chunk.isalpha():
            return [text]
        if chunk[:-1].isalpha() and chunk[-1] in _MARKS:
            return [text[:-1], chunk[-1]]
        return _GPT2.findall(text)

    return pieces


def _split_words(tables: list[_Table], text: str) -> list[int]:
    words = text.split() if not _CONTROL.search(text) else [w for w in _SPACES.split(text) if w]
    return list(map(tables[0].__getitem__, words))


def _word_pieces(library: Callable[[str], list[str]]) -> Callable[[int, str], list[str]]:
    def pieces(kind: int, chunk: str) -> list[str]:
        if not chunk.isascii():
            body = chunk[:-1] if chunk[-1] in _MARKS else chunk
            if body and _SETTLED.fullmatch(body):
                return [body.lower(), chunk[-1]] if len(body) < len(chunk) else [body.lower()]
            return library(chunk)
        word = chunk.lower()
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and word[-1] in _MARKS:
            return [word[:-1], word[-1]]
        return _WORD.findall(word)

    return pieces


def load(path: str, encode: Callable | None = None) -> Chunks:
    """The encoder of a tokenizer file: byte-level BPE, or BPE over lower-cased words without white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encode = encode or _library(spec)
    if spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]:
        return Chunks(_split_byte_level, _byte_level_pieces(_library_pieces(spec)), encode, added)
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"]:
        return Chunks(_split_words, _word_pieces(_library_pieces(spec)), encode, added)
    raise ValueError(f"{path}: neither a byte-level nor a lower-cased word BPE")


def cached(path: str) -> Chunks:
    """One encoder for each file and Python worker."""
    loaded = worker_tables("tokens")
    if path not in loaded:
        loaded[path] = load(path)
    return loaded[path]


def encoded(texts, encoder: Chunks) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, number of ids of each) of an Arrow column of texts; null texts are empty."""
    for row, to, _, _ in tv.slices(texts, SLICE_BYTES):
        ids, counts = encoder.encode([t or "" for t in texts.slice(row, to - row).to_pylist()])
        yield row, to, ids, counts
