"""Large JSON documents read by many tasks: one array of records, split into byte ranges.

Whether a byte in the middle of a file lies inside a text, and how deep, depends on all bytes before it.
So the file is read twice.  First each range says, for a beginning inside and outside of a text, how
it ends and by how much the depth changes; a few numbers a range, from which the state at each
range's beginning follows.  Then each range gives the items that begin in it, reading on to the end of the last one.

Documents that can be split: an array, ``{"Records": [...]}`` and ``{"hits": {"hits": [...]}}``, whose array begins in
the first ``HEAD`` bytes and which are alone in their file.  An item keeps its envelope, so it reads as the
whole document would with that item alone.  Files are opened by path through Arrow (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

HEAD, RANGE_BYTES = 1 << 20, 32 << 20
_ENVELOPES = {"": 1, '"Records"': 2, '"hits""hits"': 3}  # keys before the array, and the depth of its items
_MORE = 1 << 20


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    local = re.sub("^file:/*", "/", path)
    system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _structure(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]:
    """(place, depth change, bytes) of brackets and commas outside of texts, and whether the end is inside a text and after a backslash."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    place = np.arange(n)
    plain = np.maximum.accumulate(np.where(b != 92, place, -1))  # the last byte that is no backslash
    run = np.empty(n, np.int64)  # backslashes just before a byte
    run[:1], run[1:] = 0, place[:-1] - plain[:-1]
    if escaped:
        run += np.where(run == place, 1, 0)
    quote = (b == 34) & (run % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    at = np.flatnonzero(~within & np.isin(b, np.frombuffer(b"[]{},", np.uint8)))
    change = np.where(np.isin(b[at], np.frombuffer(b"[{", np.uint8)), 1, np.where(b[at] == 44, 0, -1))
    odd = n > 0 and b[-1] == 92 and (n - 1 - plain[-1] + (escaped and plain[-1] < 0)) % 2 == 1
    return at, change, b[at], bool(within[-1]) if n else inside, bool(odd)


def _escaped(f: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while start > n:
        size = min(4096, start - n)
        back = f.read_at(size, start - n - size)
        own = len(back) - len(back.rstrip(b"\\"))
        n += own
        if own < size:
            break
    return n % 2 == 1


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("change", pa.int64()), ("least", pa.int64()), ("opens", pa.int64()), ("opens_after", pa.int64())])


def _pieces(f: pa.NativeFile, start: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place in the file, bytes): a file from a place on, ``_MORE`` bytes at a time, so a task holds no more than that of a range."""
    while stop is None or start < stop:
        data = f.read_at(_MORE if stop is None else min(_MORE, stop - start), start)
        if not data:
            return
        yield start, data
        start += len(data)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with opened(r["path"]) as f:
                before = _escaped(f, r["start"])
                said = [{"path": r["path"], "start": r["start"], "stop": r["stop"], "inside": i, "ends_inside": i, "change": 0, "least": None, "opens": 0, "opens_after": 0} for i in (False, True)]
                escaped = [before, before]
                for _, data in _pieces(f, r["start"], r["stop"]):
                    for i, s in enumerate(said):
                        _, change, _, s["ends_inside"], escaped[i] = _structure(data, s["ends_inside"], escaped[i])
                        change = change[change != 0]
                        if not len(change):
                            continue
                        depth = s["change"] + np.cumsum(change)
                        least = int(np.argmin(depth))
                        opens = int((change > 0).sum())
                        if s["least"] is None or depth[least] < s["least"]:
                            s["least"], s["opens_after"] = int(depth[least]), int((change[least + 1 :] > 0).sum())
                        else:
                            s["opens_after"] += opens
                        s["opens"] += opens
                        s["change"] = int(depth[-1])
            yield pa.RecordBatch.from_pylist(said, schema=_SUMMARY)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            name = r["path"].rsplit("/", 1)[-1]
            with opened(r["path"]) as f:
                found = ((begin, r["prefix"] + text + r["suffix"]) for begin, data in _items_of(f, r) if (text := data.decode("utf-8", "replace").strip()))
                while part := list(itertools.islice(found, 1000)):
                    yield pa.RecordBatch.from_pydict({"source_file": [name] * len(part), "line": pa.array([x[0] for x in part], pa.int64()), "raw": [x[1] for x in part]})


def _items_of(f: pa.NativeFile, r: dict) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the items that begin after a bracket or comma of the range; besides a piece, only the open item is held."""
    target, stop = r["target"], r["stop"]
    inside, escaped, depth, in_array = r["inside"], _escaped(f, r["start"]), r["depth"], r["in_array"]
    begin, held = None, []  # where the open item begins, and what earlier pieces have of it
    for start, data in _pieces(f, r["start"]):
        if begin is None and start >= stop:
            return
        at, change, byte, inside, escaped = _structure(data, inside, escaped)
        levels = depth + np.cumsum(change)
        near = np.flatnonzero((levels == target) & (byte == 44) | (levels == target) & (byte == 91) | (levels == target - 1) & (byte == 93))
        for here, b in zip(at[near].tolist(), byte[near].tolist(), strict=True):
            if b == 91 and (in_array or start + here != r["array"]):
                continue
            if begin is not None:
                yield begin, b"".join(held) + data[max(begin - start, 0) : here]
                begin, held = None, []
            if b == 93:
                if in_array:
                    return
                continue
            in_array = in_array or b == 91
            if not in_array:
                continue
            if start + here >= stop:
                return
            begin = start + here + 1
        if begin is not None:
            held.append(data[max(begin - start, 0) :])
        depth = int(levels[-1]) if len(levels) else depth


def _array_of(head: bytes) -> tuple[int, int, str, str] | None:
    """(place of the array's bracket, depth of its items, text before an item, text after it) of a document that can be split."""
    at, change, byte, _, _ = _structure(head, False, False)
    brackets = np.flatnonzero(byte == 91)
    if not len(brackets):
        return None
    place = int(at[brackets[0]])
    depth = int(np.cumsum(change)[brackets[0]])
    before = head[:place].decode("utf-8", "replace").lstrip("﻿")
    keys = re.findall(r'("(?:[^"\\]|\\.)*")\s*:\s*(?=\{|$)', before)
    if _ENVELOPES.get("".join(keys)) != depth:
        return None
    names = [json.loads(k) for k in keys]
    return place, depth, "".join("{" + json.dumps(k) + ":" for k in names) + "[", "]" + "}" * len(names)


def _states(said: dict, ranges: list[tuple], found: tuple) -> list[dict] | None:
    """The state at the beginning of each range that may hold items; None if the file isn't one whole document."""
    array, target, prefix, suffix = found
    inside, depth, over, states = False, 0, False, []
    for path, start, stop in ranges:
        r = said[start, inside]
        if start <= array or depth >= target:
            states.append({"path": path, "start": start, "stop": stop, "inside": inside, "depth": depth, "in_array": start > array, "target": target, "array": array, "prefix": prefix, "suffix": suffix})
        if over and r["opens"]:
            return None  # another document follows
        if r["least"] is not None and depth + r["least"] <= 0:
            if depth + r["least"] < 0 or r["opens_after"]:
                return None
            over = True
        inside, depth = r["ends_inside"], depth + r["change"]
    return None if depth or inside else states


def read_split(spark: SparkSession, path: str, size: int, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """(source_file, line, raw): the items of one large document, ``line`` being the byte after which they begin; None where it can't be split."""
    return read_many(spark, {path: size}, range_bytes)[0]


def read_many(spark: SparkSession, sizes: dict[str, int], range_bytes: int = RANGE_BYTES) -> tuple[DataFrame | None, list[str]]:
    """The items of large documents (path: size) as :func:`read_split` gives them, and the paths of those that can be split.

    The ranges of all files are dealt to tasks together, in two jobs for any number of files.
    """
    found = {}
    for path, size in sizes.items():
        with opened(path) as f:
            array = _array_of(f.read_at(min(HEAD, size), 0))
        if array is not None:
            found[path] = array
    ranges = {path: [(path, a, min(a + range_bytes, sizes[path])) for a in range(0, sizes[path], range_bytes)] for path in found}
    listed = [x for r in ranges.values() for x in r]
    if not listed:
        return None, []
    said: dict[str, dict] = {path: {} for path in found}
    summaries = _dealt(spark, listed, "path string, start long, stop long").mapInArrow(_summaries, "path string, start long, stop long, inside boolean, ends_inside boolean, change long, least long, opens long, opens_after long")
    for r in summaries.collect():  # two short rows a range
        said[r.path][r.start, r.inside] = r.asDict()
    states = {path: _states(said[path], ranges[path], found[path]) for path in found}
    split = [path for path in found if states[path] is not None]
    if not split:
        return None, []
    rows = _dealt(spark, [s for path in split for s in states[path]], "path string, start long, stop long, inside boolean, depth long, in_array boolean, target long, array long, prefix string, suffix string")
    return rows.mapInArrow(_items, "source_file string, line long, raw string"), split


def _dealt(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """``rows`` on as many tasks."""
    return spark.createDataFrame(rows, schema).repartition(min(len(rows), 100_000))
