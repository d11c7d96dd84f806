"""Token files: id arrays with Elias-Fano coded document boundaries.

A *segment* is one self-contained image:

    magic "TWEF1\\0", byte width of an id (2 or 4), low bits for each boundary,
    n_docs, n_ids, n_high, n_samples (uint64 each), then
    low    packed low bits of the boundaries
    high   the upper parts in unary, one set bit for each boundary
    select uint32 bit positions of every 64th set bit
    ids    the concatenated ids, little-endian

Boundary i (ids before document i of the segment) is ((select(i) - i) << low) | low[i]:
about 2 + log2(ids / documents) bits for each document and no table of 64-bit offsets.

Segments are rows of a Parquet table that Spark writes (so task retries and lost
executors leave no half-written files), in ascending document order: ``shard`` is the
range partition, ``segment`` its running number, ``before`` the ids earlier in the
shard, ``doc_ids`` the segment's documents.  The ids before a shard are summed from one
row for each shard when the files are read.

Defined cases: a null or empty text has no ids but the end id; null document ids come
first; rows that repeat an id each get their own entry, ordered by text; an empty table
gives no segments; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens

SEGMENT_IDS = 2 << 20
_MAGIC = b"TWEF1\0"
_HEAD = struct.Struct("<6sBBQQQQ")
_SAMPLE = 64
MOST_SHARDS = 500_000  # rows of 16 bytes that are broadcast
SCHEMA = "shard int, segment int, before long, n_ids long, doc_ids array<long>, image binary"


def pack(counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """The image of documents with these numbers of ids; an id that ``width`` bytes can't hold is an error."""
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {int(ids.max())} needs more than {width} bytes")
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.uint64)
    low = max(0, int(len(ids) // len(ends)).bit_length() - 1)
    lows = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(len(ends))
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    parts = np.packbits(lows, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::_SAMPLE].astype("<u4").tobytes()
    head = _HEAD.pack(_MAGIC, width, low, len(counts), len(ids), len(parts[1]), len(parts[2]) // 4)
    return b"".join((head, *parts, ids.astype(f"<u{width}").tobytes()))


class Segment:
    """Reads an image; boundaries are taken by select."""

    def __init__(self, image: bytes):
        magic, width, self.low, self.n_docs, self.n_ids, n_high, n_samples = _HEAD.unpack_from(image)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        n_low = -(-self.low * (self.n_docs + 1) // 8)
        self.lows = np.frombuffer(image, np.uint8, n_low, at)
        self.high = np.frombuffer(image, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(image, "<u4", n_samples, at + n_low + n_high)
        self.ids = np.frombuffer(image, f"<u{width}", self.n_ids, at + n_low + n_high + 4 * n_samples)

    def offset(self, i: int) -> int:
        """The ids of the segment before its document ``i``."""
        return int(self.offsets(i, i)[0])

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Boundaries ``first`` to ``last``, by select: the samples bound the bits to look at, so only these boundaries are ever decoded."""
        start = int(self.samples[first // _SAMPLE])
        after = last // _SAMPLE + 1
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start >> 3 : (stop >> 3) + 1], bitorder="little")
        bits[: start & 7] = 0
        at = np.arange(first, last + 1)
        ones = np.flatnonzero(bits)[at - first // _SAMPLE * _SAMPLE] + (start & ~7)
        begin, end = self.low * first, self.low * (last + 1)
        lows = np.unpackbits(self.lows[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :][: end - begin]
        return ((ones - at) << self.low) | (lows.reshape(len(at), self.low).astype(np.int64) @ (1 << np.arange(self.low)))


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    encoder = tokens.cached(path)
    held: list[tuple] = []
    size = number = before = 0

    def flush():
        docs, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        known = docs >= 0
        names = pa.array(docs, pa.int64(), mask=~known & (docs == _NO_ID))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), names), pa.array([pack(counts, ids, width)], pa.binary())],
            names=["shard", "segment", "before", "n_ids", "doc_ids", "image"],
        )

    for batch in batches:
        docs = batch.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for row, to, ids, counts in tokens.encoded(batch.column(1), encoder):
            ends = np.cumsum(counts)
            held.append((docs[row:to], counts + 1, np.insert(ids, ends, end_id)))
            size += len(ids) + to - row
            if size >= limit:
                yield flush()
                before, number, held, size = before + size, number + 1, [], 0
    if held:
        yield flush()


_NO_ID = -(2**63)


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", width: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts, in ascending document order, into token segments at the folder ``to``.

    ``width``: bytes of an id, 2 for vocabularies up to 65,536; a larger id is an error, none is cut short.
    """
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).repartitionByRange("doc").sortWithinPartitions("doc", "text")
    ordered.mapInArrow(lambda it: _segments(it, tokenizer, end_id, width, segment_ids), SCHEMA).write.parquet(to)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, base, image in zip(*batch.columns, strict=True):
            segment = Segment(image.as_py())
            for lo in range(0, segment.n_docs, 512):  # small batches of results
                hi = min(lo + 512, segment.n_docs)
                ends = segment.offsets(lo, hi)
                ids = segment.ids[ends[0] : ends[-1]].astype("<u4")
                cuts = (ends - ends[0]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [docs.values.slice(lo, hi - lo), pa.array(ends[:-1] + base.as_py(), pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian uint32 bytes) of every document in the files at ``path``."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("size"))  # one row for each partition that was written
    base = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))
    few = sizes.limit(MOST_SHARDS + 1).count() <= MOST_SHARDS  # so that the ids themselves stay where they are
    placed = segments.join(F.broadcast(base) if few else base, "shard").select("doc_ids", (F.col("base") + F.col("before")).alias("base"), "image")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")
