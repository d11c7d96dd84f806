"""Best-fit packing of tokenised documents into sequences of bounded length.

Method: bounded-space online best-fit.  Each packing task keeps at most ``open_bins``
open sequences in a bitset keyed by free space; the next piece goes into the open
sequence with the least free space that still holds it (one mask and lowest-bit step),
and when a new sequence would be one too many, the fullest open one closes.  Pieces
come in the order of a hash, so long and short ones are mixed.

Pieces are cut where the documents are encoded, and one shuffle on a hash of the
document deals them out to be packed; the ids need only travel where they are wanted.  Sequences are numbered
by task, so no task waits for another.  A task of very few pieces leaves at most its
last sequences part-filled; adaptive execution merges small partitions before that.

Defined cases: null or empty text is the end id alone; null document ids are packed
like others; rows that repeat an id are packed each; pieces of length 0 or over the
capacity are an error in ``pack`` (``cut`` never makes them); an empty table gives an
empty table; other columns pass through both, and columns named like the results are
replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import map_arrow, others

CAPACITY, OPEN_BINS = 1024, 256


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = tokens.cached(path)
    for batch in batches:
        for row, to, ids, counts in tokens.encoded(batch.column(batch.num_columns - 1), encoder):
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(to - row), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (counts - (pieces - 1) * capacity)[doc]  # the first piece is the one that may be shorter
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            base = (np.cumsum(counts) - counts)[doc] + start
            raw = ids.astype("<u4")
            own = batch.slice(row, to - row).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [*own.columns[:-1], pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([raw[a : a + n].tobytes() for a, n in zip(base.tolist(), length.tolist(), strict=True)], pa.binary())],
                names=[*batch.schema.names[:-1], "piece", "start", "length", "ids"],
            )


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """The pieces of all documents: the other columns of ``docs`` with piece, start, length and ids (little-endian uint32).

    Only a document longer than ``capacity`` is cut; all its pieces but the first are full.
    """
    own = others(docs, text, "piece", "start", "length", "ids")
    return map_arrow(docs, own, [F.col(text).alias("body")], lambda it: _cut(it, tokenizer, end_id, capacity), "piece int, start long, length long, ids binary")


class Packer:
    """Online best-fit with a fixed number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.mask, self.open, self.made = 0, 0, 0
        self.by_space: dict[int, list[int]] = defaultdict(list)

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(number of the bin, offset in it) of the next item."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of length {length} doesn't fit into {self.capacity}")
        fitting = self.mask >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            found, space = self.made, self.capacity
            self.made += 1
        left = space - length
        if left:
            self.by_space[left].append(found)
            self.mask |= 1 << left
            self.open += 1
        return found, self.capacity - space


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    packer = Packer(capacity, open_bins)
    for batch in batches:
        placed = [packer.place(n) for n in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"])


def pack(pieces: DataFrame, by: list[str], length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``by`` names columns that tell pieces apart (they deal out the work and break ties)."""
    names = others(pieces, "sequence_id", "offset")
    ordered = pieces.repartition(*by).sortWithinPartitions(F.xxhash64(*by), *by)
    return map_arrow(ordered, names, [F.col(length).alias("length")], lambda it: _pack(it, capacity, open_bins), "sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces that carry ``ids``: each sequence's pieces one after the other."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (acc, p) -> concat(acc, p.ids))").alias("ids"))
