"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Method: each vector x is scaled to length one and quantised to integers q in
[-127, 127] with its own step s, and the length e of the exact remainder x - s*q is
kept.  For two vectors, |x.y - s_x s_y (q_x . q_y)| <= e_x + e_y + e_x e_y.  Tiles of
integer codes are multiplied (as float32, in which all sums of such products are
exact); a pair whose upper bound stays below the threshold is settled, a pair whose
lower bound reaches it is a link, and only the pairs in between are computed again in
double precision from the original components.

Work: comparing all vectors is quadratic by definition, so they are dealt into few, large
blocks: as many as memory asks for (``BLOCK_VALUES`` components a block), or, for a small
table, a grid of about the square root of the tasks, so each vector travels to few pairs
of blocks.  A block holds vectors that are nearest to the same pivot (some vectors of the
table, chosen by a hash); a large cell is cut into several blocks by a hash.  With the
angle r of a cell's farthest vector from its pivot, a vector whose angle to the pivot
exceeds r plus the threshold's angle can't link with any vector of the cell (triangle
inequality), and isn't sent there.  Memory is bounded and no pair of vectors is
ever a row: a block pair returns a link count for each vector and, for the components,
one edge from each linked vector to the smallest vector of its piece.  Equal vectors
collapse to one row with a weight first, so large groups of copies cost one row.

Lengths of vectors: each length is compared by itself.  The ``LENGTHS`` most frequent
ones have pivots (at most ``PIVOTS`` each, ``PIVOT_VALUES`` numbers in all, which reach the driver); any other length is
dealt by the hash alone, with the same result.

Defined cases: vectors that are null, zero, or hold null or non-finite components link
with nothing; vectors of different lengths never link; a null id is passed through
without links; rows that repeat an id are linked like other rows and add up under
their id; an empty table gives an empty table; other columns, whatever their names, are
ignored; ties can't occur, as a pair links or doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import table

BLOCK_VALUES, LEAST_ROWS = 1 << 21, 1024
PIVOTS, LENGTHS, PIVOT_VALUES = 4096, 16, 1 << 24  # at most so many pivots a length, lengths, and numbers in all pivots
_TILE = 1024
_SLACK = 1e-6  # covers the rounding of the bounds themselves
_EXACT = 1024  # so many products of codes add up exactly in float32


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, codes as float32, steps, remainders' lengths)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None])
    rest = unit - codes * step[:, None]
    return unit, codes.astype(np.float32), step, np.sqrt((rest * rest).sum(axis=1))


def _tile_links(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two quantised tiles whose cosine reaches the threshold."""
    (ua, qa, sa, ea), (ub, qb, sb, eb) = a, b
    worst = ea.max() + eb.max() + ea.max() * eb.max() + _SLACK
    product = qa @ qb.T if qa.shape[1] <= _EXACT else sum((qa[:, k : k + _EXACT] @ qb[:, k : k + _EXACT].T).astype(np.float64) for k in range(0, qa.shape[1], _EXACT))
    i, j = np.nonzero(product >= product.dtype.type((threshold - worst) / (sa.max() * sb.max()) * (1 - 1e-6)) if threshold > worst else np.ones(product.shape, bool))
    about = sa[i] * sb[j] * product[i, j].astype(np.float64)
    bound = ea[i] + eb[j] + ea[i] * eb[j] + _SLACK
    linked = about - bound >= threshold
    unsure = np.flatnonzero(~linked & (about + bound >= threshold))
    for lo in range(0, len(unsure), 1 << 16):
        k = unsure[lo : lo + (1 << 16)]
        linked[k] = np.einsum("ij,ij->i", ua[i[k]], ub[j[k]]) >= threshold
    return i[linked], j[linked]


def _block_pair(rows: pa.Table, threshold: float) -> pa.Table:
    """Link counts and spanning edges of one pair of blocks (or of a block with itself)."""
    ids, weight, side = (rows.column(c).to_numpy() for c in ("vec", "weight", "side"))
    order = np.lexsort((ids, side))
    ids, weight, side = ids[order], weight[order], side[order]
    vectors = rows.column("embedding").combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)[order]
    parts = quantise(x)
    alone = bool(len(rows)) and rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    left = len(ids) if alone else int((side == 0).sum())
    first, second = range(0, left, _TILE), range(0 if alone else left, len(ids), _TILE)
    count = np.zeros(len(ids), np.int64)
    rank = np.argsort(np.argsort(ids, kind="stable"))
    piece = np.arange(len(ids))  # by rank: the smallest rank of the piece known so far

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal piece
        while True:
            low, high = np.minimum(piece[a], piece[b]), np.maximum(piece[a], piece[b])
            go = low < high
            if not go.any():
                return
            np.minimum.at(piece, high[go], low[go])
            while not np.array_equal(piece, piece[piece]):
                piece = piece[piece]

    for p in first:
        for q in second:
            if alone and q < p:
                continue
            ends = min(p + _TILE, left), min(q + _TILE, len(ids))
            i, j = _tile_links(tuple(v[p : ends[0]] for v in parts), tuple(v[q : ends[1]] for v in parts), threshold)
            i, j = i + p, j + q
            if alone and p == q:
                i, j = i[i < j], j[i < j]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            join(rank[i], rank[j])
    ordered = np.empty(len(ids), np.int64)
    ordered[rank] = ids
    hit = count > 0
    return pa.table({"vec": pa.array(ids[hit], pa.int64()), "links": pa.array(count[hit]), "other": pa.array(ordered[piece[rank[hit]]], pa.int64())})


class Cells:
    """The pivots of one length, with each cell's radius, blocks and first block (known after the first pass)."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.radius, self.blocks, self.base = np.zeros(len(pivots)), np.ones(len(pivots), np.int64), np.zeros(len(pivots), np.int64)

    def angles(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.arccos(np.clip(unit @ self.pivots.T, -1, 1))


def _by_length(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows of that length, their vectors) of batches with the columns size and embedding."""
    for batch in batches:
        sizes = batch.column(batch.schema.names.index("size")).to_numpy()
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            for lo in range(0, len(of), rows):
                own = batch.take(pa.array(of[lo : lo + rows]))
                yield size, own, own.column(own.schema.names.index("embedding")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, size)


def _spread(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """(size, cell, vectors, angle of the farthest) of parts of each cell."""
    for size, own, x in _by_length(batches):
        angle = cells[size].angles(x)
        cell = angle.argmin(axis=1)
        n = np.bincount(cell, minlength=angle.shape[1])
        far = np.zeros(angle.shape[1])
        np.maximum.at(far, cell, angle.min(axis=1))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size), pa.int32()), pa.array(k, pa.int32()), pa.array(n[k], pa.int64()), pa.array(far[k])], names=["size", "cell", "n", "far"])


def _route(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector (vec, weight, draw, blocks, size, embedding) once for each pair of blocks in which it may find links."""
    for size, own, x in _by_length(batches):
        vec, weight, draw, blocks, _, vectors = own.columns
        draw = draw.to_numpy()
        if size in cells:
            c = cells[size]
            angle = c.angles(x)
            cell = angle.argmin(axis=1)
            mine = c.base[cell] + draw % c.blocks[cell]
            row, near = np.nonzero((angle <= c.radius + reach) | (np.arange(angle.shape[1]) == cell[:, None]))
            times, base = c.blocks[near], c.base[near]
        else:
            row, times, base = np.arange(len(draw)), blocks.to_numpy(), np.zeros(len(draw), np.int64)
            mine = draw % times
        at = np.repeat(np.arange(len(row)), times)
        other = base[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        row = row[at]
        i, j = np.minimum(mine[row], other), np.maximum(mine[row], other)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size), pa.int32()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array((mine[row] > other).astype(np.int32)), vec.take(take), weight.take(take), vectors.take(take)], names=["size", "i", "j", "side", "vec", "weight", "embedding"])


def _cells(reps: DataFrame, sizes: DataFrame, values: int, grid: int) -> dict[int, Cells]:
    """Pivots, radii and blocks of the most frequent lengths; at most PIVOTS short rows of each reach the driver."""
    top = sizes.where(f"n > {LEAST_ROWS}").orderBy(F.desc("n"), "size").limit(LENGTHS).collect()
    if not top:
        return {}
    rows = {r["size"]: max(1, values // r["size"]) for r in top}
    most = {r["size"]: max(2, min(PIVOTS, PIVOT_VALUES // (len(top) * r["size"]))) for r in top}  # of all lengths together a bounded number of values
    wanted = {r["size"]: min(most[r["size"]] // 2, max(-(-r["n"] // rows[r["size"]]), min(grid, -(-r["n"] // LEAST_ROWS)))) for r in top}
    every = F.element_at(F.create_map(*[F.lit(v) for r in top for v in (r["size"], max(1, r["n"] // wanted[r["size"]]))]), F.col("size"))
    known = reps.where(F.col("size").isin(list(rows)))
    drawn: dict[int, list] = {}
    for r in known.where(F.pmod(F.xxhash64(F.lit(7), "rep"), every) == 0).orderBy("rep").select("size", "embedding").collect():
        drawn.setdefault(r["size"], []).append(r.embedding)
    cells = {}
    for size, found in drawn.items():
        x = np.array(found[: most[size]], np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        cells[size] = Cells(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    if cells:
        parts = known.where(F.col("size").isin(list(cells))).select("size", "embedding").mapInArrow(lambda it: _spread(it, cells), "size int, cell int, n long, far double")
        for r in parts.groupBy("size", "cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():
            cells[r["size"]].radius[r.cell], cells[r["size"]].blocks[r.cell] = r.far + _SLACK, -(-r.n // rows[r["size"]])
    for c in cells.values():
        c.base = np.cumsum(c.blocks) - c.blocks
    return cells


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links are pairs of vectors with cosine >= ``threshold``."""
    x = F.col(embedding).cast("array<double>")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    own = table(vectors.select(F.col(vec_id).cast("long").alias("vec"), F.when(good, F.col(embedding)).alias("embedding")).withColumn("key", F.xxhash64("embedding")), "vectors")
    good_rows = own.where("embedding is not null and vec is not null")
    reps = good_rows.groupBy("key", "embedding").agg(F.min("vec").alias("rep"), F.count("*").alias("weight"))
    reps = table(reps.withColumn("size", F.size("embedding")), "representatives")
    sizes = table(reps.groupBy("size").agg(F.count("*").alias("n")), "sizes")
    cells = _cells(reps, sizes, block_values, math.ceil(math.sqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism)))
    dealt = reps.join(sizes, "size").select(F.col("rep").alias("vec"), "weight", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)).alias("draw"), F.ceil(F.col("n") * F.col("size") / block_values).cast("long").alias("blocks"), "size", "embedding")
    kind = reps.schema["embedding"].dataType.simpleString()
    pairs = dealt.mapInArrow(lambda it: _route(it, cells, math.acos(threshold) + _SLACK), f"size int, i long, j long, side int, vec long, weight long, embedding {kind}")
    found = table(pairs.groupBy("size", "i", "j").applyInArrow(lambda t: _block_pair(t, threshold), "vec long, links long, other long"), "found")
    rep_links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    label = table(components(found.select(F.col("vec").alias("a"), F.col("other").alias("b"))), "labels")
    reps = reps.select("key", F.col("embedding").alias("rep_embedding"), "rep", "weight").join(rep_links.withColumnRenamed("vec", "rep"), "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    # Rows that link with nothing all have one key or none: they stay out of the join.
    linked = own["vec"].isNotNull() & own["embedding"].isNotNull()
    result = own.where(linked).join(reps, (own["key"] == reps["key"]) & (own["embedding"] == reps["rep_embedding"]), "left")
    result = result.select(own["vec"], "links", "weight", "component", "rep").unionByName(own.where(~linked).select("vec"), allowMissingColumns=True)
    component = F.coalesce("component", "rep", "vec")
    return result.select(
        F.col("vec").alias(vec_id),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec"), F.lit(True)).alias("kept"),
    )
