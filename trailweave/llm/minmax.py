"""MinHash near-dedup by min-max hashing.

Method: under each of ``bands * rows / 2`` permutations of the shingle hashes both
the minimum and the maximum are kept, so half the hash evaluations give a signature
of ``bands * rows`` values.  A band takes ``rows`` values of different permutations.
Documents that share a band are candidates; every link is confirmed on the full
shingle sets, so no link is wrong, and a pair at the threshold 0.85 shares no band
with probability (1 - 0.85**5)**24 < 1e-6; ``bands_for`` gives the bands for that at other
thresholds.

Large groups: documents with equal shingle sets collapse to one representative
first.  Inside a band's bucket each document is then compared with the bucket's
smallest document, its leader, only.  After the links found so have been contracted,
pairs of a leader's group that are still in different components are compared, as far
as what they share with the leader (an exact number by then) and the shingles they have
besides it allow them to reach the threshold (see ``_listed``).  These pairs are found in
lists of documents that have something in common; in each round a list's smallest document
is compared with the others and the links are contracted, and a list whose documents are
all in one component is done.  Only when few are left, or after ``ROUNDS`` such rounds,
are the pairs of what remains apart compared, which are documents that have proved
unlike the same leaders.  So a group of n copies, or of n documents that are alike but
for their leader, costs about n comparisons, and every pair that shares a bucket ends up
connected, bounded or tested.

Defined cases: null or empty text has no shingles and links with nothing; a text of
fewer than ``width`` words is one shingle; rows without id link with nothing; rows
that repeat an id count as one document (the union of the links of each of their texts);
an empty table gives an empty table.  ``near_duplicates`` returns its four columns only,
``keep_one`` all columns of the rows it keeps; names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .components import components
from .shared import table, worker_tables

WIDTH, BANDS, ROWS = 5, 24, 5
MISSED = 1e-6
ROUNDS, FEW = 4, 8  # rounds of leaders in open lists, at most; lists of this many documents on average are paired at once
_SKETCH = "doc long, n long, set_a long, set_b long, keys array<long>"
_EMPTY = np.uint64(2**64 - 1)


def shingles(words: tv.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents (ascending); a short document is one shingle."""
    hashes, at = words.runs(width)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        own = []
        for d in short:
            total = np.uint64(words.counts[d])
            for h in words.hashes[words.first[d] : words.first[d + 1]]:
                total = tv.mix(np.array([total]) + h)[0]
            own.append(total)
        hashes, doc = np.concatenate((hashes, np.array(own, np.uint64))), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    return hashes, doc


def _sets(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted, and where each document's begin."""
    ends = np.searchsorted(doc, np.arange(n_docs + 1))
    parts = []
    for i in range(n_docs):
        x = np.sort(hashes[ends[i] : ends[i + 1]])
        parts.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
    return (np.concatenate(parts) if parts else hashes), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), tv.mix(draw[1])


_SET_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _set_hash(hashes: np.ndarray, doc: np.ndarray, n_docs: int, seed: int) -> np.ndarray:
    """A hash of each document's set, whatever its order."""
    return tv.reduce_by_doc(np.add, tv.mix(hashes ^ np.uint64(seed)), doc, n_docs, 0).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    times, plus = _permutations(bands * rows // 2)
    worker_tables("minmax")
    for batch in batches:
        for row, to, data, off in tv.slices(batch.column(1)):
            n_docs = to - row
            hashes, ends = _sets(*shingles(tv.Words(data, off, lower=True), width), n_docs)
            n = np.diff(ends)
            doc = np.repeat(np.arange(n_docs), n)
            values = np.empty((bands * rows, n_docs), np.uint64)
            for p in range(len(times)):
                y = hashes * times[p] + plus[p]
                values[p] = tv.reduce_by_doc(np.minimum, y, doc, n_docs, _EMPTY)
                values[len(times) + p] = tv.reduce_by_doc(np.maximum, y, doc, n_docs, 0)
            keys = np.empty((n_docs, bands), np.uint64)
            for b in range(bands):
                key = np.full(n_docs, np.uint64(b + 1))
                for j in range(rows):
                    key = tv.mix(key + values[b * rows + j])
                keys[:, b] = key
            full = n > 0
            sums = [_set_hash(hashes, doc, n_docs, s) for s in _SET_SEEDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, n_docs).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), tv.lists(keys[full].view(np.int64).ravel(), np.where(full, bands, 0), pa.int64())],
                names=["doc", "n", "set_a", "set_b", "keys"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    worker_tables("minmax")
    for batch in batches:
        for row, to, data, off in tv.slices(batch.column(1)):
            hashes, ends = _sets(*shingles(tv.Words(data, off, lower=True), width), to - row)
            n = np.diff(ends)
            node = _set_hash(hashes, np.repeat(np.arange(to - row), n), to - row, _SET_SEEDS[0])
            yield pa.RecordBatch.from_arrays([pa.array(node), tv.lists(hashes.view(np.int64), n, pa.int64())], names=["node", "shingles"])


def _score(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both full sets and of what they share."""
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))


def _reaches(shared: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * shared >= percent * (na + nb - shared)


def _listed(group: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, s, x, label, n, shared): the documents x of leaders' groups that are open, in lists (a, s) of which two may link.

    Two documents must share ``percent`` / (100 + ``percent``) of the sum of their sizes.  They share
    at most what each shares with the leader, so the rest must be shingles that both have besides the
    leader's.  So either what they share with the leader is enough by itself (list s = null), or they have
    one of those own shingles in common, and, by the prefix principle, one of the rarest: a document that
    needs k of its d own shingles is listed under its d - k + 1 rarest only.
    """
    named = _labelled(group.select("a", F.col("b").alias("x"), F.col("nb").alias("n"), "shared"), label)
    mixed = named.groupBy("a").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("n").alias("smallest")).where("least < most").select("a", "smallest")
    part = lambda n, m: F.ceil(percent * (n + m) / (100 + percent))
    least = F.greatest(F.col("smallest"), F.ceil(percent * F.col("n") / 100))
    open_ = table(named.join(mixed, "a").withColumn("need", part(F.col("n"), least) - F.col("shared")).drop("smallest"), "open")
    own = open_.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    own = own.select("a", "x", "label", "n", "shared", "need", F.explode(F.array_except("sx", "sa")).alias("s"))
    often = own.withColumn("often", F.count("*").over(Window.partitionBy("a", "s"))).where("often > 1 or need > 1")
    rank = F.row_number().over(Window.partitionBy("a", "x").orderBy("often", "s"))
    rare = often.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.col("shared") - F.greatest(F.col("need"), F.lit(1)) + 1).where("often > 1")
    columns = ["a", "s", "x", "label", "n", "shared"]
    return rare.select(columns).unionByName(open_.where("need <= 0").withColumn("s", F.lit(None).cast("long")).select(columns))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` of sets x with their component so far (``label``: node, label)."""
    return rows.join(label.select(F.col("node").alias("x"), "label"), "x")


def _mixed(listed: DataFrame) -> DataFrame:
    """The lists that still hold sets of different components: (a, t, size, and as leader a set of the smallest component with its label, n and shared)."""
    first = F.min(F.struct(F.col("label").alias("_label"), F.col("x").alias("leader"), F.col("n").alias("_n"), F.col("shared").alias("_shared")))
    found = listed.groupBy("a", "s").agg(F.min("label").alias("least"), F.max("label").alias("most"), first.alias("first"), F.count("*").alias("size"))
    return found.where("least < most").select(F.col("a").alias("_a"), F.col("s").alias("t"), "size", "first.*")


def _most() -> Column:
    """What x and _x can share at most, as they are in one list."""
    both = F.least("shared", "_shared")
    return F.when(F.col("s").isNull(), both).otherwise(both + F.least(F.col("n") - F.col("shared"), F.col("_n") - F.col("_shared")))


def _in_list() -> Column:
    return (F.col("a") == F.col("_a")) & F.col("s").eqNullSafe(F.col("t"))


def _star_pairs(listed: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a mixed list's leader with those of other components that may reach the threshold."""
    pairs = listed.join(mixed, _in_list()).where((F.col("label") != F.col("_label")) & _reaches(_most(), F.col("n"), F.col("_n"), percent))
    return pairs.select(F.col("leader").alias("a"), F.col("x").alias("b")).distinct()


def _rest_pairs(listed: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components in a mixed list that may reach the threshold."""
    inside = listed.join(mixed.select("_a", "t"), _in_list(), "left_semi")
    other = inside.select(F.col("a").alias("_a"), F.col("s").alias("t"), *[F.col(c).alias(f"_{c}") for c in ("x", "label", "n", "shared")])
    pairs = inside.join(other, _in_list() & (F.col("x") < F.col("_x")) & (F.col("label") != F.col("_label"))).where(_reaches(_most(), F.col("n"), F.col("_n"), percent))
    return pairs.select(F.col("x").alias("a"), F.col("_x").alias("b")).distinct()


def _contracted(label: DataFrame, found: DataFrame) -> DataFrame:
    """The components (node, component) of documents after further links."""
    ends = found
    for c in ("a", "b"):
        ends = ends.join(label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    above = components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    joined = label.union(found.select("a", "a")).union(found.select("b", "b"))
    return table(joined.join(above, "component", "left").groupBy("node").agg(F.min(F.coalesce("to", "component")).alias("component")), "labels")


def link_components(docs: DataFrame, doc_id: str, text: str, percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(sketches by document, (node, component) of every document that is linked with another).

    Sets are compared, each once, under their hash; a link of two sets links the smallest documents that
    have them.  So an id that is repeated with another text has the links of either.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    sketch = table(keyed.mapInArrow(lambda it: _sketches(it, width, bands, rows), _SKETCH), "sketches")
    full = sketch.where("doc is not null and n > 0")
    same = ["set_a", "set_b", "n"]
    # The smallest document of equal sets stands for all of them from here on.
    reps = full.groupBy(*same).agg(F.min("doc").alias("rep"), F.max("doc").alias("most"), F.first("keys").alias("keys"))
    reps = table(reps, "representatives")
    copies = full.select(*same, "doc").join(reps.where("rep < most").select(*same, "rep"), same).where("doc > rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    member = reps.select(F.col("set_a").alias("node"), "rep", F.explode("keys").alias("key"))
    # The leader is the set of the smallest document: copies come after what they are copies of.
    shared = member.groupBy("key").agg(F.min(F.struct("rep", "node")).alias("first"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", F.col("first.node").alias("leader"))
    star = table(member.join(shared, "key").select(F.col("leader").alias("a"), F.col("node").alias("b"), "rep").distinct(), "stars")
    node = table(star.select(F.col("b").alias("node"), "rep").distinct(), "nodes")
    bodies = keyed.join(node.select(F.col("rep").alias("doc")).distinct().hint("merge"), "doc", "left_semi").mapInArrow(lambda it: _full_sets(it, width), "node long, shingles array<long>")
    sets = table(bodies.dropDuplicates(["node"]), "sets")
    reached = _reaches(F.col("shared"), F.col("na"), F.col("nb"), percent)
    group = table(_score(star.select("a", "b"), sets), "scores")  # each leader's group, the leader included
    documents = lambda links: links.join(node.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(node.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    label = table(components(documents(group.where("a != b").where(reached).select("a", "b")).union(copies)), "labels")
    of_sets = lambda: node.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("label"))
    listed = table(_listed(group, of_sets(), sets, percent), "listed")
    for turn in range(ROUNDS + 1):
        mixed = table(_mixed(listed), "mixed")
        left = mixed.agg(F.sum(F.col("size") * F.col("size")).alias("pairs"), F.sum("size").alias("rows")).first()
        if not left.pairs:
            break
        last = turn == ROUNDS or left.pairs <= FEW * left.rows
        pairs = _rest_pairs(listed, mixed, percent) if last else _star_pairs(listed, mixed, percent)
        found = table(documents(_score(pairs, sets).where(reached).select("a", "b")), "found")
        if not found.isEmpty():
            label = _contracted(label, found)
        if last:
            break
        rest = listed.join(mixed.select("_a", "t", "leader"), _in_list()).where("x != leader")  # a leader has met all of its list
        listed = table(_labelled(rest.select("a", "s", "x", "n", "shared"), of_sets()), "listed")
    return sketch, label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; the smallest document of each component is kept.

    Documents link if 100 * |intersection| >= ``percent`` * |union| of their shingle sets.
    """
    sketch, label = link_components(docs, doc_id, text, percent, width, bands, rows)
    base = sketch.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"))
    joined = base.join(label.select(F.col("node").alias(doc_id), F.col("component").alias("component_id")), doc_id, "left")
    component = F.coalesce("component_id", doc_id)
    return joined.select(doc_id, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(doc_id), F.lit(True)).alias("kept"))


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The least even number of bands of which a pair at the threshold shares none with probability below MISSED."""
    none = 1 - (percent / 100) ** rows
    bands = 2
    while none**bands >= MISSED:
        bands += 2
    return bands


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, bands: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is kept, one for each group of near-duplicates; all columns pass through.  ``bands`` follow from ``percent`` if not given."""
    bands = bands or bands_for(percent)
    gone = near_duplicates(docs.select(doc_id, text), doc_id, text, percent, bands=bands).where("not kept").select(doc_id).distinct()
    return docs.join(gone, doc_id, "left_anti")
