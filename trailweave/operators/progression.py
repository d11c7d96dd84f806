"""Two-hop findings without pairs of hops: counts and first sightings by a sweep over time.

What a pair of hops amounts to follows from the classes of its two edges (hosts, identities, what
the context says of them, states) and from whether their sessions match; edges of one class are
alike but for their time and id.  So pairs are never made.  Edges meet under a key (the
host between the hops, the identity that goes on, the session that must match) and a
time bin; there, one side's edges are the *anchors*, and a sweep in order of time gives for each anchor, for
eight classes of the other side at once, how many of their edges lie in its window (differences of running
counts) and the first of them.  The side that makes fewer rows is the anchor: n edges and m of k other
classes are about 2 n k / 8 + m rows, though n x m hops.

An edge that comes before another is the first hop if the other goes on from its target host, at most the window later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.sources import scratch

from .graph import confirmed_transition

_GROUP = ["host", "key", "via", "bin"]
_FIRST = ["source_host", "target_host", "identity", "effective_identity", "src_known", "dst_known", "dst_tier", "id_known", "eff_known", "auth_state", "privilege_state"]
_NEXT = ["target_host", "identity", "effective_identity", "dst_known", "dst_tier", "dst_critical", "id_known", "eff_known", "eff_max_tier", "novel", "route", "approved_change", "auth_state", "privilege_state"]


_PLACES = 8  # classes that a sweep counts at once
HELD = 1024  # edges of a class in a row of hop groups


def _classed(edges: DataFrame, columns: list[str], extra: list[Column]) -> DataFrame:
    """``edges`` with their class: its columns as a struct, and a 128-bit name of it."""
    with_class = edges.withColumn("class", F.struct(*columns, *extra))
    return with_class.withColumn("class_id", F.md5(F.to_json("class", {"ignoreNullFields": "false"})))


def _classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with their class as first hops, and as next hops."""
    t = F.col("credential_transition")
    change = F.when(t.isNotNull(), F.struct(t["state"].alias("state"), t["from_identity"].alias("from_identity"), t["to_identity"].alias("to_identity"))).alias("credential_transition")
    return _classed(edges, _FIRST, []), _classed(edges, _NEXT, [change])


def _sides(first: DataFrame, then: DataFrame, worth: Column, micros: int) -> DataFrame:
    """First hops and next hops under their keys: (host, key, via, bin, is_next, at, id, class_id, counts).

    ``via`` says which sessions may meet: a next hop that names its source session meets the first hops of that session, and
    those that know none; one that names none meets all.  ``counts``: not a next hop that isn't worth a finding.
    """
    at, t = F.unix_micros("ts"), F.col("credential_transition")
    slot = F.floor(at / micros)
    exact = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("="), c))
    own = lambda is_next, counts: [F.lit(is_next).alias("is_next"), at.alias("at"), F.col("edge_id").alias("id"), "class_id", counts.alias("counts")]
    known = lambda side: side.where("host is not null and key is not null and bin is not null")
    first = first.select(
        F.col("target_host").alias("host"), F.col("effective_identity").alias("key"),
        F.explode(F.array(F.lit("any"), F.coalesce(exact("logon_id"), F.lit("none")))).alias("via"), F.array(slot, slot + 1).alias("bins"), *own(False, F.lit(True)),
    ).select("host", "key", "via", F.explode("bins").alias("bin"), "is_next", "at", "id", "class_id", "counts")
    keys = F.array_distinct(F.array_compact(F.array("identity", F.when(confirmed_transition(""), t["from_identity"]))))
    vias = F.when(F.col("source_logon_id").isNull(), F.array(F.lit("any"))).otherwise(F.array(exact("source_logon_id"), F.lit("none")))
    then = then.select(
        F.col("source_host").alias("host"), F.explode(keys).alias("key"), vias.alias("vias"), slot.alias("bin"), *own(True, F.coalesce(worth, F.lit(False))),
    ).select("host", "key", F.explode("vias").alias("via"), "bin", "is_next", "at", "id", "class_id", "counts")
    return known(first).unionByName(known(then))


def _events(sides: DataFrame, micros: int) -> DataFrame:
    """The rows of the sweeps: 0 where an anchor's window begins, 1 another edge, 2 where a window ends; times are inclusive.

    The classes of the other side are numbered within a group; a sweep (``part``) counts ``_PLACES`` of them, each in its ``place``.
    """
    whole, ranked = Window.partitionBy(*_GROUP), Window.partitionBy(*_GROUP).orderBy("is_next", "class_id")
    nxt = F.col("is_next")
    rows = sides.repartition(*_GROUP).withColumn("rank", F.dense_rank().over(ranked))
    rows = rows.withColumns({"n": F.count_if(~nxt).over(whole), "m": F.count_if(nxt).over(whole), "n_kinds": F.coalesce(F.max(F.when(~nxt, F.col("rank"))).over(whole), F.lit(0)), "kinds": F.max("rank").over(whole)}).where("n > 0 and m > 0")
    sweeps = lambda kinds: F.ceil(kinds / _PLACES)
    n_sweeps, m_sweeps = sweeps(F.col("n_kinds")), sweeps(F.col("kinds") - F.col("n_kinds"))
    # First hops are the anchors if they make fewer rows.
    rows = rows.withColumn("forward", 2 * F.col("n") * m_sweeps + F.col("m") < 2 * F.col("m") * n_sweeps + F.col("n"))
    number = F.when(nxt, F.col("rank") - F.col("n_kinds")).otherwise(F.col("rank")) - 1
    low = F.when(F.col("forward"), F.col("at") + 1).otherwise(F.col("at") - micros)
    row = lambda kind, time, part, place: F.struct(F.lit(kind).alias("kind"), time.alias("time"), part.cast("int").alias("part"), place.cast("int").alias("place"))
    none = F.lit(None)
    marks = F.flatten(F.transform(F.sequence(F.lit(0), (F.when(F.col("forward"), m_sweeps).otherwise(n_sweeps) - 1).cast("int")), lambda part: F.array(row(0, low, part, none), row(2, low + micros - 1, part, none))))
    other = F.array(row(1, F.col("at"), F.floor(number / _PLACES), number % _PLACES))
    return rows.select(*_GROUP, "forward", "at", "id", "class_id", "counts", F.inline(F.when(nxt == F.col("forward"), other).otherwise(marks)))


def _sweep(events: DataFrame, micros: int) -> DataFrame:
    """``events`` with, for each place, ``before`` (others up to here) and ``near`` (the first other from here on, if in the window), and ``covered`` (this other lies in the window of an anchor that counts)."""
    by = [*_GROUP, "part"]
    so_far = Window.partitionBy(*by).orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy(*by).orderBy(F.desc("time"), F.desc("kind"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    kind, counts = F.col("kind"), F.col("counts")
    here = lambda j: counts & F.coalesce(F.col("place") == j, F.lit(False))
    swept = events.withColumns({f"before{j}": F.count_if(here(j)).over(so_far) for j in range(_PLACES)})
    nearest = {f"near{j}": F.last(F.when(here(j), F.struct("time", "id", "class_id")), ignorenulls=True).over(from_end) for j in range(_PLACES)}
    swept = swept.withColumns({**nearest, "end": F.last(F.when((kind == 2) & counts, F.col("time")), ignorenulls=True).over(from_end)})
    hit = lambda j: F.when((kind == 0) & (F.col(f"near{j}.time") < F.col("time") + micros), F.col(f"near{j}"))
    before = F.when(kind != 1, F.array(*[F.col(f"before{j}") for j in range(_PLACES)]))
    covered = (kind == 1) & F.coalesce(F.col("end") < F.col("time") + micros, F.lit(False))
    return swept.select(*by, "forward", "at", "id", "class_id", "counts", "kind", before.alias("before"), F.array(*[hit(j) for j in range(_PLACES)]).alias("near"), covered.alias("covered")).withColumn("hit", F.exists("near", lambda x: x.isNotNull()))


def continuation_counts(edges: DataFrame, worth: Column, minutes: float) -> tuple[DataFrame, DataFrame]:
    """(first, next, lineage, n, order) for the classes of hops that are ``worth`` it, and (edge_id) of edges that are a second hop or the first one of a hop that is.

    ``edges``: as ``policy.with_context`` makes them, with unique ids.  ``first`` and ``next`` are structs of what the
    edges of a class share; ``n`` is the number of their hops, ``order`` (t1, e1, t2, e2) the first of them.
    ``worth``: a condition on the next hop, the same for all edges of a class that leave one host.
    """
    micros = int(minutes * 60_000_000)
    first, then = _classes(edges)
    swept = scratch.table(_sweep(_events(_sides(first, then, worth, micros), micros), micros), "hops")
    near = lambda j: F.get("near", F.lit(j))
    anchor, other = lambda j: F.struct(F.col("at").alias("time"), "id", "class_id"), near
    one, two = (lambda j: F.when(F.col("forward"), anchor(j)).otherwise(other(j))), (lambda j: F.when(F.col("forward"), other(j)).otherwise(anchor(j)))
    order = lambda j: F.struct(F.timestamp_micros(one(j)["time"]).alias("t1"), one(j)["id"].alias("e1"), F.timestamp_micros(two(j)["time"]).alias("t2"), two(j)["id"].alias("e2"), one(j)["class_id"].alias("first_id"), two(j)["class_id"].alias("next_id"))
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    counted = swept.where("counts and kind != 1").groupBy(*_GROUP, "part", "forward", "class_id").agg(*[x for j in range(_PLACES) for x in (F.sum(sign * F.get("before", F.lit(j))).alias(f"n{j}"), F.min(F.when(near(j).isNotNull(), order(j))).alias(f"o{j}"))])
    counted = counted.select(_lineage().alias("lineage"), F.inline(F.array(*[F.struct(F.col(f"n{j}").alias("n"), F.col(f"o{j}").alias("o")) for j in range(_PLACES)]))).where("n > 0")
    order = F.struct("o.t1", "o.e1", "o.t2", "o.e2")
    counted = counted.groupBy(F.col("o.first_id").alias("first_id"), F.col("o.next_id").alias("next_id"), "lineage").agg(F.sum("n").alias("n"), F.min(order).alias("order"))
    named = lambda side, n: side.groupBy(F.col("class_id").alias(f"{n}_id")).agg(F.any_value("class").alias(n))
    counted = counted.join(named(first, "first"), "first_id").join(named(then, "next"), "next_id")
    # An anchor that is a next hop, or another that a first hop's window covers, is a second hop; the other two are first hops of worth.
    used = swept.where("covered or hit").select(F.col("id").alias("edge_id")).distinct()
    return counted.select("first", "next", "lineage", "n", "order"), used


def hop_groups(edges: DataFrame, worth: Column, minutes: float, most: int = HELD) -> DataFrame:
    """(first, next, lineage, firsts, nexts): classes of hops that are ``worth`` it and meet under a key and a bin, with the edges (at, id) of either class there.

    ``edges``: as ``policy.with_context`` makes them.  :func:`hops` makes the pairs.  At most ``most`` edges of a class, neighbours in time, are in
    a row, so a busy host's hops are many rows that any task can take; rows whose times can't meet are left out.
    """
    micros = int(minutes * 60_000_000)
    first, then = _classes(edges)
    sides = _sides(first, then.where(F.coalesce(worth, F.lit(False))), worth, micros)
    place = F.row_number().over(Window.partitionBy(*_GROUP, "is_next", "class_id").orderBy("at"))
    own = F.col("is_next") | (F.col("bin") == F.floor(F.col("at") / micros))  # first hops take their second bin as rows of many
    sides = sides.where(own).repartition(*_GROUP).withColumn("part", F.floor((place - 1) / most))
    rows = sides.groupBy(*_GROUP, "is_next", "class_id", "part").agg(F.collect_list(F.struct("at", "id")).alias("held"), F.min("at").alias("low"), F.max("at").alias("high"))
    named = lambda side, n: side.select(F.col("class_id"), F.col("class").alias(n)).distinct()
    rows = scratch.table(rows.drop("part").join(named(first, "first"), "class_id", "left").join(named(then, "next"), "class_id", "left").drop("class_id"), "hop-groups")
    one = rows.where("not is_next").withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") + 1)))
    one = one.select(*_GROUP, "first", F.col("held").alias("firsts"), F.col("low").alias("begun"), F.col("high").alias("ended"))
    two = rows.where("is_next").select(*_GROUP, "next", F.col("held").alias("nexts"), "low", "high")
    met = one.join(two, _GROUP).where((F.col("high") > F.col("begun")) & (F.col("low") <= F.col("ended") + micros))
    return met.select("first", "next", _lineage().alias("lineage"), "firsts", "nexts")


def hops(groups: DataFrame, minutes: float) -> DataFrame:
    """A row (first_id, next_id, all but ``firsts`` and ``nexts``) for each hop of ``groups``, dealt to all tasks: nothing but ids and times is looked at for a pair."""
    micros = int(minutes * 60_000_000)
    rest = [F.col(f"`{c}`") for c in groups.columns if c not in ("firsts", "nexts")]
    dealt = groups.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism, "firsts", "nexts")
    pairs = dealt.select(*rest, "nexts", F.explode("firsts").alias("one")).select(*rest, "one", F.explode("nexts").alias("two"))
    age = F.col("two.at") - F.col("one.at")
    return pairs.where((age > 0) & (age <= micros) & (F.col("one.id") != F.col("two.id"))).select(F.col("one.id").alias("first_id"), F.col("two.id").alias("next_id"), *rest)


def _lineage() -> Column:
    return F.when(F.col("via").startswith("="), "session-exact").otherwise("identity")
