"""Two-hop continuation of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import in_window

CONTINUATION_MINUTES = 30


def confirmed_transition(edge: str) -> Column:
    """A confirmed transition that names both its ends."""
    t = F.col(f"{edge}credential_transition")
    named = lambda c: F.coalesce(t[c], F.lit("")) != ""
    return F.coalesce(t["state"] == "confirmed", F.lit(False)) & named("from_identity") & named("to_identity")


def sanitize_edges(edges: DataFrame) -> DataFrame:
    """The effective identity is where a confirmed transition leads, else the identity, whatever the edge claims; missing states are ``unknown``."""
    return edges.withColumns(
        {
            "effective_identity": F.when(confirmed_transition(""), F.col("credential_transition.to_identity")).otherwise(F.col("identity")),
            "privilege_state": F.coalesce("privilege_state", F.lit("unknown")),
            "auth_state": F.coalesce("auth_state", F.lit("unknown")),
        }
    )


def duplicate_edge_ids(edges: DataFrame) -> DataFrame:
    """Edge ids that occur more than once, with their counts."""
    return edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1")


def reject_duplicate_edge_ids(edges: DataFrame) -> DataFrame:
    """``edges``; an action on it fails if an edge id occurs twice."""
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy("edge_id"))
    checked = edges.withColumn("_n", n).withColumn("edge_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate edge_id "), "edge_id"))).otherwise(F.col("edge_id")))
    return checked.drop("_n")


def session_lineage(first_logon: Column, next_source_logon: Column) -> Column:
    """session-exact or mismatch where both sessions are known, else identity."""
    known = first_logon.isNotNull() & next_source_logon.isNotNull()
    return F.when(known & (first_logon == next_source_logon), "session-exact").when(known, "mismatch").otherwise("identity")


def transition_links(first: str = "first", nxt: str = "next") -> Column:
    """Whether the next hop's confirmed transition goes from the first hop's effective identity to its own."""
    t = F.col(f"{nxt}.credential_transition")
    ends = (t["from_identity"] == F.col(f"{first}.effective_identity")) & (t["to_identity"] == F.col(f"{nxt}.effective_identity"))
    return confirmed_transition(f"{nxt}.") & F.coalesce(ends, F.lit(False))


def continuation_pairs(edges: DataFrame, minutes: float = CONTINUATION_MINUTES) -> DataFrame:
    """(first, next, lineage) for hops that go on from a host: same identity or a confirmed transition from it, later by at most ``minutes``.

    A next hop is listed under its identity and, if different, under the identity it was confirmed to
    come from, so the join is on equal keys and no pair comes twice.  Time bins of the window's length
    are part of the key: a busy hub's hops meet only those of two bins.
    """
    micros = int(minutes * 60_000_000)
    whole = F.struct(*[F.col(f"`{c}`") for c in edges.columns])
    slot = F.floor(F.unix_micros("ts") / micros)
    first = edges.select(F.col("target_host").alias("host"), F.col("effective_identity").alias("key"), F.explode(F.array(slot, slot + 1)).alias("bin"), whole.alias("first"))
    came = F.when(confirmed_transition(""), F.col("credential_transition.from_identity"))
    keys = F.array_distinct(F.array_compact(F.array("identity", came)))
    then = edges.select(F.col("source_host").alias("host"), F.explode(keys).alias("key"), slot.alias("bin"), whole.alias("next"))
    age = F.unix_micros("next.ts") - F.unix_micros("first.ts")
    pairs = first.join(then, ["host", "key", "bin"]).where((age > 0) & (age <= micros) & (F.col("first.edge_id") != F.col("next.edge_id")))
    return pairs.select("first", "next", session_lineage(F.col("first.logon_id"), F.col("next.source_logon_id")).alias("lineage")).where("lineage != 'mismatch'")


def second_hops(edges: DataFrame, minutes: float = CONTINUATION_MINUTES) -> DataFrame:
    """(edge_id) of the edges that are the next hop of some pair of :func:`continuation_pairs`; the pairs aren't made.

    A next hop that names its source session meets the first hops of that session and those that know none; one that names none meets all.
    """
    micros = int(minutes * 60_000_000)
    at, exact = F.unix_micros("ts"), lambda c: F.concat(F.lit("="), c)
    first = edges.where("target_host is not null and effective_identity is not null and edge_id is not null")
    first = first.select(F.col("target_host").alias("host"), F.col("effective_identity").alias("key"), F.explode(F.array(F.lit("any"), F.coalesce(exact("logon_id"), F.lit("none")))).alias("via"), at.alias("at"), F.col("edge_id").alias("least"), F.col("edge_id").alias("most"))
    came = F.when(confirmed_transition(""), F.col("credential_transition.from_identity"))
    vias = F.when(F.col("source_logon_id").isNull(), F.array(F.lit("any"))).otherwise(F.array(exact("source_logon_id"), F.lit("none")))
    then = edges.where("source_host is not null").select(F.col("source_host").alias("host"), F.explode(F.array_distinct(F.array_compact(F.array("identity", came)))).alias("key"), vias.alias("vias"), F.col("edge_id").alias("seq"), (at - micros).alias("low"))
    then = then.select("host", "key", F.explode("vias").alias("via"), "seq", "low")
    near = in_window(then, first, ["host", "key", "via"], micros - 1, {"least": F.min, "most": F.max})
    return near.where("least != seq or most != seq").select(F.col("seq").alias("edge_id"))


def build_index(edges: DataFrame, minutes: float = CONTINUATION_MINUTES) -> tuple[DataFrame, DataFrame]:
    """All pairs, and the ids of the edges that are a second hop."""
    return continuation_pairs(edges, minutes), second_hops(edges, minutes)
