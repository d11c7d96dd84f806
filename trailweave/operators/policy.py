"""Context lookups, route policy and the classification of hops.

Context tables (see ``sources.context``): hosts(host, tier, critical), identities(identity,
justified_max_tier), policy(valid_from, valid_until), complete_for(environment, identity, target_tier),
approved_paths(identity, via, to_tier), approved_changes(identity, target_host, approved_from,
approved_until, via, service), known_edges(identity, host).  They are joined on equal keys; Spark
broadcasts them as long as their size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions import scalars as S
from trailweave.sources import scratch

from .graph import CONTINUATION_MINUTES, sanitize_edges, transition_links
from .progression import HELD, continuation_counts, hop_groups

# The confidence of each label.
CONFIDENCE = {
    "NONE": "none",
    "EXPECTED": "none",
    "JUSTIFIED": "none",
    "INSUFFICIENT_EVIDENCE": "low",
    "INSUFFICIENT_CONTEXT": "low",
    "PIVOT_PROGRESSION": "low",
    "POSSIBLE_PRIVILEGED_PROGRESSION": "low",
    "PRIVILEGED_DESTINATION_REACH": "medium",
    "PRIVILEGED_PROGRESSION": "medium",
    "CREDENTIAL_TRANSITION_PROGRESSION": "high",
    "CRITICAL_UNAPPROVED_PATH": "highest",
}


@dataclass
class Context:
    hosts: DataFrame
    identities: DataFrame
    policy: DataFrame
    complete_for: DataFrame
    approved_paths: DataFrame
    approved_changes: DataFrame
    known_edges: DataFrame


def confidence_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.element_at(table, label)


def with_host(df: DataFrame, hosts: DataFrame, host: str, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>_known``, ``_tier`` and ``_critical`` of a host; an undeclared host has no tier and isn't critical."""
    one = hosts.groupBy("host").agg(F.min("tier").alias(f"{prefix}_tier"), F.max("critical").alias(f"{prefix}_critical"), F.lit(True).alias(f"{prefix}_known"))
    joined = df.join(one.withColumnRenamed("host", f"_{prefix}"), F.col(host) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    return joined.withColumns({f"{prefix}_known": F.coalesce(f"{prefix}_known", F.lit(False)), f"{prefix}_critical": F.coalesce(f"{prefix}_critical", F.lit(False))})


def with_identity(df: DataFrame, identities: DataFrame, identity: str, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>_known`` and ``_max_tier`` of an identity."""
    one = identities.groupBy("identity").agg(F.min("justified_max_tier").alias(f"{prefix}_max_tier"), F.lit(True).alias(f"{prefix}_known"))
    joined = df.join(one.withColumnRenamed("identity", f"_{prefix}"), F.col(identity) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    return joined.withColumn(f"{prefix}_known", F.coalesce(f"{prefix}_known", F.lit(False)))


def with_novelty(df: DataFrame, known_edges: DataFrame, identity: str, target: str) -> DataFrame:
    """``df`` with ``novel``: the target isn't among the identity's known hosts."""
    known = known_edges.select(F.col("identity").alias("_ni"), F.col("host").alias("_nh")).distinct().withColumn("_seen", F.lit(True))
    return df.join(known, (F.col(identity) == F.col("_ni")) & (F.col(target) == F.col("_nh")), "left").withColumn("novel", F.col("_seen").isNull()).drop("_ni", "_nh", "_seen")


def with_route_decision(df: DataFrame, ctx: Context, identity: str, via: str, tier: str, ts: str, environment: str = "on_prem") -> DataFrame:
    """``df`` with ``route``: AUTHORIZED, PROHIBITED or UNKNOWN_CONTEXT.

    Without a policy that is valid on that day nothing is known (each policy row is tested by itself);
    an approved path authorises; a missing one prohibits only where the policy says it is complete for
    the identity and tier.  The policy's rows, one in any sound context, travel as one array.
    """
    spans = ctx.policy.select(F.struct(S.iso_date(F.col("valid_from")).alias("a"), S.iso_date(F.col("valid_until")).alias("b")).alias("s")).agg(F.collect_set("s").alias("s"))
    approved = ctx.approved_paths.select(F.col("identity").alias("_ai"), F.col("via").alias("_av"), F.col("to_tier").alias("_at")).distinct().withColumn("_approved", F.lit(True))
    complete = ctx.complete_for.where(F.col("environment") == environment).select(F.col("identity").alias("_ci"), F.col("target_tier").alias("_ct")).distinct().withColumn("_complete", F.lit(True))
    out = df.join(approved, (F.col(identity) == F.col("_ai")) & (F.col(via) == F.col("_av")) & (F.col(tier) == F.col("_at")), "left")
    out = out.join(complete, (F.col(identity) == F.col("_ci")) & (F.col(tier) == F.col("_ct")), "left").withColumns({"_day": F.to_date(ts), "_spans": spans.scalar()})
    valid = F.coalesce(F.exists("_spans", lambda s: F.coalesce(F.col("_day").between(s["a"], s["b"]), F.lit(False))), F.lit(False))
    route = F.when(~valid | F.col(tier).isNull(), "UNKNOWN_CONTEXT").when(F.col("_approved"), "AUTHORIZED").when(F.col("_complete"), "PROHIBITED").otherwise("UNKNOWN_CONTEXT")
    return out.withColumn("route", route).drop("_day", "_spans", "_ai", "_av", "_at", "_approved", "_ci", "_ct", "_complete")


def with_approved_change(df: DataFrame, changes: DataFrame, identity: str, target: str, via: str, service: str, ts: str) -> DataFrame:
    """``df`` with ``approved_change``: some change ticket covers the identity, target and day, and its via and service if it names them.

    A missing day bounds nothing; a ticket with a day that is no ISO date covers nothing.  The tickets of an
    identity and target are joined as one array, so no row of ``df`` comes twice.
    """
    first, last = S.iso_date(F.col("approved_from")), S.iso_date(F.col("approved_until"))
    sound = changes.where((F.col("approved_from").isNull() | first.isNotNull()) & (F.col("approved_until").isNull() | last.isNotNull()))
    ticket = F.struct(first.alias("a"), last.alias("b"), "via", "service")
    c = sound.groupBy(F.col("identity").alias("_i"), F.col("target_host").alias("_t")).agg(F.collect_set(ticket).alias("_tickets"))
    out = df.join(c, (F.col(identity) == F.col("_i")) & (F.col(target) == F.col("_t")), "left").withColumns({"_day": F.to_date(ts), "_via": F.col(via), "_service": F.col(service)})
    free = lambda bound, ok: F.coalesce(bound.isNull() | ok, F.lit(False))
    fits = lambda t: free(t["a"], F.col("_day") >= t["a"]) & free(t["b"], F.col("_day") <= t["b"]) & free(t["via"], t["via"] == F.col("_via")) & free(t["service"], t["service"] == F.col("_service"))
    return out.withColumn("approved_change", F.coalesce(F.exists("_tickets", fits), F.lit(False))).drop("_i", "_t", "_tickets", "_day", "_via", "_service")


def privilege_scope(source: Column, destination: Column) -> Column:
    return F.when(source & destination, "both").when(source, "source").when(destination, "destination").otherwise("none")


def with_context(edges: DataFrame, ctx: Context) -> DataFrame:
    """``edges`` with all that the context says of each: its hosts, its identities, novelty, route and change ticket.

    A pair's pivot host is the second edge's source host, so everything that a second hop is judged by
    but the first hop's own hosts and identities belongs to that one edge: lookups are made once for
    each edge, not for each pair.
    """
    e = with_host(with_host(edges, ctx.hosts, "source_host", "src"), ctx.hosts, "target_host", "dst")
    e = with_identity(with_identity(e, ctx.identities, "identity", "id"), ctx.identities, "effective_identity", "eff")
    e = with_novelty(e, ctx.known_edges, "effective_identity", "target_host")
    e = with_route_decision(e, ctx, "effective_identity", "source_host", "dst_tier", "ts")
    return with_approved_change(e, ctx.approved_changes, "effective_identity", "target_host", "source_host", "service", "ts")


def classify_hops(pairs: DataFrame, *also: str) -> DataFrame:
    """One finding for each pair (of edges :func:`with_context`) that is worth one, with the pairs' columns ``also``; the first clause that applies gives the label."""
    order = F.struct(F.col("first.ts").alias("t1"), F.col("first.edge_id").alias("e1"), F.col("next.ts").alias("t2"), F.col("next.edge_id").alias("e2"))
    return _judged(pairs.withColumn("order", order).where(_worth("next.")), *also)


def classify_hop_groups(edges: DataFrame, minutes: float = CONTINUATION_MINUTES, most: int = HELD) -> DataFrame:
    """What :func:`classify_hops` says of the hops among ``edges`` (:func:`with_context`), said once for the hops of two classes, with their ``firsts`` and ``nexts`` (see ``progression.hops``) and the ``looked_up`` route and change ticket."""
    groups = hop_groups(edges, _worth(), minutes, most).withColumn("order", F.lit(None).cast("struct<t1: timestamp, e1: string, t2: timestamp, e2: string>"))
    looked_up = F.struct("next.route", "next.approved_change").alias("looked_up")
    return _judged(groups.withColumn("looked_up", looked_up), "firsts", "nexts", "looked_up").drop("edges", "order")


def _worth(edge: str = "") -> Column:
    """Whether a hop is worth a finding: its target is new to the identity, of a higher tier or critical, or there is a change of credentials.

    The second edge says all of this, as its source is the host between the hops.
    """
    higher = F.coalesce(F.col(f"{edge}dst_tier") < F.col(f"{edge}src_tier"), F.lit(False))
    return F.col(f"{edge}novel") | higher | F.col(f"{edge}credential_transition").isNotNull() | F.col(f"{edge}dst_critical")


def _judged(pairs: DataFrame, *also: str) -> DataFrame:
    """The findings of pairs (first, next, lineage, order), of edges or of classes of edges."""
    p = pairs.select(
        "first", "next", "lineage", "order", *also, transition_links().alias("linked"),
        F.col("next.effective_identity").alias("who"), F.col("first.source_host").alias("h1"), F.col("first.target_host").alias("h2"), F.col("next.target_host").alias("h3"),
        F.col("first.identity").alias("i1"), F.col("first.effective_identity").alias("i2"), F.col("next.identity").alias("i3"),
        F.col("first.src_known").alias("a_known"), F.col("first.dst_known").alias("src_known"), F.col("first.dst_tier").alias("src_tier"),
        F.col("next.dst_known").alias("dst_known"), F.col("next.dst_tier").alias("dst_tier"), F.col("next.dst_critical").alias("dst_critical"),
        F.col("first.id_known").alias("p_known"), F.col("first.eff_known").alias("q_known"), F.col("next.id_known").alias("r_known"), F.col("next.eff_known").alias("w_known"),
        F.col("next.eff_max_tier").alias("w_max_tier"), F.col("next.novel").alias("novel"), F.col("next.route").alias("route"), F.col("next.approved_change").alias("approved_change"),
    )
    missing = lambda items: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(~F.col(f"{k}_known"), F.coalesce(n, F.lit("None"))) for n, k in items]))))
    p = p.withColumns({"undeclared_hosts": missing([("h1", "a"), ("h2", "src"), ("h3", "dst")]), "undeclared_identities": missing([("i1", "p"), ("i2", "q"), ("i3", "r"), ("who", "w")])})
    confirmed = lambda c: F.coalesce(F.col(c) == "confirmed", F.lit(False))
    has_transition = F.col("next.credential_transition").isNotNull()
    auth = confirmed("first.auth_state") & confirmed("next.auth_state")
    src_priv, dst_priv = confirmed("first.privilege_state"), confirmed("next.privilege_state")
    crown = F.coalesce((F.col("dst_tier") == 0) & F.col("dst_critical"), F.lit(False))
    unknown = (F.size("undeclared_hosts") > 0) | (F.size("undeclared_identities") > 0)
    listed = lambda c: F.array_join(c, ", ")
    undeclared = F.concat(F.lit("The context doesn't declare all of the path: hosts ["), listed("undeclared_hosts"), F.lit("], identities ["), listed("undeclared_identities"), F.lit("]."))
    clauses = [
        (~auth, "INSUFFICIENT_EVIDENCE", F.lit("The authentication of one of the hops isn't confirmed.")),
        (has_transition & ~F.col("linked"), "INSUFFICIENT_EVIDENCE", F.lit("A change of credentials is indicated, but not confirmed to come from the first hop.")),
        (unknown, "INSUFFICIENT_CONTEXT", undeclared),
        (crown & (F.col("route") == "AUTHORIZED"), "EXPECTED", F.lit("An approved administrative path leads to this tier-0 host.")),
        (crown & (F.col("route") == "PROHIBITED"), "CRITICAL_UNAPPROVED_PATH", F.lit("A critical tier-0 host was reached over a path that the valid and complete policy doesn't approve.")),
        (crown, "INSUFFICIENT_CONTEXT", F.lit("A critical tier-0 host was reached; the policy is not valid that day, or not complete for this identity and tier.")),
        (F.col("approved_change"), "JUSTIFIED", F.lit("A change ticket covers this access.")),
        (F.col("route") == "AUTHORIZED", "EXPECTED", F.lit("The path is an approved administrative one.")),
        (F.col("linked"), "CREDENTIAL_TRANSITION_PROGRESSION", F.lit("After a confirmed change of credentials the access went on.")),
        (src_priv & (F.col("lineage") == "session-exact"), "PRIVILEGED_PROGRESSION", F.lit("The very session that was privileged on the middle host went on.")),
        (src_priv, "POSSIBLE_PRIVILEGED_PROGRESSION", F.lit("The identity was privileged on the middle host and went on; that it was the same session isn't shown.")),
        (dst_priv, "PRIVILEGED_DESTINATION_REACH", F.lit("The onward hop ended in a privileged session.")),
    ]
    label, rationale = F.lit("PIVOT_PROGRESSION"), F.lit("Access spread to a host that is new to the identity or of a higher tier, without privileges.")
    for applies, name, why in reversed(clauses):
        label, rationale = F.when(applies, name).otherwise(label), F.when(applies, why).otherwise(rationale)
    considered = ~(~auth | (has_transition & ~F.col("linked")) | unknown)
    modifiers = F.struct(
        F.col("src_tier"),
        F.col("dst_tier"),
        F.col("novel").alias("target_novelty"),
        F.col("dst_critical").alias("target_critical"),
        privilege_scope(src_priv, dst_priv).alias("privilege_scope"),
        F.col("lineage").alias("session_lineage"),
        F.col("first.privilege_state").alias("source_session_privilege"),
        F.col("next.privilege_state").alias("destination_session_privilege"),
        has_transition.alias("credential_transition_present"),
        F.col("linked").alias("credential_transition_confirmed"),
        auth.alias("evidence_completeness"),
        F.col("w_max_tier").alias("identity_tier_entitlement"),
        F.when(considered, F.col("route")).alias("route_policy_state"),
        F.col("undeclared_hosts"),
        F.col("undeclared_identities"),
    )
    return p.select(
        label.alias("label"),
        F.array("h1", "h2", "h3").alias("path"),
        F.col("who").alias("identity"),
        F.array("order.e1", "order.e2").alias("edges"),
        rationale.alias("rationale"),
        modifiers.alias("modifiers"),
        "order",
        *also,
    )


def aggregate_findings(findings: DataFrame) -> DataFrame:
    """One finding for each (label, identity, path): the first seen, with the number of occurrences (each row's ``n``)."""
    path = F.array_join("path", "|", "None")
    first = F.min_by(F.struct("path", "edges", "rationale", "modifiers"), F.struct(F.col("order"), F.array_join("edges", "|"))).alias("f")
    grouped = findings.groupBy("label", "identity", path.alias("_path")).agg(first, F.sum("n").alias("occurrence_count"))
    return grouped.select(
        "label",
        confidence_of(F.col("label")).alias("confidence"),
        F.col("f.path").alias("path"),
        "identity",
        F.col("f.edges").alias("edges"),
        F.col("f.rationale").alias("rationale"),
        F.col("f.modifiers").alias("modifiers"),
        "occurrence_count",
        F.lit(True).alias("first_seen_in_window"),
        F.col("f.modifiers.target_novelty").alias("baseline_novel"),
    )


def standalone_findings(edges: DataFrame, used: DataFrame, judged: DataFrame) -> DataFrame:
    """Edges that neither lead to a finding nor are a second hop (those are ``used``): NONE, or INSUFFICIENT_EVIDENCE without confirmed authentication."""
    alone = edges.join(used, "edge_id", "left_anti")
    sure = F.coalesce(F.col("auth_state") == "confirmed", F.lit(False))
    return alone.select(
        F.when(sure, "NONE").otherwise("INSUFFICIENT_EVIDENCE").alias("label"),
        F.array("source_host", "target_host").alias("path"),
        F.col("effective_identity").alias("identity"),
        F.array("edge_id").alias("edges"),
        F.when(sure, "An authenticated session from which nothing went on.").otherwise("A single edge whose authentication isn't confirmed.").alias("rationale"),
        F.lit(None).cast(judged.schema["modifiers"].dataType).alias("modifiers"),
        F.struct(F.col("ts").alias("t1"), F.col("edge_id").alias("e1"), F.lit(None).cast("timestamp").alias("t2"), F.lit(None).cast("string").alias("e2")).alias("order"),
        F.lit(1).cast("long").alias("n"),
    )


def classify(edges: DataFrame, ctx: Context, minutes: float = CONTINUATION_MINUTES) -> DataFrame:
    """All findings of a set of edges with unique ids (see ``graph.reject_duplicate_edge_ids``).

    The context is looked up once for each edge, and hops are counted by classes of edges, not as pairs
    (see ``progression``).
    """
    clean = sanitize_edges(edges)
    known = scratch.table(with_context(clean, ctx), "edges-in-context")
    counted, used = continuation_counts(known, _worth(), minutes)
    judged = _judged(counted, "n")
    return aggregate_findings(judged.unionByName(standalone_findings(clean, used, judged)))
