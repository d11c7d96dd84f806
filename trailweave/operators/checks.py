"""Contract and integrity checks: each returns the violations it finds, one row for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import scalars as S

from .policy import CONFIDENCE, Context

# The states and labels of the contracts.
STATES = ["confirmed", "absent", "unknown"]
LINK_STATES = ["confirmed", "unknown"]
PROGRESSIONS = ["CRITICAL_UNAPPROVED_PATH", "CREDENTIAL_TRANSITION_PROGRESSION", "PRIVILEGED_PROGRESSION", "POSSIBLE_PRIVILEGED_PROGRESSION", "PRIVILEGED_DESTINATION_REACH", "PIVOT_PROGRESSION"]


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _outside(c: str, values: list[str]) -> Column:
    return ~F.coalesce(F.col(c).isin(values), F.lit(False))


def violations(df: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """(key, message) for each rule that a row breaks; a rule whose condition is null isn't broken."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("message"))


def check_pivot_edges(edges: DataFrame) -> DataFrame:
    t = F.col("credential_transition")
    required = [(_blank(c), f"{c} is missing") for c in ("edge_id", "source_host", "target_host", "identity", "effective_identity")]
    return violations(
        edges,
        "edge_id",
        [
            *required,
            (F.col("ts").isNull(), "@timestamp is not a date-time"),
            (_outside("service", ["rdp", "smb"]), "service is not rdp or smb"),
            (_outside("privilege_state", STATES), "privilege_state is not a known state"),
            (_outside("auth_state", STATES), "auth_state is not a known state"),
            (~S.is_ip(F.col("source_ip")), "source_ip is not an address"),
            (~S.is_ip(F.col("target_ip")), "target_ip is not an address"),
            (t.isNotNull() & (_blank("credential_transition.from_identity") | _blank("credential_transition.to_identity")), "credential_transition lacks an identity"),
            (t.isNotNull() & _outside("credential_transition.state", LINK_STATES), "credential_transition.state is not a known state"),
            (F.col("evidence_refs").isNull(), "evidence_refs is missing"),
        ],
    )


def check_reachability_edges(edges: DataFrame, version: str = "2.0") -> DataFrame:
    entities = ("subject", "effective_subject", "source", "target")
    lacks = lambda e: _blank(f"{e}.id") | _blank(f"{e}.kind") | F.coalesce(F.col(f"{e}.display_name") == "", F.lit(False))
    t = "credential_transition"
    there = F.col(t).isNotNull()
    empty = lambda r, c: F.coalesce(r[c], F.lit("")) == ""
    refs = [f.name for f in edges.schema["evidence_refs"].dataType.elementType.fields]
    rules = [lambda r: empty(r, "evidence_ref") | empty(r, "source_type")]
    rules += [lambda r: F.coalesce(r["source_file"] == "", F.lit(False))] if "source_file" in refs else []
    rules += [lambda r: ~F.coalesce(r["source_sha256"].rlike("^[0-9a-f]{64}$"), F.lit(True))] if "source_sha256" in refs else []
    return violations(
        edges,
        "edge_id",
        [
            (F.coalesce(F.col("schema_version"), F.lit("")) != version, "schema_version is not the supported one"),
            (_blank("edge_id"), "edge_id is missing"),
            (F.col("ts").isNull(), "@timestamp is not a date-time"),
            (_outside("environment", ["on_prem", "aws"]), "environment is not known"),
            (_outside("edge_type", ["authenticated_to", "assumed_role", "accessed_resource"]), "edge_type is not known"),
            *[(lacks(e), f"{e} lacks kind or id, or has an empty name") for e in entities],
            (_outside("session.state", LINK_STATES), "session.state is not a known state"),
            (_outside("auth_state", STATES), "auth_state is not a known state"),
            (_outside("privilege_state", STATES), "privilege_state is not a known state"),
            (there & (lacks(f"{t}.from_subject") | lacks(f"{t}.to_subject")), "credential_transition lacks a subject"),
            (there & _outside(f"{t}.state", LINK_STATES), "credential_transition.state is not a known state"),
            (F.coalesce(F.size("evidence_refs"), F.lit(0)) < 1, "evidence_refs is empty"),
            (F.exists("evidence_refs", lambda r: reduce(lambda a, b: a | b, [rule(r) for rule in rules])), "evidence_refs has an item without type or reference, or with an empty file or a bad sha256"),
            (F.col("native_context").isNull(), "native_context is missing"),
        ],
    )


def check_findings(findings: DataFrame) -> DataFrame:
    """The key is the label, identity and path of a finding."""
    keyed = findings.withColumn("_key", F.concat_ws("|", "label", F.coalesce("identity", F.lit("None")), F.array_join("path", ">", "None")))
    progression = F.col("label").isin(PROGRESSIONS)
    hosts, n_edges = (F.coalesce(F.size(c), F.lit(0)) for c in ("path", "edges"))
    return violations(
        keyed,
        "_key",
        [
            (_outside("label", list(CONFIDENCE)), "label is not known"),
            (_outside("confidence", sorted(set(CONFIDENCE.values()))), "confidence is not known"),
            (_blank("identity"), "identity is missing"),
            (_blank("rationale"), "rationale is missing"),
            (hosts < 1, "path is empty"),
            (n_edges < 1, "edges is empty"),
            (progression & ((hosts < 3) | (n_edges < 2)), "a progression needs three hosts and two edges"),
            ((F.col("label") == "NONE") & (n_edges != 1), "NONE needs one edge"),
        ],
    )


def check_edge_semantics(edges: DataFrame) -> DataFrame:
    t = F.col("credential_transition")
    sure = F.coalesce(t["state"] == "confirmed", F.lit(False))
    counted = edges.withColumn("_n", F.count("*").over(Window.partitionBy("edge_id")))
    same = F.col("effective_identity").eqNullSafe(F.col("identity"))
    return violations(
        counted,
        "edge_id",
        [
            (F.col("_n") > 1, "duplicate edge_id"),
            (~sure & ~same, "effective_identity differs without a confirmed transition"),
            (sure & ~t["to_identity"].eqNullSafe(F.col("effective_identity")), "confirmed transition does not lead to effective_identity"),
            (sure & (F.coalesce(t["evidence_ref"], F.lit("")) == ""), "confirmed transition without evidence_ref"),
            (sure & _blank("source_logon_id"), "confirmed transition without source_logon_id"),
            ((F.col("auth_state") == "confirmed") & (_blank("evidence_refs.logon") | _blank("evidence_refs.network")), "confirmed auth_state needs network and logon references"),
            ((F.col("privilege_state") == "confirmed") & _blank("evidence_refs.privilege"), "confirmed privilege_state needs a privilege reference"),
        ],
    )


def check_context(ctx: Context) -> DataFrame:
    """(key, message): unknown hosts or identities, bad dates, empty scopes."""
    hosts, identities = ctx.hosts.select("host").distinct(), ctx.identities.select("identity").distinct()

    def dangling(df: DataFrame, column: str, known: DataFrame, where: str) -> DataFrame:
        other = known.columns[0]
        lost = df.select(F.col(column).alias("key")).join(known.select(F.col(other).alias("key")), "key", "left_anti")
        return lost.select(F.col("key").cast("string"), F.lit(f"{where}: {column} is not declared").alias("message"))

    bad_date = lambda c: F.col(c).isNotNull() & S.iso_date(F.col(c)).isNull()
    policy = violations(
        ctx.policy.withColumn("_key", F.lit("policy")),
        "_key",
        [
            *[(S.iso_date(F.col(c)).isNull(), f"policy: {c} is not an ISO date") for c in ("valid_from", "valid_until")],
            (S.iso_date(F.col("valid_from")) > S.iso_date(F.col("valid_until")), "policy: valid_from is after valid_until"),
        ],
    )
    scopes = violations(ctx.complete_for, "identity", [(_blank("environment"), "complete_for: environment is missing"), (F.col("target_tier").isNull(), "complete_for: target_tier is not an integer")])
    changes = violations(ctx.approved_changes, "identity", [(bad_date(c), f"approved_changes: {c} is not an ISO date") for c in ("approved_from", "approved_until")])
    parts = [
        dangling(ctx.approved_paths, "via", hosts, "approved_paths"),
        dangling(ctx.approved_paths, "identity", identities, "approved_paths"),
        dangling(ctx.complete_for, "identity", identities, "complete_for"),
        dangling(ctx.approved_changes, "identity", identities, "approved_changes"),
        dangling(ctx.approved_changes, "target_host", hosts, "approved_changes"),
        dangling(ctx.known_edges, "identity", identities, "known_edges"),
        dangling(ctx.known_edges, "host", hosts, "known_edges"),
        policy,
        scopes,
        changes,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
