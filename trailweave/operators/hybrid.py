"""Edges of different environments in one vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions import scalars as S

SCHEMA_VERSION = "2.0"


def pivot_to_reachability(edges: DataFrame, version: str = SCHEMA_VERSION, *also: str) -> DataFrame:
    """On-premises edges in the common form, with their columns ``also``."""
    refs = F.array(*[F.struct(F.lit(k).alias("source_type"), F.col(f"evidence_refs.{k}").alias("evidence_ref"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("source_sha256")) for k in ("network", "logon", "privilege")])
    t = F.col("credential_transition")
    lifted = F.struct(S.on_prem_identity(t["from_identity"]).alias("from_subject"), S.on_prem_identity(t["to_identity"]).alias("to_subject"), t["state"].alias("state"), t["evidence_ref"].alias("evidence_ref"))
    native = F.create_map(*[x for k in ("service", "source_ip", "target_ip", "logon_id", "source_logon_id") for x in (F.lit(k), F.col(k))])
    session = F.struct(F.col("logon_id").alias("id"), F.col("source_logon_id").alias("parent_session_id"), F.when(F.coalesce("logon_id", F.lit("")) != "", "confirmed").otherwise("unknown").alias("state"))
    return edges.select(
        F.lit(version).alias("schema_version"),
        F.concat(F.lit("onprem:"), "edge_id").alias("edge_id"),
        "ts",
        F.lit("on_prem").alias("environment"),
        F.lit("authenticated_to").alias("edge_type"),
        S.on_prem_identity(F.col("identity")).alias("subject"),
        S.on_prem_identity(F.col("effective_identity")).alias("effective_subject"),
        S.on_prem_host(F.col("source_host")).alias("source"),
        S.on_prem_host(F.col("target_host")).alias("target"),
        session.alias("session"),
        F.coalesce("auth_state", F.lit("unknown")).alias("auth_state"),
        F.coalesce("privilege_state", F.lit("unknown")).alias("privilege_state"),
        F.when(t.isNotNull(), lifted).alias("credential_transition"),
        F.filter(refs, lambda r: F.coalesce(r["evidence_ref"], F.lit("")) != "").alias("evidence_refs"),
        F.map_filter(native, lambda k, v: v.isNotNull()).alias("native_context"),
        *also,
    )


def _text(path: str) -> Column:
    return F.nullif(F.try_variant_get("v", f"$.{path}", "string"), F.lit(""))


def assume_role_records(records: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    """Cloud audit records (column ``v``, a variant; source_file and source_sha256 if known) as edges, or with the reason why not.

    Accepted is one successful sts:AssumeRole with all its parts.  ``reason`` is null for those.
    """
    for c in ("source_file", "source_sha256"):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast("string"))
    # Each field is looked up once in a record, however often it is used below.
    fields = ["eventID", "eventTime", "eventSource", "eventName", "errorCode", "errorMessage", "awsRegion", "sourceIPAddress", "userIdentity.arn", "userIdentity.principalId", "userIdentity.userName", "requestParameters.roleArn", "requestParameters.roleSessionName", "responseElements.credentials.accessKeyId", "responseElements.assumedRoleUser.assumedRoleId", "responseElements.assumedRoleUser.arn"]
    records = records.select("v", "source_file", "source_sha256", *[_text(f).alias(f) for f in fields])
    text = lambda f: F.col(f"`{f}`")
    actor, display = S.aws_actor(text("userIdentity.arn"), text("userIdentity.principalId"), text("userIdentity.userName"))
    session = F.coalesce(text("responseElements.credentials.accessKeyId"), text("responseElements.assumedRoleUser.assumedRoleId"))
    needed = {"eventID": text("eventID"), "eventTime": text("eventTime"), "actor": actor, "requestParameters.roleArn": text("requestParameters.roleArn"), "assumed session id": session}
    missing = F.array_join(F.array_compact(F.array(*[F.when(v.isNull(), k) for k, v in needed.items()])), ", ")
    is_role = (text("eventSource") == "sts.amazonaws.com") & (text("eventName") == "AssumeRole")
    failed = text("errorCode").isNotNull() | text("errorMessage").isNotNull()
    reason = F.when(~F.coalesce(is_role, F.lit(False)), "not sts:AssumeRole").when(failed, "failed AssumeRole").when(missing != "", F.concat(F.lit("missing "), missing))
    role_arn = needed["requestParameters.roleArn"]
    subject = S.entity("cloud_principal", "principal:aws:", actor, display)
    role = S.entity("cloud_role", "role:aws:", role_arn, S.role_short_name(role_arn))
    native = F.create_map(*[x for k, v in {"event_source": "eventSource", "event_name": "eventName", "aws_region": "awsRegion", "source_ip": "sourceIPAddress", "role_session_name": "requestParameters.roleSessionName", "assumed_role_arn": "responseElements.assumedRoleUser.arn"}.items() for x in (F.lit(k), text(v))])
    ref = F.struct(F.lit("cloudtrail").alias("source_type"), needed["eventID"].alias("evidence_ref"), "source_file", "source_sha256")
    return records.select(
        reason.alias("reason"),
        F.lit(version).alias("schema_version"),
        F.concat(F.lit("aws:"), F.substring(F.sha2(F.to_json("v"), 256), 1, 24)).alias("edge_id"),
        S.utc_ts(needed["eventTime"]).alias("ts"),
        F.lit("aws").alias("environment"),
        F.lit("assumed_role").alias("edge_type"),
        subject.alias("subject"),
        role.alias("effective_subject"),
        subject.alias("source"),
        role.alias("target"),
        F.struct(session.alias("id"), F.lit(None).cast("string").alias("parent_session_id"), F.lit("confirmed").alias("state")).alias("session"),
        F.lit("confirmed").alias("auth_state"),
        F.lit("unknown").alias("privilege_state"),
        F.struct(subject.alias("from_subject"), role.alias("to_subject"), F.lit("confirmed").alias("state"), needed["eventID"].alias("evidence_ref")).alias("credential_transition"),
        F.array(ref).alias("evidence_refs"),
        native.alias("native_context"),
        "source_file",
    )


def assume_role_edges(records: DataFrame) -> DataFrame:
    """The accepted records, in order of time and id.  The same record twice gives one id twice (see ``graph.duplicate_edge_ids``)."""
    return assume_role_records(records).where("reason is null").drop("reason", "source_file").orderBy("ts", "edge_id")


def unify_edges(on_prem: DataFrame, cloud: DataFrame) -> DataFrame:
    return on_prem.unionByName(cloud, allowMissingColumns=True).orderBy("ts", "edge_id")


def cross_env_continuity(pairs: DataFrame, mappings: DataFrame) -> DataFrame:
    """``pairs`` (on_prem_identity, cloud_principal) with state and evidence_ref: confirmed only by an explicit confirmed mapping with evidence (the first by seq); names, times and addresses never bridge."""
    good = mappings.where("state = 'confirmed' and coalesce(evidence_ref, '') != ''").groupBy("on_prem_identity", "cloud_principal").agg(F.min_by("evidence_ref", "seq").alias("evidence_ref"))
    joined = pairs.join(good, ["on_prem_identity", "cloud_principal"], "left")
    return joined.withColumn("state", F.when(F.col("evidence_ref").isNotNull(), "confirmed").otherwise("unknown"))
