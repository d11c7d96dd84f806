"""From evidence to findings: the case pipeline."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators import checks, edges, flows, graph, hybrid, policy, windows
from trailweave.sources import context, scratch

TOOL_VERSION = "1.0"


@dataclass
class Params:
    flow_window: float = edges.FLOW_WINDOW
    privilege_window: float = edges.PRIVILEGE_WINDOW
    credential_window: float = edges.CREDENTIAL_WINDOW
    continuation_minutes: float = graph.CONTINUATION_MINUTES
    strict_keys: bool = False


@dataclass
class Case:
    flows: DataFrame
    windows: DataFrame
    pivot_edges: DataFrame
    reachability_edges: DataFrame
    findings: DataFrame
    quality: DataFrame
    violations: DataFrame
    #: Rows and milliseconds of each stage, from the pass that wrote its dataset.
    counts: dict[str, int] = field(default_factory=dict)
    milliseconds: dict[str, float] = field(default_factory=dict)


def reconstruct_case(packets: DataFrame, windows_events: DataFrame, cloud_records: DataFrame | None, ip_map: DataFrame, ctx: policy.Context, params: Params | None = None, clock_offset: float = 0.0) -> Case:
    """All datasets of a case.

    Each of them has several consumers, so each is written as a table in the shared folder and read back:
    it is computed once, and a lost executor costs no more than its own tasks.  Counts, times and the quality of the
    Windows events are taken in those passes; nothing is read again for them.
    """
    p = params or Params()
    counts: dict[str, int] = {}
    took: dict[str, float] = {}
    begun = time.time()

    def kept(df: DataFrame, name: str, stage: str, metrics: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, int]]:
        t = time.time()
        made, seen = scratch.observed_table(df, name, metrics)
        counts[name], took[stage] = seen["n"], 1000 * (time.time() - t)
        return made, seen

    network, _ = kept(flows.load_network(packets, clock_offset=clock_offset), "network_flows", "network_ingest_ms")
    events, seen = kept(windows.normalize_windows_events(windows_events, ip_map), "windows_events", "windows_ingest_ms", windows.quality_metrics())
    logons, privs, creds = windows.split_events(events)
    flow_refs = network.withColumn("ref", flow_ref())
    found_edges = edges.materialize_edges(flow_refs, logons, privs, creds, ip_map, p.flow_window, p.privilege_window, p.credential_window, p.strict_keys)
    pivot, _ = kept(found_edges, "pivot_edges", "edge_materialization_ms")
    t = time.time()
    findings, _ = kept(policy.classify(pivot, ctx, p.continuation_minutes), "findings", "graph_classification_ms")
    took["graph_classification_ms"] = 1000 * (time.time() - t)  # with the tables on the way
    lifted = hybrid.pivot_to_reachability(pivot)
    spark = packets.sparkSession
    quality = context.local_table(spark, [("windows", issue, n) for issue, n in seen.items() if n and issue != "n"], "source string, issue string, n long")
    if cloud_records is not None:
        records, _ = kept(hybrid.assume_role_records(cloud_records), "cloud_records", "cloud_ingest_ms")
        lifted = hybrid.unify_edges(lifted, records.where("reason is null").drop("reason", "source_file"))
        reasons, _ = windows.cloudtrail_quality(records)
        quality = quality.unionByName(reasons.select(F.lit("cloud").alias("source"), F.col("reason").alias("issue"), "n"))
    lifted, _ = kept(lifted, "reachability_edges", "hybrid_normalization_ms")
    found = checks.check_pivot_edges(pivot).withColumn("contract", F.lit("pivot_edge"))
    for name, df in (("edge_semantics", checks.check_edge_semantics(pivot)), ("reachability_edge", checks.check_reachability_edges(lifted)), ("finding", checks.check_findings(findings))):
        found = found.unionByName(df.withColumn("contract", F.lit(name)))
    found, _ = kept(found, "violations", "derived_output_ms")
    took["pipeline_total_ms"] = 1000 * (time.time() - begun)
    return Case(network, events, pivot, lifted, findings, quality, found, counts, took)


def flow_ref() -> Column:
    """A reference of a flow that depends on its content alone."""
    return F.concat(F.lit("raw-"), F.substring(F.sha2(F.concat_ws("|", "ts_raw", "src_ip", "src_port", "dst_ip", "dst_port", "transport", "packets", "bytes"), 256), 1, 16))


def case_counts(case: Case) -> DataFrame:
    """(name, n): the size of each dataset, as counted when it was written."""
    rows = [(name, n) for name, n in case.counts.items() if name != "cloud_records"]
    return context.local_table(case.findings.sparkSession, rows, "name string, n long")


def fingerprint(df: DataFrame) -> DataFrame:
    """(digest, n): one SHA-256 that depends on the rows alone, not on their order or files.

    Each row is hashed, the hash is cut into eight numbers of 32 bits, and these are summed over all rows; the
    digest is the hash of the number of rows and the sums.  Sums of parts add up to those of the whole, so
    nothing is sorted, and each task sends on one row.
    """
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)]
    row = F.sha2(F.concat_ws("\n", *plain), 256)
    part = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    summed = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(8)])
    return summed.select(F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in range(8)]), 256).alias("digest"), "n")


def derivation_id(outputs: dict[str, DataFrame], inputs: DataFrame, config: dict[str, str], revision: str = "") -> DataFrame:
    """(derivation_id): what a result follows from (version, input files, settings) and what it is; no times, no layout.

    ``inputs``: (role, size, sha256) of every input file, from ``records.evidence_descriptors``.
    """
    head = "|".join([TOOL_VERSION, revision, *[f"{k}={v}" for k, v in sorted(config.items())]])
    named = {f"output {k}": v for k, v in outputs.items()} | {"inputs": inputs.select("role", "size", "sha256")}
    out = None
    for name, df in sorted(named.items()):
        one = fingerprint(df).select(F.concat(F.lit(f"{name}="), "digest").alias("d"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.array_join(F.array_sort(F.collect_list("d")), "|").alias("d")).select(F.sha2(F.concat(F.lit(head + "|"), "d"), 256).alias("derivation_id"))


def report_tables(case: Case) -> dict[str, DataFrame]:
    """Summaries of a case: evidence, quality, edges and findings."""
    evidence = case.windows.groupBy(F.lit("windows").alias("source"), F.col("code").alias("kind")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    evidence = evidence.unionByName(case.flows.groupBy(F.lit("network").alias("source"), F.col("protocol").alias("kind")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("last_ts" if "last_ts" in case.flows.columns else "ts").alias("last")))
    found = case.reachability_edges.groupBy("environment", "edge_type", "auth_state", "privilege_state").agg(F.count("*").alias("n"))
    labels = case.findings.groupBy("label", "confidence").agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("occurrences"))
    return {"evidence": evidence, "quality": case.quality, "edges": found, "findings": labels}


def timed_counts(case: Case) -> list[tuple[str, float, int]]:
    """(stage, milliseconds, rows): wall time and rows of each stage, as measured when its dataset was written, and of all."""
    rows = {"network_ingest_ms": "network_flows", "windows_ingest_ms": "windows_events", "cloud_ingest_ms": "cloud_records", "edge_materialization_ms": "pivot_edges", "graph_classification_ms": "findings", "hybrid_normalization_ms": "reachability_edges", "derived_output_ms": "violations"}
    timed = [(stage, ms, case.counts[rows[stage]]) for stage, ms in case.milliseconds.items() if stage in rows]
    return [*timed, ("pipeline_total_ms", case.milliseconds["pipeline_total_ms"], sum(n for _, _, n in timed))]
