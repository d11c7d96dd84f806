"""Whole sources: files to normalised events or edges, with their counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import hybrid, windows

from . import context, records, scratch


@dataclass
class Loaded:
    """``rows`` and what there is to say about them: ``issues`` (issue, n), ``files`` (source_file, raw_records, accepted_records), ``bad`` lines."""

    rows: DataFrame
    issues: DataFrame
    files: DataFrame
    bad: DataFrame


def load_windows_sources(spark: SparkSession, paths: list[str], ip_map: DataFrame, xml_events: DataFrame | None = None) -> Loaded:
    """Windows events of JSON files (and of exported XML rows: source_file, line, xml), normalised, in order of time."""
    good, bad = records.read_json_records(spark, paths)
    raw = records.windows_records(records.unwrap_envelope(good))
    if xml_events is not None:
        exported = records.windows_xml_to_ecs(xml_events).withColumn("item", F.lit(0))
        raw = raw.unionByName(exported, allowMissingColumns=True)
    # Rows, issues and counts are made of these two tables, so each file is parsed once for them; issues are counted in the pass that writes.
    raw = scratch.table(raw, "windows-raw")
    numbered = windows.dense_seq(raw, ["source_file", "line", "item"])
    events, seen = scratch.observed_table(windows.normalize_windows_events(numbered, ip_map), "windows-events", windows.quality_metrics())
    issues = context.local_table(spark, [(issue, n) for issue, n in seen.items() if n and issue != "n"], "issue string, n long")
    sizes = raw.groupBy("source_file").agg(F.count("*").alias("raw_records"))
    taken = events.groupBy("source_file").agg(F.count("*").alias("accepted_records"))
    files = sizes.join(taken, "source_file", "left").withColumn("accepted_records", F.coalesce("accepted_records", F.lit(0)))
    return Loaded(events.orderBy("ts", "seq"), issues, files, bad)


def load_cloudtrail_sources(spark: SparkSession, paths: list[str]) -> Loaded:
    """Role assumptions of cloud audit files as edges in order of time and id, each with its file's name and hash."""
    good, bad = records.read_json_records(spark, paths)
    hashes = records.evidence_descriptors(spark, paths, "cloud").select(F.col("file_name").alias("source_file"), F.col("sha256").alias("source_sha256"))
    found = hybrid.assume_role_records(records.expand_cloudtrail(good.drop("raw")).join(hashes, "source_file", "left"))
    reasons, files = windows.cloudtrail_quality(found)
    edges = found.where("reason is null").drop("reason", "source_file").orderBy("ts", "edge_id")
    return Loaded(edges, reasons.withColumnRenamed("reason", "issue"), files, bad)
