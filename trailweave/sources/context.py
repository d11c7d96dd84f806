"""Context tables from JSON documents or from tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.policy import Context

_TABLES = {
    "hosts": "host string, tier int, critical boolean",
    "identities": "identity string, justified_max_tier int",
    "policy": "valid_from string, valid_until string",
    "complete_for": "environment string, identity string, target_tier int",
    "approved_paths": "identity string, via string, to_tier int",
    "approved_changes": "identity string, target_host string, approved_from string, approved_until string, via string, service string",
    "known_edges": "identity string, host string",
}


def _fields(table: str) -> str:
    """The table's columns as the fields of a struct."""
    return ", ".join(": ".join(c.split(" ")) for c in _TABLES[table].split(", "))


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that is part of the plan, so that Spark knows its size (and broadcasts it, if that is small enough)."""
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table({name: pa.array(column, _ARROW[kind]) for (name, kind), column in zip(fields, columns, strict=True)}))


def context_from_rows(spark: SparkSession, **rows: list[tuple]) -> Context:
    """A context from rows of its tables (missing ones are empty)."""
    return Context(**{name: local_table(spark, rows.get(name, []), schema) for name, schema in _TABLES.items()})


def load_context(spark: SparkSession, folder: str) -> Context:
    """A context from the Parquet tables of a folder."""
    return Context(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in _TABLES.items()})


def load_context_json(spark: SparkSession, folder: str) -> Context:
    """A context from five JSON documents: asset_tiers, identity_roles, expected_admin_paths, approved_changes, known_reachability."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{folder}/{name}.json", multiLine=True)
    tiers = read("asset_tiers", "hosts map<string, struct<tier: int, critical: boolean>>").select(F.explode("hosts").alias("host", "h"))
    roles = read("identity_roles", "identities map<string, struct<justified_max_tier: int>>").select(F.explode("identities").alias("identity", "i"))
    paths = read("expected_admin_paths", f"policy_metadata struct<valid_from: string, valid_until: string, complete_for: array<struct<{_fields("complete_for")}>>>, approved_paths array<struct<{_fields("approved_paths")}>>")
    changes = read("approved_changes", f"approved_changes array<struct<{_fields("approved_changes")}>>")
    known = read("known_reachability", "known_edges map<string, array<string>>").select(F.explode("known_edges").alias("identity", "hosts"))
    return Context(
        hosts=tiers.select("host", "h.tier", F.coalesce("h.critical", F.lit(False)).alias("critical")),
        identities=roles.select("identity", "i.justified_max_tier"),
        policy=paths.select("policy_metadata.valid_from", "policy_metadata.valid_until"),
        complete_for=paths.select(F.explode("policy_metadata.complete_for").alias("x")).select("x.*"),
        approved_paths=paths.select(F.explode("approved_paths").alias("x")).select("x.*"),
        approved_changes=changes.select(F.explode("approved_changes").alias("x")).select("x.*"),
        known_edges=known.select("identity", F.explode("hosts").alias("host")),
    )


def load_ip_map(spark: SparkSession, path: str) -> DataFrame:
    """(pos, ip, host) from one JSON object of texts, in its order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "map<string, string>")).alias("pos", "ip", "host"))
