"""Readers and writers of evidence records."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import scalars as S

from . import scratch, split_json

_BULK = ("index", "create", "update", "delete")
_XML = "System struct<EventID: string, TimeCreated: struct<_SystemTime: string>, Computer: string, EventRecordID: string>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
CODES = ["4624", "4672", "4648"]


SPLIT_BYTES = 256 << 20


def read_json_records(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records: source_file, line, raw, v) and (bad: source_file, line).

    ``.ndjson`` and ``.jsonl`` files, and files that are not one JSON document, are read line by
    line; blank lines are skipped and a byte order mark is tolerated.  Bad lines are kept apart
    (see :func:`require_no_bad`).  A document of more than ``split_bytes`` is read by many tasks, an item of
    its array a record, if it can be split (see ``split_json``); ``line`` is then the byte at which the item begins.
    """
    lines_of = [p for p in paths if p.endswith((".ndjson", ".jsonl"))]
    whole_of = [p for p in paths if p not in lines_of]
    parts = []
    items, split = split_json.read_many(spark, _sizes(spark, whole_of, split_bytes))
    if items is not None:
        taken = {_plain_path(p) for p in split}
        whole_of = [p for p in whole_of if _plain_path(p) not in taken]
        parts.append(items)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")
    clean = lambda c: F.regexp_replace(c, "^﻿", "")
    if lines_of:
        parts.append(_numbered(spark.read.text(lines_of).select(name, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), clean(F.col("value")).alias("raw"))))
    if whole_of:
        texts = spark.read.text(whole_of, wholetext=True).select(name, clean(F.col("value")).alias("value"))
        one = F.try_parse_json("value")
        lines = texts.where(one.isNull()).select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
        parts.append(texts.where(one.isNotNull()).select("source_file", F.lit(0).cast("long").alias("line"), F.col("value").alias("raw")))
        parts.append(lines.select("source_file", F.col("line").cast("long"), "raw"))
    rows = reduce(DataFrame.unionByName, parts).where(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw"))
    return rows.where("v is not null"), rows.where("v is null").select("source_file", "line")


def _plain_path(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def _sizes(spark: SparkSession, paths: list[str], least: int) -> dict[str, int]:
    """The files named by ``paths`` that are larger than ``least`` and can be opened by path, one for each such file."""
    named = [p for p in paths if not set(p) & set("*?[{") and re.match(_OPENABLE, p)]
    if not named:
        return {}
    files = spark.read.format("binaryFile").load(named).where(F.col("length") > least).select("path", "length")  # names and sizes only
    plain = {_plain_path(p) for p in named}
    return {r.path: r.length for r in files.collect() if _plain_path(r.path) in plain}


def _numbered(lines: DataFrame) -> DataFrame:
    """(source_file, line, raw): each line with its number in its file, from 0.

    Within a block of a file, lines are read one after the other; what comes before a block is summed
    from one row for each block, so a large file is numbered by many tasks.
    """
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    # As a table, Spark knows that it is small: then the lines themselves aren't shuffled.
    blocks = scratch.table(blocks.select("path", "block", "least", before.alias("before")), "blocks")
    return lines.join(blocks, ["path", "block"]).select("source_file", (F.col("before") + F.col("at") - F.col("least")).alias("line"), "raw")


def require_no_bad(bad: DataFrame) -> None:
    """Raise if there are bad lines, naming one."""
    first = bad.orderBy("source_file", "line").first()
    if first:
        raise ValueError(f"{first.source_file}:{first.line + 1}: not JSON")


def _has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def unwrap_envelope(records: DataFrame) -> DataFrame:
    """Arrays to their object items, search responses to their ``_source`` (with ``_id`` as missing event id), bulk action lines dropped, all else itself."""
    keep = [c for c in records.columns if c not in ("v", "raw")]
    v = F.col("v")
    at = lambda x, path: F.try_variant_get(x, path, "variant")
    item = lambda x, doc_id: F.struct(x.alias("v"), doc_id.alias("doc_id"))
    none = F.lit(None).cast("string")
    source = lambda x: item(at(x, "$._source"), F.try_variant_get(x, "$._id", "string"))
    listed = F.try_variant_get(v, "$", "array<variant>")  # null for all but arrays, and sooner known than a schema
    objects = F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    hits = F.filter(F.try_variant_get(v, "$.hits.hits", "array<variant>"), lambda x: _has(x, "$._source"))
    action = reduce(lambda a, b: a | b, [_has(v, f"$.{k}") for k in _BULK]) & ~_has(v, "$.event") & ~_has(v, "$.winlog")
    inner = (
        F.when(listed.isNotNull(), F.transform(objects, lambda x: item(x, none)))
        .when(_has(v, "$.hits.hits"), F.transform(hits, source))
        .when(_has(v, "$._source"), F.array(source(v)))
        .when(~action, F.array(item(v, none)))
    )
    out = records.select(*keep, F.posexplode(inner).alias("item", "x"))
    return out.select(*keep, "item", "x.v", "x.doc_id").withColumn("raw", F.to_json("v"))


def expand_cloudtrail(records: DataFrame) -> DataFrame:
    """``Records`` to its items, else the ``detail`` of an event envelope, else the record."""
    keep = [c for c in records.columns if c != "v"]
    many, detail = F.try_variant_get("v", "$.Records", "array<variant>"), F.try_variant_get("v", "$.detail", "variant")
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    inner = F.when(many.isNotNull(), F.filter(many, is_object)).otherwise(F.array(F.when(is_object(detail), detail).otherwise(F.col("v"))))
    return records.select(*keep, F.explode(inner).alias("v"))  # one pass, as records may be parsed on the way


def windows_xml_to_ecs(events: DataFrame, xml: str = "xml") -> DataFrame:
    """Exported event XML as flat event rows of the supported codes."""
    e = events.withColumn("_e", F.from_xml(F.col(xml), _XML))
    data = F.map_from_entries(F.transform(F.filter(F.coalesce("_e.EventData.Data", F.array().cast("array<struct<_Name: string, _VALUE: string>>")), lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"], d["_VALUE"])))
    computer, record = F.col("_e.System.Computer"), F.col("_e.System.EventRecordID")
    out = e.where(F.col("_e.System.EventID").isin(CODES))
    return out.select(
        *[F.col(c) for c in events.columns if c != xml],
        F.col("_e.System.TimeCreated._SystemTime").alias("ts_raw"),
        F.col("_e.System.EventID").alias("code"),
        F.when(F.col("_e.System.EventID") == "4624", "success").alias("outcome"),
        # Without a record number there is no id; normalisation then makes a reference of the content.
        F.when(record != "", F.concat(F.lit("evtx:"), F.coalesce(F.nullif(computer, F.lit("")), F.lit("unknown")), F.lit(":"), record)).alias("event_id"),
        computer.alias("computer_name"),
        record.alias("record_id"),
        data.alias("data"),
    )


_OPENABLE = r"(/|file:|hdfs:|s3:|gs:)"  # paths that a task can open by itself
_CHUNK = 8 << 20


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            digest, at = hashlib.sha256(), 0
            with split_json.opened(path) as f:
                while chunk := f.read_at(_CHUNK, at):
                    digest.update(chunk)
                    at += len(chunk)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha256"])


def evidence_descriptors(spark: SparkSession, paths: list[str], role: str) -> DataFrame:
    """(file_name, role, size, sha256, modified) of input files, of any size: a task reads each in chunks.

    Files of a store that only Spark's readers open are read whole, up to 2 GB each.
    """
    files = spark.read.format("binaryFile").load(paths)
    names = [F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(role).alias("role"), F.col("length").alias("size")]
    if not all(re.match(_OPENABLE, p) for p in paths):
        return files.select(*names, F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
    listed = files.select("path", "length", "modificationTime").repartition("path")
    hashed = listed.mapInArrow(_hash_files, "path string, length long, modificationTime timestamp, sha256 string")
    return hashed.select(*names, "sha256", F.col("modificationTime").alias("modified"))


def write_results(df: DataFrame, path: str, kind: str = "json", partition_by: list[str] | None = None) -> None:
    """A result as newline-delimited JSON or Parquet."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.json(path) if kind == "json" else writer.parquet(path)


def windows_records(records: DataFrame) -> DataFrame:
    """Unwrapped Windows records (column ``v``) as flat event rows before normalisation; ``raw`` is the document of an event without an id, whose reference follows from it."""
    v = F.col("v")
    get = lambda p: F.try_variant_get(v, p, "string")
    doc_id = F.col("doc_id") if "doc_id" in records.columns else F.lit(None).cast("string")
    keep = [c for c in records.columns if c in ("source_file", "line", "item", "seq")]
    event_id = F.coalesce(F.nullif(get("$.event.id"), F.lit("")), doc_id)
    return records.select(
        *keep,
        F.coalesce(F.nullif(get("$['@timestamp']"), F.lit("")), get("$.event.created")).alias("ts_raw"),
        S.event_code(v).alias("code"),
        get("$.event.outcome").alias("outcome"),
        event_id.alias("event_id"),
        S.categories(v).alias("categories"),
        F.coalesce(F.nullif(get("$.host.name"), F.lit("")), F.nullif(get("$.host.hostname"), F.lit(""))).alias("host_name"),
        S.host_ips(v).alias("host_ips"),
        get("$.winlog.computer_name").alias("computer_name"),
        get("$.winlog.record_id").alias("record_id"),
        get("$.event.sequence").alias("sequence"),
        get("$.source.ip").alias("source_ip"),
        F.try_variant_get(v, "$.winlog.event_data", "map<string,string>").alias("data"),
        F.when(F.coalesce(event_id, F.lit("")) == "", F.to_json(v)).alias("raw"),
    )
