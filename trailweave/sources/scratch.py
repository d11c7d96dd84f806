"""Intermediate files in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset on one machine (tests) a folder of it, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables that are made inside, at its end: ``with owned(spark): query(spark).write.parquet(...)``.

    Results are read from those tables, so whatever is to stay must be written before.
    """
    begun = len(_made)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made[begun:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)
        del _made[begun:]


def table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed_table(df: DataFrame, name: str, metrics: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """:func:`table`, and what the pass that wrote it has seen: ``n`` rows and other ``metrics`` (aggregates)."""
    seen = Observation()
    kept = table(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (metrics or {}).items()]), name)
    return kept, seen.get
