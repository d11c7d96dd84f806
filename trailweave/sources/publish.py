"""Publishing the datasets of a case as one commit.

All datasets are written into a folder of their own, then one small manifest names them, with their rows and
digests.  Readers go by manifests, and Spark renames a manifest into place when it is whole: a case that fails on the way,
however far it came, is never seen, and a new one replaces the old one as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "number long, name string, folder string, n long, digest string"


def sorted_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as one JSON text whose keys are sorted at every level; null fields are left out."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.select(F.to_json(F.parse_json(whole)).alias(column))


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(datasets: dict[str, DataFrame], path: str, digest: Callable[[DataFrame], DataFrame]) -> int:
    """Writes all of ``datasets`` under ``path``, then commits them; gives the commit's number.

    ``digest``: (digest, n) of a dataset, as ``plans.case.fingerprint`` makes it; it is taken of what was written.  One writer at a time.
    """
    spark = next(iter(datasets.values())).sparkSession
    known = _manifests(spark, path)
    number = 1 + (known.agg(F.max("number")).first()[0] or 0 if known is not None else 0)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows = None
    for name, df in datasets.items():
        df.write.parquet(f"{folder}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        one = digest(back).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("name"), F.lit(f"{folder}/{name}").alias("folder"), "n", "digest")
        rows = one if rows is None else rows.unionByName(one)
    sorted_json(rows).coalesce(1).write.text(f"{path}/manifests/{number}")
    return number


def published(spark: SparkSession, path: str) -> DataFrame:
    """(number, name, folder, n, digest) of the last commit; no rows before the first."""
    known = _manifests(spark, path)
    if known is None:
        return spark.createDataFrame([], _MANIFEST)
    last = known.agg(F.max("number")).first()[0]
    return known.where(F.col("number") == last)


def read_published(spark: SparkSession, path: str, digest: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The datasets of the last commit; with ``digest``, what they hold is first held against the manifest."""
    found = {}
    for r in published(spark, path).collect():
        found[r.name] = spark.read.parquet(r.folder)
        if digest is not None and tuple(digest(found[r.name]).first()) != (r.digest, r.n):
            raise ValueError(f"{r.folder} is not what was published")
    return found
