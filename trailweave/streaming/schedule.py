"""Rules on a schedule: each run looks back over evidence that is kept by day.

A run over (start, end] reads what the rule can need, from ``span`` seconds before ``start`` on; days
outside are pruned by their folders.  What an earlier run has alerted is removed, so an alert comes once,
and evidence that came late is alerted by the next run whose look-back still holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, RUN = "day", "run"


def _day(ts: Column) -> Column:
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def keep(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Adds ``events`` to the evidence: a folder for each UTC day, files in stretches of time."""
    events.withColumn(DAY, _day(F.col(ts))).repartitionByRange(DAY, ts).write.mode("append").partitionBy(DAY).parquet(path)


def look_back(spark: SparkSession, path: str, start: datetime, end: datetime, span: float, ts: str = "ts") -> DataFrame:
    """The evidence of (start - span, end]; ``start`` and ``end`` know their time zone."""
    first = start - timedelta(seconds=span)
    utc_day = lambda t: F.lit((t - t.utcoffset()).date())
    kept = spark.read.parquet(path)
    return kept.where(F.col(DAY).between(utc_day(first), utc_day(end)) & (F.col(ts) > F.lit(first)) & (F.col(ts) <= F.lit(end))).drop(DAY)


def _number(t: datetime) -> int:
    """Microseconds since 1970, by which runs are named."""
    return (t - datetime(1970, 1, 1, tzinfo=t.tzinfo) + t.utcoffset() * -1) // timedelta(microseconds=1)


def alerts(spark: SparkSession, path: str) -> DataFrame | None:
    """The alerts of all runs so far, with the ``run`` that found them; None before the first."""
    try:
        return spark.read.option("mergeSchema", False).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_rule(spark: SparkSession, evidence: str, found: str, rule: Callable[[DataFrame], DataFrame], start: datetime, end: datetime, span: float, key: str = "_id") -> None:
    """One run: writes the new alerts of ``rule`` (rows with an id ``key``) to ``found``; done again, it writes the same.

    ``span``: how far before an alert's last event its evidence may lie, and how late evidence may come.
    """
    new = rule(look_back(spark, evidence, start, end, span))
    known = alerts(spark, found)
    if known is not None:  # an alert that this look-back can find again was found by a run that ended in it
        known = known.where((F.col(RUN) > _number(start - timedelta(seconds=span))) & (F.col(RUN) < _number(end)))
        new = new.join(known.select(key), key, "left_anti")
    new.write.mode("overwrite").parquet(f"{found}/{RUN}={_number(end)}")
