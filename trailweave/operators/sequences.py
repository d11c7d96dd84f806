"""Ordered event sequences with a maximum span."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Stage:
    """Which events a stage takes (``where``), and its part of the join key (``by``)."""

    where: Column
    by: list[Column] = field(default_factory=list)


BIN_SPANS = 8  # the length of a time bin, in spans


def sequence(events: DataFrame, stages: list[Stage], max_span_seconds: float, by: list[Column] | None = None, ts: str = "ts", seq: str = "seq", carry: list[str] | None = None) -> DataFrame:
    """One row for each match: the struct columns ``stage1`` .. ``stageN`` of the events.

    For each key every stage keeps only its latest pending sequence; an event of the next stage
    takes it over, or is dropped if it comes more than the span after the first event.  So an event
    of stage k carries on exactly if the row just before it in (ts, seq) order, among pending rows
    of stage k-1 and rows of stage k, is a pending one.  Each pass is a window over the same key,
    all on one shuffle and one scan of the events.  Rows with a null in their key match nothing.

    What an event matches depends on no event further back than the span.  So a key's timeline is cut
    into bins, each of which also sees the last span of the bin before, and a match counts in the bin
    of its last event: a busy host is spread over many tasks.  ``carry``: the columns of events to
    return (all if not given); they are what travels.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in carry or events.columns])
    names = [f"_k{i}" for i in range(len(by or []) + len(stages[0].by))]
    taken = []
    for k, stage in enumerate(stages):
        keys = [c.cast("string") for c in [*(by or []), *stage.by]]
        there = reduce(lambda a, b: a & b, [stage.where, *[c.isNotNull() for c in keys]])
        taken.append(F.when(there, F.struct(*[c.alias(n) for c, n in zip(keys, names, strict=True)], F.lit(k).alias("_stage"))))
    rows = events.select(F.inline(F.array_compact(F.array(*taken))), F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), whole.alias("_event"))
    micros = int(max_span_seconds * 1_000_000)
    width = max(BIN_SPANS * micros, 1)
    at = F.unix_micros("_ts")
    rows = rows.withColumn("_home", F.floor(at / width))
    rows = rows.withColumn("_bin", F.explode(F.when(at >= (F.col("_home") + 1) * width - micros, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    rows = rows.repartition(*names, "_bin")  # every window below is over these and one column more
    rows = rows.withColumns({f"stage{k + 1}": F.when((F.lit(k) == 0) & (F.col("_stage") == 0), F.col("_event")) for k in range(len(stages))})
    span = F.expr(f"make_dt_interval(0, 0, 0, {float(max_span_seconds)})")
    rows = rows.withColumn("_begin", F.when(F.col("_stage") == 0, F.col("_ts")))
    for k in range(1, len(stages)):
        # Rows of later stages stand by in a partition of their own.
        active = F.col("_stage") <= k
        w = Window.partitionBy(*names, "_bin", active).orderBy("_ts", "_seq", "_stage")
        before = F.lag(F.struct(F.col("_stage").alias("s"), F.col("_begin").alias("b"), *[F.col(f"stage{j}").alias(f"e{j}") for j in range(1, k + 1)])).over(w)
        rows = rows.withColumn("_before", before)
        alive = (F.col("_stage") == k) & (F.col("_before.s") == k - 1) & (F.col("_ts") <= F.col("_before.b") + span)
        kept = {f"stage{j}": F.when(alive, F.col(f"_before.e{j}")).otherwise(F.col(f"stage{j}")) for j in range(1, k + 1)}
        kept[f"stage{k + 1}"] = F.when(alive, F.col("_event")).otherwise(F.col(f"stage{k + 1}"))
        kept["_begin"] = F.when(alive, F.col("_before.b")).otherwise(F.col("_begin"))
        rows = rows.withColumns(kept).where((F.col("_stage") > k) | F.col(f"stage{k + 1}").isNotNull())
    return rows.where((F.col("_stage") == len(stages) - 1) & (F.col("_home") == F.col("_bin"))).select(*[f"stage{k + 1}" for k in range(len(stages))])
