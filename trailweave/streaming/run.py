"""Streams that run to the end of their files, into a sink that a repeated batch doesn't change.

``drain`` runs a stream over a folder until nothing is left and stops; called again after a stop,
or when more files have come, it goes on where it was: the checkpoint knows what is done.
``held`` reads what the sink holds.  ``replay`` lays a table out as files slice by slice, in order of time,
and ``run_over`` drains a stream after each slice, so that it is stopped and started between them.

The sink writes each batch as its own folder, named by the batch's number, replacing what is
there: a batch that is run again after a failure leaves the same rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.sources import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",  # one store for each partition of a join, not four
}


def replay(rows: DataFrame, path: str, slices: int = 3, ts: str = "ts", end: DataFrame | None = None) -> Iterator[None]:
    """Writes ``rows`` into ``path``, ``slices`` stretches of time one after the other, and ``end`` last; gives way after each.

    ``end``: rows so late that the watermark passes all others (an append-mode stream gives a window only then).
    """
    micros = F.unix_micros(ts)
    least, most = rows.agg(F.min(micros), F.max(micros)).first()
    if least is not None:
        width = (most - least) // slices + 1
        for k in range(slices):
            low = least + k * width
            rows.where((micros >= low) & (micros < low + width)).write.mode("append").parquet(path)
            yield
    if end is not None:
        end.write.mode("append").parquet(path)
        yield


def source(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """The files of a folder as a stream; all that are there make one batch."""
    return spark.readStream.schema(schema).parquet(path)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """The sink's function for ``foreachBatch``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(stream: DataFrame, path: str) -> None:
    """Runs ``stream`` until its sources have nothing left; rows go to ``path``/rows, progress to ``path``/checkpoint.

    State is kept by RocksDB: outside the JVM's heap, and a batch checkpoints its changes only.
    """
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        conf.set(name, value)
    try:
        query = stream.writeStream.foreachBatch(write_batch(f"{path}/rows")).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def held(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def run_over(rows: DataFrame, end: DataFrame | None, make: Callable[[DataFrame], DataFrame], name: str, slices: int = 3) -> DataFrame:
    """What the stream ``make`` gives over ``rows``, in new folders of the shared one."""
    spark, path = rows.sparkSession, scratch.new_path(rows.sparkSession, name)
    for _ in replay(rows, f"{path}/files", slices, end=end):
        stream = make(source(spark, rows.schema, f"{path}/files"))
        drain(stream, path)
    return held(spark, path, stream.schema)
