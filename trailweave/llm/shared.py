"""Tables in the folder that the whole cluster shares (from ``sources.scratch``), and names of columns that can't clash."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.sources.scratch import new_path, shared_dir, table

from . import textvec

__all__ = ["map_arrow", "new_path", "others", "pick", "quoted", "shared_dir", "table", "worker_tables"]

_tables: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """What a Python worker keeps for one operator from task to task; asking for it drops what it kept for others, so that a worker's memory holds one operator's tables."""
    gone = [n for n in _tables if n != owner]
    for name in gone:
        del _tables[name]
    if gone:
        gc.collect()  # encoders refer to themselves, so they wait for the collector
        textvec.forget()
        pa.default_memory_pool().release_unused()  # Arrow keeps what batches took
    return _tables.setdefault(owner, {})


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of ``df`` but those; names are compared as Spark does, without case."""
    gone = {n.lower() for n in taken}
    return [c for c in df.columns if c.lower() not in gone]


def pick(names: list[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def map_arrow(df: DataFrame, own: list[str], inner: list[Column], run: Callable, more: str) -> DataFrame:
    """``df``'s columns ``own`` with the columns ``more`` (DDL) that ``run`` makes by ``mapInArrow``.

    ``run`` sees the columns own0, own1, ... and then ``inner``, so names can't clash; it returns the own ones first.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    new = T.StructType.fromDDL(more).fields
    schema = T.StructType([T.StructField(f"own{i}", types[n]) for i, n in enumerate(own)] + new)
    plain = df.select(*[c.alias(f"own{i}") for i, c in enumerate(pick(own))], *inner)
    return plain.mapInArrow(run, schema).toDF(*own, *[f.name for f in new])
