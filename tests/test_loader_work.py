"""Large files: their rows are numbered by many tasks, and parsed once."""

import json

import pytest
from pyspark.sql import functions as F

from trailweave.operators import windows
from trailweave.sources import loaders, records, scratch


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_of_a_file_are_numbered_by_several_tasks(spark, monkeypatch, fixed_plans):
    monkeypatch.setattr(windows, "LINES", 7, raising=False)
    rows = [("b", line, item) for line in range(0, 90, 2) for item in range(line % 3)] + [("a", line, 0) for line in range(5)] + [("a", None, 0)]
    df = spark.createDataFrame(rows[::-1], "source_file string, line long, item int")
    got = windows.dense_seq(df, ["source_file", "line", "item"]).withColumn("task", F.spark_partition_id()).collect()
    order = sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    assert [(r.source_file, r.line, r.item) for r in sorted(got, key=lambda r: r.seq)] == order and sorted(r.seq for r in got) == list(range(len(rows)))
    assert len({r.task for r in got if r.source_file == "b"}) > 1


def test_a_file_is_parsed_once_and_its_lines_are_not_shuffled(spark, monkeypatch, tmp_path):
    lines = [json.dumps({"@timestamp": "2026-08-10T10:00:30Z", "event": {"code": c, "id": f"e{n}"}, "host": {"name": "h"}, "winlog": {"event_data": {"SubjectUserName": "a"}}}) for n, c in enumerate([4672, 1, 4672])]
    (tmp_path / "w.ndjson").write_text("\n".join(lines))
    plans, table = {}, scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name, path=None: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and table(df, name, path))
    made = loaders.load_windows_sources(spark, [f"file://{tmp_path}/w.ndjson"], spark.createDataFrame([], "ip string, host string"))
    assert "Window" not in plans["windows-raw"] and "SortMergeJoin" not in plans["windows-raw"] and plans["windows-raw"].count("FileScan text") == 1
    assert [(r.seq, r.ref) for r in made.rows.collect()] == [(0, "e0"), (2, "e2")]
    assert {(r.issue, r.n) for r in made.issues.collect()} == {("4672: missing host.ip", 2), ("4672: missing winlog.event_data.SubjectLogonId", 2)}
    assert [tuple(r) for r in made.files.collect()] == [("w.ndjson", 3, 2)]
    good, bad = records.read_json_records(spark, [f"file://{tmp_path}/w.ndjson"])
    assert [r.line for r in good.orderBy("line").collect()] == [0, 1, 2] and bad.count() == 0
