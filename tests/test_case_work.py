"""The work that a case does for each of its records: dealt to all tasks, and done once."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from trailweave.functions import scalars as S
from trailweave.operators import hybrid, windows
from trailweave.plans import queries
from trailweave.plans.evidence import Evidence
from trailweave.sources import records


@pytest.mark.parametrize("made", [queries._windows_documents, queries._cloud])
def test_documents_are_made_by_all_tasks_though_events_lie_in_one_row_group(spark, made):
    ev = Evidence(spark, "/root/testdata/sf0.001")
    assert ev.events.rdd.getNumPartitions() == 1
    assert made(ev).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_cloud_records_are_parsed_in_one_pass(spark):
    docs = ['{"Records": [{"a": 1}, 5, null, {"a": 2}]}', '{"Records": []}', '{"detail": {"a": 3}}', '{"detail": 5, "a": 4}', '{"detail": null, "a": 5}', '{"a": 6}', "7", '{"Records": 8, "a": 9}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "n int, d string").select("n", F.parse_json("d").alias("v"))
    found = records.expand_cloudtrail(df)
    assert "Union" not in found._jdf.queryExecution().analyzed().toString()
    rows = {(r.n, r.v) for r in found.select("n", F.to_json("v").alias("v")).collect()}
    assert rows == {(0, '{"a":1}'), (0, '{"a":2}'), (2, '{"a":3}'), (3, '{"a":4,"detail":5}'), (4, '{"a":5,"detail":null}'), (5, '{"a":6}'), (6, "7"), (7, '{"Records":8,"a":9}')}


def test_a_field_of_a_cloud_record_is_looked_up_once(spark):
    df = spark.createDataFrame([("{}",)], "d string").select(F.parse_json("d").alias("v"))
    plan = hybrid.assume_role_records(df)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("$.requestParameters.roleArn") <= 2


def test_mapped_addresses_go_the_short_way_with_the_same_result(spark):
    texts = ["::ffff:10.0.0.1", "::FFFF:255.249.199.0", " ::ffff:1.2.3.4\n", "::ffff:01.2.3.4", "::ffff:1.2.3", "::ffff:1.2.3.256", "0::ffff:1.2.3.4", "::ffff:1.2.3.4%e", "x::ffff:1.2.3.4", "::ffff:0:1.2.3.4", "::fffe:1.2.3.4"]

    def library(v):
        try:
            ip = ipaddress.ip_address(v.strip())
        except ValueError:
            return v.strip()
        return str(getattr(ip, "ipv4_mapped", None) or ip)

    df = spark.createDataFrame([(t,) for t in texts], "ip string").select(S.canonical_ip(F.col("ip")).alias("c"))
    assert [r.c for r in df.collect()] == [library(t) for t in texts]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(ip") <= 4  # the trimmed text is made once, not for each of its parts


def test_documents_of_named_events_are_not_written_out_again(spark):
    doc = '{"@timestamp": "2026-08-10T10:00:30Z", "event": {"code": "4672", %s "x": 1}, "host": {"name": "h"}, "winlog": {%s "event_data": {"SubjectUserName": "a"}}}'
    docs = [doc % ('"id": "e1",', ""), doc % ("", '"record_id": 5,'), doc % ("", "")]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "seq long, d string").select("seq", F.parse_json("d").alias("v"), F.lit("").alias("raw"))
    raw = records.windows_records(records.unwrap_envelope(df))
    assert [r.raw is None for r in raw.orderBy("seq").collect()] == [True, False, False]
    ip_map = spark.createDataFrame([], "ip string, host string")
    refs = [r.ref for r in windows.normalize_windows_events(raw, ip_map).orderBy("seq").collect()]
    whole = df.where("seq = 2").select(F.substring(F.sha2(F.to_json("v"), 256), 1, 16)).first()[0]
    assert refs == ["e1", "windows:h:5", f"raw-{whole}"]
