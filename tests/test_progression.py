"""Findings by the sweep over classes against findings by pairs, and a hub of many hops."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from trailweave.operators import graph, policy, progression
from trailweave.sources import context

BASE = datetime(2026, 8, 10, 10, 0, 0, tzinfo=timezone.utc)
EDGE = "edge_id string, ts timestamp, source_host string, target_host string, identity string, effective_identity string, service string, logon_id string, source_logon_id string, privilege_state string, auth_state string, credential_transition struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>"


def by_pairs(edges, ctx, minutes):
    clean = graph.sanitize_edges(edges)
    known = policy.with_context(clean, ctx)
    pairs = graph.continuation_pairs(known, minutes)
    judged = policy.classify_hops(pairs).withColumn("n", F.lit(1).cast("long"))
    used = judged.select(F.col("edges")[0].alias("edge_id")).union(pairs.select("next.edge_id")).distinct()
    return policy.aggregate_findings(judged.unionByName(policy.standalone_findings(clean, used, judged)))


def some_context(spark):
    return context.context_from_rows(
        spark, hosts=[("h0", 0, True), ("h1", 1, False), ("h2", 2, None), ("h3", 2, False)], identities=[("a", 0), ("b", None)], policy=[("2026-08-01", "2026-08-10")],
        complete_for=[("on_prem", "a", 0)], approved_paths=[("a", "h1", 0), ("b", "h2", 1)], approved_changes=[("b", "h3", None, "2026-08-31", None, None), ("a", "h2", "2026", None, None, None)], known_edges=[("a", "h1"), ("b", "h0"), ("a", "h2")],
    )


def test_sweep_equals_pairs(spark):
    rnd = random.Random(6)
    hosts, who = ["h0", "h1", "h2", "h3", "h4", None], ["a", "b", "c", None]
    rows = []
    for i in range(400):
        change = None if rnd.random() < 0.7 else (rnd.choice(who), rnd.choice(who), rnd.choice(["confirmed", "unknown", None]), "r")
        at = BASE + timedelta(seconds=rnd.choice([rnd.randint(0, 20000), 60 * rnd.randint(0, 300)]), microseconds=rnd.choice([0, 0, 1]))
        session = lambda: rnd.choice([None, None, "s1", "s2"])
        rows.append((f"e{i:03}", None if rnd.random() < 0.02 else at, rnd.choice(hosts), rnd.choice(hosts), rnd.choice(who), None, rnd.choice(["rdp", "smb"]), session(), session(), rnd.choice(["confirmed", "absent", None]), rnd.choice(["confirmed", "confirmed", "confirmed", None]), change))
    edges = spark.createDataFrame(rows, EDGE).repartition(3)
    ctx = some_context(spark)
    got = {str(r) for r in policy.classify(edges, ctx, 30).collect()}
    want = {str(r) for r in by_pairs(edges, ctx, 30).collect()}
    assert got == want and len(want) > 150
    assert policy.classify(edges.limit(0), ctx, 30).count() == 0


def test_hops_of_a_hub_are_never_rows(spark):
    """10^4 arrivals and 10^4 departures within the window are 10^8 hops, of four paths."""
    n = 10_000
    nothing = F.lit(None).cast("struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>")
    text = lambda v: F.lit(v).cast("string")
    states = [text("a").alias("identity"), text("a").alias("effective_identity"), text("rdp").alias("service"), F.concat(F.lit("s"), "id").alias("logon_id"), text(None).alias("source_logon_id"), text("confirmed").alias("privilege_state"), text("confirmed").alias("auth_state"), nothing.alias("credential_transition")]
    at = lambda shift: (F.lit(BASE) + F.make_dt_interval(secs=F.lit(shift) + F.col("id") / 1000)).alias("ts")
    side = lambda name, shift, source, target: spark.range(n).select(F.concat(F.lit(name), F.lpad(F.col("id").cast("string"), 5, "0")).alias("edge_id"), at(shift), source.alias("source_host"), target.alias("target_host"), *states)
    two = lambda a, b: F.when(F.col("id") % 2 == 0, a).otherwise(b)
    edges = side("in", 0, two("x", "y"), F.lit("hub")).unionByName(side("out", 600, F.lit("hub"), two("h0", "h3")))
    found = policy.classify(edges, some_context(spark), 30).collect()
    assert {(tuple(r.path), r.occurrence_count, tuple(r.edges)) for r in found} == {((a, "hub", b), n * n // 4, (f"in0000{i}", f"out0000{j}")) for i, a in enumerate("xy") for j, b in enumerate(("h0", "h3"))}


def test_many_classes_are_counted_in_few_rows(spark):
    """100 arrivals of 20 classes and 100 departures of 20: an edge isn't listed once for each class of the other side."""
    from trailweave.operators import progression
    from trailweave.sources import scratch

    change = "cast(null as struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>) as credential_transition"
    side = lambda name, shift, source, target: spark.range(100).selectExpr(f"concat('{name}', id) as edge_id", f"timestamp_seconds({shift} + id) as ts", f"{source} as source_host", f"{target} as target_host", "'a' as identity", "'rdp' as service", "concat('s', id) as logon_id", "cast(null as string) as source_logon_id", "'absent' as privilege_state", "'confirmed' as auth_state", change)
    edges = graph.sanitize_edges(side("in", 0, "concat('x', id % 20)", "'hub'").unionByName(side("out", 500, "'hub'", "concat('y', id % 20)")))
    known = policy.with_context(edges, some_context(spark))
    counted, used = progression.continuation_counts(known, policy._worth(), 30)
    swept = [p for p in scratch._made if "/hops-" in p][-1]
    assert spark.read.parquet(swept).count() == 2 * 100 * 3 + 100
    assert counted.count() == 400 and counted.agg(F.sum("n")).first()[0] == 10_000 and used.count() == 200


def test_hops_of_groups_equal_judged_pairs(spark):
    """Each pair comes once with what it is judged by itself, however few edges a row of a group holds."""
    rnd = random.Random(9)
    hosts, who = ["h0", "h1", "h2", "h3", "h4", None], ["a", "b", "c", None]
    session = lambda: rnd.choice([None, None, "s1", "s2"])
    rows = []
    for i in range(500):
        change = None if rnd.random() < 0.7 else (rnd.choice(who), rnd.choice(who), rnd.choice(["confirmed", "unknown", None]), "r")
        at = BASE + timedelta(seconds=rnd.choice([rnd.randint(0, 9000), 60 * rnd.randint(0, 150)]), microseconds=rnd.choice([0, 0, 1]))
        rows.append((f"e{i - (i % 50 == 1):03}", None if rnd.random() < 0.02 else at, rnd.choice(hosts), rnd.choice(hosts), rnd.choice(who), None, rnd.choice(["rdp", "smb"]), session(), session(), rnd.choice(["confirmed", "absent", None]), rnd.choice(["confirmed", "confirmed", None]), change))
    known = policy.with_context(graph.sanitize_edges(spark.createDataFrame(rows, EDGE)), some_context(spark)).localCheckpoint()
    pairs = graph.continuation_pairs(known, 30).withColumn("looked_up", F.struct("next.route", "next.approved_change"))
    names = ["label", "path", "identity", "rationale", "modifiers", "looked_up"]
    want = policy.classify_hops(pairs, "looked_up").select(F.col("edges")[0].alias("first_id"), F.col("edges")[1].alias("next_id"), *names).collect()
    for most in (1, 4, 1024):
        got = progression.hops(policy.classify_hop_groups(known, 30, most), 30).select("first_id", "next_id", *names).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 300
    assert progression.hops(policy.classify_hop_groups(known.limit(0), 30), 30).count() == 0


def test_hops_of_a_hub_are_judged_by_groups(spark):
    """4,000 arrivals and 4,000 departures are 16 million hops: the join gives a few rows, of at most 1,024 edges a side, and tasks share them."""
    n = 4000
    nothing = F.lit(None).cast("struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>")
    text = lambda v: F.lit(v).cast("string")
    states = [text("a").alias("identity"), text("a").alias("effective_identity"), text("rdp").alias("service"), F.concat(F.lit("s"), "id").alias("logon_id"), text(None).alias("source_logon_id"), text("confirmed").alias("privilege_state"), text("confirmed").alias("auth_state"), nothing.alias("credential_transition")]
    at = lambda shift: (F.lit(BASE) + F.make_dt_interval(secs=F.lit(shift) + F.col("id") / 1000)).alias("ts")
    side = lambda name, shift, source, target: spark.range(n).select(F.concat(F.lit(name), "id").alias("edge_id"), at(shift), F.lit(source).alias("source_host"), F.lit(target).alias("target_host"), *states)
    known = policy.with_context(graph.sanitize_edges(side("in", 0, "x", "hub").unionByName(side("out", 600, "hub", "h0"))), some_context(spark))
    groups = policy.classify_hop_groups(known, 30)
    held = groups.select(F.size("firsts").alias("firsts"), F.size("nexts").alias("nexts")).collect()
    assert len(held) == 16 and max(max(r) for r in held) <= 1024
    made = progression.hops(groups.select("label", "firsts", "nexts"), 30)
    assert made.groupBy(F.spark_partition_id()).count().count() > 1
    assert made.agg(F.count("*"), F.countDistinct("label")).first() == (n * n, 1)
