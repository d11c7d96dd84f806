"""Streams give what the batch forms give."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from trailweave.operators import detections
from trailweave.operators import edges as E
from trailweave.operators.sequences import Stage, sequence
from trailweave.streaming import detect, schedule
from trailweave.streaming import run as streams

BASE = datetime(2026, 8, 10, 10, 0, 0, tzinfo=timezone.utc)


def run(spark, tmp_path, batches, schema, make, name):
    source = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_live_flows_equal_batch_flows(spark, tmp_path):
    schema = "seq long, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, transport string, flags string, size int"
    rows = [(i, BASE + timedelta(seconds=10 * i), *(("a", 1, "b", 2) if i % 2 else ("b", 2, "a", 1)), "tcp", "S" if i == 1 else "A", 60) for i in range(10)]
    rows += [(20 + i, BASE + timedelta(seconds=400 + i), "a", 1, "b", 2, "tcp", "S", 60) for i in range(3)]
    end = [(99, BASE + timedelta(hours=1), "x", 1, "y", 2, "tcp", "S", 60)]
    got = run(spark, tmp_path, [rows[:5], rows[5:], end, end], schema, detect.live_flow_fold, "flows")
    want = detect.live_flow_fold(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r.seq, r.client.ip, r.packets, r.client_packets)
    assert sorted(map(key, got)) == sorted(map(key, want)) == [(0, "a", 10, 5), (20, "a", 3, 3)]


SEQUENCE = "key string, ts timestamp, seq long, stage int"


def drained(spark, tmp_path, batches, schema, make):
    """What the sink holds after a stream that is stopped and started between its batches."""
    path = f"file://{tmp_path}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/files")
        stream = make(streams.source(spark, schema, f"{path}/files"))
        streams.drain(stream, path)
    return streams.held(spark, path, stream.schema)


def test_live_sequences(spark, tmp_path):
    e = lambda t, seq, stage, key="k": (key, BASE + timedelta(seconds=t), seq, stage)
    batches = [[e(0, 1, 0), e(5, 2, 0)], [e(9, 3, 1), e(10, 4, 1)], [e(12, 5, 2), e(100, 6, 0), e(200, 7, 1), e(0, 8, 1, "other"), (None, BASE, 9, 0)], [e(9999, 10, 2, "end")]]
    got = drained(spark, tmp_path, batches, SEQUENCE, lambda s: detect.live_sequence(s, 3, 60)).collect()
    assert [(r.key, r.seqs) for r in got] == [("k", "2,3,5")]


def test_events_out_of_order_give_the_batch_result(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"k{rnd.randint(0, 5)}", BASE + timedelta(seconds=rnd.randint(0, 4000)), i, rnd.randint(0, 2)) for i in range(1500)]
    arrived = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.randint(0, 290)))
    batches = [arrived[:700], arrived[700:], [("end", BASE + timedelta(hours=9), -1, 2)]]
    got = drained(spark, tmp_path, batches, SEQUENCE, lambda s: detect.live_sequence(s, 3, 60, "300 seconds")).collect()
    found = sequence(spark.createDataFrame(rows, SEQUENCE), [Stage(F.col("stage") == k, [F.col("key")]) for k in range(3)], 60).collect()
    want = [(r.stage1.key, f"{r.stage1.seq},{r.stage2.seq},{r.stage3.seq}") for r in found]
    assert sorted((r.key, r.seqs) for r in got) == sorted(want) and len(want) > 100


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    write = streams.write_batch(f"{path}/rows")
    for rows, number in (([(1,), (2,)], 0), ([(3,)], 1), ([(3,)], 1), ([(1,), (2,)], 0)):
        write(spark.createDataFrame(rows, "x long"), number)
    assert sorted(r.x for r in streams.held(spark, path, spark.range(0).select(F.col("id").alias("x")).schema).collect()) == [1, 2, 3]


def test_windows_of_a_stream_stopped_between_batches(spark, tmp_path):
    rnd = random.Random(3)
    schema = "ts timestamp, src_ip string, dst_ip string, dst_port int, transport string"
    rows = sorted((BASE + timedelta(seconds=rnd.randint(0, 5000)), rnd.choice("ab"), "d", rnd.randint(1, 40), rnd.choice(["tcp", "tcp", "udp"])) for _ in range(600))
    batches = [rows[:200], rows[200:450], rows[450:], [(BASE + timedelta(days=9), "end", "d", 1, "tcp")]]
    table = detections.port_fan_out_windowed(spark.createDataFrame(rows, schema), 5, "10 minutes", "4 minutes")
    key = lambda r: (r.window_start, r.src_ip, r.dst_ip, r.distinct_ports)
    want = sorted(map(key, table.collect()))
    brute = {}
    for ts, src, dst, port, transport in rows:
        if transport == "tcp":
            s = int(ts.timestamp()) // 240 * 240
            while s > ts.timestamp() - 600:
                brute.setdefault((s, src, dst), set()).add(port)
                s -= 240
    assert sorted((int(w.replace(tzinfo=timezone.utc).timestamp()) if w.tzinfo is None else int(w.timestamp()), a, b, n) for w, a, b, n in want) == sorted((*k, len(v)) for k, v in brute.items() if len(v) >= 5)
    for approximate in (False, True):  # so few ports are exact in a sketch
        got = drained(spark, tmp_path / str(approximate), batches, schema, lambda s: detect.live_port_fan_out(s, 5, "10 minutes", "4 minutes", approximate=approximate))  # noqa: B023
        assert sorted(map(key, got.collect())) == want


def test_sketches_of_panes(spark):
    """Many ports: within the error of a sketch; kept panes can be merged into other windows."""
    flows = spark.range(200_000).select((F.lit(BASE) + F.make_dt_interval(secs=F.col("id") % 3600)).alias("ts"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), (F.col("id") % 50_021).cast("int").alias("dst_port"), F.lit("tcp").alias("transport"))
    exact = {r.window_start: r.distinct_ports for r in detections.port_fan_out_windowed(flows, 1, "20 minutes", "10 minutes").collect()}
    sketches = detections.pane_sketches(flows, "1 minute")
    for found in (detections.port_fan_out_windowed(flows, 1, "20 minutes", "10 minutes", approximate=True), detections.fan_out_of_sketches(sketches, "20 minutes", "10 minutes", "1 minute")):
        rows = {r.window_start: r.distinct_ports for r in found.collect()}
        assert rows.keys() == exact.keys() and all(abs(rows[w] - n) < 0.06 * n for w, n in exact.items())
    assert max(exact.values()) > 30_000 and detections.port_fan_out_windowed(flows.limit(0), 1, "1 minute").count() == 0


def test_scheduled_runs_equal_one_run(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"k{rnd.randint(0, 3)}", BASE + timedelta(seconds=rnd.randint(0, 4 * 86400)), i, rnd.randint(0, 2)) for i in range(1200)]
    evidence, found = f"file://{tmp_path}/evidence", f"file://{tmp_path}/alerts"
    span = 7200
    stages = [Stage(F.col("stage") == k, [F.col("key")]) for k in range(3)]
    rule = lambda e: sequence(e, stages, span).select(F.concat_ws(",", *[F.col(f"stage{k}.seq").cast("string") for k in (1, 2, 3)]).alias("_id"))
    frame = spark.createDataFrame(rows, SEQUENCE)
    schedule.keep(frame, evidence)
    bounds = [BASE + timedelta(hours=h) for h in (-1, 20, 21, 47, 72, 97)]
    for n, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        schedule.run_rule(spark, evidence, found, rule, start, end, span)
        if n == 1:
            schedule.run_rule(spark, evidence, found, rule, start, end, span)  # done again
    ids = [r._id for r in schedule.alerts(spark, found).collect()]
    assert sorted(ids) == sorted(r._id for r in rule(frame).collect()) and len(ids) > 50
    plan = schedule.look_back(spark, evidence, bounds[1], bounds[2], span)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    scanned = schedule.look_back(spark, evidence, bounds[1], bounds[2], span).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("day=")[1][:10] for r in scanned} == {"2026-08-11"}


LOGONS = "seq long, ts timestamp, ts_raw string, host_name string, host_ips array<string>, src_ip string, identity string, logon_id string, logon_type string, ref string"
EVENTS = f"kind string, {LOGONS}, dst_ip string, dst_port int, subject_identity string, target_identity string, subject_logon_id string, target_server string"


def evidence(rows):
    """(flows, logons, privileges, credential uses) out of one table or stream of all."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    return (
        of("logon").select(*[c.split(" ")[0] for c in LOGONS.split(", ")]),
        of("flow").select("seq", "ts", "src_ip", "dst_ip", "dst_port", "ref"),
        of("priv").select("seq", "ts", "host_ips", "identity", "logon_id", "ref"),
        of("cred").select("seq", "ts", "host_ips", "subject_identity", "target_identity", "subject_logon_id", "target_server", "ref"),
    )


def test_live_edges_equal_batch_edges(spark, tmp_path):
    def row(kind, seq, t, src=None, ips=None, who=None, session=None, port=None, dst=None, subject=None, server=None):
        raw = f"t{seq}"
        return (kind, seq, BASE + timedelta(seconds=t), raw, "APP" if ips else None, ips, src, None if kind == "cred" else who, None if kind == "cred" else session, "10" if kind == "logon" else None, f"r{seq}", dst, port, subject, who if kind == "cred" else None, session if kind == "cred" else None, server)

    rows = [
        row("flow", 1, 0, "1.1", dst="2.2", port=3389), row("flow", 2, 5, "1.1", dst="2.2", port=3389), row("flow", 3, 8, "1.1", dst="2.2", port=445),
        row("cred", 4, 9, ips=["1.1"], who="bob", session="S1", subject="al", server="app"), row("cred", 5, 9, ips=["1.1"], who="bob", session="S9", subject="al", server="other"),
        row("logon", 6, 20, "1.1", ["2.2", "3.3"], "bob", "L1"), row("logon", 7, 30, "9.9", ["2.2"], "bob", "L2"), row("priv", 8, 25, ips=["3.3"], who="bob", session="L1"), row("priv", 9, 26, ips=["2.2"], who="bob", session="L1"),
        row("logon", 10, 200, "1.1", ["2.2"], "bob", "L3"), row("flow", 11, 300, None, dst="2.2", port=3389), row("logon", 12, 310, None, ["2.2"], None, None), row("priv", 13, 365, ips=["2.2"]),
    ]
    end = [[row("flow", 90, 4000 + t, "z", dst="y", port=3389), row("logon", 91, 4000 + t, "x", ["y"]), row("priv", 92, 4000 + t, ips=["y"]), row("cred", 93, 4000 + t, ips=["y"], session="S")] for t in (0, 600, 1200)]
    ip_map = spark.createDataFrame([("1.1", "WS"), ("2.2", "APP")], "ip string, host string")
    make = lambda df: detect.live_edges(*evidence(df), ip_map, lateness="30 seconds")
    got = run(spark, tmp_path, [rows[:5], rows[5:9], rows[9:], *end], EVENTS, make, "edges")
    logons, flows, privs, creds = evidence(spark.createDataFrame(rows, EVENTS))
    want = E.materialize_edges(flows, logons, privs, creds, ip_map).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 2
    assert {(r.identity, r.privilege_state, r.credential_transition and r.credential_transition.state) for r in got} == {("bob", "confirmed", "confirmed"), (None, "confirmed", None)}


def test_live_rules(spark, tmp_path):
    schema = "_id string, ts timestamp, category string, type string, host_name string, user_name string, parent_name string, process_name string, command_line string"
    e = lambda i, cmd, t=0: (f"d{i}", BASE + timedelta(seconds=t), "process", "start", "h", "u", "p", "pwsh.exe", cmd)
    batches = [[e(1, "pwsh -enc " + "aB3+" * 9), e(2, "pwsh -file x")], [e(3, "pwsh -e " + "aB3+" * 9), e(1, "pwsh -enc " + "aB3+" * 9, 1)]]
    got = run(spark, tmp_path, batches, schema, lambda s: detect.live_alerts(detect.live_encoded_powershell(s)), "rules")
    assert sorted(r._id for r in got) == ["d1", "d3"]


def test_a_busy_key_is_cut_into_bins(spark):
    rnd = random.Random(4)
    rows = [(i, BASE + timedelta(seconds=rnd.randint(0, 4000)), rnd.randint(0, 2)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "seq long, ts timestamp, stage int").withColumn("host", F.lit("h"))
    got = {tuple(r[f"stage{k}"].seq for k in (1, 2, 3)) for r in sequence(frame, [Stage(F.col("stage") == k) for k in range(3)], 9, by=[F.col("host")], carry=["seq"]).collect()}
    pending, want = [None, None], set()
    for seq, ts, stage in sorted(rows, key=lambda r: (r[1], r[0])):
        if stage == 0:
            pending[0] = (ts, (seq,))
            continue
        held, pending[stage - 1] = pending[stage - 1], None
        if held and (ts - held[0]).total_seconds() <= 9:
            if stage == 1:
                pending[1] = (held[0], (*held[1], seq))
            else:
                want.add((*held[1], seq))
    assert got == want and len(want) > 20


def test_live_edges_hold_one_join_in_bins(spark):
    """One stateful join for all kinds of events, with the time bin among its keys; the other two look up names."""
    ip_map = spark.createDataFrame([("1.1", "WS")], "ip string, host string")
    logons, flows, privs, creds = evidence(spark.createDataFrame([], EVENTS))
    plan = detect.live_edges(logons, flows, privs, creds, ip_map)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert len([j for j in joins if "Join Inner" in j]) == 1 and len(joins) == 3
    assert all("bin#" in j for j in joins if "Join Inner" in j)


def dense_rows(n, seconds, seed):
    """Evidence of all kinds under few keys, in no order of time."""
    rnd = random.Random(seed)
    pick = lambda *of: rnd.choice(of)
    rows = []
    for seq in range(n):
        kind, at = pick("logon", "flow", "priv", "cred"), BASE + timedelta(seconds=rnd.randint(0, seconds), microseconds=pick(0, 0, 1, 999999))
        ips = [["2.2"], ["3.3", "2.2"], ["3.3"], ["2.2", "2.2", None]][rnd.randrange(4)] if kind in ("logon", "priv") else [pick("1.1", None), "1.2"]
        who, session = pick("al", "bo", None), pick("S1", "S2", None)
        is_ = lambda *kinds: kind in kinds  # noqa: B023, E731
        rows.append((
            kind, seq, at, f"t{seq}", pick("APP", "app.x", None) if is_("logon") else None, None if is_("flow") else ips, pick("1.1", "1.1", None) if is_("logon", "flow") else None, who if is_("logon", "priv") else None,
            session if is_("logon", "priv") else None, pick("10", "3") if is_("logon") else None, f"r{seq}", pick("2.2", "3.3") if is_("flow") else None, pick(3389, 445, 443) if is_("flow") else None,
            "cy" if is_("cred") else None, who if is_("cred") else None, pick("S1", "S1", "S2", "") if is_("cred") else None, pick("app", "APP.corp", "3.3", " 2.2 ", "other", None) if is_("cred") else None,
        ))
    return rows


def test_live_edges_equal_batch_edges_in_any_windows(spark):
    """The sweep of a group answers what the windows hold, where they differ, where they are nothing, and at their ends."""
    ip_map = spark.createDataFrame([("1.1", "WS"), ("2.2", "APP"), ("3.3", "DB")], "ip string, host string")
    inputs = evidence(spark.createDataFrame(dense_rows(500, 150, 3), EVENTS))
    kinds = set()
    for spans in ((9, 4, 21), (30, 30, 30), (2, 0, 1.5)):
        flows, logons = inputs[1], inputs[0]
        got = detect.live_edges(logons, flows, *inputs[2:], ip_map, *spans).collect()
        want = E.materialize_edges(flows, logons, *inputs[2:], ip_map, *spans).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 10
        kinds |= {(r.privilege_state, r.credential_transition and r.credential_transition.state) for r in want}
    assert {("confirmed", "confirmed"), ("confirmed", "unknown"), ("absent", None)} <= kinds


def test_live_edges_join_groups_not_events(spark, tmp_path):
    """However many events share a key and a bin, the stream's join holds a row for either side of it, and gives one."""
    rows, spans = [r for r in dense_rows(2400, 50, 5) if r[0] != "logon" or r[9] == "10"], (60, 60, 60)
    late = lambda t: [tuple([kind, 9000 + k, BASE + timedelta(days=1 + t), "t", "x" if kind == "logon" else None, ["y"], "z", "w", "s", "10", "r", "q", 3389, "v", "w", "end", None]) for k, kind in enumerate(("logon", "flow", "priv", "cred"))]
    ip_map = spark.createDataFrame([("1.1", "WS"), ("2.2", "APP")], "ip string, host string")
    for n, part in enumerate((rows, late(0), late(1))):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/files/b{n}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/files")
    logons, flows, privs, creds = evidence(stream)
    q = detect.live_edges(logons, flows, privs, creds, ip_map, *spans).writeStream.format("memory").queryName("dense_edges").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    joined = sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin")
    logons, flows, privs, creds = evidence(spark.createDataFrame(rows, EVENTS))
    want = E.materialize_edges(flows, logons, privs, creds, ip_map, *spans).collect()
    assert sorted(map(repr, spark.table("dense_edges").collect())) == sorted(map(repr, want)) and len(want) > 150
    assert 10 < joined < 250
