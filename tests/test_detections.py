"""Rules, sequences, flows, input adapters and hybrid edges on the samples' cases."""

import ipaddress
import json
import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.functions import scalars as S
from trailweave.operators import detections, flows, hybrid, windows
from trailweave.operators.sequences import Stage, sequence
from trailweave.plans import case as cases
from trailweave.sources import context, records

BASE = datetime(2026, 8, 10, 10, 0, 0, tzinfo=timezone.utc)


def at(s):
    return BASE + timedelta(seconds=s)


def test_rc4_tickets(spark):
    rows = [("4768", "success", "0x17", u) for u in ("alice", "krbtgt", "-", "", "HOST$", None)] + [("4768", "failure", "0x17", "a"), ("4768", "success", "0x12", "a"), ("4769", "success", "0x17", "a")]
    df = spark.createDataFrame(rows, "code string, outcome string, ticket_encryption string, target_user string")
    assert [r.target_user for r in detections.rc4_tgt(df).collect()] == ["alice"]


@pytest.mark.parametrize("name,cmd,hit", [("powershell.exe", "powershell -encod " + "A" * 24, 1), ("PWSH.EXE", "x -EC  " + "a" * 20, 1), ("powershell.exe", "p -enc short", 0), ("powershell.exe", "p -executionpolicy " + "a" * 30, 0), ("cmd.exe", "x -enc " + "a" * 30, 0), ("powershell.exe", "a\nb -e " + "a" * 20 + "\nc", 1), ("powershell.exe", None, 0)])
def test_encoded_powershell(spark, name, cmd, hit):
    df = spark.createDataFrame([("d", BASE, "process", "start", "h", "u", "p", name, cmd)], "_id string, ts timestamp, category string, type string, host_name string, user_name string, parent_name string, process_name string, command_line string")
    assert detections.encoded_powershell(df).count() == hit


def machine(events, span):
    """The published state machine: the latest pending sequence of each stage, taken over by the next."""
    pending, out = {}, []
    for t, seq, stage, key in sorted(events):
        slots = pending.setdefault(key, [None] * 2)
        if stage == 0:
            slots[0] = [(t, seq)]
            continue
        held, slots[stage - 1] = slots[stage - 1], None
        if held and t - held[0][0] <= span:
            grown = [*held, (t, seq)]
            if stage == 2:
                out.append(tuple(s for _, s in grown))
            else:
                slots[stage] = grown
    return sorted(out)


def test_sequence_against_the_state_machine(spark):
    rnd = random.Random(8)
    events = [(rnd.randint(0, 400), i, rnd.randint(0, 2), f"k{rnd.randint(0, 5)}") for i in range(600)]
    df = spark.createDataFrame([(at(t), i, s, k) for t, i, s, k in events], "ts timestamp, seq long, stage int, key string")
    found = sequence(df, [Stage(F.col("stage") == k, [F.col("key")]) for k in range(3)], 30).collect()
    assert sorted((r.stage1.seq, r.stage2.seq, r.stage3.seq) for r in found) == machine(events, 30)


@pytest.mark.parametrize("gap,host,hit", [(30, "h", 1), (60, "h", 1), (61, "h", 0), (30, "other", 0)])
def test_rdp_logon_then_process(spark, gap, host, hit):
    rows = [(1, at(0), "authentication", "4624", None, "success", "10", "10.0.0.5", "h", "u", None), (2, at(gap), "process", None, "start", None, None, None, host, None, "u")]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, category string, code string, type string, outcome string, logon_type string, ip_address string, computer_name string, target_user string, user_name string")
    assert detections.rdp_logon_then_process(df).count() == hit


def packet(seq, t, src, dst, flags="A", size=60, transport="tcp"):
    return (seq, at(t), *src, *dst, transport, flags, size)


PACKETS = "seq long, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, transport string, flags string, size int"


def test_flow_folding_and_orientation(spark):
    a, b = ("10.0.0.10", 50000), ("10.0.0.60", 3389)
    rdp = [packet(1, 0, a, b, "S"), packet(2, 1, b, a, "SA"), *(packet(i, i, *([a, b] if i % 2 else [b, a])) for i in range(3, 8))]
    (f,) = flows.flow_events(flows.fold_flows(spark.createDataFrame(rdp, PACKETS))).collect()
    assert (f.src_ip, f.dst_port, f.protocol, f.packets, f.client_packets, f.duration_ns) == ("10.0.0.10", 3389, "rdp", 7, 4, 7 * 10**9)
    late = [packet(1, 0, b, a, "SA"), packet(2, 1, a, b, "A")]
    assert flows.fold_flows(spark.createDataFrame(late, PACKETS)).first().client.port == 50000
    udp = [packet(1, 0, a, ("10.0.0.1", 53), None, transport="udp")]
    assert flows.fold_flows(spark.createDataFrame(udp, PACKETS)).first().server.port == 53
    itself = [packet(1, 0, a, a, "S"), packet(2, 1, a, a)]
    f = flows.fold_flows(spark.createDataFrame(itself, PACKETS)).first()
    assert (f.client_packets, f.server_packets) == (2, 2)


def test_fan_out(spark):
    scan = [packet(i, i, ("s", 1000), ("d", 1 + i), "S") for i in range(25)]
    web = [packet(100 + i, i, ("s", 2000 + i), ("w", 443), "S") for i in range(15)]
    ev = flows.flow_events(flows.fold_flows(spark.createDataFrame(scan + web, PACKETS)))
    assert [(r.dst_ip, r.distinct_ports) for r in detections.port_fan_out(ev).collect()] == [("d", 25)]
    assert detections.port_fan_out_windowed(ev, 20, "1 minute").count() == 1
    assert flows.to_ecs(ev).first().event.category == ["network"]


def test_scalars(spark):
    texts = ["::ffff:10.0.0.1", " 10.0.0.1 ", "2001:DB8:0:0::1", "-", "", None, "nonsense", "a:b", "::ffff:999.1.1.1", " host x ", "\t::1\n", "::", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "::ffff:0a00:0001", "64:ff9b::1.2.3.4", "fe80::00a%eth0", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "12345::", "::1%", "::ffff:10.0.0.1%x", "0:0:0:0:0:0:13.1.68.3", "::01.2.3.4", "1:2:3:4:5:6:7"]

    def library(v):
        if v in (None, "", "-"):
            return v
        try:
            ip = ipaddress.ip_address(v.strip())
        except ValueError:
            return v.strip()
        return str(getattr(ip, "ipv4_mapped", None) or ip)

    rnd = random.Random(8)
    group = lambda: rnd.choice(["0", "0", "0", "00", "1", "ab", "0C", "ffff", ""])
    texts += [":".join(group() for _ in range(rnd.choice([3, 7, 8, 8, 8, 9]))) for _ in range(400)]
    rows = [(x,) for x in texts]
    got = [r[0] for r in spark.createDataFrame(rows, "ip string").select(S.canonical_ip(F.col("ip"))).collect()]
    assert got == [library(x) for x in texts]
    many = spark.createDataFrame([(texts,)], "ips array<string>").select(F.transform("ips", S.canonical_ip)).first()[0]
    assert many == got
    df = spark.createDataFrame([("alice", "CORP"), ("CORP\\bob", "X"), ("a@b", "X"), ("", "X"), (None, "X"), ("alice", None)], "u string, d string")
    assert [r[0] for r in df.select(S.norm_identity(F.col("u"), F.col("d"))).collect()] == ["CORP\\alice", "CORP\\bob", "a@b", "", None, "alice"]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


LOGON = {"@timestamp": "2026-08-10T10:00:30Z", "event": {"code": 4624}, "host": {"name": "srv-app-01.corp.example"}, "winlog": {"event_data": {"TargetUserName": "alice", "TargetDomainName": "CORP", "TargetLogonId": "0xA1", "IpAddress": "::ffff:10.0.0.10", "LogonType": "10"}}}


def test_input_adapters(spark, tmp_path):
    array = write(tmp_path / "a.json", "﻿" + json.dumps([LOGON, 5]))
    search = write(tmp_path / "b.json", json.dumps({"hits": {"hits": [{"_id": "x1", "_source": LOGON}]}}))
    bulk = write(tmp_path / "c.ndjson", json.dumps({"index": {}}) + "\n\n" + json.dumps(LOGON) + "\nnot json\n")
    good, bad = records.read_json_records(spark, [array, search, bulk])
    assert [(r.source_file) for r in bad.collect()] == ["c.ndjson"]
    with pytest.raises(ValueError, match="c.ndjson:4"):
        records.require_no_bad(bad)
    raw = records.windows_records(records.unwrap_envelope(good))
    ip_map = context.load_ip_map(spark, write(tmp_path / "map.json", json.dumps({"10.0.0.10": "WS-ENG-12", "10.0.0.60": "SRV-APP-01"})))
    events = windows.normalize_windows_events(windows.dense_seq(raw, ["source_file", "line", "item"]), ip_map)
    got = sorted(events.collect(), key=lambda r: r.seq)
    assert [r.seq for r in got] == [0, 1, 2]
    for r in got:
        assert (r.host_name, r.host_ips, r.src_ip, r.identity, r.outcome) == ("SRV-APP-01", ["10.0.0.60"], "10.0.0.10", "CORP\\alice", "success")
    assert got[1].ref == "x1" and got[0].ref.startswith("raw-") and got[0].ref == got[2].ref  # no number, no id: what it holds is its reference
    assert windows.windows_quality(events).count() == 0
    assert records.evidence_descriptors(spark, [array], "windows").first().size == (tmp_path / "a.json").stat().st_size


def test_line_numbers_count_within_each_file(spark, tmp_path):
    files = {f"f{i}.ndjson": ["", *[json.dumps({"n": n}) if n % 7 else "bad" for n in range(200 * i)]] for i in range(1, 4)}
    paths = [write(tmp_path / name, "\n".join(lines) + "\n") for name, lines in files.items()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # several blocks in a file, several files in a partition
    try:
        good, bad = records.read_json_records(spark, paths)
        assert {(r.source_file, r.line, r.n) for r in good.select("source_file", "line", F.try_variant_get("v", "$.n", "int").alias("n")).collect()} == {(f, i, json.loads(x)["n"]) for f, xs in files.items() for i, x in enumerate(xs) if x.startswith("{")}
        assert {(r.source_file, r.line) for r in bad.collect()} == {(f, i) for f, xs in files.items() for i, x in enumerate(xs) if x == "bad"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("small", [0, 1000])
def test_windows_ids_addresses_and_map_order(spark, monkeypatch, small):
    monkeypatch.setattr(windows, "SMALL_MAP", small)
    rows = [(0, "4624", "a.corp", ["2001:DB8:0::1"], "7", None, {"IpAddress": "2001:db8::0:2"}), (1, "4672", "b", None, None, "12", {}), (2, "4672", "c", ["9.9.9.9", "10.0.0.2", "10.0.0.1"], None, None, {}), (3, "4672", None, None, None, "1", {})]
    events = spark.createDataFrame([(*r[:4], None, r[4], r[5], r[6], '{"n":%d}' % r[0], "2026-08-10T10:00:00") for r in rows], "seq long, code string, host_name string, host_ips array<string>, computer_name string, record_id string, sequence string, data map<string, string>, raw string, ts_raw string")
    ip_map = spark.createDataFrame([(0, "10.0.0.2", "B.corp"), (1, "10.0.0.1", "b"), (2, "2001:db8::1", "A")], "pos int, ip string, host string")
    got = {r.seq: r for r in windows.normalize_windows_events(events, ip_map).collect()}
    assert (got[0].host_name, got[0].host_ips, got[0].src_ip, got[0].ref) == ("A", ["2001:db8::1"], "2001:db8::2", "windows:A:7")
    assert (got[1].host_name, got[1].host_ips, got[1].ref) == ("B.corp", ["10.0.0.2", "10.0.0.1"], "windows:B.corp:12")
    assert (got[2].host_name, got[2].host_ips) == ("B.corp", ["9.9.9.9", "10.0.0.2", "10.0.0.1"]) and got[2].ref.startswith("raw-")
    assert (got[3].host_name, got[3].host_ips, got[3].ref) == (None, [], "windows:unknown:1")


def test_contract_rules_of_common_edges(spark):
    from trailweave.operators import checks

    entity = "struct<kind: string, id: string, display_name: string>"
    schema = f"schema_version string, edge_id string, ts timestamp, environment string, edge_type string, subject {entity}, effective_subject {entity}, source {entity}, target {entity}, session struct<id: string, parent_session_id: string, state: string>, auth_state string, privilege_state string, credential_transition struct<from_subject: {entity}, to_subject: {entity}, state: string, evidence_ref: string>, evidence_refs array<struct<source_type: string, evidence_ref: string, source_file: string, source_sha256: string>>, native_context map<string, string>"
    e, t = ("host", "h", None), datetime(2026, 8, 10)
    good = ["2.0", "id", t, "aws", "accessed_resource", e, e, e, e, ("s", None, "unknown"), "absent", "unknown", (e, e, "unknown", None), [("x", "r", None, None)], {}]
    faults = {4: "other", 5: ("host", "", None), 6: ("host", "h", ""), 9: ("s", None, "absent"), 12: (None, e, "confirmed", None), 13: [("", "r", None, None)], 14: None}
    rows = [good] + [[v if k == i else x for i, x in enumerate(good)] for k, v in faults.items()] + [[("absent" if i == 12 else x) if i != 12 else (e, e, "absent", None) for i, x in enumerate(good)], [x if i != 13 else [("x", "r", "", "0" * 63)] for i, x in enumerate(good)]]
    got = [checks.check_reachability_edges(spark.createDataFrame([r], schema)).count() for r in rows]
    assert got == [0] + [1] * (len(rows) - 1)


def role(**kw):
    r = {"eventSource": "sts.amazonaws.com", "eventName": "AssumeRole", "eventID": "e1", "eventTime": "2026-08-10T10:00:00Z", "userIdentity": {"arn": "arn:u"}, "requestParameters": {"roleArn": "arn:r/x/Admin"}, "responseElements": {"credentials": {"accessKeyId": "AK"}}}
    return {k: v for k, v in (r | kw).items() if v is not None}


def test_cloud_records(spark):
    docs = [{"Records": [role(), role(eventName="GetUser"), 7]}, {"detail": role(errorCode="x")}, role(eventID=None, userIdentity=None), role(responseElements={"assumedRoleUser": {"assumedRoleId": "AR"}})]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "raw string").select(F.parse_json("raw").alias("v"))
    got = hybrid.assume_role_records(records.expand_cloudtrail(df)).collect()
    assert sorted(r.reason or "" for r in got) == ["", "", "failed AssumeRole", "missing eventID, actor", "not sts:AssumeRole"]
    ok = [r for r in got if r.reason is None]
    assert {r.session.id for r in ok} == {"AK", "AR"} and ok[0].target.display_name == "Admin" and ok[0].edge_id.startswith("aws:")


def test_continuity_needs_an_explicit_mapping(spark):
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "on_prem_identity string, cloud_principal string")
    maps = spark.createDataFrame([("a", "x", "confirmed", "m2", 2), ("a", "x", "confirmed", "m1", 1), ("b", "x", "unknown", "m3", 3)], "on_prem_identity string, cloud_principal string, state string, evidence_ref string, seq int")
    assert {(r.on_prem_identity, r.state, r.evidence_ref) for r in hybrid.cross_env_continuity(pairs, maps).collect()} == {("a", "confirmed", "m1"), ("b", "unknown", None)}


def test_case_end_to_end(spark):
    """Two remote desktop conversations, the second on to a domain controller, become one critical finding; twice alike."""
    a, b, c = ("10.0.0.10", 50000), ("10.0.0.60", 3389), ("10.0.0.60", 50001)
    d = ("10.0.0.90", 3389)
    packets = [packet(1, 0, a, b, "S"), packet(2, 0, b, a, "SA"), packet(3, 0, a, b), packet(4, 60, c, d, "S"), packet(5, 60, d, c, "SA"), packet(6, 60, c, d)]

    def logon(seq, t, host, ip, src, lid):
        return [(seq, S_iso(t), "4624", {"TargetUserName": "dom_admin", "TargetDomainName": "CORP", "TargetLogonId": lid, "IpAddress": src, "LogonType": "10"}, host, [ip]), (seq + 1, S_iso(t + 1), "4672", {"SubjectUserName": "dom_admin", "SubjectDomainName": "CORP", "SubjectLogonId": lid}, host, [ip])]

    rows = logon(0, 30, "SRV-APP-01", "10.0.0.60", "10.0.0.10", "0x1") + logon(2, 90, "DC01", "10.0.0.90", "10.0.0.60", "0x2")
    events = spark.createDataFrame(rows, "seq long, ts_raw string, code string, data map<string, string>, host_name string, host_ips array<string>")
    ip_map = spark.createDataFrame([("10.0.0.10", "WS-ENG-12"), ("10.0.0.60", "SRV-APP-01"), ("10.0.0.90", "DC01")], "ip string, host string")
    ctx = context.context_from_rows(spark, hosts=[("DC01", 0, True), ("SRV-APP-01", 1, False), ("WS-ENG-12", 2, False)], identities=[("CORP\\dom_admin", 0)], policy=[("2026-01-01", "2026-12-31")], complete_for=[("on_prem", "CORP\\dom_admin", 0)], known_edges=[])
    case = cases.reconstruct_case(spark.createDataFrame(packets, PACKETS), events, None, ip_map, ctx)
    (f,) = case.findings.collect()
    assert (f.label, f.path) == ("CRITICAL_UNAPPROVED_PATH", ["WS-ENG-12", "SRV-APP-01", "DC01"])
    assert {r.name: r.n for r in cases.case_counts(case).collect()} == {"network_flows": 2, "windows_events": 4, "pivot_edges": 2, "reachability_edges": 2, "findings": 1, "violations": 0}
    plan = cases.case_counts(case)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "LocalTableScan" in plan  # counted when written
    assert {stage for stage, took, _ in cases.timed_counts(case) if took > 0} == {*case.milliseconds}
    files = lambda digest: spark.createDataFrame([("windows", 5, digest)], "role string, size long, sha256 string")
    ids = {cases.derivation_id({"edges": case.pivot_edges.repartition(n)}, files("aa"), {}).first()[0] for n in (1, 3)}
    assert len(ids) == 1 and cases.derivation_id({"edges": case.pivot_edges}, files("ab"), {}).first()[0] not in ids
    assert set(cases.report_tables(case)) == {"evidence", "quality", "edges", "findings"}


def S_iso(t):
    return at(t).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_fingerprint_sees_content(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "a long, b string")
    same = {cases.fingerprint(x).first()[0] for x in (df, df.repartition(7), df.orderBy(F.desc("a")))}
    assert len(same) == 1 and cases.fingerprint(df.where("a > 0")).first()[0] not in same


def test_fingerprint_counts_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "a long, b string")
    digests = [cases.fingerprint(x).first() for x in (df, df.distinct(), df.limit(0), df.select("b", "a"))]
    assert [d.n for d in digests] == [3, 2, 0, 3] and len({d.digest for d in digests[:3]}) == 3 and digests[3] == digests[0]


def test_large_documents_are_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(4)
    items = [LOGON | {"n": i, "x": rnd.choice(['a"b', "\\", "[x]", "}{", "é中", '" : [']) * rnd.randint(0, 4)} if i % 9 else rnd.choice([5, None, [1, {"a": "]"}], "text"]) for i in range(300)]
    documents = {"a.json": items, "b.json": {"Records": items}, "c.json": {"took": 1, "hits": {"total": "]", "hits": [{"_id": f"i{n}", "_source": x} for n, x in enumerate(items) if n % 9]}, "z": 3}, "d.json": {"other": items}, "e.json": []}
    paths = [write(tmp_path / name, ("﻿" if name == "b.json" else "") + json.dumps(d, indent=1 if name == "a.json" else None, ensure_ascii=False)) for name, d in documents.items()]
    paths.append(write(tmp_path / "f.json", "\n".join(json.dumps(x) for x in items)))  # lines, not one document
    paths.append(write(tmp_path / "g.json", '{"Records": [1]}\n{"Records": [2]}'))

    def read(size):
        good, bad = records.read_json_records(spark, paths, split_bytes=size)
        every = records.unwrap_envelope(good.where("source_file != 'b.json'")).select("source_file", "raw", "doc_id").unionByName(records.expand_cloudtrail(good.where("source_file = 'b.json'").drop("raw")).select("source_file", F.to_json("v").alias("raw"), F.lit("cloud").alias("doc_id")))
        return good, sorted(map(str, every.collect())), bad.count()

    whole, split = read(1 << 30), read(1000)
    mine = split[0].where("source_file != 'f.json'").groupBy("source_file").count().collect()
    assert split[1:] == whole[1:] and {r.source_file for r in mine if r["count"] > 200} == {"a.json", "b.json", "c.json"}
    old = records.split_json.RANGE_BYTES
    good = records.split_json.read_split(spark, paths[0], (tmp_path / "a.json").stat().st_size, range_bytes=997)
    assert [json.loads(r.raw)[0] for r in good.orderBy("line").collect()] == items and good.rdd.getNumPartitions() > 10 and old == 32 << 20


def test_documents_are_dealt_to_tasks_together(spark, tmp_path):
    paths = [write(tmp_path / f"{n}.json", json.dumps([{"n": n, "i": i} for i in range(20)])) for n in range(12)]
    good, bad = records.read_json_records(spark, paths, split_bytes=10)
    tasks = good.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 200 and sum(r["count"] for r in tasks) == 240 and bad.count() == 0


def test_a_range_is_read_in_pieces(monkeypatch, tmp_path):
    split = records.split_json
    items = [{"n": i, "x": "\\" * (i % 5) + '",[' * (i % 3), "long": "]" * (400 if i == 7 else 0)} for i in range(40)]
    path = write(tmp_path / "a.json", json.dumps(items))
    size, seen, whole_file = (tmp_path / "a.json").stat().st_size, [], (tmp_path / "a.json").read_bytes()
    array, structure = split._array_of(whole_file), split._structure
    monkeypatch.setattr(split, "_structure", lambda data, *state: (seen.append(len(data)), structure(data, *state))[1])

    def read(width):
        ranges = [(path, a, min(a + width, size)) for a in range(0, size, width)]
        batch = pa.RecordBatch.from_pylist([dict(zip(("path", "start", "stop"), r, strict=True)) for r in ranges])
        said = [r for b in split._summaries([batch]) for r in b.to_pylist()]
        states = split._states({(r["start"], r["inside"]): r for r in said}, ranges, array)
        with split.opened(path) as f:
            return said, [(a, json.loads(x)) for r in states for a, x in split._items_of(f, r)]

    whole = [read(width) for width in (size, 300, 31)]
    seen.clear()
    monkeypatch.setattr(split, "_MORE", 16)
    assert [read(width) for width in (size, 300, 31)] == whole and max(seen) <= 16
    assert all([x for _, x in found] == items for _, found in whole)


def test_hashes_of_files_of_any_size(spark, tmp_path):
    import hashlib

    large = tmp_path / "large.bin"
    with large.open("wb") as f:
        f.write(b"begin")
        f.truncate((2 << 30) + 77)
    write(tmp_path / "small.txt", "x" * 100)
    want = hashlib.sha256(b"begin")
    for n in (32 << 20,) * 64:
        want.update(bytes(n))
    want.update(bytes(77 - 5))
    got = {r.file_name: (r.size, r.sha256) for r in records.evidence_descriptors(spark, [f"file://{tmp_path}"], "x").collect()}
    assert got == {"large.bin": ((2 << 30) + 77, want.hexdigest()), "small.txt": (100, hashlib.sha256(b"x" * 100).hexdigest())}


def test_owned_tables_are_removed(spark, tmp_path):
    import os

    from trailweave.sources import scratch

    with scratch.owned(spark):
        kept = scratch.table(spark.range(5), "five")
        (folder,) = {f.removeprefix("file:").rsplit("/", 1)[0] for f in kept.inputFiles()}
        folder = "/" + folder.lstrip("/")
        assert os.path.isdir(folder) and kept.count() == 5
    assert not os.path.exists(folder)


def test_published_as_a_whole(spark, tmp_path):
    from trailweave.sources import publish

    path = f"file://{tmp_path}/p"
    df = spark.createDataFrame([(2, {"b": 1, "a": None}), (1, None)], "z int, m map<string, int>")
    assert publish.published(spark, path).count() == 0 and publish.read_published(spark, path) == {}
    assert publish.publish({"one": df.where("z = 1"), "two": df}, path, cases.fingerprint) == 1
    assert publish.publish({"one": df}, path, cases.fingerprint) == 2
    with pytest.raises(Exception, match="no more"):
        publish.publish({"one": df.where("z = 1"), "two": df.select(F.raise_error(F.lit("no more")).alias("z"))}, path, cases.fingerprint)
    found = publish.read_published(spark, path, cases.fingerprint)
    assert {k: v.count() for k, v in found.items()} == {"one": 2}
    assert {r.value for r in publish.sorted_json(df).collect()} == {'{"m":{"a":null,"b":1},"z":2}', '{"z":1}'}
    spark.range(1).select(F.lit(3).alias("z"), F.lit(None).cast("map<string, int>").alias("m")).write.mode("append").parquet(publish.published(spark, path).first().folder)
    with pytest.raises(ValueError, match="not what was published"):
        publish.read_published(spark, path, cases.fingerprint)


def test_loaders(spark, tmp_path):
    from trailweave.sources import loaders

    path = write(tmp_path / "w.json", json.dumps([LOGON, {"event": {"code": 1}}]))
    ip_map = spark.createDataFrame([("10.0.0.60", "SRV-APP-01")], "ip string, host string")
    xml = '<Event><System><EventID>4672</EventID><TimeCreated SystemTime="2026-08-10T10:00:31Z"/><EventRecordID>5</EventRecordID><Computer>srv-app-01</Computer></System><EventData><Data Name="SubjectUserName">alice</Data><Data Name="SubjectLogonId">0xA1</Data></EventData></Event>'
    made = loaders.load_windows_sources(spark, [path], ip_map, spark.createDataFrame([("x.xml", 0, xml)], "source_file string, line long, xml string"))
    assert [(r.code, r.host_name, r.logon_id) for r in made.rows.collect()] == [("4624", "SRV-APP-01", "0xA1"), ("4672", "SRV-APP-01", "0xA1")]
    assert {(r.source_file, r.raw_records, r.accepted_records) for r in made.files.collect()} == {("w.json", 2, 1), ("x.xml", 1, 1)}
    assert made.issues.count() == 0 and made.bad.count() == 0
    cloud = loaders.load_cloudtrail_sources(spark, [write(tmp_path / "c.json", json.dumps({"Records": [role(), role(eventName="x")]}))])
    (edge,) = cloud.rows.collect()
    assert len(edge.evidence_refs[0].source_sha256) == 64 and [tuple(r) for r in cloud.files.collect()] == [("c.json", 2, 1)]
    assert [tuple(r) for r in cloud.issues.collect()] == [("not sts:AssumeRole", 1)]


def test_lifted_edges_keep_other_columns_without_a_join(spark):
    from trailweave.plans import queries

    made = queries.check_reachability_edges(spark, "/root/testdata/sf0.001")
    scans = made._jdf.queryExecution().analyzed().toString()
    plain = queries.materialize_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert scans.count("Join ") == plain.count("Join ")
