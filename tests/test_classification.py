"""The scenarios of multi-hop progression, each with its exact findings."""

from datetime import datetime, timedelta, timezone

import pytest

from trailweave.operators import checks, graph, policy
from trailweave.plans import queries
from trailweave.sources.context import context_from_rows

EDGE = """edge_id string, seq long, ts timestamp, ts_raw string, source_host string, source_ip string, target_host string, target_ip string, identity string,
effective_identity string, service string, logon_id string, source_logon_id string, privilege_state string, auth_state string,
credential_transition struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>, evidence_refs struct<network: string, logon: string, privilege: string>"""
ALICE, BOB, ADMIN, SVC = "CORP\\alice", "CORP\\bob", "CORP\\dom_admin", "CORP\\svc-backup"
WS, FIN, APP, FILE, PAW, DC = "WS-ENG-12", "WS-FIN-07", "SRV-APP-01", "SRV-FILE-02", "JUMP-PAW01", "DC01"


@pytest.fixture(scope="module")
def ctx(spark):
    return context_from_rows(
        spark,
        hosts=[(DC, 0, True), ("PKI01", 0, True), (PAW, 0, False), (APP, 1, False), (FILE, 1, False), (WS, 2, False), (FIN, 2, False)],
        identities=[(ALICE, 2), (BOB, 1), (ADMIN, 0), (SVC, 1)],
        policy=[("2026-01-01", "2026-12-31")],
        complete_for=[("on_prem", ADMIN, 0)],
        approved_paths=[(ADMIN, PAW, 0)],
        approved_changes=[(BOB, FILE, "2026-06-01", "2026-12-31", None, None), (ALICE, APP, "2019-01-01", "2020-01-01", None, None)],
        known_edges=[*((ALICE, h) for h in (WS, FIN)), *((BOB, h) for h in (WS, APP)), *((ADMIN, h) for h in (WS, PAW, DC, "PKI01", APP, FILE)), *((SVC, h) for h in (APP, FILE))],
    )


def hop(time, source, target, who, states="PA", service="rdp", day="2026-08-10", lid=None, parent=None, transition=None, effective=None):
    h, m, s = ([int(x) for x in time.split(":")] + [0])[:3]
    ts = datetime.fromisoformat(day).replace(tzinfo=timezone.utc) + timedelta(hours=h, minutes=m, seconds=s)
    t = (*transition, "cred") if transition else None
    refs = ("net", "logon", "priv" if "P" in states else None)
    return [ts, time, source, None, target, None, who, effective or who, service, lid, parent, "confirmed" if "P" in states else "absent", "confirmed" if "A" in states else "absent", t, refs]


def edges(spark, hops):
    return spark.createDataFrame([(f"e{i}", i, *h) for i, h in enumerate(hops)], EDGE)


A, B = (WS, APP), (APP, FILE)
SCENARIOS = {
    "01": ([hop("10:00", WS, APP, ADMIN)], [("NONE", (WS, APP), "none")]),
    "02": ([hop("10:00", WS, PAW, ADMIN), hop("10:05", PAW, DC, ADMIN)], [("EXPECTED", (WS, PAW, DC), "none")]),
    "03": ([hop("10:00", WS, APP, ADMIN), hop("10:05", APP, DC, ADMIN)], [("CRITICAL_UNAPPROVED_PATH", (WS, APP, DC), "highest")]),
    "04": ([hop("10:00", WS, FIN, ALICE, "A"), hop("10:03", FIN, APP, ALICE, "A")], [("PIVOT_PROGRESSION", (WS, FIN, APP), "low")]),
    "05": ([hop("10:00", *A, BOB, lid="0xA1"), hop("10:03", *B, ADMIN, service="smb", lid="0xB2", parent="0xA1", transition=(BOB, ADMIN, "confirmed"))], [("CREDENTIAL_TRANSITION_PROGRESSION", (WS, APP, FILE), "high")]),
    "06": ([hop("10:00", *A, BOB), hop("10:02", *B, BOB, "", "smb")], [("INSUFFICIENT_EVIDENCE", (WS, APP, FILE), "low")]),
    "07": ([hop("10:00", *A, BOB), hop("10:03", *B, BOB, "PA", "smb")], [("JUSTIFIED", (WS, APP, FILE), "none")]),
    "09": ([hop("10:00", *A, BOB), hop("10:03", *B, ALICE, "A", "smb")], [("NONE", A, "none"), ("NONE", B, "none")]),
    "10": ([hop("10:00", *A, BOB), hop("11:00", APP, DC, BOB)], [("NONE", A, "none"), ("NONE", (APP, DC), "none")]),
    "11": ([hop("10:00", *A, BOB), hop("10:03", APP, "UNKNOWN-HOST", BOB, "PA", "smb")], [("INSUFFICIENT_CONTEXT", (WS, APP, "UNKNOWN-HOST"), "low")]),
    "12": ([hop("10:00", *A, ALICE, "A"), hop("10:04", *B, ALICE, "A", "smb", transition=(ALICE, ADMIN, "unknown"))], [("INSUFFICIENT_EVIDENCE", (WS, APP, FILE), "low")]),
    "13": ([hop("10:00", WS, FIN, ALICE), hop("10:03", FIN, APP, ALICE, "A")], [("POSSIBLE_PRIVILEGED_PROGRESSION", (WS, FIN, APP), "low")]),
    "14": ([hop("10:00", WS, "UNKNOWN-VIA", BOB), hop("10:03", "UNKNOWN-VIA", FILE, BOB, "PA", "smb")], [("INSUFFICIENT_CONTEXT", (WS, "UNKNOWN-VIA", FILE), "low")]),
    "15": ([hop("10:00", *A, BOB, "P")], [("INSUFFICIENT_EVIDENCE", A, "low")]),
    "16": ([hop("10:00", WS, FIN, ALICE, "A"), hop("10:03", FIN, APP, ALICE, "A"), hop("10:03:30", FIN, APP, ALICE, "A")], [("PIVOT_PROGRESSION", (WS, FIN, APP), "low")]),
    "17": ([hop("10:00", WS, FIN, ALICE, "A"), hop("10:03", FIN, APP, ALICE, "A"), hop("10:00:10", WS, FIN, BOB, "A"), hop("10:03:10", FIN, APP, BOB, "A")], [("PIVOT_PROGRESSION", (WS, FIN, APP), "low")] * 2),
    "18": ([hop("10:00", WS, FIN, ALICE, "A"), hop("10:03", FIN, APP, ALICE)], [("PRIVILEGED_DESTINATION_REACH", (WS, FIN, APP), "medium")]),
    "19": ([hop("10:00", *A, BOB, day="2026-01-01"), hop("10:03", *B, BOB, "PA", "smb", day="2026-01-01")], [("POSSIBLE_PRIVILEGED_PROGRESSION", (WS, APP, FILE), "low")]),
    "20": ([hop("10:00", *A, BOB, "A"), hop("10:05", APP, DC, BOB, "A")], [("INSUFFICIENT_CONTEXT", (WS, APP, DC), "low")]),
    "session": ([hop("10:00", *A, ALICE, lid="0xL1"), hop("10:01", *A, ALICE, lid="0xL2"), hop("10:03", *B, ALICE, "A", "smb", lid="0xL3", parent="0xL1")], [("PRIVILEGED_PROGRESSION", (WS, APP, FILE), "medium"), ("NONE", A, "none")]),
    "claimed": ([hop("10:00", *A, BOB, lid="0xA1"), hop("10:03", *B, BOB, service="smb", lid="0xB2", parent="0xA1", transition=(BOB, ALICE, "confirmed"), effective=ADMIN)], [("CREDENTIAL_TRANSITION_PROGRESSION", (WS, APP, FILE), "high")]),
    "forged": ([hop("10:00", WS, APP, ALICE), hop("10:05", APP, DC, ALICE, effective=ADMIN)], [("INSUFFICIENT_CONTEXT", (WS, APP, DC), "low")]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, ctx, name):
    hops, want = SCENARIOS[name]
    found = policy.classify(edges(spark, hops), ctx).collect()
    assert sorted((f.label, tuple(f.path), f.confidence) for f in found) == sorted(want)
    if name == "16":
        assert found[0].occurrence_count == 2


def test_good_edges_and_findings_break_no_contract(spark, ctx):
    e = edges(spark, SCENARIOS["05"][0])
    assert checks.check_edge_semantics(e).count() == checks.check_pivot_edges(e).count() == 0
    assert checks.check_findings(policy.classify(e, ctx)).count() == 0
    assert checks.check_context(ctx).count() == 0


@pytest.mark.parametrize("minutes,n", [("10:00", 0), ("10:30", 1), ("10:30:01", 0)])
def test_continuation_excludes_equal_times_and_includes_the_far_end(spark, minutes, n):
    e = edges(spark, [hop("10:00", WS, FIN, ALICE), hop(minutes, FIN, APP, ALICE)])
    assert graph.continuation_pairs(graph.sanitize_edges(e)).count() == n


def test_duplicate_edge_ids(spark):
    e = edges(spark, [hop("10:00", *A, BOB)])
    twice = e.union(e)
    assert [tuple(r) for r in graph.duplicate_edge_ids(twice).collect()] == [("e0", 2)]
    with pytest.raises(Exception, match="duplicate edge_id"):
        graph.reject_duplicate_edge_ids(twice).collect()
    assert {r.message for r in checks.check_edge_semantics(twice).collect()} == {"duplicate edge_id"}


def test_context_violations(spark):
    bad = context_from_rows(spark, hosts=[(DC, 0, True)], identities=[(BOB, 1)], policy=[("2026-13-01", "2026-01-01")], complete_for=[("", "x", None)], approved_paths=[(BOB, "gone", 0)], approved_changes=[(BOB, DC, "soon", None, None, None)], known_edges=[("who", DC)])
    got = sorted(r.message for r in checks.check_context(bad).collect())
    assert got == ["approved_changes: approved_from is not an ISO date", "approved_paths: via is not declared", "complete_for: environment is missing", "complete_for: identity is not declared", "complete_for: target_tier is not an integer", "known_edges: identity is not declared", "policy: valid_from is not an ISO date"]


def test_second_hops_are_those_of_the_pairs(spark):
    """Dense hops with sessions, transitions and repeated ids: the second hops of all pairs, found without a join of edges."""
    import random

    from pyspark.sql import functions as F

    base = datetime(2026, 8, 10, tzinfo=timezone.utc)
    rnd = random.Random(6)
    change = lambda: (rnd.choice("ab"), rnd.choice("ab"), rnd.choice(["confirmed", "unknown"]), "r") if rnd.random() < 0.4 else None
    rows = [(f"e{i - i % 9 % 2}", base + timedelta(seconds=rnd.randint(0, 4000)), rnd.choice("xyz"), rnd.choice(["x", "y", None]), rnd.choice(["a", "b", None]), rnd.choice(["s", "t", None]), rnd.choice(["s", "t", "u", None]), change()) for i in range(500)]
    e = spark.createDataFrame(rows, "edge_id string, ts timestamp, source_host string, target_host string, identity string, logon_id string, source_logon_id string, credential_transition struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>")
    e = graph.sanitize_edges(e.withColumns({"privilege_state": F.lit("absent"), "auth_state": F.lit("confirmed")}))
    for minutes in (2, 0.5):
        pairs, second = graph.build_index(e, minutes)
        want = {r.next.edge_id for r in pairs.select("next").collect()}
        assert sorted(r.edge_id for r in second.collect()) == sorted(want) and 5 < len(want) < 450
    assert "Join " not in second._jdf.queryExecution().optimizedPlan().toString()


def test_hops_are_made_once(spark):
    """Lookups ride along with their pair: the only join is the one that makes the pairs."""
    found = queries.QUERIES["classify_hops"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
