"""Edges from evidence: logons joined to flows, privileges and explicit credentials.

Flat inputs:
  flows    seq, ts, src_ip, dst_ip, dst_port, ref
  logons   seq, ts, ts_raw, host_name, host_ips, src_ip, identity, logon_id, logon_type, ref (successful 4624)
  privs    seq, ts, host_ips, identity, logon_id, ref (4672)
  creds    seq, ts, host_ips, subject_identity, target_identity, subject_logon_id, target_server, ref (4648)
  ip_map   ip, host

``seq`` is the input order, which decides where "the first" is meant.  Missing keys match each
other (a missing logon id equals a missing logon id) unless ``strict_keys``.

Every time window is also an equality of time bins, so a hot pair of hosts or a service account
is spread over many tasks.  In a bin, events are swept in order of time; pairs of them are never made,
so the work grows with the events also where they grow denser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import scalars as S

FLOW_WINDOW, PRIVILEGE_WINDOW, CREDENTIAL_WINDOW = 120, 60, 300


def bin_of(ts: Column, seconds: float) -> Column:
    """The number of the time bin, ``seconds`` long, in which a time lies."""
    return F.floor(F.unix_micros(ts) / max(int(seconds * 1_000_000), 1))


def _age(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def _same(a: Column, b: Column, strict: bool) -> Column:
    return a == b if strict else a.eqNullSafe(b)


def host_names(ip_map: DataFrame) -> DataFrame:
    """(ip, host): one host for each address; of a repeated address the first in the map's order (``pos``), else in text order."""
    order = F.struct("pos", "host") if "pos" in ip_map.columns else F.struct("host")
    return ip_map.groupBy("ip").agg(F.min_by("host", order).alias("host"))


def logon_flow_asof(logons: DataFrame, flows: DataFrame, window: float = FLOW_WINDOW, strict_keys: bool = False) -> DataFrame:
    """``logons`` that have a flow, with flow_ref, flow_ts, target_ip and service of the latest compatible one.

    A flow fits if it goes from the logon's address to one of its host's addresses, to the service
    that the logon type names, 0 to ``window`` seconds before.  Flows of other services never hide it.
    """
    w = int(window * 1_000_000)
    service = S.service_of_logon_type(F.col("logon_type"))
    left = logons.select("seq", "ts", "src_ip", F.explode(F.array_distinct("host_ips")).alias("dst_ip"), service.alias("service")).where("service is not null and dst_ip is not null")
    right = flows.select(F.col("seq").alias("flow_seq"), F.col("ts").alias("flow_ts"), "src_ip", "dst_ip", S.service_of_port(F.col("dst_port")).alias("service"), "ref").where("service is not null and dst_ip is not null")
    if strict_keys:
        left, right = left.where("src_ip is not null"), right.where("src_ip is not null")
    flow = F.struct("flow_ts", "flow_seq", F.col("ref").alias("flow_ref"))
    key = ["src_ip", "dst_ip", "service", "bin"]
    b = bin_of(F.col("flow_ts"), window)
    right = right.select("src_ip", "dst_ip", "service", F.explode(F.array(b, b + 1)).alias("bin"), F.col("flow_ts").alias("at"), F.lit(0).alias("kind"), F.col("flow_seq").alias("order"), flow.alias("flow"))
    left = left.select("src_ip", "dst_ip", "service", bin_of(F.col("ts"), window).alias("bin"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("seq").alias("order"), F.lit(None).cast(right.schema["flow"].dataType).alias("flow"))
    order = Window.partitionBy(*key).orderBy("at", "kind", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = left.unionByName(right).withColumn("latest", F.last("flow", ignorenulls=True).over(order))
    latest = latest.where((F.col("kind") == 1) & (_age(F.col("at"), F.col("latest.flow_ts")) <= w))
    best = latest.groupBy(F.col("order").alias("seq")).agg(F.max_by(F.struct("latest.flow_ref", "latest.flow_ts", F.col("dst_ip").alias("target_ip"), "service"), F.struct("latest.flow_ts", "latest.flow_seq")).alias("hit"))
    return logons.join(best, "seq").select(*[F.col(f"`{c}`") for c in logons.columns], "hit.flow_ref", "hit.flow_ts", "hit.target_ip", "hit.service")


def in_window(questions: DataFrame, facts: DataFrame, key: list[str], micros: int, best: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(seq, *best): minima or maxima of the columns of ``facts`` that ``best`` names, over each question's facts; questions without facts are left out.

    ``questions``: key, seq and ``low``; facts count from there to ``low + micros``, both included.  ``facts``: key, at and the columns of ``best``, the first never null.
    Such a window is the end of one time bin and the beginning of the next.  So running minima from either end of
    the bins answer every question: no pairs are made, however many events share a key and a bin.  Either way has its own
    rows, with times negated for the way back, so all is one sort of narrow rows; facts are doubled after the shuffle.
    """
    width = max(micros, 1)
    slot = lambda c: F.floor(F.col(c) / width)
    mark = lambda bin, way, at: F.struct(bin.alias("bin"), F.lit(way).alias("way"), at.alias("at"))
    ends = F.array(mark(slot("low") + 1, 1, F.col("low") + micros), mark(slot("low"), -1, F.col("low")))
    rows = facts.where("at is not null").select(*key, *best, slot("at").alias("bin"), "at")
    rows = rows.unionByName(questions.where("low is not null").select(*key, "seq", F.inline(ends)), allowMissingColumns=True).repartition(*key, "bin")
    ways = F.when(F.col("way").isNull(), F.array(F.lit(1), F.lit(-1))).otherwise(F.array("way"))
    rows = rows.select(*key, "bin", *best, "seq", "at", F.col("way").isNotNull().alias("asks"), F.explode(ways).alias("way")).withColumn("at", F.col("at") * F.col("way"))
    so_far = Window.partitionBy(*key, "bin", "way").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = rows.withColumns({c: of(F.col(c)).over(so_far) for c, of in best.items()}).where("asks")
    return answers.where(F.col(next(iter(best))).isNotNull()).groupBy("seq").agg(*[of(F.col(c)).alias(c) for c, of in best.items()])


def _privileges(logons: DataFrame, privs: DataFrame, window: float, strict_keys: bool) -> DataFrame:
    """(seq, privileged, privilege_ref) of the logons that have a privilege."""
    key = ["ip", "logon_id", "identity"]
    left = logons.select("seq", "logon_id", "identity", F.unix_micros("ts").alias("low"), F.explode(F.array_distinct("host_ips")).alias("ip"))
    right = privs.select("logon_id", "identity", F.unix_micros("ts").alias("at"), F.struct(F.col("seq").alias("p_seq"), F.col("ref").alias("p_ref")).alias("first"), F.explode(F.array_distinct("host_ips")).alias("ip"))
    for c in key if strict_keys else key[:1]:
        left, right = left.where(F.col(c).isNotNull()), right.where(F.col(c).isNotNull())
    found = in_window(left, right, key, int(window * 1_000_000), {"first": F.min})
    return found.select("seq", F.lit(True).alias("privileged"), F.col("first.p_ref").alias("privilege_ref"))


def privilege_match(logons: DataFrame, privs: DataFrame, window: float = PRIVILEGE_WINDOW, strict_keys: bool = False) -> DataFrame:
    """``logons`` with ``privileged``: a special-privilege event of the same session, host and identity came 0 to ``window`` seconds after; and privilege_ref of the first of them.

    The host's addresses are part of the key: sessions that exist on every host (the system's own) and
    missing session ids meet only on one host.
    """
    return logons.join(_privileges(logons, privs, window, strict_keys), "seq", "left").withColumn("privileged", F.coalesce("privileged", F.lit(False)))


def credential_transition_match(logons: DataFrame, creds: DataFrame, ip_map: DataFrame, window: float = CREDENTIAL_WINDOW) -> DataFrame:
    """``logons`` with the explicit-credential use behind them: transition (from_identity, to_identity, state, evidence_ref) and source_logon_id.

    A use fits if it was on the source host, names the logon's identity and its target host, has a
    session, and came 0 to ``window`` seconds before.  One session: confirmed by its earliest event.
    Several: ``unknown``, without lineage.  None: null.  A use is listed under each name of its server, a logon under
    each of its target (``scalars.host_equivalent`` in the form of equal keys).
    """
    micros = int(window * 1_000_000)
    names, key = host_names(ip_map), ["ip", "identity", "name"]
    right = creds.where("coalesce(subject_logon_id, '') != '' and coalesce(target_server, '') != ''")
    right = right.join(names.select(F.col("ip").alias("server_ip"), F.col("host").alias("server_mapped")), F.trim("target_server") == F.col("server_ip"), "left")
    first = F.struct(F.col("ts").alias("c_ts"), F.col("seq").alias("c_seq"), "subject_identity", F.col("ref").alias("c_ref"))
    right = right.select(F.unix_micros("ts").alias("at"), first.alias("first"), F.col("subject_logon_id").alias("one"), F.col("subject_logon_id").alias("last"), F.col("target_identity").alias("identity"), F.explode(F.array_distinct("host_ips")).alias("ip"), S.host_keys(F.trim("target_server"), F.col("server_mapped"), F.trim("target_server")).alias("names"))
    left = logons.join(names.select(F.col("ip").alias("t_ip"), F.col("host").alias("target_mapped")), F.col("target_ip") == F.col("t_ip"), "left")
    left = left.select("seq", (F.unix_micros("ts") - micros).alias("low"), "identity", F.col("src_ip").alias("ip"), F.explode(S.host_keys(F.col("host_name"), F.col("target_mapped"), F.col("target_ip"))).alias("name")).where("ip is not null")
    right = right.where("ip is not null").select("at", "first", "one", "last", "identity", "ip", F.explode("names").alias("name"))
    found = in_window(left, right, key, micros, {"first": F.min, "one": F.min, "last": F.max}).withColumn("single", F.col("one") == F.col("last"))
    joined = logons.join(found, "seq", "left")
    transition = F.when(F.col("single").isNotNull(), F.struct(F.col("first.subject_identity").alias("from_identity"), F.col("identity").alias("to_identity"), F.when(F.col("single"), "confirmed").otherwise("unknown").alias("state"), F.col("first.c_ref").alias("evidence_ref")))
    return joined.withColumns({"credential_transition": transition, "source_logon_id": F.when(F.col("single"), F.col("one"))}).drop("one", "last", "single", "first")


def assemble_edges(found: DataFrame, ip_map: DataFrame) -> DataFrame:
    """Edges in their contract's form; of equal edge ids the first in input order stays."""
    names = host_names(ip_map).select(F.col("ip").alias("src_ip"), F.col("host").alias("mapped"))
    edge = S.edge_id(F.col("host_name"), F.col("identity"), F.col("logon_id"), F.col("ts_raw"), F.col("src_ip"))
    ranked = found.join(names, "src_ip", "left").withColumn("edge_id", edge)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("edge_id").orderBy("seq"))).where("rank = 1")
    return edge_columns(ranked)


def edge_columns(found: DataFrame) -> DataFrame:
    """Edges in their contract's form from logons with all that was found for them; ``mapped`` is the map's host of the source address."""
    return found.select(
        "edge_id",
        "seq",
        "ts",
        "ts_raw",
        F.coalesce("mapped", "src_ip").alias("source_host"),
        F.col("src_ip").alias("source_ip"),
        F.col("host_name").alias("target_host"),
        "target_ip",
        "identity",
        F.col("identity").alias("effective_identity"),
        "service",
        "logon_id",
        "source_logon_id",
        F.when(F.col("privileged"), "confirmed").otherwise("absent").alias("privilege_state"),
        F.lit("confirmed").alias("auth_state"),
        "credential_transition",
        F.struct(F.col("flow_ref").alias("network"), F.col("ref").alias("logon"), F.col("privilege_ref").alias("privilege")).alias("evidence_refs"),
    )


def materialize_edges(flows: DataFrame, logons: DataFrame, privs: DataFrame, creds: DataFrame, ip_map: DataFrame, flow_window: float = FLOW_WINDOW, privilege_window: float = PRIVILEGE_WINDOW, credential_window: float = CREDENTIAL_WINDOW, strict_keys: bool = False) -> DataFrame:
    """All four steps: nearest flow, privilege, credential transition, edge."""
    found = logon_flow_asof(logons, flows, flow_window, strict_keys)
    found = privilege_match(found, privs, privilege_window, strict_keys)
    found = credential_transition_match(found, creds, ip_map, credential_window)
    return assemble_edges(found, ip_map)
