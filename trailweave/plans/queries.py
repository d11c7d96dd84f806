"""The registered queries of the evidence operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import scalars as S
from trailweave.operators import checks, detections, edges, flows, graph, hybrid, policy, progression, windows
from trailweave.sources import context as contexts
from trailweave.sources import loaders, publish, records, scratch
from trailweave.streaming import detect, run, schedule

from . import case as cases
from .evidence import WINDOW, Evidence, context, read

#: UTC ISO-8601 of ``us`` in SQL.
_ISO = "(strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') END || 'Z')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_W = WINDOW * 1_000_000

BASE = r"""
WITH RECURSIVE e AS (
  SELECT event_id AS seq, epoch_us(ts) AS us, ts, user_id AS u, event_type, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events),
p AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 3389 WHEN 1 THEN 445 ELSE 443 END AS port, CASE k % 3 WHEN 0 THEN 'rdp' WHEN 1 THEN 'smb' END AS port_service,
    CASE k % 3 WHEN 0 THEN 'rdp' WHEN 1 THEN 'smb' ELSE 'https' END AS protocol,
    '10.0.0.' || (k % 5) AS host_ip, '10.0.0.' || (u % 5) AS from_ip, 'CORP\u' || (u % 20) AS identity, '0x' || (u % 20) AS session,
    CASE k % 2 WHEN 0 THEN '10' ELSE '3' END AS logon_type, CASE k % 2 WHEN 0 THEN 'rdp' ELSE 'smb' END AS logon_service, 'e' || seq AS ref
  FROM e),
flows AS (SELECT seq, us, from_ip AS src_ip, host_ip AS dst_ip, port, port_service AS service, ref FROM p WHERE event_type = 'view'),
logons AS (SELECT seq, us, ts, 't' || seq AS ts_raw, 'H' || (k % 5) AS host_name, host_ip, from_ip AS src_ip, identity, session AS logon_id, logon_service AS service, ref FROM p WHERE event_type = 'click'),
privs AS (SELECT seq, us, host_ip, identity, session AS logon_id, ref FROM p WHERE event_type = 'signup'),
creds AS (SELECT seq, us, host_ip, 'CORP\u' || ((u + 1) % 20) AS subject_identity, identity AS target_identity, '0x' || (u % 40) AS slid, 'H' || (u % 5) AS server, ref FROM p WHERE event_type = 'error')"""

_JOINS = rf""",
j1 AS (
  SELECT * FROM (
    SELECT l.*, f.ref AS flow_ref, f.dst_ip AS target_ip, row_number() OVER (PARTITION BY l.seq ORDER BY f.us DESC, f.seq DESC) AS rn
    FROM logons l JOIN flows f ON f.src_ip = l.src_ip AND f.dst_ip = l.host_ip AND f.service = l.service AND l.us - f.us BETWEEN 0 AND {_W}) WHERE rn = 1),
j2 AS (
  SELECT j1.seq, arg_min(q.ref, q.seq) AS privilege_ref
  FROM j1 JOIN privs q ON q.logon_id = j1.logon_id AND q.identity = j1.identity AND q.host_ip = j1.host_ip AND q.us - j1.us BETWEEN 0 AND {_W} GROUP BY j1.seq),
j3 AS (
  SELECT j1.seq, count(DISTINCT c.slid) AS sessions, min(c.slid) AS slid, arg_min(c.subject_identity, (c.us, c.seq)) AS from_identity, arg_min(c.ref, (c.us, c.seq)) AS cred_ref
  FROM j1 JOIN creds c ON c.host_ip = j1.src_ip AND c.target_identity = j1.identity AND c.server = j1.host_name AND j1.us - c.us BETWEEN 0 AND {_W} GROUP BY j1.seq),
edges AS (
  SELECT substr(sha256(host_name || '|' || identity || '|' || logon_id || '|' || ts_raw || '|' || src_ip), 1, 16) AS edge_id, j1.seq, j1.us, j1.ts,
    'H' || substr(src_ip, 8) AS source_host, src_ip AS source_ip, host_name AS target_host, target_ip, identity, service, logon_id,
    CASE WHEN sessions = 1 THEN slid END AS source_logon_id, CASE WHEN privilege_ref IS NULL THEN 'absent' ELSE 'confirmed' END AS privilege_state,
    CASE WHEN sessions = 1 THEN 'confirmed' WHEN sessions > 1 THEN 'unknown' END AS transition_state, from_identity, cred_ref, flow_ref, ref AS logon_ref, privilege_ref
  FROM j1 LEFT JOIN j2 USING (seq) LEFT JOIN j3 USING (seq))"""

JOINED = BASE + _JOINS

_PAIRS = """,
pairs AS (
  SELECT a.edge_id AS first_id, b.edge_id AS next_id, a.us AS first_us, b.us AS next_us, a.source_host AS h1, a.target_host AS h2, b.target_host AS h3, b.ts AS next_ts, b.service,
    a.identity AS first_identity, b.identity AS who, a.privilege_state AS first_priv, b.privilege_state AS next_priv, b.transition_state,
    coalesce(b.transition_state = 'confirmed' AND b.from_identity = a.identity, false) AS linked,
    CASE WHEN b.source_logon_id IS NULL THEN 'identity' WHEN a.logon_id = b.source_logon_id THEN 'session-exact' ELSE 'mismatch' END AS lineage
  FROM edges a JOIN edges b ON b.source_host = a.target_host AND (b.identity = a.identity OR (b.transition_state = 'confirmed' AND b.from_identity = a.identity))
    AND b.us > a.us AND b.us - a.us <= 43200000000 AND a.edge_id <> b.edge_id
  WHERE CASE WHEN b.source_logon_id IS NULL THEN 'identity' WHEN a.logon_id = b.source_logon_id THEN 'session-exact' ELSE 'mismatch' END <> 'mismatch')"""

PAIRED = JOINED + _PAIRS

CONTEXT = r"""
hosts(host, tier, critical) AS (VALUES ('H0', 0, true), ('H1', 0, false), ('H2', 1, false), ('H3', 2, false)),
ids AS (SELECT 'CORP\u' || i AS identity, i FROM range(18) t(i))"""

_CONFIDENCE = "CASE label " + " ".join(f"WHEN '{label}' THEN '{c}'" for label, c in policy.CONFIDENCE.items()) + " END"
_LIST = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{0}], lambda x: x IS NOT NULL))), ','), '')"
_FINDINGS = "," + CONTEXT + rf""",
seen AS (
  SELECT p.*, coalesce(s.tier, 99) AS src_tier, d.tier AS dst_tier, coalesce(d.critical, false) AS critical, (i.i IS NULL OR 'H' || (i.i % 4) <> p.h3) AS novel,
    (a.host IS NULL OR s.host IS NULL OR d.host IS NULL OR i.i IS NULL OR f.i IS NULL) AS undeclared, i.i,
    {_LIST.format("CASE WHEN a.host IS NULL THEN h1 END, CASE WHEN s.host IS NULL THEN h2 END, CASE WHEN d.host IS NULL THEN h3 END")} AS undeclared_hosts,
    {_LIST.format("CASE WHEN i.i IS NULL THEN who END, CASE WHEN f.i IS NULL THEN first_effective END, CASE WHEN o.i IS NULL THEN first_identity END")} AS undeclared_identities,
    CASE WHEN NOT (CAST(next_ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20') OR d.tier IS NULL THEN 'UNKNOWN_CONTEXT'
      WHEN i.i < 5 AND p.h2 = 'H1' AND d.tier = 0 THEN 'AUTHORIZED' WHEN i.i < 10 AND d.tier = 0 THEN 'PROHIBITED' ELSE 'UNKNOWN_CONTEXT' END AS route,
    coalesce((i.i = 6 AND p.h3 = 'H2' AND CAST(next_ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-15') OR (i.i = 7 AND p.h3 = 'H2' AND p.h2 = 'H3') OR (i.i = 8 AND p.h3 = 'H3' AND p.service = 'smb'), false) AS approved
  FROM (SELECT *, first_identity AS first_effective FROM pairs) p LEFT JOIN hosts a ON a.host = p.h1 LEFT JOIN hosts s ON s.host = p.h2 LEFT JOIN hosts d ON d.host = p.h3
    LEFT JOIN ids i ON i.identity = p.who LEFT JOIN ids f ON f.identity = p.first_effective LEFT JOIN ids o ON o.identity = p.first_identity),
hops AS (
  SELECT *, CASE
      WHEN transition_state IS NOT NULL AND NOT linked THEN 'INSUFFICIENT_EVIDENCE' WHEN undeclared THEN 'INSUFFICIENT_CONTEXT'
      WHEN dst_tier = 0 AND critical AND route = 'AUTHORIZED' THEN 'EXPECTED' WHEN dst_tier = 0 AND critical AND route = 'PROHIBITED' THEN 'CRITICAL_UNAPPROVED_PATH'
      WHEN dst_tier = 0 AND critical THEN 'INSUFFICIENT_CONTEXT' WHEN approved THEN 'JUSTIFIED' WHEN route = 'AUTHORIZED' THEN 'EXPECTED'
      WHEN linked THEN 'CREDENTIAL_TRANSITION_PROGRESSION' WHEN first_priv = 'confirmed' AND lineage = 'session-exact' THEN 'PRIVILEGED_PROGRESSION'
      WHEN first_priv = 'confirmed' THEN 'POSSIBLE_PRIVILEGED_PROGRESSION' WHEN next_priv = 'confirmed' THEN 'PRIVILEGED_DESTINATION_REACH' ELSE 'PIVOT_PROGRESSION' END AS label,
    CASE WHEN first_priv = 'confirmed' AND next_priv = 'confirmed' THEN 'both' WHEN first_priv = 'confirmed' THEN 'source' WHEN next_priv = 'confirmed' THEN 'destination' ELSE 'none' END AS privilege_scope,
    CASE WHEN NOT (transition_state IS NOT NULL AND NOT linked) AND NOT undeclared THEN route END AS route_state
  FROM seen WHERE novel OR (src_tier <> 99 AND dst_tier < src_tier) OR transition_state IS NOT NULL OR critical),
findings AS (
  SELECT label, path, identity, f.edges AS edges, f.scope AS privilege_scope, f.lineage AS session_lineage, f.route AS route_state, f.tier AS entitlement, occurrence_count, {_CONFIDENCE} AS confidence FROM (
    SELECT label, h1 || '>' || h2 || '>' || h3 AS path, who AS identity, count(*) AS occurrence_count,
      arg_min({{'edges': first_id || ',' || next_id, 'scope': privilege_scope, 'lineage': lineage, 'route': route_state, 'tier': CAST(i % 3 AS INT)}}, (first_us, first_id, next_us, next_id)) AS f FROM hops GROUP BY ALL
    UNION ALL
    SELECT 'NONE', source_host || '>' || target_host, identity, count(*), arg_min({{'edges': edge_id, 'scope': NULL::VARCHAR, 'lineage': NULL::VARCHAR, 'route': NULL::VARCHAR, 'tier': NULL::INT}}, (us, edge_id))
    FROM edges WHERE edge_id NOT IN (SELECT first_id FROM hops) AND edge_id NOT IN (SELECT next_id FROM pairs) GROUP BY ALL))"""
CLASSIFIED = PAIRED + _FINDINGS


def query(sql: str | None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(ev: Evidence) -> DataFrame:
    return edges.materialize_edges(ev.flows, ev.logons, ev.privs, ev.creds, ev.ip_map, WINDOW, WINDOW, WINDOW)


def _kept_edges(ev: Evidence) -> DataFrame:
    """Edges for queries that use them more than once, written and read back."""
    return scratch.table(_edges(ev), "edges")


_MINUTES = WINDOW / 60


@query(BASE + "SELECT src_ip, dst_ip, distinct_ports FROM (SELECT '10.1.0.' || (u % 5) AS src_ip, '10.2.0.' || (u % 7) AS dst_ip, count(DISTINCT 1024 + k) AS distinct_ports FROM e WHERE event_type = 'view' GROUP BY 1, 2) WHERE distinct_ports >= 15")
def port_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events.where("event_type = 'view'")
    return detections.port_fan_out(e.select(F.concat(F.lit("10.1.0."), F.col("u") % 5).alias("src_ip"), F.concat(F.lit("10.2.0."), F.col("u") % 7).alias("dst_ip"), (F.col("k") + 1024).alias("dst_port"), F.lit("tcp").alias("transport")))


@query(BASE + "SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_us, '10.0.0.' || (u % 5) AS src_ip, host_ip AS dst_ip, count(DISTINCT 1024 + k) AS distinct_ports FROM p WHERE event_type = 'view' GROUP BY 1, 2, 3 HAVING count(DISTINCT 1024 + k) >= 2")
def port_fan_out_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events.where("event_type = 'view'")
    found = detections.port_fan_out_windowed(e.select("ts", F.concat(F.lit("10.0.0."), F.col("u") % 5).alias("src_ip"), F.concat(F.lit("10.0.0."), F.col("k") % 5).alias("dst_ip"), (F.col("k") + 1024).alias("dst_port"), F.lit("tcp").alias("transport")), 2, "1 day")
    return found.select(F.unix_micros("window_start").alias("window_us"), "src_ip", "dst_ip", F.col("distinct_ports").cast("long").alias("distinct_ports"))


@query("SELECT l_suppkey AS src_ip, l_linenumber AS dst_ip, count(DISTINCT l_partkey) AS distinct_ports FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 15")
def fan_out_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_ip"), F.col("l_linenumber").alias("dst_ip"), F.col("l_partkey").alias("dst_port"), F.lit("tcp").alias("transport"))
    return detections.port_fan_out(x)


_SCALARS = BASE + r"""
SELECT seq, host_ip AS ip, 'h' || (k % 5) || '.corp.example,h' || (k % 5) AS aliases,
  CASE u % 4 WHEN 0 THEN 'D\a' WHEN 1 THEN 'CORP\u' || u WHEN 2 THEN 'u' || u ELSE '' END AS identity,
  CASE WHEN port_service = logon_service THEN port_service END AS service, protocol,
  substr(sha256('H' || (k % 5) || '|' || identity || '|None|t' || seq || '|' || from_ip), 1, 16) AS edge_id, 'role' || k AS role FROM p"""


@query(_SCALARS)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events
    k, u = F.col("k"), F.col("u")
    host = F.concat(F.lit("H"), k % 5)
    user = F.when(u % 4 == 0, "D\\a").when(u % 4 == 3, "").otherwise(F.concat(F.lit("u"), u))
    domain = F.when(u % 4 != 2, "CORP")
    port = F.when(k % 3 == 0, 3389).when(k % 3 == 1, 445).otherwise(443)
    logon_type = F.when(k % 2 == 0, "10").otherwise("3")
    return e.select(
        "seq",
        S.canonical_ip(F.concat(F.lit(" ::ffff:10.0.0."), k % 5)).alias("ip"),
        F.array_join(S.host_aliases(F.concat(host, F.lit(".Corp.example. "))), ",").alias("aliases"),
        S.norm_identity(user, domain).alias("identity"),
        S.service_of(port, logon_type).alias("service"),
        S.protocol_of(port).alias("protocol"),
        S.edge_id(host, F.concat(F.lit("CORP\\u"), u % 20), F.lit(None).cast("string"), F.concat(F.lit("t"), "seq"), F.concat(F.lit("10.0.0."), u % 5)).alias("edge_id"),
        S.role_short_name(F.concat(F.lit("arn:aws:iam::1:role/x/role"), k)).alias("role"),
    )


_ADDRESSES = BASE + r""", x AS (SELECT seq, u, k, lower(printf('%x', k + 1)) AS h FROM e)
SELECT seq, CASE k % 8 WHEN 0 THEN '2001:db8::' || h WHEN 1 THEN '1:0:0:2::' || h WHEN 2 THEN 'host ' || u WHEN 3 THEN '::ffff:999.1.1.' || u WHEN 4 THEN '10.0.' || (k // 256) || '.' || (k % 256)
  WHEN 5 THEN 'fe80::' || h || '%eth0' WHEN 6 THEN '-' END AS ip FROM x"""


@query(_ADDRESSES)
def canonical_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("k"), F.col("u")
    digits = F.lower(F.hex("k"))
    forms = [
        F.concat(F.lit("2001:DB8:0:0:0::"), F.lpad(F.lower(F.hex(k + 1)), 4, "0")),
        F.concat(F.lit("1:0:0:2:0:0:0:"), F.upper(F.hex(k + 1))),
        F.concat(F.lit(" host "), u, F.lit("\t")),
        F.concat(F.lit(" ::ffff:999.1.1."), u),
        F.concat(F.lit("::FFFF:0a00:"), digits),
        F.concat(F.lit("FE80:0::"), F.lower(F.hex(k + 1)), F.lit("%eth0")),
        F.lit("-"),
    ]
    text = F.coalesce(*[F.when(k % 8 == i, form) for i, form in enumerate(forms)])
    return Evidence(spark, sf_dir).events.select("seq", S.canonical_ip(text).alias("ip"))


_DOCUMENTS = BASE + rf"""
SELECT seq, us + CASE WHEN k % 3 = 1 THEN -7200000000 ELSE 0 END AS ts_us, CASE WHEN k % 5 <> 0 THEN CAST(4600 + k % 9 AS VARCHAR) ELSE 'w' || (k % 7) END AS code,
  k % 4 <> 3 AS network, CASE k % 3 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.1,10.0.0.2' ELSE '' END AS ips,
  CASE WHEN k % 2 = 0 THEN 'e' || seq ELSE 'raw-' || substr(sha256('{{"a":' || u || ',"b":"' || k || '"}}'), 1, 16) END AS ref, sha256('{{"a":' || u || ',"b":"' || k || '"}}') AS hash
FROM e"""


@query(_DOCUMENTS)
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that may be one value or many, numbers or text, of documents written from events."""
    k, u = F.col("k"), F.col("u")
    zone = F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise("")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    code = F.when(k % 5 != 0, F.concat(F.lit('"event":{"code":'), F.when(k % 2 == 0, (4600 + k % 9).cast("string")).otherwise(quote((4600 + k % 9).cast("string"))), F.lit(',"category":'))).otherwise(F.lit('"event":{"category":'))
    category = F.when(k % 4 == 0, '"network"').when(k % 4 == 1, '["host","network"]').when(k % 4 == 2, '["network"]').otherwise('"process"')
    ips = F.when(k % 3 == 0, '"10.0.0.1"').when(k % 3 == 1, '["10.0.0.1","10.0.0.2","10.0.0.1"]').otherwise('[]')
    text = F.concat(F.lit("{"), code, category, F.lit('},"winlog":{"event_id":"w'), k % 7, F.lit('"},"host":{"ip":'), ips, F.lit("}}"))
    raw = F.concat(F.lit('{ "b": "'), k, F.lit('",  "a": '), u, F.lit("}"))
    d = Evidence(spark, sf_dir).events.select("seq", "k", stamp.alias("stamp"), F.parse_json(text).alias("v"), raw.alias("raw"))
    event_id = F.when(F.col("k") % 2 == 0, F.concat(F.lit("e"), "seq"))
    return d.select(
        "seq", F.unix_micros(S.utc_ts(F.col("stamp"))).alias("ts_us"), S.event_code(F.col("v")).alias("code"), S.is_network(S.categories(F.col("v"))).alias("network"),
        F.array_join(S.host_ips(F.col("v")), ",").alias("ips"), S.evidence_ref(event_id, F.col("raw")).alias("ref"), S.canonical_hash(F.col("raw")).alias("hash"),
    )


@query(BASE + "SELECT seq FROM e WHERE event_type = 'click' AND k % 2 = 0 AND u % 3 = 0 AND u % 5 NOT IN (1, 2, 3)")
def rc4_tgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events
    u = F.col("u")
    user = F.when(u % 5 == 1, F.concat(F.lit("host"), u, F.lit("$"))).when(u % 5 == 2, "krbtgt").when(u % 5 != 3, F.concat(F.lit("u"), u))
    t = e.select("seq", F.when(F.col("event_type") == "click", "4768").alias("code"), F.when(F.col("k") % 2 == 0, "success").otherwise("failure").alias("outcome"), F.when(u % 3 == 0, "0x17").otherwise("0x12").alias("ticket_encryption"), user.alias("target_user"))
    return detections.rc4_tgt(t).select("seq")


_COMMANDS = BASE + r""", c AS (SELECT seq, 'PowerShell.exe -NoP ' || CASE k % 4 WHEN 0 THEN '-eNc ' WHEN 1 THEN '-EC ' WHEN 2 THEN '-executionpolicy ' ELSE '-e ' END || repeat('aB3', k % 12) AS cmd FROM e WHERE event_type = 'purchase')
SELECT 'd' || seq AS _id, cmd AS command_line FROM c
WHERE regexp_matches(lower(cmd), '^.* -(e(n(c(o(d(e(d(c(o(m(m(a(n(d)?)?)?)?)?)?)?)?)?)?)?)?)?|ec) +[a-z0-9+/=]{20,}.*$')"""


@query(_COMMANDS)
def encoded_powershell(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events
    flag = F.when(F.col("k") % 4 == 0, "-eNc ").when(F.col("k") % 4 == 1, "-EC ").when(F.col("k") % 4 == 2, "-executionpolicy ").otherwise("-e ")
    cmd = F.concat(F.lit("PowerShell.exe -NoP "), flag, F.expr("repeat('aB3', k % 12)"))
    p = e.select(F.concat(F.lit("d"), "seq").alias("_id"), "ts", F.when(F.col("event_type") == "purchase", "process").alias("category"), F.lit("start").alias("type"), F.lit("PowerShell.exe").alias("process_name"), cmd.alias("command_line"), *[F.lit("x").alias(c) for c in ("host_name", "user_name", "parent_name")])
    return detections.encoded_powershell(p).select("_id", "command_line")


@query(BASE + "SELECT k % 5 AS host, count(DISTINCT u % 20) AS n FROM e WHERE event_type = 'click' AND u % 20 NOT IN (1, 2) GROUP BY 1")
def allowlist_and_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Evidence(spark, sf_dir).events.where("event_type = 'click'").select((F.col("k") % 5).alias("host"), (F.col("u") % 20).alias("who"))
    a = detections.allowlist_filter(a, spark.createDataFrame([(1,), (2,)], "who long"), ["who"])
    return detections.dedupe_alerts(a.withColumn("_id", F.concat_ws("-", "host", "who"))).groupBy("host").agg(F.count("*").alias("n"))


def _sequence_sql(stages: list[tuple[str, str]], span: int) -> str:
    """Stages as (condition, key) on ``p``; the lag form in SQL."""
    parts = " UNION ALL ".join(f"SELECT {k} AS stage, {key} AS key, us, seq, us AS begun, CAST(seq AS VARCHAR) AS seqs FROM p WHERE {where}" for k, (where, key) in enumerate(stages))
    sql = BASE + f", s0 AS ({parts})"
    for k in range(1, len(stages)):
        sql += f""", l{k} AS (SELECT *, lag(stage) OVER w AS ps, lag(begun) OVER w AS pb, lag(seqs) OVER w AS pq FROM s{k - 1} WINDOW w AS (PARTITION BY key, stage <= {k} ORDER BY us, seq, stage)),
s{k} AS (SELECT stage, key, us, seq, CASE WHEN stage = {k} THEN pb ELSE begun END AS begun, CASE WHEN stage = {k} THEN pq || ',' || seqs ELSE seqs END AS seqs
  FROM l{k} WHERE stage > {k} OR (stage = {k} AND ps = {k - 1} AND us - pb <= {span * 1_000_000}))"""
    return sql + f" SELECT key, seqs FROM s{len(stages) - 1}"


_FLOW = ("event_type = 'view' AND port IN (3389, 445)", "host_ip")
_LOGON = ("event_type = 'click'", "host_ip")


def _seqs(found: DataFrame, n: int, key: str) -> DataFrame:
    return found.select(F.col(f"stage{n}.{key}").alias("key"), F.concat_ws(",", *[F.col(f"stage{k + 1}.seq").cast("string") for k in range(n)]).alias("seqs"))


@query(_sequence_sql([("event_type = 'click' AND logon_type = '10'", "'H' || (k % 5) || identity"), ("event_type = 'purchase'", "'H' || (k % 5) || identity")], WINDOW))
def rdp_logon_then_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detections.rdp_logon_then_process(Evidence(spark, sf_dir).sequence_events, WINDOW)
    return found.select(F.concat("stage1.computer_name", "stage1.target_user").alias("key"), F.concat_ws(",", F.col("stage1.seq").cast("string"), F.col("stage2.seq").cast("string")).alias("seqs"))


@query(_sequence_sql([_FLOW, _LOGON, ("event_type = 'purchase'", "host_ip")], WINDOW))
def authenticated_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seqs(detections.authenticated_pivot(Evidence(spark, sf_dir).sequence_events, WINDOW), 3, "host_ip")


@query(_sequence_sql([_FLOW, _LOGON, ("event_type = 'signup'", "host_ip")], WINDOW))
def privileged_edge_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seqs(detections.privileged_edge_candidate(Evidence(spark, sf_dir).sequence_events, WINDOW), 3, "host_ip")


_FOLD = BASE + r""",
pk AS (
  SELECT seq, us, struct_pack(ip := from_ip, port := CAST(1000 + u % 7 AS INT)) AS s, struct_pack(ip := host_ip, port := CAST(port AS INT)) AS d, CASE WHEN k % 11 = 0 THEN 'udp' ELSE 'tcp' END AS transport,
    CASE WHEN event_type = 'signup' THEN 'S' WHEN event_type = 'purchase' THEN 'SA' WHEN k % 11 <> 0 THEN 'A' END AS flags, 60 + k AS size FROM p),
ky AS (SELECT *, least(s, d) AS low, greatest(s, d) AS high, s <= d AS up FROM pk),
g AS (
  SELECT low, high, transport, count(*) AS packets, sum(size) AS bytes, sum(CASE WHEN up THEN 1 ELSE 0 END) AS up_packets, sum(CASE WHEN up THEN size ELSE 0 END) AS up_bytes, max(us) - min(us) AS us,
    coalesce(arg_min(CASE WHEN flags = 'S' THEN up ELSE NOT up END, seq) FILTER (WHERE flags LIKE '%S%'), arg_min(up, seq)) AS low_first
  FROM ky GROUP BY low, high, transport)
SELECT CASE WHEN low_first THEN low.ip ELSE high.ip END AS src_ip, CASE WHEN low_first THEN low.port ELSE high.port END AS src_port, CASE WHEN low_first THEN high.ip ELSE low.ip END AS dst_ip,
  CASE WHEN low_first THEN high.port ELSE low.port END AS dst_port, transport, us * 1000 AS duration_ns, CASE WHEN low_first THEN up_packets ELSE packets - up_packets END AS client_packets,
  CASE WHEN low_first THEN up_bytes ELSE bytes - up_bytes END AS client_bytes, packets, bytes FROM g"""


@query(_FOLD)
def fold_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = flows.flow_events(flows.fold_flows(Evidence(spark, sf_dir).packets))
    return made.select("src_ip", "src_port", "dst_ip", "dst_port", "transport", "duration_ns", "client_packets", "client_bytes", "packets", "bytes")


@query(JOINED + "SELECT seq, flow_ref, target_ip, service FROM j1")
def logon_flow_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Evidence(spark, sf_dir)
    return edges.logon_flow_asof(ev.logons, ev.flows, WINDOW).select("seq", "flow_ref", "target_ip", "service")


@query(BASE + f"SELECT l.seq, arg_min(q.ref, q.seq) AS privilege_ref FROM logons l LEFT JOIN privs q ON q.logon_id = l.logon_id AND q.identity = l.identity AND q.host_ip = l.host_ip AND q.us - l.us BETWEEN 0 AND {_W} GROUP BY l.seq")
def privilege_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Evidence(spark, sf_dir)
    return edges.privilege_match(ev.logons, ev.privs, WINDOW).select("seq", "privilege_ref")


@query(JOINED + "SELECT j1.seq, CASE WHEN sessions = 1 THEN 'confirmed' ELSE 'unknown' END AS state, from_identity, cred_ref AS evidence_ref, CASE WHEN sessions = 1 THEN slid END AS source_logon_id FROM j1 JOIN j3 USING (seq)")
def credential_transition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Evidence(spark, sf_dir)
    found = edges.logon_flow_asof(ev.logons, ev.flows, WINDOW)
    found = edges.credential_transition_match(found, ev.creds, ev.ip_map, WINDOW).where("credential_transition is not null")
    return found.select("seq", "credential_transition.state", "credential_transition.from_identity", "credential_transition.evidence_ref", "source_logon_id")


_EDGE_COLUMNS = "edge_id, source_host, source_ip, target_host, target_ip, identity, service, logon_id, source_logon_id, privilege_state, transition_state, from_identity, cred_ref, flow_ref, logon_ref, privilege_ref"


@query(JOINED + f"SELECT {_EDGE_COLUMNS} FROM edges")
def materialize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_edges(_edges(Evidence(spark, sf_dir)))


def _flat_edges(made: DataFrame) -> DataFrame:
    return made.select(
        "edge_id", "source_host", "source_ip", "target_host", "target_ip", "identity", "service", "logon_id", "source_logon_id", "privilege_state", F.col("credential_transition.state").alias("transition_state"),
        "credential_transition.from_identity", F.col("credential_transition.evidence_ref").alias("cred_ref"), F.col("evidence_refs.network").alias("flow_ref"), F.col("evidence_refs.logon").alias("logon_ref"), F.col("evidence_refs.privilege").alias("privilege_ref"),
    )


@query(PAIRED + "SELECT first_id, next_id, lineage, linked FROM pairs")
def continuation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.continuation_pairs(graph.sanitize_edges(_kept_edges(Evidence(spark, sf_dir))), _MINUTES)
    return found.select(F.col("first.edge_id").alias("first_id"), F.col("next.edge_id").alias("next_id"), "lineage", graph.transition_links().alias("linked"))


@query("""
SELECT a.o_orderkey AS first_id, b.o_orderkey AS next_id FROM orders a JOIN orders b
ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) > CAST(a.o_orderdate AS DATE) AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + INTERVAL 30 DAY""")
def continuation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    who = F.col("o_custkey").cast("string")
    nothing = F.lit(None).cast("struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>")
    e = o.select(F.col("o_orderkey").alias("edge_id"), F.to_date("o_orderdate").cast("timestamp").alias("ts"), F.lit("a").alias("source_host"), F.lit("a").alias("target_host"), who.alias("identity"), who.alias("effective_identity"), F.lit(None).cast("string").alias("logon_id"), F.lit(None).cast("string").alias("source_logon_id"), nothing.alias("credential_transition"))
    return graph.continuation_pairs(e, 30 * 24 * 60).select(F.col("first.edge_id").alias("first_id"), F.col("next.edge_id").alias("next_id"))


@query(PAIRED + "SELECT h.edge_id, d.edge_id IS NOT NULL AS second_hop FROM edges h LEFT JOIN (SELECT DISTINCT next_id AS edge_id FROM pairs) d USING (edge_id)")
def second_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kept_edges(Evidence(spark, sf_dir))
    _, second = graph.build_index(graph.sanitize_edges(e), _MINUTES)
    return e.select("edge_id").join(second.withColumn("hop", F.lit(True)), "edge_id", "left").select("edge_id", F.coalesce("hop", F.lit(False)).alias("second_hop"))


_FINDING_COLUMNS = "label, confidence, path, identity, edges, privilege_scope, session_lineage, route_state, entitlement, occurrence_count"


def _flat_findings(found: DataFrame) -> DataFrame:
    m = F.col("modifiers")
    return found.select(
        "label", "confidence", F.array_join("path", ">").alias("path"), "identity", F.array_join("edges", ",").alias("edges"), m["privilege_scope"].alias("privilege_scope"),
        m["session_lineage"].alias("session_lineage"), m["route_policy_state"].alias("route_state"), m["identity_tier_entitlement"].alias("entitlement"), "occurrence_count",
    )


@query(CLASSIFIED + f"SELECT {_FINDING_COLUMNS} FROM findings")
def classify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_findings(policy.classify(_kept_edges(Evidence(spark, sf_dir)), context(spark), _MINUTES))


@query(CLASSIFIED + """SELECT first_id, next_id, label, route, novel, approved, nullif(src_tier, 99) AS src_tier, dst_tier, critical, privilege_scope, lineage, CAST(i % 3 AS INT) AS entitlement, route_state,
  transition_state IS NOT NULL AS transition, linked, undeclared_hosts, undeclared_identities FROM hops""")
def classify_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = scratch.table(policy.with_context(graph.sanitize_edges(_edges(Evidence(spark, sf_dir))), context(spark)), "edges-in-context")
    m = F.col("modifiers")
    judged = policy.classify_hop_groups(known, _MINUTES).select(
        "label", m["target_novelty"].alias("novel"), m["src_tier"].alias("src_tier"), m["dst_tier"].alias("dst_tier"), m["target_critical"].alias("critical"),
        m["privilege_scope"].alias("privilege_scope"), m["session_lineage"].alias("lineage"), m["identity_tier_entitlement"].alias("entitlement"), m["route_policy_state"].alias("route_state"),
        m["credential_transition_present"].alias("transition"), m["credential_transition_confirmed"].alias("linked"), F.array_join(m["undeclared_hosts"], ",").alias("undeclared_hosts"), F.array_join(m["undeclared_identities"], ",").alias("undeclared_identities"),
        F.col("looked_up.route").alias("route"), F.col("looked_up.approved_change").alias("approved"), "firsts", "nexts",
    )
    return progression.hops(judged, _MINUTES)


_H1 = JOINED + r"""
SELECT 'onprem:' || edge_id AS edge_id, 'identity:on_prem:' || identity AS subject, 'host:on_prem:' || source_host AS source, 'host:on_prem:' || target_host AS target,
  'network=' || flow_ref || ',logon=' || logon_ref || CASE WHEN privilege_ref IS NULL THEN '' ELSE ',privilege=' || privilege_ref END AS refs, logon_id AS session_id, 'confirmed' AS session_state, transition_state AS state FROM edges"""


@query(_H1)
def pivot_to_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = hybrid.pivot_to_reachability(_edges(Evidence(spark, sf_dir)))
    refs = F.array_join(F.transform("evidence_refs", lambda r: F.concat(r["source_type"], F.lit("="), r["evidence_ref"])), ",")
    return lifted.select("edge_id", F.col("subject.id").alias("subject"), F.col("source.id").alias("source"), F.col("target.id").alias("target"), refs.alias("refs"), F.col("session.id").alias("session_id"), F.col("session.state").alias("session_state"), F.col("credential_transition.state").alias("state"))


def _dealt(events: DataFrame) -> DataFrame:
    """Events dealt by number to four tasks for each core: documents that are made of them cost far more than the events, which may lie in a few large row groups."""
    return events.repartition(4 * events.sparkSession.sparkContext.defaultParallelism, "seq")


def _cloud_lines(ev: Evidence) -> DataFrame:
    """(source_file, raw): cloud audit records written from events: two thirds are role assumptions, some failed or incomplete."""
    k, u = F.col("k"), F.col("u")
    record = F.struct(
        F.when(k % 3 != 0, "sts.amazonaws.com").otherwise("s3.amazonaws.com").alias("eventSource"),
        F.lit("AssumeRole").alias("eventName"),
        F.concat(F.lit("ev"), "seq").alias("eventID"),
        F.lit("2026-08-10T10:00:00Z").alias("eventTime"),
        F.when(k % 7 == 0, "AccessDenied").alias("errorCode"),
        F.struct(F.when(k % 5 != 0, F.concat(F.lit("arn:aws:iam::1:user/u"), u)).alias("arn")).alias("userIdentity"),
        F.struct(F.when(k % 4 != 0, F.concat(F.lit("arn:aws:iam::1:role/r"), u)).alias("roleArn")).alias("requestParameters"),
        F.struct(F.struct(F.concat(F.lit("AK"), "seq").alias("accessKeyId")).alias("credentials")).alias("responseElements"),
    )
    return _dealt(ev.events.where("event_type = 'error'")).select(F.concat(F.lit("f"), u % 3, F.lit(".json")).alias("source_file"), F.to_json(F.struct(F.array(record).alias("Records"))).alias("raw"))


def _cloud(ev: Evidence) -> DataFrame:
    return records.expand_cloudtrail(_cloud_lines(ev).select("source_file", F.parse_json("raw").alias("v")))


#: The accepted record's canonical text.
_RECORD = """'{{"eventID":"ev' || seq || '","eventName":"AssumeRole","eventSource":"sts.amazonaws.com","eventTime":"2026-08-10T10:00:00Z","requestParameters":{{"roleArn":"arn:aws:iam::1:role/r' || u || '"}},"responseElements":{{"credentials":{{"accessKeyId":"AK' || seq || '"}}}},"userIdentity":{{"arn":"arn:aws:iam::1:user/u' || u || '"}}}}'""".replace("{{", "{").replace("}}", "}")
_REASON = r"""CASE WHEN k % 3 = 0 THEN 'not sts:AssumeRole' WHEN k % 7 = 0 THEN 'failed AssumeRole'
  WHEN k % 5 = 0 AND k % 4 = 0 THEN 'missing actor, requestParameters.roleArn' WHEN k % 5 = 0 THEN 'missing actor' WHEN k % 4 = 0 THEN 'missing requestParameters.roleArn' END"""


@query(BASE + f", r AS (SELECT *, {_REASON} AS reason FROM e WHERE event_type = 'error') SELECT 'aws:' || substr(sha256({_RECORD}), 1, 24) AS edge_id, 1786356000000000 AS us, 'principal:aws:arn:aws:iam::1:user/u' || u AS actor, 'r' || u AS role, 'AK' || seq AS session, 'ev' || seq AS ref FROM r WHERE reason IS NULL")
def assume_role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hybrid.assume_role_edges(_cloud(Evidence(spark, sf_dir)))
    return found.select("edge_id", F.unix_micros("ts").alias("us"), F.col("subject.id").alias("actor"), F.col("target.display_name").alias("role"), F.col("session.id").alias("session"), F.col("evidence_refs")[0]["evidence_ref"].alias("ref"))


@query(BASE + f", r AS (SELECT *, {_REASON} AS reason FROM e WHERE event_type = 'error') SELECT reason AS item, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'f' || (u % 3) || '.json', count(*) FROM r WHERE reason IS NULL GROUP BY 1")
def cloudtrail_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons, files = windows.cloudtrail_quality(hybrid.assume_role_records(_cloud(Evidence(spark, sf_dir))))
    return reasons.select(F.col("reason").alias("item"), "n").unionByName(files.select(F.col("source_file").alias("item"), F.col("accepted_records").alias("n")).where("n > 0"))


_UNIFIED = f""", r AS (SELECT *, {_REASON} AS reason FROM e WHERE event_type = 'error'),
unified AS (
  SELECT 'on_prem' AS environment, 'onprem:' || edge_id AS edge_id, us, 'host:on_prem:' || target_host AS target, privilege_state FROM edges
  UNION ALL SELECT 'aws', 'aws:' || substr(sha256({_RECORD}), 1, 24), 1786356000000000, 'role:aws:arn:aws:iam::1:role/r' || u, 'unknown' FROM r WHERE reason IS NULL)"""


@query(JOINED + _UNIFIED + "SELECT * FROM unified")
def unify_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Evidence(spark, sf_dir)
    both = hybrid.unify_edges(hybrid.pivot_to_reachability(_edges(ev)), hybrid.assume_role_edges(_cloud(ev)))
    return both.select("environment", "edge_id", F.unix_micros("ts").alias("us"), F.col("target.id").alias("target"), "privilege_state")


@query(BASE + r"SELECT DISTINCT identity AS on_prem_identity, CASE WHEN u % 20 < 5 THEN 'confirmed' ELSE 'unknown' END AS state, CASE WHEN u % 20 < 5 THEN 'map-' || (u % 20) END AS evidence_ref FROM p")
def cross_env_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = Evidence(spark, sf_dir).events.select(F.concat(F.lit("CORP\\u"), F.col("u") % 20).alias("on_prem_identity"), F.concat(F.lit("arn:u"), F.col("u") % 20).alias("cloud_principal")).distinct()
    rows = [(f"CORP\\u{i}", f"arn:u{i}", s, r, n) for i in range(10) for n, (s, r) in enumerate([("confirmed" if i < 5 else "unknown", f"map-{i}"), ("confirmed", f"late-{i}" if i < 5 else None)])]
    maps = spark.createDataFrame(rows, "on_prem_identity string, cloud_principal string, state string, evidence_ref string, seq int")
    return hybrid.cross_env_continuity(ids, maps).select("on_prem_identity", "state", "evidence_ref")


def _json_lines(ev: Evidence) -> DataFrame:
    """(seq, raw): Windows events as JSON documents in search-response form, some parts missing."""
    k, u = F.col("k"), F.col("u")
    code = F.when(F.col("event_type") == "click", F.lit("4624")).when(F.col("event_type") == "signup", F.lit("4672")).when(F.col("event_type") == "error", F.lit("4648"))
    user = F.concat(F.lit("u"), u % 20)
    data = F.struct(user.alias("TargetUserName"), F.lit("CORP").alias("TargetDomainName"), user.alias("SubjectUserName"), F.concat(F.lit("0x"), u % 20).alias("SubjectLogonId"), F.when(k % 7 != 0, F.concat(F.lit("0x"), u % 20)).alias("TargetLogonId"), F.concat(F.lit("::ffff:10.0.0."), u % 5).alias("IpAddress"), F.lit("10").alias("LogonType"))
    doc = F.struct(S.iso_text(F.col("ts")).alias("@timestamp"), F.struct(code.cast("int").alias("code")).alias("event"), F.struct(F.concat(F.lit("h"), k % 6, F.lit(".corp.example")).alias("name")).alias("host"), F.struct(data.alias("event_data")).alias("winlog"))
    raw = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("id"), "seq").alias("_id"), doc.alias("_source"))).alias("hits")).alias("hits")))
    return _dealt(ev.events.where(code.isNotNull())).select("seq", raw.alias("raw"))


def _json_events(ev: Evidence) -> DataFrame:
    return records.windows_records(records.unwrap_envelope(_json_lines(ev).withColumn("v", F.parse_json("raw"))))


_N1 = BASE + rf""", n AS (
  SELECT {_ISO} AS ts_raw, us, 'id' || seq AS ref, CASE event_type WHEN 'click' THEN '4624' WHEN 'signup' THEN '4672' ELSE '4648' END AS code, CASE WHEN k % 6 < 5 THEN 'H' || (k % 6) ELSE 'h5.corp.example' END AS host_name,
    CASE WHEN k % 6 < 5 THEN '10.0.0.' || (k % 6) ELSE '' END AS ips, CASE WHEN event_type = 'click' THEN from_ip END AS src_ip,
    CASE WHEN event_type = 'click' THEN 'CORP\u' || (u % 20) ELSE 'u' || (u % 20) END AS identity, k, event_type
  FROM p WHERE event_type IN ('click', 'signup', 'error'))"""


@query(_N1 + "SELECT us, ts_raw, ref, code, host_name, ips, src_ip, identity FROM n")
def normalize_windows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Evidence(spark, sf_dir)
    out = windows.normalize_windows_events(_json_events(ev), ev.ip_map)
    return out.select(F.unix_micros("ts").alias("us"), "ts_raw", "ref", "code", "host_name", F.array_join("host_ips", ",").alias("ips"), "src_ip", "identity")


_QUALITY = """SELECT code, 'missing host.ip' AS issue, count(*) AS n FROM n WHERE ips = '' GROUP BY 1
UNION ALL SELECT code, 'missing winlog.event_data.TargetLogonId', count(*) FROM n WHERE event_type = 'click' AND k % 7 = 0 GROUP BY 1
UNION ALL SELECT code, 'missing winlog.event_data.TargetServerName', count(*) FROM n WHERE event_type = 'error' GROUP BY 1"""


@query(_N1 + _QUALITY)
def windows_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Evidence(spark, sf_dir)
    return windows.windows_quality(windows.normalize_windows_events(_json_events(ev), ev.ip_map))


@query(BASE + r"SELECT 'evtx:H' || (k % 5) || ':' || seq AS event_id, '4624' AS code, 'success' AS outcome, 'u' || u AS user_name FROM e WHERE event_type = 'click'")
def windows_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events.where("event_type = 'click'")
    head = F.concat(F.lit('<Event><System><EventID>4624</EventID><TimeCreated SystemTime="2026-08-10T10:00:00Z"/><EventRecordID>'), "seq", F.lit("</EventRecordID><Computer>H"), F.col("k") % 5, F.lit("</Computer></System>"))
    xml = F.concat(head, F.lit('<EventData><Data Name="TargetUserName">u'), "u", F.lit('</Data><Data Name="LogonType">10</Data></EventData></Event>'))
    found = records.windows_xml_to_ecs(e.select(xml.alias("xml")))
    return found.select("event_id", "code", "outcome", F.element_at("data", "TargetUserName").alias("user_name"))


def _seeded(df: DataFrame, faults: list[tuple[str, Column, str]]) -> DataFrame:
    """``df`` with one fault in each row: rule number seq % (rules + 1), the last number none."""
    at = F.col("seq") % (len(faults) + 1)
    changed: dict[str, Column] = {}
    for i, (column, bad, _) in enumerate(faults):
        changed[column] = F.when(at == i, bad).otherwise(changed.get(column, F.col(column)))
    return df.withColumns(changed)


def _expected(key: str, faults: list[tuple[str, Column, str]], table: str, condition: str = "true") -> str:
    cases_ = " ".join(f"WHEN {i} THEN '{message}'" for i, (_, _, message) in enumerate(faults))
    empty = " OR ".join(f"seq % {len(faults) + 1} = {i}" for i, (column, _, _) in enumerate(faults) if column == "edge_id") or "false"
    return f"SELECT CASE WHEN {empty} THEN '' ELSE {key} END AS key, CASE seq % {len(faults) + 1} {cases_} END AS message FROM {table} WHERE seq % {len(faults) + 1} < {len(faults)} AND {condition}"


_TRANSITION = "struct<from_identity: string, to_identity: string, state: string, evidence_ref: string>"


def _transition(origin: str | None, to: str | None, state: str, ref: str | None = "r") -> Column:
    return F.struct(F.lit(origin).alias("from_identity"), F.lit(to).alias("to_identity"), F.lit(state).alias("state"), F.lit(ref).alias("evidence_ref")).cast(_TRANSITION)


_NO_ADDRESSES = [":::::::", "12345::", "1:2:3:4:5:6:7:8:9", "::1.2.3.999"]


def _pivot_faults() -> list[tuple[str, Column, str]]:
    nothing = F.lit(None).cast("struct<network: string, logon: string, privilege: string>")
    return [
        *[(c, F.lit(""), f"{c} is missing") for c in ("edge_id", "source_host", "target_host", "identity", "effective_identity")],
        ("ts", F.lit(None).cast("timestamp"), "@timestamp is not a date-time"),
        ("service", F.lit("ssh"), "service is not rdp or smb"),
        ("privilege_state", F.lit("maybe"), "privilege_state is not a known state"),
        ("auth_state", F.lit(None).cast("string"), "auth_state is not a known state"),
        ("source_ip", F.lit("10.0.0.256"), "source_ip is not an address"),
        ("target_ip", F.lit("host"), "target_ip is not an address"),
        *[("target_ip", F.lit(bad), "target_ip is not an address") for bad in _NO_ADDRESSES],
        ("credential_transition", _transition("", "x", "confirmed"), "credential_transition lacks an identity"),
        ("credential_transition", _transition("x", "y", "absent"), "credential_transition.state is not a known state"),
        ("evidence_refs", nothing, "evidence_refs is missing"),
    ]


def _common_faults() -> list[tuple[str, Column, str]]:
    entity = "struct<kind: string, id: string, display_name: string>"
    thing = lambda kind, identifier, name="n": F.struct(F.lit(kind).alias("kind"), F.lit(identifier).alias("id"), F.lit(name).alias("display_name")).cast(entity)
    good = thing("host", "h")
    link = lambda a, state: F.struct(a.alias("from_subject"), good.alias("to_subject"), F.lit(state).alias("state"), F.lit("r").alias("evidence_ref"))
    ref = lambda kind, value, sha=None: F.array(F.struct(F.lit(kind).alias("source_type"), F.lit(value).alias("evidence_ref"), F.lit(None).cast("string").alias("source_file"), F.lit(sha).cast("string").alias("source_sha256")))
    bad_ref = "evidence_refs has an item without type or reference, or with an empty file or a bad sha256"
    return [
        ("schema_version", F.lit("1.0"), "schema_version is not the supported one"),
        ("edge_id", F.lit(""), "edge_id is missing"),
        ("ts", F.lit(None).cast("timestamp"), "@timestamp is not a date-time"),
        ("environment", F.lit("moon"), "environment is not known"),
        ("edge_type", F.lit("waved_at"), "edge_type is not known"),
        ("subject", thing("identity", ""), "subject lacks kind or id, or has an empty name"),
        ("effective_subject", F.lit(None).cast(entity), "effective_subject lacks kind or id, or has an empty name"),
        ("source", thing("", "h"), "source lacks kind or id, or has an empty name"),
        ("target", thing("host", "h", ""), "target lacks kind or id, or has an empty name"),
        ("session", F.col("session").withField("state", F.lit("absent")), "session.state is not a known state"),
        ("auth_state", F.lit("maybe"), "auth_state is not a known state"),
        ("privilege_state", F.lit(None).cast("string"), "privilege_state is not a known state"),
        ("credential_transition", link(F.lit(None).cast(entity), "confirmed"), "credential_transition lacks a subject"),
        ("credential_transition", link(good, "absent"), "credential_transition.state is not a known state"),
        ("evidence_refs", F.filter(ref("x", "y"), lambda _: F.lit(False)), "evidence_refs is empty"),
        ("evidence_refs", ref("", "r"), bad_ref),
        ("evidence_refs", ref("x", "r", "00ff"), bad_ref),
        ("native_context", F.lit(None).cast("map<string, string>"), "native_context is missing"),
        ("edge_type", F.lit("accessed_resource"), ""),
    ]


def _semantic_faults() -> list[tuple[str, Column, str]]:
    who = F.col("identity")
    sure = lambda ref: F.struct(F.lit("x").alias("from_identity"), who.alias("to_identity"), F.lit("confirmed").alias("state"), F.lit(ref).alias("evidence_ref")).cast(_TRANSITION)
    refs = F.col("evidence_refs")
    return [
        ("effective_identity", F.lit("CORP\\other"), "effective_identity differs without a confirmed transition"),
        ("credential_transition", _transition("x", "y", "confirmed"), "confirmed transition does not lead to effective_identity"),
        ("credential_transition", sure(None), "confirmed transition without evidence_ref"),
        ("credential_transition", sure("r"), "confirmed transition without source_logon_id"),
        ("evidence_refs", refs.withField("network", F.lit(None).cast("string")), "confirmed auth_state needs network and logon references"),
        ("evidence_refs", refs.withField("privilege", F.lit("")), "confirmed privilege_state needs a privilege reference"),
    ]


def _some(df: DataFrame) -> DataFrame:
    """Edges without transition, with a privilege and, where the fault isn't its lack, a source session; each breaks no rule."""
    known = F.when(F.col("seq") % 7 == 3, F.lit(None).cast("string")).otherwise("0x1")
    return df.withColumns({"credential_transition": F.lit(None).cast(_TRANSITION), "source_logon_id": known, "privilege_state": F.lit("confirmed"), "evidence_refs": F.col("evidence_refs").withField("privilege", F.lit("p"))})


@query(JOINED + _expected("edge_id", [(c, None, m) for c, m in [(c, f"{c} is missing") for c in ("edge_id", "source_host", "target_host", "identity", "effective_identity")] + [
    ("ts", "@timestamp is not a date-time"), ("service", "service is not rdp or smb"), ("privilege_state", "privilege_state is not a known state"), ("auth_state", "auth_state is not a known state"),
    ("source_ip", "source_ip is not an address"), *[("", "target_ip is not an address")] * (1 + len(_NO_ADDRESSES)), ("", "credential_transition lacks an identity"), ("", "credential_transition.state is not a known state"), ("", "evidence_refs is missing")]], "edges"))
def check_pivot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_pivot_edges(_seeded(_edges(Evidence(spark, sf_dir)), _pivot_faults()))


_SEMANTIC = ["effective_identity differs without a confirmed transition", "confirmed transition does not lead to effective_identity", "confirmed transition without evidence_ref", "confirmed transition without source_logon_id", "confirmed auth_state needs network and logon references", "confirmed privilege_state needs a privilege reference"]


@query(JOINED + _expected("edge_id", [("", None, m) for m in _SEMANTIC], "edges") + " UNION ALL SELECT 'd' || edge_id, 'duplicate edge_id' FROM edges, range(2) WHERE seq % 5 = 0")
def check_edge_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _some(_edges(Evidence(spark, sf_dir)))
    twice = e.where("seq % 5 = 0").withColumn("edge_id", F.concat(F.lit("d"), "edge_id"))
    twice = twice.withColumn("source_logon_id", F.lit("0x1"))
    return checks.check_edge_semantics(_seeded(e, _semantic_faults()).unionByName(twice).unionByName(twice))


_COMMON = ["schema_version is not the supported one", "edge_id is missing", "@timestamp is not a date-time", "environment is not known", "edge_type is not known", *[f"{x} lacks kind or id, or has an empty name" for x in ("subject", "effective_subject", "source", "target")],
    "session.state is not a known state", "auth_state is not a known state", "privilege_state is not a known state", "credential_transition lacks a subject", "credential_transition.state is not a known state", "evidence_refs is empty",
    "evidence_refs has an item without type or reference, or with an empty file or a bad sha256", "evidence_refs has an item without type or reference, or with an empty file or a bad sha256", "native_context is missing", ""]


@query(JOINED + _expected("'onprem:' || edge_id", [("edge_id" if m == "edge_id is missing" else "", None, m) for m in _COMMON], "edges", f"seq % {len(_COMMON) + 1} <> {len(_COMMON) - 1}"))
def check_reachability_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = hybrid.pivot_to_reachability(_edges(Evidence(spark, sf_dir)), hybrid.SCHEMA_VERSION, "seq")
    return checks.check_reachability_edges(_seeded(lifted, _common_faults()))


@query(BASE + r"""
SELECT DISTINCT key, message FROM (
  SELECT CASE m WHEN 0 THEN 'NOTHING' WHEN 6 THEN 'NONE' WHEN 5 THEN 'PIVOT_PROGRESSION' ELSE 'EXPECTED' END || '|' || CASE WHEN m = 2 THEN '' ELSE 'u' || (u % 20) END || CASE m WHEN 3 THEN '|' WHEN 5 THEN '|a>b' WHEN 8 THEN '' ELSE '|a>b>c' END AS key,
    CASE m WHEN 0 THEN 'label is not known' WHEN 1 THEN 'confidence is not known' WHEN 2 THEN 'identity is missing' WHEN 3 THEN 'path is empty' WHEN 4 THEN 'edges is empty' WHEN 5 THEN 'a progression needs three hosts and two edges' WHEN 6 THEN 'NONE needs one edge'
      WHEN 7 THEN 'rationale is missing' WHEN 8 THEN 'path is empty' WHEN 9 THEN 'edges is empty' END AS message
  FROM (SELECT u, k % 11 AS m FROM e)) WHERE message IS NOT NULL""")
def check_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, path = F.col("k") % 11, ["a", "b", "c"]
    none = F.array().cast("array<string>")
    found = Evidence(spark, sf_dir).events.select(
        F.when(m == 0, "NOTHING").when(m == 6, "NONE").when(m == 5, "PIVOT_PROGRESSION").otherwise("EXPECTED").alias("label"), F.when(m == 1, "sure").otherwise("low").alias("confidence"), F.when(m == 2, "").otherwise(F.concat(F.lit("u"), F.col("u") % 20)).alias("identity"),
        F.when(m == 3, none).when(m == 5, F.array(F.lit("a"), F.lit("b"))).when(m != 8, F.array(*map(F.lit, path))).alias("path"), F.when(m == 4, none).when(m != 9, F.array(F.lit("e1"), F.lit("e2"))).alias("edges"),
        F.when(m == 7, "").otherwise("because").alias("rationale"),
    )
    return checks.check_findings(found).distinct()


@query(BASE + r""", a AS (SELECT DISTINCT u % 20 AS i, k % 5 AS h FROM e)
SELECT DISTINCT key, message FROM (
  SELECT 'CORP\u' || i AS key, unnest(['known_edges: identity is not declared', 'approved_paths: identity is not declared', 'complete_for: identity is not declared', 'approved_changes: identity is not declared']) AS message FROM a WHERE i >= 18
  UNION ALL SELECT 'H4', unnest(['known_edges: host is not declared', 'approved_paths: via is not declared', 'approved_changes: target_host is not declared']) FROM a WHERE h = 4
  UNION ALL SELECT 'CORP\u' || i, 'complete_for: environment is missing' FROM a WHERE i % 3 = 0
  UNION ALL SELECT 'CORP\u' || i, 'complete_for: target_tier is not an integer' FROM a WHERE i % 4 = 0
  UNION ALL SELECT 'CORP\u' || i, 'approved_changes: approved_from is not an ISO date' FROM a WHERE i % 5 = 0
  UNION ALL SELECT 'CORP\u' || i, 'approved_changes: approved_until is not an ISO date' FROM a WHERE i % 7 = 0
  UNION ALL SELECT 'policy', 'policy: valid_from is not an ISO date' FROM a WHERE i = 0 UNION ALL SELECT 'policy', 'policy: valid_until is not an ISO date' FROM a WHERE i = 1
  UNION ALL SELECT 'policy', 'policy: valid_from is after valid_until' FROM a WHERE i = 2)""")
def check_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events
    i = F.col("u") % 20
    rows = e.select(i.alias("i"), F.concat(F.lit("CORP\\u"), i).alias("identity"), F.concat(F.lit("H"), F.col("k") % 5).alias("host")).distinct()
    i = F.col("i")
    ctx = context(spark)
    day = lambda n, bad: F.when(i % n == 0, bad).otherwise("2024-01-01")
    ctx.known_edges = rows.select("identity", "host")
    ctx.approved_paths = rows.select("identity", F.col("host").alias("via"), F.lit(0).alias("to_tier"))
    ctx.complete_for = rows.select(F.when(i % 3 == 0, "").otherwise("on_prem").alias("environment"), "identity", F.when(i % 4 != 0, 0).alias("target_tier"))
    ctx.approved_changes = rows.select("identity", F.col("host").alias("target_host"), day(5, "2024").alias("approved_from"), day(7, "2024-01-01 junk").alias("approved_until"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("service"))
    ctx.policy = rows.where("i < 3").select(F.when(i == 0, "2024-1").when(i == 2, "2025-01-01").otherwise("2024-01-01").alias("valid_from"), F.when(i == 1, "2024-02-30").otherwise("2024-12-31").alias("valid_until"))
    return checks.check_context(ctx).distinct()


_CASE = BASE[: BASE.index("flows AS (")] + rf"""
flows AS (
  SELECT seq, us, from_ip AS src_ip, host_ip AS dst_ip, port, port_service AS service, protocol, 'raw-' || substr(sha256({_ISO} || '|' || from_ip || '|' || (10000 + seq) || '|' || host_ip || '|' || port || '|tcp|2|' || (100 + k)), 1, 16) AS ref
  FROM p WHERE event_type = 'view'),
logons AS (SELECT seq, us, ts, {_ISO} AS ts_raw, 'H' || (k % 5) AS host_name, host_ip, from_ip AS src_ip, identity, session AS logon_id, logon_service AS service, ref FROM p WHERE event_type = 'click'),
""" + BASE[BASE.index("privs AS (") :] + _JOINS + _PAIRS + _FINDINGS + _UNIFIED  # fmt: skip


def _windows_documents(ev: Evidence, named: bool = True) -> DataFrame:
    """Windows events as rows before normalisation, from documents that are written from events; only ``named`` ones have an id."""
    k, u = F.col("k"), F.col("u")
    user = lambda n: F.concat(F.lit("u"), n % 20)
    error = F.col("event_type") == "error"
    code = F.when(F.col("event_type") == "click", "4624").when(F.col("event_type") == "signup", "4672").when(error, "4648")
    data = {
        "TargetUserName": user(u), "TargetDomainName": F.lit("CORP"), "SubjectUserName": F.when(error, user(u + 1)).otherwise(user(u)), "SubjectDomainName": F.lit("CORP"), "TargetLogonId": F.concat(F.lit("0x"), u % 20),
        "SubjectLogonId": F.concat(F.lit("0x"), F.when(error, u % 40).otherwise(u % 20)), "IpAddress": F.concat(F.lit("::ffff:10.0.0."), u % 5), "LogonType": F.when(k % 2 == 0, "10").otherwise("3"), "TargetServerName": F.concat(F.lit("h"), u % 5, F.lit(".corp.example")),
    }
    event = [code.alias("code"), *([F.concat(F.lit("e"), "seq").alias("id")] if named else [])]
    doc = F.struct(S.iso_text(F.col("ts")).alias("@timestamp"), F.struct(*event).alias("event"), F.struct(F.concat(F.lit("h"), k % 5, F.lit(".corp.example")).alias("name")).alias("host"), F.struct(F.struct(*[v.alias(n) for n, v in data.items()]).alias("event_data")).alias("winlog"))
    docs = _dealt(ev.events.where(code.isNotNull())).select("seq", F.parse_json(F.to_json(doc)).alias("v"), F.lit(None).cast("string").alias("raw"))
    return records.windows_records(records.unwrap_envelope(docs))


@query(_CASE + "SELECT edge_id, privilege_state, true AS logon_named, privilege_ref IS NOT NULL AS privilege_named FROM edges")
def edges_of_unnamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of events without id or raw document: each has a reference that follows from its content."""
    ev = Evidence(spark, sf_dir)
    found = windows.normalize_windows_events(_windows_documents(ev, named=False).drop("raw"), ev.ip_map)
    logons, privs, creds = windows.split_events(scratch.table(found, "events"))
    made = edges.materialize_edges(ev.flows, logons, privs, creds, ev.ip_map, WINDOW, WINDOW, WINDOW)
    named = lambda c: F.coalesce(F.col(f"evidence_refs.{c}").startswith("raw-"), F.lit(False))
    return made.select("edge_id", "privilege_state", named("logon").alias("logon_named"), named("privilege").alias("privilege_named"))


def _case(spark: SparkSession, sf_dir: str) -> cases.Case:
    """A whole case from packets, event documents and cloud records, which are written from events."""
    ev = Evidence(spark, sf_dir)
    k, u = F.col("k"), F.col("u")
    view = ev.events.where("event_type = 'view'")
    client, server = F.struct(F.concat(F.lit("10.0.0."), u % 5).alias("ip"), (F.lit(10_000) + F.col("seq")).cast("int").alias("port")), F.struct(F.concat(F.lit("10.0.0."), k % 5).alias("ip"), F.when(k % 3 == 0, 3389).when(k % 3 == 1, 445).otherwise(443).alias("port"))
    sent = lambda a, b, flags, size: F.struct(a.alias("a"), b.alias("b"), F.lit(flags).alias("flags"), size.alias("size"))
    both = view.select("seq", "ts", F.posexplode(F.array(sent(client, server, "S", 60 + k), sent(server, client, "SA", F.lit(40)))).alias("n", "x"))
    packets = both.select((F.col("seq") * 2 + F.col("n")).alias("seq"), "ts", F.col("x.a.ip").alias("src_ip"), F.col("x.a.port").alias("src_port"), F.col("x.b.ip").alias("dst_ip"), F.col("x.b.port").alias("dst_port"), F.lit("tcp").alias("transport"), "x.flags", "x.size")
    return cases.reconstruct_case(packets, _windows_documents(ev), _cloud(ev), ev.ip_map, context(spark), cases.Params(WINDOW, WINDOW, WINDOW, _MINUTES))


@query(_CASE + """SELECT 'network_flows' AS name, count(*) AS n FROM flows UNION ALL SELECT 'windows_events', count(*) FROM p WHERE event_type IN ('click', 'signup', 'error') UNION ALL SELECT 'pivot_edges', count(*) FROM edges
UNION ALL SELECT 'reachability_edges', count(*) FROM unified UNION ALL SELECT 'findings', count(*) FROM findings UNION ALL SELECT 'violations', 0""")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_counts(_case(spark, sf_dir))


@query(_CASE + f"SELECT {_FINDING_COLUMNS} FROM findings")
def reconstruct_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_findings(_case(spark, sf_dir).findings)


@query(_CASE + "SELECT label, confidence, count(*) AS n, sum(occurrence_count) AS occurrences FROM findings GROUP BY 1, 2")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.report_tables(_case(spark, sf_dir))["findings"].select("label", "confidence", "n", "occurrences")


@query(_CASE + f""", w AS (SELECT us, CASE event_type WHEN 'click' THEN '4624' WHEN 'signup' THEN '4672' ELSE '4648' END AS code FROM p WHERE event_type IN ('click', 'signup', 'error'))
SELECT 'evidence' AS section, 'windows ' || code AS item, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM w GROUP BY code
UNION ALL SELECT 'evidence', 'network ' || protocol, count(*), min(us), max(us) FROM flows GROUP BY protocol
UNION ALL SELECT 'edges', environment || ' ' || privilege_state, count(*), NULL, NULL FROM unified GROUP BY environment, privilege_state
UNION ALL SELECT 'quality', 'cloud ' || reason, count(*), NULL, NULL FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = cases.report_tables(_case(spark, sf_dir))
    row = lambda df, section, item, first, last: df.select(F.lit(section).alias("section"), item.alias("item"), "n", first.alias("first_us"), last.alias("last_us"))
    none = F.lit(None).cast("long")
    parts = [
        row(tables["evidence"], "evidence", F.concat_ws(" ", "source", "kind"), F.unix_micros("first"), F.unix_micros("last")),
        row(tables["edges"], "edges", F.concat_ws(" ", "environment", "privilege_state"), none, none),
        row(tables["quality"], "quality", F.concat_ws(" ", "source", "issue"), none, none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_CASE + """SELECT 'network_ingest_ms' AS stage, count(*) AS n FROM flows UNION ALL SELECT 'windows_ingest_ms', count(*) FROM p WHERE event_type IN ('click', 'signup', 'error') UNION ALL SELECT 'edge_materialization_ms', count(*) FROM edges
UNION ALL SELECT 'hybrid_normalization_ms', count(*) FROM unified UNION ALL SELECT 'graph_classification_ms', count(*) FROM findings UNION ALL SELECT 'cloud_ingest_ms', count(*) FROM e WHERE event_type = 'error' UNION ALL SELECT 'derived_output_ms', 0""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each timed stage; its milliseconds, which no SQL can give, are measured and must be there."""
    timed = cases.timed_counts(_case(spark, sf_dir))
    rows = [(stage, n) for stage, took, n in timed if took >= 0 and stage != "pipeline_total_ms"]
    return spark.createDataFrame(rows, "stage string, n long")


def _digest_sql(name: str, label: str, table: str, columns: list[str]) -> str:
    """The fingerprint of ``table`` in SQL: d_<name>."""
    parts = " || chr(10) || ".join(f"CASE WHEN {c} IS NULL THEN '{{}}' ELSE '{{\"{c}\":' || to_json({c}) || '}}' END" for c in sorted(columns))
    sums = " || '|' || ".join(f"CAST(coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT), 0) AS VARCHAR)" for i in range(8))
    return f"""h_{name} AS (SELECT sha256({parts}) AS h FROM {table}),
d_{name} AS (SELECT '{label}=' || sha256(count(*) || '|' || {sums}) AS d FROM h_{name})"""


_OUTPUTS = {"findings": _FINDING_COLUMNS.split(", "), "pivot_edges": _EDGE_COLUMNS.split(", ")}
_GROUPED = """, g AS (SELECT u % 6 AS part, string_agg(seq || ',' || event_type || chr(10), '' ORDER BY seq) AS body FROM e GROUP BY 1),
files AS (SELECT 'windows' AS role, CAST(length(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM g)"""


def _grouped_files(ev: Evidence) -> str:
    """Files that are written from events, one for each group of users."""
    e = ev.events.select((F.col("u") % 6).alias("part"), "seq", F.concat_ws(",", "seq", "event_type").alias("value")).repartition("part").sortWithinPartitions("part", "seq")
    return _written(e.select("part", "value"), "evidence", "", "part")


@query(CLASSIFIED + _GROUPED + f", {_digest_sql('i', 'inputs', 'files', ['role', 'size', 'sha256'])}, {_digest_sql('f', 'output findings', 'findings', _OUTPUTS['findings'])}, {_digest_sql('e', 'output pivot_edges', 'edges', _OUTPUTS['pivot_edges'])}" + f" SELECT sha256('{cases.TOOL_VERSION}||window={WINDOW}|' || i.d || '|' || f.d || '|' || e.d) AS derivation_id FROM d_i i, d_f f, d_e e")
def derivation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings and edges follow from: input files (written from events), settings and the rows themselves."""
    ev = Evidence(spark, sf_dir)
    e = _kept_edges(ev)
    found = scratch.table(policy.classify(e, context(spark), _MINUTES), "findings")
    outputs = {"pivot_edges": _flat_edges(e), "findings": _flat_findings(found)}
    return cases.derivation_id(outputs, records.evidence_descriptors(spark, [_grouped_files(ev)], "windows"), {"window": str(WINDOW)})


@query(JOINED + ", p_edges AS (SELECT edge_id, source_host, target_host FROM edges) SELECT 'edges' AS name, edge_id AS item, 2 AS number FROM p_edges UNION ALL SELECT 'flows', ref, 2 FROM flows")
def published_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and flows, published twice and then by a commit that fails on the way; readers see the second."""
    ev = Evidence(spark, sf_dir)
    e, path = _kept_edges(ev), scratch.new_path(spark, "published")
    for edges_of in (e.where("source_host = 'H1'"), e):
        publish.publish({"edges": edges_of, "flows": ev.flows}, path, cases.fingerprint)
    broken = e.withColumn("edge_id", F.when(F.col("seq") > 0, F.raise_error(F.lit("the case fails here"))).otherwise(F.col("edge_id")))
    try:
        publish.publish({"flows": ev.flows.limit(1), "edges": broken}, path, cases.fingerprint)
    except Exception as failure:
        if "the case fails here" not in str(failure):
            raise
    numbers = publish.published(spark, path).select("name", F.col("number").cast("int").alias("number"))
    found = publish.read_published(spark, path, cases.fingerprint)
    rows = [found[name].select(F.lit(name).alias("name"), F.col(column).alias("item")) for name, column in (("edges", "edge_id"), ("flows", "ref"))]
    return rows[0].unionByName(rows[1]).join(numbers, "name")


@query(BASE + r"""SELECT 'T' || (k % 4) AS tactic, 'A' || (k % 9) AS technique_id, count(DISTINCT 'D' || (u % 6)) AS n_detections, string_agg(DISTINCT 'name' || (u % 6), ', ' ORDER BY 'name' || (u % 6)) AS names FROM e GROUP BY 1, 2""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events
    t = lambda p, c, n: F.concat(F.lit(p), F.col(c) % n)
    return detections.coverage_rollup(e.select(t("T", "k", 4).alias("tactic"), t("A", "k", 9).alias("technique_id"), t("D", "u", 6).alias("detection_id"), t("name", "u", 6).alias("name")))


@query(BASE + "SELECT seq, us + 90500000 AS us FROM e WHERE event_type = 'view'")
def shifted_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = S.shift_timestamp(Evidence(spark, sf_dir).flows, 90.5)
    return moved.select("seq", F.unix_micros("ts").alias("us"))


@query(BASE + """, g AS (SELECT *, '10.0.0.' || least(u % 5, k % 5) || '-' || greatest(u % 5, k % 5) AS pair, row_number() OVER (PARTITION BY least(u % 5, k % 5), greatest(u % 5, k % 5) ORDER BY us, seq) AS rn FROM e),
s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY pair ORDER BY us, seq) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM g),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY pair ORDER BY us, seq) AS session FROM s)
SELECT pair, count(*) AS packets, max(us) - min(us) AS us FROM n GROUP BY pair, session""")
def live_flow_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of packets that runs to its end."""
    p = Evidence(spark, sf_dir).packets.withColumns({"src_port": F.lit(1), "dst_port": F.lit(1), "transport": F.lit("tcp")})
    found = run.run_over(p, _last(p, src_ip="end", dst_ip="end"), lambda s: detect.live_flow_fold(s, "1 hour"), "flows")
    ends = F.array_sort(F.array("client.ip", "server.ip"))
    return found.select(F.concat_ws("-", ends[0], F.substring_index(ends[1], ".", -1)).alias("pair"), "packets", (F.unix_micros("last_ts") - F.unix_micros("ts")).alias("us"))


def _last(rows: DataFrame, **other: str | int) -> DataFrame:
    """One row a year after the last of ``rows``, with ``other`` values: it ends a stream's windows."""
    late = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(365)))
    return late.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in other.items()})


def _written(lines: DataFrame, name: str, suffix: str = "", by: str | None = None) -> str:
    """One text column (and the column to partition by) as a folder of text files in the shared folder."""
    path = scratch.new_path(lines.sparkSession, name) + suffix
    writer = lines.write.partitionBy(by) if by else lines.write
    writer.text(path)
    return path


@query(BASE + r""", x AS (SELECT seq, u, k, row_number() OVER (PARTITION BY u % 8 ORDER BY seq) - 1 AS line FROM e)
SELECT 'code c' || (u % 3) AS item, CAST(sum(CASE k % 6 WHEN 4 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM x WHERE k % 6 >= 3 GROUP BY 1
UNION ALL SELECT 'bad', count(*) FROM x WHERE k % 6 = 1
UNION ALL SELECT 'line of ' || seq, line FROM x WHERE k % 6 = 3""")
def json_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every kind, one file for each of eight users' groups, in order of the events."""
    k = F.col("k")
    doc = F.concat(F.lit('{"id":'), "seq", F.lit(',"event":{"code":"c'), F.col("u") % 3, F.lit('"}}'))
    line = F.when(k % 6 == 0, "").when(k % 6 == 1, "{bad").when(k % 6 == 2, '{"index":{}}').when(k % 6 == 3, doc).when(k % 6 == 4, F.concat(F.lit("["), doc, F.lit(",5,"), doc, F.lit("]"))).otherwise(F.concat(F.lit('{"hits":{"hits":[{"_source":'), doc, F.lit("},{}]}}")))
    e = Evidence(spark, sf_dir).events.select((F.col("u") % 8).alias("part"), "seq", line.alias("value")).repartition("part").sortWithinPartitions("part", "seq")
    good, bad = records.read_json_records(spark, [_written(e.select("part", "value"), "lines", ".ndjson", "part")])
    items = records.unwrap_envelope(good).select(F.concat(F.lit("code "), S.event_code(F.col("v"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    plain = F.try_variant_get("v", "$.id", "long")
    lines = good.where(plain.isNotNull()).select(F.concat(F.lit("line of "), plain).alias("item"), F.col("line").alias("n"))
    return items.unionByName(bad.groupBy(F.lit("bad").alias("item")).agg(F.count("*").alias("n"))).unionByName(lines)


@query(_N1 + f"SELECT us, ts_raw, ref, code, host_name, ips, src_ip, identity FROM n UNION ALL SELECT count(*), NULL, NULL, code, issue, NULL, NULL, NULL FROM (SELECT code, issue, unnest(range(n)) FROM ({_QUALITY})) GROUP BY code, issue UNION ALL SELECT count(*), NULL, NULL, NULL, 'accepted', NULL, NULL, NULL FROM n")
def windows_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, and loaded with their issues and counts."""
    ev = Evidence(spark, sf_dir)
    made = loaders.load_windows_sources(spark, [_written(_json_lines(ev).select("raw"), "windows", ".ndjson")], ev.ip_map)
    none = [F.lit(None).cast("string").alias(c) for c in ("ts_raw", "ref", "ips", "src_ip", "identity")]
    rows = made.rows.select(F.unix_micros("ts").alias("us"), "ts_raw", "ref", "code", "host_name", F.array_join("host_ips", ",").alias("ips"), "src_ip", "identity")
    issues = made.issues.select(F.col("n").alias("us"), F.split_part("issue", F.lit(": "), F.lit(1)).alias("code"), F.split_part("issue", F.lit(": "), F.lit(2)).alias("host_name"), *none)
    files = made.files.agg(F.sum("accepted_records").alias("us")).select("us", F.lit(None).cast("string").alias("code"), F.lit("accepted").alias("host_name"), *none)
    return rows.unionByName(issues).unionByName(files)


@query(BASE + f", r AS (SELECT *, {_REASON} AS reason FROM e WHERE event_type = 'error') SELECT 'aws:' || substr(sha256({_RECORD}), 1, 24) AS item, 1 AS n FROM r WHERE reason IS NULL UNION ALL SELECT reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'raw', count(*) FROM r UNION ALL SELECT 'accepted', count(*) FROM r WHERE reason IS NULL UNION ALL SELECT 'hashed', count(*) FROM r WHERE reason IS NULL")
def cloudtrail_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = loaders.load_cloudtrail_sources(spark, [_written(_cloud_lines(Evidence(spark, sf_dir)).select("raw"), "cloud", ".ndjson")])
    one = made.rows.select(F.col("edge_id").alias("item"), F.lit(1).cast("long").alias("n"))
    hashed = made.rows.where("length(evidence_refs[0].source_sha256) = 64").agg(F.count("*").alias("n")).select(F.lit("hashed").alias("item"), "n")
    files = made.files.agg(F.sum("raw_records").alias("raw"), F.sum("accepted_records").alias("accepted")).select(F.explode(F.create_map(F.lit("raw"), "raw", F.lit("accepted"), "accepted")).alias("item", "n"))
    return one.unionByName(made.issues.select(F.col("issue").alias("item"), "n")).unionByName(files).unionByName(hashed)


@query(BASE + _GROUPED + "SELECT role, size, sha256 FROM files")
def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and hash of files that are written from events."""
    return records.evidence_descriptors(spark, [_grouped_files(Evidence(spark, sf_dir))], "windows").select("role", "size", "sha256")


@query(BASE + r"""SELECT seq, 'c' || (u % 3) AS code FROM e UNION ALL SELECT -1, 'many' FROM e HAVING count(*) > 1""")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each day as one JSON document (an array), which many tasks read, each some bytes of it."""
    e = Evidence(spark, sf_dir).events.select(F.to_date("ts").alias("part"), "seq", (F.col("u") % 3).cast("byte").alias("code"))
    item = F.concat(F.lit('{"id":'), "seq", F.lit(',"note":"],[{\\"","event":{"code":"c'), "code", F.lit('"}}'))
    order = Window.partitionBy("part").orderBy("seq")
    first, last = F.lag("seq").over(order).isNull(), F.lead("seq").over(order).isNull()
    # The windows leave the rows as they are to be written, so only these narrow ones are sorted.
    lines = e.withColumns({"first": first, "last": last}).sortWithinPartitions("part", "seq")
    folder = _written(lines.select("part", F.concat(F.when(F.col("first"), "[").otherwise(""), item, F.when(F.col("last"), "]").otherwise(",")).alias("value")), "documents", "", "part")
    names = [r.path for r in spark.read.format("binaryFile").load(folder).select("path").collect()]  # one a day
    good, bad = records.read_json_records(spark, names, split_bytes=1 << 10)
    rows = records.unwrap_envelope(good).select(F.try_variant_get("v", "$.id", "long").alias("seq"), S.event_code(F.col("v")).alias("code"))
    many = good.agg(F.count_distinct("source_file", "line").alias("n")).where("n > 1").select(F.lit(-1).cast("long").alias("seq"), F.lit("many").alias("code"))
    return rows.unionByName(many).unionByName(bad.select(F.col("line").alias("seq"), F.lit("bad").alias("code")))


@query(BASE + "SELECT 'json' AS kind, seq, host_ip, port FROM p UNION ALL SELECT 'parquet', seq, host_ip, port FROM p")
def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by either sink, partitioned, and read back."""
    k = F.col("k")
    e = Evidence(spark, sf_dir).events.select("seq", F.concat(F.lit("10.0.0."), k % 5).alias("host_ip"), F.when(k % 3 == 0, 3389).when(k % 3 == 1, 445).otherwise(443).alias("port"), (k % 2).alias("case_name"))
    parts = []
    for kind in ("json", "parquet"):
        path = scratch.new_path(spark, "results")
        records.write_results(e, path, kind, ["case_name"])
        back = spark.read.schema("seq long, host_ip string, port int, case_name int").format(kind).load(path)
        parts.append(back.select(F.lit(kind).alias("kind"), "seq", "host_ip", "port"))
    return parts[0].unionByName(parts[1])


@query(BASE + r""", x AS (SELECT 'f' || (seq % 3) || '.pcap' AS file, from_ip, host_ip, port, us + 90500000 AS us, k, 1000 + u % 7 AS sport FROM p WHERE event_type = 'view')
SELECT file, from_ip AS src_ip, sport AS src_port, host_ip AS dst_ip, port AS dst_port, min(us) AS us, count(*) AS packets, CAST(sum(60 + k) AS BIGINT) AS bytes, CASE file WHEN 'f0.pcap' THEN sha256('zero') WHEN 'f1.pcap' THEN sha256('one') END AS source_sha256
FROM x WHERE from_ip <> host_ip OR sport <> port GROUP BY ALL""")
def network_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of three capture files with a corrected clock and the hashes of two of them."""
    k, u = F.col("k"), F.col("u")
    packets = Evidence(spark, sf_dir).events.where("event_type = 'view'").select(
        "seq", "ts", F.concat(F.lit("10.0.0."), u % 5).alias("src_ip"), (F.lit(1000) + u % 7).cast("int").alias("src_port"), F.concat(F.lit("10.0.0."), k % 5).alias("dst_ip"), F.when(k % 3 == 0, 3389).when(k % 3 == 1, 445).otherwise(443).alias("dst_port"),
        F.lit("tcp").alias("transport"), F.lit("S").alias("flags"), (F.lit(60) + k).alias("size"), F.concat(F.lit("f"), F.col("seq") % 3, F.lit(".pcap")).alias("source_file"),
    )
    hashes = spark.createDataFrame([("f0.pcap", "zero"), ("f1.pcap", "one")], "file_name string, body string").select("file_name", F.sha2("body", 256).alias("sha256"))
    found = flows.load_network(packets, clock_offset=90.5, evidence=hashes)
    return found.select(F.col("source_file").alias("file"), "src_ip", "src_port", "dst_ip", "dst_port", F.unix_micros("ts").alias("us"), "packets", "bytes", "source_sha256")


@query(BASE + r"""
SELECT DISTINCT 'host' AS item, 'H' || (k % 9) AS name, CAST(k % 3 AS VARCHAR) AS value FROM e WHERE k % 9 % 3 = k % 3 UNION ALL SELECT DISTINCT 'identity', 'CORP\u' || u, CAST(u % 3 AS VARCHAR) FROM e
UNION ALL SELECT 'policy', '2024-01-01', '2024-12-31' UNION ALL SELECT DISTINCT 'complete_for', 'CORP\u' || u, 'on_prem' FROM e UNION ALL SELECT DISTINCT 'approved_path', 'CORP\u' || u, 'H1' FROM e
UNION ALL SELECT DISTINCT 'approved_change', 'CORP\u' || u, 'H2' FROM e UNION ALL SELECT DISTINCT 'known_edge', 'CORP\u' || u, 'H' || (u % 4) FROM e UNION ALL SELECT DISTINCT 'ip', '10.0.0.' || (k % 9), 'H' || (k % 9) FROM e""")
def context_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five context documents and the address map, written as JSON from events and loaded."""
    e = Evidence(spark, sf_dir).events
    name = F.concat(F.lit("CORP\\u"), "u")
    folder = scratch.new_path(spark, "context")
    users = e.select("u").distinct().select("u", name.alias("who"))
    numbers = e.select((F.col("k") % 9).alias("n")).distinct()
    host = F.concat(F.lit("H"), "n")
    as_map = lambda df, key, value: df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    listed = lambda *fields: F.collect_list(F.struct(*[v.alias(n) for n, v in fields]))
    documents = {
        "asset_tiers": as_map(numbers, host, F.struct((F.col("n") % 3).alias("tier"), (F.col("n") == 0).alias("critical"))).select(F.to_json(F.struct(F.col("m").alias("hosts")))),
        "identity_roles": as_map(users, F.col("who"), F.struct((F.col("u") % 3).alias("justified_max_tier"))).select(F.to_json(F.struct(F.col("m").alias("identities")))),
        "expected_admin_paths": users.agg(listed(("environment", F.lit("on_prem")), ("identity", F.col("who")), ("target_tier", F.lit(0))).alias("c"), listed(("identity", F.col("who")), ("via", F.lit("H1")), ("to_tier", F.lit(0))).alias("p")).select(F.to_json(F.struct(F.struct(F.lit("2024-01-01").alias("valid_from"), F.lit("2024-12-31").alias("valid_until"), F.col("c").alias("complete_for")).alias("policy_metadata"), F.col("p").alias("approved_paths")))),
        "approved_changes": users.agg(listed(("identity", F.col("who")), ("target_host", F.lit("H2"))).alias("approved_changes")).select(F.to_json(F.struct("approved_changes"))),
        "known_reachability": as_map(users, F.col("who"), F.array(F.concat(F.lit("H"), F.col("u") % 4))).select(F.to_json(F.struct(F.col("m").alias("known_edges")))),
    }
    for document, df in documents.items():
        df.write.text(f"{folder}/{document}.json")
    as_map(numbers, F.concat(F.lit("10.0.0."), "n"), host).select(F.to_json("m")).write.text(f"{folder}/map.json")
    ctx = contexts.load_context_json(spark, folder)
    row = lambda df, item, a, b: df.select(F.lit(item).alias("item"), F.col(a).alias("name"), F.col(b).cast("string").alias("value"))
    parts = [row(ctx.hosts, "host", "host", "tier"), row(ctx.identities, "identity", "identity", "justified_max_tier"), row(ctx.policy, "policy", "valid_from", "valid_until"), row(ctx.complete_for, "complete_for", "identity", "environment")]
    parts += [row(ctx.approved_paths, "approved_path", "identity", "via"), row(ctx.approved_changes, "approved_change", "identity", "target_host"), row(ctx.known_edges, "known_edge", "identity", "host"), row(contexts.load_ip_map(spark, f"{folder}/map.json"), "ip", "ip", "host")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(BASE + rf"""SELECT {_ISO} AS ts_raw, 'network' AS category, from_ip AS source_ip, 1000 AS source_port, from_ip AS client_ip, host_ip AS destination_ip, port AS destination_port, host_ip AS server_ip, 1 AS source_packets, 60 + k AS source_bytes, 0 AS destination_packets,
  protocol, 'tcp' AS transport, 1 AS packets, 60 + k AS bytes, 0 AS duration, 'unknown' AS direction, 'sensor' AS observer, '8.11.0' AS ecs_version, 'sensor flow-folding trailweave' AS observed_by FROM p WHERE event_type = 'view' AND k % 5 <> u % 5""")
def nested_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of one packet each, in the nested layout of network logs."""
    k, u = F.col("k"), F.col("u")
    e = Evidence(spark, sf_dir).events.where("event_type = 'view' AND k % 5 <> u % 5")
    packets = e.select("seq", "ts", F.concat(F.lit("10.0.0."), u % 5).alias("src_ip"), F.lit(1000).alias("src_port"), F.concat(F.lit("10.0.0."), k % 5).alias("dst_ip"), F.when(k % 3 == 0, 3389).when(k % 3 == 1, 445).otherwise(443).alias("dst_port"), F.lit("tcp").alias("transport"), F.lit("S").alias("flags"), (F.lit(60) + k).alias("size"), F.col("seq").alias("capture"))
    n = flows.to_ecs(flows.flow_events(flows.fold_flows(packets, "capture")), ordered=True)
    return n.select(
        F.col("@timestamp").alias("ts_raw"), F.col("event.category")[0].alias("category"), F.col("source.ip").alias("source_ip"), F.col("source.port").alias("source_port"), F.col("client.ip").alias("client_ip"), F.col("destination.ip").alias("destination_ip"),
        F.col("destination.port").alias("destination_port"), F.col("server.ip").alias("server_ip"), F.col("source.packets").alias("source_packets"), F.col("source.bytes").alias("source_bytes"), F.col("destination.packets").alias("destination_packets"),
        "network.protocol", "network.transport", "network.packets", "network.bytes", F.col("event.duration").alias("duration"), "network.direction", F.col("observer.hostname").alias("observer"),
        F.col("ecs.version").alias("ecs_version"), F.concat_ws(" ", "observer.type", "observer.product", "observer.vendor").alias("observed_by"),
    )


@query(BASE + "SELECT 'H' || (k % 5) || '-' || (u % 20) AS edge_id, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1 HAVING count(*) > 1")
def duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Evidence(spark, sf_dir).events.where("event_type = 'click'")
    return graph.duplicate_edge_ids(e.select(F.concat(F.lit("H"), F.col("k") % 5, F.lit("-"), F.col("u") % 20).alias("edge_id")))


@query(BASE + "SELECT (us // 43200000000 - i) * 43200000000 AS window_us, '10.0.0.' || (u % 5) AS src_ip, host_ip AS dst_ip, count(DISTINCT 1024 + k) AS distinct_ports FROM p, range(2) t(i) WHERE event_type = 'view' GROUP BY 1, 2, 3 HAVING count(DISTINCT 1024 + k) >= 2")
def live_port_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of a stream that runs to its end."""
    e = Evidence(spark, sf_dir).events.where("event_type = 'view'")
    x = e.select("ts", F.concat(F.lit("10.0.0."), F.col("u") % 5).alias("src_ip"), F.concat(F.lit("10.0.0."), F.col("k") % 5).alias("dst_ip"), (F.col("k") + 1024).alias("dst_port"), F.lit("tcp").alias("transport"))
    found = run.run_over(x, _last(x, src_ip="end"), lambda s: detect.live_port_fan_out(s, 2, "1 day", "12 hours"), "fan-out")
    return found.select(F.unix_micros("window_start").alias("window_us"), "src_ip", "dst_ip", F.col("distinct_ports").cast("long").alias("distinct_ports"))


@query(JOINED + f"SELECT {_EDGE_COLUMNS} FROM edges")
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one stream of flows, logons, privileges and credential uses that runs to its end."""
    ev = Evidence(spark, sf_dir)
    kinds = {"logon": ev.logons, "flow": ev.flows, "priv": ev.privs, "cred": ev.creds}
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    split = lambda s: [s.where(F.col("kind") == kind).select(*df.columns) for kind, df in kinds.items()]

    def make(stream: DataFrame) -> DataFrame:
        logons, found, privs, creds = split(stream)
        return detect.live_edges(logons, found, privs, creds, ev.ip_map, WINDOW, WINDOW, WINDOW)

    # Each input ends by a row of its own that no filter before the watermark takes away and that meets none of the others.
    other = {"logon": {"src_ip": "end logon", "logon_type": "10"}, "flow": {"src_ip": "end flow", "dst_port": 3389}, "priv": {"logon_id": "end priv"}, "cred": {"subject_logon_id": "end cred"}}
    ends = [_last(df, **other[kind]) for kind, df in zip(kinds, tagged, strict=True)]
    end = ends[0]
    for part in ends[1:]:
        end = end.unionByName(part, allowMissingColumns=True)
    return _flat_edges(run.run_over(rows, end, make, "live-edges", slices=2))


@query(_sequence_sql([_FLOW, _LOGON, ("event_type = 'purchase'", "host_ip")], WINDOW))
def live_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow, logon and process start on a host, by the state machine of a stream that runs to its end."""
    e = Evidence(spark, sf_dir).sequence_events
    remote = F.col("dst_port").isin(3389, 445)
    stage = F.when((F.col("category") == "network") & remote, 0).when(F.col("code") == "4624", 1).when(F.col("category") == "process", 2)
    rows = e.select(F.col("host_ip").alias("key"), "ts", "seq", stage.alias("stage")).where("stage is not null")
    return run.run_over(rows, _last(rows, key="end"), lambda s: detect.live_sequence(s, 3, WINDOW), "sequences")


@query(BASE + "SELECT 'rc4 ' || seq AS alert FROM e WHERE event_type = 'click' AND k % 2 = 0 UNION ALL SELECT 'command d' || seq FROM e WHERE event_type = 'purchase' AND k % 3 = 0")
def live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on single events of streams in which every event comes twice; each alert comes once."""
    e = Evidence(spark, sf_dir).events
    twice = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    ids = F.concat(F.lit("d"), "seq").alias("_id")
    tickets = twice.where("event_type = 'click'").select(F.col("seq").cast("string").alias("_id"), "ts", F.lit("4768").alias("code"), F.lit("success").alias("outcome"), F.when(F.col("k") % 2 == 0, "0x17").otherwise("0x12").alias("ticket_encryption"), F.lit("u").alias("target_user"))
    starts = twice.where("event_type = 'purchase'").select(ids, "ts", F.lit("process").alias("category"), F.lit("start").alias("type"), F.lit("pwsh.exe").alias("process_name"), F.when(F.col("k") % 3 == 0, "pwsh -enc " + "aB3+" * 9).otherwise("pwsh -file x").alias("command_line"), *[F.lit("x").alias(c) for c in ("host_name", "user_name", "parent_name")])
    rc4 = run.run_over(tickets, None, lambda s: detect.live_alerts(detect.live_rc4_tgt(s)), "tickets")
    commands = run.run_over(starts, None, lambda s: detect.live_alerts(detect.live_encoded_powershell(s)), "commands")
    return rc4.select(F.concat(F.lit("rc4 "), "_id").alias("alert")).unionByName(commands.select(F.concat(F.lit("command "), "_id").alias("alert")))


@query(_sequence_sql([_FLOW, _LOGON, ("event_type = 'purchase'", "host_ip")], WINDOW))
def scheduled_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots found by runs over consecutive intervals, each of which looks back one span over evidence kept by day."""
    e = Evidence(spark, sf_dir).sequence_events
    folder = scratch.new_path(spark, "schedule")
    schedule.keep(e, f"{folder}/evidence")

    def rule(evidence: DataFrame) -> DataFrame:
        return _seqs(detections.authenticated_pivot(evidence, WINDOW), 3, "host_ip").withColumn("_id", F.col("seqs"))

    least, most = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    runs, zero = 5, datetime(1970, 1, 1, tzinfo=timezone.utc)
    edges_of = [zero + timedelta(microseconds=least - 1 + (most - least + 1) * i // runs) for i in range(runs + 1)] if least is not None else [zero, zero]
    for start, end in zip(edges_of[:-1], edges_of[1:], strict=True):
        schedule.run_rule(spark, f"{folder}/evidence", f"{folder}/alerts", rule, start, end, WINDOW)
    return schedule.alerts(spark, f"{folder}/alerts").select("key", "seqs")


@query(BASE + "SELECT (us // 21600000000 - i) * 21600000000 AS window_us, '10.0.0.' || (u % 5) AS src_ip, host_ip AS dst_ip, count(DISTINCT 1024 + k) AS distinct_ports FROM p, range(4) t(i) WHERE event_type = 'view' GROUP BY 1, 2, 3 HAVING count(DISTINCT 1024 + k) >= 3")
def port_fan_out_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-out in windows of a day, four of which overlap, by a sweep over panes."""
    e = Evidence(spark, sf_dir).events.where("event_type = 'view'")
    x = e.select("ts", F.concat(F.lit("10.0.0."), F.col("u") % 5).alias("src_ip"), F.concat(F.lit("10.0.0."), F.col("k") % 5).alias("dst_ip"), (F.col("k") + 1024).alias("dst_port"), F.lit("tcp").alias("transport"))
    found = detections.port_fan_out_windowed(x, 3, "1 day", "6 hours")
    return found.select(F.unix_micros("window_start").alias("window_us"), "src_ip", "dst_ip", "distinct_ports")
