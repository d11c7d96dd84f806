"""Detections: single events, sequences and aggregations.

Flat event tables carry: seq, ts, category, plus the fields each rule names.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import Stage, sequence

# Fixed values of the rules.
LOCAL_ADDRESSES = ["-", "127.0.0.1", "::1", "0.0.0.0"]
EXCLUDED_USERS = ["krbtgt", "-", ""]
ENCODED_COMMAND = r"(?s)^.* -(e(n(c(o(d(e(d(c(o(m(m(a(n(d)?)?)?)?)?)?)?)?)?)?)?)?)?|ec) +[a-z0-9+/=]{20,}.*$"
REMOTE_PORTS, REMOTE_PROTOCOLS, REMOTE_LOGON_TYPES = [3389, 445], ["rdp", "smb"], ["10", "3"]
FAN_OUT = 15


def rc4_tgt(events: DataFrame) -> DataFrame:
    """Kerberos ticket requests of users that were granted RC4 (code 4768, encryption 0x17)."""
    user = F.col("target_user")
    return events.where((F.col("code") == "4768") & (F.col("outcome") == "success") & (F.col("ticket_encryption") == "0x17") & user.isNotNull() & ~user.endswith("$") & ~user.isin(EXCLUDED_USERS))


def encoded_powershell(events: DataFrame, ordered: bool = True) -> DataFrame:
    """PowerShell starts with an encoded command of 20 characters or more, newest first (a stream can't be ``ordered``)."""
    named = events.where((F.col("category") == "process") & (F.col("type") == "start") & F.lower("process_name").isin("powershell.exe", "pwsh.exe") & F.lower("command_line").rlike(ENCODED_COMMAND))
    found = named.select("_id", "ts", "host_name", "user_name", "parent_name", "process_name", "command_line")
    return found.orderBy(F.desc("ts"), "_id") if ordered else found


def allowlist_filter(alerts: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Alerts without those of sanctioned scanners, jump hosts or accounts."""
    return alerts.join(allowed.select(*on).distinct(), on, "left_anti")


def dedupe_alerts(alerts: DataFrame, key: str = "_id") -> DataFrame:
    """One alert for each source document; in a stream, within its watermark."""
    return alerts.dropDuplicatesWithinWatermark([key]) if alerts.isStreaming else alerts.dropDuplicates([key])


def _remote_flow() -> Column:
    return (F.col("category") == "network") & (F.col("transport") == "tcp") & F.col("dst_port").isin(REMOTE_PORTS) & F.col("protocol").isin(REMOTE_PROTOCOLS)


def _remote_logon() -> Column:
    return (F.col("code") == "4624") & (F.col("outcome") == "success") & F.col("logon_type").isin(REMOTE_LOGON_TYPES)


def _process_start() -> Column:
    return (F.col("category") == "process") & (F.col("type") == "start")


def rdp_logon_then_process(events: DataFrame, max_span: float = 60) -> DataFrame:
    """A remote interactive logon from elsewhere, then a process of the same user on the same computer."""
    logon = (F.col("code") == "4624") & (F.col("logon_type") == "10") & (F.col("outcome") == "success") & ~F.coalesce(F.col("ip_address").isin(LOCAL_ADDRESSES), F.lit(False))
    return sequence(events, [Stage(logon, [F.col("target_user")]), Stage(_process_start(), [F.col("user_name")])], max_span, by=[F.col("computer_name")])


def authenticated_pivot(events: DataFrame, max_span: float = 300) -> DataFrame:
    """A flow to a remote-access service, a logon on its target, then a process there."""
    return sequence(events, [Stage(_remote_flow(), [F.col("dst_ip")]), Stage(_remote_logon(), [F.col("host_ip")]), Stage(_process_start(), [F.col("host_ip")])], max_span)


def privileged_edge_candidate(events: DataFrame, max_span: float = 120) -> DataFrame:
    """A flow to a remote-access service, a logon on its target, then special privileges there."""
    return sequence(events, [Stage(_remote_flow(), [F.col("dst_ip")]), Stage(_remote_logon(), [F.col("host_ip")]), Stage(F.col("code") == "4672", [F.col("host_ip")])], max_span)


def port_fan_out(flows: DataFrame, threshold: int = FAN_OUT, approximate: bool = False) -> DataFrame:
    """Pairs of source and destination with many distinct destination ports over TCP, most first."""
    distinct = F.approx_count_distinct("dst_port") if approximate else F.count_distinct("dst_port")
    found = flows.where(F.col("transport") == "tcp").groupBy("src_ip", "dst_ip").agg(distinct.alias("distinct_ports")).where(F.col("distinct_ports") >= threshold)
    return found.orderBy(F.desc("distinct_ports"), "src_ip", "dst_ip")


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(duration: str) -> int:
    number, unit = duration.split()
    return int(number) * _UNITS[unit.removesuffix("s")]


def port_fan_out_windowed(flows: DataFrame, threshold: int = FAN_OUT, length: str = "1 minute", slide: str | None = None, approximate: bool = False) -> DataFrame:
    """The same by time window, tumbling or sliding (window_start, src_ip, dst_ip, distinct_ports); ``length`` and ``slide`` like "5 minutes".

    Time is cut into panes, the longest that both lengths are made of, and a row counts in its pane only.  Exact on
    a table: each port of a pair is one row a pane; it is new in the windows that begin after the pane it was
    last seen in, so windows' counts are running sums of ports that come and go, and neither rows nor sets are
    copied into windows.  ``approximate``: one HLL sketch a pane, merged into windows.  On a stream (with a
    watermark on ts): one set or sketch a pane, merged into windows by a second aggregation.
    """
    long, step = _seconds(length), _seconds(slide or length)
    pane = gcd(long, step)
    tcp = flows.where(F.col("transport") == "tcp")
    if flows.isStreaming:
        found = _merged_panes(tcp, pane, length, slide or length, approximate)
    elif approximate:
        found = fan_out_of_sketches(pane_sketches(flows, f"{pane} seconds"), length, slide)
    else:
        found = _swept_panes(tcp, pane, long // pane, step // pane)
    return found.where(F.col("distinct_ports") >= threshold)


def pane_sketches(flows: DataFrame, pane: str = "1 minute") -> DataFrame:
    """(pane, src_ip, dst_ip, ports): a mergeable HLL sketch of the destination ports for each pane of time; new panes can be added to those that are kept."""
    number = F.floor(F.unix_micros("ts") / (_seconds(pane) * 1_000_000))
    return flows.where(F.col("transport") == "tcp").groupBy(number.alias("pane"), "src_ip", "dst_ip").agg(F.hll_sketch_agg("dst_port").alias("ports"))


def fan_out_of_sketches(sketches: DataFrame, length: str, slide: str | None = None, pane: str | None = None) -> DataFrame:
    """(window_start, src_ip, dst_ip, distinct_ports) of pane sketches; ``pane``: their length, where it isn't the longest that fits."""
    long, step = _seconds(length), _seconds(slide or length)
    unit = _seconds(pane) if pane else gcd(long, step)
    if long % unit or step % unit:
        raise ValueError("windows are not made of whole panes")
    first, last = F.ceil((F.col("pane") - long // unit + 1) / (step // unit)), F.floor(F.col("pane") / (step // unit))
    spread = sketches.where(first <= last).select(F.explode(F.sequence(first, last)).alias("w"), "src_ip", "dst_ip", "ports")
    merged = spread.groupBy("w", "src_ip", "dst_ip").agg(F.hll_sketch_estimate(F.hll_union_agg("ports")).alias("distinct_ports"))
    return merged.select(F.timestamp_seconds(F.col("w") * step).alias("window_start"), "src_ip", "dst_ip", "distinct_ports")


def _swept_panes(tcp: DataFrame, pane: int, long: int, step: int) -> DataFrame:
    """Exact counts by a sweep; ``long`` and ``step`` are in panes, windows are numbered by steps."""
    seen = tcp.select("src_ip", "dst_ip", "dst_port", F.floor(F.unix_micros("ts") / (pane * 1_000_000)).alias("pane")).distinct()
    before = F.lag("pane").over(Window.partitionBy("src_ip", "dst_ip", "dst_port").orderBy("pane"))
    least = F.greatest(F.col("pane") - long + 1, F.coalesce(before + 1, F.col("pane") - long + 1))
    runs = seen.select("src_ip", "dst_ip", F.ceil(least / step).alias("first"), F.floor(F.col("pane") / step).alias("last")).where("first <= last")
    change = F.array(F.struct(F.col("first").alias("w"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("w"), F.lit(-1).alias("d")))
    changes = runs.select("src_ip", "dst_ip", F.inline(change)).groupBy("src_ip", "dst_ip", "w").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("src_ip", "dst_ip").orderBy("w")
    level = changes.select("src_ip", "dst_ip", "w", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("distinct_ports"), F.lead("w").over(order).alias("until"))
    return level.where("distinct_ports > 0").select(F.explode(F.sequence(F.col("w"), F.col("until") - 1)).alias("w"), "src_ip", "dst_ip", "distinct_ports").select(F.timestamp_seconds(F.col("w") * (step * pane)).alias("window_start"), "src_ip", "dst_ip", "distinct_ports")


def _merged_panes(tcp: DataFrame, pane: int, length: str, slide: str, approximate: bool) -> DataFrame:
    held = F.hll_sketch_agg("dst_port") if approximate else F.collect_set("dst_port")
    panes = tcp.groupBy(F.window("ts", f"{pane} seconds").alias("pane"), "src_ip", "dst_ip").agg(held.alias("ports"))
    every = F.hll_sketch_estimate(F.hll_union_agg("ports")) if approximate else F.size(F.array_distinct(F.flatten(F.collect_list("ports")))).cast("long")
    found = panes.groupBy(F.window(F.window_time("pane"), length, slide).alias("window"), "src_ip", "dst_ip").agg(every.alias("distinct_ports"))
    return found.select(F.col("window.start").alias("window_start"), "src_ip", "dst_ip", "distinct_ports")


def coverage_rollup(detections: DataFrame) -> DataFrame:
    """Detections of each tactic and technique: how many, and their names in order."""
    return detections.groupBy("tactic", "technique_id").agg(F.count_distinct("detection_id").alias("n_detections"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def coverage_totals(detections: DataFrame) -> DataFrame:
    """Techniques of each tactic, and the totals in the row whose tactic is null."""
    return detections.rollup("tactic").agg(F.count_distinct("technique_id").alias("n_techniques"), F.count_distinct("detection_id").alias("n_detections"))
