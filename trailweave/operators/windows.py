"""Windows event normalisation and input quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import scalars as S

# The supported codes and the event data each must have.
REQUIRED_FIELDS = {
    "4624": ["TargetUserName", "TargetLogonId", "IpAddress", "LogonType"],
    "4672": ["SubjectUserName", "SubjectLogonId"],
    "4648": ["SubjectUserName", "SubjectLogonId", "TargetUserName", "TargetServerName"],
}


def _ordered(ip_map: DataFrame) -> DataFrame:
    """(ip, host, pos): the map in its own order, which ``load_ip_map`` keeps in ``pos``."""
    return ip_map.select("ip", "host", F.col("pos") if "pos" in ip_map.columns else F.lit(0).alias("pos"))


def reverse_host_map(ip_map: DataFrame) -> DataFrame:
    """(alias, ips): the addresses of each alias of a host, in the map's order."""
    aliases = _ordered(ip_map).select(F.explode(S.host_aliases(F.col("host"))).alias("alias"), "pos", S.canonical_ip(F.col("ip")).alias("ip"))
    return aliases.groupBy("alias").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ip"))), lambda x: x["ip"])).alias("ips"))


SMALL_MAP = 1000  # addresses; a map of no more is one value in the plan


def _as_value(table: DataFrame, key: str, value: str) -> Column:
    """A small table as one map, made once for the query."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m")).scalar()


def _placed(events: DataFrame, ip_map: DataFrame) -> DataFrame:
    """``events`` (with ``aliases`` and ``own_ips``) with host_ips, their own or else the map's of their aliases, and name, the map's host of the first of these that it has, or else their own.

    A small map is looked up as a value, in one pass over the events and without joins; a larger one is joined.
    """
    nothing = F.array().cast("array<string>")
    chosen = lambda first, second: F.when(F.size("own_ips") > 0, F.col("own_ips")).otherwise(F.array_distinct(F.concat(F.coalesce(first, nothing), F.coalesce(second, nothing))))
    by_alias = reverse_host_map(ip_map)
    alias = lambda n: F.get("aliases", F.lit(n))
    if ip_map.limit(SMALL_MAP + 1).count() > SMALL_MAP:
        for n in range(2):
            events = events.join(by_alias.select(F.col("alias").alias(f"alias{n}"), F.col("ips").alias(f"ips{n}")), alias(n) == F.col(f"alias{n}"), "left")
        events = events.withColumn("host_ips", chosen(F.col("ips0"), F.col("ips1"))).drop("own_ips", "aliases", "alias0", "alias1", "ips0", "ips1")
        return _named(events, ip_map)
    ips = _as_value(by_alias, "alias", "ips")
    names = _as_value(_ordered(ip_map).where("ip is not null").groupBy("ip").agg(F.min_by("host", "pos").alias("host")), "ip", "host")
    events = events.withColumn("host_ips", chosen(F.element_at(ips, alias(0)), F.element_at(ips, alias(1)))).drop("own_ips", "aliases").withColumn("_names", names)
    known = F.filter(F.transform("host_ips", lambda ip: F.element_at("_names", ip)), lambda h: h.isNotNull())
    return events.withColumn("name", F.coalesce(F.get(known, F.lit(0)), "host_name")).drop("_names")


def _named(events: DataFrame, ip_map: DataFrame) -> DataFrame:
    """``events`` with ``name``: the map's host of the first of their addresses that it has, else their own.

    Events of one address need a lookup only; those of several are the few that are grouped again.
    """
    names = _ordered(ip_map).groupBy(F.col("ip").alias("map_ip")).agg(F.min_by("host", "pos").alias("map_host"))
    own = F.coalesce("map_host", "host_name").alias("name")
    one = events.where(F.size("host_ips") <= 1).join(names, F.get("host_ips", F.lit(0)) == F.col("map_ip"), "left").select(*events.columns, own)
    spread = events.where(F.size("host_ips") > 1).select("seq", F.struct(*events.columns).alias("row"), F.posexplode("host_ips").alias("place", "ip"))
    spread = spread.join(names, F.col("ip") == F.col("map_ip"), "left")
    many = spread.groupBy("seq").agg(F.first("row").alias("row"), F.min_by("map_host", F.when(F.col("map_host").isNotNull(), F.col("place"))).alias("map_host"))
    return one.unionByName(many.select("row.*", "map_host").select(*events.columns, own))


def normalize_windows_events(events: DataFrame, ip_map: DataFrame) -> DataFrame:
    """Events of the supported codes with host name and addresses, UTC time, source address and id filled in.

    ``events``: seq (unique), ts_raw, code, outcome, event_id, host_name, host_ips, computer_name, record_id,
    sequence, source_ip, data, raw (as ``sources.records`` makes them; missing columns count as null).
    The id of an event without one is made of its host and record number, or its sequence number; with
    neither, ``ref`` is the reference that follows from its content: ``raw``, or where that is null what
    the event's own columns hold.
    """
    for c, kind in (("outcome", "string"), ("event_id", "string"), ("host_name", "string"), ("host_ips", "array<string>"), ("computer_name", "string"), ("record_id", "string"), ("sequence", "string"), ("source_ip", "string"), ("raw", "string"), ("source_file", "string")):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(kind))
    blank = F.lit("")
    nothing = F.array().cast("array<string>")
    content = [c for c in ("ts_raw", "code", "outcome", "host_name", "host_ips", "computer_name", "source_ip", "data") if c in events.columns]
    number = F.coalesce(F.nullif("record_id", blank), "sequence")
    unnamed = (F.coalesce("event_id", blank) == "") & number.isNull()
    events = events.withColumn("raw", F.when(unnamed, F.coalesce("raw", F.to_json(F.struct(*content)))))
    e = events.where(F.col("code").isin(list(REQUIRED_FIELDS)))
    e = e.withColumns({"host_name": F.coalesce(F.nullif("host_name", blank), F.nullif("computer_name", blank)), "own_ips": F.transform(F.filter(F.coalesce("host_ips", nothing), lambda x: x.isNotNull() & (x != "")), S.canonical_ip)})
    e = _placed(e.withColumn("aliases", S.host_aliases(F.col("host_name"))), ip_map)
    ts = S.utc_ts(F.col("ts_raw"))
    logon = F.col("code") == "4624"
    source = S.canonical_ip(F.coalesce(F.nullif(F.element_at("data", "IpAddress"), blank), "source_ip"))
    user = F.when(logon, S.norm_identity(F.element_at("data", "TargetUserName"), F.element_at("data", "TargetDomainName")))
    event_id = F.coalesce(F.nullif("event_id", blank), F.when(number.isNotNull(), F.concat_ws(":", F.lit("windows"), F.coalesce("name", F.lit("unknown")), number)))
    return e.select(
        "seq",
        "source_file",
        ts.alias("ts"),
        F.when(ts.isNotNull(), S.iso_text(ts)).alias("ts_raw"),
        "code",
        F.when(logon, F.coalesce(F.nullif("outcome", blank), F.lit("success"))).otherwise(F.col("outcome")).alias("outcome"),
        S.evidence_ref(event_id, F.col("raw")).alias("ref"),
        F.col("name").alias("host_name"),
        "host_ips",
        F.when(logon, source).alias("src_ip"),
        F.when(logon, user).otherwise(S.norm_identity(F.element_at("data", "SubjectUserName"), F.element_at("data", "SubjectDomainName"))).alias("identity"),
        F.element_at("data", F.when(logon, F.lit("TargetLogonId")).otherwise(F.lit("SubjectLogonId"))).alias("logon_id"),
        F.element_at("data", "LogonType").alias("logon_type"),
        S.norm_identity(F.element_at("data", "TargetUserName"), F.element_at("data", "TargetDomainName")).alias("target_identity"),
        F.element_at("data", "TargetServerName").alias("target_server"),
        "data",
    )


def split_events(windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(logons, privileges, credential uses) as ``operators.edges`` takes them."""
    logons = windows.where("code = '4624' and outcome = 'success'").select("seq", "ts", "ts_raw", "host_name", "host_ips", "src_ip", "identity", "logon_id", "logon_type", "ref")
    privs = windows.where("code = '4672'").select("seq", "ts", "host_ips", "identity", "logon_id", "ref")
    creds = windows.where("code = '4648'").select("seq", "ts", "host_ips", F.col("identity").alias("subject_identity"), "target_identity", F.col("logon_id").alias("subject_logon_id"), "target_server", "ref")
    return logons, privs, creds


LINES = 1 << 16  # of a file that are numbered together


def dense_seq(records: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """A dense input order: rows are numbered within each file, and files by the rows before them.

    ``order``: file, line (a number) and further columns.  A file's rows are sorted in parts of ``LINES`` lines, by many tasks;
    one row for each part of a file, and then one for each file, meet in a single task.  ``records`` is read twice.
    """
    file = order[0]
    part = F.coalesce(F.floor(F.col(order[1]) / LINES), F.lit(-1))
    rows = records.withColumn("_part", part)
    sizes = rows.groupBy(file, "_part").agg(F.count("*").alias("_size"))
    whole = sizes.groupBy(file).agg(F.sum("_size").alias("_whole"))
    files = whole.select(F.col(file).alias("_file"), (F.sum("_whole").over(Window.orderBy(file)) - F.col("_whole")).alias("_files"))
    earlier = F.sum("_size").over(Window.partitionBy(file).orderBy("_part")) - F.col("_size")
    base = sizes.withColumn("_earlier", earlier).join(files, F.col(file) == F.col("_file")).select(file, "_part", (F.col("_files") + F.col("_earlier")).alias("_base"))
    within = rows.withColumn("_n", F.row_number().over(Window.partitionBy(file, "_part").orderBy(*order[1:])))
    return within.join(base, [file, "_part"]).withColumn(name, F.col("_base") + F.col("_n") - 1).drop("_n", "_base", "_part")


def quality_metrics() -> dict[str, Column]:
    """The counts of :func:`windows_quality` as aggregates, named ``code: issue``, for the pass that writes the events."""
    return {f"{code}: {issue}": F.count_if(F.coalesce((F.col("code") == code) & bad, F.lit(False))) for code in REQUIRED_FIELDS for issue, bad in _issues(code)}


def _issues(code: str) -> list[tuple[str, Column]]:
    empty = lambda c: F.coalesce(c, F.lit("")).isin("", "-")
    found = [("missing @timestamp", F.col("ts").isNull()), ("missing host.name", F.coalesce("host_name", F.lit("")) == ""), ("missing host.ip", F.size("host_ips") == 0)]
    return found + [(f"missing winlog.event_data.{f}", empty(F.col("src_ip") if f == "IpAddress" else F.element_at("data", f))) for f in REQUIRED_FIELDS[code]]


def windows_quality(windows: DataFrame) -> DataFrame:
    """(code, issue, n): what required parts are missing, by event code."""
    issues = [F.when((F.col("code") == code) & bad, issue) for code in REQUIRED_FIELDS for issue, bad in _issues(code)]
    return windows.select("code", F.explode(F.array_compact(F.array(*issues))).alias("issue")).groupBy("code", "issue").agg(F.count("*").alias("n"))


def windows_counts(windows: DataFrame) -> DataFrame:
    """(source_file, code, n): recognised events by file and code, with totals where a column is null."""
    return windows.cube("source_file", "code").agg(F.count("*").alias("n"))


def cloudtrail_quality(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reason, n) of rejected records, and (source_file, raw_records, accepted_records); from ``hybrid.assume_role_records``."""
    reasons = records.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    files = records.groupBy("source_file").agg(F.count("*").alias("raw_records"), F.count_if(F.col("reason").isNull()).alias("accepted_records"))
    return reasons, files
