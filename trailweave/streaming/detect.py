"""Streaming forms of flow folding, detections and edges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trailweave.functions import scalars as S
from trailweave.operators import detections
from trailweave.operators import edges as E
from trailweave.operators import flows as FL

IDLE_SECONDS = 60


def live_flow_fold(packets: DataFrame, idle: str = "60 seconds", lateness: str = "30 seconds") -> DataFrame:
    """Flows that end after ``idle`` without a packet; on a stream (append mode) and on a table alike.

    A port pair used again later is a new flow.  Packets later than the watermark are dropped.
    """
    keyed = FL.flow_key(packets.withWatermark("ts", lateness) if packets.isStreaming else packets)
    syn = F.coalesce(F.col("flags").contains("S"), F.lit(False))
    ack = F.coalesce(F.col("flags").contains("A"), F.lit(False))
    client_low = F.when(syn & ~ack, F.col("up")).when(syn & ack, ~F.col("up"))
    found = keyed.groupBy(F.session_window("ts", idle).alias("session"), "low", "high", "transport").agg(
        F.min("ts").alias("ts"),
        F.max("ts").alias("last_ts"),
        F.min("seq").alias("seq"),
        F.min_by(client_low, F.when(syn, F.col("seq"))).alias("shaken"),
        F.min_by("up", "seq").alias("opened"),
        F.sum(F.when(F.col("up"), 1).otherwise(0)).alias("up_packets"),
        F.count("*").alias("packets"),
        F.sum("size").alias("bytes"),
    )
    low_first = F.coalesce("shaken", "opened")
    side = lambda yes, no: F.when(low_first, yes).otherwise(no)
    return found.select(
        "seq",
        "ts",
        "last_ts",
        side(F.col("low"), F.col("high")).alias("client"),
        side(F.col("high"), F.col("low")).alias("server"),
        "transport",
        side(F.col("up_packets"), F.col("packets") - F.col("up_packets")).alias("client_packets"),
        side(F.col("packets") - F.col("up_packets"), F.col("up_packets")).alias("server_packets"),
        "packets",
        "bytes",
    )


def live_rc4_tgt(events: DataFrame) -> DataFrame:
    """Stateless, so without watermark; ``live_alerts`` sets one."""
    return detections.rc4_tgt(events)


def live_encoded_powershell(events: DataFrame) -> DataFrame:
    """Stateless, so without order: each event is judged as it comes."""
    return detections.encoded_powershell(events, ordered=False)


def live_alerts(alerts: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each alert once, by its id, for as long as ``lateness``."""
    return detections.dedupe_alerts(alerts.withWatermark("ts", lateness))


def live_port_fan_out(flows: DataFrame, threshold: int = detections.FAN_OUT, length: str = "10 minutes", slide: str | None = "5 minutes", lateness: str = "1 minute", approximate: bool = False) -> DataFrame:
    """Fan-out in look-back windows; a window's row comes when the watermark has passed it.  State: a set (or sketch) of ports for each pane, then for each window."""
    return detections.port_fan_out_windowed(flows.withWatermark("ts", lateness) if flows.isStreaming else flows, threshold, length, slide, approximate)


class SequenceMachine(StatefulProcessor):
    """The pending sequences of a key, and the events that still wait for their turn.

    Events come in any order within the watermark's lateness.  They wait in a list; a timer at the earliest of
    them fires when the watermark has passed it, when no earlier event can come any more, and all that the watermark
    has passed are taken in order of (time, number, stage).  ``pending[k]``: time and numbers of the latest
    sequence that has passed stage k; a key without waiting events is forgotten a span after its last one.
    """

    def __init__(self, n_stages: int, span_micros: int):
        self.n_stages, self.span = n_stages, span_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, stage int")
        self.pending = handle.getValueState("pending", "latest long, begun array<long>, seqs array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r.at, r.seq, r.stage) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(at for at, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [e for e in events if e[0] <= passed], [e for e in events if e[0] > passed]
        if not ready and (rest or not self.pending.exists() or self.pending.get()[0] + self.span >= passed):
            if rest:
                self._wake(rest[0][0])
            return
        latest, begun, seqs = self.pending.get() if self.pending.exists() else (0, [None] * (self.n_stages - 1), [""] * (self.n_stages - 1))
        begun, seqs = list(begun), list(seqs)
        for at, seq, stage in ready:
            latest = at
            if stage:
                since, said, begun[stage - 1] = begun[stage - 1], seqs[stage - 1], None
                if since is None or at - since > self.span:
                    continue
                said = f"{said},{seq}"
            else:
                since, said = at, str(seq)
            if stage == self.n_stages - 1:
                yield Row(key=key[0], seqs=said)
            else:
                begun[stage], seqs[stage] = since, said
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        if rest or latest + self.span >= passed:
            self.pending.update((latest, begun, seqs))
            self._wake(latest + self.span + 1)
        else:
            self.pending.clear()

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def live_sequence(events: DataFrame, n_stages: int, max_span_seconds: float, lateness: str = "1 minute") -> DataFrame:
    """(key, seqs): ordered sequences on a stream of (key, ts, seq, stage), ``stage`` from 0, as ``operators.sequences`` finds them in a table.

    Events may come out of order within ``lateness``; a sequence comes when the watermark has passed its last event.
    Rows with a null key, time or stage match nothing.  Runs with the RocksDB state store (see ``run.drain``).
    """
    timed = events.withWatermark("ts", lateness).where("key is not null and ts is not null and stage is not null")
    timed = timed.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("stage").cast("int").alias("stage"))
    machine = SequenceMachine(n_stages, int(max_span_seconds * 1_000_000))
    return timed.groupBy("key").transformWithState(machine, "key string, seqs string", "Append", "EventTime")


_KNOWN = "struct<a: long, b: long, who: string, ref: string>"  # what decides among facts, the least first
_LOGON = "struct<ts: timestamp, ts_raw: string, host_name: string, src_ip: string, identity: string, logon_id: string, ref: string, service: string>"
_ITEM = f"struct<part: long, at: long, asks: boolean, seq: long, target_ip: string, logon: {_LOGON}, first: {_KNOWN}, one: string, last: string>"


def _sweep(asks: Column, facts: Column, width: Column) -> Column:
    """Answers (seq, target_ip, logon, first, one, last) to the questions of a group: the least ``first`` and ``one`` and the greatest ``last`` of the facts in their windows.

    ``asks``: array of (low, seq, target_ip, logon); facts count from ``low`` to ``low + width``.  ``facts``: array of (at, first, session).
    As in ``edges.in_window`` such a window is the end of one stretch of ``width`` and the beginning of the next, so running minima from
    either end of the stretches answer every question, in up to two parts.  They are made by rounds that look 1, 2, 4 ... places back in
    the sorted array: n questions and facts take about n log n steps, and pairs are never made.
    """
    slot = lambda at: F.floor(at / F.greatest(width, F.lit(1)))
    null = F.lit(None)
    item = lambda at, way, slot, *rest: F.struct(2 * slot + max(way, 0), at * way, *rest).cast(_ITEM)
    mark = lambda q, at, way, slot: item(at, way, slot, F.lit(True), q["seq"], q["target_ip"], q["logon"], null, null, null)
    fact = lambda f, way: item(f["at"], way, slot(f["at"]), F.lit(False), null, null, null, f["first"], f["session"], f["session"])
    marks = F.transform(asks, lambda q: F.array(mark(q, q["low"] + width, 1, slot(q["low"]) + 1), mark(q, q["low"], -1, slot(q["low"]))))
    both = F.transform(facts, lambda f: F.array(fact(f, 1), fact(f, -1)))
    n, lag = 2 * (F.size(asks) + F.size(facts)), F.array(*[F.lit(1 << j) for j in range(31)])
    held = lambda x, y: F.struct(x["asks"].alias("asks"), x["part"].alias("part"), x["seq"].alias("seq"), x["target_ip"].alias("target_ip"), x["logon"].alias("logon"), F.least(x["first"], y["first"]).alias("first"), F.least(x["one"], y["one"]).alias("one"), F.greatest(x["last"], y["last"]).alias("last"))
    look = lambda acc, back: F.transform(acc, lambda x, i: F.when(F.get(acc, i - back)["part"] == x["part"], held(x, F.get(acc, i - back))).otherwise(x))
    begun = F.transform(F.sort_array(F.concat(F.flatten(marks), F.flatten(both))), lambda x: held(x, x))
    return F.filter(F.aggregate(F.filter(lag, lambda back: back < n), begun, look), lambda x: x["asks"] & x["first"].isNotNull())


def live_edges(
    logons: DataFrame, flows: DataFrame, privs: DataFrame, creds: DataFrame, ip_map: DataFrame,
    flow_window: float = E.FLOW_WINDOW, privilege_window: float = E.PRIVILEGE_WINDOW, credential_window: float = E.CREDENTIAL_WINDOW, lateness: str = "1 minute",
) -> DataFrame:
    """Edges of a stream (append mode), as ``operators.edges.materialize_edges`` makes them of tables, with ``seq`` and ``ts`` of the logon.

    Inputs are those of ``operators.edges``; ``ip_map`` is a table.  Time goes on with the slowest input: one
    that is silent, or gives only rows that can't match (Spark filters those before it looks at their time), holds the edges back.
    Logons ask for the latest flow, the first privilege and the sessions of the credential uses under equal keys.  Questions and facts
    are gathered by key and time bin: bins are as long as the longest window, and a logon's bin reaches from the one before its own to the one after,
    so it holds all that may bear on it.  When the watermark has passed a bin, one stream-stream join brings the questions of a key to its facts, a sweep
    (:func:`_sweep`) answers them without pairs, so work and state grow with the events also where they grow denser, and one aggregation for each logon
    makes the edge: once to twice the longest window after the logon.  Of equal edges one stays for as long as ``lateness`` after its bin.
    """
    micros = {"flow": int(flow_window * 1_000_000), "privilege": int(privilege_window * 1_000_000), "credential": int(credential_window * 1_000_000)}
    widest = max(1, *micros.values())
    place = F.floor((F.unix_micros("ts") - F.unix_micros("bin.start")) / widest)
    binned = lambda df, *places: df.withWatermark("ts", lateness).withColumn("bin", F.window("ts", f"{3 * widest} microseconds", f"{widest} microseconds")).where(place.isin(*places))
    key = lambda kind, **parts: F.to_json(F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for n, c in parts.items()]))  # null parts are left out and meet each other
    names = E.host_names(ip_map)
    mapped = lambda df, ip, name: df.join(names.select(F.col("ip").alias(f"{name}_ip"), F.col("host").alias(name)), F.col(ip) == F.col(f"{name}_ip"), "left").drop(f"{name}_ip")
    table = names.select(F.struct("ip", "host").alias("x")).agg(F.map_from_entries(F.collect_list("x")).alias("m")).scalar()  # the address map, as small as a document
    grouped = lambda df, what: df.groupBy("kind", "key", "bin").agg(F.collect_list(what).alias(what))

    base = binned(logons, 1).withColumn("target_ip", F.explode(F.array_distinct("host_ips"))).withColumn("service", S.service_of_logon_type(F.col("logon_type"))).where("service is not null and target_ip is not null")
    base = mapped(base, "target_ip", "target_mapped")
    at, t = F.unix_micros("ts"), F.col("target_ip")
    ask = lambda kind, k, low, logon=F.lit(None).cast(_LOGON): F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.struct(low.alias("low"), "seq", "target_ip", logon.alias("logon")).alias("asks"))  # noqa: E731, B008
    whole = F.struct("ts", "ts_raw", "host_name", "src_ip", "identity", "logon_id", "ref", "service").cast(_LOGON)
    about = [
        ask("flow", key("flow", src=F.col("src_ip"), dst=t, service=F.col("service")), at - micros["flow"], whole),
        ask("privilege", key("privilege", session=F.col("logon_id"), who=F.col("identity"), ip=t), at),
    ]
    uses = F.transform(S.host_keys(F.col("host_name"), F.col("target_mapped"), t), lambda name: ask("credential", F.when(F.col("src_ip").isNotNull(), key("credential", ip=F.col("src_ip"), who=F.col("identity"), name=name)), at - micros["credential"]))
    asks = grouped(base.select("bin", F.inline(F.concat(F.array(*about), uses))).where("key is not null"), "asks")

    known = lambda a, b, who=None: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(None).cast("string").alias("who") if who is None else F.col(who).alias("who"), "ref").cast(_KNOWN)
    fact = lambda df, kind, k, first, session=None: df.select(F.lit(kind).alias("kind"), k.alias("key"), "bin", F.struct(at.alias("at"), first.alias("first"), (F.lit(None) if session is None else F.col(session)).cast("string").alias("session")).alias("facts"))
    f = binned(flows, 0, 1).withColumn("service", S.service_of_port(F.col("dst_port"))).where("dst_ip is not null and service is not null")
    p = binned(privs, 1, 2).withColumn("ip", F.explode(F.array_distinct("host_ips"))).where("ip is not null")
    c = binned(creds, 0, 1).where("coalesce(subject_logon_id, '') != ''").withColumn("ip", F.explode(F.array_distinct("host_ips"))).where("ip is not null")
    server = F.trim("target_server")
    served = F.when(F.coalesce("target_server", F.lit("")) != "", S.host_keys(server, F.element_at(F.col("map"), server), server)).otherwise(F.array(F.lit("")))  # a use without a server has a name that no logon has: its time counts
    c = c.withColumn("map", table).withColumn("name", F.explode(served))
    facts = fact(f, "flow", key("flow", src=F.col("src_ip"), dst=F.col("dst_ip"), service=F.col("service")), known(-at, -F.col("seq")))
    facts = facts.unionByName(fact(p, "privilege", key("privilege", session=F.col("logon_id"), who=F.col("identity"), ip=F.col("ip")), known(F.col("seq"), F.lit(0))))
    facts = facts.unionByName(fact(c, "credential", key("credential", ip=F.col("ip"), who=F.col("target_identity"), name=F.col("name")), known(at, F.col("seq"), "subject_identity"), "subject_logon_id"))
    every = asks.join(grouped(facts, "facts"), ["kind", "key", "bin"])
    width = F.when(F.col("kind") == "flow", micros["flow"]).when(F.col("kind") == "privilege", micros["privilege"]).otherwise(micros["credential"])
    every = every.select("kind", "bin", F.inline(_sweep(F.col("asks"), F.col("facts"), width)))

    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    found = every.groupBy("seq", "bin").agg(
        F.first("logon", ignorenulls=True).alias("logon"),
        F.min(of("flow", F.struct("first", "target_ip"))).alias("flow"),
        F.min(of("privilege", F.col("first"))).alias("privilege"),
        F.collect_list(of("credential", F.struct("target_ip", "first", "one", "last"))).alias("uses"),
    )
    found = found.where("flow is not null").select("seq", F.window_time("bin").alias("passed"), "logon.*", F.col("privilege").isNotNull().alias("privileged"), F.col("privilege.ref").alias("privilege_ref"), F.col("flow.first.ref").alias("flow_ref"), "flow.target_ip", "uses")
    found = mapped(found, "src_ip", "mapped").withColumn("uses", F.filter("uses", lambda u: u["target_ip"].eqNullSafe(F.col("target_ip"))))
    of_uses = lambda name: F.transform("uses", lambda u: u[name])
    found = found.withColumns({"first": F.array_min(of_uses("first")), "one": F.array_min(of_uses("one")), "single": F.array_min(of_uses("one")) == F.array_max(of_uses("last"))})
    transition = F.when(F.col("single").isNotNull(), F.struct(F.col("first.who").alias("from_identity"), F.col("identity").alias("to_identity"), F.when(F.col("single"), "confirmed").otherwise("unknown").alias("state"), F.col("first.ref").alias("evidence_ref")))
    found = found.withColumns({"edge_id": S.edge_id(F.col("host_name"), F.col("identity"), F.col("logon_id"), F.col("ts_raw"), F.col("src_ip")), "credential_transition": transition, "source_logon_id": F.when(F.col("single"), F.col("one"))})
    return E.edge_columns(found.dropDuplicatesWithinWatermark(["edge_id"]) if logons.isStreaming else found.dropDuplicates(["edge_id"]))
