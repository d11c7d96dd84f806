"""Packet headers folded into oriented two-way flows.

``packets``: seq, ts, src_ip, src_port, dst_ip, dst_port, transport, flags, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions import scalars as S


def _ends() -> tuple[Column, Column]:
    return F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))


def flow_key(packets: DataFrame) -> DataFrame:
    """Adds ``low`` and ``high`` (the two endpoints in order) and ``up`` (sent by the low one)."""
    src, dst = _ends()
    return packets.withColumns({"low": F.least(src, dst), "high": F.greatest(src, dst), "up": src <= dst})


def fold_flows(packets: DataFrame, *also: str) -> DataFrame:
    """One row for each flow: client and server, first and last time, packets and bytes of either side.

    The client sent the first SYN; where none is seen, the first packet's sender is the client, unless
    that handshake evidence is a SYN+ACK, whose receiver is.  Counts are made against the low endpoint
    and swapped at the end, so there is one shuffle, with partial sums before it.  ``also`` names
    columns (such as the capture file) within which packets belong together.
    """
    keyed = flow_key(packets)
    syn = F.coalesce(F.col("flags").contains("S"), F.lit(False))
    ack = F.coalesce(F.col("flags").contains("A"), F.lit(False))
    sender_is_low = F.col("up")
    client_low = F.when(syn & ~ack, sender_is_low).when(syn & ack, ~sender_is_low | (F.col("low") == F.col("high")))
    same = F.col("low") == F.col("high")
    counted = keyed.groupBy("low", "high", "transport", *also).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("seq").alias("seq"),
        F.min_by(client_low, F.when(syn, F.col("seq"))).alias("shaken"),
        F.min_by(sender_is_low, "seq").alias("opened"),
        F.sum(F.when(F.col("up"), 1).otherwise(0)).alias("up_packets"),
        F.sum(F.when(F.col("up"), F.col("size")).otherwise(0)).alias("up_bytes"),
        F.count("*").alias("packets"),
        F.sum("size").alias("bytes"),
    )
    low_first = F.coalesce("shaken", "opened")
    side = lambda yes, no: F.when(same | low_first, yes).otherwise(no)
    other = lambda up, total: F.when(same, F.col(up)).otherwise(F.col(total) - F.col(up))
    return counted.select(
        *also,
        "seq",
        F.col("first_ts").alias("ts"),
        "last_ts",
        side(F.col("low"), F.col("high")).alias("client"),
        side(F.col("high"), F.col("low")).alias("server"),
        "transport",
        side(F.col("up_packets"), F.col("packets") - F.col("up_packets")).alias("client_packets"),
        side(F.col("up_bytes"), F.col("bytes") - F.col("up_bytes")).alias("client_bytes"),
        side(other("up_packets", "packets"), F.col("up_packets")).alias("server_packets"),
        side(other("up_bytes", "bytes"), F.col("up_bytes")).alias("server_bytes"),
    )


def flow_events(flows: DataFrame, observer: str = "sensor", *also: str) -> DataFrame:
    """Flows as flat network events: source is the client, destination the server, duration in nanoseconds."""
    return flows.select(
        *also,
        "seq",
        "ts",
        S.iso_text(F.col("ts")).alias("ts_raw"),
        F.lit(observer).alias("observer"),
        F.col("client.ip").alias("src_ip"),
        F.col("client.port").alias("src_port"),
        F.col("server.ip").alias("dst_ip"),
        F.col("server.port").alias("dst_port"),
        "transport",
        S.protocol_of(F.col("server.port")).alias("protocol"),
        ((F.unix_micros("last_ts") - F.unix_micros("ts")) * 1000).alias("duration_ns"),
        "client_packets",
        "client_bytes",
        "server_packets",
        "server_bytes",
        (F.col("client_packets") + F.col("server_packets")).alias("packets"),
        (F.col("client_bytes") + F.col("server_bytes")).alias("bytes"),
    )


ECS_VERSION = "8.11.0"  # fixed value: the layout's version


def to_ecs(events: DataFrame, product: str = "flow-folding", vendor: str = "trailweave", ordered: bool = False) -> DataFrame:
    """Flat flow events in the nested layout of network logs; ``ordered``: by first packet, then server port, as a log is written."""
    events = events.orderBy("ts", "dst_port", "seq") if ordered else events
    end = lambda ip, port, side: F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"), F.col(f"{side}_packets").alias("packets"), F.col(f"{side}_bytes").alias("bytes"))
    client, server = end("src_ip", "src_port", "client"), end("dst_ip", "dst_port", "server")
    one = lambda v: F.array(F.lit(v))
    event = F.struct(F.lit("event").alias("kind"), one("network").alias("category"), one("connection").alias("type"), F.lit("network_flow").alias("action"), F.lit("network_flow").alias("module"), F.lit("network_flow.flow").alias("dataset"), F.col("duration_ns").alias("duration"))
    network = F.struct("transport", "protocol", "packets", "bytes", F.lit("unknown").alias("direction"))
    return events.select(F.col("ts_raw").alias("@timestamp"), event.alias("event"), F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"), F.struct(F.col("observer").alias("hostname"), F.lit("sensor").alias("type"), F.lit(product).alias("product"), F.lit(vendor).alias("vendor")).alias("observer"), client.alias("client"), server.alias("server"), client.alias("source"), server.alias("destination"), network.alias("network"))


def load_network(packets: DataFrame, observer: str = "sensor", clock_offset: float = 0.0, evidence: DataFrame | None = None, file: str = "source_file") -> DataFrame:
    """Flow events of each capture file, clock corrected, with the file's name and hash.

    ``evidence``: (file_name, sha256) as from ``sources.records.evidence_descriptors``.
    """
    also = [file] if file in packets.columns else []
    events = flow_events(fold_flows(packets, *also), observer, *also)
    events = S.shift_timestamp(events, clock_offset) if clock_offset else events
    if evidence is not None and also:
        events = events.join(evidence.select(F.col("file_name").alias(file), F.col("sha256").alias("source_sha256")), file, "left")
    return events
