"""Security evidence projected from the ``events`` table, for queries on driver tables.

Views are flows, clicks are logons, signups special privileges, errors explicit credentials and
purchases process starts.  The same projection in SQL is ``queries.BASE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import scalars as S
from trailweave.operators.policy import Context
from trailweave.sources.context import context_from_rows, local_table

WINDOW = 12 * 3600  # seconds; the table is sparse


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


class Evidence:
    def __init__(self, spark: SparkSession, sf_dir: str):
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"), "event_type", k.alias("k"))
        u = F.col("u")
        k = F.col("k")
        self.events = e
        port = F.when(k % 3 == 0, 3389).when(k % 3 == 1, 445).otherwise(443)
        host_ip, from_ip = _text("10.0.0.", k % 5), _text("10.0.0.", u % 5)
        identity, session = _text("CORP\\u", u % 20), _text("0x", u % 20)
        ref = _text("e", F.col("seq"))
        of = lambda kind: e.where(F.col("event_type") == kind)
        self.flows = of("view").select("seq", "ts", from_ip.alias("src_ip"), host_ip.alias("dst_ip"), port.alias("dst_port"), F.lit("tcp").alias("transport"), S.protocol_of(port).alias("protocol"), ref.alias("ref"))
        self.logons = of("click").select("seq", "ts", _text("t", F.col("seq")).alias("ts_raw"), _text("H", k % 5).alias("host_name"), F.array(host_ip).alias("host_ips"), from_ip.alias("src_ip"), identity.alias("identity"), session.alias("logon_id"), F.when(k % 2 == 0, "10").otherwise("3").alias("logon_type"), ref.alias("ref"))
        self.privs = of("signup").select("seq", "ts", F.array(host_ip).alias("host_ips"), identity.alias("identity"), session.alias("logon_id"), ref.alias("ref"))
        self.creds = of("error").select("seq", "ts", F.array(host_ip).alias("host_ips"), _text("CORP\\u", (u + 1) % 20).alias("subject_identity"), identity.alias("target_identity"), _text("0x", u % 40).alias("subject_logon_id"), F.concat(_text("h", u % 5), F.lit(".corp.example")).alias("target_server"), ref.alias("ref"))
        self.ip_map = local_table(spark, [(f"10.0.0.{i}", f"H{i}") for i in range(5)], "ip string, host string")
        self.sequence_events = e.select(
            "seq",
            "ts",
            F.when(F.col("event_type") == "view", "network").when(F.col("event_type") == "purchase", "process").otherwise("authentication").alias("category"),
            F.when(F.col("event_type") == "click", "4624").when(F.col("event_type") == "signup", "4672").when(F.col("event_type") == "error", "4648").alias("code"),
            F.when(F.col("event_type") == "purchase", "start").alias("type"),
            F.lit("success").alias("outcome"),
            F.when(k % 2 == 0, "10").otherwise("3").alias("logon_type"),
            F.lit("tcp").alias("transport"),
            port.alias("dst_port"),
            S.protocol_of(port).alias("protocol"),
            from_ip.alias("ip_address"),
            host_ip.alias("dst_ip"),
            host_ip.alias("host_ip"),
            _text("H", k % 5).alias("computer_name"),
            identity.alias("target_user"),
            identity.alias("user_name"),
        )
        self.packets = e.select(
            "seq",
            "ts",
            from_ip.alias("src_ip"),
            (F.lit(1000) + u % 7).cast("int").alias("src_port"),
            host_ip.alias("dst_ip"),
            port.cast("int").alias("dst_port"),
            F.when(k % 11 == 0, "udp").otherwise("tcp").alias("transport"),
            F.when(F.col("event_type") == "signup", "S").when(F.col("event_type") == "purchase", "SA").when(k % 11 != 0, "A").alias("flags"),
            (F.lit(60) + k).alias("size"),
        )


def context(spark: SparkSession) -> Context:
    """Declared and undeclared hosts and identities; see ``queries.CONTEXT``."""
    users = [f"CORP\\u{i}" for i in range(18)]
    return context_from_rows(
        spark,
        hosts=[("H0", 0, True), ("H1", 0, False), ("H2", 1, False), ("H3", 2, False)],
        identities=[(u, i % 3) for i, u in enumerate(users)],
        policy=[("2024-01-01", "2024-01-20")],
        complete_for=[("on_prem", u, 0) for u in users[:10]],
        approved_paths=[(u, "H1", 0) for u in users[:5]],
        approved_changes=[(users[6], "H2", "2024-01-01", "2024-01-15", None, None), (users[7], "H2", None, None, "H3", None), (users[8], "H3", None, None, None, "smb")],
        known_edges=[(u, f"H{i % 4}") for i, u in enumerate(users)],
    )
