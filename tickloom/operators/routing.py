"""From packets to service slots: predicates, direction and the three-tier lookup.

The registry has at most 328 slots and 32 protected addresses (validated on load), so
every lookup is a broadcast equi-join and packets are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIN, SYN, RST, ACK = 1, 2, 4, 16


def _flag(bit: int):
    return F.col("tcp_flags").bitwiseAND(bit) != 0


def classified(packets: DataFrame) -> DataFrame:
    """IPv4 packets with their fragment, flag and payload predicates."""
    tcp = F.col("ip_proto") == 6
    payload = F.greatest(F.lit(0), F.col("total_len") - F.col("ihl_bytes") - F.col("tcp_data_off_bytes"))
    p = packets.where("ether_type = 2048").withColumns({
        "is_frag": F.col("frag_off").bitwiseAND(0x3FFF) != 0,
        "syn": tcp & _flag(SYN) & ~_flag(ACK),
        "syn_ack": tcp & _flag(SYN) & _flag(ACK),
        "fin_ack": tcp & _flag(FIN) & _flag(ACK),
        "rst": tcp & _flag(RST),
        "ack": tcp & _flag(ACK),
        "zero_window": tcp & (F.col("tcp_win") == 0),
        "echo": (F.col("ip_proto") == 1) & (F.col("icmp_type") == 8),
        "no_payload": tcp & (payload == 0),
    })
    plain = F.col("ack") & ~F.col("syn") & ~F.col("fin_ack") & ~F.col("rst")
    return p.withColumns({"ack_data": plain, "empty_ack": plain & F.col("no_payload")})


def directed(packets: DataFrame, protected: DataFrame) -> DataFrame:
    """``inbound`` is true if the destination is protected, false if only the source is; others are dropped."""
    ips = F.broadcast(protected.select(F.col("ip").alias("_ip")).distinct())
    both = packets.join(ips.withColumnRenamed("_ip", "_d"), F.col("dst_ip") == F.col("_d"), "left").join(ips.withColumnRenamed("_ip", "_s"), F.col("src_ip") == F.col("_s"), "left")
    known = both.where("_d is not null or _s is not null").withColumn("inbound", F.col("_d").isNotNull()).drop("_d", "_s")
    return known.withColumns({"service_ip": F.when(F.col("inbound"), F.col("dst_ip")).otherwise(F.col("src_ip")), "service_port": F.when(F.col("inbound"), F.col("dst_port")).otherwise(F.col("src_port"))})


def looked_up(packets: DataFrame, slots: DataFrame) -> DataFrame:
    """``slot_id``, ``proto_kind``, ``tier`` (1 exact, 2 catchall of the protocol, 3 other) and ``off_proto``; misses have a null slot."""
    named = F.broadcast(slots.where("proto_kind between 1 and 3").select(F.col("target_ip").alias("_i1"), F.col("port").alias("_p1"), F.col("proto_kind").alias("_k1"), F.col("slot_id").alias("_s1")))
    general = slots.where("proto_kind >= 4").select("target_ip", "proto_kind", "slot_id")
    second = F.broadcast(general.where("proto_kind < 7").toDF("_i2", "_k2", "_s2"))
    third = F.broadcast(general.where("proto_kind = 7").select("target_ip", "slot_id").toDF("_i3", "_s3"))
    kind = F.when(F.col("ip_proto") == 6, 1).when(F.col("ip_proto") == 17, 2).when(F.col("ip_proto") == 1, 3).otherwise(7)
    p = packets.withColumn("_kind", kind)
    p = p.join(named, (F.col("service_ip") == F.col("_i1")) & (F.col("service_port") == F.col("_p1")) & (F.col("_kind") == F.col("_k1")) & (F.col("service_port") != 0), "left")
    p = p.join(second, (F.col("service_ip") == F.col("_i2")) & (F.col("_kind") + 3 == F.col("_k2")), "left")
    p = p.join(third, F.col("service_ip") == F.col("_i3"), "left")
    tier = F.when(F.col("_s1").isNotNull(), 1).when(F.col("_s2").isNotNull(), 2).when(F.col("_s3").isNotNull(), 3)
    return p.withColumns({
        "slot_id": F.coalesce("_s1", "_s2", "_s3"),
        "tier": tier,
        "off_proto": (tier == 3) & (F.col("_kind") != 7),
        "proto_kind": F.when(tier == 1, F.col("_kind")).when(tier == 2, F.col("_kind") + 3).when(tier == 3, 7),
    }).drop("_i1", "_p1", "_k1", "_s1", "_i2", "_k2", "_s2", "_i3", "_s3", "_kind")


def routed(packets: DataFrame, slots: DataFrame, protected: DataFrame) -> DataFrame:
    """Packets with direction and slot; lookups that miss keep a null slot."""
    return looked_up(directed(classified(packets), protected), slots)


def diagnostics(packets: DataFrame, slots: DataFrame, protected: DataFrame) -> DataFrame:
    """The engine's counters over all packets."""
    n_all = packets.agg(F.count("*").alias("processed"))
    r = routed(packets, slots, protected)
    inside = F.col("inbound") & F.col("slot_id").isNotNull()
    counts = r.agg(
        F.count("*").alias("known"), *(F.count_if(inside & (F.col("tier") == t)).alias(f"tier{t}_hits") for t in (1, 2, 3)),
        F.count_if(inside & F.col("off_proto")).alias("off_proto_hits"), F.count_if(F.col("slot_id").isNull()).alias("lookup_misses"),
    )
    return n_all.crossJoin(counts).select("processed", (F.col("processed") - F.col("known")).alias("dropped"), "tier1_hits", "tier2_hits", "tier3_hits", "off_proto_hits", "lookup_misses")


ROUTED_SQL = """
routed AS (
  SELECT p.*, dst_ip IN (SELECT target_ip FROM slots) AS inbound, coalesce(s1.slot_id, s2.slot_id, s3.slot_id) AS slot_id,
    CASE WHEN s1.slot_id IS NOT NULL THEN 1 WHEN s2.slot_id IS NOT NULL THEN 2 WHEN s3.slot_id IS NOT NULL THEN 3 END AS tier,
    coalesce(s1.proto_kind, s2.proto_kind, s3.proto_kind) AS proto_kind,
    s1.slot_id IS NULL AND s2.slot_id IS NULL AND s3.slot_id IS NOT NULL AND ip_proto IN (6, 17, 1) AS off_proto
  FROM (
    SELECT *, CASE WHEN dst_ip IN (SELECT target_ip FROM slots) THEN dst_ip ELSE src_ip END AS service_ip,
      CASE WHEN dst_ip IN (SELECT target_ip FROM slots) THEN dst_port ELSE src_port END AS service_port,
      CASE ip_proto WHEN 6 THEN 1 WHEN 17 THEN 2 WHEN 1 THEN 3 ELSE 7 END AS kind,
      (frag_off & 16383) <> 0 AS is_frag, ip_proto = 6 AND (tcp_flags & 18) = 2 AS syn, ip_proto = 6 AND (tcp_flags & 18) = 18 AS syn_ack,
      ip_proto = 6 AND (tcp_flags & 17) = 17 AS fin_ack, ip_proto = 6 AND (tcp_flags & 4) = 4 AS rst, ip_proto = 6 AND (tcp_flags & 16) = 16 AS ack,
      ip_proto = 6 AND tcp_win = 0 AS zero_window, ip_proto = 1 AND icmp_type = 8 AS echo,
      ip_proto = 6 AND greatest(0, total_len - ihl_bytes - tcp_data_off_bytes) = 0 AS no_payload
    FROM packets WHERE ether_type = 2048 AND (dst_ip IN (SELECT target_ip FROM slots) OR src_ip IN (SELECT target_ip FROM slots))
  ) p
  LEFT JOIN slots s1 ON s1.target_ip = service_ip AND s1.port = service_port AND s1.proto_kind = kind AND service_port <> 0 AND kind <> 7
  LEFT JOIN slots s2 ON s2.target_ip = service_ip AND s2.proto_kind = kind + 3 AND kind <> 7
  LEFT JOIN slots s3 ON s3.target_ip = service_ip AND s3.proto_kind = 7
)"""
