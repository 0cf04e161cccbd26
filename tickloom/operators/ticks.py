"""One-second windows: counters, moments, the dense spine and whole snapshot records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import absolute_floor
from tickloom.operators import sketches
from tickloom.schemas import BROADCAST_ROWS, COUNTERS, MEASURES, SNAPSHOTS

TCP_KINDS, UDP_KINDS, ICMP_KINDS = (1, 4, 7), (2, 5, 7), (3, 6, 7)


def counter_aggregates() -> list[Column]:
    """Counters and moments of a slot's packets in a tick; an arm fills only if packet and slot agree on it."""
    inside, outside = F.col("inbound"), ~F.col("inbound")
    tcp = inside & (F.col("ip_proto") == 6) & F.col("proto_kind").isin(*TCP_KINDS)
    udp = inside & (F.col("ip_proto") == 17) & F.col("proto_kind").isin(*UDP_KINDS)
    icmp = inside & (F.col("ip_proto") == 1) & F.col("proto_kind").isin(*ICMP_KINDS)
    other = inside & ~F.col("ip_proto").isin(6, 17, 1) & (F.col("proto_kind") == 7)
    size = F.col("total_len").cast("long")
    n = lambda cond, name: F.count_if(cond).alias(name)
    octets = lambda cond, name: F.coalesce(F.sum(F.when(cond, size)), F.lit(0).cast("long")).alias(name)

    def moments(cond: Column, x: str, name: str) -> list[Column]:
        v = F.when(cond, F.col(x).cast("double"))
        return [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{name}_mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"{name}_M2")]

    return [
        n(inside, "inbound_pkts"), octets(inside, "inbound_bytes"), n(inside & F.col("off_proto"), "off_proto_pkts"), n(inside & F.col("is_frag"), "ip_frag_pkts"),
        *moments(inside, "ttl", "ttl"), n(outside, "out_pkts"), octets(outside, "out_bytes"),
        *(n(outside & (F.col("ip_proto") == p), f"out_{name}_pkts") for p, name in ((6, "tcp"), (17, "udp"), (1, "icmp"))),
        n(tcp, "tcp_pkts"), octets(tcp, "tcp_bytes"), *(n(tcp & F.col(c), f"{c}_pkts") for c in ("syn", "syn_ack", "fin_ack", "rst", "ack_data", "empty_ack", "zero_window")),
        F.lit(0).cast("long").alias("small_window_pkts"), *moments(tcp, "total_len", "tcp_pkt_size"),
        n(udp, "udp_pkts"), octets(udp, "udp_bytes"), *moments(udp, "total_len", "udp_pkt_size"),
        n(icmp, "icmp_pkts"), octets(icmp, "icmp_bytes"), n(icmp & F.col("echo"), "icmp_echo_pkts"), n(other, "other_pkts"), octets(other, "other_bytes"),
    ]


def counters(routed: DataFrame) -> DataFrame:
    """One row for each tick and slot that saw a packet."""
    return routed.where("slot_id is not null").groupBy("tick", "slot_id").agg(*counter_aggregates())


def protocol_counts(routed: DataFrame) -> DataFrame:
    """(tick, slot_id, counts): packets by IP protocol of those outside TCP, UDP and ICMP on OTHER slots."""
    r = routed.where("inbound and proto_kind = 7 and ip_proto not in (6, 17, 1)").groupBy("tick", "slot_id", "ip_proto").agg(F.count("*").alias("n"))
    return r.groupBy("tick", "slot_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ip_proto", "n")))).alias("counts"))  # 256 protocols at most


def spine(ticks: DataFrame, slots: DataFrame) -> DataFrame:
    """Every slot at every tick from the first to the last: a slot reports in every tick, if only zeros."""
    span = ticks.agg(F.min("tick").alias("a"), F.max("tick").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z")).alias("tick"))
    return span.repartition("tick").crossJoin(F.broadcast(slots))


def snapshots(routed: DataFrame, slots: DataFrame, profiles: DataFrame, scope: str = "bank", epoch_s: int = 0, registry_epoch: int = 1) -> DataFrame:
    """Whole snapshot records on the dense spine."""
    if slots.count() > BROADCAST_ROWS:
        raise ValueError("a registry has at most a few hundred slots")
    base = counters(routed)
    rows = spine(base, slots.select("slot_id", "target_ip", "port", "proto_kind", "is_catchall", "profile_name"))
    for part in (base, sketches.measured(routed, scope)):
        rows = rows.join(part, ["tick", "slot_id"], "left")
    if scope != "window":  # a published sketch stays as it was while nothing is added
        so_far = Window.partitionBy("slot_id", F.col("tick") % 2 if scope == "bank" else F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in sketches.SKETCHED})
    rows = rows.na.fill(0, COUNTERS).na.fill(0.0, MEASURES)
    limits = F.broadcast(profiles.select(F.col("name").alias("profile_name"), "absolute_pps_threshold", "absolute_bps_threshold", "absolute_fps_threshold"))
    floor = absolute_floor(F.col("inbound_pkts"), F.col("inbound_bytes"), F.col("est_unique_flows"), *(F.coalesce(f"absolute_{x}_threshold", F.lit(0.0)) for x in ("pps", "bps", "fps")))
    full = rows.join(limits, "profile_name", "left").withColumns({
        "produced_ts_ns": (F.col("tick") + epoch_s) * 1_000_000_000,
        "registry_epoch": F.lit(registry_epoch).cast("long"), "seq": F.col("tick") + 1,
        "profile_name": F.substring("profile_name", 1, 8), "window_count": F.floor((F.col("tick") + 2) / 2).cast("long"),
        "absolute_floor_fired": floor.cast("int"),
    })
    return full.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SNAPSHOTS.fields))


def _n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


def _sum(cond: str, name: str) -> str:
    return f"CAST(coalesce(sum(total_len) FILTER (WHERE {cond}), 0) AS BIGINT) AS {name}"


def _moments(cond: str, x: str, name: str) -> str:
    return f"coalesce(avg({x}) FILTER (WHERE {cond}), 0) AS {name}_mean, coalesce(var_pop({x}) FILTER (WHERE {cond}) * count(*) FILTER (WHERE {cond}), 0) AS {name}_M2"


_IN, _OUT = "inbound", "NOT inbound"
_TCP, _UDP = "inbound AND ip_proto = 6 AND proto_kind IN (1, 4, 7)", "inbound AND ip_proto = 17 AND proto_kind IN (2, 5, 7)"
_ICMP, _OTHER = "inbound AND ip_proto = 1 AND proto_kind IN (3, 6, 7)", "inbound AND ip_proto NOT IN (6, 17, 1) AND proto_kind = 7"
_PLAIN = "ack AND NOT syn AND NOT fin_ack AND NOT rst"
COUNTERS_SQL = f"""
counters AS (
  SELECT tick, slot_id, {_n(_IN, "inbound_pkts")}, {_sum(_IN, "inbound_bytes")}, {_n(_IN + " AND off_proto", "off_proto_pkts")}, {_n(_IN + " AND is_frag", "ip_frag_pkts")},
    {_moments(_IN, "ttl", "ttl")}, {_n(_OUT, "out_pkts")}, {_sum(_OUT, "out_bytes")},
    {", ".join(_n(f"{_OUT} AND ip_proto = {p}", f"out_{name}_pkts") for p, name in ((6, "tcp"), (17, "udp"), (1, "icmp")))},
    {_n(_TCP, "tcp_pkts")}, {_sum(_TCP, "tcp_bytes")}, {", ".join(_n(f"{_TCP} AND {c}", f"{c}_pkts") for c in ("syn", "syn_ack", "fin_ack", "rst"))},
    {_n(f"{_TCP} AND {_PLAIN}", "ack_data_pkts")}, {_n(f"{_TCP} AND {_PLAIN} AND no_payload", "empty_ack_pkts")}, {_n(f"{_TCP} AND zero_window", "zero_window_pkts")},
    0::BIGINT AS small_window_pkts, {_moments(_TCP, "total_len", "tcp_pkt_size")}, {_n(_UDP, "udp_pkts")}, {_sum(_UDP, "udp_bytes")}, {_moments(_UDP, "total_len", "udp_pkt_size")},
    {_n(_ICMP, "icmp_pkts")}, {_sum(_ICMP, "icmp_bytes")}, {_n(_ICMP + " AND echo", "icmp_echo_pkts")}, {_n(_OTHER, "other_pkts")}, {_sum(_OTHER, "other_bytes")}
  FROM routed WHERE slot_id IS NOT NULL GROUP BY tick, slot_id
)"""
