"""Fact rows from detected windows: wide statistics, phase transitions, rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import channel_name, kind_name, long_to_ip, phase_name, sample_sd, seconds_of, ttl_sums
from tickloom.operators.windows import WINDOWS, numbered, temporal
from tickloom.schemas import TEMPORAL, TRANSITIONS

# The columns of the statistics table, as its readers expect them.
STATS_COLUMNS = [
    "timestamp_ns", "slot_id", "sequence_num", "target_ip", "port", "proto_kind", "is_catchall", "profile_name", "phase", "prev_phase", "warmup_remaining",
    "consecutive_attack_windows", "baseline_freeze_remaining", "thaw_cooldown_remaining", "windows_seen", "absolute_floor_fired",
    "inbound_pkts", "inbound_bytes", "off_proto_pkts", "ip_frag_pkts", "ttl_sum", "ttl_sum_sq", "out_pkts", "out_bytes", "out_tcp_pkts", "out_udp_pkts", "out_icmp_pkts",
    "tcp_pkts", "tcp_bytes", "syn_pkts", "syn_ack_pkts", "fin_ack_pkts", "rst_pkts", "ack_data_pkts", "empty_ack_pkts", "zero_window_pkts", "udp_pkts", "udp_bytes", "icmp_pkts",
    "unique_src_ips", "unique_flows", "src_24_top1_share", "src_24_entropy", "ttl_mean", "ttl_stddev", "bw_pps_z_last", "bw_bps_z_last",
    "tier0_score", "tier1_tcp_score", "tier1_udp_score", "tier1_icmp_score", "tier1_dist_score", "tier1_l3_score", "tier1_offproto_score", "tier1_final_score",
    *(f"win_{n}s_{c}" for n in WINDOWS for c in ("total_pkts", "peak_pps", "attack_seconds")),
    "tier0_risk_pps", "tier0_risk_bps", "tier0_risk_fps", "tier0_risk_burst_pps", "tier0_risk_burst_bps", "tier0_risk_burst_fps", "dominant_channel",
]
DERIVED_COLUMNS = ["timestamp_dt", "target_ip_str", "proto_kind_str", "phase_str", "dominant_channel_str", "event_date"]


def with_derived(stats: DataFrame) -> DataFrame:
    """Columns that the table computes on write, and the day that it is partitioned by."""
    return stats.withColumns({
        "timestamp_dt": seconds_of(F.col("timestamp_ns")), "target_ip_str": long_to_ip(F.col("target_ip")), "proto_kind_str": kind_name(F.col("proto_kind")),
        "phase_str": phase_name(F.col("phase")), "dominant_channel_str": channel_name(F.col("dominant_channel")), "event_date": F.to_date(seconds_of(F.col("timestamp_ns"))),
    })


def service_stats(detected: DataFrame) -> DataFrame:
    """The wide row of each slot and tick, with its rolling windows."""
    d = numbered(temporal(detected, ["slot_id"]))
    total, squares = ttl_sums(F.col("ttl_mean"), F.col("ttl_M2"), F.col("inbound_pkts"))
    named = {
        "timestamp_ns": F.col("produced_ts_ns"), "absolute_floor_fired": F.col("floor_fired_now"), "ttl_sum": total, "ttl_sum_sq": squares,
        "unique_src_ips": F.col("est_unique_src_ips"), "unique_flows": F.col("est_unique_flows"), "ttl_stddev": sample_sd(F.col("ttl_M2"), F.col("inbound_pkts")),
        **{f"tier1_{c}_score": F.col(f"t1_{c}") for c in ("tcp", "udp", "icmp", "dist", "l3", "offproto", "final")},
        **{f"tier0_risk_{c}": F.col(f"r_{c}") for c in ("pps", "bps", "fps", "burst_pps", "burst_bps", "burst_fps")},
    }
    return d.withColumns(named).select(*STATS_COLUMNS)


def transitions(stats: DataFrame) -> DataFrame:
    """A row for each change of a slot's phase; its first window makes none."""
    before = F.lag("phase").over(Window.partitionBy("slot_id").orderBy("timestamp_ns"))
    t = stats.withColumn("from_phase", before).where("from_phase is not null and from_phase <> phase").withColumn("to_phase", F.col("phase"))
    t = t.withColumns({"from_phase_str": phase_name(F.col("from_phase"), True), "to_phase_str": phase_name(F.col("to_phase"), True), "attack_evidence": F.greatest("tier0_score", "tier1_final_score")})
    return t.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSITIONS.fields))


def dated(rows: DataFrame) -> DataFrame:
    """Rows with the second and the day of their ``timestamp_ns``, by which tables are filtered and partitioned."""
    at = seconds_of(F.col("timestamp_ns"))
    return rows.withColumns({"timestamp_dt": at, "event_date": F.to_date(at)})


def temporal_rows(stats: DataFrame) -> DataFrame:
    """Three rows for each window's three rolling totals."""
    each = F.array(*(F.struct(F.lit(n).alias("window_seconds"), *(F.col(f"win_{n}s_{c}").alias(c) for c in ("total_pkts", "peak_pps", "attack_seconds"))) for n in WINDOWS))
    t = stats.select("timestamp_ns", "slot_id", "target_ip", "port", "proto_kind", F.inline(each))
    return t.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TEMPORAL.fields))


def differences(ours: DataFrame, theirs: DataFrame, exact: list[str], close: list[str], keys: tuple[str, ...] = ("slot_id", "timestamp_ns"), tolerance: float = 1e-9) -> DataFrame:
    """(keys, field, ours, theirs) wherever two results differ: some fields exactly, some beyond a tolerance."""
    a = ours.select(*keys, *(F.col(c).alias(f"a_{c}") for c in exact + close))
    b = theirs.select(*keys, *(F.col(c).alias(f"b_{c}") for c in exact + close))
    apart = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tolerance + tolerance * F.greatest(F.abs(f"a_{c}"), F.abs(f"b_{c}"))
    pairs = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").cast("double").alias("ours"), F.col(f"b_{c}").cast("double").alias("theirs"))) for c in exact]
    pairs += [F.when(apart(c), F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").cast("double").alias("ours"), F.col(f"b_{c}").cast("double").alias("theirs"))) for c in close]
    return a.join(b, list(keys)).select(*keys, F.explode(F.array_compact(F.array(*pairs))).alias("d")).select(*keys, "d.*")
