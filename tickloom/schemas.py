"""Column lists and types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


PACKETS = struct(
    tick=L, ether_type=I, ip_proto=I, src_ip=L, dst_ip=L, total_len=I, ttl=I, frag_off=I, ihl_bytes=I,
    src_port=I, dst_port=I, tcp_flags=I, tcp_data_off_bytes=I, tcp_win=I, icmp_type=I,
)
SLOTS = struct(slot_id=I, target_ip=L, port=I, proto_kind=I, is_catchall=I, profile_name=S, name=S, detection_enabled=B)
PROFILES = struct(
    name=S, alpha=D, variance_ceiling=D, absolute_pps_threshold=D, absolute_bps_threshold=D, absolute_fps_threshold=D,
    baseline_freeze_windows=I, thaw_cooldown_windows=I, warmup_windows=I, fix_fps_source=B, fix_frag_zscore=B,
)
# The columns of records and tables, as their readers expect them.
COUNTERS = [
    "inbound_pkts", "inbound_bytes", "off_proto_pkts", "ip_frag_pkts", "out_pkts", "out_bytes", "out_tcp_pkts", "out_udp_pkts", "out_icmp_pkts",
    "tcp_pkts", "tcp_bytes", "syn_pkts", "syn_ack_pkts", "fin_ack_pkts", "rst_pkts", "ack_data_pkts", "empty_ack_pkts", "zero_window_pkts",
    "small_window_pkts", "tcp_cm_src_port_top_count", "tcp_cm_src_port_total", "udp_pkts", "udp_bytes", "udp_cm_src_port_top_count",
    "udp_cm_src_port_total", "icmp_pkts", "icmp_echo_pkts", "icmp_bytes", "other_pkts", "other_bytes",
]
MEASURES = [
    "ttl_mean", "ttl_M2", "tcp_pkt_size_mean", "tcp_pkt_size_M2", "udp_pkt_size_mean", "udp_pkt_size_M2", "est_unique_src_ips",
    "est_unique_flows", "src_24_top1_share", "src_24_entropy", "est_tcp_new_flows", "est_udp_flows", "est_other_dst_ports",
]
SNAPSHOTS = T.StructType([
    *struct(tick=L, slot_id=I, produced_ts_ns=L, registry_epoch=L, seq=L, target_ip=L, port=I, proto_kind=I, is_catchall=I, profile_name=S, window_count=L, absolute_floor_fired=I).fields,
    *(T.StructField(c, L) for c in COUNTERS), *(T.StructField(c, D) for c in MEASURES),
])
TRANSITIONS = struct(
    timestamp_ns=L, slot_id=I, target_ip=L, port=I, proto_kind=I, profile_name=S, from_phase=I, from_phase_str=S, to_phase=I, to_phase_str=S,
    tier0_score=D, tier1_final_score=D, attack_evidence=D, consecutive_attack_windows=I, absolute_floor_fired=I,
)
TEMPORAL = struct(timestamp_ns=L, slot_id=I, target_ip=L, port=I, proto_kind=I, window_seconds=I, total_pkts=L, peak_pps=L, attack_seconds=L)
_TEXTS = ("profile_name",)
_SMALL = ("slot_id", "port", "proto_kind", "is_catchall", "phase", "prev_phase", "warmup_remaining", "consecutive_attack_windows", "baseline_freeze_remaining", "thaw_cooldown_remaining", "windows_seen", "absolute_floor_fired", "dominant_channel")


def stats_type(name: str) -> T.DataType:
    """The type of a column of the statistics table."""
    if name in _TEXTS:
        return S
    if name in _SMALL:
        return I
    return D if name.startswith(("unique_", "src_24_", "ttl_mean", "ttl_stddev", "bw_", "tier")) else L


REGISTRY_EVENTS = T.StructType([
    T.StructField("timestamp_dt", T.TimestampType()), *struct(event_type=S, source_path=S).fields,
    *(T.StructField(c, L) for c in ("n_protected_ips", "n_profiles", "n_services", "n_catchalls", "n_total_slots", "reload_count", "reload_failures")),
    *struct(error_message=S, services_json_sha256=S).fields,
])
ADMIN_ACTIONS = T.StructType([T.StructField("ts_ns", L), T.StructField("ts_dt", T.TimestampType()), *struct(action=S, args_json=S, status=S, result_json=S, duration_ms=L).fields])
ANNOTATIONS = struct(transition_ts_ns=L, slot_id=I, annotated_at_ns=L, status=S, note=S)
COMMANDS = struct(tick=L, target_ip=L, port=I, proto_kind=I, action=S, args_json=S)

# The enumerations of the wire and of the tables.
PHASES = ["WARMUP", "NORMAL", "SUSPICIOUS", "ATTACK"]
KINDS = {1: "TCP", 2: "UDP", 3: "ICMP", 4: "CATCHALL_TCP", 5: "CATCHALL_UDP", 6: "CATCHALL_ICMP", 7: "CATCHALL_OTHER"}
CHANNELS = ["NONE", "PPS", "BPS", "FPS", "TCP", "UDP", "ICMP", "DIST", "L3", "OFFPROTO"]
WARMUP, NORMAL, SUSPICIOUS, ATTACK = range(4)
MAX_SLOTS, MAX_IPS, MAX_SERVICES, MAX_PROFILES = 328, 32, 200, 64
#: A dimension of this many rows or fewer is broadcast; all of the registry's are.
BROADCAST_ROWS = 10_000
