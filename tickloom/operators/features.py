"""What a detector reads from a snapshot record, as native columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import absolute_floor, flows_of_kind, population_cov, ratio, sample_cov, sample_sd, syn_per_synack

#: The feature columns of :func:`derived`, in the order in which a step reads them.
FEATURES = [
    "pps", "bps", "fps_proto", "fps_obs", "inbound", "src_ip_ratio", "off_ratio", "frag_ratio", "ttl_sd", "src24_top1", "src24_entropy",
    "tcp_n", "syn_ratio", "empty_ack_ratio", "zero_window_ratio", "syn_to_synack", "tcp_cov_trained", "tcp_cov_scored",
    "udp_n", "udp_flow_ratio", "udp_cov_trained", "udp_cov_scored", "udp_mean", "icmp_n", "icmp_echo_ratio", "floor_fired",
]


def derived(snapshots: DataFrame, profiles: DataFrame) -> DataFrame:
    """Snapshot records with FEATURES; profiles are named by the first eight letters, as records name them.

    A record whose profile is unknown gets no thresholds.
    """
    on = ["profile_name", *(["registry_epoch"] if "registry_epoch" in profiles.columns else [])]
    limits = F.broadcast(profiles.select(F.substring("name", 1, 8).alias("profile_name"), *on[1:], "absolute_pps_threshold", "absolute_bps_threshold", "absolute_fps_threshold").dropDuplicates(on))
    s = snapshots.join(limits, on, "left")
    c = F.col
    limit = lambda x: F.coalesce(f"absolute_{x}_threshold", F.lit(0.0))
    return s.withColumns({
        "pps": c("inbound_pkts").cast("double"), "bps": c("inbound_bytes") * 8.0,
        "fps_proto": flows_of_kind(c("proto_kind"), c("est_tcp_new_flows"), c("est_udp_flows")), "fps_obs": c("est_unique_flows"),
        "inbound": c("inbound_pkts").cast("double"), "src_ip_ratio": ratio(c("est_unique_src_ips"), c("inbound_pkts")),
        "off_ratio": ratio(c("off_proto_pkts"), c("inbound_pkts")), "frag_ratio": ratio(c("ip_frag_pkts"), c("inbound_pkts")),
        "ttl_sd": sample_sd(c("ttl_M2"), c("inbound_pkts")), "src24_top1": c("src_24_top1_share"), "src24_entropy": c("src_24_entropy"),
        "tcp_n": c("tcp_pkts").cast("double"), "syn_ratio": ratio(c("syn_pkts"), c("tcp_pkts")), "empty_ack_ratio": ratio(c("empty_ack_pkts"), c("tcp_pkts")),
        "zero_window_ratio": ratio(c("zero_window_pkts"), c("tcp_pkts")), "syn_to_synack": syn_per_synack(c("syn_pkts"), c("syn_ack_pkts")),
        "tcp_cov_trained": sample_cov(c("tcp_pkt_size_mean"), c("tcp_pkt_size_M2"), c("tcp_pkts")),
        "tcp_cov_scored": population_cov(c("tcp_pkt_size_mean"), c("tcp_pkt_size_M2"), c("tcp_pkts")),
        "udp_n": c("udp_pkts").cast("double"), "udp_flow_ratio": ratio(c("est_udp_flows"), c("udp_pkts")),
        "udp_cov_trained": sample_cov(c("udp_pkt_size_mean"), c("udp_pkt_size_M2"), c("udp_pkts")),
        "udp_cov_scored": population_cov(c("udp_pkt_size_mean"), c("udp_pkt_size_M2"), c("udp_pkts")),
        "udp_mean": c("udp_pkt_size_mean"), "icmp_n": c("icmp_pkts").cast("double"), "icmp_echo_ratio": ratio(c("icmp_echo_pkts"), c("icmp_pkts")),
        "floor_fired": absolute_floor(c("inbound_pkts"), c("inbound_bytes"), c("est_unique_flows"), limit("pps"), limit("bps"), limit("fps")),
    }).drop("absolute_pps_threshold", "absolute_bps_threshold", "absolute_fps_threshold")
