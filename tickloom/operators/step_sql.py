"""The detector's fold as one recursive statement, to hold :mod:`tickloom.operators.step` against.

State is a row for each slot: three columns for each baseline (mean, variance, count) and
the counters, freezes and scores by name.  Every recursion takes the next record of each
slot through five layers: cumulative sums and volume risks, firing and history, channel
scores, phase and freezes, training.
"""

from __future__ import annotations

VOLUMES = ("pps", "bps", "fps")
TRAINED_ON = {
    "pps": "pps", "bps": "bps", "fps": "fps_proto", "burst_pps": "z_pps", "burst_bps": "z_bps", "burst_fps": "z_fps",
    "ttl_sd": "ttl_sd", "src_ip_ratio": "src_ip_ratio", "off_ratio": "off_ratio", "src24_top1": "src24_top1", "src24_entropy": "src24_entropy",
    "syn_ratio": "syn_ratio", "empty_ack_ratio": "empty_ack_ratio", "zero_window_ratio": "zero_window_ratio", "syn_to_synack": "syn_to_synack", "tcp_cov": "tcp_cov_trained",
    "udp_n": "udp_n", "udp_flow_ratio": "udp_flow_ratio", "udp_cov": "udp_cov_trained", "udp_mean": "udp_mean", "icmp_n": "icmp_n", "icmp_echo_ratio": "icmp_echo_ratio",
}
SCORED_WITH = {
    "tcp": {"syn_ratio": "syn_ratio", "empty_ack_ratio": "empty_ack_ratio", "zero_window_ratio": "zero_window_ratio", "syn_to_synack": "syn_to_synack", "tcp_cov": "tcp_cov_scored"},
    "udp": {"udp_n": "udp_n", "udp_flow_ratio": "udp_flow_ratio", "udp_cov": "udp_cov_scored", "udp_mean": "udp_mean"},
    "icmp": {"icmp_n": "icmp_n", "icmp_echo_ratio": "icmp_echo_ratio"},
    "dist": {"src_ip_ratio": "src_ip_ratio", "src24_top1": "src24_top1", "src24_entropy": "src24_entropy"},
}
KINDS = {"tcp": "(1, 4, 7)", "udp": "(2, 5, 7)", "icmp": "(3, 6, 7)"}
ARM_OF = {name: arm for arm in KINDS for name in SCORED_WITH[arm]}
SCORES = ("t1_tcp", "t1_udp", "t1_icmp", "t1_dist", "t1_l3", "t1_offproto", "t1_final")
RISKS = {"r_pps": 2.5, "r_bps": 1.5, "r_fps": 0.5, "r_burst_pps": 0.8, "r_burst_bps": 0.6, "r_burst_fps": 0.3}
COUNTS = ("phase", "prev_phase", "warmup_remaining", "history", "consecutive_attack_windows", "ewma_freeze", "normal_run", "windows_seen", "floor_fired_now", "baseline_freeze_remaining", "thaw_cooldown_remaining", "dominant_channel")
REALS = ("tier0_score", "attack_evidence", "bw_pps_z_last", "bw_bps_z_last", *SCORES, *RISKS, *(f"s_{v}" for v in VOLUMES))
STATE = [*(f"{x}_{b}" for b in TRAINED_ON for x in "mvn"), *COUNTS, "attack_freeze", *REALS]

#: Features of snapshot records ``snap``, with profile parameters, numbered by slot.
FEATURES_SQL = """
feat0 AS (
  SELECT *, inbound_pkts::DOUBLE AS pps, inbound_bytes * 8.0::DOUBLE AS bps, est_unique_flows AS fps_obs, inbound_pkts::DOUBLE AS inbound,
    CASE WHEN proto_kind IN (1, 4) THEN est_tcp_new_flows WHEN proto_kind IN (2, 5) THEN est_udp_flows WHEN proto_kind = 7 THEN est_tcp_new_flows + est_udp_flows ELSE 0 END AS fps_proto,
    coalesce(est_unique_src_ips / nullif(inbound_pkts, 0), 0) AS src_ip_ratio, coalesce(off_proto_pkts / nullif(inbound_pkts, 0), 0) AS off_ratio, coalesce(ip_frag_pkts / nullif(inbound_pkts, 0), 0) AS frag_ratio,
    CASE WHEN inbound_pkts > 1 THEN sqrt(greatest(ttl_M2 / (inbound_pkts - 1), 0)) ELSE 0 END AS ttl_sd, src_24_top1_share AS src24_top1, src_24_entropy AS src24_entropy,
    tcp_pkts::DOUBLE AS tcp_n, coalesce(syn_pkts / nullif(tcp_pkts, 0), 0) AS syn_ratio, coalesce(empty_ack_pkts / nullif(tcp_pkts, 0), 0) AS empty_ack_ratio, coalesce(zero_window_pkts / nullif(tcp_pkts, 0), 0) AS zero_window_ratio,
    CASE WHEN syn_ack_pkts > 0 THEN syn_pkts / syn_ack_pkts ELSE least(10, syn_pkts) END AS syn_to_synack,
    CASE WHEN tcp_pkt_size_mean > 0 AND tcp_pkts > 1 THEN sqrt(greatest(tcp_pkt_size_M2 / (tcp_pkts - 1), 0)) / tcp_pkt_size_mean ELSE 0 END AS tcp_cov_trained,
    CASE WHEN tcp_pkt_size_mean > 0 AND tcp_pkts > 1 THEN sqrt(greatest(tcp_pkt_size_M2 / tcp_pkts, 0)) / tcp_pkt_size_mean ELSE 0 END AS tcp_cov_scored,
    udp_pkts::DOUBLE AS udp_n, coalesce(est_udp_flows / nullif(udp_pkts, 0), 0) AS udp_flow_ratio,
    CASE WHEN udp_pkt_size_mean > 0 AND udp_pkts > 1 THEN sqrt(greatest(udp_pkt_size_M2 / (udp_pkts - 1), 0)) / udp_pkt_size_mean ELSE 0 END AS udp_cov_trained,
    CASE WHEN udp_pkt_size_mean > 0 AND udp_pkts > 1 THEN sqrt(greatest(udp_pkt_size_M2 / udp_pkts, 0)) / udp_pkt_size_mean ELSE 0 END AS udp_cov_scored,
    udp_pkt_size_mean AS udp_mean, icmp_pkts::DOUBLE AS icmp_n, coalesce(icmp_echo_pkts / nullif(icmp_pkts, 0), 0) AS icmp_echo_ratio
  FROM snap
), feat AS (
  SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY tick) AS k,
    pps_limit > 0 AND pps >= pps_limit AS is_floor, """ + ", ".join(f"CASE WHEN sd_{v} > 1e-9 THEN ({x} - mean_{v}) / sd_{v} ELSE 0 END AS z_{v}" for v, x in (("pps", "pps"), ("bps", "bps"), ("fps", "fps_proto"))) + """
  FROM (SELECT *, """ + ", ".join(f"avg({x}) OVER w AS mean_{v}, coalesce(stddev_samp({x}) OVER w, 0) AS sd_{v}" for v, x in (("pps", "pps"), ("bps", "bps"), ("fps", "fps_proto"))) + """
    FROM feat0 WINDOW w AS (PARTITION BY slot_id ORDER BY tick ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
)"""


def _off(name: str, x: str) -> str:
    """Deviations of a feature from a baseline."""
    return f"(CASE WHEN n_{name} > 0 AND v_{name} >= 1e-12 THEN ({x} - m_{name}) / sqrt(v_{name}) ELSE 0 END)"


def _surprise(z: str) -> str:
    return f"(1 - 1 / (1 + exp(least(abs({z}), 700) - 3)))"


def _mean(terms: list[str]) -> str:
    return f"least(1, ({' + '.join(terms)}) / {len(terms)}.0)"


def _sum(v: str) -> str:
    x, sd = ("fps_obs" if v == "fps" else v), f"sqrt(greatest(v_{v}, 0))"
    moved = f"CASE WHEN n_{v} = 0 OR {sd} < 1e-9 THEN s_{v} ELSE greatest(0, s_{v} + ({x} - m_{v}) / {sd} - 0.5) END"
    return f"CASE WHEN attack_freeze THEN s_{v} ELSE {moved} END AS s1_{v}, least(1, abs({_off(f'burst_{v}', f'z_{v}')}) / 15.0) AS rb_{v}"


def _trained(name: str, x: str) -> tuple[str, str]:
    """What decides whether a baseline learns and by how much it moves; and its three columns after that."""
    go = "learns" + (f" AND proto_kind IN {KINDS[ARM_OF[name]]} AND {ARM_OF[name]}_n > 0" if name in ARM_OF else "")
    sd = f"sqrt(greatest(v_{name}, 0))"
    plain = f"({x} - m_{name})"
    off = f"CASE WHEN n_{name} >= 8 AND ceiling > 0 AND v_{name} > 0 THEN greatest(least({plain}, ceiling * {sd}), -ceiling * {sd}) ELSE {plain} END"
    mean = f"(m_{name} + alpha * off_{name})"
    variance = f"greatest((1 - alpha) * (v_{name} + alpha * off_{name} * off_{name}), greatest(0.01 * abs({mean}), 1e-6) ** 2)"
    first = f"({go}) AS go_{name}, {off} AS off_{name}"
    then = f"CASE WHEN NOT go_{name} THEN m_{name} WHEN n_{name} = 0 THEN {x} ELSE {mean} END AS m_{name}, CASE WHEN NOT go_{name} THEN v_{name} WHEN n_{name} = 0 THEN 0 ELSE {variance} END AS v_{name}, n_{name} + go_{name}::INTEGER AS n_{name}"
    return first, then


def fold_sql() -> str:
    """``folded``: the state of every slot after each of its records in ``feat``."""
    start = [*(f"{'0' if x == 'n' else '0.0::DOUBLE'} AS {x}_{b}" for b in TRAINED_ON for x in "mvn"), *(f"{'warmup' if c == 'warmup_remaining' else '0'}::INTEGER AS {c}" for c in COUNTS), "false AS attack_freeze", *(f"0.0::DOUBLE AS {c}" for c in REALS)]
    features = sorted({"tick", "proto_kind", "alpha", "ceiling", "freeze_ticks", "thaw_ticks", "is_floor", "inbound", "fps_obs", "frag_ratio", "tcp_n", "udp_n", "icmp_n", *(f"z_{v}" for v in VOLUMES), *TRAINED_ON.values(), *(x for arm in SCORED_WITH.values() for x in arm.values())})
    arm = {a: f"CASE WHEN proto_kind IN {KINDS[a]} AND {a}_n >= 10 THEN {_mean([_surprise(_off(n, x)) for n, x in SCORED_WITH[a].items()])} ELSE 0 END AS x_{a}" for a in KINDS}
    dist = f"CASE WHEN inbound >= 10 THEN {_mean([_surprise(_off(n, x)) for n, x in SCORED_WITH['dist'].items()])} ELSE 0 END AS x_dist"
    l3 = f"CASE WHEN inbound >= 10 THEN {_mean([_surprise(_off('ttl_sd', 'ttl_sd')), _surprise('20 * frag_ratio'), _surprise(_off('off_ratio', 'off_ratio'))])} ELSE 0 END AS x_l3"
    offproto = f"CASE WHEN inbound >= 10 THEN {_surprise(_off('off_ratio', 'off_ratio'))} ELSE 0 END AS x_offproto"
    applies = "greatest(" + ", ".join(f"CASE WHEN proto_kind IN {KINDS[a]} THEN x_{a} ELSE 0 END" for a in KINDS) + ")"
    channels = [*(f"greatest(r_{v}, r_burst_{v})" for v in VOLUMES), *(f"CASE WHEN proto_kind IN {KINDS[a]} THEN x_{a} ELSE -1 END" for a in KINDS), "x_dist", "x_l3", "x_offproto"]
    trained = [_trained(n, x) for n, x in TRAINED_ON.items()]
    same = ", ".join
    return f"""
folded AS (
  SELECT slot_id, 0::BIGINT AS k, NULL::BIGINT AS tick, {same(start)} FROM (SELECT DISTINCT slot_id, warmup FROM feat)
  UNION ALL
  SELECT slot_id, k, tick, {same(c for _, c in trained)}, {same(COUNTS)}, attack_freeze, {same(REALS)} FROM (
    SELECT *, {same(c for c, _ in trained)} FROM (
      SELECT * REPLACE (CASE WHEN phase <> before THEN before ELSE prev_phase END AS prev_phase, windows_seen + 1 AS windows_seen,
          CASE WHEN attack_freeze OR ewma_freeze > 0 THEN greatest(1, ewma_freeze) ELSE 0 END AS baseline_freeze_remaining, CASE WHEN attack_freeze THEN greatest(0, thaw_ticks - normal_run) ELSE 0 END AS thaw_cooldown_remaining,
          {same(f"CASE WHEN thawed THEN 0 ELSE s_{v} END AS s_{v}" for v in VOLUMES)}),
        NOT (attack_freeze OR ewma_freeze > 0) AND (warming OR phase = 1) AS learns FROM (
        SELECT * REPLACE (CASE WHEN warming THEN attack_freeze WHEN phase = 3 THEN true WHEN thaws THEN false ELSE attack_freeze END AS attack_freeze,
            CASE WHEN warming THEN normal_run WHEN phase = 3 OR thaws THEN 0 WHEN attack_freeze THEN CASE WHEN phase = 1 THEN normal_run + 1 ELSE 0 END ELSE normal_run END AS normal_run),
          thaws AS thawed FROM (
          SELECT *, NOT warming AND phase = 1 AND attack_freeze AND normal_run + 1 >= thaw_ticks AS thaws FROM (
            SELECT * REPLACE (CASE WHEN warming THEN CASE WHEN warmup_remaining = 0 AND phase = 0 THEN 1 ELSE phase END WHEN judged THEN CASE WHEN t1_final >= 0.7 THEN 3 WHEN t1_final >= 0.5 THEN 2 ELSE 1 END ELSE 1 END AS phase,
                CASE WHEN judged THEN t1_final ELSE tier0_score END AS attack_evidence, CASE WHEN fired THEN greatest(ewma_freeze, freeze_ticks) ELSE ewma_freeze END AS ewma_freeze), phase AS before FROM (
              SELECT * REPLACE ({same(f"CASE WHEN warming OR judged THEN x_{c.removeprefix('t1_')} ELSE {c} END AS {c}" for c in SCORES[:-1])},
                  CASE WHEN warming OR judged THEN least(1, greatest(0, 0.75 * top[1] + 0.25 * top[2], top[1] - 0.15)) ELSE t1_final END AS t1_final,
                  CASE WHEN warming OR judged THEN CASE WHEN list_max(channels) >= 0.15 THEN list_position(channels, list_max(channels))::INTEGER ELSE 0 END ELSE dominant_channel END AS dominant_channel) FROM (
                SELECT *, list_sort([{applies}, x_dist, x_l3, x_offproto], 'DESC') AS top, [{same(channels)}] AS channels FROM (
                  SELECT * REPLACE (CASE WHEN warming THEN warmup_remaining - 1 ELSE warmup_remaining END AS warmup_remaining, greatest(0, ewma_freeze - 1) AS ewma_freeze,
                      CASE WHEN warming THEN consecutive_attack_windows ELSE bit_count(history)::INTEGER END AS consecutive_attack_windows),
                    NOT warming AND (is_floor OR bit_count(history) >= 3) AS judged, {same(arm.values())}, {dist}, {l3}, {offproto} FROM (
                    SELECT * REPLACE (CASE WHEN warming THEN history ELSE ((history << 1) | fired::INTEGER) & 31 END AS history, is_floor::INTEGER AS floor_fired_now) FROM (
                      SELECT *, is_floor OR tier0_score >= 5 AS fired, warmup_remaining > 0 AS warming FROM (
                        SELECT * REPLACE ({same(f"s1_{v} AS s_{v}, least(1, s1_{v} / 4.0) AS r_{v}, rb_{v} AS r_burst_{v}" for v in VOLUMES)}, z_pps AS bw_pps_z_last, z_bps AS bw_bps_z_last,
                            {' + '.join(f"{w} * " + (f"rb_{r.removeprefix('r_burst_')}" if 'burst' in r else f"least(1, s1_{r.removeprefix('r_')} / 4.0)") for r, w in RISKS.items())} AS tier0_score) FROM (
                          SELECT s.slot_id, f.k, {same(f"f.{x}" for x in features)}, {same(f"s.{c}" for c in STATE)}, {same(_sum(v) for v in VOLUMES)} FROM folded s JOIN feat f ON f.slot_id = s.slot_id AND f.k = s.k + 1
  ))))))))))))
)"""
