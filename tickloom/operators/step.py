"""One tick of one slot's detector: a pure function of state, features and parameters.

The order is score, then decide, then train: a window is scored on the baselines of
the windows before it, and trains them only if it is found normal and nothing is
frozen.  State is a plain dictionary of numbers and lists, so that it can be kept in
a state store, written as JSON or compared.
"""

from __future__ import annotations

import json
import math

from tickloom.schemas import ATTACK, NORMAL, SUSPICIOUS, WARMUP

# Fixed values of the scoring rules.
CUSUM_DRIFT, CUSUM_LIMIT = 0.5, 4.0
BURST_SIZE, BURST_FULL = 10, 15.0
RISK_WEIGHTS = {"r_pps": 2.5, "r_bps": 1.5, "r_fps": 0.5, "r_burst_pps": 0.8, "r_burst_bps": 0.6, "r_burst_fps": 0.3}
FIRE_AT = 5.0
SUSPICIOUS_AT, ATTACK_AT = 0.5, 0.7
OPEN_AT, HISTORY = 3, 0x1F
LEAST_PACKETS = 10
DOMINANT_LEAST = 0.15
WINSOR_AFTER, SD_RELATIVE, SD_LEAST = 8, 0.01, 1e-6
TINY_VARIANCE, TINY_SD = 1e-12, 1e-9

DEFAULT_PROFILE = {
    "alpha": 0.05, "variance_ceiling": 6.0, "baseline_freeze_windows": 60, "thaw_cooldown_windows": 30, "warmup_windows": 400,
    "fix_fps_source": False, "fix_frag_zscore": False,
}

#: Kinds whose packets may fill an arm.
ARMS = {"tcp": (1, 4, 7), "udp": (2, 5, 7), "icmp": (3, 6, 7)}
#: Baselines of each arm: (baseline, feature it is trained on, feature it is scored with).
ARM_BASELINES = {
    "tcp": [("syn_ratio", "syn_ratio", "syn_ratio"), ("empty_ack_ratio",) * 3, ("zero_window_ratio",) * 3, ("syn_to_synack",) * 3, ("tcp_cov", "tcp_cov_trained", "tcp_cov_scored")],
    "udp": [("udp_n",) * 3, ("udp_flow_ratio",) * 3, ("udp_cov", "udp_cov_trained", "udp_cov_scored"), ("udp_mean",) * 3],
    "icmp": [("icmp_n",) * 3, ("icmp_echo_ratio",) * 3],
}
COMMON_BASELINES = ["ttl_sd", "src_ip_ratio", "off_ratio", "src24_top1", "src24_entropy"]
VOLUMES = ("pps", "bps", "fps")
SCORES = ("t1_tcp", "t1_udp", "t1_icmp", "t1_dist", "t1_l3", "t1_offproto", "t1_final")
OUTPUTS = [
    "phase", "prev_phase", "warmup_remaining", "consecutive_attack_windows", "baseline_freeze_remaining", "thaw_cooldown_remaining", "windows_seen",
    "floor_fired_now", "bw_pps_z_last", "bw_bps_z_last", "tier0_score", *SCORES, *RISK_WEIGHTS, "dominant_channel", "attack_evidence",
]


def fresh(params: dict) -> dict:
    """State of a slot that has not been seen."""
    names = [*VOLUMES, *(f"burst_{v}" for v in VOLUMES), *COMMON_BASELINES, "frag_ratio", *(b for arm in ARM_BASELINES.values() for b, _, _ in arm)]
    return {
        "baselines": {n: [0.0, 0.0, 0] for n in names}, "cusum": dict.fromkeys(VOLUMES, 0.0), "recent": {v: [] for v in VOLUMES},
        "phase": WARMUP, "prev_phase": WARMUP, "warmup_remaining": int(params["warmup_windows"]), "warmup_windows_completed": 0, "history": 0,
        "consecutive_attack_windows": 0, "ewma_freeze": 0, "normal_run": 0, "attack_freeze": False, "learning": False, "windows_seen": 0, "last_phase_change_window": 0,
        "floor_fired_now": 0, "baseline_freeze_remaining": 0, "thaw_cooldown_remaining": 0, "bw_pps_z_last": 0.0, "bw_bps_z_last": 0.0,
        "tier0_score": 0.0, "attack_evidence": 0.0, "dominant_channel": 0, **dict.fromkeys(SCORES, 0.0), **dict.fromkeys(RISK_WEIGHTS, 0.0),
    }


def train(baseline: list, x: float, alpha: float, ceiling: float) -> None:
    """Exponentially weighted mean and variance [mean, variance, n]; outliers are pulled in to ``ceiling`` deviations."""
    mean, variance, n = baseline
    if not n:
        baseline[:] = [x, 0.0, 1]
        return
    off, sd = x - mean, math.sqrt(max(variance, 0.0))
    if n >= WINSOR_AFTER and ceiling > 0 and sd > 0:
        off = min(max(off, -ceiling * sd), ceiling * sd)
    mean += alpha * off
    least = max(SD_RELATIVE * abs(mean), SD_LEAST)
    baseline[:] = [mean, max((1 - alpha) * (variance + alpha * off * off), least * least), n + 1]


def deviation(baseline: list, x: float) -> float:
    mean, variance, n = baseline
    return (x - mean) / math.sqrt(variance) if n and variance >= TINY_VARIANCE else 0.0


def surprise(z: float) -> float:
    """A sigmoid of |z| with its middle at 3."""
    return 1 - 1 / (1 + math.exp(abs(z) - 3)) if abs(z) < 700 else 1.0


def raised(cusum: float, x: float, baseline: list) -> float:
    """A one-sided cumulative sum after one more observation."""
    mean, variance, n = baseline
    sd = math.sqrt(variance) if n and variance > 0 else 0.0
    return cusum if sd < TINY_SD else max(0.0, cusum + (x - mean) / sd - CUSUM_DRIFT)


def burst(recent: list[float], x: float) -> float:
    """Deviation of a sample from the last ten, itself among them."""
    recent.append(x)
    del recent[:-BURST_SIZE]
    n = len(recent)
    if n < 2:
        return 0.0
    mean = math.fsum(recent) / n
    sd = math.sqrt(math.fsum((v - mean) ** 2 for v in recent) / (n - 1))
    return (x - mean) / sd if sd > TINY_SD else 0.0


def _signatures(s: dict, f: dict, kind: int, p: dict) -> None:
    """Channel scores against the baselines, their fusion and the dominant channel."""
    b = s["baselines"]
    mean = lambda zs: sum(map(surprise, zs)) / len(zs)
    for arm, kinds in ARMS.items():
        enough = kind in kinds and f[f"{arm}_n"] >= LEAST_PACKETS
        s[f"t1_{arm}"] = min(1.0, mean([deviation(b[name], f[x]) for name, _, x in ARM_BASELINES[arm]])) if enough else 0.0
    s["t1_dist"] = s["t1_l3"] = s["t1_offproto"] = 0.0
    if f["inbound"] >= LEAST_PACKETS:
        s["t1_dist"] = min(1.0, mean([deviation(b[x], f[x]) for x in ("src_ip_ratio", "src24_top1", "src24_entropy")]))
        frag = deviation(b["frag_ratio"], f["frag_ratio"]) if p["fix_frag_zscore"] else 20 * f["frag_ratio"]
        off = deviation(b["off_ratio"], f["off_ratio"])
        s["t1_l3"] = min(1.0, mean([deviation(b["ttl_sd"], f["ttl_sd"]), frag, off]))
        s["t1_offproto"] = surprise(off)
    arms = [a for a, kinds in ARMS.items() if kind in kinds]
    top = sorted([max([s[f"t1_{a}"] for a in arms], default=0.0), s["t1_dist"], s["t1_l3"], s["t1_offproto"]], reverse=True)
    s["t1_final"] = min(1.0, max(0.0, 0.75 * top[0] + 0.25 * top[1], top[0] - 0.15))
    numbered = {i: max(s[f"r_{v}"], s[f"r_burst_{v}"]) for i, v in enumerate(VOLUMES, 1)} | {i: s[f"t1_{a}"] for i, a in enumerate(ARMS, 4) if a in arms}
    numbered |= {7: s["t1_dist"], 8: s["t1_l3"], 9: s["t1_offproto"]}
    best = max(sorted(numbered), key=numbered.__getitem__)
    s["dominant_channel"] = best if numbered[best] >= DOMINANT_LEAST else 0


def _learn(s: dict, f: dict, kind: int, p: dict, z: dict) -> None:
    """Train every baseline that the window has a value for."""
    b, a, c = s["baselines"], p["alpha"], p["variance_ceiling"]
    values = {"pps": f["pps"], "bps": f["bps"], "fps": f["fps_obs"] if p["fix_fps_source"] else f["fps_proto"]} | {f"burst_{v}": z[v] for v in VOLUMES} | {x: f[x] for x in COMMON_BASELINES}
    if p["fix_frag_zscore"]:
        values["frag_ratio"] = f["frag_ratio"]
    for arm, kinds in ARMS.items():
        if kind in kinds and f[f"{arm}_n"] > 0:
            values |= {name: f[x] for name, x, _ in ARM_BASELINES[arm]}
    for name, x in values.items():
        train(b[name], x, a, c)


def _frozen(s: dict) -> bool:
    return s["attack_freeze"] or s["ewma_freeze"] > 0


def advance(s: dict, f: dict, kind: int, p: dict, learning: bool = False) -> dict:
    """Take one window into the state, in place, and return it; learning mode is on for all, or for the slot by command."""
    learning = learning or s.get("learning", False)
    z = {v: burst(s["recent"][v], f["fps_proto" if v == "fps" else v]) for v in VOLUMES}
    s["bw_pps_z_last"], s["bw_bps_z_last"] = z["pps"], z["bps"]
    b = s["baselines"]
    for v in VOLUMES:
        if not s["attack_freeze"]:
            s["cusum"][v] = raised(s["cusum"][v], f["fps_obs" if v == "fps" else v], b[v])
        s[f"r_{v}"] = min(1.0, s["cusum"][v] / CUSUM_LIMIT)
        s[f"r_burst_{v}"] = min(1.0, abs(deviation(b[f"burst_{v}"], z[v])) / BURST_FULL)
    s["tier0_score"] = sum(w * s[r] for r, w in RISK_WEIGHTS.items())
    floor = bool(f["floor_fired"])
    s["floor_fired_now"] = int(floor)
    fired = floor or s["tier0_score"] >= FIRE_AT
    open_now = 0
    if not s["warmup_remaining"]:
        s["history"] = (s["history"] << 1 | fired) & HISTORY
        open_now = s["consecutive_attack_windows"] = s["history"].bit_count()
    s["attack_evidence"] = s["tier0_score"]
    if learning:
        _signatures(s, f, kind, p)
        s["windows_seen"] += 1
        _learn(s, f, kind, p, z)
        return s

    before = s["phase"]
    s["ewma_freeze"] = max(0, s["ewma_freeze"] - 1)
    warming = s["warmup_remaining"] > 0
    if warming:
        s["warmup_remaining"] -= 1
        s["warmup_windows_completed"] += 1
        _signatures(s, f, kind, p)
        if not s["warmup_remaining"] and s["phase"] == WARMUP:
            s["phase"] = NORMAL
    else:
        s["phase"] = NORMAL
        if floor or open_now >= OPEN_AT:
            _signatures(s, f, kind, p)
            s["attack_evidence"] = score = s["t1_final"]
            s["phase"] = ATTACK if score >= ATTACK_AT else SUSPICIOUS if score >= SUSPICIOUS_AT else NORMAL
    if fired:
        s["ewma_freeze"] = max(s["ewma_freeze"], int(p["baseline_freeze_windows"]))
    if not warming:
        _thaw(s, p)
    if not _frozen(s) and (warming or s["phase"] == NORMAL):
        _learn(s, f, kind, p, z)

    s["baseline_freeze_remaining"] = max(1, s["ewma_freeze"]) if _frozen(s) else 0
    s["thaw_cooldown_remaining"] = max(0, int(p["thaw_cooldown_windows"]) - s["normal_run"]) if s["attack_freeze"] else 0
    if s["phase"] != before:
        s["prev_phase"], s["last_phase_change_window"] = before, s["windows_seen"]
    s["windows_seen"] += 1
    return s


def _thaw(s: dict, p: dict) -> None:
    """An attack freezes everything until enough normal windows in a row."""
    if s["phase"] == ATTACK:
        s["attack_freeze"], s["normal_run"] = True, 0
    elif s["attack_freeze"]:
        s["normal_run"] = s["normal_run"] + 1 if s["phase"] == NORMAL else 0
        if s["normal_run"] >= int(p["thaw_cooldown_windows"]) and s["phase"] == NORMAL:
            s["attack_freeze"], s["normal_run"] = False, 0
            s["cusum"] = dict.fromkeys(VOLUMES, 0.0)


def drained(s: dict) -> dict:
    """State as it is taken up after a restart: without what built up in the last windows."""
    return s | {"history": 0, "consecutive_attack_windows": 0, "cusum": dict.fromkeys(VOLUMES, 0.0)}


def rebound(s: dict, old: dict, new: dict) -> dict:
    """State after its profile changed: a baseline whose source changed starts anew, all else stays."""
    b = dict(s["baselines"])
    if bool(old["fix_fps_source"]) != bool(new["fix_fps_source"]):
        b["fps"] = [0.0, 0.0, 0]
    if bool(old["fix_frag_zscore"]) != bool(new["fix_frag_zscore"]):
        b["frag_ratio"] = [0.0, 0.0, 0]
    return s | {"baselines": b}


COMMANDS = ("force_ewma_freeze", "force_attack_freeze", "release_freezes", "reset_transient", "set_learning_mode")


def commanded(s: dict, action: str, args: dict, p: dict) -> dict:
    """State after an operator's command; unknown commands and bad arguments raise ValueError."""
    if action == "force_ewma_freeze":
        ticks = int(args.get("ticks", p["baseline_freeze_windows"]))
        if ticks < 0:
            raise ValueError("ticks must not be negative")
        return s | {"ewma_freeze": ticks}
    if action == "force_attack_freeze":
        return s | {"phase": ATTACK, "attack_freeze": True, "normal_run": 0, "ewma_freeze": max(s["ewma_freeze"], int(p["baseline_freeze_windows"]))}
    if action == "release_freezes":
        return s | {"phase": NORMAL, "attack_freeze": False, "normal_run": 0, "ewma_freeze": 0, "cusum": dict.fromkeys(VOLUMES, 0.0)}
    if action == "reset_transient":
        return drained(s)
    if action == "set_learning_mode":
        if not isinstance(enabled := args.get("enabled"), bool):
            raise ValueError("enabled must be true or false")
        return s | {"learning": enabled}
    raise ValueError(f"unknown command {action!r}")


def dumped(s: dict) -> str:
    return json.dumps(s)


def loaded(text: str) -> dict:
    return json.loads(text)
