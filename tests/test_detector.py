"""The detector's step: scenarios, and batch, stream and restart against it."""

import math
import random

import pytest

from tickloom import schemas
from tickloom.functions import scalars
from tickloom.operators import detect, step, windows

PROFILE = step.DEFAULT_PROFILE | {"alpha": 0.05, "variance_ceiling": 6.0, "baseline_freeze_windows": 8, "thaw_cooldown_windows": 6, "warmup_windows": 3}
ZERO = dict.fromkeys(["pps", "bps", "fps_proto", "fps_obs", "inbound", "src_ip_ratio", "off_ratio", "frag_ratio", "ttl_sd", "src24_top1", "src24_entropy", "tcp_n", "syn_ratio", "empty_ack_ratio", "zero_window_ratio", "syn_to_synack", "tcp_cov_trained", "tcp_cov_scored", "udp_n", "udp_flow_ratio", "udp_cov_trained", "udp_cov_scored", "udp_mean", "icmp_n", "icmp_echo_ratio", "floor_fired"], 0.0)


def quiet(n=100.0, **more):
    return ZERO | {"pps": n, "bps": n * 8000, "inbound": n, "tcp_n": n, "syn_ratio": 0.1, "syn_to_synack": 1.0, "ttl_sd": 2.0, "src24_top1": 0.1, "src24_entropy": 4.0, "src_ip_ratio": 0.3, "fps_obs": n / 2, "fps_proto": n / 2} | more


def flood(**more):
    return quiet(10_000.0, syn_ratio=0.99, syn_to_synack=10.0, src_ip_ratio=0.99, src24_top1=0.9, src24_entropy=0.3, ttl_sd=30.0, floor_fired=1.0, fps_obs=9000.0, fps_proto=9000.0, empty_ack_ratio=0.8, zero_window_ratio=0.8, tcp_cov_scored=3.0, off_ratio=0.9, frag_ratio=0.5) | more


def run(rows, p=PROFILE, kind=4, s=None, learning=False):
    s = s or step.fresh(p)
    for r in rows:
        s = step.advance(s, r, kind, p, learning)
    return s


def jitter(n, seed=1):
    r = random.Random(seed)
    return [quiet(100 + r.random() * 5, syn_ratio=0.1 + r.random() / 50, src24_top1=0.1 + r.random() / 50, src24_entropy=4 + r.random() / 10, ttl_sd=2 + r.random() / 10, src_ip_ratio=0.3 + r.random() / 20) for _ in range(n)]


def test_baseline_of_equal_values():
    b = [0.0, 0.0, 0]
    for _ in range(51):
        step.train(b, 100.0, 0.5, 6.0)
    assert b[0] == 100 and b[1] <= 1.0


def test_wider_ceiling_moves_more():
    moved = []
    for c in (6.0, 3.0):
        b = [0.0, 0.0, 0]
        for i in range(10):
            step.train(b, 100 + i % 3, 0.05, c)
        before = b[0]
        step.train(b, 300.0, 0.05, c)
        moved.append(b[0] - before)
    assert moved[0] / moved[1] > 1.5


def test_sigmoid_and_cusum():
    assert step.surprise(3) == 0.5 and step.surprise(1e9) == 1.0
    s = 0.0
    for _ in range(20):
        s = step.raised(s, 200.0, [100.0, 25.0, 9])
    assert s > step.CUSUM_LIMIT


def test_warm_up_ends_in_normal():
    s, phases = step.fresh(PROFILE), []
    for _ in range(3):
        phases.append(step.advance(s, quiet(), 4, PROFILE)["phase"])
    assert phases == [0, 0, 1]


def test_floor_alone_does_not_convict():
    p = PROFILE | {"warmup_windows": 2}
    s = run([quiet(), quiet(), quiet(105.0, floor_fired=1.0)], p)
    assert s["floor_fired_now"] == 1 and s["t1_final"] > 0 and s["ewma_freeze"] == 8 and s["phase"] != schemas.ATTACK


def test_flood_is_an_attack_and_thaws():
    s = run(jitter(30))
    s = step.advance(s, flood(), 4, PROFILE)
    assert s["phase"] == schemas.ATTACK and s["attack_freeze"]
    before = [list(b) for b in s["baselines"].values()]
    for _ in range(5):
        step.advance(s, quiet(), 4, PROFILE)
    assert s["attack_freeze"] and [list(b) for b in s["baselines"].values()] == before
    step.advance(s, quiet(), 4, PROFILE)
    assert not s["attack_freeze"] and set(s["cusum"].values()) == {0.0}


def test_flood_in_warm_up_does_not_train():
    p = PROFILE | {"warmup_windows": 20}
    s = run([quiet()] * 5, p)
    mean = s["baselines"]["pps"][0]
    s = run([flood()] * 3, p, s=s)
    assert s["baselines"]["pps"][0] == mean and s["ewma_freeze"] > 0 and s["phase"] == 0 and s["history"] == 0 == s["consecutive_attack_windows"]


def test_learning_never_changes_phase():
    s = run([flood()] * 50, learning=True)
    assert s["phase"] == 0 and s["windows_seen"] == 50 and s["baselines"]["pps"][2] == 50


def test_history_of_pulses():
    s = run(jitter(30))
    for k in range(5):
        s = step.advance(step.drained(s) | {"history": s["history"]}, flood() if k % 2 == 0 else quiet(), 4, PROFILE)
    assert s["history"] & 0b10101 == 0b10101 and s["consecutive_attack_windows"] >= 3


@pytest.mark.parametrize("a, b, want", [(0.5, 0.0, 0.375), (0.6, 0.6, 0.6), (0.9, 0.0, 0.75), (0.9, 0.7, 0.85)])
def test_fusion(spark, a, b, want):
    from pyspark.sql import functions as F

    lit = lambda x: F.lit(float(x))
    got = spark.range(1).select(scalars.fused(F.lit(1), lit(a), lit(0), lit(0), lit(b), lit(0), lit(0)).alias("x")).first().x
    assert got == pytest.approx(want)


def test_burst_is_two_pass():
    recent, r = [], random.Random(2)
    values = [1e10 + i * 1e7 + (i % 7) * 1e6 for i in range(50)]
    for i, x in enumerate(values):
        z = step.burst(recent, x)
        last = values[max(0, i - 9) : i + 1]
        if len(last) > 1:
            m = sum(last) / len(last)
            sd = math.sqrt(sum((v - m) ** 2 for v in last) / (len(last) - 1))
            assert z == pytest.approx((x - m) / sd, rel=1e-9)
    del r


def test_commands_and_rebinding():
    s = run(jitter(10))
    assert step.commanded(s, "force_ewma_freeze", {"ticks": 4}, PROFILE)["ewma_freeze"] == 4
    hit = step.commanded(s, "force_attack_freeze", {}, PROFILE)
    assert hit["phase"] == schemas.ATTACK and hit["attack_freeze"]
    free = step.commanded(hit, "release_freezes", {}, PROFILE)
    assert free["phase"] == schemas.NORMAL and not free["attack_freeze"] and free["ewma_freeze"] == 0
    for bad in (("force_ewma_freeze", {"ticks": -1}), ("nothing", {})):
        with pytest.raises(ValueError):
            step.commanded(s, *bad, PROFILE)
    new = step.rebound(s, PROFILE, PROFILE | {"fix_fps_source": True, "alpha": 0.42})
    assert new["baselines"]["fps"] == [0.0, 0.0, 0] and new["baselines"]["pps"] == s["baselines"]["pps"] and new["warmup_remaining"] == s["warmup_remaining"]


def snapshots(spark, ticks=range(60), slots=((0, 10, 80, 1), (1, 10, 0, 5))):
    rows = []
    for t in ticks:
        for slot, ip, port, kind in slots:
            n = 5000 if t in (40, 41, 42) and slot == 0 else 100 + (t * 7 + slot) % 9
            base = dict.fromkeys(schemas.COUNTERS, 0) | dict.fromkeys(schemas.MEASURES, 0.0)
            base |= {"inbound_pkts": n, "inbound_bytes": n * 500, "tcp_pkts": n if kind == 1 else 0, "udp_pkts": n if kind == 5 else 0, "syn_pkts": n if n > 1000 else 3, "syn_ack_pkts": 3, "ttl_mean": 60.0, "ttl_M2": n * (900.0 if n > 1000 else 2.0 + t % 3 / 10), "tcp_pkt_size_mean": 500.0, "tcp_pkt_size_M2": n * 9.0, "est_unique_flows": n / 2, "est_unique_src_ips": n * (1.0 if n > 1000 else 0.3 + t % 3 / 100), "src_24_top1_share": 0.9 if n > 1000 else 0.1 + t % 3 / 100, "src_24_entropy": 0.2 if n > 1000 else 4.0 + t % 3 / 10}
            rows.append({"tick": t, "slot_id": slot, "produced_ts_ns": t * 10**9, "registry_epoch": 1, "seq": t, "target_ip": ip, "port": port, "proto_kind": kind, "is_catchall": 0, "profile_name": "default", "window_count": t // 2, "absolute_floor_fired": 0} | base)
    return spark.createDataFrame([[r[f.name] for f in schemas.SNAPSHOTS.fields] for r in rows], schemas.SNAPSHOTS)


def profiles(spark):
    return spark.createDataFrame([("default", 0.05, 6.0, 1000.0, 0.0, 0.0, 8, 6, 10, False, False)], schemas.PROFILES)


def outputs(df):
    cols = ["slot_id", "tick", *step.OUTPUTS]
    return sorted(map(tuple, df.select(*cols).collect()))


def test_batch_restart_and_commands(spark):
    whole = outputs(detect.detected(snapshots(spark).repartition(5), profiles(spark)))
    assert len(whole) == 120 and any(r[2] == schemas.ATTACK for r in whole)
    first, rest = snapshots(spark, range(30)), snapshots(spark, range(30, 60))
    state = detect.states(first, profiles(spark))
    assert state.count() == 2
    again = outputs(detect.detected(rest, profiles(spark), state=state))
    assert again == [r for r in whole if r[1] >= 30]
    drained = detect.drained_states(state).collect()
    assert all(step.loaded(r.state)["history"] == 0 and set(step.loaded(r.state)["cusum"].values()) == {0.0} for r in drained)
    commands = spark.createDataFrame([(45, 10, 80, 1, "release_freezes", "{}")], schemas.COMMANDS)
    freed = {r[:2]: r for r in outputs(detect.detected(snapshots(spark), profiles(spark), commands))}
    held = {r[:2]: r for r in whole}
    k = 2 + step.OUTPUTS.index("thaw_cooldown_remaining")
    assert held[0, 45][k] > 0 and freed[0, 45][k] == 0 and freed[1, 45] == held[1, 45]


def test_stream_equals_batch(spark, tmp_path):
    from tickloom.streaming import live

    src = str(tmp_path / "src")
    for part in (range(0, 25), range(25, 60)):
        snapshots(spark, part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schemas.SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.into(live.detected(stream, profiles(spark)), str(tmp_path / "cp"), live.once_per_batch(str(tmp_path / "out")))
    q.awaitTermination(240)
    got = outputs(spark.read.parquet(str(tmp_path / "out")))
    assert got == outputs(detect.detected(snapshots(spark), profiles(spark)))


def test_stream_counters(spark, tmp_path):
    from pyspark.sql import functions as F

    from tests.conftest import SF_SMALL
    from tickloom import queries
    from tickloom.operators import ticks
    from tickloom.streaming import live

    routed = queries._routed(spark, SF_SMALL).where("tick < 40").withColumn("ts", F.timestamp_seconds("tick"))
    routed.coalesce(1).write.parquet(str(tmp_path / "in"))
    last = routed.orderBy("tick").limit(1).withColumn("ts", F.timestamp_seconds(F.lit(10_000)))  # moves the watermark past all
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(routed.schema).parquet(str(tmp_path / "in"))
    q = live.into(live.tick_counters(stream), str(tmp_path / "cp"), live.once_per_batch(str(tmp_path / "out")))
    q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).where("tick < 40").select("tick", "slot_id", "inbound_pkts", "tcp_bytes")
    want = ticks.counters(spark.read.parquet(str(tmp_path / "in")).where("ts < timestamp'1970-01-01 00:01:00'")).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_native_average_is_the_steps(spark):
    r = random.Random(4)
    rows = [(k, t, r.gauss(50, 5) + (400 if t == 30 else 0)) for k in "ab" for t in range(60)]
    got = {x.k: x for x in windows.ewma(spark.createDataFrame(rows, "k string, tick long, x double"), ["k"], "x").collect()}
    for k in "ab":
        b = [0.0, 0.0, 0]
        for kk, _, x in rows:
            if kk == k:
                step.train(b, x, 0.05, 6.0)
        assert got[k]["mean"] == pytest.approx(b[0]) and got[k]["variance"] == pytest.approx(b[1]) and got[k]["n"] == b[2]


def test_shadow_and_counters(spark, tmp_path):
    from pyspark.sql import functions as F

    from tickloom.streaming import live

    rows = spark.createDataFrame([(s, t * 10**9, 10 + t, 1 + 2 * (t == 3), 0.5, 1) for s in (1, 2) for t in range(5)], "slot_id int, timestamp_ns long, inbound_pkts long, phase int, tier0_score double, absolute_floor_fired int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = live.Counters()
    spark.streams.addListener(seen)
    stream = live.counted(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = live.shadowed(stream, str(tmp_path / "cp"), lambda b: b, lambda b: b.withColumn("tier0_score", F.when(F.col("slot_id") == 2, 0.75).otherwise(F.col("tier0_score"))), str(tmp_path / "out"), ["inbound_pkts"], ["tier0_score"])
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 5 and {(r.slot_id, r.field, r.ours, r.theirs) for r in got} == {(2, "tier0_score", 0.5, 0.75)}
    for _ in range(50):
        if seen.stopped:
            break
        __import__("time").sleep(0.2)
    spark.streams.removeListener(seen)
    assert seen.rows_in >= 10 and seen.failed == 0 and seen.observed["facts"]["attack_rows"] >= 2
    named = seen.named()
    assert len(named) == 12 and named["read"] == seen.rows_in and named["inserted"] >= 10 and named["accepts"] == 1 and "queue_drops=0" in seen.line()


def test_guarded_writer():
    from tickloom.streaming import live

    counters, calls = live.Counters(), []

    def fails(batch, batch_id):
        calls.append(batch_id)
        if len(calls) < 2 or batch_id == 7:
            raise OSError("gone")

    counters.guarded(fails)(None, 1)
    assert calls == [1, 1] and (counters.write_errors, counters.batches_dropped) == (1, 0)
    counters.guarded(fails, drop=True)(None, 7)
    assert (counters.write_errors, counters.batches_dropped) == (3, 1)
    with pytest.raises(OSError):
        counters.guarded(fails)(None, 7)


def test_learning_mode_between_ticks(spark):
    from tickloom import commands

    slots = spark.createDataFrame([(10, 80, 1), (10, 0, 5)], "target_ip long, port int, proto_kind int")
    on = commands.request_all(slots, 35, "set_learning_mode", {"enabled": True})
    off = commands.request_all(slots, 50, "set_learning_mode", {"enabled": False})
    got = {r[:2]: dict(zip(step.OUTPUTS, r[2:])) for r in outputs(detect.detected(snapshots(spark), profiles(spark), on.unionByName(off)))}
    plain = {r[:2]: dict(zip(step.OUTPUTS, r[2:])) for r in outputs(detect.detected(snapshots(spark), profiles(spark)))}
    assert plain[0, 41]["phase"] == schemas.ATTACK and got[0, 41]["phase"] == plain[0, 34]["phase"] == schemas.NORMAL
    assert got[0, 34] == plain[0, 34] and got[0, 59]["windows_seen"] == 60
    with pytest.raises(ValueError):
        commands.request_all(slots, 1, "set_learning_mode", {"enabled": "yes"})


def test_profiles_by_epoch(spark):
    from pyspark.sql import functions as F

    from tickloom import commands

    rows = snapshots(spark, range(30)).withColumn("registry_epoch", F.when(F.col("tick") < 15, 1).otherwise(2).cast("long"))
    both = profiles(spark).withColumn("registry_epoch", F.lit(1).cast("long")).unionByName(profiles(spark).withColumns({"registry_epoch": F.lit(2).cast("long"), "alpha": F.lit(0.42), "warmup_windows": F.lit(99)}))
    got, old = detect.detected(rows, both), detect.detected(rows, profiles(spark))
    k = lambda df: {r[:2]: r for r in outputs(df)}
    a, b = k(got), k(old)
    assert all(a[x] == b[x] for x in a if x[1] <= 15) and any(a[x] != b[x] for x in a if x[1] > 16)
    left = {r.slot_id: r.warmup_remaining for r in got.where("tick = 29").collect()}
    assert set(left.values()) == {0}  # a slot keeps its own warm-up
    assert sorted(map(tuple, commands.primed(rows, None).collect())) == [(1, False), (2, True)]
    assert commands.confirmed(rows, 2, 14 * 10**9).first() == (True, 15 * 10**9) and not commands.confirmed(rows, 3, 14 * 10**9).first().confirmed
    assert not commands.confirmed(rows, 2, 9 * 10**9).first().confirmed
