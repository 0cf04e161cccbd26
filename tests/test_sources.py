"""Registry, wire format, tables and scalar functions."""

import datetime as dt
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import scalars
from tickloom.operators import sketches
from tickloom.sources import adapters, registry, tables, wire


def test_hashes(spark):
    r = random.Random(1)
    values = [0, 1, 2**32 - 1, *(r.randrange(2**32) for _ in range(300))]

    def fmix(k):
        k ^= k >> 16
        k = k * 0x85EBCA6B % 2**32
        k ^= k >> 13
        k = k * 0xC2B2AE35 % 2**32
        return k ^ k >> 16

    def bucket(k, width):
        h = k * 0x9E3779B97F4A7C15 % 2**64 ^ 0xA5A5A5A5
        return ((h ^ h >> 33) & 0xFFFFFFFF) % width

    df = spark.createDataFrame([(v,) for v in values], "k long").select("k", scalars.hash32(F.col("k")).alias("h"), scalars.bucket_hash(F.col("k"), 512).alias("b"), scalars.bucket_hash(F.col("k"), 256).alias("p"))
    for row in df.collect():
        assert (row.h, row.b, row.p) == (fmix(row.k), bucket(row.k, 512), bucket(row.k, 256))


def test_fnv(spark):
    def fnv(b):
        h = 2166136261
        for x in b:
            h = (h ^ x) * 16777619 % 2**32
        return h

    for t in ("", "a", "foobar", "é"):
        assert spark.range(1).select(scalars.fnv1a32(F.lit(t)).alias("h")).first().h == fnv(t.encode())


def test_addresses(spark):
    good = {"0.0.0.0": 0, "192.0.2.1": 3221225985, "255.255.255.255": 4294967295}
    bad = ["01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "a.b.c.d", "1.2.3.4 ", "", None]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", scalars.ip_to_long(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.n == good.get(r.t)


def test_formats(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert f(scalars.format_peak(F.lit(scalars.PEAK_UNSET).cast("long"))) == "-" and f(scalars.format_peak(F.lit(1234567))) == "1,234,567"
    assert f(scalars.format_compact(F.lit(1500))) == "1.5K" and f(scalars.format_compact(F.lit(2.5e9))) == "2.5G"
    assert f(scalars.format_age(F.lit(59))) == "59s ago" and f(scalars.format_age(F.lit(7200))) == "2h ago"
    assert f(scalars.phase_name(F.lit(9))) == "UNKNOWN" and f(scalars.phase_name(F.lit(9), True)) == "UNKNOWN(9)"


def test_estimate_of_full_and_empty_sketch(spark):
    few = spark.createDataFrame([(1, 1, "s", i * 2654435761 % 2**32) for i in range(40)], "tick long, slot_id int, sketch string, h long")
    got = sketches.estimates(few, "window").first().estimate
    assert got == pytest.approx(40, rel=0.15)
    with pytest.raises(ValueError):
        sketches.estimates(few, "hour")


def load(spark, change=None):
    doc = json.loads(adapters.REGISTRY_JSON)
    if change:
        change(doc)
    return registry.document(spark, json.dumps(doc))


def test_registry_load(spark):
    doc = load(spark)
    slots = registry.slots(doc).collect()
    assert [s.slot_id for s in slots] == list(range(7)) and [s.is_catchall for s in slots] == [1] * 5 + [0] * 2
    assert registry.violations(doc).count() == 0
    removed = load(spark, lambda d: d["catchall_assignments"]["192.0.2.1"].pop("icmp"))
    assert registry.slots(removed).count() == 6
    ranged = load(spark, lambda d: d["services"].append({"name": "r", "target_ip": "192.0.2.1", "port_range": "8000-8004", "proto": "TCP", "profile": "default"}))
    assert sorted(r.port for r in registry.slots(ranged).where("name = 'r'").collect()) == [8000, 8001, 8002, 8003, 8004]
    assert registry.resolved(registry.slots(doc), registry.profiles(doc)).count() == 7
    assert registry.missing_sections(doc).count() == 10


@pytest.mark.parametrize("rule, change", [
    ("L1", lambda d: d.update(version=2)), ("L2", lambda d: d["services"][0].update(target_ip="192.0.2.77")), ("L3", lambda d: d["services"][0].update(profile="none")),
    ("L5", lambda d: d["catchall_assignments"].update({"192.0.2.9": {"tcp": "default"}})), ("L6", lambda d: d["catchall_assignments"]["192.0.2.1"].update(tcp="none")),
    ("L7", lambda d: d["services"].append(dict(d["services"][0]))), ("L8", lambda d: d["services"][0].update(proto="SCTP")), ("L9", lambda d: d["services"][0].pop("port")),
    ("L10", lambda d: d["services"].append({"name": "r", "target_ip": "192.0.2.1", "port_range": "1000-1400", "proto": "TCP", "profile": "default"})),
    ("L11", lambda d: d["protected_ips"].append("192.0.02.1")), ("L12", lambda d: d["profiles"]["default"].update(tier0_weights={"pps": -1})),
])
def test_registry_rules(spark, rule, change):
    assert rule in {r.rule for r in registry.violations(load(spark, change)).collect()}


def test_registry_strict(spark):
    found = registry.violations(load(spark, lambda d: d.update(learning_mode=True)), "strict_v1").collect()
    assert {r.rule for r in found} == {"L4", "L12", "L13"} and sum(r.rule == "L4" for r in found) == 3 and "learning_mode" in {r.path for r in found}


def test_migration_from_c(spark):
    text = 'static x t[] = { { .ip = "192.0.2.1", .tcp = &web, .udp = dns }, { .ip = "192.0.2.2", .other = "rest" } };'
    got = sorted(map(tuple, registry.from_c_source(spark.createDataFrame([(text,)], "text string")).collect()))
    assert got == [("192.0.2.1", "tcp", "web"), ("192.0.2.1", "udp", "dns"), ("192.0.2.2", "other", "rest")]


def message(**more):
    row = {n: (1.25 * i if k == "d" else i % 200) for i, (n, k) in enumerate(wire.PAYLOAD_FIELDS) if not n.startswith("_")}
    return wire.encoded(row | {"profile_name": "webby", "timestamp_ns": 123456789, "slot_id": 7, "sequence_num": 9, "absolute_floor_fired": 1, "ttl_mean": -0.1, "tier0_score": 6.2e-310} | more)


def test_wire_fields_and_errors(spark):
    ok = message()
    fix = lambda b: b[:464] + struct.pack(">I", zlib.crc32(b[:464]))
    cases = {
        None: ok, "length": ok[:-1], "magic": b"X" + ok[1:], "version": ok[:4] + b"\x09" + ok[5:], "type": ok[:5] + b"\x09" + ok[6:],
        "crc": ok[:100] + bytes([ok[100] ^ 1]) + ok[101:], "payload_length": fix(ok[:18] + b"\x00\x01" + ok[20:]),
    }
    df = spark.createDataFrame([(str(k), bytearray(v)) for k, v in cases.items()] + [("length", None)], "want string, message binary")
    rows = wire.decoded(df).collect()
    assert all(str(r.error) == r.want for r in rows)
    r = next(r for r in rows if r.error is None)
    assert (r.profile_name, r.slot_id, r.absolute_floor_fired, r.ttl_mean) == ("webby", 7, 1, -0.1) and r.tier0_score == pytest.approx(6.2e-310, rel=1e-9)
    assert r.win_300s_attack_seconds == [n for n, _ in wire.PAYLOAD_FIELDS].index("win_300s_attack_seconds") % 200
    assert len(ok) == wire.SIZE


def test_messages_in_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(message() + message(slot_id=8) + b"tail")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a"))
    got = wire.decoded(wire.messages_in(files)).orderBy("n").collect()
    assert [r.slot_id for r in got] == [7, 8, None] and got[2].error == "length"
    assert "ATTACK" in wire.line(wire.decoded(wire.messages_in(files)).where("error is null").withColumn("phase", F.lit(3))).first().line


def test_tables(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS t_tables CASCADE")
    assert len(tables.create(spark, "t_tables", dry_run=True)) == 7
    spark.sql("CREATE DATABASE t_tables")
    spark.sql("CREATE TABLE t_tables.traffic_stats (dst_ip STRING) USING parquet")
    spark.sql("INSERT INTO t_tables.traffic_stats VALUES ('192.0.2.1')")
    spark.sql("CREATE TABLE t_tables.service_stats (slot_id INT) USING parquet")
    names = lambda: sorted(t.name for t in spark.catalog.listTables("t_tables"))
    assert sum("ADD COLUMNS" in s for s in tables.create(spark, "t_tables")) == 9
    assert len(names()) == 7 and "traffic_stats_legacy" in names() and "traffic_stats" not in names()
    assert not any("ALTER" in s for s in tables.create(spark, "t_tables"))
    assert tables.verified(spark, "t_tables") == dict.fromkeys(tables.RETENTION_DAYS, 0)
    assert len(tables.rollback(spark, "t_tables")) == 7 and len(names()) == 7
    tables.rollback(spark, "t_tables", confirm=True)
    assert names() == ["traffic_stats"] and spark.table("t_tables.traffic_stats").count() == 1
    spark.sql("DROP DATABASE t_tables CASCADE")
    tables.create(spark, "t_tables")
    assert [f.name for f in spark.table("t_tables.service_stats").schema][:3] == ["timestamp_ns", "slot_id", "sequence_num"] and "phase_str" in spark.table("t_tables.service_stats").columns
    spark.sql("DROP DATABASE t_tables CASCADE")

    path = str(tmp_path / "stats")
    day = 86_400 * 10**9
    rows = spark.createDataFrame([(d * day, s, 1, 2, 3) for d in range(19_700, 19_740) for s in range(3)], "timestamp_ns long, target_ip long, port int, proto_kind int, slot_id int")
    tables.append(rows, path)
    today = dt.date(1970, 1, 1) + dt.timedelta(days=19_739)
    assert tables.kept(spark.read.parquet(path), "service_stats", today).count() == 31 * 3
    assert len(tables.drop_expired(spark, path, "service_stats", today)) == 9
    assert spark.read.parquet(path).count() == 31 * 3
    use = tables.disk_use(spark, {"stats": path}).first()
    assert use.bytes_on_disk > 0 and use.files >= 31

    notes = str(tmp_path / "notes")
    tables.annotate(spark, notes, 5, 1, "new", "", 1)
    with pytest.raises(ValueError):
        tables.annotate(spark, notes, 5, 1, "maybe", "", 2)
    assert spark.read.schema(schemas.ANNOTATIONS).parquet(notes).count() == 1


def test_config_files(tmp_path):
    path = str(tmp_path / "services.json")
    now = dt.datetime(2024, 1, 1)
    for k in range(25):
        tables.save_config(path, adapters.REGISTRY_JSON.replace("dns", f"dns{k}"), now + dt.timedelta(seconds=k))
    kept = tables.backups(path)
    assert len(kept) == 20 and kept == sorted(kept, reverse=True)
    tables.restore_config(path, kept[-1], now + dt.timedelta(hours=1))
    assert "dns4" in open(path).read()
    with pytest.raises(ValueError):
        tables.save_config(path, '{"version": 1}', now)


def test_frames(spark):
    from tickloom.sources import frames

    eth = b"\0" * 12
    ip = lambda proto, opts=b"": bytes([0x45 + len(opts) // 4, 0]) + struct.pack(">HHHBBHII", 60, 0, 0x2001, 64, proto, 0, 0xC0000201, 0x0A000001) + opts
    tcp = struct.pack(">HHIIBBHHH", 443, 9000, 0, 0, 0x60, 0x12, 77, 0, 0)
    cases = [eth + b"\x08\0" + ip(6) + tcp, eth + b"\x81\0\0\x05\x08\0" + ip(6, b"\0" * 4) + tcp, eth + b"\x08\0" + ip(1) + b"\x08\0", eth + b"\x86\xdd" + b"\0" * 60, eth + b"\x08\0" + ip(17)[:10], eth, b"", None]
    got = frames.parsed(spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "tick long, frame binary")).orderBy("tick").collect()
    assert [r.tick for r in got] == [0, 1, 2]
    for r in got[:2]:
        assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.tcp_flags, r.tcp_data_off_bytes, r.tcp_win, r.frag_off) == (0xC0000201, 0x0A000001, 443, 9000, 0x12, 24, 77, 0x2001)
    assert got[1].ihl_bytes == 24 and (got[2].icmp_type, got[2].src_port) == (8, 0)


def test_commands_and_reload(spark):
    from tickloom import commands

    doc, bad = load(spark), load(spark, lambda d: d.update(version=3))
    assert commands.reloaded(None, doc)[0] is doc
    kept, found = commands.reloaded(doc, bad)
    assert kept is doc and [v.rule for v in found] == ["L1"]
    row = commands.reload_event(spark, doc, found, "/x", "2024-01-01 00:00:00", 2, 1).first()
    assert (row.event_type, row.n_total_slots, row.n_catchalls, row.reload_failures) == ("reload_failed", 7, 5, 1) and "L1" in row.error_message
    assert commands.request(spark, 5, 1, 80, 1, "force_ewma_freeze", {"ticks": 3}).first().args_json == '{"ticks": 3}'
    with pytest.raises(ValueError):
        commands.request(spark, 5, 1, 80, 1, "explode")
    from tickloom.operators import step

    s = spark.createDataFrame([(1, 80, 1, step.dumped(step.fresh(step.DEFAULT_PROFILE)))], "target_ip long, port int, proto_kind int, state string")
    assert commands.slot_info(s).first().warmup_remaining == 400


def strict_profile():
    p: dict = {}
    for section, keys in [*registry.WEIGHTS.items(), *registry.PROBABILITIES.items()]:
        at = p
        for part in section.split("."):
            at = at.setdefault(part, {})
        at.update(dict.fromkeys(keys, 0.5))
    return p


def test_strict_documents(spark):
    def whole(d):
        d.update(metadata={}, profiles={"default": strict_profile(), "strict_web": strict_profile()})
        d["catchall_assignments"] = {ip: dict.fromkeys(registry.FAMILIES, "default") for ip in d["protected_ips"]}

    assert registry.violations(load(spark, whole), "strict_v1").count() == 0

    def broken(change):
        def both(d):
            whole(d)
            change(d)

        return {(r.rule, r.path) for r in registry.violations(load(spark, both), "strict_v1").collect()}

    assert broken(lambda d: d["profiles"]["default"]["tier1_l3"]["weights"].pop("src_24_entropy")) == {("L12", "default.tier1_l3.weights.src_24_entropy")}
    assert broken(lambda d: d["profiles"]["default"]["tier1"].update(normal_threshold=1.5)) == {("L12", "default.tier1.normal_threshold")}
    assert broken(lambda d: d["profiles"]["default"]["v2_feature_weights"].update(new_flow_ratio=-0.5)) >= {("L12", "default.v2_feature_weights.new_flow_ratio")}
    assert broken(lambda d: d["profiles"]["default"].update(alpha=0.1)) == {("L13", "default.alpha")}
    assert broken(lambda d: d["services"][0].update(color="red")) == {("L13", "services[0].color")}
    assert ("L10", "services") in broken(lambda d: d["services"].append({"name": "r", "target_ip": "192.0.2.1", "port_range": "1000-1318", "proto": "TCP", "profile": "default"}))


def test_dashboard_actions():
    from tickloom import commands

    assert commands.permitted("ping") == "ping" and len(commands.DASHBOARD_ACTIONS) == 10
    with pytest.raises(PermissionError):
        commands.permitted("request_reload")
