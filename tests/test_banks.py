"""Images of the snapshot region: contract, banks, idle slots."""

import struct

from tests.test_detector import profiles, snapshots
from tickloom.operators import detect
from tickloom.schemas import SNAPSHOTS
from tickloom.sources import banks


def test_layout():
    assert banks.RECORD.itemsize == 384 and banks.RECORD.fields["target_ip"][1] == 344 and banks.RECORD.fields["profile_name"][1] == 357
    h = 0x811C9DC5
    for name in banks.ORDER:
        kind, at = banks.RECORD.fields[name][:2]
        code = {"u8": 1, "u4": 2, "u2": 3, "u1": 4, "f8": 5, "S8": 6}[kind.str[1:]]
        for b in struct.pack("<HHB", at, kind.itemsize, code):
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    assert banks.LAYOUT == h


def test_records(spark, tmp_path):
    rows = [r.asDict() for r in snapshots(spark, range(4)).collect()]
    for t in range(4):
        tick = [r | {"slot_id": 2 * r["slot_id"] + 1} for r in rows if r["tick"] == t]
        (tmp_path / f"{t}.bank").write_bytes(banks.image(tick, 6, t % 2, t + 1, 3, t * 10**9))
    (tmp_path / "again.bank").write_bytes((tmp_path / "2.bank").read_bytes())
    images = spark.read.format("binaryFile").load(str(tmp_path))
    got = banks.fresh(banks.records(images))
    assert [f.name for f in got.schema] == [f.name for f in SNAPSHOTS.fields]
    want = {(r["tick"], 2 * r["slot_id"] + 1): r for r in rows}
    assert got.count() == len(want)
    for r in got.collect():
        mine = want[r.tick, r.slot_id] | {"slot_id": r.slot_id, "seq": r.tick + 1, "registry_epoch": 3}
        assert r.asDict() == mine
    assert detect.detected(got, profiles(spark)).count() == len(want)


def test_broken_images(spark):
    good = banks.image([], 4, 0, 1, 1, 0)
    at = lambda k, b: good[:k] + b + good[k + len(b) :]
    bad = [("short", good[:50], "length"), ("cut", good[:-1], "length"), ("magic", at(0, b"XXXX"), "magic"), ("version", at(4, b"\x09"), "format_version"), ("record", at(8, b"\x01"), "record_version"), ("size", at(12, b"\x01\x00"), "record_size"), ("layout", at(16, b"\x00\x00"), "layout_hash"), ("none", None, "length")]
    got = banks.records(spark.createDataFrame([(p, c) for p, c, _ in bad] + [("good", good)], "path string, content binary")).collect()
    assert {(r.path, r.error) for r in got} == {(p, e) for p, _, e in bad}
