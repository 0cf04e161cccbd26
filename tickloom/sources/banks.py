"""Images of the engine's snapshot region: a header and two banks of fixed-size records.

An image is one row (path, content), as ``binaryFile`` reads it.  Its header is checked
against the contract first, an image that breaks it gives one row with the error and
nothing else.  Of the two banks the published one is decoded: record i belongs to slot i,
and a slot without a protocol is idle.  Images of one sequence number are the same tick.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.cluster import ship_package
from tickloom.schemas import COUNTERS, MEASURES, SNAPSHOTS

# Fixed values of the region: magic, versions, sizes, codes of the kinds, and the fields of header and record in order.
MAGIC, FORMAT_VERSION, RECORD_VERSION = b"ADS1", 1, 2
HEADER_SIZE, RECORD_SIZE = 128, 384
KINDS = {"<u8": 1, "<u4": 2, "<u2": 3, "u1": 4, "<f8": 5, "S8": 6}
HEADER = np.dtype({
    "names": ["magic", "format_version", "record_version", "record_size", "layout_hash", "capacity", "n_active", "active_bank", "registry_epoch", "seq_bank0", "seq_bank1", "produced_ts_ns"],
    "formats": ["S4", *["<u4"] * 7, *["<u8"] * 4], "offsets": [*range(0, 32, 4), 32, 40, 48, 56], "itemsize": HEADER_SIZE,
})
ORDER = [
    "inbound_pkts", "inbound_bytes", "off_proto_pkts", "ip_frag_pkts", "ttl_mean", "ttl_M2", "out_pkts", "out_bytes", "out_tcp_pkts", "out_udp_pkts", "out_icmp_pkts",
    "tcp_pkts", "tcp_bytes", "syn_pkts", "syn_ack_pkts", "fin_ack_pkts", "rst_pkts", "ack_data_pkts", "empty_ack_pkts", "zero_window_pkts", "small_window_pkts",
    "tcp_pkt_size_mean", "tcp_pkt_size_M2", "tcp_cm_src_port_top_count", "tcp_cm_src_port_total", "udp_pkts", "udp_bytes", "udp_pkt_size_mean", "udp_pkt_size_M2",
    "udp_cm_src_port_top_count", "udp_cm_src_port_total", "icmp_pkts", "icmp_echo_pkts", "icmp_bytes", "other_pkts", "other_bytes",
    "est_unique_src_ips", "est_unique_flows", "src_24_top1_share", "src_24_entropy", "est_tcp_new_flows", "est_udp_flows", "est_other_dst_ports",
    "target_ip", "window_count", "port", "proto_kind", "is_catchall", "absolute_floor_fired", "profile_name",
]
NARROW = {"target_ip": "<u4", "window_count": "<u4", "port": "<u2", "proto_kind": "u1", "is_catchall": "u1", "absolute_floor_fired": "u1", "profile_name": "S8"}


def _record() -> np.dtype:
    formats = [NARROW.get(c) or ("<f8" if c in MEASURES else "<u8") for c in ORDER]
    ends = np.cumsum([np.dtype(f).itemsize for f in formats])
    return np.dtype({"names": ORDER, "formats": formats, "offsets": [0, *ends[:-1].tolist()], "itemsize": RECORD_SIZE})


RECORD = _record()


def layout_hash() -> int:
    """FNV-1a over offset, size and kind of every field, so that a change of any of them is seen."""
    h = 2166136261
    for name in ORDER:
        kind, at = RECORD.fields[name][:2]
        for octet in at.to_bytes(2, "little") + kind.itemsize.to_bytes(2, "little") + bytes([KINDS[NARROW.get(name) or ("<f8" if name in MEASURES else "<u8")]]):
            h = (h ^ octet) * 16777619 % (1 << 32)
    return h


LAYOUT = layout_hash()


def broken(content: bytes) -> str | None:
    """What about an image breaks the contract, if anything does."""
    if len(content) < HEADER_SIZE:
        return "length"
    h = np.frombuffer(content, HEADER, 1)[0]
    if bytes(h["magic"]) != MAGIC:
        return "magic"
    for name, want in (("format_version", FORMAT_VERSION), ("record_version", RECORD_VERSION), ("record_size", RECORD_SIZE), ("layout_hash", LAYOUT)):
        if int(h[name]) != want:
            return name
    return "length" if len(content) < HEADER_SIZE + 2 * int(h["capacity"]) * RECORD_SIZE else None


def image(records: list[dict], capacity: int, bank: int, seq: int, epoch: int, produced_ts_ns: int) -> bytes:
    """An image whose published bank holds these records, by their slot_id; for tests and replays."""
    h, r = np.zeros(1, HEADER), np.zeros((2, capacity), RECORD)
    values = {"magic": MAGIC, "format_version": FORMAT_VERSION, "record_version": RECORD_VERSION, "record_size": RECORD_SIZE, "layout_hash": LAYOUT, "capacity": capacity, "n_active": len(records), "active_bank": bank, "registry_epoch": epoch, f"seq_bank{bank}": seq, "produced_ts_ns": produced_ts_ns}
    for name, v in values.items():
        h[name] = v
    for row in records:
        for name in ORDER:
            r[bank, row["slot_id"]][name] = row[name].encode() if name == "profile_name" else row[name]
    return h.tobytes() + r.tobytes()


def records(images: DataFrame) -> DataFrame:
    """Snapshot records of the active slots of images (path, content); of a broken image one row with ``error``."""
    ship_package(images.sparkSession)
    schema = T.StructType([*SNAPSHOTS.fields, T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])
    kinds = to_arrow_schema(schema)
    plain = {*COUNTERS, *MEASURES, *NARROW} - {"profile_name"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                raw = content.as_py() or b""
                if error := broken(raw):
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "error": error}], schema=kinds)
                    continue
                h = np.frombuffer(raw, HEADER, 1)[0]
                bank, capacity = int(h["active_bank"]) & 1, int(h["capacity"])
                every = np.frombuffer(raw, RECORD, capacity, HEADER_SIZE + bank * capacity * RECORD_SIZE)
                slot = np.flatnonzero(every["proto_kind"])
                rows, n = every[slot], len(slot)
                seq = int(h[f"seq_bank{bank}"])
                whole = {"tick": seq - 1, "seq": seq, "produced_ts_ns": int(h["produced_ts_ns"]), "registry_epoch": int(h["registry_epoch"]), "path": path.as_py(), "error": None}
                cols = []
                for f in kinds:
                    if f.name in plain:
                        cols.append(pa.array(rows[f.name].astype(np.float64 if f.name in MEASURES else np.int64)).cast(f.type))
                    elif f.name == "slot_id":
                        cols.append(pa.array(slot).cast(f.type))
                    elif f.name == "profile_name":
                        cols.append(pa.array([x.decode("ascii", "replace") for x in rows["profile_name"].tolist()], f.type))
                    else:
                        cols.append(pa.array([whole[f.name]] * n, f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    return images.select("path", "content").mapInArrow(run, schema)


def fresh(rows: DataFrame) -> DataFrame:
    """The records of each sequence number once, however often its image was read."""
    return rows.where(F.col("error").isNull()).dropDuplicates(["seq", "slot_id"]).drop("path", "error")
