"""The 468-byte snapshot message: encoding, decoding and a reader for files of messages.

Decoding is native: fields are cut out of the binary column with ``substring``; only
doubles, for which there is no native conversion from their bits, are built from sign,
exponent and fraction.  Malformed messages keep their bytes and get an error class.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the wire format: magic, sizes, and (name, type) of each field in order.
MAGIC, VERSION, SNAPSHOT = b"L2FW", 2, 1
SIZE, HEADER, PAYLOAD = 468, 32, 432
FLOOR_FLAG = 1
HEADER_FIELDS = [("magic", "4s"), ("version", "B"), ("msg_type", "B"), ("flags", "B"), ("_r0", "x"), ("timestamp_ns", "Q"), ("slot_id", "H"), ("payload_len", "H"), ("sequence_num", "Q"), ("_r1", "4x")]
PAYLOAD_FIELDS = [
    ("target_ip", "I"), ("port", "H"), ("proto_kind", "B"), ("is_catchall", "B"), ("profile_name", "8s"),
    ("phase", "B"), ("prev_phase", "B"), ("_r2", "2x"), ("warmup_remaining", "I"), ("consecutive_attack_windows", "I"), ("baseline_freeze_remaining", "I"), ("thaw_cooldown_remaining", "I"), ("windows_seen", "I"),
    *((c, "Q") for c in ("inbound_pkts", "inbound_bytes", "off_proto_pkts", "ip_frag_pkts", "ttl_sum", "ttl_sum_sq", "out_pkts", "out_bytes")),
    *((c, "I") for c in ("out_tcp_pkts", "out_udp_pkts", "out_icmp_pkts")), ("_r3", "4x"),
    *((c, "Q") for c in ("tcp_pkts", "tcp_bytes", "syn_pkts", "syn_ack_pkts", "fin_ack_pkts", "rst_pkts", "ack_data_pkts", "empty_ack_pkts", "zero_window_pkts", "udp_pkts", "udp_bytes", "icmp_pkts")),
    *((c, "d") for c in ("unique_src_ips", "unique_flows", "src_24_top1_share", "src_24_entropy", "ttl_mean", "ttl_stddev", "bw_pps_z_last", "bw_bps_z_last")),
    *((c, "d") for c in ("tier0_score", "tier1_tcp_score", "tier1_udp_score", "tier1_icmp_score", "tier1_dist_score", "tier1_l3_score", "tier1_offproto_score", "tier1_final_score")),
    *((f"win_{n}s_{c}", "I") for n in (10, 60, 300) for c in ("total_pkts", "peak_pps", "attack_seconds")),
    *((f"tier0_risk_{c}", "d") for c in ("pps", "bps", "fps", "burst_pps", "burst_bps", "burst_fps")), ("dominant_channel", "B"), ("_r4", "3x"),
]
WIDTH = {"4s": 4, "8s": 8, "B": 1, "H": 2, "I": 4, "Q": 8, "d": 8, "x": 1, "2x": 2, "3x": 3, "4x": 4}
ERRORS = ["length", "magic", "version", "type", "crc", "payload_length"]


def layout() -> dict[str, tuple[int, str]]:
    """Offset and type of each named field."""
    out, at = {}, 0
    for name, kind in HEADER_FIELDS + PAYLOAD_FIELDS:
        if not name.startswith("_"):
            out[name] = (at, kind)
        at += WIDTH[kind]
    if at != HEADER + PAYLOAD:
        raise AssertionError("the layout does not add up")
    return out


def encoded(row: dict) -> bytes:
    """A message from a row of the statistics table."""
    fields = HEADER_FIELDS + PAYLOAD_FIELDS
    fixed = {"magic": MAGIC, "version": VERSION, "msg_type": SNAPSHOT, "payload_len": PAYLOAD, "flags": FLOOR_FLAG * bool(row.get("absolute_floor_fired"))}
    values = [fixed[n] if n in fixed else (row.get(n) or "").encode("ascii", "replace") if k.endswith("s") else (row.get(n) or 0) for n, k in fields if not n.startswith("_")]
    body = struct.pack(">" + "".join(k for _, k in fields), *values)
    return body + struct.pack(">I", zlib.crc32(body))


def _unsigned(data: Column, at: Column | int, width: int) -> Column:
    return F.conv(F.hex(F.substr(data, F.lit(at) + 1, F.lit(width))), 16, 10).try_cast("long")


def _double(data: Column, at: Column) -> Column:
    """An IEEE double from eight bytes."""
    top, rest = _unsigned(data, at, 2), _unsigned(data, at + 2, 6)
    bits = F.struct(F.when(top >= 32768, -1.0).otherwise(1.0).alias("sign"), F.shiftright(top, 4).bitwiseAND(2047).alias("exponent"), (F.shiftleft(top.bitwiseAND(15), 48) + rest).alias("fraction"))

    def value(x: Column) -> Column:
        normal = x["sign"] * (1 + x["fraction"] / F.lit(2.0**52)) * F.pow(F.lit(2.0), x["exponent"] - 1023)
        special = F.when(x["fraction"] == 0, x["sign"] * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return F.when(x["exponent"] == 2047, special).when(x["exponent"] == 0, x["sign"] * x["fraction"] * F.lit(5e-324)).otherwise(normal)

    return F.transform(F.array(bits), value)[0]


def _text_at(data: Column, width: int):
    return lambda i: F.rtrim(F.substr(data, i + 1, F.lit(width)).cast("string"), F.lit("\0"))


def _number_at(data: Column, width: int):
    return lambda i: _unsigned(data, i, width)


def decoded(messages: DataFrame, data: str = "message") -> DataFrame:
    """The columns of each message and ``error``, null for sound ones; checks come in a fixed order.

    Fields of one type are cut out by one expression over their offsets, which keeps the plan small.
    """
    m, spots = F.col(data), layout()
    kinds: dict[str, list[str]] = {}
    for n, (_, k) in spots.items():
        kinds.setdefault(k, []).append(n)
    cut = {}
    for k, names in kinds.items():
        at = F.array(*(F.lit(spots[n][0]) for n in names))
        if k.endswith("s"):
            cut[k] = F.transform(at, _text_at(m, WIDTH[k]))
        elif k == "d":
            cut[k] = F.transform(at, lambda i: _double(m, i))
        else:
            cut[k] = F.transform(at, _number_at(m, WIDTH[k]))
    body = F.substring(m, 1, HEADER + PAYLOAD)
    rows = messages.withColumns({f"_{k}": F.when(F.octet_length(m) == SIZE, v) for k, v in cut.items()} | {"_crc": F.crc32(body) == _unsigned(m, HEADER + PAYLOAD, 4)})
    value = {n: F.col(f"_{k}")[kinds[k].index(n)] for n, (_, k) in spots.items()}
    checks = [
        (m.isNull() | (F.octet_length(m) != SIZE), "length"), (F.substring(m, 1, 4) != F.lit(MAGIC), "magic"), (value["version"] != VERSION, "version"),
        (value["msg_type"] != SNAPSHOT, "type"), (~F.col("_crc"), "crc"), (value["payload_len"] != PAYLOAD, "payload_length"),
    ]
    error = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        error = F.when(bad, name).otherwise(error)
    names = [n for n in spots if n not in ("magic", "version", "msg_type", "payload_len", "flags")]
    sound = F.col("error").isNull()
    return rows.withColumn("error", error).select(
        *messages.columns, "error", *(F.when(sound, value[n]).alias(n) for n in names), F.when(sound, value["flags"].bitwiseAND(FLOOR_FLAG).cast("int")).alias("absolute_floor_fired")
    )


def messages_in(files: DataFrame) -> DataFrame:
    """(path, n, message) of the concatenated messages of binary files; a short tail is one short message."""
    count = F.ceil(F.octet_length("content") / SIZE).cast("int")
    return files.where("octet_length(content) > 0").select("path", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(F.col("content"), i * SIZE + 1, F.lit(SIZE)))).alias("n", "message"))


def line(stats: DataFrame) -> DataFrame:
    """A message as a line of text of fixed widths."""
    from tickloom.functions.scalars import kind_name, long_to_ip, phase_name

    return stats.select(F.format_string("%-15s %5d %-14s %-10s pkts=%-8d t0=%.3f t1=%.3f", long_to_ip(F.col("target_ip")), "port", kind_name(F.col("proto_kind"), True), phase_name(F.col("phase"), True), "inbound_pkts", "tier0_score", "tier1_final_score").alias("line"))


def encode_rows(stats: DataFrame) -> DataFrame:
    """(slot_id, timestamp_ns, message) for rows of the statistics table."""
    from collections.abc import Iterator

    import pandas as pd

    from tickloom.cluster import ship_package

    ship_package(stats.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"slot_id": b["slot_id"], "timestamp_ns": b["timestamp_ns"], "message": [encoded(r) for r in b.to_dict("records")]})

    return stats.mapInPandas(run, T.StructType([T.StructField("slot_id", T.IntegerType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("message", T.BinaryType())]))
