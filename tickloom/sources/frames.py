"""Packet columns from raw Ethernet frames, natively.

One 802.1Q tag is unwrapped; only IPv4 frames that are long enough for their headers
come out.  Protocols other than TCP, UDP and ICMP have no transport fields (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import PACKETS

VLAN, IPV4 = 0x8100, 0x0800


def _at(frame: Column, offset: Column | int, width: int) -> Column:
    """An unsigned big-endian number; null beyond the frame's end."""
    start = F.lit(offset) + 1
    return F.when(F.octet_length(frame) >= start + (width - 1), F.conv(F.hex(F.substr(frame, start, F.lit(width))), 16, 10).try_cast("long"))


def parsed(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """(tick, frame) to the packet columns."""
    f = F.col(frame)
    outer = _at(f, 12, 2)
    l3 = F.when(outer == VLAN, 18).otherwise(14)
    head = frames.withColumns({"_l3": l3, "ether_type": F.when(outer == VLAN, _at(f, 16, 2)).otherwise(outer)}).where(F.col("ether_type") == IPV4)
    head = head.withColumn("_ihl", _at(f, F.col("_l3"), 1).bitwiseAND(15) * 4).where((F.col("_ihl") >= 20) & (F.octet_length(f) >= F.col("_l3") + F.col("_ihl")))
    base = lambda n, w: _at(f, F.col("_l3") + n, w)
    row = head.withColumns({"ip_proto": base(9, 1), "_l4": (F.col("_l3") + F.col("_ihl")).cast("int")})
    tcp, ported = F.col("ip_proto") == 6, F.col("ip_proto").isin(6, 17)
    upper = lambda cond, n, w: F.coalesce(F.when(cond, _at(f, F.col("_l4") + n, w)), F.lit(0).cast("long"))
    whole = row.withColumns({
        "src_ip": base(12, 4), "dst_ip": base(16, 4), "total_len": base(2, 2), "ttl": base(8, 1), "frag_off": base(6, 2), "ihl_bytes": F.col("_ihl"),
        "src_port": upper(ported, 0, 2), "dst_port": upper(ported, 2, 2), "tcp_flags": upper(tcp, 13, 1), "tcp_data_off_bytes": F.shiftright(upper(tcp, 12, 1), 4) * 4,
        "tcp_win": upper(tcp, 14, 2), "icmp_type": upper(F.col("ip_proto") == 1, 0, 1),
    })
    return whole.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in PACKETS.fields))


def encoded(packets: DataFrame, tagged: Column | None = None) -> DataFrame:
    """(tick, frame): a frame with each packet's fields, tagged where the condition holds."""
    h = lambda c, n: F.lpad(F.hex(F.col(c).cast("long")), n, "0")
    ports = F.concat(h("src_port", 4), h("dst_port", 4))
    upper = (
        F.when(F.col("ip_proto") == 6, F.concat(ports, F.lit("0" * 16 + "50"), h("tcp_flags", 2), h("tcp_win", 4), F.lit("0" * 8)))
        .when(F.col("ip_proto") == 17, F.concat(ports, F.lit("0" * 8))).when(F.col("ip_proto") == 1, F.concat(h("icmp_type", 2), F.lit("0" * 14))).otherwise("")
    )
    tag = F.when(tagged, "81000064").otherwise("") if tagged is not None else F.lit("")
    ip = F.concat(F.lit("4500"), h("total_len", 4), F.lit("0000"), h("frag_off", 4), h("ttl", 2), h("ip_proto", 2), F.lit("0000"), h("src_ip", 8), h("dst_ip", 8))
    return packets.select("tick", F.unhex(F.concat(F.lit("0" * 24), tag, h("ether_type", 4), ip, upper)).alias("frame"))
