"""Packets from the order lines of a star schema, for tests and benchmarks without a network."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two protected addresses of a documentation range; the second has an OTHER catchall only.
SERVICE_IP, OTHER_IP = 3221225985, 3221225986
#: Tick 0 of the adapter, in seconds.
EPOCH_S = 1_704_067_200

REGISTRY_JSON = json.dumps({
    "version": 1,
    "protected_ips": ["192.0.2.1", "192.0.2.2"],
    "profiles": {
        "default": {"alpha": 0.05, "variance_ceiling_factor": 6.0, "baseline_freeze_windows": 8, "thaw_cooldown_windows": 6, "warmup_windows": 20},
        "strict_web": {"alpha": 0.1, "variance_ceiling_factor": 6.0, "absolute_pps_threshold": 400.0, "baseline_freeze_windows": 8, "thaw_cooldown_windows": 6, "warmup_windows": 20},
    },
    "catchall_assignments": {"192.0.2.1": {"tcp": "default", "udp": "default", "icmp": "default", "other": "default"}, "192.0.2.2": {"other": "default"}},
    "services": [
        {"name": "web", "target_ip": "192.0.2.1", "port": 443, "proto": "TCP", "profile": "strict_web", "detection_enabled": True},
        {"name": "dns", "target_ip": "192.0.2.1", "port": 53, "proto": "UDP", "profile": "default", "detection_enabled": True},
    ],
})


def packets_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One packet for each order line, in weekly ticks; integer arithmetic only."""
    c = F.col
    proto = F.when(c("l_returnflag") == "A", 6).when(c("l_returnflag") == "N", 17).when(c("l_linestatus") == "F", 1).otherwise(47)
    peer_ip = F.lit(167772160) + c("l_suppkey") * 256 + c("l_partkey") % 256
    other = (c("l_returnflag") == "A") & (c("l_linestatus") == "O") & (c("l_linenumber") == 7)
    svc_ip = F.when(other, F.lit(OTHER_IP)).otherwise(F.lit(SERVICE_IP)).cast("long")
    ported = c("l_returnflag").isin("A", "N")
    svc_port = F.when(~ported, 0).when(c("l_linestatus") == "O", 1024 + c("l_partkey") % 1000).when(c("l_returnflag") == "A", 443).otherwise(53).cast("int")
    peer_port = F.when(ported, 1024 + c("l_orderkey") % 60000).otherwise(0).cast("int")
    outward, stray = c("l_suppkey") % 10 == 9, c("l_partkey") % 97 == 0
    length = F.when(c("l_linenumber") == 4, 40).otherwise(40 + c("l_quantity").cast("int") * 28)
    n = c("l_linenumber")
    return lineitem.select(
        F.floor(F.datediff("l_shipdate", F.lit("1995-01-02").cast("date")) / 7).cast("long").alias("tick"),
        F.lit(2048).alias("ether_type"), proto.alias("ip_proto"),
        F.when(stray, peer_ip).when(outward, svc_ip).otherwise(peer_ip).alias("src_ip"),
        F.when(stray, peer_ip + 1).when(outward, peer_ip).otherwise(svc_ip).alias("dst_ip"),
        length.cast("int").alias("total_len"), (32 + n * 16).cast("int").alias("ttl"),
        F.when(c("l_partkey") % 20 == 0, 1).otherwise(0).alias("frag_off"), F.lit(20).alias("ihl_bytes"),
        F.when(outward & ~stray, svc_port).otherwise(peer_port).alias("src_port"),
        F.when(outward & ~stray, peer_port).otherwise(svc_port).alias("dst_port"),
        F.when(n == 1, 2).when(n == 2, 18).when(n == 5, 17).when(n == 6, 4).otherwise(16).alias("tcp_flags"),
        F.lit(20).alias("tcp_data_off_bytes"), F.when(n == 7, 0).otherwise(1024).alias("tcp_win"),
        F.when(n % 2 == 1, 8).otherwise(0).alias("icmp_type"),
    )


PACKETS_SQL = f"""
packets AS (
  SELECT *, 2048 AS ether_type,
    CASE WHEN stray THEN peer_ip WHEN outward THEN svc_ip ELSE peer_ip END AS src_ip,
    CASE WHEN stray THEN peer_ip + 1 WHEN outward THEN peer_ip ELSE svc_ip END AS dst_ip,
    CASE WHEN outward AND NOT stray THEN svc_port ELSE peer_port END AS src_port,
    CASE WHEN outward AND NOT stray THEN peer_port ELSE svc_port END AS dst_port
  FROM (
    SELECT date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) // 7 AS tick,
      CASE WHEN l_returnflag = 'A' THEN 6 WHEN l_returnflag = 'N' THEN 17 WHEN l_linestatus = 'F' THEN 1 ELSE 47 END AS ip_proto,
      167772160 + l_suppkey * 256 + l_partkey % 256 AS peer_ip,
      CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_linenumber = 7 THEN {OTHER_IP} ELSE {SERVICE_IP} END AS svc_ip,
      CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 0 WHEN l_linestatus = 'O' THEN 1024 + l_partkey % 1000 WHEN l_returnflag = 'A' THEN 443 ELSE 53 END AS svc_port,
      CASE WHEN l_returnflag IN ('A', 'N') THEN 1024 + l_orderkey % 60000 ELSE 0 END AS peer_port,
      l_suppkey % 10 = 9 AS outward, l_partkey % 97 = 0 AS stray,
      CASE WHEN l_linenumber = 4 THEN 40 ELSE 40 + CAST(l_quantity AS INTEGER) * 28 END AS total_len,
      32 + l_linenumber * 16 AS ttl, CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS frag_off, 20 AS ihl_bytes,
      CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 18 WHEN 5 THEN 17 WHEN 6 THEN 4 ELSE 16 END AS tcp_flags,
      20 AS tcp_data_off_bytes, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1024 END AS tcp_win,
      CASE WHEN l_linenumber % 2 = 1 THEN 8 ELSE 0 END AS icmp_type
    FROM lineitem
  )
), slots(slot_id, target_ip, port, proto_kind, is_catchall, profile_name) AS (
  VALUES (0, {SERVICE_IP}, 0, 4, 1, 'default'), (1, {SERVICE_IP}, 0, 5, 1, 'default'), (2, {SERVICE_IP}, 0, 6, 1, 'default'),
         (3, {SERVICE_IP}, 0, 7, 1, 'default'), (4, {OTHER_IP}, 0, 7, 1, 'default'),
         (5, {SERVICE_IP}, 443, 1, 0, 'strict_web'), (6, {SERVICE_IP}, 53, 2, 0, 'default')
)"""
