"""Exact relational forms of the engine's cardinality and heavy-hitter sketches.

A register array is a grouping by register with a maximum, a counter row is a grouping
by bucket with a count, so both combine on the map side and have no Python.  The
scope says what a published estimate covers: ``window`` one tick, ``cumulative`` all
ticks so far, ``bank`` all ticks so far of the same parity, as two alternating banks
that are never cleared would give.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import bucket_hash, flow_key, hash32

REGISTERS = 1024
SUBNET_BUCKETS, PORT_BUCKETS = 512, 256
#: Fixed value: the bias of an estimator with 1024 registers.
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)
SCOPES = ("window", "cumulative", "bank")
ESTIMATES = ["est_unique_src_ips", "est_unique_flows", "est_tcp_new_flows", "est_udp_flows", "est_other_dst_ports"]


def observations(routed: DataFrame) -> DataFrame:
    """(tick, slot_id, sketch, h): what each routed packet adds to the register sketches."""
    on_tcp = (F.col("ip_proto") == 6) & F.col("proto_kind").isin(1, 4, 7)
    on_udp = (F.col("ip_proto") == 17) & F.col("proto_kind").isin(2, 5, 7)
    # keys are hashed after they are dealt out: a generator would work out a hash's common parts again and again
    keys = routed.where("slot_id is not null").select(
        "tick", "slot_id", "inbound", F.when(on_tcp, "est_tcp_new_flows").when(on_udp, "est_udp_flows").alias("arm"), (F.col("proto_kind") == 7).alias("other"), (F.col("dst_port") != 0).alias("ported"),
        F.when(F.col("inbound"), F.col("src_ip")).otherwise(F.col("dst_ip")).alias("peer"), flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_port")).alias("flow"), "dst_port",
    )
    seen = lambda sketch, key: F.struct(sketch.alias("sketch"), F.col(key).cast("long").alias("key"))
    inbound = F.array(seen(F.lit("est_unique_src_ips"), "peer"), seen(F.lit("est_unique_flows"), "flow"), seen(F.col("arm"), "flow"), seen(F.when(F.col("other"), "est_other_dst_ports"), "dst_port"))
    outbound = F.array(seen(F.lit("out_dst_ips"), "peer"), seen(F.when(F.col("ported"), "out_dst_ports"), "dst_port"))
    each = keys.select("tick", "slot_id", F.inline(F.when(F.col("inbound"), inbound).otherwise(outbound))).where("sketch is not null")
    return each.select("tick", "slot_id", "sketch", hash32(F.col("key")).alias("h"))


def _rank(h: Column) -> Column:
    """1 + leading zeros of a hash's upper 22 bits."""
    upper = F.shiftright(h, 10)
    return F.lit(22) - reduce(add, ((upper >= 1 << k).cast("int") for k in range(1, 22)))


def registers(seen: DataFrame, *keys: str) -> DataFrame:
    """The largest rank in each register."""
    return seen.groupBy(*keys, F.col("h").bitwiseAND(REGISTERS - 1).alias("idx")).agg(F.max(_rank(F.col("h"))).alias("rank"))


def estimate(total: Column, used: Column) -> Column:
    """From the sum of 2**-rank over the used registers and their number."""
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / (total + (REGISTERS - used))
    empty = REGISTERS - used
    return F.when((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * F.ln(F.lit(float(REGISTERS)) / F.greatest(empty, F.lit(1)))).otherwise(raw)


def _scoped(regs: DataFrame, scope: str) -> DataFrame:
    """Registers as each tick publishes them; ticks are those in which the slot's sketch saw anything."""
    if scope == "window":
        return regs
    bank = F.col("tick") % 2 if scope == "bank" else F.lit(0)
    regs = regs.withColumn("bank", bank)
    # a register holds its maximum from the tick of a rise until the next rise, so only rises are carried on
    w = Window.partitionBy("slot_id", "sketch", "bank", "idx").orderBy("tick")
    rises = regs.withColumn("before", F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before is null or rank > before")
    # the sum and the number of used registers change only by the rises, so they are running sums of changes
    change = rises.select("slot_id", "sketch", "bank", "tick", (F.pow(F.lit(2.0), -F.col("rank")) - F.coalesce(F.pow(F.lit(2.0), -F.col("before")), F.lit(0.0))).alias("d_total"), F.when(F.col("before").isNull(), 1).otherwise(0).alias("d_used"))
    return change.groupBy("slot_id", "sketch", "bank", "tick").agg(F.sum("d_total").alias("d_total"), F.sum("d_used").alias("d_used"))


def estimates(seen: DataFrame, scope: str = "window") -> DataFrame:
    """(tick, slot_id, sketch, estimate)."""
    regs = registers(seen, "tick", "slot_id", "sketch")
    if scope == "window":
        each = regs.groupBy("tick", "slot_id", "sketch").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("total"), F.count("*").alias("used"))
        return each.select("tick", "slot_id", "sketch", estimate(F.col("total"), F.col("used")).alias("estimate"))
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    ticks = regs.select("tick", "slot_id", "sketch").distinct().withColumn("bank", F.col("tick") % 2 if scope == "bank" else F.lit(0))
    changes = ticks.join(_scoped(regs, scope), ["slot_id", "sketch", "bank", "tick"], "left")
    w = Window.partitionBy("slot_id", "sketch", "bank").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    run = changes.select("tick", "slot_id", "sketch", F.sum(F.coalesce("d_total", F.lit(0.0))).over(w).alias("total"), F.sum(F.coalesce("d_used", F.lit(0))).over(w).alias("used"))
    return run.select("tick", "slot_id", "sketch", estimate(F.col("total"), F.col("used")).alias("estimate"))


def subnet_counts(routed: DataFrame) -> DataFrame:
    """Inbound packets by tick, slot and bucket of the source's /24."""
    net = F.col("src_ip") - F.col("src_ip") % 256
    hit = routed.where("inbound and slot_id is not null").select("tick", "slot_id", bucket_hash(net, SUBNET_BUCKETS).alias("bucket"))
    return hit.groupBy("tick", "slot_id", "bucket").agg(F.count("*").alias("n"))


def _grown(counts: DataFrame, scope: str, *keys: str) -> DataFrame:
    """(tick, *keys, total, top, weighted) of the bucket counts so far: their sum, their largest and the sum of n log2 n.

    Counts only rise, so what a tick adds to each of the three is known from the buckets it
    hits; these additions are summed up over the ticks, and no bucket is carried through
    ticks that do not hit it.
    """
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    if scope == "window":
        return counts.groupBy("tick", *keys).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.sum(weight(F.col("n"))).alias("weighted"))
    counts = counts.withColumn("bank", F.col("tick") % 2 if scope == "bank" else F.lit(0))
    so_far = Window.partitionBy(*keys, "bank", "bucket").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    hits = counts.withColumn("after", F.sum("n").over(so_far))
    each = hits.groupBy(*keys, "bank", "tick").agg(F.sum("n").alias("n"), F.max("after").alias("top"), F.sum(weight(F.col("after")) - weight(F.col("after") - F.col("n"))).alias("weighted"))
    run = Window.partitionBy(*keys, "bank").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("tick", *keys, F.sum("n").over(run).alias("total"), F.max("top").over(run).alias("top"), F.sum("weighted").over(run).alias("weighted"))


def subnet_shape(routed: DataFrame, scope: str = "window") -> DataFrame:
    """(tick, slot_id, src_24_top1_share, src_24_entropy) over the buckets."""
    each = _grown(subnet_counts(routed), scope, "slot_id")
    # -sum p log2 p = log2 N - sum(n log2 n) / N
    return each.select("tick", "slot_id", (F.col("top") / F.col("total")).alias("src_24_top1_share"), (F.log2("total") - F.col("weighted") / F.col("total")).alias("src_24_entropy"))


def port_tops(routed: DataFrame, scope: str = "window") -> DataFrame:
    """(tick, slot_id, arm, top_count, total) of source ports on the TCP and UDP arms."""
    arm = F.when((F.col("ip_proto") == 6) & F.col("proto_kind").isin(1, 4, 7), "tcp").when((F.col("ip_proto") == 17) & F.col("proto_kind").isin(2, 5, 7), "udp")
    r = routed.where("inbound and slot_id is not null").select("tick", "slot_id", arm.alias("arm"), bucket_hash(F.col("src_port"), PORT_BUCKETS).alias("bucket")).where("arm is not null")
    each = _grown(r.groupBy("tick", "slot_id", "arm", "bucket").agg(F.count("*").alias("n")), scope, "slot_id", "arm")
    return each.select("tick", "slot_id", "arm", F.col("top").alias("top_count"), "total")


SUBNETS, TCP_PORTS, UDP_PORTS = range(len(ESTIMATES), len(ESTIMATES) + 3)


def cells(routed: DataFrame) -> DataFrame:
    """(tick, slot_id, what, idx, rank, n): all registers and buckets that inbound packets hit, from one pass.

    ``what`` numbers ESTIMATES, then subnets and the ports of either arm.
    """
    on_tcp = (F.col("ip_proto") == 6) & F.col("proto_kind").isin(1, 4, 7)
    on_udp = (F.col("ip_proto") == 17) & F.col("proto_kind").isin(2, 5, 7)
    arm = F.when(on_tcp, 0).when(on_udp, 1)
    keys = routed.where("inbound and slot_id is not null").select("tick", "slot_id", "src_ip", "src_port", "dst_port", arm.alias("arm"), F.when(F.col("proto_kind") == 7, 4).alias("other"), flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_port")).alias("flow"))
    add_to = lambda what, key: F.struct(what.alias("what"), key.cast("long").alias("key"))
    each = F.array(
        add_to(F.lit(0), F.col("src_ip")), add_to(F.lit(1), F.col("flow")), add_to(F.col("arm") + 2, F.col("flow")), add_to(F.col("other"), F.col("dst_port")),
        add_to(F.lit(SUBNETS), F.col("src_ip") - F.col("src_ip") % 256), add_to(F.col("arm") + TCP_PORTS, F.col("src_port")),
    )
    # keys are hashed after they are dealt out: one hash in the code instead of six keeps it small enough to be compiled
    hit = keys.select("tick", "slot_id", F.inline(each)).where("what is not null").withColumn("h", hash32(F.col("key")))
    bucket = F.when(F.col("what") < SUBNETS, F.col("h").bitwiseAND(REGISTERS - 1)).when(F.col("what") == SUBNETS, bucket_hash(F.col("key"), SUBNET_BUCKETS)).otherwise(bucket_hash(F.col("key"), PORT_BUCKETS))
    ranked = hit.select("tick", "slot_id", "what", bucket.cast("int").alias("idx"), _rank(F.col("h")).alias("rank"))
    return ranked.groupBy("tick", "slot_id", "what", "idx").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))


def measured(routed: DataFrame, scope: str = "window") -> DataFrame:
    """(tick, slot_id, ...) with every sketch column of a snapshot, at ticks at which the slot saw an inbound packet.

    What a tick adds to the sums, maxima and used registers is known from the cells it
    hits; over more than one tick these additions are summed up.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    c = cells(routed).withColumn("bank", F.col("tick") % 2 if scope == "bank" else F.lit(0))
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    before = Window.partitionBy("slot_id", "bank", "what", "idx").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    was = (lambda f, none: F.lit(none)) if scope == "window" else (lambda f, none: f.over(before))
    c = c.withColumns({"rank0": was(F.max("rank"), None).cast("int"), "n0": F.coalesce(was(F.sum("n"), 0), F.lit(0))})
    fresh = F.col("rank0").isNull()
    total = F.when(fresh, F.pow(F.lit(2.0), -F.col("rank"))).when(F.col("rank") > F.col("rank0"), F.pow(F.lit(2.0), -F.col("rank")) - F.pow(F.lit(2.0), -F.col("rank0"))).otherwise(0.0)
    now = F.col("n0") + F.col("n")
    of = lambda what, x: F.when(F.col("what") == what, x)
    sums = {f"total{k}": of(k, total) for k in range(len(ESTIMATES))} | {f"used{k}": of(k, fresh.cast("long")) for k in range(len(ESTIMATES))}
    sums |= {f"n{k}": of(k, F.col("n")) for k in (SUBNETS, TCP_PORTS, UDP_PORTS)} | {"weighted": of(SUBNETS, weight(now) - weight(F.col("n0")))}
    tops = {f"top{k}": of(k, now) for k in (SUBNETS, TCP_PORTS, UDP_PORTS)}
    each = c.groupBy("tick", "slot_id", "bank").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in sums.items()), *(F.coalesce(F.max(x), F.lit(0)).alias(k) for k, x in tops.items()))
    if scope != "window":
        so_far = Window.partitionBy("slot_id", "bank").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
        each = each.select("tick", "slot_id", *(F.sum(k).over(so_far).alias(k) for k in sums), *(F.max(k).over(so_far).alias(k) for k in tops))
    n = F.col(f"n{SUBNETS}")
    return each.select(
        "tick", "slot_id", *(estimate(F.col(f"total{k}"), F.col(f"used{k}")).alias(name) for k, name in enumerate(ESTIMATES)),
        (F.col(f"top{SUBNETS}") / n).alias("src_24_top1_share"), (F.log2(n) - F.col("weighted") / n).alias("src_24_entropy"),
        *(F.col(f"{x}{k}").alias(f"{arm}_cm_src_port_{name}") for arm, k in (("tcp", TCP_PORTS), ("udp", UDP_PORTS)) for x, name in (("top", "top_count"), ("n", "total"))),
    )


SKETCHED = [*ESTIMATES, "src_24_top1_share", "src_24_entropy", *(f"{arm}_cm_src_port_{x}" for arm in ("tcp", "udp") for x in ("top_count", "total"))]


def _mul(a: str, b: int) -> str:
    return f"CAST((({a})::HUGEINT * {b}) % 4294967296 AS BIGINT)"


def hash32_sql(k: str) -> str:
    k = f"xor({k}, ({k}) >> 16)"
    k = _mul(k, 0x85EBCA6B)
    k = f"xor({k}, ({k}) >> 13)"
    k = _mul(k, 0xC2B2AE35)
    return f"xor({k}, ({k}) >> 16)"


def bucket_sql(key: str, width: int) -> str:
    product = f"((({key})::HUGEINT * 11400714819323198485) % 18446744073709551616)"
    return f"xor(xor(CAST({product} % {width} AS BIGINT), {0xA5A5A5A5 % width}), CAST(({product} // 8589934592) % {width} AS BIGINT))"


OBSERVED_SQL = f"""
seen0 AS (
  SELECT tick, slot_id, inbound, ip_proto, proto_kind, dst_port, CAST(src_ip AS BIGINT) AS a, CAST(dst_ip AS BIGINT) AS b, CAST(dst_port AS BIGINT) AS p,
    xor(xor(CAST(src_ip AS BIGINT), CAST(src_port AS BIGINT) << 16), CAST(dst_port AS BIGINT)) AS f
  FROM routed WHERE slot_id IS NOT NULL
), seen AS (
  SELECT tick, slot_id, sketch, h FROM (
    SELECT tick, slot_id, 'est_unique_src_ips' AS sketch, {hash32_sql("a")} AS h FROM seen0 WHERE inbound
    UNION ALL SELECT tick, slot_id, 'est_unique_flows', {hash32_sql("f")} FROM seen0 WHERE inbound
    UNION ALL SELECT tick, slot_id, 'est_tcp_new_flows', {hash32_sql("f")} FROM seen0 WHERE inbound AND ip_proto = 6 AND proto_kind IN (1, 4, 7)
    UNION ALL SELECT tick, slot_id, 'est_udp_flows', {hash32_sql("f")} FROM seen0 WHERE inbound AND ip_proto = 17 AND proto_kind IN (2, 5, 7)
    UNION ALL SELECT tick, slot_id, 'est_other_dst_ports', {hash32_sql("p")} FROM seen0 WHERE inbound AND proto_kind = 7
    UNION ALL SELECT tick, slot_id, 'out_dst_ips', {hash32_sql("b")} FROM seen0 WHERE NOT inbound
    UNION ALL SELECT tick, slot_id, 'out_dst_ports', {hash32_sql("p")} FROM seen0 WHERE NOT inbound AND dst_port <> 0)
), regs AS (
  SELECT tick, slot_id, sketch, h & 1023 AS idx, max(23 - length(bin((h >> 10) | 1))) AS rank FROM seen GROUP BY ALL
)"""


def estimate_sql(total: str, used: str) -> str:
    raw = f"({ALPHA * REGISTERS * REGISTERS!r} / ({total} + (1024 - {used})))"
    return f"CASE WHEN {raw} <= 2560 AND {used} < 1024 THEN 1024 * ln(1024.0 / greatest(1024 - {used}, 1)) ELSE {raw} END"
