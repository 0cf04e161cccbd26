"""Scalar functions of the engine as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import CHANNELS, KINDS, PHASES

STRICT_QUAD = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
#: What a 32-bit peak counter holds before its first sample.
PEAK_UNSET = 4294967295


def ip_to_long(text: Column) -> Column:
    """A dotted quad as a number; null unless it is strictly formed (no leading zeros)."""
    number = F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + F.try_to_number(x, F.lit("999")).cast("long"))
    return F.when(text.rlike(STRICT_QUAD), number)


def long_to_ip(ip: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def in_cidr(ip: Column, net: Column, prefix: Column) -> Column:
    """Whether an address lies in net/prefix."""
    drop = F.lit(32) - prefix
    scale = F.pow(F.lit(2.0), drop).cast("long")
    return F.floor(ip / scale) == F.floor(net / scale)


def _named(code: Column, names: dict[int, str], other: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return F.coalesce(out, other)


def phase_name(code: Column, numbered: bool = False) -> Column:
    return _named(code, dict(enumerate(PHASES)), F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")")) if numbered else F.lit("UNKNOWN"))


def kind_name(code: Column, numbered: bool = False) -> Column:
    return _named(code, KINDS, F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")")) if numbered else F.lit("UNKNOWN"))


def channel_name(code: Column) -> Column:
    return _named(code, dict(enumerate(CHANNELS)), F.lit("UNKNOWN"))


def times32(a: Column, b: int) -> Column:
    """The product of two unsigned 32-bit numbers modulo 2**32, without overflow on the way."""
    return ((a.bitwiseAND(65535) * b) + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(65535), 16)).bitwiseAND(4294967295)


def hash32(value: Column) -> Column:
    """The murmur3 finaliser of an unsigned 32-bit number."""
    k = value.cast("long")
    k = k.bitwiseXOR(F.shiftright(k, 16))
    k = times32(k, 0x85EBCA6B)
    k = k.bitwiseXOR(F.shiftright(k, 13))
    k = times32(k, 0xC2B2AE35)
    return k.bitwiseXOR(F.shiftright(k, 16))


def flow_key(src_ip: Column, src_port: Column, dst_port: Column) -> Column:
    return src_ip.cast("long").bitwiseXOR(F.shiftleft(src_port.cast("long"), 16)).bitwiseXOR(dst_port.cast("long"))


def flow_hash(src_ip: Column, src_port: Column, dst_port: Column) -> Column:
    return hash32(flow_key(src_ip, src_port, dst_port))


def bucket_hash(key: Column, width: int) -> Column:
    """Bucket of an unsigned 32-bit key in the first row of a counting sketch; ``width`` is a power of two up to 512.

    The key times the 64-bit golden ratio, xor the row's seed, xor itself shifted by 33.
    Only bits 0 to 8 and 33 to 41 matter, so 42 bits of the product are enough.
    """
    golden, seed = 0x9E3779B97F4A7C15, 0xA5A5A5A5
    k = key.cast("long")
    high = (F.shiftright(k, 16) * (golden % (1 << 26))).bitwiseAND((1 << 26) - 1)
    product = (k.bitwiseAND(65535) * (golden % (1 << 42)) + F.shiftleft(high, 16)).bitwiseAND((1 << 42) - 1)
    return product.bitwiseXOR(F.lit(seed % 512)).bitwiseXOR(F.shiftright(product, 33)).bitwiseAND(width - 1)


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the bytes of a text or binary column."""
    hexed = F.hex(text)
    octets = F.transform(F.sequence(F.lit(0), F.greatest(F.length(hexed) / 2, F.lit(1)).cast("int") - 1), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.when(F.length(hexed) > 0, F.aggregate(octets, start, lambda acc, x: times32(acc.bitwiseXOR(x), 16777619))).otherwise(start)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def z_score(x: Column, mean: Column, variance: Column, samples: Column) -> Column:
    """Distance from a baseline in deviations; 0 without a baseline or with next to no variance."""
    return F.when((samples > 0) & (variance >= 1e-12), (x - mean) / F.sqrt(variance)).otherwise(0.0)


def z_to_score(z: Column) -> Column:
    """A sigmoid of |z| with its middle at 3."""
    return 1 - 1 / (1 + F.exp(F.abs(z) - 3))


def population_cov(mean: Column, m2: Column, n: Column) -> Column:
    return F.when((n > 0) & (mean > 0), F.sqrt(F.greatest(F.when(n > 1, F.try_divide(m2, n)).otherwise(0.0), F.lit(0.0))) / F.when(mean > 0, mean)).otherwise(0.0)


def sample_sd(m2: Column, n: Column) -> Column:
    return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(m2, n - 1), F.lit(0.0)))).otherwise(0.0)


def sample_cov(mean: Column, m2: Column, n: Column) -> Column:
    return F.when(mean > 0, sample_sd(m2, n) / F.when(mean > 0, mean)).otherwise(0.0)


def syn_per_synack(syn: Column, syn_ack: Column) -> Column:
    return F.when(syn_ack > 0, F.try_divide(syn.cast("double"), syn_ack.cast("double"))).otherwise(F.least(F.lit(10.0), syn.cast("double")))


def flows_of_kind(kind: Column, tcp: Column, udp: Column) -> Column:
    return F.when(kind.isin(1, 4), tcp).when(kind.isin(2, 5), udp).when(kind == 7, tcp + udp).otherwise(0.0)


def absolute_floor(pkts: Column, octets: Column, flows: Column, pps_limit: Column, bps_limit: Column, fps_limit: Column) -> Column:
    """Whether any enabled (positive) threshold is reached."""
    reached = [(limit > 0) & (x >= limit) for x, limit in ((pkts.cast("double"), pps_limit), (octets * 8.0, bps_limit), (flows, fps_limit))]
    return reached[0] | reached[1] | reached[2]


def fused(kind: Column, tcp: Column, udp: Column, icmp: Column, dist: Column, l3: Column, off: Column) -> Column:
    """The two highest of the channel scores, discounted: max(0.75 a + 0.25 b, a - 0.15), within 0 and 1."""
    proto = F.when(kind.isin(1, 4), tcp).when(kind.isin(2, 5), udp).when(kind.isin(3, 6), icmp).when(kind == 7, F.greatest(tcp, udp, icmp)).otherwise(0.0)
    top = F.sort_array(F.array(proto, dist, l3, off), asc=False)
    return F.least(F.greatest(0.75 * top[0] + 0.25 * top[1], top[0] - 0.15, F.lit(0.0)), F.lit(1.0))


def dominant_channel(kind: Column, pps: Column, bps: Column, fps: Column, tcp: Column, udp: Column, icmp: Column, dist: Column, l3: Column, off: Column) -> Column:
    """Number of the highest channel, the lowest number among equals; 0 if none reaches 0.15."""
    own = {4: (kind.isin(1, 4, 7), tcp), 5: (kind.isin(2, 5, 7), udp), 6: (kind.isin(3, 6, 7), icmp)}
    scores = {1: pps, 2: bps, 3: fps, 7: dist, 8: l3, 9: off} | {k: F.when(applies, x).otherwise(-1.0) for k, (applies, x) in own.items()}
    best = F.array_max(F.array(*(F.struct(scores[k].alias("score"), F.lit(-k).alias("n")) for k in range(1, 10))))
    return F.when(best["score"] < 0.15, 0).otherwise(-best["n"])


def ttl_sums(mean: Column, m2: Column, n: Column) -> tuple[Column, Column]:
    """Sum and sum of squares from the moments, rounded half to even."""
    return F.bround(mean * n).cast("long"), F.bround(m2 + n * mean * mean).cast("long")


def seconds_of(ns: Column) -> Column:
    """A timestamp of whole seconds from nanoseconds."""
    return F.timestamp_seconds(((ns - F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000).cast("long"))


def format_peak(peak: Column) -> Column:
    """Thousands separators; a dash for a counter without a sample."""
    return F.when(peak.isNull() | (peak == PEAK_UNSET), "-").otherwise(F.format_number(peak, 0))


def format_compact(n: Column) -> Column:
    """K, M and G with one decimal."""
    x = n.cast("double")
    return F.when(x >= 1e9, F.format_string("%.1fG", x / 1e9)).when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x))


def format_bytes(n: Column) -> Column:
    x = n.cast("double")
    k = 1024.0
    return F.when(x >= k**3, F.format_string("%.1f GB", x / k**3)).when(x >= k**2, F.format_string("%.1f MB", x / k**2)).when(x >= k, F.format_string("%.1f KB", x / k)).otherwise(F.format_string("%.0f B", x))


def format_age(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds ago", s)).when(s < 3600, F.format_string("%dm ago", F.floor(s / 60).cast("long"))).when(s < 86400, F.format_string("%dh ago", F.floor(s / 3600).cast("long"))).otherwise(F.format_string("%dd ago", F.floor(s / 86400).cast("long")))
