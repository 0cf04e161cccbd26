"""The registry document: loading, expansion to slots, and validation as one table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import ip_to_long
from tickloom.schemas import MAX_IPS, MAX_PROFILES, MAX_SERVICES, MAX_SLOTS

FAMILIES = ["tcp", "udp", "icmp", "other"]
PROTOS = {"TCP": 1, "UDP": 2, "ICMP": 3}
SECTIONS = ["tier0_weights", "tier1_weights", "fusion_weights", "thresholds", "absolute_thresholds"]
#: Fallbacks of knobs that are missing or not positive; thresholds fall back to 0, which disables them.
KNOBS = {"alpha": 0.05, "variance_ceiling_factor": 6.0, "baseline_freeze_windows": 60, "thaw_cooldown_windows": 30, "warmup_windows": 400}
THRESHOLDS = ["absolute_pps_threshold", "absolute_bps_threshold", "absolute_fps_threshold"]
FLAGS = ["fix_fps_source", "fix_frag_zscore"]
# What strict documents may hold, and the weights and probabilities that each of their profiles must give.
TOP_KEYS = ["version", "metadata", "protected_ips", "profiles", "catchall_assignments", "services"]
PROFILE_KEYS = ["tier0", "tier1", "tier1_l3", "tier1_offproto", "v2_feature_weights"]
SERVICE_KEYS = ["name", "target_ip", "port", "port_range", "proto", "profile", "detection_enabled", "added_at", "added_by", "notes"]
WEIGHTS = {
    "tier0.weights": ["pps", "bps", "fps", "burst_pps", "burst_bps", "burst_fps"],
    "tier1.fusion_weights": ["tcp", "udp", "icmp", "dist"],
    "tier1_l3.weights": ["ttl_stddev", "ip_frag_ratio", "other_proto_ratio", "src_port_top1_share", "src_24_top1_share", "src_24_entropy"],
    "v2_feature_weights": ["empty_ack_ratio", "zero_window_ratio", "small_window_ratio", "new_flow_ratio", "syn_fin_ratio", "syn_to_synack_ratio", "tcp_pkt_size_cov", "tcp_mean_pkt_size", "udp_pkt_size_cov", "udp_mean_pkt_size"],
}
PROBABILITIES = {"tier1": ["normal_threshold", "suspicious_threshold"], "tier1_offproto": ["suspicious_threshold", "attack_threshold"]}
DOCUMENT = (
    "version int, protected_ips array<string>, profiles map<string, map<string, string>>, catchall_assignments map<string, map<string, string>>, "
    "services array<struct<name string, target_ip string, port string, port_range string, proto string, profile string, detection_enabled string>>"
)


def document(spark: SparkSession, text: str) -> DataFrame:
    """The parsed document, one row, from its text."""
    return parsed(spark.range(1).select(F.lit(text).alias("text")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The parsed document at a path."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def parsed(texts: DataFrame) -> DataFrame:
    return texts.select("text", F.from_json("text", DOCUMENT).alias("d")).select("text", "d.*")


def protected_ips(doc: DataFrame) -> DataFrame:
    return doc.select(F.posexplode("protected_ips").alias("n", "text_ip")).select("n", "text_ip", ip_to_long(F.col("text_ip")).alias("ip"))


def _positive(value: Column, default: float) -> Column:
    x = F.expr("try_cast(v as double)") if value is None else value.try_cast("double")
    return F.when(x > 0, x).otherwise(F.lit(float(default)))


def profiles(doc: DataFrame) -> DataFrame:
    """The knobs that the detector honours, with their fallbacks."""
    p = doc.select(F.explode("profiles").alias("name", "p"))
    knob = {k: _positive(F.col("p")[k], v) for k, v in KNOBS.items()}
    whole = {k: x.cast("int") if k.endswith("windows") else x for k, x in knob.items()}
    return p.select(
        "name", whole["alpha"].alias("alpha"), whole["variance_ceiling_factor"].alias("variance_ceiling"), *(_positive(F.col("p")[t], 0.0).alias(t) for t in THRESHOLDS),
        *(whole[k].alias(k) for k in ("baseline_freeze_windows", "thaw_cooldown_windows", "warmup_windows")), *((F.coalesce(F.col("p")[f], F.lit("false")) == "true").alias(f) for f in FLAGS),
    )


def catchalls(doc: DataFrame) -> DataFrame:
    """(n, target_ip, family, profile) in the order in which slots are numbered: by address, then by family."""
    c = doc.select(F.posexplode(F.map_entries("catchall_assignments")).alias("a", "e")).select("a", F.col("e.key").alias("target_ip"), F.col("e.value").alias("m"))
    each = c.select("a", "target_ip", F.posexplode(F.array(*(F.lit(f) for f in FAMILIES))).alias("b", "family"), "m")
    return each.select((F.col("a") * 4 + F.col("b")).alias("n"), "target_ip", "family", F.col("m")[F.col("family")].alias("profile")).where("profile is not null")


def services(doc: DataFrame) -> DataFrame:
    """Services with their port or range parsed, ranges not yet expanded."""
    s = doc.select(F.posexplode("services").alias("n", "s")).select("n", "s.*")
    low, high = (F.regexp_extract(F.coalesce("port_range", F.lit("")), r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$", g).try_cast("int") for g in (1, 2))
    proto = F.coalesce(*(F.when(F.upper("proto") == k, v) for k, v in PROTOS.items()))
    return s.withColumns({"port_number": F.col("port").try_cast("int"), "low": low, "high": high, "proto_kind": proto, "detection_enabled": F.coalesce(F.col("detection_enabled"), F.lit("true")) == "true"})


def _ports(s: DataFrame) -> DataFrame:
    few = F.when(F.col("low").isNotNull() & (F.col("high") >= F.col("low")) & (F.col("high") <= 65535), F.sequence("low", F.least(F.col("high"), F.col("low") + MAX_SLOTS)))
    return s.withColumn("slot_port", F.explode(F.coalesce(few, F.array(F.coalesce("port_number", F.lit(0))))))


def slots(doc: DataFrame) -> DataFrame:
    """Slots in document order, catchalls first; a port range gives a slot for each port."""
    c = catchalls(doc).select(
        F.lit(0).alias("part"), "n", F.lit(0).alias("slot_port"), ip_to_long(F.col("target_ip")).alias("target_ip"),
        (F.array_position(F.array(*(F.lit(f) for f in FAMILIES)), F.col("family")) + 3).cast("int").alias("proto_kind"),
        F.lit(1).alias("is_catchall"), F.col("profile").alias("profile_name"), F.concat_ws("_", F.lit("catchall"), "target_ip", "family").alias("name"), F.lit(True).alias("detection_enabled"),
    )
    s = _ports(services(doc)).select(F.lit(1).alias("part"), "n", "slot_port", ip_to_long(F.col("target_ip")).alias("target_ip"), "proto_kind", F.lit(0).alias("is_catchall"), F.col("profile").alias("profile_name"), "name", "detection_enabled")
    both = c.unionByName(s)
    # a few hundred rows: numbered as one sorted array
    rows = both.agg(F.array_sort(F.collect_list(F.struct("part", "n", "slot_port", "target_ip", "proto_kind", "is_catchall", "profile_name", "name", "detection_enabled"))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("slot_id", "r")).select("slot_id", "r.target_ip", F.col("r.slot_port").alias("port"), "r.proto_kind", "r.is_catchall", "r.profile_name", "r.name", "r.detection_enabled")


def resolved(slot_rows: DataFrame, profile_rows: DataFrame, strict: bool = True) -> DataFrame:
    """Slots with their profile: only those that have one if strict, else with nulls to be defaulted."""
    p = F.broadcast(profile_rows.withColumnRenamed("name", "profile_name"))
    return slot_rows.join(p, "profile_name", "inner" if strict else "left")


def violations(doc: DataFrame, mode: str = "engine") -> DataFrame:
    """(rule, path, message) of all rules at once.

    Mode ``strict_v1`` also asks for all catchalls, for room for four catchalls of every
    address and for all weights and probabilities, and refuses unknown keys.
    """
    if mode not in ("engine", "strict_v1"):
        raise ValueError("mode must be engine or strict_v1")
    ips, cs, ss = protected_ips(doc), catchalls(doc), services(doc)
    prof = doc.select(F.explode("profiles").alias("profile", "p"))
    names = F.broadcast(prof.select("profile"))
    known = F.broadcast(ips.select(F.col("text_ip").alias("target_ip")).distinct())
    at = lambda what, n: F.concat(F.lit(f"{what}["), n.cast("string"), F.lit("]"))

    def bad(df: DataFrame, rule: str, path: Column, message: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), path.alias("path"), F.lit(message).alias("message"))

    slot_rows = slots(doc)
    parts = [
        bad(doc.where("version is null or version <> 1"), "L1", F.lit("version"), "version must be 1"),
        bad(ss.join(known, "target_ip", "left_anti"), "L2", at("services", F.col("n")), "target_ip is not protected"),
        bad(ss.join(names, "profile", "left_anti"), "L3", at("services", F.col("n")), "profile is not defined"),
        bad(cs.select("target_ip").distinct().join(known, "target_ip", "left_anti"), "L5", F.col("target_ip"), "catchalls of an address that is not protected"),
        bad(cs.join(names, "profile", "left_anti"), "L6", F.concat_ws(".", "target_ip", "family"), "profile is not defined"),
        bad(slot_rows.groupBy("target_ip", "port", "proto_kind").agg(F.count("*").alias("k"), F.max("name").alias("name")).where("k > 1"), "L7", F.coalesce("name", F.lit("")), "two slots share address, port and protocol"),
        bad(ss.where("proto_kind is null"), "L8", at("services", F.col("n")), "proto must be TCP, UDP or ICMP"),
        bad(ss.where((F.col("port").isNull() == F.col("port_range").isNull())), "L9", at("services", F.col("n")), "exactly one of port and port_range"),
        bad(ss.where("port is not null and (port_number is null or port_number < 0 or port_number > 65535)"), "L9", at("services", F.col("n")), "port out of bounds"),
        bad(ss.where("port_range is not null and (low is null or low < 1 or high > 65535 or low > high)"), "L9", at("services", F.col("n")), "port_range out of bounds"),
        bad(ss.where("proto_kind = 3 and coalesce(port_number, 0) <> 0"), "L9", at("services", F.col("n")), "an ICMP service has port 0"),
        bad(ss.where("proto_kind in (1, 2) and port_number = 0"), "L9", at("services", F.col("n")), "port 0 is for ICMP"),
        bad(slot_rows.agg(F.count("*").alias("k")).where(F.col("k") > MAX_SLOTS), "L10", F.lit("services"), f"more than {MAX_SLOTS} slots"),
        bad(ss.agg(F.count("*").alias("k")).where(F.col("k") > MAX_SERVICES), "L10", F.lit("services"), f"more than {MAX_SERVICES} services"),
        bad(prof.agg(F.count("*").alias("k")).where(F.col("k") > MAX_PROFILES), "L10", F.lit("profiles"), f"more than {MAX_PROFILES} profiles"),
        bad(ips.agg(F.count("*").alias("k")).where(F.col("k") > MAX_IPS), "L11", F.lit("protected_ips"), f"more than {MAX_IPS} addresses"),
        bad(ips.where("ip is null"), "L11", at("protected_ips", F.col("n")), "not a dotted quad"),
        bad(_weights(doc).where("x is null or x < 0"), "L12", F.col("path"), "weights are numbers of at least 0"),
        bad(_thresholds(doc).where("x is null or x < 0 or x > 1"), "L12", F.col("path"), "thresholds are numbers from 0 to 1"),
    ]
    if mode == "strict_v1":
        whole = ips.select(F.col("text_ip").alias("target_ip"), F.explode(F.array(*(F.lit(f) for f in FAMILIES))).alias("family"))
        parts.append(bad(whole.join(cs.select("target_ip", "family"), ["target_ip", "family"], "left_anti"), "L4", F.concat_ws(".", "target_ip", "family"), "catchall is missing"))
        among = lambda keys: F.array(*(F.lit(k) for k in keys))
        keys = doc.select(F.explode(F.array_except(F.json_object_keys("text"), among(TOP_KEYS))).alias("k"))
        parts.append(bad(keys, "L13", F.col("k"), "unknown key"))
        inner = prof.select("profile", F.explode(F.array_except(F.map_keys("p"), among(PROFILE_KEYS))).alias("k"))
        parts.append(bad(inner, "L13", F.concat_ws(".", "profile", "k"), "unknown key of a profile"))
        each = doc.select(F.posexplode(F.from_json(F.get_json_object("text", "$.services"), "array<string>")).alias("n", "s"))
        own = each.select("n", F.explode(F.array_except(F.json_object_keys("s"), among(SERVICE_KEYS))).alias("k"))
        parts.append(bad(own, "L13", F.concat(at("services", F.col("n")), F.lit("."), F.col("k")), "unknown key of a service"))
        room = _ports(ss).agg(F.count("*").alias("k")).crossJoin(ips.agg(F.count("*").alias("i")))  # one row each
        parts.append(bad(room.where(F.col("k") + 4 * F.col("i") > MAX_SLOTS), "L10", F.lit("services"), "no room for four catchalls of every address"))
        named = F.array(*(F.struct(F.lit(f"{section}.{k}").alias("path"), F.lit(most).alias("most")) for table, most in ((WEIGHTS, None), (PROBABILITIES, 1.0)) for section, ks in table.items() for k in ks))
        asked = prof.select("profile", "p", F.explode(named.cast("array<struct<path string, most double>>")).alias("w")).select("profile", "p", F.col("w.path").alias("w"), F.col("w.most").alias("most"))
        value = F.expr("try_cast(get_json_object(p[substring_index(w, '.', 1)], concat('$.', substring(w, instr(w, '.') + 1))) as double)")
        parts.append(bad(asked.where(value.isNull() | (value < 0) | (value > F.col("most"))), "L12", F.concat_ws(".", "profile", "w"), "weights are numbers of at least 0, probabilities of 0 to 1"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _entries(doc: DataFrame, section_like: str) -> DataFrame:
    sections = doc.select(F.explode("profiles").alias("profile", "p")).select("profile", F.explode("p").alias("section", "body")).where(F.col("section").rlike(section_like))
    return sections.select("profile", "section", F.explode(F.from_json("body", "map<string, string>")).alias("key", "value")).select(F.concat_ws(".", "profile", "section", "key").alias("path"), F.col("value").try_cast("double").alias("x"))


def _weights(doc: DataFrame) -> DataFrame:
    return _entries(doc, "weights$")


def _thresholds(doc: DataFrame) -> DataFrame:
    return _entries(doc, "^thresholds$")


def missing_sections(doc: DataFrame) -> DataFrame:
    """(profile, section) of the full loader's five sections that a profile lacks."""
    p = doc.select(F.explode("profiles").alias("profile", "p")).select("profile", F.explode(F.array_except(F.array(*(F.lit(s) for s in SECTIONS)), F.map_keys("p"))).alias("section"))
    return p


def from_c_source(source: DataFrame) -> DataFrame:
    """(target_ip, family, profile) from designated initialisers ``.ip = "...", .tcp = "name"`` in C text; a one-off migration."""
    entry = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"\{[^{}]*\.ip\s*=\s*\"[^\"]+\"[^{}]*\}"), F.lit(0))).alias("e")
    e = source.select(entry).select("e", F.regexp_extract("e", r"\.ip\s*=\s*\"([^\"]+)\"", 1).alias("target_ip"))
    each = F.array(*(F.struct(F.lit(f).alias("family"), F.regexp_extract("e", rf"\.{f}\s*=\s*&?\"?(\w+)", 1).alias("profile")) for f in FAMILIES))
    return e.select("target_ip", F.inline(each)).where("profile <> ''")
