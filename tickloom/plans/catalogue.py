"""The named queries over the fact tables.

Every query takes the moment it looks back from; nothing reads the clock.  Filters on
time are also given as filters on the day, by which the tables are partitioned, so
that scans are pruned.  The latest row of a slot is one ``max_by`` over a unique
order, which combines on the map side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import format_age, format_peak, kind_name
from tickloom.operators.windows import down_sampled
from tickloom.schemas import PHASES

FRESH_S, RECENT_S, DEGRADED_S = 60, 60, 300
NEWEST = F.struct  # (timestamp_ns, sequence_num) orders a slot's rows without ties
# The columns of a slot's series, as its readers expect them.
SERIES = [
    "inbound_pkts", "inbound_bytes", "unique_flows", "out_pkts", "out_bytes", "ip_frag_pkts", "off_proto_pkts", "tcp_pkts", "tcp_bytes", "syn_pkts", "syn_ack_pkts", "fin_ack_pkts",
    "rst_pkts", "ack_data_pkts", "empty_ack_pkts", "zero_window_pkts", "udp_pkts", "udp_bytes", "icmp_pkts", "unique_src_ips", "src_24_top1_share", "src_24_entropy", "ttl_mean", "ttl_stddev",
    "bw_pps_z_last", "bw_bps_z_last", "tier0_score", "tier1_tcp_score", "tier1_udp_score", "tier1_icmp_score", "tier1_dist_score", "tier1_l3_score", "tier1_offproto_score", "tier1_final_score", "phase",
]


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def since(as_of: dt.datetime, seconds: float, column: str = "timestamp_dt", strict: bool = False, day: str | None = "event_date") -> Column:
    """Rows from ``seconds`` before a moment up to it; on the day too, where the table has it."""
    start = as_of - dt.timedelta(seconds=seconds)
    low, high = (F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") for x in (start, as_of))
    cond = (F.col(column) > low if strict else F.col(column) >= low) & (F.col(column) <= high)
    return cond & F.col(day).between(F.lit(start.date()), F.lit(as_of.date())) if day else cond


def newest_day(rows: DataFrame) -> DataFrame:
    """The rows of the newest day: the only folder that a search for the newest row has to open."""
    day = rows.agg(F.max("event_date").alias("d")).first()["d"]  # of a partitioned table, its folders' names
    return rows.where(F.col("event_date") == F.lit(day)) if day else rows


def latest(stats: DataFrame, columns: list[str], by: tuple[str, ...] = ("slot_id",)) -> DataFrame:
    """The newest row's columns for each slot."""
    row = F.max_by(F.struct(*columns), F.struct("timestamp_ns", "sequence_num"))
    return stats.groupBy(*by).agg(row.alias("r")).select(*by, "r.*")


def phase_counts(stats: DataFrame, as_of: dt.datetime, fresh_s: int = FRESH_S) -> DataFrame:
    """How many fresh slots are in each phase; phases without any count 0."""
    now = latest(stats.where(since(as_of, fresh_s)), ["phase_str"]).groupBy("phase_str").agg(F.count("*").alias("n"))
    every = stats.sparkSession.range(1).select(F.explode(F.array(*(F.lit(p) for p in PHASES))).alias("phase_str"))
    return every.join(F.broadcast(now), "phase_str", "left").select("phase_str", F.coalesce("n", F.lit(0).cast("long")).alias("n"))  # four rows


def top_slots(stats: DataFrame, as_of: dt.datetime, n: int = 5) -> DataFrame:
    """The fresh slots past warm-up with the highest scores."""
    columns = ["target_ip_str", "port", "proto_kind_str", "phase_str", "tier1_final_score", "tier0_score"]
    return latest(stats.where(since(as_of, FRESH_S)), columns).where("phase_str <> 'WARMUP'").orderBy(F.desc("tier1_final_score"), "slot_id").limit(n)


def overview(stats: DataFrame, transitions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row: the latest moment, phase counts, recent transitions and the top slots as JSON."""
    head = newest_day(stats.where((F.col("timestamp_dt") <= F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")) & (F.col("event_date") <= F.lit(as_of.date())))).agg(F.max("timestamp_dt").alias("latest_timestamp"))
    counts = phase_counts(stats, as_of).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase_str", "n")))).alias("phase_counts"))
    recent = transitions.where(since(as_of, RECENT_S)).agg(F.count("*").alias("transitions_recent"))
    top = top_slots(stats, as_of).agg(F.to_json(F.sort_array(F.collect_list(F.struct("tier1_final_score", "slot_id", "target_ip_str", "port", "proto_kind_str", "phase_str", "tier0_score")), asc=False)).alias("top_slots"))
    return head.crossJoin(counts).crossJoin(recent).crossJoin(top)  # one row each


def services(stats: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The latest row of each fresh slot, in order of address text, port and protocol."""
    columns = ["target_ip_str", "port", "proto_kind_str", "is_catchall", "profile_name", "phase_str", "warmup_remaining", "consecutive_attack_windows", "inbound_pkts", "inbound_bytes", "tier0_score", "tier1_final_score", "unique_src_ips", "win_10s_peak_pps", "timestamp_dt"]
    return latest(stats.where(since(as_of, FRESH_S)), columns).withColumn("peak_pps_10s", format_peak(F.col("win_10s_peak_pps"))).orderBy("target_ip_str", "port", "proto_kind_str")


def service_detail(stats: DataFrame, slot_id: int) -> DataFrame:
    """The newest row of a slot, all columns."""
    row = stats.where(F.col("slot_id") == slot_id).orderBy(F.desc("timestamp_ns"), F.desc("sequence_num")).limit(1)
    return row.withColumns({"peak_pps_display": format_peak(F.col("win_10s_peak_pps")), "absolute_floor_fired": (F.col("absolute_floor_fired") != 0).cast("int")})


def timeseries(stats: DataFrame, slot_id: int, as_of: dt.datetime, window: int = 300) -> DataFrame:
    """A slot's series over the last 10 to 86400 seconds, oldest first."""
    return stats.where(F.col("slot_id") == slot_id).where(since(as_of, clamped(window, 10, 86400))).select("timestamp_dt", *SERIES).orderBy("timestamp_ns")


def registry_audit(events: DataFrame, limit: int = 50) -> DataFrame:
    """Reloads, newest first; those of one second by all their columns."""
    rows = events.drop("services_json_sha256", "event_date")
    return rows.orderBy(F.desc("timestamp_dt"), *(c for c in rows.columns if c != "timestamp_dt")).limit(clamped(limit, 1, 500))


def registry_history(events: DataFrame, limit: int = 10) -> DataFrame:
    """When the registry changed last, and how many slots it defined."""
    rows = events.select("timestamp_dt", "n_total_slots", "event_type", "source_path")
    return rows.orderBy(F.desc("timestamp_dt"), "n_total_slots", "event_type", "source_path").limit(limit)


def registry_content(slot_rows: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Every slot of a registry document with the knobs of its profile, in the order of its slots."""
    p = profile_rows.withColumnRenamed("name", "profile_name")
    return slot_rows.join(F.broadcast(p), "profile_name", "left").select(*slot_rows.columns, *(c for c in p.columns if c != "profile_name")).orderBy("slot_id")  # a few hundred rows


def alerts(transitions: DataFrame, limit: int = 100) -> DataFrame:
    """Transitions, newest first."""
    return transitions.orderBy(F.desc("timestamp_ns"), "slot_id").limit(clamped(limit, 1, 1000)).withColumn("proto_kind_str", kind_name(F.col("proto_kind"), True))


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The last annotation of each transition."""
    return annotations.groupBy("transition_ts_ns", "slot_id").agg(F.max_by(F.struct("status", "note", "annotated_at_ns"), F.struct("annotated_at_ns", "status", "note")).alias("a")).select("transition_ts_ns", "slot_id", "a.*")


def audit(transitions: DataFrame, admin: DataFrame, registry: DataFrame, annotations: DataFrame, types: str = "transition,admin,registry", limit: int = 200) -> DataFrame:
    """(type, ts_ns, payload): the three streams as one, newest first; each is cut to the limit before the whole is."""
    limit = clamped(limit, 1, 1000)
    wanted = {t.strip() for t in types.split(",") if t.strip()}
    notes = latest_annotations(annotations).withColumnsRenamed({"slot_id": "_slot", "status": "a_status", "note": "a_note"})
    newest = transitions.orderBy(F.desc("timestamp_ns"), "slot_id").limit(limit)
    noted = newest.join(notes, (F.col("timestamp_ns") == F.col("transition_ts_ns")) & (F.col("slot_id") == F.col("_slot")), "left")
    annotation = F.when(F.coalesce("a_status", F.lit("")) != "", F.struct(F.col("a_status").alias("status"), F.coalesce("a_note", F.lit("")).alias("note"), F.col("annotated_at_ns").alias("annotated_at_ns")))
    fields = ["slot_id", "target_ip", "port", "profile_name", "from_phase_str", "to_phase_str", "tier0_score", "tier1_final_score", "attack_evidence", "consecutive_attack_windows", "absolute_floor_fired"]
    parts = {
        "transition": noted.select(F.lit("transition").alias("type"), F.col("timestamp_ns").alias("ts_ns"), F.to_json(F.struct(*fields, annotation.alias("annotation"))).alias("payload")),
        "admin": admin.orderBy(F.desc("ts_ns"), "action").limit(limit).select(F.lit("admin").alias("type"), "ts_ns", F.to_json(F.struct("action", "args_json", "status", "result_json", "duration_ms")).alias("payload")),
        "registry": registry.orderBy(F.desc("timestamp_dt"), "event_type").limit(limit).select(F.lit("registry").alias("type"), (F.unix_timestamp("timestamp_dt") * 1_000_000_000).alias("ts_ns"), F.to_json(F.struct("event_type", "source_path", "n_total_slots", "reload_count", "reload_failures", "error_message")).alias("payload")),
    }
    out = None
    for name, part in parts.items():
        if name in wanted:
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = parts["admin"].limit(0)
    return out.orderBy(F.desc("ts_ns"), "type", "payload").limit(limit)


def system_health(stats: DataFrame, registry: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row: age of the newest row, its display and the last reload."""
    age = newest_day(stats).agg((F.lit(int(as_of.timestamp())) - F.unix_timestamp(F.max("timestamp_dt"))).alias("age_seconds"))
    last = registry.agg(F.max_by(F.struct("event_type", "timestamp_dt"), F.struct("timestamp_dt", "event_type")).alias("r"))
    return age.withColumn("age", format_age(F.col("age_seconds"))).crossJoin(last).select("age_seconds", "age", F.col("r.event_type").alias("last_event"), F.col("r.timestamp_dt").alias("last_event_at"))


def system_slots(stats: DataFrame, as_of: dt.datetime) -> DataFrame:
    return latest(stats.where(since(as_of, FRESH_S)), ["target_ip_str", "port", "proto_kind_str", "profile_name", "phase_str"]).orderBy("target_ip_str", "port", "proto_kind_str")


def health(stats: DataFrame, as_of: dt.datetime, degraded_s: int = DEGRADED_S) -> DataFrame:
    """One row: ok, or degraded if the table is empty or its newest row too old."""
    newest = newest_day(stats).agg(F.max("timestamp_dt").alias("latest")).crossJoin(stats.agg(F.count("*").alias("rows")))  # one row each
    age = F.lit(int(as_of.timestamp())) - F.unix_timestamp("latest")
    return newest.select(F.when(F.col("latest").isNull() | (age > degraded_s), "degraded").otherwise("ok").alias("status"), age.alias("age_seconds"), "rows")


def in_attack(stats: DataFrame, as_of: dt.datetime, seconds: int = 30) -> DataFrame:
    """Rows in ATTACK of the last half minute, highest score first."""
    columns = ["target_ip_str", "port", "proto_kind_str", "profile_name", "tier0_score", "tier1_final_score", "consecutive_attack_windows", "baseline_freeze_remaining", "timestamp_dt"]
    return stats.where(since(as_of, seconds, strict=True)).where("phase = 3").select("slot_id", *columns).orderBy(F.desc("tier1_final_score"), "slot_id", "timestamp_dt")


def top_ips(stats: DataFrame, as_of: dt.datetime, seconds: int = 3600, n: int = 10) -> DataFrame:
    t = stats.where(since(as_of, seconds, strict=True)).groupBy("target_ip_str").agg(F.sum("inbound_pkts").alias("total_pkts"), F.sum("inbound_bytes").alias("total_bytes"))
    return t.orderBy(F.desc("total_pkts"), "target_ip_str").limit(n)


def transition_history(transitions: DataFrame, target_ip: int, as_of: dt.datetime, seconds: int = 86400) -> DataFrame:
    columns = ["timestamp_dt", "slot_id", "port", "proto_kind", "from_phase_str", "to_phase_str", "tier0_score", "tier1_final_score", "attack_evidence"]
    return transitions.where(F.col("target_ip") == target_ip).where(since(as_of, seconds, strict=True)).select(*columns).orderBy("timestamp_dt", "slot_id")


def score_buckets(stats: DataFrame, as_of: dt.datetime, seconds: int = 6 * 3600, width: str = "10 minutes") -> DataFrame:
    s = stats.where(since(as_of, seconds, strict=True)).groupBy("target_ip_str", "port", "proto_kind_str", F.window("timestamp_dt", width)["start"].alias("bucket"))
    return s.agg(F.avg("tier1_final_score").alias("avg_t1"), F.max("tier1_final_score").alias("max_t1")).orderBy("target_ip_str", "port", "proto_kind_str", "bucket")


def hour_peaks(temporal: DataFrame, as_of: dt.datetime, seconds: int = 3600, window_seconds: int = 60, n: int = 20) -> DataFrame:
    t = temporal.where(F.col("window_seconds") == window_seconds).where(since(as_of, seconds, strict=True))
    return t.groupBy("target_ip_str", "port").agg(F.max("peak_pps").alias("hour_peak_pps")).orderBy(F.desc("hour_peak_pps"), "target_ip_str", "port").limit(n)


def reload_audit(registry: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    r = registry.where(since(as_of, days * 86400, strict=True))
    return r.select("timestamp_dt", "event_type", "source_path", "n_total_slots", "reload_count", "reload_failures", "error_message").orderBy(F.desc("timestamp_dt"))


def legacy_extent(legacy: DataFrame) -> DataFrame:
    return legacy.agg(F.count("*").alias("rows"), F.min("timestamp_ms").alias("earliest_ms"), F.max("timestamp_ms").alias("latest_ms"))


def legacy_range(legacy: DataFrame, dst_ip: str, first_ms: int, last_ms: int) -> DataFrame:
    return legacy.where((F.col("dst_ip") == dst_ip) & F.col("timestamp_ms").between(first_ms, last_ms)).orderBy("timestamp_ms")


def top_scores(stats: DataFrame, as_of: dt.datetime, seconds: int = 300, n: int = 10) -> DataFrame:
    s = stats.where(since(as_of, seconds)).groupBy("target_ip_str", "port", "proto_kind_str").agg(F.avg("tier1_final_score").alias("avg_t1"), F.max("tier1_final_score").alias("peak_t1"))
    return s.orderBy(F.desc("peak_t1"), "target_ip_str", "port", "proto_kind_str").limit(n)


def recent_transitions(transitions: DataFrame, as_of: dt.datetime, seconds: int = 3600, limit: int = 50) -> DataFrame:
    return transitions.where(since(as_of, seconds)).orderBy(F.desc("timestamp_ns"), "slot_id").limit(limit)


def rows_per_minute(stats: DataFrame, as_of: dt.datetime, seconds: int = 3600) -> DataFrame:
    return stats.where(since(as_of, seconds)).groupBy(F.date_trunc("minute", "timestamp_dt").alias("minute")).agg(F.count("*").alias("n")).orderBy("minute")


def staleness(stats: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Seconds since the newest row, not below 0."""
    return newest_day(stats).agg(F.greatest(F.lit(0).cast("long"), F.lit(int(as_of.timestamp())) - F.unix_timestamp(F.max("timestamp_dt"))).alias("stale_seconds"))


def distinct_slots(stats: DataFrame, as_of: dt.datetime, seconds: int = 300) -> DataFrame:
    return stats.where(since(as_of, seconds)).agg(F.count_distinct("slot_id").alias("slots"))


def outage(stats: DataFrame, first: dt.datetime, last: dt.datetime) -> DataFrame:
    """Minutes without a row between two moments."""
    span = F.sequence(*(F.lit(x.strftime("%Y-%m-%d %H:%M:00")).cast("timestamp") for x in (first, last)), F.expr("interval 1 minute"))
    every = stats.sparkSession.range(1).select(F.explode(span).alias("minute"))
    seen = stats.where(since(last + dt.timedelta(minutes=1), (last - first).total_seconds() + 120))
    return every.join(seen.select(F.date_trunc("minute", "timestamp_dt").alias("minute")).distinct(), "minute", "left_anti").orderBy("minute")


def chart(stats: DataFrame, slot_id: int, as_of: dt.datetime, window: int = 300, points: int = 60) -> DataFrame:
    s = stats.where((F.col("slot_id") == slot_id) & since(as_of, clamped(window, 10, 86400)))
    return down_sampled(s, ["slot_id"], "timestamp_ns", points, ("inbound_pkts", "inbound_bytes", "tier1_final_score"), ("phase",)).orderBy("timestamp_ns")


def triage(temporal: DataFrame, transitions: DataFrame, flaps: int = 4) -> DataFrame:
    """Slots whose attack seconds show in the 10 s window only (noise), and slots that change phase often (flapping)."""
    t = temporal.groupBy("slot_id", "timestamp_ns").agg(*(F.max(F.when(F.col("window_seconds") == n, F.col("attack_seconds"))).alias(f"a{n}") for n in (10, 300)))
    noise = t.groupBy("slot_id").agg(F.count_if((F.col("a10") > 0) & (F.col("a300") <= F.col("a10"))).alias("spike_seconds"))
    n = transitions.groupBy("slot_id").agg(F.count("*").alias("changes"))
    return noise.join(n, "slot_id", "left").select("slot_id", "spike_seconds", F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), (F.coalesce("changes", F.lit(0)) >= flaps).alias("flapping"))


def searched(slots: DataFrame, text: str = "", phase: str = "", proto: str = "") -> DataFrame:
    """Slots by phase, protocol and a part of their address, port, id or profile."""
    out = slots.where(F.lower(F.concat_ws(" ", "target_ip_str", F.col("port").cast("string"), F.col("slot_id").cast("string"), "profile_name")).contains(text.lower().strip()))
    out = out.where(F.col("phase_str") == phase) if phase else out
    return out.where(F.col("proto_kind_str") == proto) if proto else out


def payloads(result: DataFrame) -> DataFrame:
    """Each row of a query's result as a JSON object, as a web server would send it."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("payload"))
