"""Fact tables at rest: creation, additive change, partitioned writes, retention, backups."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.operators.facts import DERIVED_COLUMNS, STATS_COLUMNS

#: Days that each table keeps.
RETENTION_DAYS = {"service_stats": 30, "service_phase_transitions": 90, "service_temporal_aggregates": 30, "service_registry_snapshots": 365, "service_admin_actions": 30}
ADDITIVE = [("service_phase_transitions", "absolute_floor_fired", "INT"), ("service_stats", "absolute_floor_fired", "INT"), *(("service_stats", f"tier0_risk_{c}", "DOUBLE") for c in ("pps", "bps", "fps", "burst_pps", "burst_bps", "burst_fps")), ("service_stats", "dominant_channel", "INT"), ("service_stats", "dominant_channel_str", "STRING")]
# The table of the schema before, and its name while this one is in use.
LEGACY, LEGACY_KEPT = "traffic_stats", "traffic_stats_legacy"
STATUSES = ("new", "acknowledged", "resolved", "false_positive")
BACKUPS = 20


def create(spark: SparkSession, database: str, dry_run: bool = False) -> list[str]:
    """Create the database and its tables where absent and add missing columns; returns what was (or would be) run."""
    stats = T.StructType([T.StructField(c, schemas.stats_type(c)) for c in STATS_COLUMNS] + [T.StructField(c, T.TimestampType() if c == "timestamp_dt" else T.StringType()) for c in DERIVED_COLUMNS if c != "event_date"])
    tables = {
        "service_stats": stats, "service_phase_transitions": schemas.TRANSITIONS, "service_temporal_aggregates": schemas.TEMPORAL, "service_registry_snapshots": schemas.REGISTRY_EVENTS,
        "service_admin_actions": schemas.ADMIN_ACTIONS, "service_alert_annotations": schemas.ANNOTATIONS,
    }
    todo = [f"CREATE DATABASE IF NOT EXISTS {database}", *_renamed(spark, database, LEGACY, LEGACY_KEPT)]
    for name, s in tables.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.fields)
        todo.append(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, event_date date) USING parquet PARTITIONED BY (event_date)")
    done = []
    for sql in todo:
        if not dry_run:
            spark.sql(sql)
        done.append(sql)
    for table, column, kind in ADDITIVE:
        if spark.catalog.tableExists(f"{database}.{table}") and column not in spark.table(f"{database}.{table}").columns:
            sql = f"ALTER TABLE {database}.{table} ADD COLUMNS ({column} {kind})"
            if not dry_run:
                spark.sql(sql)
            done.append(sql)
    return done


def _renamed(spark: SparkSession, database: str, old: str, new: str) -> list[str]:
    """The statement that renames a table, if there is one to rename and none in its place."""
    there = {t.name for t in spark.catalog.listTables(database)} if spark.catalog.databaseExists(database) else set()
    return [f"ALTER TABLE {database}.{old} RENAME TO {database}.{new}"] if old in there and new not in there else []


def verified(spark: SparkSession, database: str) -> dict[str, int]:
    """Rows of each fact table; raises if one is missing or can't be read."""
    return {name: spark.table(f"{database}.{name}").count() for name in RETENTION_DAYS}


def rollback(spark: SparkSession, database: str, confirm: bool = False) -> list[str]:
    """Drop the tables of :func:`create` and give the legacy table its name back; without ``confirm`` only says what would be run."""
    names = [t.name for t in spark.catalog.listTables(database)] if spark.catalog.databaseExists(database) else []
    todo = [f"DROP TABLE IF EXISTS {database}.{n}" for n in names if n in RETENTION_DAYS or n == "service_alert_annotations"]
    todo += _renamed(spark, database, LEGACY_KEPT, LEGACY)
    if confirm:
        for sql in todo:
            spark.sql(sql)
    return todo


def append(rows: DataFrame, path: str, time_ns: str = "timestamp_ns", order: tuple[str, ...] = ("target_ip", "port", "proto_kind", "timestamp_ns")) -> None:
    """Append rows to a table's folder, one folder a day, sorted so that scans can skip row groups."""
    day = F.to_date(F.timestamp_seconds((F.col(time_ns) / 1_000_000_000).cast("long")))
    dated = rows if "event_date" in rows.columns else rows.withColumn("event_date", day)
    dated.repartition("event_date", *[c for c in order[:1] if c in rows.columns]).sortWithinPartitions("event_date", *order).write.mode("append").partitionBy("event_date").parquet(path)


def kept(rows: DataFrame, table: str, today: dt.date) -> DataFrame:
    """Rows within the table's retention; on a partitioned table this is a choice of folders."""
    return rows.where(F.col("event_date") >= F.lit(today - dt.timedelta(days=RETENTION_DAYS[table])))


def expired_days(spark: SparkSession, path: str, table: str, today: dt.date) -> list[dt.date]:
    """Days of a table's folder that its retention has passed."""
    days = spark.read.parquet(path).select("event_date").distinct().where(F.col("event_date") < F.lit(today - dt.timedelta(days=RETENTION_DAYS[table])))
    return sorted(r[0] for r in days.collect())


def drop_expired(spark: SparkSession, path: str, table: str, today: dt.date) -> list[dt.date]:
    """Delete those days' folders."""
    days = expired_days(spark, path, table, today)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for d in days:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={d.isoformat()}")
        p.getFileSystem(conf).delete(p, True)
    return days


def annotate(spark: SparkSession, path: str, transition_ts_ns: int, slot_id: int, status: str, note: str, now_ns: int) -> None:
    """Append an annotation; the last one of a transition counts."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    spark.createDataFrame([(transition_ts_ns, slot_id, now_ns, status, note)], schemas.ANNOTATIONS).write.mode("append").parquet(path)


def save_config(path: str, text: str, now: dt.datetime) -> str:
    """Replace a registry document atomically after keeping a dated backup; the newest 20 backups stay."""
    doc = json.loads(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("protected_ips"), list) or not isinstance(doc.get("profiles"), dict) or not isinstance(doc.get("services"), list):
        raise ValueError("not a registry document")
    p = Path(path)
    backup = p.with_name(f"{p.name}.bak.{now:%Y%m%d%H%M%S%f}")
    if p.exists():
        backup.write_text(p.read_text())
    fresh = p.with_name(f".{p.name}.new")
    fresh.write_text(text)
    fresh.replace(p)
    for old in backups(path)[BACKUPS:]:
        Path(old).unlink()
    return str(backup)


def backups(path: str) -> list[str]:
    """Backups of a document, newest first."""
    p = Path(path)
    return sorted((str(x) for x in p.parent.glob(f"{p.name}.bak.*")), reverse=True)


def restore_config(path: str, backup: str, now: dt.datetime) -> str:
    if backup not in backups(path):
        raise ValueError("no such backup")
    return save_config(path, Path(backup).read_text(), now)


def disk_use(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, bytes_on_disk, files) of tables' folders."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        one = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_on_disk"), F.count("*").alias("files")).select(F.lit(name).alias("table"), "bytes_on_disk", "files")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("bytes_on_disk"))
