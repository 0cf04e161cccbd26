"""Window functions over a slot's ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.cluster import ship_package
from tickloom.operators.step import train

BURST_TICKS = 10
WINDOWS = (10, 60, 300)


def burst_z(df: DataFrame, keys: list[str], value: str, out: str = "burst_z", ticks: int = BURST_TICKS) -> DataFrame:
    """Deviation of a value from the last ten rows, itself among them; 0 where they do not vary."""
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(-(ticks - 1), 0)
    sd = F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))
    return df.withColumn(out, F.when(sd > 1e-9, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 1e-9, sd)).otherwise(0.0))


def temporal(df: DataFrame, keys: list[str], sizes: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Sums, peaks, means and phase counts of the last 10, 60 and 300 rows of each slot."""
    extra: dict[str, Column] = {}
    for n in sizes:
        w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(-(n - 1), 0)
        extra |= {
            f"win_{n}s_total_pkts": F.sum("inbound_pkts").over(w), f"win_{n}s_peak_pps": F.max("inbound_pkts").over(w), f"win_{n}s_mean_pps": F.avg("inbound_pkts").over(w),
            f"win_{n}s_attack_seconds": F.count_if(F.col("phase") == 3).over(w), f"win_{n}s_suspicious_seconds": F.count_if(F.col("phase") == 2).over(w),
        }
    return df.withColumns(extra)


def fire_history(df: DataFrame, keys: list[str], fired: str = "fired", ticks: int = 5) -> DataFrame:
    """How many of the last five rows fired."""
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(-(ticks - 1), 0)
    return df.withColumn("fires", F.sum(F.col(fired).cast("int")).over(w))


#: Ticks that are numbered in one task: a day of seconds.
STRETCH = 86_400


def numbered(df: DataFrame, ticks_per_slot: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """``sequence_num`` that rises with (tick, slot_id): dense, or tick * slots + slot without any pass.

    Ranks are counted within a tick, ticks are summed up within a stretch of them, and
    stretches among one another, so no task holds all ticks.
    """
    if ticks_per_slot:
        return df.withColumn("sequence_num", F.col("tick") * ticks_per_slot + F.col("slot_id"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = df.groupBy("tick").agg(F.count("*").alias("_n")).withColumn("_stretch", F.floor(F.col("tick") / stretch))
    inside = per.withColumn("_inside", before(Window.partitionBy("_stretch").orderBy("tick")))
    past = per.groupBy("_stretch").agg(F.sum("_n").alias("_n")).withColumn("_past", before(Window.orderBy("_stretch"))).select("_stretch", "_past")  # a row a day
    offset = inside.join(F.broadcast(past), "_stretch").select("tick", (F.col("_inside") + F.col("_past")).alias("_before"))
    here = df.withColumn("_r", F.row_number().over(Window.partitionBy("tick").orderBy("slot_id")))
    return here.join(offset, "tick").withColumn("sequence_num", F.col("_before") + F.col("_r")).drop("_before", "_r")


def cusum_fixed(df: DataFrame, keys: list[str], z: str, drift: float = 0.5) -> DataFrame:
    """The one-sided cumulative sum max(0, S + z - drift) on a fixed baseline, from running sums and their minimum."""
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    walk = df.withColumn("_walk", F.sum(F.col(z) - drift).over(w))
    return walk.withColumn("s_plus", F.col("_walk") - F.least(F.lit(0.0), F.min("_walk").over(w))).drop("_walk")


def ewma(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05, ceiling: float = 6.0) -> DataFrame:
    """Mean, variance and count of the winsorised exponential average of each key's values in tick order.

    The detector's own training step, folded over rows that are dealt by key and sorted by
    tick; a task holds one batch and one key's baseline, however long its series.
    """
    ship_package(df.sparkSession)
    rows = df.select(*keys, "tick", F.col(value).cast("double").alias("_x")).where("_x is not null")
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keys), T.StructField("mean", T.DoubleType()), T.StructField("variance", T.DoubleType()), T.StructField("n", T.LongType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, baseline, done = None, [0.0, 0.0, 0], []
        for b in batches:
            for *mine, _, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if mine != key:
                    if key is not None:
                        done.append((*key, *baseline))
                    key, baseline = mine, [0.0, 0.0, 0]
                train(baseline, x, alpha, ceiling)
        if key is not None:
            done.append((*key, *baseline))
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in done], schema=kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "tick").mapInArrow(run, schema)


def down_sampled(df: DataFrame, keys: list[str], order: str, points: int = 60, means: tuple[str, ...] = (), peaks: tuple[str, ...] = ()) -> DataFrame:
    """At most ``points`` rows for each key: means and peaks of equal stretches of its series."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(order)) - 1)
    size = F.ceil(F.col("_n") / points)
    r = r.withColumn("bucket", F.floor(F.col("_k") / size))
    return r.groupBy(*keys, "bucket").agg(F.min(order).alias(order), *(F.avg(c).alias(c) for c in means), *(F.max(c).alias(c) for c in peaks))
