"""The same operators over streams.

Windows are event-time seconds with a watermark.  The detector keeps each slot's state
in the state store and takes its ticks in order; facts go to their tables from one
micro-batch after the other, each written once for each batch id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.cluster import ship_package
from tickloom.operators import step
from tickloom.operators.detect import KEY, OUTPUT_FIELDS, PARAMS, prepared
from tickloom.operators.features import FEATURES
from tickloom.operators.ticks import counter_aggregates


def tick_counters(routed: DataFrame, time: str = "ts", late: str = "5 seconds", width: str = "1 second") -> DataFrame:
    """Counters of each slot and event-time window; ``routed`` is a stream with a timestamp column."""
    if routed.schema[time].dataType.typeName() == "timestamp_ntz":
        routed = routed.withColumn(time, F.col(time).cast("timestamp"))
    w = routed.where("slot_id is not null").withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "slot_id").agg(*counter_aggregates())
    return w.select(F.unix_seconds(F.col("w.start")).alias("tick"), *[c for c in w.columns if c != "w"])


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, learning: bool, keep: list[str]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("tick", kind="stable")
    held = json.loads(state.get[0]) if state.exists else None
    out = []
    for r in rows.to_dict("records"):
        params = {c: r[f"p_{c}"] for c in PARAMS}
        if held is None:
            held = {"params": params, "state": step.loaded(r["_state"]) if isinstance(r.get("_state"), str) else step.fresh(params), "tick": None}
        if held["tick"] is not None and r["tick"] <= held["tick"]:
            continue  # a window that was delivered again
        if held["params"] != params:
            held["state"], held["params"] = step.rebound(held["state"], held["params"], params), params
        if isinstance(r.get("_commands"), str):
            for c in json.loads(r["_commands"]):
                held["state"] = step.commanded(held["state"], c["action"], json.loads(c.get("args_json") or "{}"), params)
        s = step.advance(held["state"], {f: r[f] for f in FEATURES}, int(key[2]), params, learning)
        held["tick"] = int(r["tick"])
        out.append({c: r[c] for c in keep} | {o: s[o] for o in step.OUTPUTS})
    if held is not None:
        state.update((json.dumps(held),))
    yield pd.DataFrame(out, columns=[*keep, *step.OUTPUTS])


def detected(snapshots: DataFrame, profiles: DataFrame, state: DataFrame | None = None, learning: bool = False) -> DataFrame:
    """A stream of snapshot records with the detector's outputs; state lives as long as the query's checkpoint."""
    ship_package(snapshots.sparkSession)
    keep = snapshots.columns
    rows = prepared(snapshots, profiles, None, state)
    wanted = [*keep, *(c for c in [*FEATURES, *(f"p_{c}" for c in PARAMS), "_commands", "_state"] if c not in keep)]

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        yield from _advance(key, frames, group, learning, keep)

    schema = T.StructType([*snapshots.schema.fields, *OUTPUT_FIELDS])
    return rows.select(*wanted).groupBy(*KEY).applyInPandasWithState(run, schema, T.StructType([T.StructField("held", T.StringType())]), "append", GroupStateTimeout.NoTimeout)


def into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], trigger: str | None = None):
    """Start a query that hands each micro-batch to a writer; without a trigger it stops when what is there is done."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=trigger) if trigger else q.trigger(availableNow=True)).start()


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A writer whose batches replace themselves if they are repeated, so that every row lands exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def new_records(snapshots: DataFrame, late: str = "1 minute") -> DataFrame:
    """Snapshot records without those of a tick and slot that came before."""
    timed = snapshots.withColumn("_at", F.timestamp_seconds(F.col("produced_ts_ns") / 1_000_000_000))
    return timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["slot_id", "tick"]).drop("_at")


def shadowed(stream: DataFrame, checkpoint: str, ours: Callable[[DataFrame], DataFrame], theirs: Callable[[DataFrame], DataFrame], path: str, exact: list[str], close: list[str]):
    """Run two detectors on the same micro-batches and append where their results differ."""
    from tickloom.operators.facts import differences

    def write(batch: DataFrame, batch_id: int) -> None:
        differences(ours(batch), theirs(batch), exact, close).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return into(stream, checkpoint, write)


class Counters(StreamingQueryListener):
    """What a query has taken in and written, from its progress events; register it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.batches = self.rows_in = self.started = self.stopped = self.failed = self.write_errors = self.batches_dropped = 0
        self.observed: dict[str, dict] = {}

    def named(self) -> dict[str, int]:
        """The counters by the names under which a collector reports them.

        A source is read at its own pace and replayed after a failure, so no queue can
        overflow: its depth and drops are 0 by construction.
        """
        seen = lambda name, key: self.observed.get(name, {}).get(key, 0)
        return {
            "read": self.rows_in, "parsed": seen("wire", "parsed"), "inserted": seen("facts", "rows"), "transitions": seen("transitions", "rows"), "temporal_rows": seen("temporal", "rows"),
            "queue_depth": 0, "parse_errors": seen("wire", "errors"), "queue_drops": 0, "write_errors": self.write_errors, "batches_dropped": self.batches_dropped,
            "accepts": self.started, "reconnects": max(0, self.started - 1),
        }

    def line(self) -> str:
        return "[stats] " + " ".join(f"{k}={v}" for k, v in self.named().items())

    def guarded(self, write: Callable[[DataFrame, int], None], tries: int = 2, drop: bool = False) -> Callable[[DataFrame, int], None]:
        """A batch writer that tries again and counts what fails; at last it raises, so that the batch is replayed, or drops the batch."""

        def put(batch: DataFrame, batch_id: int) -> None:
            for left in reversed(range(tries)):
                try:
                    return write(batch, batch_id)
                except Exception:
                    self.write_errors += 1
                    if not left and not drop:
                        raise
            self.batches_dropped += 1

        return put

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows_in += event.progress.numInputRows
        for name, row in (event.progress.observedMetrics or {}).items():
            now = self.observed.setdefault(name, {})
            for k, v in row.asDict().items():
                now[k] = now.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.stopped += 1
        self.failed += event.exception is not None


def parsed_counted(messages: DataFrame) -> DataFrame:
    """Decoded messages that also count those parsed and those with an error."""
    return messages.observe("wire", F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def rows_counted(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table that also count themselves, under its name."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def counted(stats: DataFrame, name: str = "facts") -> DataFrame:
    """Statistics rows that also count rows, transitions candidates and floor breaches as metrics of each batch."""
    return stats.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("phase") == 3).alias("attack_rows"), F.sum(F.col("absolute_floor_fired").cast("long")).alias("floor_rows"))
