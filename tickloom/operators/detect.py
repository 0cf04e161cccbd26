"""The detector over a table of snapshot records: a fold of each slot's ticks in order.

Features are native columns.  Records are dealt by slot, sorted by slot and tick inside
each partition and streamed through the fold batch by batch, so a task holds the state
of one slot and one batch, however long a slot's history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.cluster import ship_package
from tickloom.operators import step
from tickloom.operators.features import FEATURES, derived
from tickloom.schemas import BROADCAST_ROWS

KEY = ["target_ip", "port", "proto_kind"]
PARAMS = list(step.DEFAULT_PROFILE)
INTEGERS = {"phase", "prev_phase", "warmup_remaining", "consecutive_attack_windows", "baseline_freeze_remaining", "thaw_cooldown_remaining", "windows_seen", "floor_fired_now", "dominant_channel"}
OUTPUT_FIELDS = [T.StructField(n, T.IntegerType() if n in INTEGERS else T.DoubleType()) for n in step.OUTPUTS]
STATES = T.StructType([*(T.StructField(k, T.LongType() if k == "target_ip" else T.IntegerType()) for k in KEY), T.StructField("state", T.StringType())])


def with_params(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows with the parameters of their profile, the defaults where it is unknown or silent.

    Profiles with a ``registry_epoch`` hold for records of that epoch: a slot goes on with
    the state that it has, under the parameters that its records' epoch brings.
    """
    on = ["profile_name", *(["registry_epoch"] if "registry_epoch" in profiles.columns else [])]
    p = profiles.select(F.substring("name", 1, 8).alias("profile_name"), *on[1:], *(F.col(c).alias(f"p_{c}") for c in PARAMS)).dropDuplicates(on)
    joined = rows.join(F.broadcast(p), on, "left")
    return joined.withColumns({f"p_{c}": F.coalesce(f"p_{c}", F.lit(v)) for c, v in step.DEFAULT_PROFILE.items()})


def prepared(snapshots: DataFrame, profiles: DataFrame, commands: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """Records with features, parameters, the commands of their tick and the state to start from."""
    rows = with_params(derived(snapshots.where("proto_kind <> 0"), profiles), profiles)
    if commands is None:
        rows = rows.withColumn("_commands", F.lit(None).cast("string"))
    else:
        c = commands.groupBy("tick", *KEY).agg(F.to_json(F.collect_list(F.struct("action", "args_json"))).alias("_commands"))
        rows = rows.join(c, ["tick", *KEY], "left")
    if state is None:
        return rows.withColumn("_state", F.lit(None).cast("string"))
    return rows.join(state.select(*KEY, F.col("state").alias("_state")), KEY, "left")


def fold_rows(rows: Iterator[dict], learning: bool, held: dict) -> Iterator[dict]:
    """The outputs after each row; rows come sorted by slot and tick, ``held`` keeps key and state between calls."""
    for r in rows:
        key = tuple(int(r[k]) for k in KEY)
        params = {c: r[f"p_{c}"] for c in PARAMS}
        if held.get("key") != key:
            start = r.get("_state")
            held.update(key=key, params=params, state=step.loaded(start) if isinstance(start, str) else step.fresh(params))
        if held["params"] != params:
            held.update(state=step.rebound(held["state"], held["params"], params), params=params)
        if isinstance(r.get("_commands"), str):
            for c in json.loads(r["_commands"]):
                held["state"] = step.commanded(held["state"], c["action"], json.loads(c.get("args_json") or "{}"), params)
        s = step.advance(held["state"], {f: r[f] for f in FEATURES}, key[2], params, learning)
        yield {o: s[o] for o in step.OUTPUTS}


def detected(snapshots: DataFrame, profiles: DataFrame, commands: DataFrame | None = None, state: DataFrame | None = None, learning: bool = False) -> DataFrame:
    """Snapshot records with the detector's outputs."""
    if profiles.count() > BROADCAST_ROWS:
        raise ValueError("a registry has at most a few dozen profiles")
    ship_package(snapshots.sparkSession)
    rows = prepared(snapshots, profiles, commands, state)
    wanted = [*KEY, "tick", *FEATURES, *(f"p_{c}" for c in PARAMS), "_commands", "_state"]
    keep = snapshots.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            read = [b.column(c).to_pylist() for c in wanted]
            out = list(fold_rows((dict(zip(wanted, r, strict=True)) for r in zip(*read, strict=True)), learning, held))
            made = [pa.array([int(o[f.name]) if f.name in INTEGERS else float(o[f.name]) for o in out], pa.int32() if f.name in INTEGERS else pa.float64()) for f in OUTPUT_FIELDS]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, *step.OUTPUTS])

    schema = T.StructType([*snapshots.schema.fields, *OUTPUT_FIELDS])
    dealt = rows.select(*keep, *(c for c in wanted if c not in keep)).repartition(*KEY).sortWithinPartitions(*KEY, "tick")
    return dealt.mapInArrow(run, schema)


def states(snapshots: DataFrame, profiles: DataFrame, commands: DataFrame | None = None, state: DataFrame | None = None, learning: bool = False) -> DataFrame:
    """The state of every slot after its last record, to start from later."""
    ship_package(snapshots.sparkSession)
    rows = prepared(snapshots, profiles, commands, state)
    wanted = [*KEY, "tick", *FEATURES, *(f"p_{c}" for c in PARAMS), "_commands", "_state"]

    def kept(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip([*KEY, "state"], d, strict=True)) for d in done], schema=to_arrow_schema(STATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            done: list[tuple] = []
            for r in zip(*(b.column(c).to_pylist() for c in wanted), strict=True):
                before = (held.get("key"), held.get("state"))
                for _ in fold_rows(iter([dict(zip(wanted, r, strict=True))]), learning, held):
                    pass
                if before[0] is not None and before[0] != held["key"]:
                    done.append((*before[0], step.dumped(before[1])))
            if done:
                yield kept(done)
        if held:
            yield kept([(*held["key"], step.dumped(held["state"]))])

    return rows.select(*wanted).repartition(*KEY).sortWithinPartitions(*KEY, "tick").mapInArrow(run, STATES)


def drained_states(state: DataFrame) -> DataFrame:
    """States for a restart: history and sums emptied, without Python."""
    zero = F.lit('{"pps": 0.0, "bps": 0.0, "fps": 0.0}')
    s = F.regexp_replace("state", r'"history": [0-9]+', '"history": 0')
    s = F.regexp_replace(s, r'"consecutive_attack_windows": [0-9]+', '"consecutive_attack_windows": 0')
    return state.withColumn("state", F.regexp_replace(s, F.lit(r'"cusum": \{[^}]*\}'), F.concat(F.lit('"cusum": '), zero)))
