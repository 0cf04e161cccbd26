"""Operator actions: what is asked of the engine between ticks, and reloads of its registry.

Commands on slots are rows of ``schemas.COMMANDS``; the detector takes those of a tick
before it scores the tick (``operators.detect``).  Here they are checked, and the rest
of the actions has its functions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import step
from tickloom.sources import registry

#: Actions on a slot's state; checkpoints are ``detect.states``.
ACTIONS = step.COMMANDS
# What a dashboard may ask for; reloads are not among it.
DASHBOARD_ACTIONS = ("ping", "engine_pid", "slot_info", "force_ewma_freeze", "force_attack_freeze", "release_freezes", "reset_transient", "set_learning_mode", "save_checkpoint", "load_checkpoint")


def permitted(action: str) -> str:
    """The action, if a dashboard may ask for it; others raise PermissionError."""
    if action not in DASHBOARD_ACTIONS:
        raise PermissionError(f"action not allowed: {action!r}")
    return action


def request(spark: SparkSession, tick: int, target_ip: int, port: int, proto_kind: int, action: str, args: dict | None = None) -> DataFrame:
    """One command as a row; unknown actions and bad arguments raise ValueError."""
    step.commanded(step.fresh(step.DEFAULT_PROFILE), action, args or {}, step.DEFAULT_PROFILE)
    return spark.createDataFrame([(tick, target_ip, port, proto_kind, action, json.dumps(args or {}))], schemas.COMMANDS)


def request_all(slots: DataFrame, tick: int, action: str, args: dict | None = None) -> DataFrame:
    """The same command for every slot, as learning mode is for a whole engine."""
    step.commanded(step.fresh(step.DEFAULT_PROFILE), action, args or {}, step.DEFAULT_PROFILE)
    values = {"tick": F.lit(tick), "action": F.lit(action), "args_json": F.lit(json.dumps(args or {}))}
    return slots.select(*((values[f.name] if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.COMMANDS.fields))


def primed(epochs: DataFrame, current: int | None) -> DataFrame:
    """(registry_epoch, reload): each epoch in which records came, and whether it asks for a reload: the first one seen never does."""
    seen = epochs.select("registry_epoch").distinct()  # as many rows as there were reloads
    first = seen.agg(F.min("registry_epoch").alias("first"))
    start = F.col("first") if current is None else F.lit(current)
    return seen.crossJoin(first).select("registry_epoch", (F.col("registry_epoch") != start).alias("reload"))


def confirmed(snapshots: DataFrame, epoch: int, asked_ns: int, within_s: float = 5.0) -> DataFrame:
    """One row: whether a record of an epoch came within the seconds after a reload was asked for, and when the first one did."""
    got = snapshots.where((F.col("registry_epoch") >= epoch) & F.col("produced_ts_ns").between(asked_ns, asked_ns + int(within_s * 1e9)))
    return got.agg((F.count("*") > 0).alias("confirmed"), F.min("produced_ts_ns").alias("at_ns"))


def slot_info(states: DataFrame) -> DataFrame:
    """What an operator sees of each slot's state."""
    names = {"phase": "int", "prev_phase": "int", "warmup_remaining": "int", "history": "int", "ewma_freeze": "int", "normal_run": "int", "attack_freeze": "boolean", "windows_seen": "long", "tier0_score": "double", "t1_final": "double"}
    return states.select("target_ip", "port", "proto_kind", *(F.get_json_object("state", f"$.{n}").cast(t).alias(n) for n, t in names.items()))


def reloaded(current: DataFrame | None, fresh: DataFrame, mode: str = "engine") -> tuple[DataFrame | None, list]:
    """The fresh registry document if it has no violations, else the current one; and the violations."""
    found = registry.violations(fresh, mode).orderBy("rule", "path").collect()  # a document has a few hundred entries
    return (current, found) if found else (fresh, [])


def reload_event(spark: SparkSession, doc: DataFrame, violations: list, path: str, at: str, count: int, failures: int) -> DataFrame:
    """A row for the reload audit table."""
    n = {"n_protected_ips": registry.protected_ips(doc), "n_profiles": registry.profiles(doc), "n_services": registry.services(doc), "n_catchalls": registry.catchalls(doc), "n_total_slots": registry.slots(doc)}
    text = doc.first()["text"]
    values = {
        "timestamp_dt": F.lit(at).cast("timestamp"), "event_type": F.lit("reload_failed" if violations else "reload"), "source_path": F.lit(path), **{k: F.lit(v.count()) for k, v in n.items()},
        "reload_count": F.lit(count), "reload_failures": F.lit(failures), "error_message": F.lit("; ".join(f"{v.rule} {v.path}: {v.message}" for v in violations)), "services_json_sha256": F.sha2(F.lit(text), 256),
    }
    return spark.range(1).select(*(values[f.name].cast(f.dataType).alias(f.name) for f in schemas.REGISTRY_EVENTS.fields))
