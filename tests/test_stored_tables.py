"""Catalogue queries on tables at rest: the same rows, and only the folders of the days asked for."""

import datetime as dt

import pytest

from tests.conftest import SF_SMALL, plain
from tickloom import queries
from tickloom.operators import facts
from tickloom.plans import catalogue
from tickloom.sources import tables

AS_OF = queries.AS_OF


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    stats = queries._stats(spark, SF_SMALL)
    parts = {"stats": stats, "transitions": facts.dated(facts.transitions(stats)), "temporal": facts.dated(facts.temporal_rows(stats))}
    for name, rows in parts.items():
        tables.append(rows, str(folder / name))
    return {name: (spark.read.parquet(str(folder / name)), rows) for name, rows in parts.items()}


ASKED = {
    "services": ("stats", lambda t: catalogue.services(t, AS_OF)),
    "in_attack": ("stats", lambda t: catalogue.in_attack(t, AS_OF)),
    "top_ips": ("stats", lambda t: catalogue.top_ips(t, AS_OF)),
    "score_buckets": ("stats", lambda t: catalogue.score_buckets(t, AS_OF)),
    "health": ("stats", lambda t: catalogue.health(t, AS_OF).select("status", "age_seconds")),
    "outage": ("stats", lambda t: catalogue.outage(t, AS_OF - dt.timedelta(seconds=600), AS_OF)),
    "transition_history": ("transitions", lambda t: catalogue.transition_history(t, queries.SERVICE_IP, AS_OF)),
    "recent_transitions": ("transitions", lambda t: catalogue.recent_transitions(t, AS_OF)),
}


@pytest.mark.parametrize("name", sorted(ASKED))
def test_pruned_by_day(stored, name):
    table, ask = ASKED[name]
    at_rest, computed = stored[table]
    got = ask(at_rest)
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("PartitionFilters: [")[1:] if x.split("]")[0]]
    assert filters and all("event_date" in x.split("]")[0] for x in filters), plan
    assert plain(got.toPandas()) == plain(ask(computed).select(*got.columns).toPandas())


def test_peaks_of_the_hour(stored):
    at_rest, _ = stored["temporal"]
    got = catalogue.hour_peaks(at_rest.withColumn("target_ip_str", at_rest.target_ip.cast("string")), AS_OF)
    assert "event_date" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
