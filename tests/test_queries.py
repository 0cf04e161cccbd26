"""Every query with SQL against DuckDB, and what has none for its shape."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL, plain
from tickloom import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF_SMALL).toPandas()) == plain(duck.sql(queries.SQL[name]).df())


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_overview(spark):
    row = queries.QUERIES["k01_overview"](spark, SF_SMALL).first()
    assert row.n_warmup + row.n_normal + row.n_suspicious + row.n_attack > 0 and row.latest_timestamp == queries.AS_OF_S
    assert 0 < len(row.top_slots.split(",")) <= 5


def test_detector_rows_and_wire(spark):
    d = queries.QUERIES["detector"](spark, SF_SMALL).toPandas()
    w = queries.QUERIES["wire_round_trip"](spark, SF_SMALL).toPandas()
    assert len(d) == len(w) > 0 and w["error"].isna().all()
    key = ["timestamp_ns", "slot_id"]
    both = d.merge(w, on=key, suffixes=("", "_w"))
    assert len(both) == len(d)
    for c in ("tier0_score", "tier1_final_score", "inbound_pkts", "src_24_entropy", "win_60s_peak_pps", "phase", "target_ip"):
        assert (both[c] - both[c + "_w"]).abs().max() < 1e-6
    assert set(w["profile_name"]) == {"default", "strict_w"}
    assert (d.groupby("slot_id")["phase"].first() == 0).all() and d["phase"].max() >= 1


def test_plans_push_down_and_broadcast(spark, capsys):
    queries.QUERIES["k14_top_ips"](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "ReadSchema" in plan and "l_tax" not in plan and "Python" not in plan
