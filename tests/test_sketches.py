"""The one-pass sketch columns against the sketches one by one."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tickloom import queries
from tickloom.operators import sketches


@pytest.mark.parametrize("scope", sketches.SCOPES)
def test_measured(spark, scope):
    routed = queries._routed(spark, SF_SMALL).where("inbound").cache()
    got = {(r.tick, r.slot_id): r for r in sketches.measured(routed, scope).collect()}
    assert got
    est = {(r.tick, r.slot_id, r.sketch): r.estimate for r in sketches.estimates(sketches.observations(routed), scope).collect()}
    for (tick, slot, sketch), x in est.items():
        assert got[tick, slot][sketch] == pytest.approx(x)
    if scope == "window":
        assert sum(r[c] > 0 for r in got.values() for c in sketches.ESTIMATES) == len(est)
    for r in sketches.subnet_shape(routed, scope).collect():
        assert got[r.tick, r.slot_id].src_24_top1_share == pytest.approx(r.src_24_top1_share)
        assert got[r.tick, r.slot_id].src_24_entropy == pytest.approx(r.src_24_entropy, abs=1e-9)
    for r in sketches.port_tops(routed, scope).collect():
        mine = got[r.tick, r.slot_id]
        assert (mine[f"{r.arm}_cm_src_port_top_count"], mine[f"{r.arm}_cm_src_port_total"]) == (r.top_count, r.total)


def test_bucket_counts_so_far_against_plain_sums(spark):
    routed = queries._routed(spark, SF_SMALL)
    n = [tuple(r) for r in sketches.subnet_counts(routed).select("tick", "slot_id", "bucket", "n").collect()]
    for r in sketches.subnet_shape(routed, "bank").where(F.col("tick") % 7 == 0).collect():
        have = {}
        for tick, slot, bucket, k in n:
            if slot == r.slot_id and tick <= r.tick and (tick - r.tick) % 2 == 0:
                have[bucket] = have.get(bucket, 0) + k
        assert r.src_24_top1_share == pytest.approx(max(have.values()) / sum(have.values()))
