"""Connected components of an edge list, by alternating star contraction.

Each round links every node's larger neighbours to its smallest neighbour, then its
smaller neighbours and itself to the smallest.  Every step is one shuffle and an
aggregation with map-side combining; edges are written to the shared folder between
rounds, so lineage stays short.  A hub's neighbours are never collected: only
minima are aggregated, and edges are dealt out by a join whose large partitions Spark
splits, as neither side's exchange is shared with an aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v <= u")
    # written out, so that the join has an exchange of its own on either side and a hub's neighbours can be split
    least = written(near.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), f"{name}-least")
    moved = near.join(least, "u").where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node reachable.

    Nodes without an edge to another node are not returned.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = written(_star(_star(now, True, name), False, name), name)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
