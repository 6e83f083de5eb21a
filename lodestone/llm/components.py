"""Connected components by alternating stars, as joins and aggregates.

Each round points every node's larger neighbours, then its smaller ones, at the smallest node
around it. A hub with any number of neighbours is a min with a map-side combine and a join that
AQE can split. Rounds are written to the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) after a large or a small star, u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(low, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (u, v); component is the smallest node reachable.

    Null ends and loops link nothing. Without edges there are no rows.
    """
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        before, now = now, staged(_star(_star(now, True), False), "stars")
        discard(before)
        got = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == mark or not got[0]:
            break
        mark = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
