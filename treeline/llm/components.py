"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import discard, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of each id in edges (u, v): component is the smallest id reachable.

    Each step takes the minimum of each node's neighbours, combined before the shuffle, and joins it back by the node;
    a hub's rows are split by the adaptive skew join. Ids are longs; self loops and repeated edges do no harm; null ends
    are ignored; no edges give no rows. Rounds grow with the logarithm of the graph; beyond max_rounds it raises.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges", small=True)
    before = _state(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        after = saved(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges", small=True)
        state = _state(after)
        discard(now)
        now = after
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components not found within {max_rounds} rounds")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
