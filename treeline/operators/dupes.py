"""Groups of byte-identical files in tiers: equal size, equal sample of head and tail, equal hash of the whole.

Scale: sizes that occur once are dropped before any content is read, contents are joined for what is left and reduced to
samples in the same stage, and whole contents are hashed only where a sample is repeated. Groups are aggregated, and their
copies stay rows of their own, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.storage import saved
from treeline.operators.search import scope

BLOCK = 4096
SAMPLED = 2 * BLOCK


def candidates(nodes: DataFrame, min_size: int = 1, under: str | None = None, include_excluded: bool = False) -> DataFrame:
    keep = ~F.col("is_dir") & ~F.col("is_hard_link") & ~F.col("is_deleted") & (F.col("size") > 0) & (F.col("size") >= min_size)
    if not include_excluded:
        keep &= ~F.col("is_excluded") & ~F.col("is_metadata")
    if under:
        keep &= F.array_contains("ancestors", F.lit(scope(nodes, under)).cast("long"))
    return nodes.filter(keep).select("node_id", "path", "size")


def _tiers(found: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates of repeated sizes with `sample` and, only where that is repeated too, `whole` (null: not read or unreadable), as a written table."""
    sizes = found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    c = F.col("content")
    sample = F.when(c.isNull(), None).when(F.col("size") >= SAMPLED, F.xxhash64(F.concat(F.substring(c, 1, BLOCK), F.substring(c, -BLOCK, BLOCK)))).otherwise(F.lit(0))
    sampled = saved(found.join(sizes, "size").join(contents, "node_id", "left").select("node_id", "path", "size", sample.alias("sample"), c.isNotNull().alias("read")), "samples")
    again = sampled.filter("read").groupBy("size", "sample").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size", "sample")
    wanted = sampled.filter("read").join(again, ["size", "sample"], "left_semi").select("node_id")
    hashed = wanted.join(contents, "node_id").select("node_id", F.sha2(c, 256).alias("whole"))
    return saved(sampled.join(hashed, "node_id", "left"), "hashes")


def _groups(tiers: DataFrame) -> DataFrame:
    g = tiers.filter("whole is not null").groupBy("size", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min("node_id").alias("first_node")).filter("copies > 1")
    return g.withColumn("wasted", F.col("size") * (F.col("copies") - 1))


def _copies(ranked: DataFrame, tiers: DataFrame) -> DataFrame:
    """A row for each copy of the groups: never a row that holds them all."""
    return tiers.join(ranked, ["size", "whole"]).select("size", "copies", "wasted", "first_node", "node_id", "path")


def groups(nodes: DataFrame, contents: DataFrame, limit: int = 0, **filters) -> DataFrame:
    """size, copies, wasted and first node of each group with node and path of each of its copies; the `limit` most wasteful groups, 0: all."""
    t = _tiers(candidates(nodes, **filters), contents)
    g = _groups(t)
    return _copies(g.orderBy(F.desc("wasted"), "first_node").limit(limit) if limit else g, t)


def whole_groups(nodes: DataFrame, contents: DataFrame, limit: int = 0, most: int = 10_000, **filters) -> DataFrame:
    """The copies of the most wasteful groups (at most `limit`) up to the first group that would take their number beyond `most`."""
    t = _tiers(candidates(nodes, **filters), contents)
    # a group has two copies at least, so no more groups than these can be shown
    few = min(limit, most // 2 + 1) if limit else most // 2 + 1
    ranked = _groups(t).orderBy(F.desc("wasted"), "first_node").limit(few)
    shown = F.sum("copies").over(Window.orderBy(F.desc("wasted"), "first_node"))
    return _copies(ranked.withColumn("shown", shown).filter(F.col("shown") <= most).drop("shown"), t)


def stats(nodes: DataFrame, contents: DataFrame, limit: int = 0, **filters) -> DataFrame:
    """One row: how much each tier considered and read, groups (after limit) and wasted bytes (before)."""
    found = candidates(nodes, **filters)
    t = _tiers(found, contents)
    g = _groups(t).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted_bytes"))
    sampled = F.col("read") & (F.col("size") >= SAMPLED)
    counted = t.agg(
        F.count(F.lit(1)).alias("size_candidates"), F.count_if(sampled).alias("sampled"), F.count_if(F.col("whole").isNotNull()).alias("fully_hashed"),
        F.coalesce(F.sum(F.when(sampled, SAMPLED)), F.lit(0)).cast("long").alias("bytes_sampled"), F.coalesce(F.sum(F.when(F.col("whole").isNotNull(), F.col("size"))), F.lit(0)).alias("bytes_hashed"),
    )
    g = g.withColumn("groups", F.least("groups", F.lit(limit)) if limit else F.col("groups"))
    return found.agg(F.count(F.lit(1)).alias("considered")).join(counted).join(g)


def flattened(copies: DataFrame) -> DataFrame:
    """A header row for each group and a row for each copy under it."""
    lines = copies.select("first_node", "wasted", "copies", F.lit(1).alias("place"), "node_id", "path")
    heads = copies.filter("node_id = first_node").select("first_node", "wasted", "copies", F.lit(0).alias("place"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("string").alias("path"))
    return heads.unionByName(lines).orderBy(F.desc("wasted"), "first_node", "place", "node_id")
