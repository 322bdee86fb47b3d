"""Repair of entries whose size or name stands in an extension record; namespace ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.forest import DIRECTORY, has


def namespace_rank(namespace: Column) -> Column:
    """How good a name is: Win32 and DOS in one, Win32, POSIX, DOS alone."""
    return F.when(namespace == 3, 4).when(namespace == 1, 3).when(namespace == 0, 2).when(namespace == 2, 1).otherwise(0)


def repair(entries: DataFrame, sizes: DataFrame, names: DataFrame) -> DataFrame:
    """entries (with name_rank) with the first spilled size (vol_ord, base, arrival, size, alloc) of files, and the best spilled name (vol_ord, base, arrival, rank, parent, name) if it outranks the own one."""
    key = [F.col("vol_ord"), F.col("base").alias("record_no")]
    s = sizes.groupBy(*key).agg(F.min_by(F.struct("size", "alloc"), "arrival").alias("s"))
    n = names.filter("name <> ''").groupBy(*key).agg(F.max_by(F.struct("rank", "parent", "name"), F.struct("rank", -F.col("arrival"))).alias("n"))
    d = entries.join(s, ["vol_ord", "record_no"], "left").join(n, ["vol_ord", "record_no"], "left")
    file = ~has(F.col("flags"), DIRECTORY) & F.col("s").isNotNull()
    better = F.coalesce(F.col("n.rank") > F.col("name_rank"), F.lit(False))
    new = {"own_size": (file, "s.size"), "own_alloc": (file, "s.alloc"), "name": (better, "n.name"), "parent_record": (better, "n.parent")}
    return d.withColumns({c: F.when(cond, F.col(x)).otherwise(F.col(c)) for c, (cond, x) in new.items()}).drop("s", "n")
