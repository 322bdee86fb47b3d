"""From parent pointers to the node table: parents, closure, paths, depths, subtree totals, exclusions.

Input entries: vol_ord, drive, record_no, sequence, parent_record, name, flags, own_size, own_alloc, mtime_unix.

Scale: the closure is found by pointer jumping over directories alone (few next to files); each round makes every chain
three times as long and is cut by a written table; files get theirs by one join with their directory. Totals are summed
by directory before they are spread over ancestors, so the rows that every root gathers are one for each directory and
are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.storage import saved
from treeline.functions.text import fold

# Flag bits.
DIRECTORY, REPARSE, COMPRESSED, SPARSE, HIDDEN, SYSTEM, READONLY, HARD_LINK = 1, 2, 4, 8, 16, 32, 64, 128
HAS_ADS, ENCRYPTED, METADATA, EXCLUDED, ORPHAN, DELETED, NAME_OVERRIDDEN = 256, 512, 1024, 2048, 4096, 8192, 16384
ROOT_RECORD = 5


def has(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def node_id(vol_ord: Column, record_no: Column) -> Column:
    return vol_ord.cast("long") * (1 << 48) + record_no


def with_parents(entries: DataFrame) -> DataFrame:
    """Node ids, and each entry's parent: the root for one whose parent is missing or no directory's record (ORPHAN)."""
    e = entries.withColumns({"node_id": node_id(F.col("vol_ord"), F.col("record_no")), "is_dir": has(F.col("flags"), DIRECTORY)})
    dirs = e.filter(F.col("is_dir") & ~has(F.col("flags"), DELETED)).select(F.col("node_id").alias("found"))
    wanted = node_id(F.col("vol_ord"), F.col("parent_record"))
    e = e.join(dirs, wanted == F.col("found"), "left")
    root = node_id(F.col("vol_ord"), F.lit(ROOT_RECORD))
    is_root = F.col("record_no") == ROOT_RECORD
    orphan = F.col("found").isNull() & ~is_root & ~has(F.col("flags"), DELETED)
    e = e.withColumn("parent_id", F.when(is_root, root).otherwise(F.coalesce("found", root)))
    return e.withColumn("flags", F.when(orphan, F.col("flags").bitwiseOR(F.lit(ORPHAN))).otherwise(F.col("flags"))).drop("found", "parent_record")


def closure(dirs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, ancestors (self first, root last) and their names of directories (node_id, parent_id, name); the smallest id of each cycle, or None).

    Each round appends the chain above twice; rounds go on until every chain has reached its root or met itself, however deep the forest is.
    """
    next_ = F.when(F.col("parent_id") != F.col("node_id"), F.col("parent_id"))
    now = dirs.select(F.col("node_id").alias("id"), F.array("node_id").alias("ancestors"), F.array("name").alias("names"), next_.alias("next"))
    more = lambda x, y, kind: F.concat(x, F.coalesce(y, F.array().cast(kind)))
    open_ = F.col("next").isNotNull() & ~F.array_contains("ancestors", F.col("next"))
    while True:
        above = now.select(F.col("id").alias("up"), F.col("ancestors").alias("a2"), F.col("names").alias("n2"), F.col("next").alias("next2"))
        for _ in range(2):
            joined = now.join(above, (F.col("next") == F.col("up")) & ~F.array_contains("ancestors", F.col("next")), "left")
            on = F.when(F.col("up").isNotNull(), F.col("next2")).otherwise(F.col("next"))
            now = joined.select("id", more("ancestors", F.col("a2"), "array<bigint>").alias("ancestors"), more("names", F.col("n2"), "array<string>").alias("names"), on.alias("next"))
        now = saved(now, "closure")
        if now.filter(open_).isEmpty():
            break
    round_ = now.filter("next is not null")
    cycles = None
    if not round_.isEmpty():
        cycles = saved(round_.select(F.array_min(F.slice("ancestors", F.array_position("ancestors", F.col("next")).cast("int"), F.size("ancestors"))).alias("first")).distinct(), "cycles")
    return now.select("id", "ancestors", "names"), cycles


def under(excluded: list[str], drive: Column, key: Column) -> Column:
    """Whether a directory's folded path of names stands at or under one of the paths."""
    hit = F.lit(False)
    for path in excluded:
        wanted = fold(F.lit("\n".join([".", *(x for x in path[2:].split("\\") if x)])))
        hit = hit | ((drive == path[:1].upper()) & ((key == wanted) | F.startswith(key, F.concat(wanted, F.lit("\n")))))
    return hit


def build_nodes(entries: DataFrame, excluded: list[str] = (), epoch: int = 0) -> DataFrame:
    """The node table of entries. excluded: paths of directories whose bytes don't count toward others'. Of directories that hold each other the one with the smallest id hangs at the root (ORPHAN). Deleted entries stay and count nothing."""
    e = saved(with_parents(entries), "entries")  # read several times: the source only once
    chains = lambda e: closure(e.filter("is_dir").select("node_id", "parent_id", "name"))
    above, cycles = chains(e)
    if cycles is not None:
        e = e.join(F.broadcast(cycles), e["node_id"] == cycles["first"], "left")  # as few as the table's faults
        cut = F.col("first").isNotNull()
        e = e.withColumns({"parent_id": F.when(cut, node_id(F.col("vol_ord"), F.lit(ROOT_RECORD))).otherwise(F.col("parent_id")), "flags": F.when(cut, F.col("flags").bitwiseOR(F.lit(ORPHAN))).otherwise(F.col("flags"))}).drop("first")
        above, _ = chains(e)
    # What files take from their directory is made once for each directory.
    below_root = F.slice(F.reverse("names"), 2, F.greatest(F.size("names") - 1, F.lit(0)))
    above = above.join(e.filter("is_dir").select(F.col("node_id").alias("id"), "drive"), "id")
    above = above.select("id", "ancestors", "drive", _joined("names").alias("up_names"), F.concat("drive", F.lit(":\\"), F.array_join(below_root, "\\")).alias("up_path")).withColumn("up_fold", fold(F.col("up_names")))
    above = saved(above.withColumn("under_excluded", under(list(excluded), F.col("drive"), F.col("up_fold"))).drop("drive"), "directories")

    files = e.filter(~F.col("is_dir") & ~has(F.col("flags"), DELETED))
    own = files.groupBy(F.col("parent_id").alias("id")).agg(F.sum("own_size").alias("size"), F.sum("own_alloc").alias("alloc"), F.count(F.lit(1)).alias("files"))
    spread = above.select("id", "ancestors", "under_excluded").join(own, "id").select(F.explode("ancestors").alias("id"), "size", "alloc", "files", "under_excluded")
    out = F.col("under_excluded")
    total = spread.groupBy("id").agg(*(F.sum(c).alias(f"t_{c}") for c in ("size", "alloc", "files")), *(F.sum(F.when(out, F.col(c)).otherwise(0)).alias(f"x_{c}") for c in ("size", "alloc", "files")))
    counted = lambda c: F.when(out, F.coalesce(f"t_{c}", F.lit(0))).otherwise(F.coalesce(F.col(f"t_{c}") - F.col(f"x_{c}"), F.lit(0))).alias(f"sum_{c}")
    above = above.join(total, "id", "left").select(F.col("id").alias("dir_id"), "ancestors", "up_names", "up_path", "up_fold", "under_excluded", *map(counted, ("size", "alloc", "files")))

    is_dir = F.col("is_dir")
    d = e.join(above, F.when(is_dir, F.col("node_id")).otherwise(F.col("parent_id")) == F.col("dir_id"))
    mine = lambda of_dir, of_file: F.when(is_dir, of_dir).otherwise(of_file)
    name_fold = fold(F.col("name"))
    flags = F.when(F.col("under_excluded"), F.col("flags").bitwiseOR(F.lit(EXCLUDED))).otherwise(F.col("flags").bitwiseAND(F.lit(~EXCLUDED)))
    d = d.select(
        "node_id", "vol_ord", "drive", "record_no", "sequence", "parent_id", "name", name_fold.alias("name_fold"), flags.alias("flags"), "own_size", "own_alloc",
        mine(F.col("sum_size"), F.col("own_size")).alias("size"), mine(F.col("sum_alloc"), F.col("own_alloc")).alias("alloc"), mine(F.col("sum_files"), F.lit(0)).alias("subtree_files"), "mtime_unix",
        mine(F.col("ancestors"), F.concat(F.array("node_id"), "ancestors")).alias("ancestors"), "is_dir", (F.size("ancestors") - mine(F.lit(1), F.lit(0))).alias("depth"),
        mine(F.col("up_path"), F.concat("up_path", F.when(F.size("ancestors") > 1, "\\").otherwise(""), "name")).alias("path"), mine(F.col("up_names"), F.concat("up_names", F.lit("\n"), "name")).alias("path_names"),
        F.lit(epoch).cast("long").alias("epoch"), mine(F.col("up_fold"), F.concat("up_fold", F.lit("\n"), name_fold)).alias("path_fold"),
    )
    bits = {"is_excluded": EXCLUDED, "is_metadata": METADATA, "is_deleted": DELETED, "is_hard_link": HARD_LINK, "is_orphan": ORPHAN}
    return d.withColumns({c: has(F.col("flags"), bit) for c, bit in bits.items()} | {"is_root": F.col("parent_id") == F.col("node_id")})


def _joined(names: str) -> Column:
    return F.array_join(F.reverse(names), "\n")
