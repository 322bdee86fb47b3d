"""Sizes, the largest directories, volume status and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.text import count_text, size_text, time_text
from treeline.operators.search import lookup, result_rows, scope

LIVE = "not is_deleted"
#: Fixed value: bytes of a node's fields but for its name.
FIXED_BYTES = 38


def size_children(nodes: DataFrame, path: str, top: int) -> DataFrame:
    """The largest children of a directory that count toward it; top 0: none."""
    home = scope(nodes, path)
    kids = nodes.filter((F.col("parent_id") == home) & (F.col("node_id") != home) & F.expr(LIVE) & ~F.col("is_excluded"))
    return result_rows(kids.orderBy(F.desc("size"), "node_id").limit(top))


def size_of(nodes: DataFrame, path: str) -> DataFrame:
    scope(nodes, path)
    return result_rows(lookup(nodes, path))


def own_bytes(nodes: DataFrame) -> DataFrame:
    """Each directory's bytes in files of its own."""
    files = nodes.filter(~F.col("is_dir") & ~F.col("is_excluded") & F.expr(LIVE)).groupBy(F.col("parent_id").alias("id")).agg(F.sum("size").alias("own"))
    dirs = nodes.filter(F.col("is_dir"))
    return dirs.join(files, dirs["node_id"] == files["id"], "left").withColumn("own", F.coalesce("own", F.lit(0)))


def largest_dirs(nodes: DataFrame, top: int = 30, under: str | None = None) -> DataFrame:
    """Directories by their subtrees' bytes, with own bytes; top 0: all. The bytes of files are summed for the directories shown alone."""
    keep = F.col("is_dir") & ~F.col("is_excluded") & ~F.col("is_root") & F.expr(LIVE)
    if under:
        keep &= F.array_contains("ancestors", F.lit(scope(nodes, under)).cast("long"))
    dirs = nodes.filter(keep).orderBy(F.desc("size"), "node_id")
    dirs = dirs.limit(top) if top else dirs
    files = nodes.filter(~F.col("is_dir") & ~F.col("is_excluded") & F.expr(LIVE))
    own = files.join(dirs.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").groupBy(F.col("parent_id").alias("id")).agg(F.sum("size").alias("own_sum"))
    shown = dirs.join(own, dirs["node_id"] == own["id"], "left").orderBy(F.desc("size"), "node_id")
    return result_rows(shown, F.coalesce("own_sum", F.lit(0)))


def status(nodes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per volume: files and bytes of the root, directories, deleted nodes, position and liveness of the journal."""
    counts = nodes.groupBy("vol_ord").agg(
        F.max(F.when(F.col("is_root"), F.col("subtree_files"))).alias("files"), F.max(F.when(F.col("is_root"), F.col("size"))).alias("size"),
        F.count_if(F.col("is_dir") & ~F.col("is_deleted")).alias("dirs"), F.count_if(F.col("is_deleted")).alias("deleted"), F.count(F.lit(1)).alias("nodes"),
    )
    return volumes.join(counts, "vol_ord", "left")


def tombstones(nodes: DataFrame) -> DataFrame:
    """Deleted nodes of each volume."""
    return nodes.groupBy("vol_ord").agg(F.count_if(F.col("is_deleted")).alias("tombstones"))


def memory_estimate(nodes: DataFrame) -> DataFrame:
    """Bytes that the nodes of each volume take in memory: the fixed fields, the names, and a table of records."""
    return nodes.groupBy("vol_ord").agg((FIXED_BYTES * F.count(F.lit(1)) + F.sum(F.octet_length("name")) + 4 * (F.max("record_no") + 1)).cast("long").alias("bytes"))


def listing(nodes: DataFrame, path: str) -> DataFrame:
    """What a directory holds: directories first, then by folded name, then by name."""
    home = scope(nodes, path)
    kids = nodes.filter((F.col("parent_id") == home) & ~F.col("is_root") & F.expr(LIVE))
    return kids.orderBy(F.desc("is_dir"), "name_fold", "name", "node_id")


def scan_report(nodes: DataFrame) -> DataFrame:
    """Per volume what a scan found: files, directories, their bytes and allocation."""
    live = nodes.filter(F.expr(LIVE))
    file = lambda c: F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col(c))), F.lit(0)).cast("long")
    return live.groupBy("vol_ord").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if(F.col("is_dir")).alias("dirs"), file("own_size").alias("size"), file("own_alloc").alias("alloc"))


def rendered(rows: DataFrame, own: bool = False) -> DataFrame:
    """Result rows as lines of text: size, time (or own bytes and files, for directories by size), and the path, of directories with a separator."""
    shown = F.concat("path", F.when(F.col("is_dir") & ~F.col("path").endswith("\\"), "\\").otherwise(""))
    between = [F.lpad(size_text(F.col("own")), 10, " "), F.lpad(count_text(F.col("files")), 9, " ")] if own else [time_text(F.col("mtime"))]
    return rows.select(F.concat_ws("  ", F.lpad(size_text(F.col("size")), 10, " "), *between, shown).alias("line"))


def share_of_largest(rows: DataFrame) -> DataFrame:
    """Tenths of the largest size, for each row of a page."""
    most = F.max("size").over(Window.partitionBy())
    return rows.withColumn("blocks", F.when(most > 0, F.least(F.lit(10), F.round(F.col("size") / most * 10).cast("int"))).otherwise(0))


def problems(nodes: DataFrame, volumes: DataFrame) -> DataFrame:
    """(check, n) of what is wrong with an index; n is 0 throughout in a sound one."""
    parents = nodes.select(F.col("node_id").alias("p"))
    checks = [
        nodes.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("n")).select(F.lit("empty").alias("check"), "n"),
        nodes.join(parents, nodes["parent_id"] == parents["p"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing parent").alias("check"), "n"),
        volumes.join(nodes.filter("is_root"), "vol_ord", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing root").alias("check"), "n"),
        nodes.groupBy("node_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated id").alias("check"), "n"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
