"""The change journal: coalescing a batch of records into changes, and folding changes into the entries.

A record of the file table is reused with a higher sequence number, so changes are keyed by (volume, record, sequence).
Within a batch each key is one group; what a group finds depends on the base row and on the group before it alone, so
outcomes need one window over a record's few groups and no loop over changes. Directories created in the same batch as
their children are found in rounds, one for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.storage import saved
from treeline.functions.text import file_record, file_sequence, fold
from treeline.operators.forest import DELETED, DIRECTORY, EXCLUDED, ORPHAN, has, node_id, under

# Reason bits of journal records.
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION = 0x1, 0x2, 0x4
FILE_CREATE, FILE_DELETE, RENAME_OLD_NAME, RENAME_NEW_NAME = 0x100, 0x200, 0x1000, 0x2000
BASIC_INFO_CHANGE, HARD_LINK_CHANGE, STREAM_CHANGE, CLOSE = 0x8000, 0x10000, 0x200000, 0x80000000
SIZE_CHANGES = DATA_OVERWRITE | DATA_EXTEND | DATA_TRUNCATION
INTERESTING = SIZE_CHANGES | FILE_CREATE | FILE_DELETE | RENAME_OLD_NAME | RENAME_NEW_NAME | HARD_LINK_CHANGE | CLOSE
ATTRIBUTE_DIRECTORY = 0x10


def with_keys(journal: DataFrame) -> DataFrame:
    """Interesting records, their file and parent references split into record and sequence."""
    j = journal.filter(F.col("reason").cast("long").bitwiseAND(F.lit(INTERESTING)) != 0)
    return j.withColumns({"record": file_record(F.col("file_ref")), "sequence": file_sequence(F.col("file_ref")), "parent": file_record(F.col("parent_ref"))})


def coalesce(journal: DataFrame) -> DataFrame:
    """One row for each (volume, record, sequence) that changed: first (its first usn), created, deleted, renamed, resized, name, parent, is_dir, size, mtime.

    journal: volume, record, sequence, parent, usn, reason, attributes, name, size, mtime. Of each the last value holds. A
    file created and deleted in the batch is left out, one deleted and then created is created and has the last name given;
    a rename goes by the name and parent of its last record of the new name, whatever came after; a resize needs a size and
    a file.
    """
    reason = F.col("reason").cast("long")
    bit = lambda b: has(reason, b)
    last = lambda c, when=None: F.max_by(F.col(c), F.when(when, F.col("usn")) if when is not None else F.col("usn"))
    g = journal.groupBy("volume", "record", "sequence").agg(
        F.min("usn").alias("first"), F.max(F.when(bit(FILE_CREATE), F.col("usn"))).alias("create_usn"), F.max(F.when(bit(FILE_DELETE), F.col("usn"))).alias("delete_usn"),
        F.bool_or(bit(RENAME_NEW_NAME)).alias("renamed"), F.bool_or(bit(SIZE_CHANGES)).alias("sized"), last("name", F.col("name") != "").alias("name"), last("parent").alias("parent"),
        last("name", bit(RENAME_NEW_NAME)).alias("new_name"), last("parent", bit(RENAME_NEW_NAME)).alias("new_parent"),
        has(last("attributes"), ATTRIBUTE_DIRECTORY).alias("is_dir"), last("size").alias("size"), last("mtime").alias("mtime"),
    )
    gone = F.col("delete_usn").isNotNull() & (F.col("create_usn").isNull() | (F.col("delete_usn") >= F.col("create_usn")))
    created = F.col("create_usn").isNotNull() & ~gone
    g = g.withColumns({"created": created, "deleted": gone & F.col("create_usn").isNull(), "empty": gone & F.col("create_usn").isNotNull()}).filter("not empty")
    quiet = ~F.col("created") & ~F.col("deleted")
    for c in ("name", "parent"):
        g = g.withColumn(c, F.when(F.col("renamed") & quiet, F.col(f"new_{c}")).otherwise(F.col(c))).drop(f"new_{c}")
    g = g.withColumns({"renamed": F.col("renamed") & quiet, "resized": F.col("sized") & quiet & ~F.col("is_dir") & F.col("size").isNotNull()})
    return g.filter("created or deleted or renamed or resized").drop("create_usn", "delete_usn", "sized", "empty")


def changes(groups: DataFrame) -> DataFrame:
    """One row for each change of coalesced groups, with its op."""
    ops = F.array(*(F.when(F.col(c), F.lit(name)) for c, name in (("created", "Created"), ("deleted", "Deleted"), ("renamed", "Renamed"), ("resized", "Resized"))))
    return groups.withColumn("op", F.explode(F.array_compact(ops)))


def _known_parents(groups: DataFrame, live: DataFrame) -> DataFrame:
    """(pv, pr, since, px) of directories that exist before the batch (since -1; px: excluded) or come with it, each after its own parent and under none that is excluded."""
    known = saved(live.filter(has(F.col("flags"), DIRECTORY)).select(F.col("vol_ord").alias("pv"), F.col("record_no").alias("pr"), F.lit(-1).cast("long").alias("since"), has(F.col("flags"), EXCLUDED).alias("px")), "known")
    waiting = groups.filter("created and is_dir")
    while True:
        more = waiting.join(known.filter("not px"), (F.col("volume") == F.col("pv")) & (F.col("parent") == F.col("pr")) & (F.col("since") < F.col("first")))
        more = more.select(F.col("volume").alias("pv"), F.col("record").alias("pr"), F.col("first").alias("since"), F.lit(False).alias("px")).distinct()
        more = saved(more.join(known, ["pv", "pr"], "left_anti"), "known-more")
        if more.isEmpty():
            return known
        known = saved(known.unionByName(more), "known")


def outcomes(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """The groups with base_ (the entry before the batch, of the first group only), parent_known, parent_excluded, and matches: the group's sequence is the live entry's."""
    live = entries.filter(~has(F.col("flags"), DELETED))
    known = _known_parents(groups, live)
    parents = known.groupBy(F.col("pv").alias("volume"), F.col("pr").alias("parent")).agg(F.min("since").alias("since"), F.bool_or("px").alias("px"))
    base = live.select(F.col("vol_ord").alias("volume"), F.col("record_no").alias("record"), F.col("sequence").alias("base_sequence"), F.col("name").alias("base_name"), F.col("parent_record").alias("base_parent"), F.col("flags").alias("base_flags"))
    g = groups.join(parents, ["volume", "parent"], "left").withColumns({"parent_known": F.coalesce(F.col("since") < F.col("first"), F.lit(False)), "parent_excluded": F.coalesce("px", F.lit(False))}).drop("since", "px")
    g = g.join(base, ["volume", "record"], "left")
    order = Window.partitionBy("volume", "record").orderBy("first")
    g = g.withColumn("place", F.row_number().over(order)).withColumn("later", F.lead("first").over(order))
    return g.withColumn("matches", (F.col("place") == 1) & F.coalesce(F.col("sequence") == F.col("base_sequence"), F.lit(False)))


def outcome(op: Column) -> Column:
    """What becomes of a change: a create of what is there is a resize; what is excluded, or has another sequence, or no parent, isn't followed."""
    flags = F.coalesce("base_flags", F.lit(0))
    resize = F.when(has(flags, DIRECTORY | EXCLUDED), "Ignored").otherwise("Resized")
    create = F.when(F.col("matches"), resize).when(~F.col("parent_known"), "Unknown").when(F.col("parent_excluded"), "Ignored").otherwise("Created")
    same = (F.col("name") == F.col("base_name")) & (F.col("parent") == F.col("base_parent"))
    rename = F.when(~F.col("parent_known"), "Unknown").when(same, "Ignored").when(F.col("name") != F.col("base_name"), "Renamed").otherwise("Moved")
    delete = F.when(has(flags, EXCLUDED), "Ignored").otherwise("Deleted")
    return F.when(op == "Created", create).when(~F.col("matches"), "Unknown").when(op == "Deleted", delete).when(op == "Resized", resize).otherwise(rename)


def counters(judged: DataFrame) -> DataFrame:
    """(op, outcome, n): what became of each change."""
    return changes(judged).withColumn("outcome", outcome(F.col("op"))).groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n"))


def total(counted: DataFrame) -> DataFrame:
    """One row, n: the changes that changed something."""
    return counted.agg(F.coalesce(F.sum(F.when(~F.col("outcome").isin("Unknown", "Ignored"), F.col("n"))), F.lit(0)).alias("n"))


def _decided(judged: DataFrame) -> DataFrame:
    """One row for each record: its last group decides its state, `dead`, `changed` or `new`, and what is taken over (c_)."""
    last = judged.filter("later is null")
    state = F.when(F.col("matches") & F.col("deleted"), "dead").when(F.col("matches"), "changed").when(F.col("created") & F.col("parent_known") & ~F.col("parent_excluded"), "new").otherwise("dead")
    fields = ("name", "parent", "size", "mtime", "sequence", "is_dir", "created", "resized")
    return last.select(F.col("volume").alias("vol_ord"), F.col("record").alias("record_no"), state.alias("state"), (F.col("renamed") & F.col("parent_known")).alias("c_renamed"), *(F.col(c).alias(f"c_{c}") for c in fields))


def _taken() -> dict[str, Column]:
    """Own fields of a changed entry. Of an excluded one only the size is followed."""
    followed = ~has(F.col("flags"), EXCLUDED)
    sized = (F.col("c_resized") | (F.col("c_created") & F.col("c_size").isNotNull())) & ~has(F.col("flags"), DIRECTORY)
    took = lambda cond, new, old: F.when(F.coalesce(cond, F.lit(False)), F.col(new)).otherwise(F.col(old))
    return {
        "own_size": took(sized, "c_size", "own_size"), "own_alloc": took(sized & followed, "c_size", "own_alloc"),
        "mtime_unix": took(sized & followed & (F.coalesce("c_mtime", F.lit(0)) != 0), "c_mtime", "mtime_unix"), "name": took(F.col("c_renamed"), "c_name", "name"),
    }


def apply(entries: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries after the batch, its judged groups). The last group of a record decides its state; an entry of another sequence is retired. What is gone stays as a tombstone (DELETED, without size) until its record is used again."""
    judged = saved(outcomes(coalesce(journal), entries), "judged")
    last = saved(_decided(judged), "decided")
    gone, state = has(F.col("flags"), DELETED), F.coalesce("state", F.lit(""))
    kept = ~gone & state.isin("", "changed")
    dead = F.when(gone, state != "new").otherwise(state == "dead")
    # one pass over the entries, whatever becomes of them
    old = entries.join(last, ["vol_ord", "record_no"], "left").filter(kept | dead)
    taken = _taken() | {"parent_record": F.when(F.coalesce("c_renamed", F.lit(False)), F.col("c_parent")).otherwise(F.col("parent_record"))}
    lost = {"own_size": F.lit(0).cast("long"), "own_alloc": F.lit(0).cast("long")}
    old = old.withColumns({c: F.when(kept, now).otherwise(lost.get(c, F.col(c))) for c, now in taken.items()} | {"flags": F.when(kept, F.col("flags")).otherwise(F.col("flags").bitwiseOR(F.lit(DELETED)))})
    drives = entries.select("vol_ord", "drive").distinct()
    size = F.when(F.col("c_is_dir"), 0).otherwise(F.coalesce("c_size", F.lit(0))).cast("long")
    new = last.filter("state = 'new'").join(drives, "vol_ord").select(
        "vol_ord", "drive", "record_no", F.col("c_sequence").alias("sequence"), F.col("c_parent").alias("parent_record"), F.col("c_name").alias("name"),
        F.when(F.col("c_is_dir"), DIRECTORY).otherwise(0).alias("flags"), size.alias("own_size"), size.alias("own_alloc"), F.coalesce("c_mtime", F.lit(0)).cast("long").alias("mtime_unix"),
    )
    return old.select(*entries.columns).unionByName(new), judged


def _totals(rows: DataFrame, sign: int) -> DataFrame:
    """(id, d_* from all, o_* from rows that aren't excluded) over the directories above files."""
    live = rows.filter(~F.col("is_dir") & ~F.col("is_deleted")).select(F.explode(F.slice("ancestors", 2, F.greatest(F.size("ancestors") - 1, F.lit(0)))).alias("id"), F.col("size"), F.col("alloc"), F.lit(1).cast("long").alias("files"), "is_excluded")
    return live.select("id", *((sign * F.col(c)).alias(f"d_{c}") for c in ("size", "alloc", "files")), *(F.when(F.col("is_excluded"), 0).otherwise(sign * F.col(c)).cast("long").alias(f"o_{c}") for c in ("size", "alloc", "files")))


def apply_to_nodes(nodes: DataFrame, judged: DataFrame, excluded: list[str] = ()) -> DataFrame | None:
    """The node table after a batch without building it anew; None where directories were renamed or are removed while something is in them or comes to them, as then whole subtrees change.

    Rows that changed are made from their parents' rows; what they add or take away is summed over their ancestors, and the
    sums are added to the directories' totals. The table is read and written once, joined by rows as few as the batch has.
    """
    last = saved(_decided(judged), "decided")
    touched = saved(nodes.join(last, ["vol_ord", "record_no"]), "touched")
    moved = touched.filter(F.col("is_dir") & ~F.col("is_deleted") & ((F.col("state") == "new") | F.col("c_renamed") & ((F.col("c_name") != F.col("name")) | (node_id(F.col("vol_ord"), F.col("c_parent")) != F.col("parent_id")))))
    dead_dirs = touched.filter("is_dir and not is_deleted and state = 'dead'").select("node_id")
    left = nodes.filter(~F.col("is_deleted")).join(dead_dirs.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").join(touched.filter("state = 'dead'").select("node_id"), "node_id", "left_anti")
    if not moved.isEmpty() or not left.isEmpty():
        return None
    zero = F.lit(0).cast("long")
    drop = [c for c in touched.columns if c.startswith("c_")] + ["state"]
    tombs = touched.filter("state = 'dead'").withColumns({c: zero for c in ("own_size", "own_alloc", "size", "alloc", "subtree_files")} | {"flags": F.col("flags").bitwiseOR(F.lit(DELETED)), "is_deleted": F.lit(True)}).drop(*drop)
    changed = touched.filter("state = 'changed' and not is_deleted").withColumns(_taken() | {"wanted": F.when(F.col("c_renamed"), node_id(F.col("vol_ord"), F.col("c_parent"))).otherwise(F.col("parent_id"))})
    still = changed.filter("not c_renamed").withColumns({c: F.when(F.col("is_dir"), F.col(c)).otherwise(F.col(f"own_{c}")) for c in ("size", "alloc")}).drop(*drop, "wanted")
    place = ["node_id", "vol_ord", "record_no", "sequence", "name", "flags", "own_size", "own_alloc", "mtime_unix", "is_dir", "wanted"]
    size = F.when(F.col("c_is_dir"), 0).otherwise(F.coalesce("c_size", F.lit(0))).cast("long")
    born = last.filter("state = 'new'").select(
        node_id(F.col("vol_ord"), F.col("record_no")).alias("node_id"), "vol_ord", "record_no", F.col("c_sequence").alias("sequence"), F.col("c_name").alias("name"), F.when(F.col("c_is_dir"), DIRECTORY).otherwise(0).alias("flags"),
        size.alias("own_size"), size.alias("own_alloc"), F.coalesce("c_mtime", F.lit(0)).cast("long").alias("mtime_unix"), F.col("c_is_dir").alias("is_dir"), node_id(F.col("vol_ord"), F.col("c_parent")).alias("wanted"),
    )
    waiting = saved(born.unionByName(changed.filter("c_renamed").select(*place)), "waiting")
    parents = nodes.filter("is_dir and not is_deleted").join(touched.filter("state = 'dead'").select("node_id"), "node_id", "left_anti")
    made = still
    while not waiting.isEmpty():  # once for each level of directories created with what they hold
        placed = saved(_placed(waiting, parents, nodes.columns, excluded), "placed")
        made = made.unionByName(placed.select(*made.columns))
        waiting = saved(waiting.join(placed.select("node_id"), "node_id", "left_anti"), "waiting")
        parents = placed.filter("is_dir")
        if placed.isEmpty():  # what is left has a parent that goes with this batch
            return None
    made = saved(made.unionByName(tombs.join(made.select("node_id"), "node_id", "left_anti").select(*made.columns)), "made")
    sums = _totals(touched, -1).unionByName(_totals(made, 1)).groupBy("id").agg(*(F.sum(f"{k}_{c}").alias(f"{k}_{c}") for k in "do" for c in ("size", "alloc", "files")))
    rest = nodes.join(made.select("node_id"), "node_id", "left_anti").unionByName(made.select(*nodes.columns))
    rest = rest.join(saved(sums, "sums"), rest["node_id"] == F.col("id"), "left")
    more = lambda c: F.when(F.col("is_excluded"), F.col(f"d_{c}")).otherwise(F.col(f"o_{c}"))
    grown = lambda c, of: F.when(F.col("is_dir") & F.col("id").isNotNull() & ~F.col("is_deleted"), F.col(c) + more(of)).otherwise(F.col(c))
    return rest.withColumns({"size": grown("size", "size"), "alloc": grown("alloc", "alloc"), "subtree_files": grown("subtree_files", "files")}).select(*nodes.columns)


def _placed(rows: DataFrame, parents: DataFrame, columns: list[str], excluded: list[str]) -> DataFrame:
    """Node rows of those whose parent (wanted) is among parents."""
    p = parents.select(F.col("node_id").alias("wanted"), "drive", F.col("ancestors").alias("p_ancestors"), F.col("path").alias("p_path"), F.col("path_names").alias("p_names"), F.col("is_excluded").alias("p_excluded"), F.col("is_root").alias("p_root"), F.col("epoch"))
    d = rows.join(p, "wanted").withColumn("path_names", F.concat("p_names", F.lit("\n"), "name"))
    d = d.withColumns({"path_fold": fold(F.col("path_names")), "path": F.concat("p_path", F.when(F.col("p_root"), "").otherwise("\\"), "name"), "ancestors": F.concat(F.array("node_id"), "p_ancestors"), "name_fold": fold(F.col("name")), "parent_id": F.col("wanted")})
    d = d.withColumn("is_excluded", F.col("p_excluded") | (F.col("is_dir") & under(excluded, F.col("drive"), F.col("path_fold"))))
    clear = F.col("flags").bitwiseAND(F.lit(~(EXCLUDED | ORPHAN)))
    d = d.withColumns({"flags": F.when(F.col("is_excluded"), clear.bitwiseOR(F.lit(EXCLUDED))).otherwise(clear), "size": F.when(F.col("is_dir"), 0).otherwise(F.col("own_size")).cast("long"), "alloc": F.when(F.col("is_dir"), 0).otherwise(F.col("own_alloc")).cast("long")})
    kinds = {"is_metadata": 1024, "is_hard_link": 128}
    return d.withColumns({"depth": F.size("ancestors") - 1, "subtree_files": F.lit(0).cast("long"), "is_deleted": F.lit(False), "is_orphan": F.lit(False), "is_root": F.lit(False)} | {c: has(F.col("flags"), bit) for c, bit in kinds.items()}).select(*columns)
