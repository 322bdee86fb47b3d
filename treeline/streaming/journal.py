"""The live index: a Structured Streaming query that folds journal batches into snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeline.functions.storage import saved
from treeline.operators.changes import INTERESTING, apply, apply_to_nodes, coalesce, counters, outcomes, with_keys
from treeline.operators.forest import DIRECTORY, ORPHAN, build_nodes, has
from treeline.sources import snapshot
from treeline.sources.ntfs import USN_SCHEMA, decode_batches

JOURNAL = "volume int, record long, sequence int, parent long, usn long, reason long, attributes int, name string, size long, mtime long"


class Desynchronised(RuntimeError):
    """The journal no longer holds what follows a volume's stored position: the volume must be scanned anew."""


def entries_of_nodes(nodes: DataFrame) -> DataFrame:
    """What build_nodes() was given, tombstones and marks of exclusion included."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("record_no").alias("parent_record"))
    e = nodes.join(parents, "parent_id")
    size = lambda c: F.when(has(F.col("flags"), DIRECTORY), 0).otherwise(F.col(c)).cast("long").alias(c)
    return e.select("vol_ord", "drive", "record_no", "sequence", "parent_record", "name", F.col("flags").bitwiseAND(F.lit(~ORPHAN)).alias("flags"), size("own_size"), size("own_alloc"), "mtime_unix")


def fold_batch(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Fold a batch into the snapshot at path and publish the next epoch; (op, outcome, n) of its changes.

    Records at or before the volume's position are left out, so a batch that is delivered again changes nothing. What the
    snapshot excludes stays excluded. Totals are changed by what the batch adds and takes away; only a batch that renames
    or removes directories with something in them has the table built anew.
    """
    nodes, volumes, manifest = snapshot.load(spark, path, verify=False)
    seen = volumes.select(F.col("vol_ord").alias("volume"), F.col("next_usn").alias("position"))
    known = batch.filter(F.col("reason").cast("long").bitwiseAND(F.lit(INTERESTING)) != 0)
    fresh = known.join(F.broadcast(seen), "volume").filter(F.col("usn") >= F.col("position")).drop("position")  # one row a volume
    judged = saved(outcomes(coalesce(fresh), entries_of_nodes(nodes)), "judged")
    after = apply_to_nodes(nodes, judged, manifest["excluded"])
    if after is None:
        after = build_nodes(apply(entries_of_nodes(nodes), fresh)[0], manifest["excluded"])
    moved = batch.groupBy(F.col("volume").alias("vol_ord")).agg((F.max("usn") + 1).alias("to"))
    volumes = volumes.join(moved, "vol_ord", "left").withColumn("next_usn", F.greatest("next_usn", "to")).drop("to")
    snapshot.save(after, volumes, path, manifest["excluded"])
    return counters(judged)


def watch(spark: SparkSession, journal_dir: str, path: str, checkpoint: str, every: str | None = None, on_counters=None, journals: DataFrame | None = None, seconds: float | None = None) -> StreamingQuery:
    """Fold journal files that arrive in journal_dir (JSON rows of JOURNAL) into the snapshot.

    every: a processing interval; None: what is there, then stop. journals (vol_ord, first_usn, last_usn): what the
    journals still hold; a volume whose position lies outside raises Desynchronised before anything is read. seconds: stop
    after so long.
    """
    if journals is not None:
        lost = [r["drive"] for r in position_gap(snapshot.load(spark, path, verify=False)[1], journals).filter("desynced").select("drive").collect()]  # of the volumes, a few
        if lost:
            raise Desynchronised(", ".join(sorted(lost)))
    stream = spark.readStream.schema(JOURNAL).json(journal_dir)

    def fold(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            found = fold_batch(spark, path, batch)
            if on_counters:
                on_counters(found)

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if seconds is not None:
        query.awaitTermination(seconds)
        query.stop()
    return query


def watch_batches(spark: SparkSession, batches_dir: str, journal_dir: str, volume: int, checkpoint: str) -> StreamingQuery:
    """Decode files of raw journal batches that arrive in batches_dir into JSON rows for watch(). A raw record tells no size or time: these stay null, so resizes wait for the next scan."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(batches_dir)
    rows = with_keys(files.select(F.col("content").alias("batch")).mapInArrow(decode_batches, USN_SCHEMA))
    none = F.lit(None).cast("long")
    rows = rows.select(F.lit(volume).alias("volume"), "record", "sequence", "parent", "usn", "reason", F.col("attributes").cast("int").alias("attributes"), "name", none.alias("size"), none.alias("mtime"))
    return rows.writeStream.format("json").option("path", journal_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def position_gap(volumes: DataFrame, journals: DataFrame) -> DataFrame:
    """volumes with `desynced`: the journal (vol_ord, first_usn, last_usn) no longer holds what follows the stored position, so the volume must be rebuilt."""
    v = volumes.join(journals, "vol_ord", "left")
    return v.withColumn("desynced", ~F.coalesce(F.col("next_usn").between(F.col("first_usn"), F.col("last_usn")), F.lit(False)))
