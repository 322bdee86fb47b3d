"""What the operators of this package share: words, shared folders, saved tables, file access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (fixed by the contracts of the queries).
WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of a batch that goes to a Python worker, about; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Most bytes of a table that is broadcast, by a count of its rows.
BROADCAST_BYTES = 32 << 20


def release() -> None:
    """Give memory that this process no longer uses back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_python(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes, and memory released at the end of each task, as workers are used again."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """The driver's rows as a DataFrame, by way of Arrow. From plain rows Spark makes an RDD that Python workers pass on, and these, with a daemon of their own on every executor, stay in memory."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows]) for i in range(len(names))], names=names), schema)


def bounded(small: DataFrame, size: int) -> DataFrame:
    """small, to be broadcast if it has few bytes: the other side's rows, a hot key's included, then stay where they are. Else the join shuffles."""
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, as in tests, is it a folder of our own where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TASKS_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def saved(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written to the shared folder and read again: the lineage is cut, lost executors don't matter, and the planner knows its size.

    small: few rows come out, so partitions are merged up to the advised size instead of one for each core, which spares
    tiny tasks and files.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_TASKS_FIRST)
    if small:
        spark.conf.set(_TASKS_FIRST, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TASKS_FIRST, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what saved() wrote; nothing may still depend on it."""
    spark, path = df.sparkSession, df.saved_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of df by the planner's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_file(path: str, parts) -> None:
    """Write bytes-like parts; the file appears whole or not at all, and a repeated task writes the same again."""
    store, at = filesystem(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    store.move(temporary, at)


_LOCAL: dict[str, str] = {}


def local_file(path: str) -> str:
    """A path that can be memory-mapped: the file itself if its file system is mounted, else this process's copy."""
    from pyarrow import fs

    store, at = filesystem(path)
    if isinstance(store, fs.LocalFileSystem):
        return at
    if path not in _LOCAL:
        target = os.path.join(tempfile.mkdtemp(prefix="treeline-"), os.path.basename(at))
        fs.copy_files(at, target, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        _LOCAL[path] = target
    return _LOCAL[path]
