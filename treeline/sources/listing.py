"""Directories of any file system that Spark reaches, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import fold

SCHEMA = "name string, is_dir boolean, size long, mtime_unix long, path string"


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """What a directory holds, directories first, then by folded name and name. Raises if it can't be read. One directory's entries pass the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    rows = [(x.getPath().getName(), x.isDirectory(), 0 if x.isDirectory() else x.getLen(), x.getModificationTime() // 1000, x.getPath().toString()) for x in found]
    return spark.createDataFrame(rows, SCHEMA).orderBy(F.desc("is_dir"), fold(F.col("name")), "name")
