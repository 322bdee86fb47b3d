"""Versioned snapshots: a Parquet folder for each epoch, and a manifest that names the published one.

The manifest is written beside its place and renamed over it, in one step, after the data, so readers see the old index or
the new one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
#: Seconds after which an index is rebuilt, and after which a note says that it is old.
REUSE, STALE = 3600, 1800


class BadSnapshot(ValueError):
    """The snapshot is missing, damaged or of another format."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def checksum(nodes: DataFrame) -> int:
    """Order-free: the sum of row hashes, modulo 2**63."""
    plain = [c for c in sorted(nodes.columns)]
    return int(nodes.agg(F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()[0]) % 2**63


def save(nodes: DataFrame, volumes: DataFrame, path: str, excluded: list[str] = ()) -> dict:
    """Write the next epoch and publish it in one step; epochs before the last one, which readers may still have open, are removed."""
    spark = nodes.sparkSession
    try:
        epoch = peek(spark, path)["epoch"] + 1
    except BadSnapshot:
        epoch = 1
    data = f"{path}/epoch={epoch}-{uuid.uuid4().hex[:8]}"
    nodes.withColumn("epoch", F.lit(epoch).cast("long")).write.parquet(f"{data}/nodes")
    volumes.write.parquet(f"{data}/volumes")
    written = spark.read.parquet(f"{data}/nodes")
    manifest = {"format": FORMAT, "epoch": epoch, "data": data, "written_at": int(time.time()), "nodes": written.count(), "drives": sorted(r["drive"] for r in volumes.select("drive").collect()), "checksum": checksum(written), "excluded": list(excluded)}
    fs, temporary = _fs(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/manifest.json")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    replace = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
    qualified = fs.makeQualified(final)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), qualified, replace)  # raises if it fails
    _, root = _fs(spark, path)
    for old in fs.listStatus(root):
        name = old.getPath().getName()
        if name.startswith("epoch=") and int(name[6:].split("-")[0]) < epoch - 1:
            fs.delete(old.getPath(), True)
    return manifest


def peek(spark: SparkSession, path: str) -> dict:
    """The manifest, without reading data."""
    try:
        text = "\n".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect())
        manifest = json.loads(text)
    except (AnalysisException, ValueError) as e:
        raise BadSnapshot(path) from e
    if manifest.get("format") != FORMAT:
        raise BadSnapshot(f"format {manifest.get('format')}")
    return {"excluded": []} | manifest


def load(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, volumes, manifest); verify: the data must be what the manifest says."""
    manifest = peek(spark, path)
    try:
        nodes, volumes = spark.read.parquet(f"{manifest['data']}/nodes"), spark.read.parquet(f"{manifest['data']}/volumes")
    except AnalysisException as e:
        raise BadSnapshot(path) from e
    if verify and (nodes.count() != manifest["nodes"] or checksum(nodes) != manifest["checksum"]):
        raise BadSnapshot("the data don't match the manifest")
    return nodes, volumes, manifest


def freshness(manifest: dict, drives: list[str], now: int) -> str:
    """`reuse`, `stale` (reuse, with a note) or `rebuild`."""
    age = now - manifest["written_at"]
    if sorted(drives) != manifest["drives"] or age > REUSE:
        return "rebuild"
    return "stale" if age >= STALE else "reuse"
