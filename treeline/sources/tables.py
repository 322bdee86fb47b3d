"""The driver's tables as volumes: C, a forest of regions down to order lines; D, documents; and a journal of events on D."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.operators.forest import DIRECTORY, HARD_LINK, HIDDEN, ROOT_RECORD

CLUSTER = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(df: DataFrame, vol_ord: int, drive: str, record, parent, name, flags=DIRECTORY, size=0, mtime=0) -> DataFrame:
    lit = lambda x: x if not isinstance(x, (int, str)) else F.lit(x)
    alloc = F.ceil(lit(size) / CLUSTER) * CLUSTER
    return df.select(
        F.lit(vol_ord).alias("vol_ord"), F.lit(drive).alias("drive"), lit(record).cast("long").alias("record_no"), F.lit(1).alias("sequence"), lit(parent).cast("long").alias("parent_record"),
        lit(name).alias("name"), lit(flags).cast("int").alias("flags"), lit(size).cast("long").alias("own_size"), alloc.cast("long").alias("own_alloc"), lit(mtime).cast("long").alias("mtime_unix"),
    )


def volume_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    line = t("lineitem")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*line.columns))
    line = line.withColumn("rn", rn).join(t("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    line = line.join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    word = F.lower(F.substring_index("o_orderpriority", " ", 1))
    flags = F.when(F.col("l_linenumber") == 7, HARD_LINK).otherwise(0) + F.when(F.col("o_orderstatus") == "P", HIDDEN).otherwise(0)
    parts = [
        _entries(spark.range(1), 0, "C", ROOT_RECORD, ROOT_RECORD, "."),
        _entries(t("region"), 0, "C", 100 + F.col("r_regionkey"), ROOT_RECORD, F.col("r_name")),
        _entries(t("nation"), 0, "C", 1000 + F.col("n_nationkey"), 100 + F.col("n_regionkey"), F.col("n_name")),
        _entries(t("customer"), 0, "C", 1_000_000 + F.col("c_custkey"), 1000 + F.col("c_nationkey"), F.col("c_name")),
        _entries(t("orders"), 0, "C", 10_000_000 + F.col("o_orderkey"), 1_000_000 + F.col("o_custkey"), F.concat(F.lit("order "), F.col("o_orderkey"), F.lit("."), word)),
        _entries(
            line, 0, "C", 100_000_000 + F.col("l_orderkey") * 1000 + F.col("rn"), 10_000_000 + F.col("l_orderkey"), F.concat("p_name", F.lit(" "), "rn", F.lit("."), F.lower("p_type")),
            flags, F.col("l_quantity").cast("long") * 1024 + F.col("l_linenumber"), F.unix_timestamp("l_shipdate"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _doc_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source and the records of their directories."""
    docs = read(spark, sf_dir, "documents")
    langs = docs.select("lang").distinct().withColumn("lang_rank", F.row_number().over(Window.orderBy("lang")))
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return docs.join(F.broadcast(langs), "lang").withColumns({"lang_record": 15 + F.col("lang_rank"), "source_record": 1000 + F.col("lang_rank") * 1000 + number})


def volume_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _doc_dirs(spark, sf_dir)
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))
    return (
        _entries(spark.range(1), 1, "D", ROOT_RECORD, ROOT_RECORD, ".")
        .unionByName(_entries(docs.select("lang", "lang_record").distinct(), 1, "D", F.col("lang_record"), ROOT_RECORD, F.col("lang")))
        .unionByName(_entries(docs.select("lang_record", "source", "source_record").distinct(), 1, "D", F.col("source_record"), F.col("lang_record"), F.col("source")))
        .unionByName(_entries(docs, 1, "D", 1_000_000 + F.col("doc_id"), F.col("source_record"), name, 0, F.octet_length(F.col("text"))))
    )


def contents_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and content of volume D's files."""
    docs = read(spark, sf_dir, "documents")
    return docs.select((F.lit(1 << 48) + 1_000_000 + F.col("doc_id")).alias("node_id"), F.encode("text", "UTF-8").alias("content"))


def volumes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "C", 0, False), (1, "D", 0, True)], "vol_ord int, drive string, next_usn long, journal_active boolean")


#: The directory that the journal's new files stand in: the first source directory of the first language.
JOURNAL_PARENT = 2000
REASONS = {"signup": 0x100, "click": 0x2, "purchase": 0x1, "view": 0x2000, "error": 0x200}


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as journal records on volume D; the sequence of a user's record counts the errors before."""
    e = read(spark, sf_dir, "events")
    mine = Window.partitionBy("user_id").orderBy("event_id")
    errors = F.sum((F.col("event_type") == "error").cast("int")).over(mine) - (F.col("event_type") == "error").cast("int")
    reason = F.lit(0)
    for k, v in REASONS.items():
        reason = F.when(F.col("event_type") == k, v).otherwise(reason)
    return e.select(
        F.lit(1).alias("volume"), (1_000_000 + F.col("user_id")).alias("record"), (1 + errors).cast("int").alias("sequence"), F.lit(JOURNAL_PARENT).cast("long").alias("parent"), F.col("event_id").alias("usn"),
        reason.alias("reason"), F.lit(0).alias("attributes"), F.concat(F.lit("u"), "user_id", F.lit("_"), "event_id", F.lit(".dat")).alias("name"),
        (F.col("value").cast("decimal(12,2)") * 100).cast("long").alias("size"), F.unix_timestamp("ts").alias("mtime"),
    )
