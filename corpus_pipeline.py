"""The training-data pipeline: documents, stage by stage, to token ids' digests.

Defined cases, in every stage: rows are judged one by one, so repeated rows and repeated or null ids go by their own text;
columns beyond those of documents are carried along, whatever their names; an empty table gives an empty result. Ties are
decided by the operators' own rules, the same at every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import saved, table
from treeline.llm.op1_quality import keep_quality
from treeline.llm.op4_minhash import drop_near_duplicates
from treeline.llm.op6_bpe import encode_documents
from treeline.llm.op7_mixing import mix
from treeline.llm.op9_language import keep_identified


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model learns from the rows' own lang. Null and wordless texts go; with no lang at all nothing can be learned, and all go."""
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null texts are empty and go; a null lang or source is a group of its own."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8. The smallest id stays, with all its rows; rows with a null id stay; empty texts are near to nothing."""
    return drop_near_duplicates(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' targets; one may come twice. A null source is a source, the last; texts without words are never drawn."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, for each row; a null text counts as the empty one."""
    return encode_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
