"""Corpus pipeline: stages from documents to packed training sequences.

Every stage takes the documents that the one before kept, with all their
columns. Rows that share a ``doc_id`` are told apart by their text. Null ids and
texts, repeated rows, extra columns and empty tables are handled as the
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationflow.llm.common import staged, table, text_key
from stationflow.llm.decontam import decontaminate
from stationflow.llm.jaccard import near_duplicates
from stationflow.llm.langid import judge, learn
from stationflow.llm.packing import pack_documents
from stationflow.llm.secrets import find, redact


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are (or are not) among ``keys`` (``doc_id``, ``key``)."""
    keys = keys.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: no letters, or a tie of the best two."""
    found = judge(F.col("text"), learn(docs.select("text", "lang")))
    return docs.withColumn("__found", found).where(~F.col("__found.rejected")).drop("__found")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Of rows of a group that repeat this id, one stays; groups are told apart by their
    root, as unlike ones may share an id or have none. Documents without words are no
    group: each id and text of them stays.
    """
    near = near_duplicates(docs.select("doc_id", "text"))
    alone = F.when(F.col("root").isNull(), F.col("key"))
    kept = (
        near.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("root", "doc_id", alone.alias("alone")).agg(F.min("key").alias("key"))
    )
    return _matched(docs, kept, "left_semi").withColumn("__key", text_key(F.col("text"))).dropDuplicates(
        ["doc_id", "__key"]
    ).drop("__key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    judged = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _matched(docs, judged.where("contaminated").select("doc_id", "key"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays."""
    return redact(docs, find(docs.select("doc_id", "text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack_documents(docs)


STAGES = [
    ("language", language), ("deduplicate", deduplicate), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("packing", packing),
]
ORACLE_SQL = None  # compression, randomness tests and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
