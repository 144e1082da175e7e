"""Queries of the operators in this package: name -> callable, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, chat, decontam, jaccard, langid, lexical, outliers, packing, quality, secrets, tokens, topk, warc
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(jaccard.SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates and number of links of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("key", "root")


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned without the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return docs.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), quality.score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query(decontam.SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query(topk.SQL)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of every hundredth vector."""
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(rows.where("vec_id % 100 = 0"), rows)


@query(warc.SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


@query(chat.SQL)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and one that spells control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.unionByName(more))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned without the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 4, 2)
    found = langid.judge(F.col("text"), langid.learn(docs.where(~fold)))
    return docs.select("doc_id", fold.alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.lang_pred", "f.score", "f.rejected"
    )


@query()
def op9_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written in order and read back."""
    return tokens.token_table(table(spark, sf_dir, "documents"))


@query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return secrets.by_document(docs, secrets.find(docs))


@query()
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the quality rules for every document."""
    return outliers.judge(table(spark, sf_dir, "documents")).drop("key")


@query(audit.SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    return audit.audit(audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query(lexical.SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
