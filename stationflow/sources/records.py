"""Configurations, evaluation sets and text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..functions import text as X

EVAL_SCHEMA = "user_input string, response string, reference string, retrieved_contexts array<string>"


UNREADABLE = "_corrupt_record"


def read_experiments(
    spark: SparkSession, path: str | Sequence[str], invalid: str = "fail", glob: str = "*.json",
) -> DataFrame:
    """Experiment configurations, missing values filled with their defaults.

    A configuration with a value of a wrong type or outside its choices (``S.EXPERIMENT_CHOICES``)
    fails the job; with ``invalid="mark"`` all rows come, and ``problem`` tells what is wrong with them.
    """
    if invalid not in ("fail", "mark"):
        raise ValueError("invalid is fail or mark")
    raw = (
        spark.read.schema(f"{S.EXPERIMENT_SCHEMA}, {UNREADABLE} string").option("multiLine", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
    )
    # every field takes part in the test, or Spark would not parse those that nobody selects
    every = F.to_json(F.struct(*[c for c in raw.columns if c != UNREADABLE])).isNotNull()
    named = raw.select(F.col("_metadata.file_path").alias("path"), "*", (F.col(UNREADABLE).isNotNull() & every).alias("__wrong"))
    rows = fill_experiment_defaults(named)
    problem = F.when(F.col("__wrong"), F.lit("a value has the wrong type")).otherwise(experiment_problem())
    rows = rows.withColumn("problem", problem).drop(UNREADABLE, "__wrong")
    if invalid == "mark":
        return rows
    wrong = F.concat(F.col("path"), F.lit(": "), F.col("problem"))
    return rows.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(wrong).cast("boolean"))).drop("problem")


def experiment_problem() -> Column:
    """The first field of a filled configuration that is none of its choices, with its value; null if all are."""
    found = F.lit(None).cast("string")
    for name, choices in reversed(S.EXPERIMENT_CHOICES.items()):
        said = F.concat(F.lit(f"{name} is "), F.col(name), F.lit(f", not one of {', '.join(choices)}"))
        found = F.when(~F.col(name).isin(choices), said).otherwise(found)
    return found


def fill_experiment_defaults(df: DataFrame) -> DataFrame:
    def default(name: str, kind: T.DataType) -> Column | None:
        value = S.EXPERIMENT_DEFAULTS.get(name)
        if value is None:
            return None
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value])
        return F.lit(value).cast(kind)

    def filled(field: T.StructField, prefix: str, parent: Column | None) -> Column:
        name = prefix + field.name
        col = F.col(field.name) if parent is None else parent[field.name]
        if isinstance(field.dataType, T.StructType):
            inner = [filled(f, name + ".", col).alias(f.name) for f in field.dataType.fields]
            return F.struct(*inner)
        value = default(name, field.dataType)
        return col if value is None else F.coalesce(col, value)

    return df.select(*[filled(f, "", None).alias(f.name) for f in df.schema.fields])


def read_eval_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation rows of a JSON-lines file; missing text is empty, missing contexts are ``[]``.

    ``limit`` keeps the first rows in file order.
    """
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("n"),
        ).alias("__pos"),
        F.col("value").alias("__line"),
    ).where(X.strip_text("__line") != "")
    if limit:
        lines = lines.orderBy("__pos").limit(limit)
    row = F.from_json("__line", EVAL_SCHEMA, {"mode": "FAILFAST"})
    texts = [F.coalesce(F.col(f"__r.{c}"), F.lit("")).alias(c) for c in ("user_input", "response", "reference")]
    contexts = F.coalesce(F.col("__r.retrieved_contexts"), F.array().cast("array<string>"))
    return lines.select(row.alias("__r")).select(*texts, contexts.alias("retrieved_contexts"))


def read_text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines without surrounding blanks, empty ones left out."""
    text = X.strip_text("value")
    return spark.read.text(path).select(text.alias("text")).where(F.col("text") != "")


def text_lines(df: DataFrame, col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The same for a text column of a table."""
    line = F.explode(F.split(F.col(col), r"\r\n|\r|\n"))
    return df.select(*keep, line.alias("__l")).select(*keep, X.strip_text("__l").alias("text")).where(
        F.col("text") != ""
    )
