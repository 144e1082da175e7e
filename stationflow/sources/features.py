"""Feature and serving tables, file fingerprints, file choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators.experiments import top1
from ..operators.series import (
    add_time_idx, drop_null_rows, inf_to_null, select_available, select_required,
)
from .raw import _exists, list_files
from .streams import read_digests


def read_features(
    spark: SparkSession, path: str | Sequence[str], features: Sequence[str] = tuple(S.FEATURE_COLUMNS),
    targets: Sequence[str] = tuple(S.FORECAST_TARGETS), keys: Sequence[str] = (S.KEY, S.TIME),
) -> DataFrame:
    """Strict read: all columns must exist; rows with a null are dropped."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not _exists(spark, p):
            raise FileNotFoundError(f"no Parquet data in {p}")
    df = spark.read.parquet(*paths)
    missing = [c for c in dict.fromkeys([*features, *targets]) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kept = list(dict.fromkeys([*[k for k in keys if k in df.columns], *features, *targets]))
    return drop_null_rows(select_required(df, kept))


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """``folder, files`` of the Parquet data below a folder; folders of partitions (``name=value``) belong to the one above."""
    folder = F.regexp_replace("path", "(/[^/=]+=[^/]*)*/[^/]+$", "").alias("folder")
    return list_files(spark, root, "*.parquet").groupBy(folder).agg(F.count(F.lit(1)).alias("files"))


def serving_path(spark: SparkSession, path: str, model_root: str | None = None) -> str:
    """What to serve from: the first ``serving_data`` below the model root; else ``path`` itself, if it is a file or
    holds data; else the first folder below it that does. Only one is taken, as positions would repeat otherwise."""
    if model_root and _exists(spark, model_root):
        found = datasets(spark, model_root).where(F.array_contains(F.split("folder", "/"), "serving_data"))
        first = found.agg(F.min("folder")).first()[0]
        if first:
            return first
    if _exists(spark, path):
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.getFileStatus(hadoop_path).isDirectory():
            return path
        own = fs.makeQualified(hadoop_path).toString()
        first = datasets(spark, path).agg(F.min(F.struct(F.col("folder") != own, "folder"))).first()[0]
        if first:
            return first.folder
    raise FileNotFoundError(f"no Parquet data in {path}" + (f", none in {model_root}" if model_root else ""))


def read_serving(
    spark: SparkSession, path: str, columns: Sequence[str] = tuple(S.FEATURE_COLUMNS),
    model_root: str | None = None, by: str = S.KEY, t: str = S.TIME,
) -> tuple[DataFrame, list[str]]:
    """Lenient read: (rows with group and time_idx, names that were not found)."""
    return prepare_serving(spark.read.parquet(serving_path(spark, path, model_root)), columns, by, t)


def prepare_serving(
    df: DataFrame, columns: Sequence[str] = tuple(S.FEATURE_COLUMNS), by: str = S.KEY, t: str = S.TIME,
) -> tuple[DataFrame, list[str]]:
    """Requested columns that exist, no infinities, no nulls, positions per station."""
    kept, missing = select_available(df, [by, t, *columns])
    return add_time_idx(drop_null_rows(inf_to_null(kept)), by, t), missing


def file_fingerprint(spark: SparkSession, path: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """``path, length, sha256`` of the files below a folder; a file streams through the hash, however large it is."""
    return read_digests(spark, path, suffixes)


def pick_serving_file(files: DataFrame, preferred: str | None, default: str = "salvador") -> DataFrame:
    """Largest file of the preferred station, else of the default one, else of all.

    ``files`` has ``path`` and ``length``; the first path wins ties.
    """
    parts = F.split("path", "/")
    level = F.when(F.array_contains(parts, default), 1).otherwise(2)
    if preferred:
        level = F.when(F.array_contains(parts, preferred), 0).otherwise(level)
    ranked = files.withColumn("level", level)
    return top1(ranked, [], [F.col("level"), -F.col("length"), F.col("path")], ["path", "length", "level"])
