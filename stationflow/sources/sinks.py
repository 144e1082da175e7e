"""Writers. All write in parallel from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import numbers as N
from ..operators.accuracy import prediction_rows, upsert_accuracy
from ..operators.profiles import replace_docs
from ..operators.series import time_chunk
from . import snapshots
from .raw import _exists

FILE_HOURS = 24 * 365


def _spread(df: DataFrame, by: str, t: str | None) -> DataFrame:
    """Rows of a station and year in one task, sorted by time for row-group pruning."""
    if t is None or t not in df.columns:
        return df
    return (
        df.repartition(F.col(by), time_chunk(t, FILE_HOURS)).sortWithinPartitions(by, t)
    )


def write_partitions(df: DataFrame, root: str, by: str = S.KEY, t: str | None = S.TIME, fmt: str = "parquet") -> None:
    """Replace the stations present in ``df``, leave the others."""
    out = _spread(df, by, t).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    if fmt == "csv":
        out.option("header", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(root)
    else:
        out.parquet(root)


def write_staging(df: DataFrame, root: str, by: str = S.KEY, t: str = S.TIME, fmt: str = "parquet") -> None:
    """Replace the stations in ``df``; ``fmt="snapshot"`` makes a new version of the table, the old one stays readable."""
    if fmt == "snapshot":
        snapshots.replace(_spread(df, by, t), root, [by])
    else:
        write_partitions(df, root, by, t, fmt)


def write_features(df: DataFrame, root: str, by: str = S.KEY, t: str = S.TIME) -> DataFrame:
    """Write features; returns ``municipio, output_path, rows_processed, columns`` from what was written."""
    written = df.select(by).distinct()
    write_partitions(df, root, by, t)
    spark = df.sparkSession
    stored = spark.read.parquet(root)
    names = ",".join(c for c in df.columns if c not in (by, t))
    return stored.groupBy(by).agg(F.count(F.lit(1)).alias("rows_processed")).join(
        written, by, "left_semi"
    ).select(
        by, F.concat(F.lit(f"{root.rstrip('/')}/{by}="), F.col(by)).alias("output_path"),
        "rows_processed", F.lit(names).alias("columns"),
    )


def profile_documents(profiles: DataFrame, stats: Sequence[str], by: str = S.KEY) -> DataFrame:
    """Nested JSON per station: month -> column -> statistics. At most 12 months of few columns."""
    inner = profiles.groupBy(by, "month").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", F.struct(*stats).alias("v"))))).alias("__c")
    )
    months = F.array_sort(
        F.collect_list(F.struct("month", "__c")),
        lambda a, b: F.when(a["month"] < b["month"], -1).when(a["month"] > b["month"], 1).otherwise(0),
    )
    named = F.transform(months, lambda m: F.struct(m["month"].cast("string"), m["__c"]))
    return inner.groupBy(by).agg(F.to_json(F.map_from_entries(named)).alias("value"))


def write_profiles(profiles: DataFrame, extremes: DataFrame, meta: DataFrame, root: str, by: str = S.KEY) -> None:
    """``monthly_profiles``, ``seasonal_extremes`` and ``metadata`` as JSON text per station."""
    parts = {
        "monthly_profiles": profile_documents(profiles, ["mean", "std", "min", "max"], by),
        "seasonal_extremes": profile_documents(extremes, ["p5", "p95"], by),
        "metadata": meta.select(by, F.to_json(F.struct(*meta.columns)).alias("value")),
    }
    for name, df in parts.items():
        (
            df.select(by, "value").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(by).text(f"{root}/{name}")
        )


def append_predictions(forecasts: DataFrame, path: str, predicted_at: Column) -> None:
    prediction_rows(forecasts, predicted_at).write.mode("append").parquet(path)


def save_accuracy(new: DataFrame, path: str, version: int, spark: SparkSession) -> str:
    """Merge new accuracy rows into the table; returns the folder of the merged version.

    Each version is a folder of its own, so a reader or a task that is run
    again never sees a half-replaced table.
    """
    current, target = f"{path}/v={version}", f"{path}/v={version + 1}"
    if _exists(spark, current):
        merged = upsert_accuracy(spark.read.parquet(current), new)
    else:
        merged = new
    merged.write.mode("overwrite").parquet(target)
    return target


def write_station_docs(new: DataFrame, existing: DataFrame | None, path: str, by: str = S.KEY) -> None:
    """Documents of the stations in ``new`` replaced; written to a new folder."""
    docs = new if existing is None else replace_docs(existing, new, by)
    docs.write.mode("overwrite").parquet(path)


def write_scores(scores: DataFrame, path: str, stamp: str) -> None:
    """JSON with time, count and scores, and CSV with four decimals. One row per metric."""
    payload = scores.agg(
        F.max("n_examples").alias("n_examples"),
        F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("scores"),
    ).select(F.to_json(F.struct(F.lit(stamp).alias("timestamp"), "n_examples", "scores")).alias("value"))
    payload.write.mode("overwrite").text(f"{path}/results_{stamp}_json")
    table = scores.select("metric", N.fixed_text("score", 4).alias("score"))
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/results_{stamp}_csv")


def write_raw_station_files(df: DataFrame, root: str, by: str = S.KEY, t: str = S.TIME,
                            names: dict[str, str] | None = None, encoding: str = S.RAW_ENCODING) -> None:
    """Rows in the raw station layout, one file per station and year.

    Eight lines of metadata, a header, semicolons, decimal commas, a closing
    semicolon. The lines of a file come from one station and year and stream
    through the writer in order.
    """
    names = names or {v: k for k, v in S.RENAME_MAP.items()}
    cols = [c for c in df.columns if c in names and c not in (by, t)]
    header = ";".join([S.RAW_DATE, S.RAW_HOUR, *[names[c] for c in cols]]) + ";"
    top = F.array(*[F.lit(x) for x in (*[f"META {i}:;x" for i in range(8)], header)])
    cells = [
        F.date_format(t, "yyyy/MM/dd"), F.date_format(t, "HHmm' UTC'"),
        *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")), F.lit("")) for c in cols],
    ]
    rows = df.select(
        by, F.year(t).alias("ano"), F.lit(1 << 30).alias("__n"), F.col(t).alias("__t"),
        F.concat(F.concat_ws(";", *cells), F.lit(";")).alias("line"),
    )
    heads = df.select(by, F.year(t).alias("ano")).distinct().select(by, "ano", F.posexplode(top).alias("__n", "line"))
    lines = rows.unionByName(heads, allowMissingColumns=True).repartition(by, "ano").sortWithinPartitions(by, "ano", "__n", "__t")
    # The text writer passes bytes through unchanged.
    lines.select(by, "ano", F.encode("line", encoding).cast("string").alias("value")).write.partitionBy(by, "ano").mode(
        "overwrite"
    ).option("lineSep", "\n").text(root)
