"""Forecast log, pairing with actual values, error per horizon bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import numbers as N, times as D
from .windows import interval_join


def encode_forecast(points: Column | str) -> Column:
    """JSON text of an array of (timestamp, temp_ar_c), times in ISO form."""
    arr = F.col(points) if isinstance(points, str) else points
    iso = F.transform(
        arr,
        lambda p: F.struct(
            F.date_format(p["timestamp"], "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            p["temp_ar_c"].cast("double").alias("temp_ar_c"),
        ),
    )
    return F.to_json(iso)


def decode_forecast(json: Column | str) -> Column:
    """Array of forecast values; hour ``h`` is element ``h`` counted from 1."""
    col = F.col(json) if isinstance(json, str) else json
    return F.transform(F.from_json(col, S.POINTS_SCHEMA), lambda p: p["temp_ar_c"])


def slice_forecast(values: Column, start_h: Column, end_h: Column) -> Column:
    """Values of hours ``start_h`` to ``end_h``, cut at the end of the forecast."""
    first = F.greatest(start_h, F.lit(1))
    return F.slice(values, first, F.greatest(end_h - first + 1, F.lit(0)))


def pending(predictions: DataFrame, accuracy: DataFrame, now: Column) -> DataFrame:
    """Predictions whose horizon has passed and that were never evaluated."""
    due = predictions.where(D.hours_after(F.col("reference_date"), F.col("horizon")) < now)
    done = accuracy.select(F.col("prediction_id").alias("id")).distinct()
    return due.join(done, "id", "left_anti")


def actuals_for(
    predictions: DataFrame, series: DataFrame, target: str = "temp_ar_c", by: str = S.KEY,
    t: str = S.TIME,
) -> DataFrame:
    """Actual values per prediction and bucket: ``id, bucket, start_h, end_h, t, actual``."""
    asked = predictions.select(
        "id", by, "reference_date", F.inline(D.buckets_of("horizon"))
    ).select(
        "id", by, "bucket", "start_h", "end_h",
        D.hours_after(F.col("reference_date"), F.col("start_h")).alias("__from"),
        D.hours_after(F.col("reference_date"), F.col("end_h")).alias("__to"),
    )
    # a missing value takes no position
    values = series.select(by, t, F.col(target).cast("double").alias("actual")).where("actual IS NOT NULL AND NOT isnan(actual)")
    joined = interval_join(asked, values, "__from", "__to", by, t)
    return joined.select("id", by, "bucket", "start_h", "end_h", F.col(t).alias("t"), "actual")


def pair_errors(
    predictions: DataFrame, actuals: DataFrame, align: str = "position"
) -> DataFrame:
    """Pairs ``id, bucket, position, predicted, actual``.

    With ``align='position'`` the i-th actual of a bucket meets the i-th
    forecast value of that bucket. With ``'timestamp'`` they meet by hour.
    A bucket never holds more actuals than its hours, so the row number runs
    over a short group.
    """
    values = decode_forecast("forecast_json")
    if align == "position":
        w = Window.partitionBy("id", "bucket").orderBy("t", "actual")
        # by id alone: the window, the join and the error per bucket share this shuffle
        placed = actuals.repartition(F.col("id")).withColumn("position", F.row_number().over(w))
        joined = placed.join(predictions.select("id", values.alias("__values")), "id")
        hour = F.col("start_h") + F.col("position") - 1
        inside = hour <= F.col("end_h")
    elif align == "timestamp":
        joined = actuals.join(predictions.select("id", "reference_date", values.alias("__values")), "id")
        gap = F.unix_seconds(F.col("t").cast("timestamp")) - F.unix_seconds(
            F.col("reference_date").cast("timestamp")
        )
        joined = joined.where(gap % 3600 == 0)
        hour = (gap / 3600).cast("int")
        joined = joined.withColumn("position", hour - F.col("start_h") + 1)
        inside = F.lit(True)
    else:
        raise ValueError("align must be 'position' or 'timestamp'")
    pred = F.get("__values", (hour - 1).cast("int"))
    return joined.where(inside & (hour <= F.size("__values"))).select(
        "id", "bucket", F.col("position").cast("int").alias("position"),
        pred.alias("predicted"), "actual",
    )


def forecast_error(df: DataFrame, by: list[str], pred: str = "predicted", actual: str = "actual") -> DataFrame:
    return df.groupBy(*by).agg(*N.error_columns(F.col(pred), F.col(actual)))


def training_metrics(df: DataFrame, by: list[str], pred: str = "predicted", actual: str = "actual",
                     eps: float = 1e-6) -> DataFrame:
    return df.groupBy(*by).agg(*N.training_error_columns(F.col(pred), F.col(actual), eps))


def accuracy_by_bucket(
    predictions: DataFrame, series: DataFrame, accuracy: DataFrame, now: Column,
    align: str = "position", min_points: int = 1, target: str = "temp_ar_c",
    by: str = S.KEY, t: str = S.TIME,
) -> DataFrame:
    """Error per (prediction, bucket) of all predictions that are due.

    Buckets without actual values give no row. ``min_points`` holds back
    buckets that have too few of them yet.
    """
    due = pending(predictions, accuracy, now)
    pairs = pair_errors(due, actuals_for(due, series, target, by, t), align)
    errors = forecast_error(pairs, ["id", "bucket"])
    return errors.where(F.col("n_points") >= min_points).select(
        F.col("id").alias("prediction_id"), "bucket", "mae", "rmse", "mape_frac", "n_points"
    )


def upsert_accuracy(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Newest row per (prediction, bucket); a new row wins over an old one.

    One aggregation with map-side combine; nothing is sorted.
    """
    cols = [c for c in new.columns if c not in ("prediction_id", "bucket")]
    both = existing.select(*new.columns, F.lit(0).alias("__src")).unionByName(
        new.select("*", F.lit(1).alias("__src"))
    )
    rank = F.struct("evaluated_at", "__src", *[c for c in cols if c != "evaluated_at"])
    best = both.groupBy("prediction_id", "bucket").agg(F.max(rank).alias("__b"))
    return best.select("prediction_id", "bucket", *[F.col("__b")[c].alias(c) for c in cols])


def prediction_rows(forecasts: DataFrame, predicted_at: Column) -> DataFrame:
    """Log rows from forecasts with ``points``; an id is made where there is none."""
    made = F.col("id") if "id" in forecasts.columns else F.uuid()
    return forecasts.select(
        made.alias("id"),
        F.concat_ws("_", "model_type", F.col("horizon").cast("string")).alias("model_key"),
        "model_version", F.col("group_id"), "reference_date", "horizon",
        predicted_at.alias("predicted_at"),
        encode_forecast("points").alias("forecast_json"),
    )
