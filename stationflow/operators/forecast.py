"""Batch forecasts: model choice, context rows, scoring, points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schema as S
from ..functions import numbers as N, times as D
from ..session import shared_dir
from . import gram
from .joins import spread_join
from .scaling import inverse_scaler
from .windows import last_n_before, last_n_stats


def model_catalogue(spark: SparkSession) -> DataFrame:
    """Serving models; a fixed handful of rows."""
    rows = spark.createDataFrame(
        S.SERVING_MODELS,
        "model_key string, experiment_name string, model_type string, horizon int, "
        "sequence_length int, registry_name string",
    )
    return rows


def lookup(df: DataFrame, config: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a configuration table. Spark knows its size and broadcasts it when small."""
    return df.join(config, list(on), "left")


def resolve_models(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests with their model and a status for unknown ones."""
    out = lookup(requests, catalogue, ["model_type", "horizon"])
    return out.withColumn(
        "status", F.when(F.col("model_key").isNull(), "model_not_found").otherwise("ok")
    )


Scorer = Callable[[DataFrame], DataFrame]


def seasonal_naive(rows: DataFrame, season: int = 24, target: str = "temp_ar_c") -> DataFrame:
    """Each hour repeats the value one season earlier.

    Row ``j`` of the last season serves the hours j+1, j+1+season, ...
    """
    j = F.col("position") - (F.col("sequence_length") - season)
    hours = F.sequence((j + 1).cast("int"), F.col("horizon").cast("int"), F.lit(season))
    return rows.where((j >= 0) & (j < F.col("horizon"))).select(
        "request_id", F.explode(hours).alias("hour_ahead"),
        F.col(target).cast("double").alias("value"),
    )


def pandas_scorer(fn: Callable, cols: Sequence[str]) -> Scorer:
    """Scorer from ``fn(context, horizon) -> values``; a group is one context window."""
    import pandas as pd

    def score(pdf):
        ordered = pdf.sort_values("position")
        horizon = int(ordered["horizon"].iloc[0])
        values = list(fn(ordered[list(cols)], horizon))[:horizon]
        return pd.DataFrame(
            {
                "request_id": ordered["request_id"].iloc[0],
                "hour_ahead": range(1, len(values) + 1),
                "value": [float(v) for v in values],
            }
        )

    def run(rows: DataFrame) -> DataFrame:
        keep = rows.select("request_id", "position", "horizon", *cols)
        return keep.groupBy("request_id").applyInPandas(
            score, "request_id string, hour_ahead int, value double"
        )

    return run


def batch_forecast(
    requests: DataFrame,
    series: DataFrame,
    catalogue: DataFrame,
    scorer: Scorer = seasonal_naive,
    by: str = S.KEY,
    t: str = S.TIME,
) -> tuple[DataFrame, DataFrame]:
    """Status per request, and the forecast points of those that can be served.

    A request for an unknown model is ``model_not_found``, one with too few
    rows before its instant ``insufficient_rows``.
    """
    resolved = resolve_models(requests, catalogue)
    known = resolved.where(F.col("status") == "ok").drop("status")
    served, rows = last_n_before(known, series, F.col("sequence_length"), by=by, t=t)
    status = served.select("request_id", "status").unionByName(
        resolved.where(F.col("status") != "ok").select("request_id", "status")
    )
    info = known.select("request_id", "reference_date", "horizon", "sequence_length", "model_key")
    scored = scorer(rows.join(info.select("request_id", "horizon", "sequence_length"), "request_id"))
    points = scored.join(info.select("request_id", "reference_date", "model_key"), "request_id").select(
        "request_id", "model_key", "hour_ahead",
        D.hours_after(F.col("reference_date"), F.col("hour_ahead")).alias("timestamp"),
        F.col("value").alias("temp_ar_c"),
    )
    return status, points


def expand_points(df: DataFrame, values: str = "values") -> DataFrame:
    """Value i of a forecast at reference + (i + 1) hours, the first ``horizon`` values."""
    rest = [c for c in df.columns if c != values]
    first = F.slice(F.col(values), F.lit(1), F.greatest(F.col("horizon"), F.lit(0)))
    return df.select(*rest, F.posexplode(first).alias("__i", "temp_ar_c")).select(
        *rest, (F.col("__i") + 1).alias("hour_ahead"),
        D.hours_after(F.col("reference_date"), F.col("__i") + 1).alias("timestamp"), "temp_ar_c",
    )


def points_array(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points of one forecast as an ordered array; its length is the horizon."""
    return points.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "temp_ar_c"))).alias("points")
    )


def period_summary(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per forecast, date and part of the day: min, max, mean, peak hour (first on ties)."""
    tagged = points.select(
        *by, F.to_date("timestamp").alias("target_date"),
        D.period_of_day("timestamp").alias("period"), F.hour("timestamp").alias("hour"),
        "temp_ar_c",
    )
    peak = F.max(F.struct(F.col("temp_ar_c"), (-F.col("hour")).alias("h")))
    return tagged.groupBy(*by, "target_date", "period").agg(
        F.min("temp_ar_c").alias("temperature_min_c"),
        F.max("temp_ar_c").alias("temperature_max_c"),
        F.avg("temp_ar_c").alias("temperature_avg_c"),
        peak.alias("__peak"),
        F.count(F.lit(1)).alias("n_hours"),
    ).select(
        *by, "target_date", "period", D.period_label("period").alias("period_label"),
        "temperature_min_c", "temperature_max_c", "temperature_avg_c",
        F.format_string("%02dh", -F.col("__peak.h")).alias("peak_hour"), "n_hours",
    )


def period_report(points: DataFrame, by: Sequence[str], date, period: str) -> DataFrame:
    """One forecast period with its hourly list; a forecast without it says so."""
    chosen = points.where(
        (F.to_date("timestamp") == F.lit(date).cast("date")) & (D.period_of_day("timestamp") == period)
    )
    # A period has at most 12 hours, so the list is short.
    hourly = chosen.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.hour("timestamp").alias("hour"), "temp_ar_c"))),
            lambda p: F.struct(
                F.format_string("%02dh", p["hour"]).alias("hour"),
                N.round_even(p["temp_ar_c"], 1).alias("temp_c"),
            ),
        ).alias("hourly")
    )
    keys = points.select(*by).distinct()
    stats = period_summary(chosen, by).select(
        *by, *[N.round_even(c, 1).alias(c) for c in
               ("temperature_min_c", "temperature_max_c", "temperature_avg_c")], "peak_hour",
    )
    out = keys.join(stats, list(by), "left").join(hourly, list(by), "left")
    return out.withColumn("error", F.when(F.col("hourly").isNull(), "sem_dados"))


def window_stats(
    requests: DataFrame, series: DataFrame, cols: Sequence[str], n: int = 48,
    by: str = S.KEY, t: str = S.TIME,
) -> DataFrame:
    """min, max, mean per column over the last ``n`` rows before each request."""
    fields = {c: F.col(f"__row.{c}") for c in cols}
    figures = [F.struct(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")).alias(c) for c, v in fields.items()]
    wide = last_n_stats(requests, series, n, [F.count("__row").alias("window_rows"), *figures], by=by, t=t)
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])
    found = F.when(F.col("window_rows") > 0, lines)  # a request without its rows keeps one line
    return wide.select(
        "request_id", "status", "rows_until", F.nullif("window_rows", F.lit(0)).alias("window_rows"), F.inline_outer(found)
    ).select("request_id", "status", "rows_until", "window_rows", "column", "s.min", "s.max", "s.mean")


def window_sample(
    requests: DataFrame, series: DataFrame, cols: Sequence[str], n: int = 48, max_rows: int = 24,
    by: str = S.KEY, t: str = S.TIME, digits: int | None = 4,
) -> DataFrame:
    """The last ``max_rows`` rows of each request's window."""
    _, rows = last_n_before(requests, series, n, by=by, t=t)
    values = [N.round_even(c, digits).alias(c) if digits is not None else F.col(c) for c in cols]
    return rows.where(F.col("position") >= n - max_rows).select("request_id", t, *values)


def evaluate_step(
    samples: DataFrame, step: int, target: int, targets: Sequence[str], stats: DataFrame,
    max_points: int = 0, by: str = S.KEY,
) -> DataFrame:
    """Predicted and actual of one target at one forecast step, in original units.

    ``samples`` has ``start_idx``, ``y`` and ``y_pred``, both (horizon, targets).
    """
    if not 0 <= target < len(targets):
        raise IndexError(f"target {target} out of range")
    if step < 0:
        raise IndexError(f"step {step} out of range")

    def pick(col: str):
        return F.get(F.get(F.col(col), F.lit(step)), F.lit(target)).cast("double")

    same = (F.size("y") == F.size("y_pred")) & (F.size("y") > step)
    checked = F.when(same, pick("y")).otherwise(
        F.raise_error(F.lit("shapes of prediction and actual differ")).cast("double")
    )
    flat = samples.select(by, "start_idx", checked.alias("actual"), pick("y_pred").alias("predicted"))
    name = targets[target]
    real = inverse_scaler(flat, stats, {"actual": name, "predicted": name}, by)
    if max_points <= 0:
        return real
    return stride_rows(real, max_points, by, "start_idx")


def stride_rows(df: DataFrame, max_points: int, by: str, pos: str) -> DataFrame:
    """Every k-th row where ``pos`` already counts the rows of a group from 0."""
    ends = df.groupBy(by).agg((F.max(pos) + 1).alias("__n"))
    stride = F.greatest(F.ceil(F.col("__n") / F.lit(max_points)), F.lit(1))
    return spread_join(df, ends, [by], [pos]).where(F.col(pos) % stride == 0).drop("__n")


def fit_per_station(
    split_df: DataFrame,
    features: Sequence[str],
    target: str = "temp_ar_c",
    horizon: int = 1,
    penalties: Sequence[float] = (0.0, 1.0, 10.0),
    by: str = S.KEY,
) -> DataFrame:
    """A ridge model per (station, penalty), scored on validation rows.

    The rows are written once and meet their targets from there. The normal
    equations are sums (``gram``), so Spark adds them up in partial
    aggregates and only one small matrix per station is solved in a task.
    Returns metrics with ``is_best`` for the lowest validation loss.
    """
    names = list(features)
    path = shared_dir(split_df.sparkSession, "split")
    small = split_df.select(by, "split", "split_idx", *dict.fromkeys([*names, target]))
    small.write.parquet(path)
    small = split_df.sparkSession.read.schema(small.schema).parquet(path).where("split IN ('train', 'val')")
    ahead = small.select(by, "split", (F.col("split_idx") - horizon).alias("split_idx"), F.col(target).alias("__y"))
    pairs = small.select(by, "split", "split_idx", *names).join(ahead, [by, "split", "split_idx"])
    sums = gram.gram_sums(pairs.where("split = 'train'"), [by], names, "__y")
    models = gram.solved(sums, len(names), penalties).select(by, "penalty", "weights")
    x = [F.lit(1.0)] + [F.col(c).cast("double") for c in names]
    val = pairs.where(F.col("split") == "val").select(by, F.array(*x).alias("__x"), "__y")
    scored = spread_join(val, models, [by], ["__y", "__x"]).withColumn("__p", N.dot("__x", "weights"))
    diff = F.col("__p") - F.col("__y")
    metrics = scored.groupBy(by, "penalty").agg(
        F.avg(diff * diff).alias("val_loss"),
        *N.training_error_columns(F.col("__p"), F.col("__y").cast("double")),
    )
    best = Window.partitionBy(by).orderBy("val_loss", "penalty")
    return metrics.withColumn("is_best", F.row_number().over(best) == 1)
