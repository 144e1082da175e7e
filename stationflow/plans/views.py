"""Derived views, each written once for Spark and once as a SQL common table expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import times as D
from ..operators import forecast
from ..operators.accuracy import encode_forecast
from ..operators.series import feature_table

Query = Callable[[SparkSession, str], DataFrame]

NOW = "2024-01-25 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


# Added before rounding, so that decimal halves (common: the data are cents) do
# not lie on a rounding border, where the order of additions would decide.
SHIFT = 1.37e-8


def rr(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(SHIFT), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rr(c, digits) for c in cols})


def sr(*exprs: str, digits: int = 6) -> str:
    """The same in SQL: each ``expr`` or ``expr AS name`` rounded."""
    out = []
    for e in exprs:
        expr, _, name = e.rpartition(" AS ")
        expr, name = (expr, name) if expr else (name, name)
        out.append(f"round({expr} + 1.37e-8, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


# --- WX: hourly weather of three stations ---------------------------------------

WX_MEASURES = [
    "temp_ar_c", "temp_max_c", "temp_min_c", "umidade_rel_ar_percent", "pressao_atm_estacao_mb",
    "precipitacao_total_mm",
]


def wx(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    seen = F.col("event_type").isin("click", "view")
    n = F.count(F.lit(1)).cast("double")
    total = F.sum(cents).cast("double")
    rain = F.sum(F.when(F.col("event_type") == "purchase", cents)).cast("double")
    return e.groupBy(
        F.concat(F.lit("st_"), (F.col("user_id") % 3).cast("string")).alias("municipio"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("data_hora"),
    ).agg(
        (total / (n * 100)).alias("temp_ar_c"),
        F.max("value").alias("temp_max_c"),
        F.min("value").alias("temp_min_c"),
        F.try_divide(F.sum(F.when(seen, cents)).cast("double"), F.count_if(seen) * 100.0).alias(
            "umidade_rel_ar_percent"
        ),
        (total / (n * 1000) + 1000).alias("pressao_atm_estacao_mb"),
        (F.coalesce(rain, F.lit(0.0)) / 100).alias("precipitacao_total_mm"),
    )


WX = """ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events),
wx AS (SELECT 'st_' || CAST(user_id % 3 AS VARCHAR) AS municipio, date_trunc('hour', ts) AS data_hora,
  CAST(sum(c) AS DOUBLE) / (count(*) * 100) AS temp_ar_c,
  max(value) AS temp_max_c, min(value) AS temp_min_c,
  CAST(sum(c) FILTER (WHERE event_type IN ('click', 'view')) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE event_type IN ('click', 'view')) * 100, 0) AS umidade_rel_ar_percent,
  CAST(sum(c) AS DOUBLE) / (count(*) * 1000) + 1000 AS pressao_atm_estacao_mb,
  coalesce(CAST(sum(c) FILTER (WHERE event_type = 'purchase') AS DOUBLE), 0) / 100 AS precipitacao_total_mm
  FROM ev GROUP BY 1, 2)"""


# --- WH: multi-year series of five stations --------------------------------------


def wh(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, temp = F.col("o_orderkey"), F.col("o_totalprice") / 10000.0
    return o.select(
        F.concat(F.lit("st_"), (F.col("o_custkey") % 5).cast("string")).alias("municipio"),
        D.hours_after(F.col("o_orderdate"), key % 24).alias("data_hora"),
        temp.alias("temp_ar_c"),
        (temp + key % 7).alias("temp_max_c"),
        (temp - key % 5).alias("temp_min_c"),
        F.when(key % 4 != 0, (F.col("o_custkey") % 50) / 10.0).alias("precipitacao_total_mm"),
        key.alias("seq"),
    )


WH = """wh AS (SELECT 'st_' || CAST(o_custkey % 5 AS VARCHAR) AS municipio,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS data_hora,
  o_totalprice / 10000.0 AS temp_ar_c,
  o_totalprice / 10000.0 + o_orderkey % 7 AS temp_max_c,
  o_totalprice / 10000.0 - o_orderkey % 5 AS temp_min_c,
  CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 50) / 10.0 END AS precipitacao_total_mm,
  o_orderkey AS seq FROM orders)"""


# --- feature table of WX ----------------------------------------------------------


def features(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table(wx(spark, sf))


FEAT_ALL = WX + """,
feat_all AS (SELECT municipio, data_hora, temp_ar_c, umidade_rel_ar_percent, pressao_atm_estacao_mb,
  precipitacao_total_mm,
  sin(2 * pi() * hour(data_hora) / 24) AS hora_sin, cos(2 * pi() * hour(data_hora) / 24) AS hora_cos,
  lag(temp_ar_c, 1) OVER w AS temp_lag_1h, lag(temp_ar_c, 24) OVER w AS temp_lag_24h,
  avg(temp_ar_c) OVER (w ROWS 5 PRECEDING) AS temp_ma_6h,
  avg(temp_ar_c) OVER (w ROWS 11 PRECEDING) AS temp_ma_12h,
  avg(pressao_atm_estacao_mb) OVER (w ROWS 5 PRECEDING) AS pressao_ma_6h,
  avg(pressao_atm_estacao_mb) OVER (w ROWS 11 PRECEDING) AS pressao_ma_12h,
  pressao_atm_estacao_mb - lag(pressao_atm_estacao_mb, 1) OVER w AS pressao_tendencia_1h,
  temp_ar_c - lag(temp_ar_c, 1) OVER w AS temp_tendencia_1h
  FROM wx WINDOW w AS (PARTITION BY municipio ORDER BY data_hora))"""
FEAT = FEAT_ALL + """,
feat AS (SELECT * FROM feat_all WHERE umidade_rel_ar_percent IS NOT NULL AND temp_lag_24h IS NOT NULL
  AND temp_lag_1h IS NOT NULL)"""

# Position and split of the WX rows themselves (no nulls in the columns used).
SPLIT = WX + """,
idx AS (SELECT *, row_number() OVER (PARTITION BY municipio ORDER BY data_hora) - 1 AS time_idx,
  count(*) OVER (PARTITION BY municipio) AS total FROM wx),
sp AS (SELECT *, CASE WHEN time_idx < floor(total * 0.8::DOUBLE) THEN 'train'
  WHEN time_idx < floor(total * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM idx),
spx AS (SELECT *, row_number() OVER (PARTITION BY municipio, split ORDER BY data_hora) - 1 AS split_idx FROM sp)"""


# --- PX: forecast requests and their log ------------------------------------------


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per station and day."""
    days = wx_days(spark, sf)
    horizon = F.when(F.col("day_n") % 3 == 0, 72).when(F.col("day_n") % 3 == 1, 168).otherwise(336)
    return days.select(
        F.concat_ws("_", "municipio", F.col("day_n").cast("string")).alias("request_id"),
        "municipio",
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_n").cast("int")).cast("timestamp").alias("reference_date"),
        horizon.alias("horizon"),
        F.lit("tft").alias("model_type"),
    )


def wx_days(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.select(
        F.concat(F.lit("st_"), (F.col("user_id") % 3).cast("string")).alias("municipio"),
        day.cast("bigint").alias("day_n"),
    ).distinct()


RQ = """rq AS (SELECT DISTINCT 'st_' || CAST(user_id % 3 AS VARCHAR) || '_' || CAST(day_n AS VARCHAR) AS request_id,
  'st_' || CAST(user_id % 3 AS VARCHAR) AS municipio,
  TIMESTAMP '2024-01-01' + to_days(CAST(day_n AS INTEGER)) AS reference_date,
  CASE day_n % 3 WHEN 0 THEN 72 WHEN 1 THEN 168 ELSE 336 END AS horizon, 'tft' AS model_type
  FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_n FROM events))"""


def prediction_points(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with their forecast ``50 + hour % 24`` as an array of points."""
    hours = F.sequence(F.lit(1), F.col("horizon"))
    return requests(spark, sf).select(
        F.col("request_id").alias("id"), "municipio", F.col("municipio").alias("group_id"),
        "model_type", F.lit("1").alias("model_version"), "reference_date", "horizon",
        F.transform(
            hours,
            lambda h: F.struct(
                D.hours_after(F.col("reference_date"), h).alias("timestamp"),
                (F.lit(50) + h % 24).cast("double").alias("temp_ar_c"),
            ),
        ).alias("points"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return prediction_points(spark, sf).select(
        "id", "municipio", "reference_date", "horizon", encode_forecast("points").alias("forecast_json")
    )


PAIRS = WX + ",\n" + RQ + """,
due AS (SELECT * FROM rq WHERE reference_date + to_hours(horizon) < TIMESTAMP '""" + NOW + """'
  AND request_id NOT IN (SELECT request_id FROM done)),
bk AS (SELECT * FROM (VALUES ('near', 1, 24), ('mid', 25, 72), ('far', 73, 9999)) AS b(bucket, s, e)),
act AS (SELECT d.request_id AS id, bk.bucket, bk.s, least(bk.e, d.horizon) AS e, w.data_hora, w.temp_ar_c AS actual,
  d.reference_date, d.horizon,
  row_number() OVER (PARTITION BY d.request_id, bk.bucket ORDER BY w.data_hora) AS position
  FROM due d JOIN bk ON bk.s <= d.horizon
  JOIN wx w ON w.municipio = d.municipio AND w.data_hora >= d.reference_date + to_hours(bk.s)
   AND w.data_hora <= d.reference_date + to_hours(least(bk.e, d.horizon))),
pr AS (SELECT *, CAST(50 + (s + position - 1) % 24 AS DOUBLE) AS predicted FROM act WHERE s + position - 1 <= e)"""
# Predictions of every fifth day count as evaluated before.
DONE = "done AS (SELECT request_id FROM rq WHERE CAST(split_part(request_id, '_', 3) AS INTEGER) % 5 = 0)"
PAIRS_NONE = "WITH " + PAIRS.replace(
    "due AS", "done AS (SELECT '' AS request_id WHERE false),\ndue AS", 1
)
PAIRS_DONE = "WITH " + PAIRS.replace("due AS", DONE + ",\ndue AS", 1)


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy rows of every fifth day."""
    day = F.element_at(F.split("request_id", "_"), -1).cast("int")
    return requests(spark, sf).where(day % 5 == 0).select(F.col("request_id").alias("prediction_id"))


# --- RX: experiment runs ------------------------------------------------------------


def runs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_suppkey", "l_linenumber").agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / (F.count(F.lit(1)) * 100.0)).alias("__m")
    ).select(
        F.concat_ws("_", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.col("l_linenumber").cast("string").alias("experiment"),
        "l_suppkey",
        F.when(F.col("l_suppkey") % 10 == 0, "FAILED").otherwise("FINISHED").alias("status"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("__m")).alias("mape"),
    )


RX = """rx AS (SELECT CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS run_id,
  CAST(l_linenumber AS VARCHAR) AS experiment, l_suppkey,
  CASE WHEN l_suppkey % 10 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
  CASE WHEN l_suppkey % 7 <> 0 THEN CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) END AS mape
  FROM lineitem GROUP BY l_suppkey, l_linenumber)"""


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a run in (order, part) order are its epochs, the tax its loss."""
    from ..operators.series import running

    li = table(spark, sf, "lineitem").select(
        F.concat_ws("_", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"),
        "l_orderkey", "l_partkey", "l_extendedprice", F.col("l_tax").alias("val_loss"),
    )
    chunk = F.floor(F.col("l_orderkey") / F.lit(1 << 16)).cast("bigint")
    return running(
        li, ["run_id"], ["l_orderkey", "l_partkey", "l_extendedprice"], chunk, {"epoch": ("count", F.lit(1))}
    ).select("run_id", "epoch", "val_loss")


EPOCHS = """ep AS (SELECT CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS run_id,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS epoch,
  l_tax AS val_loss FROM lineitem)"""


def catalogue(spark: SparkSession) -> DataFrame:
    return forecast.model_catalogue(spark)


CATALOGUE = """cat AS (SELECT * FROM (VALUES ('tft_72', 'tft', 72, 168), ('tft_168', 'tft', 168, 336),
  ('tft_336', 'tft', 336, 504)) AS c(model_key, model_type, horizon, sequence_length))"""
