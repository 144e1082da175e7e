"""Queries over forecasts, their errors, experiment tables and service metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import numbers as N, table_functions as T, text as X, times as D
from ..operators import accuracy as A, experiments as R, forecast as C, gram as G, series as Q, service as M, windows as W
from ..session import shared_dir
from . import views as V
from .registry import query
from .views import (
    CATALOGUE, EPOCHS, NOW, PAIRS_DONE, PAIRS_NONE, RQ, RX, SPLIT, WX, now, rounded, rr, sr, table, wx,
)

# --- requests and forecasts -----------------------------------------------------------


@query(f"""WITH {RQ}, {CATALOGUE} SELECT request_id, model_key, CAST(sequence_length AS DOUBLE) AS sequence_length,
CASE WHEN model_key IS NULL THEN 'model_not_found' ELSE 'ok' END AS status FROM (
 SELECT request_id, horizon + CASE WHEN CAST(split_part(request_id, '_', 3) AS INTEGER) % 4 = 0 THEN 1 ELSE 0 END AS horizon,
 model_type FROM rq) LEFT JOIN cat USING (model_type, horizon)""")
def model_lookup(spark, sf):
    day = F.element_at(F.split("request_id", "_"), -1).cast("int")
    asked = V.requests(spark, sf).withColumn("horizon", F.col("horizon") + F.when(day % 4 == 0, 1).otherwise(0))
    out = C.resolve_models(asked, V.catalogue(spark))
    return out.select("request_id", "model_key", F.col("sequence_length").cast("double").alias("sequence_length"), "status")


FC = f"""{WX}, {RQ}, {CATALOGUE}, k AS (SELECT rq.*, cat.model_key, cat.sequence_length FROM rq JOIN cat USING (model_type, horizon)),
ctx AS (SELECT k.request_id, k.horizon, k.reference_date, k.model_key, k.sequence_length, w.temp_ar_c,
 row_number() OVER (PARTITION BY k.request_id ORDER BY w.data_hora DESC) AS back,
 count(*) OVER (PARTITION BY k.request_id) AS available
 FROM k JOIN wx w ON w.municipio = k.municipio AND w.data_hora <= k.reference_date),
pts AS (SELECT request_id, model_key, reference_date, temp_ar_c,
 unnest(generate_series(25 - back, horizon, 24)) AS hour_ahead FROM ctx WHERE available >= sequence_length AND back <= 24)"""


@query(f"""WITH {FC} SELECT request_id, model_key, hour_ahead, reference_date + to_hours(hour_ahead) AS timestamp,
{sr('temp_ar_c')} FROM pts""")
def batch_forecast(spark, sf):
    _, points = C.batch_forecast(V.requests(spark, sf), wx(spark, sf), V.catalogue(spark))
    return rounded(points, "temp_ar_c")


@query(f"""WITH {FC} SELECT k.request_id, CASE WHEN coalesce(max(ctx.available), 0) >= max(k.sequence_length) THEN 'ok'
ELSE 'insufficient_rows' END AS status FROM k LEFT JOIN ctx USING (request_id) GROUP BY 1""")
def forecast_status(spark, sf):
    status, _ = C.batch_forecast(V.requests(spark, sf), wx(spark, sf), V.catalogue(spark))
    return status


@query(f"""WITH {FC}, c AS (SELECT request_id, model_key, horizon, reference_date, avg(temp_ar_c) AS level FROM ctx
 WHERE available >= sequence_length AND back <= sequence_length GROUP BY ALL)
SELECT request_id, model_key, unnest(generate_series(1, horizon)) AS hour_ahead,
reference_date + to_hours(unnest(generate_series(1, horizon))) AS timestamp, {sr('level AS temp_ar_c')} FROM c""")
def custom_scorer(spark, sf):
    def level(context, horizon):
        return [context["temp_ar_c"].mean()] * horizon

    scorer = C.pandas_scorer(level, ["temp_ar_c"])
    _, points = C.batch_forecast(V.requests(spark, sf), wx(spark, sf), V.catalogue(spark), scorer)
    return rounded(points, "temp_ar_c")


def _contexts(spark, sf):
    """Rows before each request that can be served, with its horizon."""
    asked = C.resolve_models(V.requests(spark, sf), V.catalogue(spark)).where("status = 'ok'").drop("status")
    _, rows = W.last_n_before(asked, wx(spark, sf), F.col("sequence_length"))
    at = F.col("reference_date").cast("timestamp_ntz").alias("reference_date")
    return rows.join(asked.select("request_id", at, "horizon"), "request_id")


@query(f"""WITH {FC}, d AS (SELECT request_id, CAST(reference_date + to_hours(hour_ahead) AS DATE) AS target_date,
 hour(reference_date + to_hours(hour_ahead)) AS hr, temp_ar_c AS v FROM pts),
p AS (SELECT *, CASE WHEN hr < 7 THEN 'madrugada' WHEN hr < 12 THEN 'manha' WHEN hr < 17 THEN 'tarde' ELSE 'noite' END AS period FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY request_id, target_date, period ORDER BY v DESC, hr) AS r FROM p)
SELECT request_id, strftime(target_date, '%Y-%m-%d') AS target_date, period, {sr('min(v) AS temperature_min_c',
 'max(v) AS temperature_max_c', 'avg(v) AS temperature_avg_c')}, printf('%02dh', max(hr) FILTER (WHERE r = 1)) AS peak_hour,
count(*) AS n_hours FROM m GROUP BY ALL""")
def sql_period_stats(spark, sf):
    """Two table functions in one SQL text: forecasts of the contexts, summed up by part of the day."""
    T.register(spark)
    out = spark.sql(
        """WITH points AS (
          SELECT request_id, reference_date + make_dt_interval(0, hour_ahead) AS timestamp, value AS temp_ar_c
          FROM season_forecast(TABLE({contexts}), season => 24))
        SELECT * FROM period_stats(TABLE(points))""",
        contexts=_contexts(spark, sf),
    )
    out = out.withColumn("target_date", F.col("target_date").cast("string"))
    return rounded(out, "temperature_min_c", "temperature_max_c", "temperature_avg_c")


@query(f"""WITH {RQ}, {WX}, {CATALOGUE}, c AS (SELECT rq.request_id, cat.sequence_length AS n, w.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY w.data_hora DESC) AS back,
 count(*) OVER (PARTITION BY rq.request_id) AS available FROM rq JOIN cat USING (model_type, horizon) JOIN wx w ON w.municipio = rq.municipio AND w.data_hora <= rq.reference_date),
v AS (SELECT request_id, 'temp_ar_c' AS "column", temp_ar_c AS x FROM c WHERE available >= n AND back <= n
 UNION ALL SELECT request_id, 'umidade_rel_ar_percent', umidade_rel_ar_percent FROM c WHERE available >= n AND back <= n)
SELECT request_id, "column", count(*) AS window_rows, {sr('min(x) AS min', 'max(x) AS max', 'avg(x) AS mean')} FROM v GROUP BY 1, 2""")
def sql_window_stats(spark, sf):
    T.register(spark)
    out = spark.sql(
        "SELECT * FROM window_stats(TABLE({contexts}), 'temp_ar_c,umidade_rel_ar_percent')", contexts=_contexts(spark, sf)
    )
    return rounded(out, "min", "max", "mean")


@query(f"""WITH {RQ}, h AS (SELECT request_id, reference_date, horizon, unnest(generate_series(1, least(horizon, 100))) AS hour_ahead FROM rq)
SELECT request_id, reference_date, horizon, hour_ahead, reference_date + to_hours(hour_ahead) AS timestamp,
CAST(hour_ahead AS DOUBLE) / 2 AS temp_ar_c FROM h""")
def expand_points(spark, sf):
    values = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda h: h / F.lit(2.0))
    return C.expand_points(
        V.requests(spark, sf).select("request_id", "reference_date", "horizon", values.alias("values"))
    )


POINTS = f"""{RQ}, ph AS (SELECT request_id AS id, reference_date, unnest(generate_series(1, horizon)) AS h FROM rq),
pp AS (SELECT id, h, reference_date + to_hours(h) AS t, CAST(50 + h % 24 AS DOUBLE) AS v FROM ph),
pd AS (SELECT id, CAST(t AS DATE) AS d, v, hour(t) AS hr, CASE WHEN hour(t) < 7 THEN 'madrugada' WHEN hour(t) < 12 THEN 'manha'
 WHEN hour(t) < 17 THEN 'tarde' ELSE 'noite' END AS period FROM pp)"""


def _points(spark, sf):
    return V.prediction_points(spark, sf).select("id", F.inline_outer("points"))


@query(f"""WITH {POINTS} SELECT id, strftime(d, '%Y-%m-%d') AS target_date, period, CASE period WHEN 'madrugada' THEN 'Madrugada (00h–07h)'
WHEN 'manha' THEN 'Manhã (07h–12h)' WHEN 'tarde' THEN 'Tarde (12h–17h)' ELSE 'Noite (17h–00h)' END AS period_label,
min(v) AS temperature_min_c, max(v) AS temperature_max_c, avg(v) AS temperature_avg_c,
printf('%02dh', CAST(arg_max(hr, v * 100 - hr) AS BIGINT)) AS peak_hour, count(*) AS n_hours FROM pd GROUP BY id, d, period""")
def period_summary(spark, sf):
    out = C.period_summary(_points(spark, sf), ["id"])
    return out.withColumn("target_date", F.col("target_date").cast("string"))


@query(f"""WITH {POINTS}, s AS (SELECT id, min(v) AS temperature_min_c, max(v) AS temperature_max_c, avg(v) AS temperature_avg_c,
printf('%02dh', CAST(arg_max(hr, v * 100 - hr) AS BIGINT)) AS peak_hour, CAST(count(*) AS DOUBLE) AS n FROM pd
WHERE d = DATE '2024-01-10' AND period = 'noite' GROUP BY id)
SELECT rq.request_id AS id, s.* EXCLUDE (id), CASE WHEN s.id IS NULL THEN 'sem_dados' END AS error
FROM rq LEFT JOIN s ON s.id = rq.request_id""")
def period_report(spark, sf):
    out = C.period_report(_points(spark, sf), ["id"], "2024-01-10", "noite")
    return out.withColumn("n", F.size("hourly").cast("double")).drop("hourly")


@query(f"""WITH {WX} SELECT municipio, data_hora, CASE WHEN hour(data_hora) < 7 THEN 'madrugada' WHEN hour(data_hora) < 12 THEN 'manha'
WHEN hour(data_hora) < 17 THEN 'tarde' ELSE 'noite' END AS period FROM wx""")
def period_of_day(spark, sf):
    return wx(spark, sf).select("municipio", "data_hora", D.period_of_day("data_hora").alias("period"))


@query(f"""WITH {RQ} SELECT request_id, b AS bucket, s AS start_h, least(e, horizon) AS end_h FROM rq JOIN
(VALUES ('near', 1, 24), ('mid', 25, 72), ('far', 73, 9999)) AS k(b, s, e) ON s <= horizon""")
def horizon_buckets(spark, sf):
    return V.requests(spark, sf).select("request_id", F.inline(D.buckets_of("horizon")))


@query(f"""WITH {POINTS} SELECT CASE WHEN h <= 24 THEN 'near' WHEN h <= 72 THEN 'mid' ELSE 'far' END AS bucket, count(*) AS n FROM pp GROUP BY 1""")
def horizon_bucket(spark, sf):
    hours = V.requests(spark, sf).select(F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("h"))
    return hours.groupBy(D.horizon_bucket("h").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {POINTS} SELECT id, count(*) AS n, sum(v) AS total,
'[' || string_agg('{{"timestamp":"' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '","temp_ar_c":' || printf('%.1f', v) || '}}', ',' ORDER BY h) || ']' AS forecast_json
FROM pp GROUP BY id""")
def forecast_json(spark, sf):
    p = V.predictions(spark, sf).withColumn("v", A.decode_forecast("forecast_json"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return p.select("id", F.size("v").cast("bigint").alias("n"), total.alias("total"), "forecast_json")


@query(f"""WITH {POINTS} SELECT id, count(*) FILTER (WHERE h BETWEEN 25 AND 100) AS n,
coalesce(sum(v) FILTER (WHERE h BETWEEN 25 AND 100), 0) AS total FROM pp GROUP BY id""")
def slice_forecast(spark, sf):
    p = V.predictions(spark, sf)
    cut = A.slice_forecast(A.decode_forecast("forecast_json"), F.lit(25), F.lit(100))
    return p.select("id", F.size(cut).cast("bigint").alias("n"), F.aggregate(cut, F.lit(0.0), lambda a, x: a + x).alias("total"))


FORECAST_SUMS = """horizon AS n_values, CAST(list_sum(list_transform(range(1, horizon + 1), lambda h: (50 + h % 24) * h)) AS DOUBLE) AS weighted"""


def with_forecast_sums(log):
    """Number of the logged values, and their sum weighted by hour: every value and its place counts."""
    values = A.decode_forecast("forecast_json")
    weighted = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return log.withColumns({"n_values": F.size(values), "weighted": weighted})


@query(f"""WITH {POINTS} SELECT request_id AS id, 'tft_' || CAST(horizon AS VARCHAR) AS model_key, '1' AS model_version,
municipio AS group_id, reference_date, horizon, TIMESTAMP '{NOW}' AS predicted_at, {FORECAST_SUMS} FROM rq""")
def append_predictions(spark, sf):
    from ..sources import sinks

    path = shared_dir(spark, "prediction-log")
    sinks.append_predictions(V.prediction_points(spark, sf), path, now())
    return with_forecast_sums(spark.read.parquet(path)).drop("forecast_json")


@query(f"""WITH {WX}, {RQ}, c AS (SELECT rq.request_id, w.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY w.data_hora DESC) AS back,
 count(*) OVER (PARTITION BY rq.request_id) AS available FROM rq JOIN wx w ON w.municipio = rq.municipio AND w.data_hora <= rq.reference_date),
v AS (SELECT request_id, 'temp_ar_c' AS "column", temp_ar_c AS x FROM c WHERE available >= 48 AND back <= 48
 UNION ALL SELECT request_id, 'umidade_rel_ar_percent', umidade_rel_ar_percent FROM c WHERE available >= 48 AND back <= 48)
SELECT request_id, "column", count(*) AS window_rows, {sr('min(x) AS min', 'max(x) AS max', 'avg(x) AS mean')} FROM v GROUP BY 1, 2""")
def window_stats(spark, sf):
    out = C.window_stats(V.requests(spark, sf), wx(spark, sf), ["temp_ar_c", "umidade_rel_ar_percent"])
    out = out.where(F.col("status") == "ok").drop("status", "rows_until")
    return rounded(out, "min", "max", "mean")


@query(f"""WITH {WX}, {RQ}, c AS (SELECT rq.request_id, w.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY w.data_hora DESC) AS back,
 count(*) OVER (PARTITION BY rq.request_id) AS available FROM rq JOIN wx w ON w.municipio = rq.municipio AND w.data_hora <= rq.reference_date)
SELECT request_id, data_hora, {sr('temp_ar_c')} FROM c WHERE available >= 48 AND back <= 24""")
def window_sample(spark, sf):
    out = C.window_sample(V.requests(spark, sf), wx(spark, sf), ["temp_ar_c"], digits=None)
    return rounded(out, "temp_ar_c")


# --- accuracy ---------------------------------------------------------------------------


@query(f"{PAIRS_DONE} SELECT request_id AS id, horizon FROM due")
def pending_predictions(spark, sf):
    return A.pending(V.predictions(spark, sf), V.evaluated(spark, sf), now()).select("id", "horizon")


@query(f"{PAIRS_NONE} SELECT id, bucket, s AS start_h, e AS end_h, data_hora AS t, {sr('actual')} FROM act")
def actuals_for(spark, sf):
    due = V.predictions(spark, sf).where(D.hours_after(F.col("reference_date"), F.col("horizon")) < now())
    return rounded(A.actuals_for(due, wx(spark, sf)).drop("municipio"), "actual")


@query(f"{PAIRS_NONE} SELECT id, bucket, position, predicted, {sr('actual')} FROM pr")
def pair_errors(spark, sf):
    due = V.predictions(spark, sf).where(D.hours_after(F.col("reference_date"), F.col("horizon")) < now())
    return rounded(A.pair_errors(due, A.actuals_for(due, wx(spark, sf))), "actual")


@query(f"""{PAIRS_NONE} SELECT id, bucket, date_diff('hour', reference_date, data_hora) - s + 1 AS position,
CAST(50 + date_diff('hour', reference_date, data_hora) % 24 AS DOUBLE) AS predicted, {sr('actual')} FROM act""")
def pair_errors_by_time(spark, sf):
    due = V.predictions(spark, sf).where(D.hours_after(F.col("reference_date"), F.col("horizon")) < now())
    return rounded(A.pair_errors(due, A.actuals_for(due, wx(spark, sf)), "timestamp"), "actual")


ERRORS = sr(
    "avg(abs(predicted - actual)) AS mae", "sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse",
    "avg(CASE WHEN actual <> 0 THEN abs(predicted - actual) / abs(actual) END) AS mape_frac",
)
METRICS = ["mae", "rmse", "mape_frac"]


@query(f"{PAIRS_DONE} SELECT id AS prediction_id, bucket, {ERRORS}, count(*) AS n_points FROM pr GROUP BY 1, 2")
def accuracy_by_bucket(spark, sf):
    out = A.accuracy_by_bucket(V.predictions(spark, sf), wx(spark, sf), V.evaluated(spark, sf), now())
    return rounded(out, *METRICS)


LI_PAIRS = """lp AS (SELECT l_suppkey, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS actual,
 l_quantity + l_tax * 10 - 0.4 AS predicted FROM lineitem)"""


def _line_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_suppkey", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity")).alias("actual"),
        (F.col("l_quantity") + F.col("l_tax") * 10.0 - 0.4).alias("predicted"),
    )


@query(f"WITH {LI_PAIRS} SELECT l_suppkey, {ERRORS}, count(*) AS n_points FROM lp GROUP BY 1")
def forecast_error(spark, sf):
    return rounded(A.forecast_error(_line_pairs(spark, sf), ["l_suppkey"]), *METRICS)


TRAIN = sr(
    "avg(abs(predicted - actual)) AS mae", "sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse",
)


@query(f"WITH {LI_PAIRS} SELECT l_suppkey, {TRAIN}, {sr('avg(abs(predicted - actual) / greatest(abs(actual), 1e-6)) * 100 AS mape_pct', digits=1)} FROM lp GROUP BY 1")
def training_metrics(spark, sf):
    out = A.training_metrics(_line_pairs(spark, sf), ["l_suppkey"])
    return rounded(rounded(out, "mae", "rmse"), "mape_pct", digits=1)


def _log(spark, sf, shift, where):
    o = table(spark, sf, "orders").where(where)
    return o.select(
        F.col("o_custkey").cast("string").alias("prediction_id"), F.col("o_orderstatus").alias("bucket"),
        (F.col("o_totalprice") + shift).alias("mae"),
        F.timestamp_seconds(F.col("o_orderkey").cast("bigint")).alias("evaluated_at"),
    )


UPSERT = """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS prediction_id, o_orderstatus AS bucket, o_totalprice AS mae, o_orderkey AS k, 0 AS src
 FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL
 SELECT CAST(o_custkey AS VARCHAR), o_orderstatus, o_totalprice + 1, o_orderkey, 1 FROM orders WHERE o_orderkey % 3 <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY prediction_id, bucket ORDER BY k DESC, src DESC) AS rn FROM a)"""


@query(f"{UPSERT} SELECT prediction_id, bucket, {sr('mae', digits=2)} FROM r WHERE rn = 1")
def upsert_accuracy(spark, sf):
    old, new = _log(spark, sf, 0.0, "o_orderkey % 3 <> 0"), _log(spark, sf, 1.0, "o_orderkey % 3 <> 1")
    return rounded(A.upsert_accuracy(old, new).drop("evaluated_at"), "mae", digits=2)


# --- experiments -------------------------------------------------------------------------


@query(f"""WITH {RX}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY mape ASC NULLS LAST, run_id) AS rn
FROM rx WHERE status = 'FINISHED') SELECT experiment, run_id, {sr('mape')} FROM r WHERE rn = 1""")
def select_best_run(spark, sf):
    return rounded(R.select_best_run(V.runs(spark, sf)), "mape")


# of every 7 candidates one is NaN, of every 5 values in production another
GATE = f"""{RX}, c AS (SELECT run_id AS model_name, run_id, CASE WHEN l_suppkey % 7 <> 0 THEN mape END AS mape FROM rx),
p AS (SELECT run_id AS model_name, CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 0.05 WHEN l_suppkey % 3 = 1 THEN NULL ELSE mape END AS cur
 FROM rx WHERE l_suppkey % 4 <> 0)"""


def _gate(spark, sf, force):
    r = V.runs(spark, sf)
    k = F.col("l_suppkey")
    prod = r.where(k % 4 != 0).select(
        F.col("run_id").alias("model_name"),
        F.when(k % 5 == 0, float("nan")).when(k % 3 == 0, 0.05).when(k % 3 == 1, F.lit(None)).otherwise(F.col("mape")).alias("mape"),
    )
    cand = r.select(F.col("run_id").alias("model_name"), "run_id", F.when(k % 7 == 0, float("nan")).otherwise(F.col("mape")).alias("mape"))
    out = R.promotion_gate(cand, prod, force).drop("mape_tag")
    figures = ("mape", "current_mape", "delta")
    return rounded(out.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in figures}), *figures)


@query(f"""WITH {GATE} SELECT model_name, run_id, {sr('mape', 'cur AS current_mape', 'mape - cur AS delta')},
CASE WHEN mape > cur THEN 'rejected' ELSE 'promoted' END AS decision FROM c LEFT JOIN p USING (model_name)""")
def promotion_gate(spark, sf):
    return _gate(spark, sf, False)


@query(f"""WITH {GATE} SELECT model_name, run_id, {sr('mape', 'cur AS current_mape', 'mape - cur AS delta')},
'promoted' AS decision FROM c LEFT JOIN p USING (model_name)""")
def promotion_forced(spark, sf):
    return _gate(spark, sf, True)


@query("""WITH v AS (SELECT CAST(l_suppkey AS VARCHAR) AS model_name, l_orderkey AS version,
 min(CAST(l_partkey AS VARCHAR)) AS run_id, min(l_discount) AS mape FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS rn FROM v),
m AS (SELECT CAST(s_suppkey AS VARCHAR) AS model_name, CAST(s_suppkey AS BIGINT) AS version, 'run' || CAST(s_suppkey AS VARCHAR) AS run_id,
 0.5::DOUBLE AS mape FROM supplier WHERE s_suppkey % 3 = 0),
b AS (SELECT * FROM n WHERE rn = 1)
SELECT coalesce(b.model_name, m.model_name) AS model_name, coalesce(m.version, b.version) AS version,
 coalesce(m.run_id, b.run_id) AS run_id, coalesce(m.mape, b.mape) AS mape,
 CASE WHEN m.run_id IS NOT NULL THEN 'export' ELSE 'auto' END AS promoted_by
FROM b FULL OUTER JOIN m ON m.model_name = b.model_name""")
def production_versions(spark, sf):
    li = table(spark, sf, "lineitem")
    versions = li.groupBy(F.col("l_suppkey").cast("string").alias("model_name"), F.col("l_orderkey").alias("version"), "l_returnflag").agg(
        F.min(F.col("l_partkey").cast("string")).alias("run_id"), F.min("l_discount").alias("mape")
    ).select(
        "*", F.when(F.col("l_returnflag") == "A", "production").alias("alias"), F.lit("2024-01-01").alias("promoted_at"),
        F.lit("auto").alias("promoted_by"), F.lit("e").alias("experiment_name"),
    )
    s = table(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    manifests = s.select(
        F.col("s_suppkey").cast("string").alias("model_name"), F.col("s_suppkey").cast("bigint").alias("version"),
        F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("run_id"), F.lit(0.5).alias("mape"),
        F.lit("2024-01-02").alias("promoted_at"), F.lit("e").alias("experiment_name"),
    )
    return R.production_versions(versions, manifests).drop("promoted_at", "experiment_name")


EARLY = f"""WITH {EPOCHS}, a AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ep),
b AS (SELECT *, max(CASE WHEN before IS NULL OR val_loss < before THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS last FROM a),
s AS (SELECT run_id, min(epoch) AS stop FROM b WHERE epoch - last >= 3 GROUP BY 1),
n AS (SELECT run_id, max(epoch) AS n FROM ep GROUP BY 1),
f AS (SELECT n.run_id, coalesce(stop, n) AS total, stop IS NOT NULL AS stopped FROM n LEFT JOIN s USING (run_id))
SELECT f.run_id, b.last AS best_epoch, least(b.before, b.val_loss) AS best_val_loss, total AS total_epochs, stopped AS stopped_early
FROM f JOIN b ON b.run_id = f.run_id AND b.epoch = f.total"""


@query(EARLY)
def early_stop_trace(spark, sf):
    return R.early_stop_trace(V.epochs(spark, sf), 3)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN NULL ELSE 0.75 END AS mape FROM orders""")
def coalesce_metric(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    m = (
        F.when(k == 0, F.create_map(F.lit("mape"), F.col("o_totalprice"), F.lit("MAPE"), F.lit(9.0)))
        .when(k == 1, F.create_map(F.lit("MAPE"), F.lit(9.0), F.lit("val_MAPE"), F.lit(0.25)))
        .when(k == 2, F.create_map(F.lit("val_mape"), F.lit(0.5)))
        .when(k == 3, F.create_map(F.lit("loss"), F.lit(1.0)))
        .otherwise(F.create_map(F.lit("val_MAPE"), F.lit(float("nan")), F.lit("mape_scaled"), F.lit(0.75)))
    )
    return R.coalesce_metric(o.select("o_orderkey", m.alias("metrics")), skip_nan=True).drop("metrics")


@query(f"""WITH {SPLIT}, p AS (SELECT municipio, data_hora, temp_ar_c AS actual, lag(temp_ar_c, 3) OVER (PARTITION BY municipio ORDER BY split_idx) AS predicted, split_idx
 FROM spx WHERE split = 'test') SELECT municipio, data_hora, true AS actual_close, true AS predicted_close, {sr('avg(abs(actual - predicted)) OVER (PARTITION BY municipio) AS station_mae', digits=2)} FROM p WHERE split_idx >= 26""")
def evaluate_horizon_step(spark, sf):
    """Third step of a forecast that repeats the last hour seen, beside what came, in the units of the series."""
    from ..operators import scaling

    cols = ["municipio", "data_hora", "temp_ar_c"]
    path = shared_dir(spark, "split")
    Q.temporal_split(wx(spark, sf).select(*cols)).where("split <> 'val'").write.parquet(path)
    split = spark.read.parquet(path)
    stats = scaling.fit_scaler(split.where("split = 'train'"), ["temp_ar_c"])
    scaled = scaling.apply_scaler(split.where("split = 'test'"), stats, ["temp_ar_c"])
    samples = W.make_windows(scaled, ["temp_ar_c"], ["temp_ar_c"], 24, 3)
    forecast = samples.withColumn("y_pred", F.array_repeat(F.element_at("x", -1), 3))
    out = C.evaluate_step(forecast, 2, 0, ["temp_ar_c"], stats)
    rows = split.where("split = 'test'").select("municipio", "data_hora", "temp_ar_c", (F.col("split_idx") - 26).alias("start_idx"))
    last = split.where("split = 'test'").select("municipio", F.col("temp_ar_c").alias("last"), (F.col("split_idx") - 23).alias("start_idx"))
    joined = out.join(rows, ["municipio", "start_idx"]).join(last, ["municipio", "start_idx"])
    # samples are single precision
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.001
    errors = N.error_columns(F.col("predicted"), F.col("actual"))
    whole = out.groupBy("municipio").agg(*errors).select("municipio", rr("mae", 2).alias("station_mae"))
    return joined.join(whole, "municipio").select(
        "municipio", "data_hora", near("actual", "temp_ar_c").alias("actual_close"), near("predicted", "last").alias("predicted_close"), "station_mae",
    )


_CENTRED = """s11 - s1 * s1 / n + pen AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n + pen AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y"""
_SLOPES = """(c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2"""
_SUMS = """count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22,
 sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy"""


@query(f"""WITH {SPLIT}, p AS (SELECT municipio, split, a.temp_ar_c AS x1, a.precipitacao_total_mm AS x2, b.temp_ar_c AS y
 FROM spx a JOIN spx b USING (municipio, split) WHERE b.split_idx = a.split_idx + 1),
g AS (SELECT municipio, {_SUMS} FROM p WHERE split = 'train' GROUP BY 1), r AS (SELECT *, unnest([0.0::DOUBLE, 1.0, 10.0]) AS pen FROM g),
c AS (SELECT *, {_CENTRED} FROM r), w AS (SELECT *, {_SLOPES} FROM c),
v AS (SELECT w.municipio, pen AS penalty, y, (sy - b1 * s1 - b2 * s2) / n + b1 * x1 + b2 * x2 AS f FROM w JOIN p USING (municipio) WHERE split = 'val'),
m AS (SELECT municipio, penalty, avg((f - y) * (f - y)) AS val_loss, avg(abs(f - y)) AS mae, avg(abs(f - y) / greatest(abs(y), 1e-6)) * 100 AS mape_pct FROM v GROUP BY 1, 2)
SELECT municipio, penalty, {sr('val_loss', 'mae', 'sqrt(val_loss) AS rmse', 'mape_pct')},
 row_number() OVER (PARTITION BY municipio ORDER BY val_loss, penalty) = 1 AS is_best FROM m""")
def fit_per_station(spark, sf):
    split = Q.temporal_split(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c", "precipitacao_total_mm"))
    return rounded(C.fit_per_station(split, ["temp_ar_c", "precipitacao_total_mm"]), "val_loss", "mae", "rmse", "mape_pct")


@query(f"""WITH {WX}, p AS (SELECT municipio, CAST(data_hora AS DATE) AS day, temp_ar_c AS y, lag(temp_ar_c) OVER w AS x1, lag(precipitacao_total_mm) OVER w AS x2
 FROM wx WINDOW w AS (PARTITION BY municipio ORDER BY data_hora)), q AS (SELECT * FROM p WHERE x1 IS NOT NULL),
d AS (SELECT DISTINCT municipio, day FROM q),
g AS (SELECT d.municipio, d.day, {_SUMS} FROM d JOIN q ON q.municipio = d.municipio AND q.day BETWEEN d.day - 6 AND d.day GROUP BY 1, 2),
r AS (SELECT *, unnest([0.0::DOUBLE, 10.0]) AS pen FROM g), c AS (SELECT *, {_CENTRED} FROM r), w AS (SELECT *, {_SLOPES} FROM c),
m AS (SELECT *, (sy - b1 * s1 - b2 * s2) / n AS b0 FROM w)
SELECT m.municipio, m.day, pen AS penalty, CAST(any_value(n) AS BIGINT) AS n, {sr('any_value(b0) AS intercept', 'any_value(b1) AS of_temp', 'any_value(b2) AS of_rain', digits=5)},
 {sr('avg((b0 + b1 * x1 + b2 * x2 - y) * (b0 + b1 * x1 + b2 * x2 - y)) AS next_day_mse', digits=4)}
FROM m JOIN q ON q.municipio = m.municipio AND q.day = m.day + 1 GROUP BY 1, 2, 3""")
def rolling_refit(spark, sf):
    """Models of the last seven days on each day, measured on the next; the rows are read once, for the sums by day."""
    lagged = Q.add_series_features(
        wx(spark, sf).select("municipio", "data_hora", "temp_ar_c", "precipitacao_total_mm"),
        lags={"x1": ("temp_ar_c", 1), "x2": ("precipitacao_total_mm", 1)},
    ).withColumn("day", F.to_date("data_hora"))
    path = shared_dir(spark, "gram")
    G.gram_sums(lagged, ["municipio", "day"], ["x1", "x2"], "temp_ar_c").write.parquet(path)
    sums = spark.read.parquet(path)
    models = G.solved(G.rolling(sums, 7, 2), 2, (0.0, 10.0))
    after = sums.select("municipio", F.date_sub("day", 1).alias("day"), *[F.col(n).alias(f"next_{n}") for n in G.names(2)])
    found = models.join(after, ["municipio", "day"]).select(
        "municipio", "day", "penalty", F.col("g0_0").cast("bigint").alias("n"),
        *[F.get("weights", F.lit(i)).alias(c) for i, c in enumerate(("intercept", "of_temp", "of_rain"))],
        G.squared_error(2, prefix="next_").alias("next_day_mse"),
    )
    return rounded(rounded(found, "intercept", "of_temp", "of_rain", digits=5), "next_day_mse", digits=4)


# --- service metrics ----------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def metric_counters(spark, sf):
    return M.metric_counters(table(spark, sf, "events"), ["event_type"])


@query("""SELECT event_type, user_id, value, ts AS at FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def metric_gauges(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.metric_gauges(e, ["event_type", "user_id"], "ts", "value", ["event_id"])


EDGES = [1.0, 5.0, 10.0, 50.0, 100.0, 200.0]
LE = ", ".join(f"({e})" for e in EDGES)


@query(f"""SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS cumulative, count(*) AS count, {sr('sum(value) AS sum', digits=2)}
FROM events, (VALUES {LE}, ('Infinity'::DOUBLE)) AS k(le) GROUP BY 1, 2""")
def metric_histogram(spark, sf):
    hist = M.metric_histogram(table(spark, sf, "events"), "value", EDGES, ["event_type"])
    return rounded(M.bucket_rows(hist, ["event_type"]), "sum", digits=2)


def _quantile_sql(key, src, qs=(0.5, 0.95, 0.99)):
    cum = f"""cum AS (SELECT {key}, le, count(*) FILTER (WHERE value <= le) AS c, count(*) AS total
 FROM {src}, (VALUES {LE}, ('Infinity'::DOUBLE)) AS k(le) GROUP BY 1, 2),
b AS (SELECT *, lag(le, 1, 0) OVER (PARTITION BY {key} ORDER BY le) AS lo, lag(c, 1, 0) OVER (PARTITION BY {key} ORDER BY le) AS below FROM cum),
q AS (SELECT {key}, total, unnest({list(qs)}) AS q FROM (SELECT DISTINCT {key}, total FROM b)),
h AS (SELECT q.{key}, q.total, q.q, min(b.le) AS le FROM q JOIN b ON b.{key} = q.{key} AND b.c >= q.q * q.total GROUP BY 1, 2, 3),
v AS (SELECT h.{key}, h.total, h.q, CASE WHEN h.le = 'Infinity'::DOUBLE THEN {EDGES[-1]}
 ELSE lo + (b.le - lo) * (h.q * h.total - below) / (c - below) END AS x FROM h JOIN b ON b.{key} = h.{key} AND b.le = h.le)"""
    cols = sr(*[f"max(x) FILTER (WHERE q = {q}) AS p{int(round(q * 100))}" for q in qs], digits=4)
    return cum, f"SELECT {key}, max(total) AS count, {cols} FROM v GROUP BY 1"


_cum, _sel = _quantile_sql("event_type", "events")


@query(f"WITH {_cum} {_sel}")
def histogram_quantile(spark, sf):
    hist = M.metric_histogram(table(spark, sf, "events"), "value", EDGES, ["event_type"])
    return rounded(M.quantile_columns(hist, ["event_type"]), "p50", "p95", "p99", digits=4)


_cum2, _sel2 = _quantile_sql("window_start", "ew")


@query(f"WITH ew AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, value FROM events), {_cum2} {_sel2}")
def latency_quantiles(spark, sf):
    out = M.latency_quantiles(table(spark, sf, "events"), "ts", "value", EDGES)
    return rounded(out, "p50", "p95", "p99", digits=4)


@query("""WITH m AS (SELECT event_type, date_trunc('minute', ts) AS b FROM events),
w AS (SELECT event_type, b - to_minutes(unnest([0, 1, 2, 3, 4])) AS window_start FROM m)
SELECT event_type, window_start, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM w GROUP BY 1, 2""")
def metric_rates(spark, sf):
    out = M.metric_rates(table(spark, sf, "events"), "ts", "event_type")
    return out.withColumn("per_second", F.round("per_second", 6))


TTL = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS rn FROM e),
f AS (SELECT event_id, user_id, event_type, us, rn, us AS anchor, false AS is_hit FROM o WHERE rn = 1
 UNION ALL SELECT o.event_id, o.user_id, o.event_type, o.us, o.rn,
  CASE WHEN o.us > f.anchor + {ttl}::BIGINT * 1000000 THEN o.us ELSE f.anchor END, o.us <= f.anchor + {ttl}::BIGINT * 1000000
 FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.rn = f.rn + 1)
SELECT event_id, user_id, event_type, is_hit, anchor AS anchor_us FROM f"""


@query(TTL.format(ttl=86400))
def ttl_dedupe(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    out = M.ttl_dedupe(e, ["user_id", "event_type"], "ts", "event_id", 86400, spans=4)
    return out.select("event_id", "user_id", "event_type", "is_hit", F.unix_micros("anchor").alias("anchor_us"))


@query("SELECT event_type, count(*) FILTER (WHERE is_hit) AS hits, count(*) FILTER (WHERE NOT is_hit) AS misses FROM ("
       + TTL.format(ttl=21600).replace("user_id, event_type ORDER", "event_type ORDER").replace("o.user_id = f.user_id AND ", "")
       + ") GROUP BY 1")
def cache_counts(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return M.cache_counts(M.ttl_dedupe(e, ["event_type"], "ts", "event_id", 21600), ["event_type"])


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAYS")
def retention_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return e.where(D.newer_than("ts", now(), 10))


@query(f"""SELECT event_id, sha256('tft:' || CAST(72 + user_id % 3 AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ':' || event_type) AS request_key FROM events""")
def request_key(spark, sf):
    e = table(spark, sf, "events")
    key = X.request_key(
        F.lit("tft"), 72 + F.col("user_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_type")
    )
    return e.select("event_id", key.alias("request_key"))
