"""Queries over ordered series: features, positions, samples, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import times as D
from ..operators import scaling, series as Q, windows as W
from .registry import query
from .views import (
    FEAT, FEAT_ALL, RQ, SPLIT, WX, features, requests, rounded, rr, sr, table, wx,
)

DERIVED = [c for c in S.FEATURE_COLUMNS if c not in ("umidade_rel_ar_percent",)]


@query(f"WITH {FEAT} SELECT municipio, data_hora, {sr(*S.FEATURE_COLUMNS)} FROM feat")
def feature_table(spark, sf):
    return rounded(features(spark, sf), *S.FEATURE_COLUMNS)


@query(f"WITH {FEAT_ALL} SELECT municipio, data_hora, {sr('temp_ar_c', 'temp_lag_1h', 'temp_lag_24h')} FROM feat_all")
def add_lags(spark, sf):
    out = Q.add_lags(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c"))
    return rounded(out, "temp_ar_c", "temp_lag_1h", "temp_lag_24h")


@query(f"""WITH {WX} SELECT a.municipio, a.data_hora, {sr('a.temp_ar_c AS temp_ar_c', 'b.temp_ar_c AS temp_lag_1h', 'd.temp_ar_c AS temp_lag_24h')}
FROM wx a LEFT JOIN wx b ON b.municipio = a.municipio AND b.data_hora = a.data_hora - INTERVAL 1 HOUR
LEFT JOIN wx d ON d.municipio = a.municipio AND d.data_hora = a.data_hora - INTERVAL 24 HOUR""")
def add_lags_by_time(spark, sf):
    out = Q.add_lags(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c"), mode="time")
    return rounded(out, "temp_ar_c", "temp_lag_1h", "temp_lag_24h")


MA = ["temp_ma_6h", "temp_ma_12h", "pressao_ma_6h", "pressao_ma_12h"]


@query(f"WITH {FEAT_ALL} SELECT municipio, data_hora, {sr(*MA)} FROM feat_all")
def add_moving_averages(spark, sf):
    out = Q.add_moving_averages(wx(spark, sf))
    return rounded(out.select("municipio", "data_hora", *MA), *MA)


@query(f"""WITH {WX} SELECT municipio, data_hora,
{sr('avg(umidade_rel_ar_percent) OVER (PARTITION BY municipio ORDER BY data_hora ROWS 2 PRECEDING) AS umidade_ma_3h')}
FROM wx""")
def moving_average_with_gaps(spark, sf):
    out = Q.add_moving_averages(wx(spark, sf), {"umidade": "umidade_rel_ar_percent"}, [3])
    return rounded(out.select("municipio", "data_hora", "umidade_ma_3h"), "umidade_ma_3h")


@query(f"WITH {FEAT_ALL} SELECT municipio, data_hora, {sr('pressao_tendencia_1h', 'temp_tendencia_1h')} FROM feat_all")
def add_trends(spark, sf):
    cols = ["pressao_tendencia_1h", "temp_tendencia_1h"]
    return rounded(Q.add_trends(wx(spark, sf)).select("municipio", "data_hora", *cols), *cols)


@query(f"WITH {FEAT_ALL} SELECT municipio, data_hora, {sr('hora_sin', 'hora_cos')} FROM feat_all")
def add_cyclic_hour(spark, sf):
    out = Q.add_cyclic_hour(wx(spark, sf).select("municipio", "data_hora"))
    return rounded(out, "hora_sin", "hora_cos")


@query(f"WITH {WX} SELECT municipio, data_hora, {sr('temp_ar_c', 'pressao_atm_estacao_mb')} FROM wx")
def select_required(spark, sf):
    out = Q.select_required(wx(spark, sf), ["municipio", "data_hora", "temp_ar_c", "pressao_atm_estacao_mb"])
    return rounded(out, "temp_ar_c", "pressao_atm_estacao_mb")


@query(f"WITH {WX} SELECT municipio, data_hora, {sr('temp_ar_c')}, 'vento_vel_ms' AS missing FROM wx")
def select_available(spark, sf):
    out, missing = Q.select_available(wx(spark, sf), ["municipio", "data_hora", "temp_ar_c", "vento_vel_ms"])
    return rounded(out, "temp_ar_c").withColumn("missing", F.lit(",".join(missing)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE l_quantity END AS q FROM lineitem""")
def inf_to_null(spark, sf):
    n = F.col("l_linenumber")
    odd = (
        F.when(n == 1, float("inf")).when(n == 2, float("-inf")).when(n == 3, float("nan"))
        .otherwise(F.col("l_quantity"))
    )
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", odd.alias("q"))
    return Q.inf_to_null(out)


@query(f"WITH {WX} SELECT municipio, data_hora, {sr('umidade_rel_ar_percent')} FROM wx WHERE umidade_rel_ar_percent IS NOT NULL")
def drop_null_rows(spark, sf):
    out = Q.drop_null_rows(wx(spark, sf).select("municipio", "data_hora", "umidade_rel_ar_percent"))
    return rounded(out, "umidade_rel_ar_percent")


@query(f"""WITH {FEAT} SELECT municipio, data_hora, 'station_1' AS "group",
row_number() OVER (PARTITION BY municipio ORDER BY data_hora) - 1 AS time_idx FROM feat""")
def add_time_idx(spark, sf):
    return Q.add_time_idx(features(spark, sf).select("municipio", "data_hora"))


@query(f"WITH {SPLIT} SELECT municipio, data_hora, time_idx, split, split_idx FROM spx")
def temporal_split(spark, sf):
    return Q.temporal_split(wx(spark, sf).select("municipio", "data_hora"))


@query(f"WITH {SPLIT} SELECT municipio, data_hora, time_idx FROM sp WHERE split = 'train'")
def training_slice(spark, sf):
    return Q.training_slice(wx(spark, sf).select("municipio", "data_hora"), 0.8)


@query(f"""WITH {SPLIT} SELECT municipio, split, count(*) AS n_rows, greatest(count(*) - 24 - 1 + 1, 0) AS n_samples
FROM spx GROUP BY 1, 2""")
def dataset_counts(spark, sf):
    return Q.dataset_counts(Q.temporal_split(wx(spark, sf).select("municipio", "data_hora")), 24, 1)


def _split_wx(spark, sf):
    cols = ["municipio", "data_hora", "temp_ar_c", "pressao_atm_estacao_mb", "precipitacao_total_mm"]
    return Q.temporal_split(wx(spark, sf).select(*cols))


@query(f"""WITH {SPLIT}, wd AS (SELECT municipio, split, split_idx AS start_idx,
 list([CAST(temp_ar_c AS FLOAT), CAST(pressao_atm_estacao_mb AS FLOAT)]) OVER (PARTITION BY municipio, split ORDER BY split_idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS x,
 list(CAST(temp_ar_c AS FLOAT)) OVER (PARTITION BY municipio, split ORDER BY split_idx ROWS BETWEEN 24 FOLLOWING AND 29 FOLLOWING) AS y
 FROM spx)
SELECT municipio, split, start_idx, len(x) AS n_x, len(y) AS n_y,
 {sr('CAST(x[1][1] AS DOUBLE) AS x_first', 'CAST(x[24][2] AS DOUBLE) AS x_last', 'CAST(y[1] AS DOUBLE) AS y_first', 'CAST(y[6] AS DOUBLE) AS y_last', digits=3)}
FROM wd WHERE len(x) = 24 AND len(y) = 6""")
def make_windows(spark, sf):
    out = W.make_windows(_split_wx(spark, sf), ["temp_ar_c", "pressao_atm_estacao_mb"], ["temp_ar_c"], 24, 6)

    def cell(col, i, j):
        return rr(F.get(F.get(col, F.lit(i)), F.lit(j)).cast("double"), 3)

    return out.select(
        "municipio", "split", "start_idx",
        F.size("x").cast("bigint").alias("n_x"), F.size("y").cast("bigint").alias("n_y"),
        cell("x", 0, 0).alias("x_first"), cell("x", 23, 1).alias("x_last"),
        cell("y", 0, 0).alias("y_first"), cell("y", 5, 0).alias("y_last"),
    )


@query(f"""WITH {SPLIT}, n AS (SELECT municipio, split, count(*) AS n FROM spx GROUP BY 1, 2)
SELECT municipio, split, unnest(generate_series(0, n - 30)) AS start_idx FROM n WHERE n >= 30""")
def window_index(spark, sf):
    return W.window_index(_split_wx(spark, sf), 24, 6)


@query(f"""WITH {SPLIT}, n AS (SELECT municipio, split, count(*) AS n FROM spx GROUP BY 1, 2),
s AS (SELECT municipio, split, n, unnest(generate_series(0, n - 18 - 6)) AS encoder_start FROM n WHERE n >= 24)
SELECT municipio, split, encoder_start, least(24, n - encoder_start - 6) AS encoder_length,
 encoder_start + least(24, n - encoder_start - 6) AS decoder_start, 6 AS prediction_length,
 'hora_sin,hora_cos' AS known_reals, 'temp_ar_c,temp_lag_1h' AS unknown_reals FROM s""")
def encoder_windows(spark, sf):
    return W.encoder_windows(
        _split_wx(spark, sf), 24, 6, "tft", features=["temp_ar_c", "hora_sin", "hora_cos", "temp_lag_1h"]
    )


@query(f"""WITH {SPLIT}, n AS (SELECT municipio, split, count(*) AS n FROM spx GROUP BY 1, 2)
SELECT municipio, split, unnest(generate_series(0, n - 30)) AS encoder_start, 24 AS encoder_length,
 unnest(generate_series(24, n - 6)) AS decoder_start, 6 AS prediction_length, '' AS known_reals,
 'temp_ar_c' AS unknown_reals FROM n WHERE n >= 30""")
def encoder_windows_fixed(spark, sf):
    return W.encoder_windows(_split_wx(spark, sf), 24, 6, "nbeats")


STATS = """st AS (SELECT municipio, avg(temp_ar_c) AS tm, stddev_pop(temp_ar_c) AS ts,
 avg(precipitacao_total_mm) AS pm, stddev_pop(precipitacao_total_mm) AS ps FROM sp WHERE split = 'train' GROUP BY 1)"""
SCALED = ["temp_ar_c", "precipitacao_total_mm"]


def _fit(spark, sf):
    split = _split_wx(spark, sf)
    return split, scaling.fit_scaler(split.where(F.col("split") == "train"), SCALED)


@query(f"""WITH {SPLIT}, {STATS} SELECT municipio, {sr('tm AS temp_ar_c__mean', 'CASE WHEN ts = 0 THEN 1 ELSE ts END AS temp_ar_c__std',
 'pm AS precipitacao_total_mm__mean', 'CASE WHEN ps = 0 THEN 1 ELSE ps END AS precipitacao_total_mm__std')} FROM st""")
def fit_scaler(spark, sf):
    _, stats = _fit(spark, sf)
    return rounded(stats, *[c for c in stats.columns if c != "municipio"])


@query(f"""WITH {SPLIT}, {STATS} SELECT municipio, data_hora, split, {sr('(temp_ar_c - tm) / ts AS temp_ar_c',
 '(precipitacao_total_mm - pm) / ps AS precipitacao_total_mm')} FROM sp JOIN st USING (municipio)""")
def apply_scaler(spark, sf):
    split, stats = _fit(spark, sf)
    out = scaling.apply_scaler(split.select("municipio", "data_hora", "split", *SCALED), stats, SCALED)
    return rounded(out, *SCALED)


@query(f"WITH {SPLIT} SELECT municipio, data_hora, {sr('temp_ar_c')} FROM sp")
def inverse_scaler(spark, sf):
    split, stats = _fit(spark, sf)
    there = scaling.apply_scaler(split.select("municipio", "data_hora", *SCALED), stats, SCALED)
    back = scaling.inverse_scaler(there, stats, {"temp_ar_c": "temp_ar_c"})
    return rounded(back.select("municipio", "data_hora", "temp_ar_c"), "temp_ar_c")


@query(f"""WITH {WX}, v AS (SELECT municipio, data_hora, CASE WHEN temp_ar_c > 20 THEN temp_ar_c
 ELSE ln(greatest(exp(least(temp_ar_c, 20)) - 1, 1e-8)) END AS v FROM wx),
s AS (SELECT municipio, avg(v) AS c, stddev_samp(v) + 1e-8 AS s FROM v GROUP BY 1)
SELECT municipio, data_hora, {sr('(v - c) / s AS temp_ar_c_norm', digits=4)} FROM v JOIN s USING (municipio)""")
def group_normalizer(spark, sf):
    out = scaling.group_normalizer(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c"), "temp_ar_c")
    return rounded(out.select("municipio", "data_hora", "temp_ar_c_norm"), "temp_ar_c_norm", digits=4)


@query(f"""WITH {SPLIT} SELECT municipio, data_hora, {sr('temp_ar_c')} FROM sp
WHERE time_idx % CAST(greatest(ceil(total / 100.0), 1) AS BIGINT) = 0""")
def stride_sample(spark, sf):
    out = Q.stride_sample(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c"), 100)
    return rounded(out, "temp_ar_c")


@query(f"WITH {SPLIT} SELECT municipio, data_hora, {sr('temp_ar_c')} FROM sp WHERE time_idx >= total - 24")
def tail_rows(spark, sf):
    return rounded(Q.tail_rows(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c"), 24), "temp_ar_c")


@query(f"WITH {SPLIT} SELECT municipio, data_hora, {sr('temp_ar_c')} FROM sp WHERE time_idx < 12")
def head_sample(spark, sf):
    return rounded(Q.head_rows(wx(spark, sf).select("municipio", "data_hora", "temp_ar_c"), 12), "temp_ar_c")


@query(f"WITH {WX} SELECT municipio, data_hora, {sr('temp_ar_c')} FROM wx ORDER BY municipio, data_hora")
def sort_series(spark, sf):
    out = wx(spark, sf).select("municipio", "data_hora", "temp_ar_c").orderBy("municipio", "data_hora")
    return rounded(out, "temp_ar_c")


@query("""SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status, NULL AS segment FROM orders
UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer""")
def union_stations(spark, sf):
    a = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS amount", "o_orderstatus AS status")
    b = table(spark, sf, "customer").selectExpr("c_acctbal AS amount", "c_mktsegment AS segment", "c_custkey AS id")
    return Q.union_stations(a, b)


@query("""WITH wh AS (SELECT 'st_' || CAST(o_custkey % 5 AS VARCHAR) AS municipio,
 o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS data_hora FROM orders)
SELECT municipio, data_hora, count(*) AS n FROM wh GROUP BY 1, 2 HAVING count(*) > 1""")
def check_unique(spark, sf):
    from .views import wh

    return Q.check_unique(wh(spark, sf))


@query(f"""WITH {WX}, {RQ} SELECT rq.request_id, count(w.data_hora) AS rows_until
FROM rq LEFT JOIN wx w ON w.municipio = rq.municipio AND w.data_hora <= rq.reference_date GROUP BY 1""")
def rows_until(spark, sf):
    out = W.rows_until(requests(spark, sf), wx(spark, sf))
    return out.select("request_id", "rows_until")


LASTN = f"""{WX}, {RQ}, c AS (SELECT rq.request_id, w.data_hora, w.temp_ar_c,
 row_number() OVER (PARTITION BY rq.request_id ORDER BY w.data_hora DESC) AS back,
 count(*) OVER (PARTITION BY rq.request_id) AS available
 FROM rq JOIN wx w ON w.municipio = rq.municipio AND w.data_hora <= rq.reference_date)"""


@query(f"""WITH {LASTN} SELECT request_id, data_hora, 168 - back AS position, {sr('temp_ar_c')}
FROM c WHERE available >= 168 AND back <= 168""")
def last_n_before(spark, sf):
    _, rows = W.last_n_before(requests(spark, sf), wx(spark, sf), 168)
    return rounded(rows.select("request_id", "data_hora", "position", "temp_ar_c"), "temp_ar_c")


@query(f"""WITH {WX}, {RQ} SELECT rq.request_id, w.data_hora, {sr('w.temp_ar_c AS temp_ar_c')}
FROM rq JOIN wx w ON w.municipio = rq.municipio AND w.data_hora >= rq.reference_date + INTERVAL 1 HOUR
 AND w.data_hora <= rq.reference_date + INTERVAL 72 HOUR""")
def interval_join(spark, sf):
    asked = requests(spark, sf).select(
        "request_id", "municipio",
        D.hours_after(F.col("reference_date"), F.lit(1)).alias("start"),
        D.hours_after(F.col("reference_date"), F.lit(72)).alias("end"),
    )
    out = W.interval_join(asked, wx(spark, sf), "start", "end")
    return rounded(out.select("request_id", "data_hora", "temp_ar_c"), "temp_ar_c")
