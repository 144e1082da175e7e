"""Queries over exploratory aggregates, profiles and texts made from them."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import schema as S
from ..operators import eda as E, profiles as P, quantiles as K, series as Q, sketches as SK
from ..session import shared_dir
from .registry import query
from .views import FEAT, WH, WX, features, now, rounded, rr, sr, table, wh, wx

NAMES_WH = ["municipio", "data_hora", "temp_ar_c", "temp_max_c", "temp_min_c", "precipitacao_total_mm", "seq"]


@query("""SELECT count(*) AS num_rows, 6 AS num_columns, unnest([0, 1, 2, 3, 4, 5]) AS position,
unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS "column",
unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) AS dtype FROM events""")
def profile_table(spark, sf):
    return E.profile_table(table(spark, sf, "events"))


@query(f"""WITH {FEAT} SELECT count(*) AS num_rows, 14 AS num_columns, 7 AS original_features, 7 AS new_features,
'{",".join(c for c in [*S.TARGET_COLUMNS, 'temp_lag_1h', 'temp_lag_24h', 'temp_ma_6h', 'pressao_ma_6h', 'temp_ma_12h',
 'pressao_ma_12h', 'pressao_tendencia_1h', 'temp_tendencia_1h', 'hora_sin', 'hora_cos'])}' AS feature_names,
'DatetimeIndex' AS index_type FROM feat""")
def feature_summary(spark, sf):
    before = wx(spark, sf).drop("municipio")
    return E.feature_summary(before, features(spark, sf).drop("municipio"))


@query(f"""WITH {WX} SELECT 'umidade_rel_ar_percent' AS "column", count(*) FILTER (WHERE umidade_rel_ar_percent IS NULL) AS nulls,
{sr('100.0 * count(*) FILTER (WHERE umidade_rel_ar_percent IS NULL) / count(*) AS percent')} FROM wx HAVING count(*) FILTER (WHERE umidade_rel_ar_percent IS NULL) > 0""")
def missing_summary(spark, sf):
    return rounded(E.missing_summary(wx(spark, sf)), "percent")


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sr(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr')} FROM lineitem"
    for a in LI for b in LI))
def correlation_matrix(spark, sf):
    return rounded(E.correlation_matrix(table(spark, sf, "lineitem"), LI), "corr")


@query(f"""WITH {WX}, pairs AS (SELECT * FROM wx WHERE umidade_rel_ar_percent IS NOT NULL)
SELECT 'umidade_rel_ar_percent' AS col_a, 'temp_ar_c' AS col_b, {sr('corr(temp_ar_c, umidade_rel_ar_percent) AS corr')} FROM pairs
UNION ALL SELECT 'temp_ar_c', 'umidade_rel_ar_percent', {sr('corr(temp_ar_c, umidade_rel_ar_percent) AS corr')} FROM pairs
UNION ALL SELECT 'temp_ar_c', 'constant', NULL UNION ALL SELECT 'constant', 'temp_ar_c', NULL
UNION ALL SELECT 'constant', 'umidade_rel_ar_percent', NULL UNION ALL SELECT 'umidade_rel_ar_percent', 'constant', NULL
UNION ALL SELECT 'constant', 'constant', NULL UNION ALL SELECT 'temp_ar_c', 'temp_ar_c', 1.0
UNION ALL SELECT 'umidade_rel_ar_percent', 'umidade_rel_ar_percent', 1.0""")
def correlation_with_gaps(spark, sf):
    df = wx(spark, sf).select("temp_ar_c", "umidade_rel_ar_percent", F.lit(1.0).alias("constant"))
    return rounded(E.correlation_matrix(df), "corr")


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
FROM lineitem, e GROUP BY 1""")
def distribution(spark, sf):
    return E.distribution(table(spark, sf, "lineitem"), "l_extendedprice", 20)


def _box(col, by, src):
    keys = ", ".join(by)
    q = sr(
        f"min({col}) AS min", f"quantile_cont({col}, 0.25) AS q1", f"quantile_cont({col}, 0.5) AS median",
        f"quantile_cont({col}, 0.75) AS q3", f"max({col}) AS max",
    )
    return f"SELECT {keys + ', ' if by else ''}count({col}) AS n, {q} FROM {src}" + (f" GROUP BY {keys}" if by else "")


BOX = ["min", "q1", "median", "q3", "max"]


@query(_box("l_extendedprice", [], "lineitem"))
def box_summary(spark, sf):
    return rounded(K.box_stats(table(spark, sf, "lineitem"), [], "l_extendedprice"), *BOX)


@query(f"WITH {WH}, y AS (SELECT *, year(data_hora) AS ano FROM wh) " + _box("temp_ar_c", ["ano"], "y"))
def distribution_by_year(spark, sf):
    return rounded(E.distribution_by_year(wh(spark, sf), "temp_ar_c"), *BOX)


@query(f"WITH {WH}, y AS (SELECT *, year(data_hora) AS ano, hour(data_hora) AS hora FROM wh) "
       + _box("temp_ar_c", ["ano", "hora"], "y"))
def hourly_distribution_by_year(spark, sf):
    return rounded(E.hourly_distribution_by_year(wh(spark, sf), "temp_ar_c"), *BOX)


@query(f"""WITH {WH} SELECT municipio, data_hora, seq, year(data_hora) AS ano, month(data_hora) AS mes,
strftime(data_hora, '%b') AS nome_mes, dayofyear(data_hora) AS dia_do_ano, hour(data_hora) AS hora,
strftime(data_hora, '%Y-%m-%d') AS data_sem_hora FROM wh""")
def calendar_parts(spark, sf):
    out = E.with_calendar(wh(spark, sf).select("municipio", "data_hora", "seq"))
    return out.withColumn("data_sem_hora", F.col("data_sem_hora").cast("string"))


def _part_sql(parts, col, agg, text_year=False):
    keys = {"ano": "year(data_hora)", "mes": "month(data_hora)", "hora": "hour(data_hora)", "dia_do_ano": "dayofyear(data_hora)"}
    names = [f"CAST({keys[p]} AS VARCHAR) AS {p}" if text_year and p == "ano" else f"{keys[p]} AS {p}" for p in parts]
    value = f"avg({col})" if agg == "mean" else f"coalesce(sum({col}), 0)"
    return (f"WITH {WH} SELECT {', '.join(names)}, {sr(f'{value} AS {col}')} FROM wh GROUP BY "
            + ", ".join(str(i + 1) for i in range(len(parts))))


RAIN = "precipitacao_total_mm"


@query(_part_sql(["ano", "mes"], "temp_ar_c", "mean"))
def monthly_by_year(spark, sf):
    return rounded(E.monthly_by_year(wh(spark, sf), "temp_ar_c"), "temp_ar_c")


@query(_part_sql(["ano", "mes"], RAIN, "sum"))
def monthly_sum_by_year(spark, sf):
    return rounded(E.monthly_by_year(wh(spark, sf), RAIN, "sum"), RAIN)


@query(_part_sql(["ano"], RAIN, "sum"))
def rain_by_year(spark, sf):
    return rounded(E.rain_by_year(wh(spark, sf)), RAIN)


@query(_part_sql(["ano", "hora"], "temp_ar_c", "mean", True))
def hourly_profile_by_year(spark, sf):
    return rounded(E.hourly_profile_by_year(wh(spark, sf), "temp_ar_c"), "temp_ar_c")


@query(_part_sql(["ano", "hora"], RAIN, "sum", True))
def hourly_sum_by_year(spark, sf):
    return rounded(E.hourly_profile_by_year(wh(spark, sf), RAIN, "total"), RAIN)


@query(_part_sql(["ano", "dia_do_ano"], "temp_ar_c", "mean", True))
def daily_by_year(spark, sf):
    return rounded(E.daily_by_year(wh(spark, sf), "temp_ar_c"), "temp_ar_c")


@query(_part_sql(["ano", "dia_do_ano"], RAIN, "sum", True))
def daily_sum_by_year(spark, sf):
    return rounded(E.daily_by_year(wh(spark, sf), RAIN, "sum"), RAIN)


HOURS = [f"h{h:02d}" for h in range(24)]
HEAT = f"""WITH {WH}, cells AS (SELECT year(data_hora) AS ano, month(data_hora) AS mes, hour(data_hora) AS hora,
 avg(temp_ar_c) AS v FROM wh GROUP BY 1, 2, 3),
grid AS (SELECT y.ano, m.mes FROM (SELECT DISTINCT ano FROM cells) y, (SELECT unnest(generate_series(1, 12)) AS mes) m),
wide AS (SELECT ano, mes, {", ".join(f"max(v) FILTER (WHERE hora = {h}) AS h{h:02d}" for h in range(24))} FROM cells GROUP BY 1, 2)
SELECT ano, mes, {sr(*HOURS, digits=4)}, {sr('(SELECT min(v) FROM cells) AS z_min', '(SELECT max(v) FROM cells) AS z_max', digits=4)}
FROM grid LEFT JOIN wide USING (ano, mes)"""


@query(HEAT)
def hour_month_heatmap(spark, sf):
    return rounded(E.hour_month_heatmap(wh(spark, sf), "temp_ar_c"), *HOURS, "z_min", "z_max", digits=4)


def _extreme_sql(cond):
    return f"""WITH {WH}, d AS (SELECT year(data_hora) AS ano, CAST(data_hora AS DATE) AS dia, max(temp_max_c) AS hi,
 min(temp_min_c) AS lo FROM wh GROUP BY 1, 2) SELECT ano, count(*) FILTER (WHERE {cond}) AS qtd_dias FROM d GROUP BY 1"""


@query(_extreme_sql("hi >= 50"))
def extreme_days(spark, sf):
    return E.extreme_days(wh(spark, sf), 50.0)


@query(_extreme_sql("lo <= -3"))
def extreme_cold_days(spark, sf):
    return E.extreme_days(wh(spark, sf), -3.0, "min")


@query(f"""WITH {WH}, y AS (SELECT DISTINCT year(data_hora) AS ano FROM wh),
c AS (SELECT year(data_hora) AS ano, count(*) AS n FROM wh WHERE year(data_hora) % 2 = 0 GROUP BY 1)
SELECT ano, coalesce(n, 0) AS n FROM y LEFT JOIN c USING (ano)""")
def left_fill(spark, sf):
    w = wh(spark, sf).select(F.year("data_hora").alias("ano"))
    counts = w.where(F.col("ano") % 2 == 0).groupBy("ano").agg(F.count(F.lit(1)).alias("n"))
    return E.left_fill(w.distinct(), counts, "ano", ["n"])


PROFILE_COLS = ["temp_ar_c", "precipitacao_total_mm"]


def _profile_cte(src):
    rows = " UNION ALL ".join(
        f"SELECT municipio, month(data_hora) AS month, '{c}' AS \"column\", {c} AS v FROM {src}" for c in PROFILE_COLS
    )
    return f"""lng AS ({rows}),
prof AS (SELECT municipio, month, "column", avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
 quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM lng GROUP BY 1, 2, 3)"""


def _two_digits(*names):
    """Rounded from the exact binary value, as a format does it."""
    return ", ".join(f"CAST(printf('%.2f', {n}) AS DOUBLE) + 0.0 AS {n.rpartition('.')[2]}" for n in names)


@query(f"""WITH {WH}, {_profile_cte('wh')} SELECT municipio, month, "column", {_two_digits('mean', 'std', 'min', 'max')} FROM prof""")
def monthly_profiles(spark, sf):
    return P.monthly_profiles(wh(spark, sf), PROFILE_COLS)


@query(f"""WITH {WH}, {_profile_cte('wh')} SELECT municipio, month, "column", {_two_digits('p5', 'p95')} FROM prof""")
def seasonal_extremes(spark, sf):
    return P.seasonal_extremes(wh(spark, sf), PROFILE_COLS)


@query()
def seasonal_extremes_sketch(spark, sf):
    return P.seasonal_extremes(wh(spark, sf), PROFILE_COLS, approx=True)


@query(f"""WITH {WH}, l AS (UNPIVOT (SELECT municipio, month(data_hora) AS month, temp_ar_c, precipitacao_total_mm FROM wh) ON temp_ar_c, precipitacao_total_mm INTO NAME "column" VALUE v)
SELECT municipio, month, "column", count(*) AS n, true AS p5_near, true AS p95_near FROM l GROUP BY 1, 2, 3""")
def quantile_sketches(spark, sf):
    """Stored sketches of the odd and the even years, merged; each estimate's rank lies within the bound."""
    rows, probs = wh(spark, sf), {"p5": 0.05, "p95": 0.95}
    path = shared_dir(spark, "sketches")
    for odd in (0, 1):
        SK.quantile_sketches(rows.where(F.year("data_hora") % 2 == odd), PROFILE_COLS).write.mode("append").parquet(path)
    found = SK.sketched_quantiles(SK.merged(spark.read.parquet(path)), probs)
    # a group of few rows has steps of 1 / n
    near = lambda c: F.col(c) <= SK.RANK_ERROR + 1 / F.col("n")
    return SK.rank_errors(rows, found, probs).select("municipio", "month", "column", "n", near("p5").alias("p5_near"), near("p95").alias("p95_near"))


@query(f"""WITH {WH} SELECT municipio, min(data_hora) AS date_start, max(data_hora) AS date_end, count(*) AS row_count,
'temp_ar_c,precipitacao_total_mm' AS profile_columns, TIMESTAMP '2024-01-25 00:00:00' AS snapshot_at FROM wh GROUP BY 1""")
def snapshot_metadata(spark, sf):
    return P.snapshot_metadata(wh(spark, sf), now())


ANNUAL = f"""{WH}, m AS (SELECT municipio, month(data_hora) AS month, CAST(printf('%.2f', avg(temp_ar_c)) AS DOUBLE) AS mean FROM wh GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY municipio ORDER BY mean DESC, month) AS hot,
 row_number() OVER (PARTITION BY municipio ORDER BY mean, month) AS cold FROM m),
e AS (SELECT municipio, min(data_hora) AS date_start, max(data_hora) AS date_end, count(*) AS row_count FROM wh GROUP BY 1)"""


@query(f"""WITH {ANNUAL} SELECT e.*, h.month AS hottest_month, {sr('h.mean AS hottest_mean')}, c.month AS coldest_month,
{sr('c.mean AS coldest_mean')} FROM e JOIN r h ON h.municipio = e.municipio AND h.hot = 1
JOIN r c ON c.municipio = e.municipio AND c.cold = 1""")
def annual_summary(spark, sf):
    w = wh(spark, sf)
    out = P.annual_summary(P.monthly_profiles(w, ["temp_ar_c"]), P.snapshot_metadata(w, now()))
    return rounded(out, "hottest_mean", "coldest_mean")


MONTHS = "['" + "', '".join(S.MONTH_NAMES.values()) + "']"


def _two(x):
    """Two decimals without trailing zeros, one at least."""
    return f"regexp_replace(printf('%.2f', {x}), '(\\.\\d)0$', '\\1')"


ANNUAL_TEXT = f"""'Resumo climático anual de ' || e.municipio || ': mês mais quente é ' || {MONTHS}[h.month] || ' (média ' || {_two('h.mean')}
|| '°C), mês mais frio é ' || {MONTHS}[c.month] || ' (média ' || {_two('c.mean')} || '°C). Histórico de '
|| strftime(date_start, '%Y-%m') || ' a ' || strftime(date_end, '%Y-%m') || ', total de ' || format('{{:,}}', row_count)
|| ' observações horárias.' AS text"""
ANNUAL_FROM = "FROM e JOIN r h ON h.municipio = e.municipio AND h.hot = 1 JOIN r c ON c.municipio = e.municipio AND c.cold = 1"


@query(f"WITH {ANNUAL} SELECT e.municipio, 0 AS mes, 'anual' AS mes_nome, {ANNUAL_TEXT} {ANNUAL_FROM}")
def annual_chunk(spark, sf):
    w = wh(spark, sf)
    return P.annual_chunk(P.monthly_profiles(w, ["temp_ar_c"]), P.snapshot_metadata(w, now()))


CHUNKS = f"""{WH}, {_profile_cte('wh')}, t AS (SELECT * FROM prof WHERE "column" = 'temp_ar_c'),
p AS (SELECT * FROM prof WHERE "column" = 'precipitacao_total_mm'),
monthly AS (SELECT t.municipio, t.month AS mes, {MONTHS}[t.month] AS mes_nome,
'Em ' || {MONTHS}[t.month] || ' em ' || t.municipio || ': Temperatura média de ' || {_two('t.mean')} || '°C (mín: '
|| {_two('t.min')} || '°C, máx: ' || {_two('t.max')} || '°C, desvio: ' || {_two('t.std')} || '°C). Percentil 5%: '
|| {_two('t.p5')} || '°C, percentil 95%: ' || {_two('t.p95')} || '°C. Precipitação: média de ' || {_two('p.mean')}
|| ' mm, máximo de ' || {_two('p.max')} || ' mm.' AS text
FROM t JOIN p ON p.municipio = t.municipio AND p.month = t.month)"""


@query(f"WITH {CHUNKS} SELECT * FROM monthly")
def monthly_chunks(spark, sf):
    w = wh(spark, sf)
    return P.monthly_chunks(P.monthly_profiles(w, PROFILE_COLS), P.seasonal_extremes(w, PROFILE_COLS))


def _docs(spark, sf):
    w = wh(spark, sf)
    return P.monthly_profiles(w, PROFILE_COLS), P.seasonal_extremes(w, PROFILE_COLS), P.snapshot_metadata(w, now())


@query(f"""WITH {CHUNKS}, {ANNUAL[len(WH) + 2 :]} SELECT municipio || '_' || CAST(mes AS VARCHAR) AS doc_id, municipio, mes, mes_nome, text FROM monthly
UNION ALL SELECT e.municipio || '_0', e.municipio, 0, 'anual', {ANNUAL_TEXT} {ANNUAL_FROM}""")
def build_docs(spark, sf):
    return P.build_docs(*_docs(spark, sf))


@query("""WITH d AS (SELECT source AS municipio, doc_id, 'old' AS version FROM documents),
n AS (SELECT source AS municipio, doc_id + 1000000 AS doc_id, 'new' AS version FROM documents
 WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 0 AND doc_id % 3 = 0)
SELECT * FROM d WHERE municipio NOT IN (SELECT municipio FROM n) UNION ALL SELECT * FROM n""")
def replace_docs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("municipio"), "doc_id")
    old = d.withColumn("version", F.lit("old"))
    even = (F.substring("municipio", 4, 9).cast("int") % 2 == 0) & (F.col("doc_id") % 3 == 0)
    new = d.where(even).select("municipio", (F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("version"))
    return P.replace_docs(old, new)


@query(f"WITH {WH} SELECT municipio, min(data_hora) AS start, max(data_hora) AS \"end\", count(*) AS row_count FROM wh GROUP BY 1")
def series_extent(spark, sf):
    return E.series_extent(wh(spark, sf))


@query(f"WITH {WH} SELECT data_hora, {sr('temp_max_c', 'temp_ar_c', 'temp_min_c')} FROM wh ORDER BY data_hora")
def series_projection(spark, sf):
    cols = ["temp_max_c", "temp_ar_c", "temp_min_c"]
    return rounded(E.series_projection(wh(spark, sf), cols), *cols)


@query(f"WITH {WH} SELECT DISTINCT year(data_hora) AS ano FROM wh")
def distinct_values(spark, sf):
    return E.distinct_values(wh(spark, sf).select(F.year("data_hora").alias("ano")), "ano")


@query(f"""WITH l AS (SELECT length(text) AS n FROM documents),
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM l)
SELECT (SELECT count(*) FROM l) AS n, {sr('(SELECT avg(n) FROM l) AS mean', '(SELECT stddev_pop(n) FROM l) AS stdev', digits=4)},
(SELECT n FROM o WHERE i = CAST(floor(0.95::DOUBLE * (total - 1)) AS BIGINT)) AS p95""")
def length_stats(spark, sf):
    return rounded(E.length_stats(table(spark, sf, "documents"), "text"), "mean", "stdev", digits=4)


@query(" UNION ALL ".join(
    f"SELECT count(*) AS n_examples, '{c}' AS metric, {sr(f'avg({c}) AS score')} FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def score_rollup(spark, sf):
    return rounded(E.score_rollup(table(spark, sf, "lineitem")), "score")


@query("""SELECT count(*) AS years, CAST(sum(n) AS BIGINT) AS csv_files
FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)""")
def ingest_summary(spark, sf):
    o = table(spark, sf, "orders")
    files = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("csv_count"))
    return E.ingest_summary(files)


@query("""SELECT source AS municipio, count(DISTINCT lang) AS files, count(*) AS rows FROM documents GROUP BY 1""")
def station_summary(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("municipio"), "lang")
    return E.station_summary(d, "lang")
