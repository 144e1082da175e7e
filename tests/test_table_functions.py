import datetime as dt

import pytest

from stationflow.functions import table_functions as T

AT = dt.datetime(2024, 1, 10, 22)
SCHEMA = "id string, n int, x double, reference_date timestamp_ntz, horizon int"


@pytest.fixture
def context(spark):
    """Two windows out of order, one with a null and a NaN, and one that is too short."""
    T.register(spark)
    rows = [("a", i, float(i), AT, 5) for i in (3, 0, 2, 1)]
    rows += [("b", 0, 7.0, AT, 3), ("b", 1, None, AT, 3), ("b", 2, float("nan"), AT, 3), ("c", 0, 1.0, AT, 9)]
    return spark.createDataFrame(rows, SCHEMA)


def sql(spark, text, **tables):
    return [tuple(r) for r in spark.sql(text, **tables).collect()]


def test_forecast_repeats_the_season(spark, context):
    got = sql(spark, """SELECT id, hour_ahead, value FROM season_forecast(TABLE({c}), season => 3, key => 'id', place => 'n', value => 'x')
        ORDER BY 1, 2""", c=context)
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 1.0), ("a", 5, 2.0),
                   ("b", 1, 7.0), ("b", 2, None), ("b", 3, None)]


def test_window_stats_skip_missing_values(spark, context):
    got = sql(spark, """SELECT * FROM window_stats(TABLE({c}), 'x', key => 'id', place => 'n') ORDER BY 1""", c=context)
    assert got == [("a", "x", 4, 0.0, 3.0, 1.5), ("b", "x", 3, 7.0, 7.0, 7.0), ("c", "x", 1, 1.0, 1.0, 1.0)]


def test_functions_can_be_chained(spark, context):
    got = sql(spark, """WITH p AS (SELECT id, reference_date + make_dt_interval(0, hour_ahead) AS t, value
          FROM season_forecast(TABLE({c}), season => 3, key => 'id', place => 'n', value => 'x'))
        SELECT id, CAST(target_date AS STRING), period, temperature_min_c, temperature_max_c, temperature_avg_c, peak_hour, n_hours
        FROM period_stats(TABLE(p), key => 'id', place => 't', value => 'value') ORDER BY 1, 2""", c=context)
    assert got == [("a", "2024-01-10", "noite", 1.0, 1.0, 1.0, "23h", 1), ("a", "2024-01-11", "madrugada", 1.0, 3.0, 2.0, "01h", 4),
                   ("b", "2024-01-10", "noite", 7.0, 7.0, 7.0, "23h", 1)]


def test_empty_table(spark, context):
    empty = context.where("false")
    assert sql(spark, "SELECT * FROM window_stats(TABLE({c}), 'x', key => 'id', place => 'n')", c=empty) == []
    assert sql(spark, "SELECT * FROM season_forecast(TABLE({c}), key => 'id', place => 'n', value => 'x')", c=empty) == []


@pytest.mark.parametrize("call, why", [
    ("season_forecast(TABLE({c}), key => 'id', place => 'n', value => 'y')", "no column y"),
    ("season_forecast(TABLE({c}), season => 0, key => 'id', place => 'n', value => 'x')", "1 at least"),
    ("window_stats(TABLE({c}), 'x,z', key => 'id', place => 'n')", "no column z"),
    ("period_stats(TABLE({c}), key => 'id', place => 7)", "name of a column"),
    ("period_stats(TABLE(SELECT id, x, CAST(reference_date AS TIMESTAMP) AS t FROM {c}), key => 'id', place => 't', value => 'x')", "TIMESTAMP_NTZ"),
])
def test_wrong_calls_fail_before_they_run(spark, context, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql("SELECT * FROM " + call, c=context)
