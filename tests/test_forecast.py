import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from stationflow.functions import numbers as N, text as X, times as D
from stationflow.operators import accuracy as A, forecast as C
from stationflow.sources import sinks

REF = dt.datetime(2024, 1, 1)


def points(n, start=REF, value=lambda i: 20.0 + i):
    return json.dumps([{"timestamp": (start + dt.timedelta(hours=i + 1)).isoformat(), "temp_ar_c": value(i)} for i in range(n)])


def log(spark, horizon=72, n=None, ident="p1", station="a", ref=REF):
    return spark.createDataFrame(
        [(ident, station, ref, horizon, points(n or horizon, ref))],
        "id string, municipio string, reference_date timestamp, horizon int, forecast_json string",
    )


def no_accuracy(spark):
    return spark.createDataFrame([], "prediction_id string")


def lit(t):
    return F.lit(t)


@pytest.mark.parametrize("hours,count", [(73, 1), (72, 0), (71, 0)])
def test_pending_after_the_horizon(spark, hours, count):
    now = lit(REF + dt.timedelta(hours=hours))
    assert A.pending(log(spark), no_accuracy(spark), now).count() == count


def test_evaluated_once(spark):
    done = spark.createDataFrame([("p1",), ("p1",)], "prediction_id string")
    assert A.pending(log(spark), done, lit(REF + dt.timedelta(days=30))).count() == 0


@pytest.mark.parametrize("p,a,want", [
    ([10, 10], [8, 12], (2, 2, (2 / 8 + 2 / 12) / 2, 2)),
    ([1, 2], [0, 4], (1.5, math.sqrt(2.5), 0.5, 2)),
    ([1, 1], [0, 0], (1, 1, None, 2)),
])
def test_error_columns(spark, p, a, want):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(p, a)], "p double, a double")
    got = df.agg(*N.error_columns(F.col("p"), F.col("a"))).first()
    assert tuple(got) == pytest.approx(want)


def test_training_errors_are_percent(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 3, "p double, a double")
    assert tuple(df.agg(*N.training_error_columns(F.col("p"), F.col("a"))).first()) == (1.0, 1.0, 100.0)
    zero = spark.createDataFrame([(1.0, 0.0)], "p double, a double")
    assert zero.agg(*N.training_error_columns(F.col("p"), F.col("a"))).first()["mape_pct"] == pytest.approx(1e8)


@pytest.mark.parametrize("n,start,end,want", [(72, 1, 24, (24, 0.0)), (72, 25, 72, (48, 24.0)), (10, 1, 100, (10, 0.0)), (5, 9, 12, (0, None))])
def test_forecast_slice(spark, n, start, end, want):
    df = spark.createDataFrame([(points(n, value=float),)], "j string")
    got = df.select(A.slice_forecast(A.decode_forecast("j"), lit(start), lit(end)).alias("v")).first()["v"]
    assert (len(got), got[0] if got else None) == want


def test_accuracy_of_one_forecast(spark, hourly):
    series = hourly(200, lambda i: {"temp_ar_c": 20.0 + i})
    out = A.accuracy_by_bucket(log(spark), series, no_accuracy(spark), lit(REF + dt.timedelta(days=9)))
    rows = {r["bucket"]: r for r in out.collect()}
    assert set(rows) == {"near", "mid"}  # no far bucket at 72 hours
    assert rows["near"]["n_points"] == 24 and rows["mid"]["n_points"] == 48
    assert rows["near"]["mae"] == pytest.approx(1.0)  # hour h holds 20 + h, forecast 20 + h - 1


def test_pairs_go_by_position_or_by_hour(spark, hourly):
    series = hourly(200, lambda i: {"temp_ar_c": 20.0 + i}, skip={3})
    now = lit(REF + dt.timedelta(days=9))
    due = A.pending(log(spark), no_accuracy(spark), now)
    actual = A.actuals_for(due, series)
    by_pos = A.pair_errors(due, actual).where("bucket = 'near'").orderBy("position").collect()
    assert len(by_pos) == 23 and [r["predicted"] for r in by_pos] == [20.0 + i for i in range(23)]
    assert by_pos[2]["actual"] == 24.0
    by_hour = A.pair_errors(due, actual, "timestamp").where("bucket = 'near'").orderBy("position").collect()
    assert all(r["actual"] - r["predicted"] == 1.0 for r in by_hour) and len(by_hour) == 23
    with pytest.raises(ValueError):
        A.pair_errors(due, actual, "x")


def test_short_forecast_is_paired_to_its_end(spark, hourly):
    series = hourly(200, lambda i: {"temp_ar_c": 20.0 + i})
    out = A.accuracy_by_bucket(log(spark, 72, n=30), series, no_accuracy(spark), lit(REF + dt.timedelta(days=9)))
    assert {r["bucket"]: r["n_points"] for r in out.collect()} == {"near": 24, "mid": 6}


def test_no_actuals_no_row(spark, hourly):
    now = lit(REF + dt.timedelta(days=9))
    assert A.accuracy_by_bucket(log(spark), hourly(200, station="b"), no_accuracy(spark), now).count() == 0
    few = A.accuracy_by_bucket(log(spark), hourly(30), no_accuracy(spark), now, min_points=20)
    assert [r["bucket"] for r in few.collect()] == ["near"]


def accuracy_rows(spark, rows):
    return spark.createDataFrame(rows, "prediction_id string, bucket string, mae double, evaluated_at timestamp")


def test_upsert_keeps_one_row(spark, tmp_path):
    old = accuracy_rows(spark, [("p", "near", 1.0, REF), ("q", "near", 5.0, REF)])
    new = accuracy_rows(spark, [("p", "near", 2.0, REF)])
    got = {(r[0], r[1]): r["mae"] for r in A.upsert_accuracy(old, new).collect()}
    assert got == {("p", "near"): 2.0, ("q", "near"): 5.0}
    assert A.upsert_accuracy(old, old.limit(0)).count() == 2
    root = str(tmp_path / "acc")
    sinks.save_accuracy(old, root, 0, spark)
    path = sinks.save_accuracy(new, root, 1, spark)
    assert spark.read.parquet(path).count() == 2


def test_log_rows(spark, tmp_path):
    f = spark.createDataFrame(
        [("tft", "3", "g", REF, 2, [(REF + dt.timedelta(hours=1), 20.0), (REF + dt.timedelta(hours=2), 21.5)])],
        "model_type string, model_version string, group_id string, reference_date timestamp, horizon int, "
        "points array<struct<timestamp:timestamp,temp_ar_c:double>>",
    )
    sinks.append_predictions(f, str(tmp_path / "log"), lit(REF))
    sinks.append_predictions(f, str(tmp_path / "log"), lit(REF))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len({r["id"] for r in rows}) == 2 and rows[0]["model_key"] == "tft_2"
    assert json.loads(rows[0]["forecast_json"])[1] == {"timestamp": "2024-01-01T02:00:00", "temp_ar_c": 21.5}


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id string, municipio string, reference_date timestamp, horizon int, model_type string")


def test_batch_forecast(spark, hourly):
    at = REF + dt.timedelta(days=8)
    asked = requests(spark, [("ok", "a", at, 72, "tft"), ("few", "a", at, 336, "tft"), ("unknown", "a", at, 72, "lstm")])
    status, pts = C.batch_forecast(asked, hourly(24 * 10, lambda i: {"temp_ar_c": float(i % 24)}), C.model_catalogue(spark))
    assert {r[0]: r[1] for r in status.collect()} == {"ok": "ok", "few": "insufficient_rows", "unknown": "model_not_found"}
    rows = pts.orderBy("hour_ahead").collect()
    assert [r["hour_ahead"] for r in rows] == list(range(1, 73))
    assert rows[0]["timestamp"] == at + dt.timedelta(hours=1)
    assert all(r["temp_ar_c"] == float(r["timestamp"].hour) for r in rows)


def test_own_scorer(spark, hourly):
    at = REF + dt.timedelta(days=8)
    scorer = C.pandas_scorer(lambda ctx, h: [float(len(ctx))] * (h + 5), ["temp_ar_c"])
    _, pts = C.batch_forecast(requests(spark, [("r", "a", at, 72, "tft")]), hourly(240), C.model_catalogue(spark), scorer)
    assert pts.count() == 72 and pts.first()["temp_ar_c"] == 168.0


def test_expand_points(spark):
    df = spark.createDataFrame([(REF, 2, [1.0, 2.0, 3.0]), (REF, 5, [1.0])], "reference_date timestamp, horizon int, values array<double>")
    rows = C.expand_points(df).collect()
    assert [(r["hour_ahead"], r["temp_ar_c"]) for r in rows] == [(1, 1.0), (2, 2.0), (1, 1.0)]
    assert rows[1]["timestamp"] == REF + dt.timedelta(hours=2)


def test_periods(spark):
    pts = spark.createDataFrame(
        [("f", REF + dt.timedelta(hours=h), 30.0 if h in (13, 15) else 20.0 + h / 10) for h in range(1, 73)],
        "id string, timestamp timestamp, temp_ar_c double",
    )
    day = C.period_summary(pts, ["id"]).where("target_date = '2024-01-01'")
    rows = {r["period"]: r for r in day.collect()}
    assert rows["madrugada"]["n_hours"] == 6  # the first point is 01:00
    assert rows["tarde"]["peak_hour"] == "13h"  # the first of equal peaks
    one = C.period_report(pts, ["id"], "2024-01-01", "manha").first()
    assert [h["hour"] for h in one["hourly"]] == ["07h", "08h", "09h", "10h", "11h"] and one["temperature_avg_c"] == 20.9
    assert C.period_report(pts, ["id"], "2025-01-01", "manha").first()["error"] == "sem_dados"


def test_window_stats_and_sample(spark, hourly):
    asked = spark.createDataFrame([("r", "a", REF + dt.timedelta(hours=60))], "request_id string, municipio string, reference_date timestamp")
    row = C.window_stats(asked, hourly(100), ["temp_ar_c"]).first()
    assert (row["min"], row["max"], row["window_rows"]) == (13.0, 60.0, 48)
    sample = C.window_sample(asked, hourly(100), ["temp_ar_c"]).collect()
    assert sorted(r["temp_ar_c"] for r in sample) == [float(i) for i in range(37, 61)]


def test_step_evaluation(spark, hourly):
    stats = spark.createDataFrame([("a", 10.0, 2.0)], "municipio string, temp_ar_c__mean double, temp_ar_c__std double")
    samples = spark.createDataFrame(
        [("a", i, [[float(i)], [float(i + 1)]], [[0.0], [1.0]]) for i in range(10)],
        "municipio string, start_idx bigint, y array<array<float>>, y_pred array<array<float>>",
    )
    out = C.evaluate_step(samples, 1, 0, ["temp_ar_c"], stats, max_points=4).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["actual"], r["predicted"]) for r in out] == [(i, 10.0 + 2 * (i + 1), 12.0) for i in (0, 3, 6, 9)]
    with pytest.raises(IndexError):
        C.evaluate_step(samples, 0, 1, ["temp_ar_c"], stats)
    bad = samples.withColumn("y_pred", F.array(F.array(F.lit(0.0))))
    with pytest.raises(Exception, match="shapes"):
        C.evaluate_step(bad, 0, 0, ["temp_ar_c"], stats).collect()


def test_ridge_finds_a_linear_series(spark, hourly):
    from stationflow.operators.series import temporal_split

    df = temporal_split(hourly(200, lambda i: {"temp_ar_c": 3.0 + 2.0 * i, "x": float(i % 5)}))
    rows = C.fit_per_station(df, ["temp_ar_c", "x"], penalties=(0.0, 1e6)).collect()
    best = [r for r in rows if r["is_best"]]
    assert len(rows) == 2 and len(best) == 1 and best[0]["penalty"] == 0.0
    assert best[0]["mae"] == pytest.approx(0.0, abs=1e-5)


def test_buckets(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, 24, 25, 72, 73, 9999)], "h int").select("h", D.horizon_bucket("h").alias("b"))
    assert {r["h"]: r["b"] for r in df.collect()} == {0: None, 1: "near", 24: "near", 25: "mid", 72: "mid", 73: "far", 9999: "far"}


def test_request_key(spark):
    import hashlib

    df = spark.createDataFrame([("tft", 72)], "m string, h int")
    want = hashlib.sha256(b"tft:72:x").hexdigest()
    assert df.select(X.request_key("m", "h", lit("x"))).first()[0] == want
