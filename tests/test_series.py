import bisect
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationflow import schema as S
from stationflow.operators import scaling, series as Q, windows as W
from stationflow.sources import features as SF, sinks


def clean_rows(i):
    return {
        "temp_ar_c": 25 + 5 * math.sin(2 * math.pi * i / 24), "umidade_rel_ar_percent": 60.0 + i % 7,
        "pressao_atm_estacao_mb": 1000.0 + i % 11, "precipitacao_total_mm": float(i % 3), "vento_vel_ms": 1.0,
    }


def expected_features(pdf):
    out = pdf.sort_values("data_hora").copy()
    h = out["data_hora"].dt.hour
    out["hora_sin"], out["hora_cos"] = np.sin(2 * np.pi * h / 24), np.cos(2 * np.pi * h / 24)
    for k in (1, 24):
        out[f"temp_lag_{k}h"] = out["temp_ar_c"].shift(k)
    for n in (6, 12):
        out[f"temp_ma_{n}h"] = out["temp_ar_c"].rolling(n, min_periods=1).mean()
        out[f"pressao_ma_{n}h"] = out["pressao_atm_estacao_mb"].rolling(n, min_periods=1).mean()
    out["pressao_tendencia_1h"] = out["pressao_atm_estacao_mb"].diff(1)
    out["temp_tendencia_1h"] = out["temp_ar_c"].diff(1)
    return out


def test_feature_table(hourly):
    out = Q.feature_table(hourly(100, clean_rows))
    assert out.count() == 76
    assert "vento_vel_ms" not in out.columns
    assert set(S.FEATURE_COLUMNS) <= set(out.columns)
    assert out.where(F.abs(F.col("hora_sin") ** 2 + F.col("hora_cos") ** 2 - 1) > 1e-12).count() == 0


@pytest.mark.parametrize("hours", [1, 5, 13, 24 * 30])
def test_features_do_not_depend_on_chunks(hourly, hours):
    """Gaps, nulls and chunks shorter than the longest lag."""
    df = hourly(300, clean_rows, skip=set(range(40, 95)) | {3, 150, 151, 299})
    odd = df.withColumn("temp_ar_c", F.when(F.hour("data_hora") != 7, F.col("temp_ar_c")))
    got = Q.add_series_features(
        odd.select("municipio", "data_hora", "temp_ar_c", "pressao_atm_estacao_mb"),
        lags={f"temp_lag_{k}h": ("temp_ar_c", k) for k in (1, 24)},
        means={f"{n}_ma_{k}h": (c, k) for k in (6, 12) for n, c in (("temp", "temp_ar_c"), ("pressao", "pressao_atm_estacao_mb"))},
        diffs={"pressao_tendencia_1h": "pressao_atm_estacao_mb", "temp_tendencia_1h": "temp_ar_c"},
        hours=hours,
    ).toPandas().sort_values("data_hora").reset_index(drop=True)
    want = expected_features(odd.toPandas()).reset_index(drop=True)
    for c in got.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_features_without_null_removal(hourly):
    out = Q.feature_table(hourly(60, clean_rows), lags=[2, 12, 48], sizes=[3, 6, 12, 24], seasonal=False, remove_nan=False)
    assert out.count() == 60 and "hora_sin" not in out.columns and "temp_ma_24h" in out.columns


def test_missing_columns(hourly):
    with pytest.raises(ValueError, match="missing columns"):
        Q.feature_table(hourly(5))
    kept, missing = Q.select_available(hourly(5), ["temp_ar_c", "x"])
    assert kept.columns == ["temp_ar_c"] and missing == ["x"]


def test_lag_by_time_sees_gaps(hourly):
    df = hourly(5, skip={2})
    rows = Q.add_lags(df, lags=[1], mode="rows").orderBy("data_hora").collect()
    assert [r["temp_lag_1h"] for r in rows] == [None, 0.0, 1.0, 3.0]
    rows = Q.add_lags(df, lags=[1], mode="time").orderBy("data_hora").collect()
    assert [r["temp_lag_1h"] for r in rows] == [None, 0.0, None, 3.0]


def test_positions_over_many_chunks(hourly):
    df = hourly(200, skip=set(range(50, 120)))
    rows = Q.index_series(df, hours=7, total="n").orderBy("data_hora").collect()
    assert [r["time_idx"] for r in rows] == list(range(130)) and rows[0]["n"] == 130


@pytest.mark.parametrize("n,train,val,sizes", [(100, 0.7, 0.15, (70, 15, 15)), (100, 0.8, 0.1, (80, 10, 10)), (7, 0.8, 0.1, (5, 1, 1))])
def test_split(hourly, n, train, val, sizes):
    out = Q.temporal_split(hourly(n), train, val)
    counts = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert tuple(counts[k] for k in ("train", "val", "test")) == sizes
    assert out.groupBy("split").agg(F.min("split_idx").alias("m")).where("m <> 0").count() == 0


@pytest.mark.parametrize("n,length,horizon,count", [(100, 24, 10, 67), (50, 12, 6, 33), (10, 8, 3, 0)])
def test_windows(hourly, n, length, horizon, count):
    df = Q.temporal_split(hourly(n, lambda i: {"temp_ar_c": float(i), "x": float(-i)}), 1.0, 0.0)
    out = W.make_windows(df, ["temp_ar_c", "x"], ["temp_ar_c"], length, horizon)
    rows = out.orderBy("start_idx").collect()
    assert len(rows) == count == W.window_index(df, length, horizon).count()
    for r in rows[:3] + rows[-3:]:
        s = r["start_idx"]
        assert [v[0] for v in r["x"]] == [float(s + i) for i in range(length)]
        assert [v[0] for v in r["y"]] == [float(s + length + i) for i in range(horizon)]


def test_windows_across_blocks(hourly, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 16)
    df = Q.temporal_split(hourly(100), 0.8, 0.1)
    out = W.make_windows(df, ["temp_ar_c"], ["temp_ar_c"], 6, 3)
    counts = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 72, "val": 2, "test": 2}
    got = out.where("split = 'train'").orderBy("start_idx").collect()
    assert all([v[0] for v in r["x"]] == [float(r["start_idx"] + i) for i in range(6)] for r in got)
    assert W.make_windows(df, ["temp_ar_c"], ["temp_ar_c"], 6, 3, stride=5).where("split = 'train'").count() == 15


def test_scaler_uses_population_deviation_of_training_rows(hourly):
    df = hourly(10, lambda i: {"temp_ar_c": float(i), "flat": 3.0})
    stats = scaling.fit_scaler(df, ["temp_ar_c", "flat"])
    row = stats.first()
    assert row["temp_ar_c__std"] == pytest.approx(np.std(range(10))) and row["flat__std"] == 1.0
    there = scaling.apply_scaler(df, stats, ["temp_ar_c", "flat"])
    assert there.agg(F.avg("temp_ar_c")).first()[0] == pytest.approx(0)
    back = scaling.inverse_scaler(there, stats, {"temp_ar_c": "temp_ar_c"})
    assert sorted(round(r["temp_ar_c"], 9) for r in back.collect()) == [float(i) for i in range(10)]


def ask(spark, rows):
    return spark.createDataFrame(rows, "request_id string, municipio string, reference_date timestamp")


@pytest.mark.parametrize("hours", [None, 3, 1000])
def test_last_rows_before(spark, hourly, hours):
    df = hourly(100, skip=set(range(30, 60)))
    at = dt.datetime
    asked = ask(spark, [("r1", "a", at(2024, 1, 5)), ("r2", "a", at(2024, 1, 2)), ("r3", "a", at(2023, 1, 1)), ("r4", "zz", at(2024, 1, 5)), ("r5", "a", at(2030, 1, 1))])
    status, rows = W.last_n_before(asked, df, 40, hours=hours)
    got = {r["request_id"]: (r["status"], r["rows_until"]) for r in status.collect()}
    assert got == {"r1": ("ok", 67), "r2": ("insufficient_rows", 25), "r3": ("insufficient_rows", 0), "r4": ("insufficient_rows", 0), "r5": ("ok", 70)}
    r1 = [r["temp_ar_c"] for r in rows.where("request_id = 'r1'").orderBy("position").collect()]
    assert r1 == [float(i) for i in [*range(0, 30), *range(60, 97)]][-40:]
    assert rows.groupBy("request_id").count().count() == 2


def test_last_rows_of_a_station_with_many_spans(spark):
    """100,000 spans of one station: no row holds a list, the series is read twice, results are those of the row numbers."""
    first = dt.datetime(2010, 1, 1)
    hour = F.timestamp_seconds(F.unix_seconds(F.lit(first).cast("timestamp")) + F.col("id") * 3600)
    series = spark.range(100_000).where("id % 1000 < 900").select(F.lit("a").alias("municipio"), hour.alias("data_hora"), F.col("id").cast("double").alias("temp_ar_c"))
    at = [0, 5, 899, 950, 1000, 50_003, 99_999, 150_000]
    asked = ask(spark, [(f"r{i}", "a", first + dt.timedelta(hours=i)) for i in at])
    status, rows = W.last_n_before(asked, series, 7, hours=1)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Range (0, 100000") == 1  # the other reading made the index
    assert [f.dataType.simpleString() for f in W.span_index(series, hours=1).schema] == ["string", "bigint", "bigint", "bigint", "bigint"]
    have = [i for i in range(100_000) if i % 1000 < 900]
    want = {f"r{i}": [float(x) for x in have[: bisect.bisect_right(have, i)][-7:]] for i in at}
    counts = {r.request_id: (r.rows_until, r.status) for r in status.collect()}
    assert counts == {f"r{i}": (n := bisect.bisect_right(have, i), "ok" if n >= 7 else "insufficient_rows") for i in at}
    got = {}
    for r in rows.orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append(r.temp_ar_c)
    assert got == {k: v for k, v in want.items() if len(v) == 7}


def test_zero_rows_wanted_gives_none(spark, hourly):
    status, rows = W.last_n_before(ask(spark, [("r", "a", dt.datetime(2024, 1, 2))]), hourly(50), 0)
    assert rows.count() == 0 and status.first()["status"] == "insufficient_rows"


def test_interval_ends_are_included(spark, hourly):
    ref = dt.datetime(2024, 1, 1, 10, 30)
    asked = spark.createDataFrame(
        [("a", ref + dt.timedelta(hours=1), ref + dt.timedelta(hours=6)), ("a", dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 7))],
        "municipio string, s timestamp, e timestamp",
    )
    out = W.interval_join(asked, hourly(48), "s", "e", hours=3)
    assert sorted(r["temp_ar_c"] for r in out.collect()) == [5.0, 6.0, 7.0, 12.0, 13.0, 14.0, 15.0, 16.0]


def test_serving_read(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(hours=i), v) for i, v in enumerate([1.0, float("inf"), 2.0, float("-inf")])]
    spark.createDataFrame(rows, "municipio string, data_hora timestamp, temp double").write.parquet(str(tmp_path / "d"))
    df, missing = SF.read_serving(spark, str(tmp_path / "d"), ["temp", "none"])
    got = df.orderBy("time_idx").collect()
    assert [r["temp"] for r in got] == [1.0, 2.0] and [r["time_idx"] for r in got] == [0, 1]
    assert missing == ["none"] and got[0]["group"] == "station_1"
    with pytest.raises(FileNotFoundError):
        SF.read_serving(spark, str(tmp_path / "absent"))


def test_serving_prefers_model_root(spark, tmp_path, hourly):
    hourly(8).repartition(4).write.parquet(str(tmp_path / "m" / "v1" / "serving_data"))
    hourly(5).repartition(2).write.parquet(str(tmp_path / "m" / "v2" / "serving_data"))
    hourly(9).write.parquet(str(tmp_path / "d"))
    df, _ = SF.read_serving(spark, str(tmp_path / "d"), ["temp_ar_c"], str(tmp_path / "m"))
    assert df.count() == 8


def test_strict_read(spark, tmp_path, hourly):
    root = str(tmp_path / "f")
    summary = sinks.write_features(hourly(5, lambda i: {"x": float(i) if i else None}), root).first()
    assert summary["rows_processed"] == 5 and summary["columns"] == "x"
    assert SF.read_features(spark, root, ["x"], []).count() == 4
    with pytest.raises(ValueError, match="missing columns"):
        SF.read_features(spark, root, ["y"], [])
    with pytest.raises(FileNotFoundError):
        SF.read_features(spark, root + "x", ["x"], [])


def test_serving_file_choice(spark):
    files = spark.createDataFrame(
        [("/spec/a/1.parquet", 10), ("/spec/salvador/2.parquet", 5), ("/spec/salvador/3.parquet", 5), ("/spec/b/4.parquet", 99)],
        "path string, length bigint",
    )
    pick = lambda p: SF.pick_serving_file(files, p).first()["path"]
    assert pick("a") == "/spec/a/1.parquet" and pick("zz") == "/spec/salvador/2.parquet"
    assert SF.pick_serving_file(files.where("path not like '%salvador%'"), None).first()["path"] == "/spec/b/4.parquet"


def test_stride_and_tail(hourly):
    df = hourly(101)
    assert Q.stride_sample(df, 10).count() == 10 and Q.stride_sample(df, 0).count() == 101
    assert sorted(r["temp_ar_c"] for r in Q.tail_rows(df, 3).collect()) == [98.0, 99.0, 100.0]


def test_running_aggregates_over_chunks(hourly):
    df = hourly(60, lambda i: {"v": float((i * 37) % 23)})
    out = Q.running(df, ["municipio"], ["data_hora"], Q.time_chunk("data_hora", 7),
                    {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "n": ("count", F.col("v"))})
    pdf = out.toPandas().sort_values("data_hora")
    v = pd.Series([(i * 37) % 23 for i in range(60)], dtype=float)
    for name, want in (("s", v.cumsum()), ("lo", v.cummin()), ("hi", v.cummax()), ("n", pd.Series(range(1, 61)))):
        np.testing.assert_allclose(pdf[name].to_numpy(dtype=float), want.to_numpy(dtype=float))
