import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.operators import gram as G


def rows(spark, n=400, days=20):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        x, z = rng.normal(size=2).round(4).tolist()
        y = None if i % 50 == 7 else 1.5 + 2 * x - z + round(float(rng.normal()), 3) / 10
        out.append((f"s{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=int(i % days) * (1 + i % 2)), x, z, y))
    return out, spark.createDataFrame(out, "municipio string, day date, x double, z double, y double").repartition(5)


def direct(data, keep):
    a = np.array([(1.0, r[2], r[3], r[4]) for r in data if r[4] is not None and keep(r)])
    return (a.T @ a)[np.triu_indices(4)] if len(a) else None


def test_windows_are_differences_of_running_sums(spark, monkeypatch):
    monkeypatch.setattr(G, "DAY_BLOCK", 4)
    data, df = rows(spark)
    sums = G.gram_sums(df, ["municipio", "day"], ["x", "z"], "y")
    got = {(r.municipio, r.day): [float(r[n]) for n in G.names(2)] for r in G.rolling(sums, 7, 2).collect()}
    assert set(got) == {(r[0], r[1]) for r in data if r[4] is not None}
    for (station, day), g in got.items():
        want = direct(data, lambda r: r[0] == station and day - dt.timedelta(days=7) < r[1] <= day)
        assert g == pytest.approx(want.tolist(), abs=1e-7)
    whole = {r.municipio: [r[n] for n in G.names(2)] for r in G.merged(sums, ["municipio"], 2).collect()}
    once = {r.municipio: [r[n] for n in G.names(2)] for r in G.gram_sums(df, ["municipio"], ["x", "z"], "y").collect()}
    assert whole == once  # exact


def test_models_from_sums(spark):
    data, df = rows(spark)
    sums = G.gram_sums(df, ["municipio"], ["x", "z"], "y")
    out = G.solved(sums, 2, (0.0, 5.0)).withColumn("mse", G.squared_error(2)).collect()
    for r in out:
        a = np.array([(1.0, d[2], d[3], d[4]) for d in data if d[0] == r.municipio and d[4] is not None])
        ridge = np.diag([0.0, r.penalty, r.penalty])
        w = np.linalg.solve(a[:, :3].T @ a[:, :3] + ridge, a[:, :3].T @ a[:, 3])
        assert r.weights == pytest.approx(w.tolist(), abs=1e-6)
        assert r.mse == pytest.approx(((a[:, :3] @ w - a[:, 3]) ** 2).mean(), abs=1e-7)
    assert len(out) == 6


def test_features_that_repeat_each_other(spark):
    df = spark.createDataFrame([("a", float(i), float(i), 2.0 * i + 1) for i in range(10)] + [("one", 1.0, 1.0, 3.0)], "municipio string, x double, z double, y double")
    out = {r.municipio: r for r in G.solved(G.gram_sums(df, ["municipio"], ["x", "z"], "y"), 2).withColumn("mse", G.squared_error(2)).collect()}
    assert out["a"].weights == pytest.approx([1.0, 1.0, 1.0]) and out["a"].mse == pytest.approx(0, abs=1e-7)
    assert out["one"].weights == pytest.approx([3.0, 0.0, 0.0])
    assert G.solved(G.gram_sums(df.limit(0), ["municipio"], ["x"], "y"), 1).count() == 0
