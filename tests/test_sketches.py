import datetime as dt

import numpy as np

from stationflow.operators import sketches as K

PROBS = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


def test_merged_sketches_stay_within_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", dt.datetime(2020 + i % 3, 1 + i % 2, 1), float(v), None if i % 5 else float("nan")) for i, v in enumerate(rng.lognormal(size=12_000))]
    df = spark.createDataFrame(rows, "municipio string, data_hora timestamp, temp_ar_c double, precipitacao_total_mm double").repartition(6)
    parts = [K.quantile_sketches(df.where(f"year(data_hora) = {y}"), ["temp_ar_c", "precipitacao_total_mm", "absent"]) for y in (2020, 2021, 2022)]
    together = K.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    for sketches in (together, K.quantile_sketches(df, ["temp_ar_c"])):
        found = K.sketched_quantiles(sketches, PROBS)
        errors = K.rank_errors(df, found, PROBS).collect()
        assert len(errors) == 2 and all(r.column == "temp_ar_c" and r.n == 6_000 for r in errors)
        assert all(r[p] <= K.RANK_ERROR for r in errors for p in PROBS)
    assert K.merged(parts[0].limit(0)).count() == 0


def test_rank_errors_see_a_wrong_estimate(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), float(i)) for i in range(100)], "municipio string, data_hora timestamp, temp_ar_c double")
    wrong = spark.createDataFrame([("a", 1, "temp_ar_c", 100, 50.0, 4.0)], "municipio string, month int, column string, n long, p5 double, p95 double")
    r = K.rank_errors(df, wrong, {"p5": 0.05, "p95": 0.95}).first()
    assert (round(r.p5, 6), round(r.p95, 6)) == (0.45, 0.9)
