import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationflow.functions import numbers as N
from stationflow.operators import eda as E, experiments as R, profiles as P, quantiles as K
from stationflow.sources import sinks

ROWS = [
    ("2024-01-01 00:00", 31.0, 25.0, 20.0, 10.0), ("2024-01-01 01:00", 29.0, 24.0, 19.0, 0.0),
    ("2024-06-15 12:00", 25.0, None, 15.0, 5.0), ("2024-12-31 23:00", 28.0, 26.0, 21.0, 1.0),
    ("2025-01-01 00:00", 33.0, 27.0, 22.0, 12.0), ("2025-01-01 05:00", 30.0, 22.0, 18.0, 0.0),
    ("2025-07-01 12:00", 20.0, 15.0, 10.0, 7.0), ("2025-07-02 12:00", 21.0, 16.0, 11.0, None),
]


@pytest.fixture
def frame(spark):
    data = [("a", dt.datetime.fromisoformat(t), *v) for t, *v in ROWS]
    return spark.createDataFrame(
        data, "municipio string, data_hora timestamp, temp_max_c double, temp_ar_c double, temp_min_c double, precipitacao_total_mm double"
    )


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_rain_and_extreme_days(frame):
    assert {k: r["precipitacao_total_mm"] for k, r in as_dict(E.rain_by_year(frame), "ano").items()} == {2024: 16.0, 2025: 19.0}
    assert E.rain_by_year(frame.drop("precipitacao_total_mm")) is None
    assert {k: r["qtd_dias"] for k, r in as_dict(E.extreme_days(frame, 30), "ano").items()} == {2024: 1, 2025: 1}
    assert {k: r["qtd_dias"] for k, r in as_dict(E.extreme_days(frame, 11, "min"), "ano").items()} == {2024: 0, 2025: 2}


def test_missing(frame):
    rows = as_dict(E.missing_summary(frame), "column")
    assert rows["temp_ar_c"]["percent"] == 12.5 and set(rows) == {"temp_ar_c", "precipitacao_total_mm"}


def test_aggregations_by_name(frame):
    got = as_dict(E.monthly_by_year(frame, "temp_ar_c", "sum"), "ano", "mes")
    assert got[(2024, 6)]["temp_ar_c"] == 0.0  # a sum without values is 0
    assert as_dict(E.monthly_by_year(frame, "temp_ar_c"), "ano", "mes")[(2024, 6)]["temp_ar_c"] is None
    with pytest.raises(ValueError):
        E.monthly_by_year(frame, "temp_ar_c", "max")
    assert as_dict(E.hourly_profile_by_year(frame, "temp_ar_c", "max"), "ano", "hora")[("2025", 12)]["temp_ar_c"] == 31.0
    assert as_dict(E.daily_by_year(frame, "temp_ar_c"), "ano", "dia_do_ano")[("2024", 366)]["temp_ar_c"] == 26.0


def test_heatmap_is_a_full_grid(frame):
    rows = as_dict(E.hour_month_heatmap(frame, "temp_ar_c"), "ano", "mes")
    assert len(rows) == 24 and rows[(2024, 1)]["h01"] == 24.0 and rows[(2024, 2)]["h00"] is None
    assert rows[(2025, 3)]["z_min"] == 15.5 and rows[(2025, 3)]["z_max"] == 27.0


def test_calendar_needs_time(frame):
    row = E.with_calendar(frame).where("ano = 2024 and mes = 12").first()
    assert (row["nome_mes"], row["dia_do_ano"], row["hora"]) == ("Dec", 366, 23)
    with pytest.raises(ValueError):
        E.with_calendar(frame.drop("data_hora"))


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1), (2.0, 4.0, 5.0, 2), (3.0, None, 5.0, 3), (4.0, 1.0, 5.0, 4)], "a double, b double, c double, d int")
    got = {(r[0], r[1]): r[2] for r in E.correlation_matrix(df).collect()}
    want = df.toPandas()[["a", "b"]].corr().loc["a", "b"]
    assert got[("a", "b")] == pytest.approx(want) and got[("b", "a")] == pytest.approx(want)
    assert got[("a", "c")] is None and not any("d" in k for k in got)


@pytest.mark.parametrize("ranges", [1, 4, 1024])
def test_quantiles_are_exact(spark, ranges):
    rng = np.random.default_rng(42)
    values = np.concatenate([rng.normal(20, 5, 700), np.full(400, 21.5), [1e12, -1e9]])
    groups = np.where(rng.random(len(values)) < 0.8, "hot", "rare")
    pdf = pd.DataFrame({"g": groups, "v": values})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = {"p5": 0.05, "q1": 0.25, "median": 0.5, "p95": 0.95, "lo": 0.0, "hi": 1.0}
    got = K.exact_quantiles(df, ["g"], "v", probs, ranges).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(part["v"].quantile(p), rel=1e-12), (g, name)


def test_quantiles_of_one_value_and_none(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", None), ("b", None)], "g string, v double")
    rows = K.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in rows] == [("a", 3.0)]


def test_length_stats(spark):
    df = spark.createDataFrame([("x" * n,) for n in range(1, 23)], "t string")
    row = E.length_stats(df, "t").first()
    lengths = list(range(1, 23))
    assert (row["n"], row["mean"], row["p95"]) == (22, 11.5, sorted(lengths)[int(0.95 * 21)])
    assert row["stdev"] == pytest.approx(np.std(lengths))


def test_profiles_match_pandas(frame):
    got = as_dict(P.monthly_profiles(frame, digits=2), "month", "column")
    pdf = frame.toPandas()
    jan = pdf[pdf["data_hora"].dt.month == 1]["temp_ar_c"]
    row = got[(1, "temp_ar_c")]
    assert (row["mean"], row["std"], row["min"], row["max"]) == (round(jan.mean(), 2), round(jan.std(), 2), jan.min(), jan.max())
    assert (2, "temp_ar_c") not in got and not any(c == "umidade_rel_ar_percent" for _, c in got)
    ext = as_dict(P.seasonal_extremes(frame, digits=2), "month", "column")
    assert ext[(1, "temp_ar_c")]["p95"] == round(jan.quantile(0.95), 2)


def test_texts(frame):
    now = F.lit(dt.datetime(2026, 1, 1))
    prof, ext, meta = P.monthly_profiles(frame), P.seasonal_extremes(frame), P.snapshot_metadata(frame, now)
    docs = {r["mes"]: r for r in P.build_docs(prof, ext, meta).collect()}
    assert docs[7]["text"] == (
        "Em julho em a: Temperatura média de 15.5°C (mín: 15.0°C, máx: 16.0°C, desvio: 0.71°C). "
        "Percentil 5%: 15.05°C, percentil 95%: 15.95°C. Precipitação: média de 7.0 mm, máximo de 7.0 mm."
    )
    assert docs[0]["mes_nome"] == "anual" and docs[7]["mes_nome"] == "julho"
    assert docs[0]["text"] == (
        "Resumo climático anual de a: mês mais quente é dezembro (média 26.0°C), mês mais frio é julho (média 15.5°C). "
        "Histórico de 2024-01 a 2025-07, total de 8 observações horárias."
    )
    again = P.build_docs(prof, ext, meta, P.build_docs(prof, ext, meta))
    assert again.count() == len(docs)


def test_profile_files(spark, frame, tmp_path):
    now = F.lit(dt.datetime(2026, 1, 1))
    sinks.write_profiles(P.monthly_profiles(frame, digits=2), P.seasonal_extremes(frame, digits=2), P.snapshot_metadata(frame, now), str(tmp_path / "fs"))
    text = spark.read.text(str(tmp_path / "fs" / "monthly_profiles")).first()["value"]
    data = json.loads(text)
    assert list(data) == ["1", "6", "7", "12"] and data["1"]["temp_ar_c"]["max"] == 27.0


def test_score_files(spark, tmp_path):
    scores = spark.createDataFrame([(5, "faithfulness", 0.73333), (5, "recall", 0.6)], "n_examples bigint, metric string, score double")
    sinks.write_scores(scores, str(tmp_path), "T")
    rows = {r[0]: r[1] for r in spark.read.option("header", "true").csv(str(tmp_path / "results_T_csv")).collect()}
    assert rows == {"faithfulness": "0.7333", "recall": "0.6000"}
    payload = json.loads(spark.read.text(str(tmp_path / "results_T_json")).first()[0])
    assert payload["n_examples"] == 5 and payload["scores"]["recall"] == 0.6


def test_best_run(spark):
    runs = spark.createDataFrame(
        [("e", "r3", "FINISHED", 0.2), ("e", "r1", "FINISHED", 0.2), ("e", "r0", "FINISHED", None), ("e", "r9", "FAILED", 0.0),
         ("f", "r5", "FINISHED", None), ("f", "r4", "FINISHED", float("nan"))],
        "experiment string, run_id string, status string, mape double",
    )
    got = {r["experiment"]: r["run_id"] for r in R.select_best_run(runs).collect()}
    assert got["e"] == "r1" and got["f"] in ("r4", "r5")
    with pytest.raises(ValueError):
        R.require_best_run(runs, "none")


def test_gate(spark):
    cand = spark.createDataFrame([("a", "1", 0.2), ("b", "2", 0.1), ("c", "3", None), ("d", "4", 0.3), ("e", "5", 0.1)], "model_name string, run_id string, mape double")
    prod = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("c", 0.1), ("d", None)], "model_name string, mape double")
    got = {r["model_name"]: r["decision"] for r in R.promotion_gate(cand, prod).collect()}
    assert got == {"a": "rejected", "b": "promoted", "c": "promoted", "d": "promoted", "e": "promoted"}
    nan = spark.createDataFrame([("x", "r", float("nan")), ("y", "r", 9.0)], cand.schema)
    known = spark.createDataFrame([("x", 0.05), ("y", float("nan"))], "model_name string, mape double")
    assert {r["decision"] for r in R.promotion_gate(nan, known).collect()} == {"promoted"}
    forced = {r["decision"] for r in R.promotion_gate(cand, prod, force=True).collect()}
    assert forced == {"promoted"}


def brute_early_stop(losses, patience):
    best, best_epoch, bad = float("inf"), 0, 0
    for epoch, loss in enumerate(losses, 1):
        if loss < best:
            best, best_epoch, bad = loss, epoch, 0
        else:
            bad += 1
            if bad >= patience:
                return best_epoch, epoch, True
    return best_epoch, len(losses), False


@pytest.mark.parametrize("block", [3, 1024])
def test_early_stop_against_a_loop(spark, block):
    rng = np.random.default_rng(42)
    runs = {f"r{i}": [float(x) for x in rng.integers(0, 12, rng.integers(1, 40))] for i in range(30)}
    runs["nan_first"] = [float("nan"), 3.0, 2.0, float("nan"), 5.0]
    data = [(r, i, x) for r, xs in runs.items() for i, x in enumerate(xs, 1)]
    df = spark.createDataFrame(data, "run_id string, epoch bigint, val_loss double")
    rows = R.early_stop_trace(df, 3, block=block).collect()
    got = {r["run_id"]: (r["best_epoch"], r["total_epochs"], r["stopped_early"]) for r in rows}
    assert got == {r: brute_early_stop(xs, 3) for r, xs in runs.items()}


def test_metric_names(spark):
    rows = [({"val_MAPE": 0.2, "MAPE": 0.3},), ({"val_MAPE": float("nan"), "mape_scaled": 0.4},), ({"loss": 1.0},), ({"mape": float("nan"), "MAPE": 1.0},)]
    df = spark.createDataFrame(rows, "m map<string,double>")
    skip = [r[0] for r in df.select(N.first_metric("m", skip_nan=True)).collect()]
    plain = [r[0] for r in df.select(N.first_metric("m")).collect()]
    assert skip[0] == 0.2 and skip[1] == 0.4 and skip[2] is None and np.isnan(skip[3])
    assert plain[0] == 0.2 and np.isnan(plain[1]) and plain[2] is None and np.isnan(plain[3])


def test_parameters(spark):
    cases = {
        " 12 ": ("int", 12), "1.5": ("float", 1.5), "1e-3": ("float", 0.001), "TRUE": ("bool", True), "False": ("bool", False),
        "['a', 'b']": ("list", ["a", "b"]), "(1, 2)": ("list", ["1", "2"]), "abc": ("text", "abc"), "'q'": ("text", "q"), "None": ("none", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.parse_param("t").alias("p"))
    for r in df.collect():
        kind, value = cases[r["t"]]
        assert r["p"]["kind"] == kind
        if value is not None:
            assert r["p"][f"{kind}_value"] == value
    params = spark.createDataFrame([({"a": "1"},)], "m map<string,string>")
    assert params.select(N.require_param("m", "a").alias("p")).first()["p"]["int_value"] == 1
    with pytest.raises(Exception, match="missing parameter"):
        params.select(N.require_param("m", "b")).collect()


def test_governance(spark):
    df = spark.createDataFrame([(None, "'me@x.org' ", True), ("", '""', False)], "a string, b string, fair boolean")
    rows = R.resolve_governance(df, {"owner": ["a", "b"], "fairness_checked": ["fair"]}).collect()
    assert [(r["owner"], r["fairness_checked"]) for r in rows] == [("me@x.org", "true"), ("unknown", "false")]


def test_ingest_check(spark):
    good = spark.createDataFrame([(2024, 3), (2025, 2)], "year int, csv_count bigint")
    assert tuple(E.ingest_summary(good).first()) == (2, 5)
    bad = spark.createDataFrame([(2024, 0)], "year int, csv_count bigint")
    with pytest.raises(Exception, match="years without"):
        E.ingest_summary(bad).collect()


def test_feature_summary_needs_features(frame):
    with pytest.raises(ValueError):
        E.feature_summary(frame, frame)
