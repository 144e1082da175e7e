import json

import pytest

from stationflow import schema as S
from stationflow.sources import features, records


def configs(folder, **files):
    for name, value in files.items():
        (folder / f"{name}.json").write_text(json.dumps(value))
    return str(folder)


def test_defaults_are_filled(spark, tmp_path):
    row = records.read_experiments(spark, configs(tmp_path, a={"run_name": "r", "data": {"horizon": 72}})).first()
    assert (row.run_name, row.data.horizon, row.data.sequence_length, row.model.model_type) == ("r", 72, 24, "lstm")
    assert "problem" not in row.asDict()


@pytest.mark.parametrize("wrong, why", [
    ({"model": {"model_type": "xgboost"}}, "model.model_type is xgboost"),
    ({"governance": {"risk_level": "none"}}, "governance.risk_level is none"),
    ({"governance": {"model_type": "LSTM"}}, "governance.model_type is LSTM"),
    ({"epochs": "many"}, "wrong type"),
])
def test_invalid_configurations_are_rejected(spark, tmp_path, wrong, why):
    root = configs(tmp_path, good={"run_name": "good"}, wrong={"run_name": "wrong", **wrong})
    with pytest.raises(Exception, match=why):
        records.read_experiments(spark, root).collect()
    marked = records.read_experiments(spark, root, invalid="mark").select("path", "problem").collect()
    said = {r.path.rpartition("/")[2]: r.problem for r in marked}
    assert said["good.json"] is None and why in said["wrong.json"]


def test_choices_hold_the_defaults():
    for name, choices in S.EXPERIMENT_CHOICES.items():
        assert S.EXPERIMENT_DEFAULTS[name] in choices


def test_serving_data_is_looked_for_in_order(spark, tmp_path):
    def store(path, n):
        spark.range(n).selectExpr("id % 2 AS p", "id").write.partitionBy("p").parquet(str(tmp_path / path))

    def served(path, model_root=None):
        found = features.serving_path(spark, str(tmp_path / path), model_root and str(tmp_path / model_root))
        return spark.read.parquet(found).count()

    store("nested/b/h168", 4)
    store("nested/a/h072", 3)
    assert served("nested") == 3  # the first below, alone
    spark.range(5).write.parquet(str(tmp_path / "own"))
    assert served("own") == 5
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "own/deeper"))
    assert served("own") == 5  # its own files, not those below
    file = next((tmp_path / "own/deeper").glob("*.parquet"))
    assert served(file.relative_to(tmp_path)) == 6
    store("models/m2/serving_data", 8)
    store("models/m1/serving_data", 7)
    store("models/m0/other", 9)
    assert served("own", "models") == 7 and served("none", "models") == 7
    assert served("own", "no-models") == 5
    (tmp_path / "empty").mkdir()
    for path in ("empty", "none"):
        with pytest.raises(FileNotFoundError):
            served(path, "no-models")
