import pytest
from pyspark.sql import functions as F

from stationflow.sources import snapshots


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, y int, x double")


def state(spark, root, version=None):
    return sorted(tuple(r) for r in snapshots.read(spark, root, version).select("k", "y", "x").collect())


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.replace(rows(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)), root, ["k", "y"], "w", 0)
    return root


def test_only_named_partitions_change(spark, table):
    snapshots.replace(rows(spark, ("a", 1, 9.0), ("c", 1, 4.0)), table, ["k", "y"], "w", 1)
    assert state(spark, table) == [("a", 1, 9.0), ("a", 2, 2.0), ("b", 1, 3.0), ("c", 1, 4.0)]
    assert state(spark, table, 1) == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]
    some = snapshots.read(spark, table, only=rows(spark, ("a", 1, 0.0), ("z", 1, 0.0)))
    assert [r.x for r in some.collect()] == [9.0]


@pytest.mark.parametrize("step", ["_parts", "_commits"])
def test_job_that_dies_leaves_the_table(spark, table, step, monkeypatch):
    """It fails while the data, the list of partitions or the pointer are written: readers see the version before."""
    before = state(spark, table)
    new = rows(spark, ("a", 1, 9.0), ("d", 1, 5.0))
    if step == "_parts":
        real = snapshots._parts
        monkeypatch.setattr(snapshots, "_parts", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    else:
        real = snapshots._publish
        monkeypatch.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        snapshots.replace(new, table, ["k", "y"], "w", 1)
    monkeypatch.setattr(snapshots, "_parts" if step == "_parts" else "_publish", real)
    assert state(spark, table) == before and snapshots.pointer(spark, table).version == 1
    bad = new.withColumn("x", F.when(F.col("k") == "a", 1.0).otherwise(F.raise_error(F.lit("bad row")).cast("double")))
    with pytest.raises(Exception, match="bad row"):
        snapshots.replace(bad, table, ["k", "y"], "w", 1)
    assert state(spark, table) == before
    snapshots.replace(new, table, ["k", "y"], "w", 1)
    assert state(spark, table) == [("a", 1, 9.0), ("a", 2, 2.0), ("b", 1, 3.0), ("d", 1, 5.0)]


def test_repeated_batch_changes_nothing(spark, table):
    again = snapshots.replace(rows(spark, ("a", 1, 7.0)), table, ["k", "y"], "w", 0)
    assert again.version == 1 and ("a", 1, 1.0) in state(spark, table)
    other = snapshots.replace(rows(spark, ("a", 1, 7.0)), table, ["k", "y"], "another", 0)
    assert other.version == 2 and ("a", 1, 7.0) in state(spark, table)
    assert other.batches == {"w": 0, "another": 0}


def test_second_writer_of_a_version_fails(spark, table, tmp_path):
    (tmp_path / "t/_commits/2").write_text("{}")
    with pytest.raises(FileExistsError):
        snapshots._publish(spark, f"{table}/_commits/2", "{}")


def test_odd_changes(spark, table, tmp_path):
    with pytest.raises(ValueError):
        snapshots.replace(rows(spark, ("a", 1, 7.0)).drop("x"), table, ["k", "y"])
    snapshots.replace(spark.createDataFrame([], "k string, y int, x double"), table, ["k", "y"])
    assert len(state(spark, table)) == 3
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "none"))


def test_tidy_keeps_what_is_named(spark, table):
    for i in range(3):
        snapshots.replace(rows(spark, ("a", 1, float(i))), table, ["k", "y"])
    want = state(spark, table)
    assert snapshots.tidy(spark, table, keep=1) == [2, 3]  # version 1 still holds two partitions
    assert state(spark, table) == want
