import numpy as np
from pyspark.sql import functions as F

from stationflow.operators import retrieval as V, vector_index as I


def vectors(spark, rows, name="doc_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<double>")


def test_chance_to_share_a_cell():
    rng = np.random.default_rng(1)
    p = I.Projections(6, 2.0, 1, 20_000, 3)
    x = rng.normal(size=6)
    for d in (0.3, 1.0, 4.0):
        step = rng.normal(size=6)
        y = x + d * step / np.linalg.norm(step)
        a, b = p.buckets(np.stack([x, y]))
        assert abs((a == b).mean() - I.meeting(np.array([d]), 2.0)[0]) < 0.02
    assert (p.buckets(x[None, :]) == p.buckets(x[None, :])).all()


def test_index_finds_what_the_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, centres[i % 12] + rng.normal(size=16) * 0.3) for i in range(600)]
    copies = [(1000 + i, rows[0][1]) for i in range(150)]  # a quarter of the rows are one vector
    odd = [(5000, None), (5001, []), (5002, [1.0, 2.0])]
    docs = vectors(spark, rows + copies + odd)
    fitted = I.fit_projections(docs, 5)
    assert fitted.dim == 16 and fitted.tables <= I.MOST_TABLES
    path = str(tmp_path / "index")
    I.build_index(docs, path, fitted, shards=3)
    assert I.read_index(spark, path) == (fitted, 3)
    asked = vectors(spark, rows[::7] + [rows[0]], "query_id")
    found = I.search_index(asked, path, 5).cache()
    exact = V.topk_similar(asked, docs.where(F.size("embedding") == 16), 5).cache()
    r = I.recall(found, exact).first()
    assert r.results == 86 * 5 and r.recall >= 0.9
    own = [(x.doc_id, x.distance) for x in found.where("query_id = 0").orderBy("rank").collect()]
    assert own == [(0, 0.0), (1000, 0.0), (1001, 0.0), (1002, 0.0), (1003, 0.0)]
    true = {(x.query_id, x.doc_id): x.distance for x in exact.collect()}
    both = [(x.distance, true[x.query_id, x.doc_id]) for x in found.collect() if (x.query_id, x.doc_id) in true]
    assert all(abs(a - b) < 1e-9 for a, b in both)
    stored = spark.read.parquet(path + "/rows")
    assert stored.count() == 600 * fitted.tables and stored.selectExpr("max(size(ids))").first()[0] == I.MOST_IDS


def test_few_queries_read_few_folders(spark, tmp_path):
    rng = np.random.default_rng(4)
    docs = vectors(spark, [(i, rng.normal(size=4)) for i in range(200)])
    path = str(tmp_path / "index")
    I.build_index(docs, path, I.Projections(4, 1.0, 2, 2), shards=8)
    plan = I.search_index(docs.limit(1).withColumnRenamed("doc_id", "query_id"), path, 3)
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() >= 1


def test_empty_index(spark, tmp_path):
    none = vectors(spark, [])
    fitted = I.fit_projections(none)
    I.build_index(none, str(tmp_path / "index"), fitted)
    assert fitted.tables == 1


def test_searches_bring_no_rows_to_the_driver(spark, tmp_path, monkeypatch):
    """Every vector is a query; blocks of queries and documents meet in tasks, full buckets are spread."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8)) for i in range(500)] + [(1000 + i, np.ones(8)) for i in range(300)]
    docs = vectors(spark, rows).cache()
    path = str(tmp_path / "index")
    I.build_index(docs, path, I.Projections(8, 6.0, 1, 3), shards=1)
    monkeypatch.setattr(I, "FULL_BYTES", 64 * 50)  # buckets over 50 rows
    kind = type(docs)
    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "collect", "toPandas", "take"):
            m.setattr(kind, name, lambda *a, **b: (_ for _ in ()).throw(AssertionError("rows to the driver")))
        exact = V.topk_similar(docs.withColumnRenamed("doc_id", "query_id"), docs, 4, block=64)
    exact = {(r.query_id, r["rank"]): (r.doc_id, r.distance) for r in exact.collect()}
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for i, v in rows[::37]:
        d = ((x - v) ** 2).sum(axis=1)
        assert [exact[i, r + 1][0] for r in range(4)] == ids[np.lexsort((ids, d))][:4].tolist()
    found = I.search_index(docs.withColumnRenamed("doc_id", "query_id"), path, 4).collect()
    assert len(found) == 4 * len(rows) and sum((r.doc_id, r.distance) == exact[r.query_id, r["rank"]] for r in found) >= 0.9 * len(found)
