import random

import corpus_pipeline

from .helpers import documents, plain
from .test_decontam import brute as decontaminated
from .test_near import brute as near
from .test_secrets import base
from .test_tokens import check_packing, whole

SF = "/root/testdata/sf0.001"


def step(spark, name, docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    return stage(spark, docs, SF)


def test_stages_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "deduplicate", "decontamination", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert step(spark, name, docs.limit(3)).columns == docs.columns


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = step(spark, "language", docs)
    assert kept.count() >= 0.97 * len(rows)
    best = {i for i, group, _ in near(rows) if i == group}
    assert sorted(r.doc_id for r in step(spark, "deduplicate", docs).collect()) == sorted(best)
    clean = [i for i, *_, hit in decontaminated(rows, items) if not hit]
    assert sorted(r.doc_id for r in step(spark, "decontamination", docs).collect()) == sorted(clean)
    more = spark.createDataFrame([(-1, "my password: hunter2hunter2 ok", "en", "s", 29)], docs.schema)
    safe = {r.doc_id: r.text for r in step(spark, "secret_scan", docs.union(more)).collect()}
    assert len(safe) == len(rows) + 1 and safe[-1] == "my [SECRET] ok"
    assert all(("[SECRET]" in safe[i]) >= bool(base(t)) for i, t in rows)
    assert all(safe[i] == t for i, t in rows if "[SECRET]" not in safe[i])


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in rows}
    assert kept <= set(texts) and len(kept) > 0.6 * len(texts)
    by = {i: sum(r.length for r in rows if r.doc_id == i) for i in kept}
    assert all(by[i] == len(whole(texts[i])) for i in kept if "=" not in texts[i] and ":" not in texts[i] and by[i] < 500 and len(texts[i]) < 900)


def test_odd_rows_pass(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("the of and with from under over near".split()) + str(i) for i in range(40))
    docs = documents(spark, [(1, None), (2, ""), (2, ""), (3, text), (4, text), (4, text), (None, "word one two three four five"), (5, "x" * 100_000)],
                     ["en", "fr", None, "en", "en", "en", "fr", "en"])
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = step(spark, name, docs)
        assert out.columns == docs.columns
        assert step(spark, name, docs.limit(0)).count() == 0
    ids = [r.doc_id for r in step(spark, "deduplicate", docs).collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 2, 3, None, 5], key=str) or sorted(ids, key=str) == sorted([1, 2, 3, None, 5], key=str)
    packed = step(spark, "packing", docs.where("doc_id = 5 OR doc_id = 3")).collect()
    check_packing(packed, [(5, "x" * 100_000), (3, text)])


def test_unlike_documents_without_or_with_one_id_stay(spark):
    def text(word):
        return " ".join(f"{word}{i}" for i in range(30))

    rows = [
        (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")),  # no ids: three groups
        (7, text("d")), (7, text("e")), (7, text("e") + " end"), (8, text("d")),  # one id: two groups
        (None, text("f")), (9, text("f")),  # an id goes before none
        (None, "..."), (None, "!"), (10, None), (10, ""),  # no words: no group
    ]
    got = plain(step(spark, "deduplicate", documents(spark, rows)), "doc_id", "text")
    twin = [r for r in got if r[0] == 7 and r[1].startswith("e")]
    assert len(twin) == 1 and twin[0] in rows
    rest = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (9, text("f")), (None, "..."), (None, "!"), (10, None), (10, "")]
    assert got == sorted([*rest, *twin], key=str)


def test_packing_has_one_python_step_on_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    steps, send = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **b: steps.append(a[2]) or send(*a, **b))
    assert step(spark, "packing", docs).select("doc_id").distinct().count() == 20
    assert len(steps) == 1
