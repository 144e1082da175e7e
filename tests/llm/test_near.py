import collections
import re

import numpy as np
import pytest

from stationflow.llm import common, components, jaccard, queries, shingles

from .helpers import SF, documents, plain


def shingle_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """class and links of each row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    group = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        group[find(i)].append(doc_id)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in group.items()}
    return sorted(((rows[i][0], least[find(i)], links[i]) for i in range(len(rows))), key=str)


def variants(seed, groups, copies, words=60):
    """Groups of texts that differ in a few words each."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.integers(5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(words)] = f"x{rng.integers(5000)}"
            rows.append((len(rows), " ".join(own)))
    return rows


ODD = [
    (1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, TWO!"), (6, "a b c d e f g h i j k l"),
    (7, "a b c d e f g h i j k l"), (7, "A b c d e f g h i j k l"), (7, "A b c d e f g h i j k l"), (None, "one two"),
    (9, "long " + " ".join(f"v{i}" for i in range(9000))), (10, " ".join(f"v{i}" for i in range(9000))), (11, "ÉÉ éé"),
]


def test_odd_rows(spark):
    got = plain(jaccard.near_duplicates(documents(spark, ODD)), "doc_id", "class_id", "n_links")
    assert got == brute(ODD)
    assert plain(jaccard.near_duplicates(documents(spark, []))) == []


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = plain(queries.QUERIES["op1_near_duplicates"](spark, SF), "doc_id", "class_id", "n_links")
    assert got == brute(rows)


@pytest.mark.parametrize("small", [1000, 6])
def test_large_buckets_are_split_and_blocked(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "MERGED", 4)
    rows = variants(3, 4, 30)
    got = plain(jaccard.near_duplicates(documents(spark, rows)), "doc_id", "class_id", "n_links")
    assert got == brute(rows)


def test_recall_at_the_threshold():
    """Sets that share just eight of ten tokens meet in the runs that the target asks for."""
    rng = np.random.default_rng(1)
    runs, met = jaccard.runs_needed(target=0.9999), 0
    with np.errstate(over="ignore"):
        for _ in range(300):
            tokens = rng.integers(1 << 63, size=100).astype(np.uint64)
            a, b = jaccard.first_paths(tokens, runs, 0.8), jaccard.first_paths(tokens[:80], runs, 0.8)
            met += len(np.intersect1d(a, b)) > 0
    assert met >= 299


def test_shingles_equal_plain_sets():
    texts = [t for _, t in ODD] + ["x y z"] * 3
    got = list(shingles.shingle_sets(texts))
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(shingle_set(a) & shingle_set(b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100, 300: 300}


def test_a_row_repeated_many_times_is_compared_once(spark):
    """10,000 copies of one row beside a near copy: no comparison holds more than the two classes and what else is near."""
    text = " ".join(f"w{i}" for i in range(60))
    other = text.replace("w59", "x59")
    rows = documents(spark, [(1, text)] * 10_000 + [(2, other)] + [(None, f"a b c d e f{i}") for i in range(20)])
    from stationflow.llm import jaccard

    got = jaccard.near_duplicates(rows).groupBy("class_id", "text_class", "n_links").count().collect()
    found = {(r.class_id, r.text_class, r.n_links): r["count"] for r in got}
    assert found[(1, 1, 10_000)] == 10_000 and found[(1, 2, 10_000)] == 1


def test_pairs_met_in_an_earlier_group():
    import numpy as np

    from stationflow.llm.jaccard import _met_before

    rng = np.random.default_rng(1)
    earlier = [rng.choice(6000, rng.integers(0, 40), replace=False).tolist() for _ in range(80)]
    i, j = np.triu_indices(80, 1)
    want = [not set(earlier[a]).isdisjoint(earlier[b]) for a, b in zip(i, j)]
    assert _met_before(earlier, i, j).tolist() == want and not _met_before([[], []], np.array([0]), np.array([1])).any()


def test_repeats_leave_a_task_once(spark):
    """What a task sends on has each class once, whatever its rows repeat."""
    import pyarrow as pa

    from stationflow.llm import jaccard

    group = jaccard._compare(0.8)
    tokens = pa.array([[1, 2, 3, 4, 5]] * 500 + [[1, 2, 3, 4, 6, 5]])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([9] * 501), pa.array([1] * 500 + [2]), pa.array([500] * 500 + [1]), tokens, pa.array([[9]] * 501)],
        names=["g", "cid", "weight", "tokens", "groups"],
    )
    sent = {}
    keep = jaccard.similar_pairs
    try:
        jaccard.similar_pairs = lambda sets, t: sent.setdefault("n", len(sets)) and keep(sets, t)
        out = [r for b in group(iter([batch])) for r in b.to_pylist()]
    finally:
        jaccard.similar_pairs = keep
    assert sent == {"n": 2} and sorted((r["cid"], r["links"]) for r in out) == [(1, 1), (2, 500)]


def _written_files(spark, monkeypatch, tmp_path, work):
    """Names of the files that ``work`` leaves in the shared folder."""
    monkeypatch.setattr(common, "shared_dir", lambda _, purpose: f"file://{tmp_path}/{purpose}-{len(list(tmp_path.iterdir()))}")
    work()
    return [f.name for f in tmp_path.rglob("*") if f.is_file()]


def test_no_child_process_for_each_file(spark, monkeypatch, tmp_path):
    # Hadoop's local writer leaves a .crc file beside each file, and starts a child of the executor for the mode of either
    rows = variants(5, 6, 4)
    files = _written_files(spark, monkeypatch, tmp_path, lambda: jaccard.near_duplicates(documents(spark, rows)).collect())
    assert any(f.endswith(".parquet") for f in files) and not [f for f in files if f.endswith(".crc")]


def test_written_rows(spark, monkeypatch, tmp_path):
    df = spark.sql("SELECT IF(id % 3 = 0, NULL, id) a, struct(id x, NULL y) b, IF(id % 2 = 0, array(id, 7L), NULL) c, string(id) d FROM range(50)")
    df = df.withColumn("b", df.b.cast("struct<x:long,y:long>")).repartition(7)

    def twice(batches):
        for batch in batches:
            yield batch
            yield batch

    def check():
        out = common.written(df, "rows")
        assert out.schema.simpleString() == df.schema.simpleString() and plain(out, *df.columns) == plain(df, *df.columns)
        empty = common.written(df.where("d = 'x'"), "none")
        assert empty.columns == df.columns and empty.count() == 0
        assert common.written(df.select("d"), "more", twice, "d string").count() == 100
        (tmp_path / "part").mkdir()
        (tmp_path / "part" / ".part-00000.parquet-9").write_bytes(b"broken off")  # of a task that failed
        assert spark.read.schema("d string").parquet(f"file://{tmp_path}/part").count() == 0

    assert not [f for f in _written_files(spark, monkeypatch, tmp_path, check) if f.endswith(".crc")]
