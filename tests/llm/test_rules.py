import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from stationflow.llm import audit, lexical, outliers

from .helpers import documents, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a\x1cb \x85c d", "a b c a b c", "a a a a a", "x y\nx y\n\n x y\nz", "$#|<>*&% #", "é　ü\nÉ 😀", "w" * 50_000, "A B\r\nA B\r\n"]


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(three)
    hit = {i + j for i, x in enumerate(three) if often[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


@pytest.fixture
def many():
    rng = random.Random(5)
    pick = ["a", "b", "ab", "#x", "é", "|", "the", "cat"]
    return ODD + ["".join(rng.choice(pick) + rng.choice([" ", "\n", "\t", "  "]) for _ in range(rng.randrange(60))) for _ in range(150)]


def test_counts_against_brute_force(many, monkeypatch):
    for t in many:
        assert outliers.counts(t) == brute_counts(t)
    monkeypatch.setattr("stationflow.llm.outliers.pieces", lambda d: __import__("stationflow.llm.rows", fromlist=["x"]).pieces(d, 7))
    for t in many:
        assert outliers.counts(t) == brute_counts(t)


def test_chi_squared():
    assert outliers.chi2_limit(0.95, 5) == pytest.approx(11.0705, abs=1e-3) and outliers.chi2_limit(0.5, 2) == pytest.approx(2 * math.log(2))
    assert outliers.consistency(1.0) == 1.0 and outliers.consistency(0.5) == pytest.approx(0.5 / outliers.chi2_share(outliers.chi2_limit(0.5, 5), 7))


def cells(spark, x, cell=0):
    rows = [("g", cell, len(x), *map(int, r)) for r in x]
    return spark.createDataFrame(rows, "gid string, cell int, n long, x0 int, x1 int, x2 int, x3 int, x4 int")


def test_estimate_ignores_a_third_of_outliers(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5)) * 500
    good = np.rint(rng.normal(size=(600, 5)) @ mix + 3000).astype(int)
    bad = np.rint(rng.normal(size=(300, 5)) * 100 + 12000).astype(int)
    got = outliers.estimate(cells(spark, np.concatenate([good, bad]))).first()
    centre = np.array([got[f"m{i}"] for i in range(5)])
    cov = np.cov(good.T, bias=True) + np.diag((np.array(outliers.LEAST_SPREAD) * outliers.UNIT) ** 2)
    off = centre - good.mean(axis=0)
    assert off @ np.linalg.inv(cov) @ off < 0.1
    assert abs(got.det - np.linalg.slogdet(cov)[1]) < 0.5
    inverse = np.zeros((5, 5))
    for k, (i, j) in enumerate(outliers._PAIRS):
        inverse[i, j] = inverse[j, i] = got[f"w{k}"] / (1 if i == j else 2)
    d = lambda x: np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
    assert (d(bad) > outliers.chi2_limit(1 - 1e-6, 5)).all() and (d(good) <= outliers.chi2_limit(1 - 1e-6, 5)).all()


def test_concentration_never_raises_the_determinant(spark):
    """The same steps in numpy, over all rows: from the same starts they end in the same rows."""
    rng = np.random.default_rng(9)
    x = np.rint(np.concatenate([rng.normal(size=(150, 5)) * 300 + 2000, rng.normal(size=(60, 5)) * 200 + 9000])).astype(int)
    got = outliers.estimate(cells(spark, x)).first()
    floor = np.diag((np.array(outliers.LEAST_SPREAD) * outliers.UNIT) ** 2)
    best = None
    for first in (range(150), range(60, 210), range(0, 210, 2)):
        rows, last = np.array(first), math.inf
        while True:
            own = x[rows]
            share = min(1.0, len(rows) / len(x))
            cov = np.cov(own.T, bias=True) * outliers.consistency(share) + floor
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9:
                break
            last = det
            off = x - own.mean(axis=0)
            d = np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off)
            rows = np.argsort(d, kind="stable")[: (len(x) + 6) // 2]
        best = min(best or (last, own, cov), (last, own, cov), key=lambda b: b[0])
    off = x - best[1].mean(axis=0)
    near = x[np.einsum("ni,ij,nj->n", off, np.linalg.inv(best[2]), off) <= outliers.chi2_limit(0.975, 5)]
    want = np.linalg.slogdet(np.cov(near.T, bias=True) * outliers.consistency(0.975) + floor)[1]
    assert abs(got.det - want) < 0.15
    assert np.abs(np.array([got[f"m{i}"] for i in range(5)]) - near.mean(axis=0)).max() < 30


def prose(rng, n=120):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_rules_keep_ordinary_texts_only(spark):
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.randrange(80, 400))) for i in range(260)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(rng).split())) for i in range(20)]
    rows = texts + bad + [(2000, None), (2001, ""), (None, "short"), (2002, "one two " * 60), texts[0], texts[0]]
    df = documents(spark, rows, ["en"] * 130 + [None] * (len(rows) - 130))
    got = outliers.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id >= 2000:
            assert r.base_failed and not r.kept
        else:
            assert not r.base_failed and r.kept == (r.doc_id < 1000)
    counted = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got}
    assert counted == {(i, *brute_counts(t)) for i, t in rows}


def test_rules_without_a_large_group(spark):
    rng = random.Random(2)
    few = documents(spark, [(i, prose(rng)) for i in range(5)] + [(9, None)])
    got = {r.doc_id: (r.kept, r.distance) for r in outliers.judge(few).collect()}
    assert got == {**{i: (True, None) for i in range(5)}, 9: (False, None)}
    assert plain(outliers.judge(documents(spark, []))) == []


def test_small_sources_are_pooled(spark):
    keys = [("a", "en", 5), ("b", "en", 4), ("c", "en", 30), ("d", "fr", 3), (None, None, 2)]
    rows = spark.createDataFrame([(g, s) for s, g, n in keys for _ in range(n)], "lang string, source string")
    from pyspark.sql import functions as F

    got = {tuple(r) for r in outliers.groups(rows.select(F.to_json(F.struct("lang", "source")).alias("key")), 8).collect()}
    en = 'lang {"lang":"en"}'
    assert got == {
        ('{"lang":"en","source":"a"}', en, 9), ('{"lang":"en","source":"b"}', en, 9),
        ('{"lang":"en","source":"c"}', '{"lang":"en","source":"c"}', 30), ('{"lang":"fr","source":"d"}', None, None), ("{}", None, None),
    }


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = defaultdict(list)
    for i, t, lang in rows:
        s, w = t or "", WORD.findall(t or "")
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in s) > 3 * len(s),
            "D": any(c in "#$%&*|" for c in s), "E": i is not None and i > least[s],
        }
        fails[lang or ""].append((i, {k for k in f if f[k]}))
    out = []
    for part, docs in fails.items():
        total, own = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                own.append((
                    part, "".join(order), step + 1, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone),
                    sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f,
                ))
        out += [(*r[:-1], total[r[-1]]) for r in own]
    return sorted(out, key=str)


def test_audit_against_brute_force(spark):
    rng = random.Random(4)
    pool = ODD + ["A" * n + " b" * m + s for n in (0, 9) for m in (30, 300) for s in ("", " #", " |c")] + [" ".join(f"w{i}" for i in range(300))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(160)]
    rows += [(3, "same", "en")] * 50
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in list(range(40)) + [3, 3]] + [(None, 1, 1)]
    df = documents(spark, [r[:2] for r in rows], [r[2] for r in rows])
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert plain(audit.audit(audit.masks(df, marks))) == brute_audit(rows, labels)
    assert plain(audit.audit(audit.masks(documents(spark, []), marks))) == []


def test_shapley_by_least_squares_is_exact():
    rng = random.Random(6)
    for n in (2, 3, 5):
        v = [rng.randrange(1000) for _ in range(1 << n)]
        want = [0] * n
        for order in permutations(range(n)):
            s = 0
            for i in order:
                want[i] += v[s | 1 << i] - v[s]
                s |= 1 << i
        assert [x * math.factorial(n) for x in audit.shapley(v.__getitem__, n)] == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, k):
    have = [(i, term_list(t)) for i, t in docs if term_list(t)]
    n, total = len(have), sum(len(w) for _, w in have)
    df = Counter(t for _, w in have for t in set(w))
    out = []
    for item, text in set(items):
        found = []
        for i, w in have:
            tf, m = Counter(w), 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(term_list(text)) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, small, monkeypatch):
    if small:  # many tiles: the tasks run in processes of their own, so plans are compared through parameters
        monkeypatch.setattr(lexical, "ITEM_TILE", 2)
    rng = random.Random(8)
    pick = ["the", "The", "cat", "é1", "ß", "a_b", "x", "y", "zz", "77"]
    text = lambda n: "".join(rng.choice(pick) + rng.choice([" ", "-", "\n", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(90)] + [(5, "cat cat"), (5, "cat cat"), (None, "cat x"), (200, None), (201, ""), (202, "._")]
    docs += [(300 + i, "cat the") for i in range(30)] + [(400, "cat " * 50_000)]
    items = [(i, text(8)) for i in range(12)] + [(20, None), (21, "?"), (22, "unseen"), (3, "cat"), (3, "cat"), (None, "zz")]
    df = documents(spark, docs)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = plain(lexical.search(df, asked, k=7, block_terms=20 if small else lexical.BLOCK_TERMS))
    assert got == brute_search(docs, items, 7)
    assert plain(lexical.search(documents(spark, []), asked)) == [] and plain(lexical.search(df, asked.limit(0))) == []


def test_tiles_are_exact(monkeypatch):
    """Products cut into columns by the bound of partial sums add up as whole numbers; small pools keep ties."""
    import pyarrow as pa

    docs = [(i, " ".join(["a"] * (i % 3 + 1) + ["b", "c"])) for i in range(40)]
    block = lexical.Block(["1", "2"], [1, 2], {b"a": 0, b"b": 1, b"c": 2}, [np.array([0, 1, 2]), np.array([1])])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs]})
    weights = np.array([7000, 9000, 11], dtype=np.int64)
    run = lambda: [b.to_pydict() for b in lexical._search(block, weights, 40, 200, 5)(iter([batch]))]
    whole = run()
    monkeypatch.setattr(lexical, "_EXACT", 9000 * lexical.MOST_IMPACT)
    monkeypatch.setattr(lexical, "DOC_TILE", 3)
    monkeypatch.setattr(lexical, "POOL_ROWS", 1)
    assert run() == whole and whole[0]["item_id"] == ["1"] * 5 + ["2"] * 5
