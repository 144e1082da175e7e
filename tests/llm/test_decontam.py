import hashlib
import re

from stationflow.llm import decontam

from .helpers import documents, plain

PASSAGE = [f"q{i}" for i in range(25)]
ITEMS = [
    ("i1", " ".join(PASSAGE)), ("i2", "Short ITEM here"), ("i3", None), ("i4", ""), ("i5", "r " * 30), (None, "no id " * 8),
    ("i1", " ".join(PASSAGE)), ("i10", " ".join(PASSAGE[5:20])), ("i6", "one"),
]
DOCS = [
    (1, "x y " + " ".join(PASSAGE[3:13]) + " z"), (2, "x " + " ".join(PASSAGE[3:12]) + " z"), (3, None), (4, ""),
    (5, "a SHORT, item; here b"), (6, "r " * 40), (7, " ".join(PASSAGE) + " " + " ".join(PASSAGE)), (7, "nothing"), (7, "nothing"),
    (None, "no id " * 8 + "one"), (9, "w " * 30_000 + " ".join(PASSAGE[10:])), (10, "ones one"),
]


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            m = min(10, len(w))
            for i in range(len(w) - m + 1):
                windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])] - {None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def run(spark, docs, items):
    rows = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, span string")
    return plain(decontam.decontaminate(documents(spark, docs), rows), *COLUMNS)


def test_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS[:5], []) == brute(DOCS[:5], [])


def test_every_place_of_a_window_is_found(spark):
    docs = [(i, " ".join(["z"] * i + PASSAGE[i : i + 10] + ["z"] * (20 - i))) for i in range(16)]
    assert run(spark, docs, [("a", " ".join(PASSAGE))]) == brute(docs, [("a", " ".join(PASSAGE))])


def test_items_without_id_hit_words(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = documents(spark, [(1, f"x {passage} y"), (2, "none of it"), (3, f"{passage} eleven")])
    items = spark.createDataFrame([(None, passage), (7, passage + " eleven")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (10, 1, True), 2: (0, 0, False), 3: (11, 1, True)}
    alone = spark.createDataFrame([(None, passage)], "item_id long, text string")
    row = {r.doc_id: r for r in decontam.decontaminate(docs, alone).collect()}[1]
    assert (row.n_hit, row.n_items, row.contaminated) == (10, 0, True)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
