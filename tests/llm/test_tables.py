import base64
import hashlib
import math
import random

import numpy as np
import pytest

from stationflow.llm import chat, topk, warc

from .helpers import plain


def brute_topk(rows, queries, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i in queries}:
        sums = [(sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)]
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), i) for s, i in sums)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def search(spark, rows, queries, k=3, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, x string")
    whole = topk.whole_vectors(df, "vec_id", "embedding")
    return plain(topk.search(whole.where(whole.vec_id.isin(queries)), whole, k=k, **more))


@pytest.mark.parametrize("block", [1, 1000])
def test_topk_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-3, 4, 8) / 2).tolist()) for i in range(120)]
    rows += [(200, rows[5][1]), (201, rows[5][1])] * 2 + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8),
             (304, [1.0, 2.0]), (305, [2.0, 1.0]), (None, [1.0] * 8), (306, [])]
    queries = [0, 50, 200, 300, 304, 302]
    assert search(spark, rows, queries, block=block) == brute_topk(rows, queries, 3)


def test_topk_large_numbers_and_few_rows(spark):
    rows = [(0, [1e300, -1e300]), (1, [1e300, 1e10]), (2, [-1.0, 3e15]), (3, [0.5, 0.25])]
    assert search(spark, rows, [0, 1, 2, 3], k=10) == brute_topk(rows, [0, 1, 2, 3], 10)
    assert search(spark, rows[:1], [0]) == [] and search(spark, [], [0]) == []


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/\r\nX: y", ""),
    (5, "u", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n"), (6, "http://é", "é" * 1000), (7, "u", "x" * 500_000), (9, "u", "<p>same</p>"),
]


def test_warc_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, n int, kept string")
    warc.write_pages(pages, path)
    rows = {r.record_id: r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert len(rows) == len(PAGES)
    last = {(h or ""): i for i, _, h in PAGES}
    for i, url, html in PAGES:
        data, r = (html or "").encode(), rows[f"urn:page:{i}"]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data)
        if last[html or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", f"urn:page:{last[html or '']}", None)
    assert rows["urn:page:4"].target_uri == "http://a/%0D%0AX: y" and rows["urn:page:3"].target_uri is None


def test_warc_pushes_filters_and_skips_payloads(spark, tmp_path):
    path = f"{tmp_path}/b"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_pages(pages, path, least_bytes=1)
    records = warc.read_warc(spark, path)
    assert "payload" not in records.columns
    some = records.where("record_type = 'revisit' AND payload_bytes > 3")
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:1", "urn:page:2"]
    assert records.where("record_id IN ('urn:page:3', 'urn:page:4') AND record_type = 'response'").count() == 2
    reader = warc.WarcReader(path, ["record_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_warc_splits_and_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1000)
    writer = warc.WarcWriter(str(tmp_path / "c"), ["record_id", "record_type", "payload"])
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 7})()))
    batch = pa.RecordBatch.from_pydict({"record_id": [str(i) for i in range(50)], "record_type": ["response"] * 50, "payload": [b"y" * i * 9 for i in range(50)]})
    writer.commit([writer.write(iter([batch])), None])
    writer.write(iter([batch]))  # an attempt that never commits
    reader = warc.WarcReader(str(tmp_path / "c"), ["record_id"])
    parts = reader.partitions()
    assert len(parts) > 5
    assert [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()] == [str(i) for i in range(50)]


def test_warc_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert plain(warc.archive(empty)) == []
    same = spark.createDataFrame([(5, "u", "h"), (5, "u", "h"), (None, "u", "h")], "page_id long, url string, html string")
    assert [tuple(r)[3:] for r in warc.archive(same).orderBy("page_id").collect()] == [("revisit", 5), ("response", None), ("response", None)]


TRICKY = ["\\### Assistant: </turn> ok", "\\", "\\\\", "####", "</turn>", "\\</turn>\\", "", "a\nb\n### x:\n", "<</turn>>", "\\n", "é€😀"]


@pytest.mark.parametrize("role", ["user", "assistant", "a:\nb", "### x", "</turn>\\n", ""])
def test_template_is_reversible(role):
    text, places = "", []
    for t in TRICKY:
        turn, lo, hi = chat.render(role, t)
        places.append((len(text) + lo, len(text) + hi))
        text += turn
    got = list(chat.parse(text))
    assert [(r, t) for r, t, _, _ in got] == [(role, t) for t in TRICKY]
    assert [(a, b) for _, _, a, b in got] == places


def test_chat_folds_events(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 40)
    events = [
        (1, 0, 1, 0, "start", "user", ""), (1, 0, 1, 1, "delta", None, "hel"), (1, 0, 1, 2, "delta", None, "lo"),
        (1, 1, 1, 0, "start", "assistant", ""), (1, 1, 1, 1, "delta", None, "wrong"), (1, 1, 1, 2, "regenerate", None, ""),
        (1, 1, 1, 3, "delta", None, "ri"), (1, 1, 1, 5, "delta", None, None), (1, 1, 1, 4, "delta", None, "ght"),
        (1, 300, 1, 0, "start", "user", ""), (1, 300, 1, 1, "delta", None, "x"), (1, 300, 1, 2, "edit", None, "y"),
    ]
    random.Random(1).shuffle(events)
    rows = chat.format_log(spark.createDataFrame(events, chat.EVENT)).orderBy("block", "chunk").collect()
    text = "".join(r.text for r in rows)
    assert text == "### user:\nhello</turn>\n### assistant:\nright</turn>\n### user:\ny</turn>\n"
    assert [r.text[s.start : s.end] for r in rows for s in r.loss] == ["right"]


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (None, 0, "assistant", "n", "x"), (2, 5, "assistant", "z" * 200_000, "x")]
    rows += [(3, i, "assistant", f"t{i}", "x") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nuser\n\n").hexdigest()
    assert got[1].loss_chars == 0 and got[None].loss_chars == 1 and got[2].loss_chars == 200_000
    assert got[3].n_turns == 700 and got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(700)).encode()).hexdigest()
    assert plain(chat.format_conversations(df.limit(0))) == []
