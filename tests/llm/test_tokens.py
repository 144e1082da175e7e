import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationflow.llm import packing, queries, tokens
from stationflow.llm.common import text_key

from .helpers import SF, documents, plain

ODD = [
    (5, None), (3, ""), (9, "It's we'll  a\t\tb\n\n c 12½ x² ｆｕｌｌ 漢字 \x1c z y <|endoftext|> don't"),
    (3, "twice the id"), (3, "twice the id"), (None, "no id"), (7, "word " * 3000), (1, " lead"), (2, "trail  "),
]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("memo", [1, 10_000])
def test_encoder_equals_tokenizer(spark, memo):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [t or "" for _, t in ODD]
    ids, counts = tokens.with_end(*tokens.Encoder(tokens.tokenizer_path(), memo).encode(texts))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [whole(t) for t in texts]


def test_token_table(spark):
    got = plain(tokens.token_table(documents(spark, ODD)))
    want, start = [], 0
    keyed = documents(spark, ODD).select("doc_id", "text", text_key(F.col("text")).alias("k")).collect()
    for doc_id, text, _ in sorted(keyed, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = whole(text)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want, key=str)
    assert plain(tokens.token_table(documents(spark, []))) == []


def test_token_table_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    for r in docs:
        ids = whole(r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    rows = queries.QUERIES["op9_token_table"](spark, SF)
    assert plain(rows) == sorted(want, key=str)


def check_packing(rows, texts, capacity=2048):
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts:
        ids = whole(text)
        own = sorted(docs[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            assert r.piece == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in filled.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op7_best_fit_packing"](spark, SF).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    lengths = np.array([r.length for r in rows])
    assert n <= packing.least_bins(np.bincount(lengths, minlength=2049), 2048) + 1


def test_packing_odd_rows(spark):
    texts = [(i, t) for i, t in ODD if i not in (3, None)]
    check_packing(packing.pack_documents(documents(spark, texts)).collect(), texts)
    repeated = packing.pack_documents(documents(spark, ODD)).collect()
    assert sum(r.length for r in repeated) == sum(len(whole(t)) for _, t in ODD)
    assert plain(packing.pack_documents(documents(spark, []))) == []


def test_parts_exchange_until_proven(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 60, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)],
                                   "doc_id long, piece int, start long, length long, ids_crc32 long")
    bound = packing.least_bins(np.bincount(lengths, minlength=101), 100)

    def used(rounds):
        rows = packing.place(pieces, 100, part_items=100, rounds=rounds)
        sums = rows.groupBy("sequence_id").agg({"length": "sum", "offset": "count"}).collect()
        assert max(r["sum(length)"] for r in sums) <= 100 and rows.count() == 3000
        return len(sums)

    assert bound <= used(None) <= used(1)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def test_three_to_a_bin(spark):
    """Lengths a little over and under a third: decreasing order makes pairs, sizes alone bound badly."""
    lengths = np.random.default_rng(2).integers(600, 800, 60_000)
    ids = np.arange(60_000)
    zero = np.zeros(60_000, dtype=int)
    pieces = spark.createDataFrame(pd.DataFrame(
        {"doc_id": ids, "piece": zero, "start": zero, "length": lengths, "ids_crc32": ids}), PIECE)
    placed = packing.place(pieces)
    row = packing.certificate(placed).first()
    assert 21_000 < row.least <= row.bins <= 22_400
    sums = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    assert sums.agg(F.max("n")).first()[0] <= 2048 and sums.count() == row.bins
    assert sums.agg(F.sum("k")).first()[0] == 60_000 and placed.select("doc_id").distinct().count() == 60_000


@pytest.mark.parametrize("doc_id", [7, None])
def test_equal_rows_are_dealt_evenly(spark, doc_id):
    """10,000 pieces alike in every column: each part gets its share, and none is lost."""
    row = F.lit(doc_id).cast("long").alias("doc_id")
    pieces = spark.range(10_000).select(row, *[F.expr(e) for e in (
        "0 AS piece", "0L AS start", "700L AS length", "5L AS ids_crc32")])
    placed = packing.place(pieces, part_items=1000, rounds=1)
    sizes = placed.groupBy(F.expr("sequence_id >> 24")).count().toPandas()["count"]
    assert len(sizes) == 10 and sizes.max() < 1200 and sizes.sum() == 10_000
    whole = packing.place(pieces, part_items=1000)
    assert packing.certificate(whole).first() == (5000, 5000)


def test_fill_tells_equal_rows_apart(spark):
    docs = documents(spark, [(1, "a b c")] * 4 + [(None, "d " * 30)] * 3)
    ids = tokens.encoded(docs.select("doc_id", "text"), tokens.tokenizer_path()).select("doc_id", "ids")
    pieces = packing.numbered(packing.cut_pieces(ids, 16, with_ids=True))
    filled = packing.fill(pieces, packing.place(pieces.drop("ids"), 16)).collect()
    assert sum(len(r.ids) for r in filled) == 4 * len(whole("a b c")) + 3 * len(whole("d " * 30))
    assert all(len(r.ids) == sum(r.lengths) <= 16 for r in filled)


@pytest.mark.parametrize("seed", range(12))
def test_bound_is_below_best(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 30, 6)

    def best(items, bins):
        if not items:
            return len(bins)
        found = 99
        for i, b in enumerate(bins):
            if b + items[0] <= 30:
                found = min(found, best(items[1:], bins[:i] + [b + items[0]] + bins[i + 1 :]))
        return min(found, best(items[1:], bins + [items[0]])) if len(bins) < 8 else found

    assert packing.least_bins(np.bincount(lengths, minlength=31), 30) <= best(sorted(lengths.tolist())[::-1], [])


def test_fill_gives_back_ids(spark):
    docs = documents(spark, [(1, "a b c"), (2, "d " * 50), (3, None)])
    ids = tokens.encoded(docs.select("doc_id", "text"), tokens.tokenizer_path()).select("doc_id", "ids")
    pieces = packing.cut_pieces(ids, 16, with_ids=True)
    placed = packing.place(packing.cut_pieces(ids, 16), 16)
    filled = {r.sequence_id: r.ids for r in packing.fill(pieces, placed).collect()}
    want = {1: whole("a b c"), 2: whole("d " * 50), 3: [0]}
    for r in placed.collect():
        assert filled[r.sequence_id][r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]
