"""Filter interaction audit: what each of five filters removes, alone and beside the others.

Words are runs of characters other than blanks (0x20, 0x09-0x0D), case-sensitive.
Null texts count as empty, a null ``lang`` is the part with the empty name. Rows
that repeat a ``doc_id`` count one by one; a null id is smaller than none and has
no smaller one, and no label. Labels that repeat an id mark it if one of them
does. Extra columns are ignored, whatever their names are. An empty table
gives an empty result. Memory grows with the longest text: about twice its size
and its different words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, staged
from .rows import count_of, pieces

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
COPY = 1 << FILTERS.index("E")


def failures(text: str) -> int:
    """Bits of the filters A to D that a whole text fails."""
    data = text.encode("utf-8", "replace")
    n, different = 0, set()
    for part in pieces(data):
        words = part.split()
        n += len(words)
        different.update(words)
    failed = (
        n < LEAST_WORDS, 100 * len(different) < LEAST_DISTINCT * n,
        100 * count_of(data, CAPITALS) > MOST_CAPITALS * len(text), count_of(data, SIGNS) > 0,
    )
    return sum(1 << i for i, bad in enumerate(failed) if bad)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("text").to_pylist():
            masks.append(failures(text))
            digests.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
            names=["doc_id", "part", "digest", "mask"],
        )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part mask n good toxic``: documents by the set of filters they fail, and how many of them are labelled so.

    Equal texts meet by a digest of 128 bits. Rows are counted by document and
    text first, so copies and repeated rows are one row each before they are
    dealt out; the first of a text is joined by text and id together.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    with small_batches(docs.sparkSession):
        found = rows.mapInArrow(_judge, "doc_id long, part string, digest binary, mask int")
        found = staged(found.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "failures")
    first = found.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    small = found.join(first, ["digest", "doc_id"], "left").groupBy(
        "doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask")
    ).agg(F.sum("n").alias("n"))
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where(
        "doc_id IS NOT NULL AND (good OR toxic)"
    ).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counted = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark)
    return small.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def shapley(value: Callable[[int], int], players: int) -> list[Fraction]:
    """Shapley values of a coalition game by constrained least squares, in rationals.

    The additive game nearest to ``value`` with the kernel's weights (n - 1) /
    (C(n, s) s (n - s)) for coalitions of s players, whose values add up to that of
    all: its normal equations with one multiplier, solved exactly.
    """
    whole = (1 << players) - 1
    a = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    b = [Fraction(0)] * (players + 1)
    for coalition in range(1, whole):
        s = coalition.bit_count()
        weight = Fraction(players - 1, comb(players, s) * s * (players - s))
        members = [i for i in range(players) if coalition >> i & 1]
        for i in members:
            b[i] += weight * (value(coalition) - value(0))
            for j in members:
                a[i][j] += weight
    for i in range(players):
        a[i][players] = a[players][i] = Fraction(1)
    b[players] = Fraction(value(whole) - value(0))
    return _solve(a, b)[:players]


def _solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    rows = [[*row, y] for row, y in zip(a, b)]
    for k in range(len(rows)):
        pivot = next(r for r in range(k, len(rows)) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(len(rows)):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [row[-1] for row in rows]


def removals(masks_: Sequence[int], counts: Sequence[int], filters: int) -> list[int]:
    """For each coalition of filters: how many of the documents one of them removes."""
    m, n = np.array(masks_, dtype=np.int64), np.array(counts, dtype=object)
    return [int(n[(m & coalition) != 0].sum()) for coalition in range(1 << filters)]


def _audit(filters: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, good, toxic = (removals(pdf["mask"], pdf[c], len(filters)) for c in ("n", "good", "toxic"))
        whole = (1 << len(filters)) - 1
        total = int(pdf["n"].sum())
        orders = list(permutations(range(len(filters))))
        shares = [x * len(orders) for x in shapley(gone.__getitem__, len(filters))]
        out = []
        for order in orders:
            before = 0
            for step, f in enumerate(order):
                after = before | 1 << f
                removed = gone[after] - gone[before]
                out.append((
                    pdf["part"].iloc[0], "".join(filters[i] for i in order), step + 1, total - gone[after], removed,
                    gone[1 << f] - removed, gone[whole] - gone[whole ^ 1 << f], good[after] - good[before],
                    toxic[after] - toxic[before], int(shares[f]),
                ))
                before = after
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


_COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``masks``.

    The documents that each coalition of filters removes are tabulated (32
    numbers a part); a step is the difference of two of them. ``shapley`` is the
    number a filter removes in all orders together.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS[3:])
    return counted.groupBy("part").applyInPandas(_audit(filters), schema)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM d JOIN first USING (t) LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before::BIGINT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before::BIGINT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before::BIGINT = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before::BIGINT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
