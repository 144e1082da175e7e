"""Ranked lexical search: term impacts of documents times term weights of items, as dense blocked products.

Terms are runs of letters, digits and characters from U+0080 on, A-Z in lower
case. Null and empty texts have none: such documents are never found and such
items find nothing. Rows that repeat a ``doc_id`` are documents of their own; null
ids come last among equal scores. Rows that repeat an ``item_id`` with another
text are answered one by one, rows repeated whole once. Extra columns are
ignored, whatever their names are. Empty tables give an empty result. Memory
grows with the longest text: about twice its size and its different terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import small_batches, staged, text_key
from .decontam import words
from .rows import pieces

K = 50
BLOCK_TERMS = 1 << 18
ITEM_TILE = 32
TERM_TILE = 4096
DOC_TILE = 512
TILE_ENTRIES = 1 << 20
POOL_ROWS = 1 << 18
MOST_IMPACT = 1_000_000
_EXACT = (1 << 53) - 1
_LAST = (1 << 63) - 1
# Lower case for A-Z, a blank for every byte that is in no term.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, some at a time."""
    for part in pieces((text or "").encode("utf-8", "replace").translate(_FOLD)):
        yield part.split()


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds for a term of weight 1; below ``MOST_IMPACT``."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Block:
    """A bounded set of items: ``ids`` and ``keys``, ``vocabulary`` (term to number), the numbers of each item's terms."""

    ids: list[str]
    keys: list[int]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    def tiles(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Consecutive items with the sorted numbers of their terms: a compact vocabulary."""
        for lo in range(0, len(self.terms), ITEM_TILE):
            hi = min(lo + ITEM_TILE, len(self.terms))
            yield lo, hi, np.unique(np.concatenate(self.terms[lo:hi]))


def _block(rows: list) -> Block:
    vocabulary: dict[bytes, int] = {}
    numbers = []
    for r in rows:
        numbers.append(np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r.terms], dtype=np.int64))
    return Block([r.item_id for r in rows], [r.key for r in rows], vocabulary, numbers)


def _tally(vocabulary: dict[bytes, int]):
    """Counts of a task: documents with each term, and (-1) documents with a term, (-2) terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), dtype=np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n, found = 0, set()
                for part in terms(text):
                    n += len(part)
                    found.update(part)
                if n:
                    n_docs += 1
                    n_terms += n
                    df[[vocabulary[t] for t in vocabulary.keys() & found]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [n_docs, n_terms]]))], names=["term", "n"]
        )

    return run


class Best:
    """The ``k`` best documents of each item among those offered: score, then smaller id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Scores of items from ``first`` on (rows) for documents (columns); ties with the least kept score stay in."""
        i, j = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if len(i):
            self.parts.append((i + first, scores[i, j], none[j], ids[j]))
            self.size += len(i)
            if self.size > POOL_ROWS + 2 * self.k * len(self.least):
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Keep the best of each item, in order."""
        if not self.parts:
            return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, none, doc = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((doc, none, -score, item))
        item, score, none, doc = item[order], score[order], none[order], doc[order]
        start = np.searchsorted(item, item)
        rank = np.arange(len(item)) - start
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        keep = rank < self.k
        self.parts = [(item[keep], score[keep], none[keep], doc[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _search(block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The ``k`` best documents of a task for each item of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = block.vocabulary
        width = max(1, min(TERM_TILE, _EXACT // (MOST_IMPACT * max(1, int(weights.max(initial=0))))))  # no partial sum over 2^53
        plan = []
        for lo, hi, own in block.tiles():
            for a in range(0, len(own), width):
                some = own[a : a + width]
                left = np.zeros((hi - lo, len(some)))
                for i in range(lo, hi):
                    mine = block.terms[i][np.isin(block.terms[i], some)]
                    left[i - lo, np.searchsorted(some, mine)] = weights[mine]
                plan.append((lo, hi, some, left, a + width >= len(own)))
        best = Best(len(block.ids), k)
        column = np.full(len(vocabulary), -1, dtype=np.int64)

        def multiply(docs: list[tuple]) -> None:
            at = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
            number = np.concatenate([d[2] for d in docs])
            tf = np.concatenate([d[3] for d in docs])
            value = impacts(tf, np.array([d[1] for d in docs], dtype=np.int64)[at]).astype(np.float64)
            ids = np.array([_LAST if d[0] is None else d[0] for d in docs], dtype=np.int64)
            none = np.array([d[0] is None for d in docs])
            total = None
            for lo, hi, some, left, last in plan:
                column[some] = np.arange(len(some))
                place = column[number]
                column[some] = -1
                in_tile = place >= 0
                right = np.zeros((len(some), len(docs)))
                right[place[in_tile], at[in_tile]] = value[in_tile]
                product = (left @ right).astype(np.int64)
                total = product if total is None else total + product
                if last:
                    best.offer(lo, total, ids, none)
                    total = None

        docs: list[tuple] = []
        entries = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, count = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    count.update(part)
                found = [(vocabulary[t], c) for t, c in count.items() if t in vocabulary]
                if not found:
                    continue
                number, tf = np.array(found, dtype=np.int64).T
                docs.append((doc_id, 100 - 50 + (50 * n * n_docs) // n_terms, number, tf))
                entries += len(number)
                if len(docs) == DOC_TILE or entries >= TILE_ENTRIES:
                    multiply(docs)
                    docs, entries = [], 0
        if docs:
            multiply(docs)
        item, score, none, doc = best.cut()
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.ids[i] for i in item], pa.string()), pa.array([block.keys[i] for i in item], pa.int64()),
                 pa.array(doc, mask=none), pa.array(score)], names=["item_id", "key", "doc_id", "score"],
            )

    return run


def _items(items: DataFrame) -> DataFrame:
    """``item_id key terms`` of the items that have terms; ids as text."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("item_id", text_key(F.col("text")).alias("key"), F.array_distinct(words(F.col("text"))).alias("terms"))
    return rows.where("size(terms) > 0").dropDuplicates(["item_id", "key"])


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best rows of ``docs`` (``doc_id text``) for each of ``items`` (``item_id text``): ``item_id rank doc_id score``.

    Items are dealt into blocks by a hash, so many that a block has about
    ``block_terms`` terms in all (or one item); only a block's terms go to
    the tasks. A block reads the documents twice, once to count its terms
    over all of them and once to score. A tile of items has its own compact
    vocabulary; its weights are multiplied with the impacts of a tile of
    documents in doubles, which hold every partial sum exactly. A task keeps
    the best of each item, with all that tie until the ids decide.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    wanted = staged(_items(items), "items")
    total = wanted.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    blocks = -(-total // block_terms)
    parts = []
    with small_batches(spark):
        for b in range(blocks):
            block = _block(wanted.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)) == b).orderBy("item_id", "key").collect())
            counted = rows.select("text").mapInArrow(_tally(block.vocabulary), "term long, n long")
            counts = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
            n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
            if not n_docs or not block.ids:
                continue
            weights = np.array([weight(n_docs, counts.get(t, 0)) for t in range(len(block.vocabulary))], dtype=np.int64)
            found = rows.mapInArrow(_search(block, weights, n_docs, n_terms, k), "item_id string, key long, doc_id long, score long")
            parts.append(staged(found, "found"))
    if not parts:
        empty = spark.createDataFrame([], "rank int, doc_id long, score long")
        return empty.select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    order = W.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), n AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, r, 100 - 50 + (50 * len(w) * n.n) // n.l AS m FROM d, n WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
i AS (
  SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, n WHERE t IN (SELECT t FROM i) GROUP BY t, n.n
), s AS (
  SELECT item_id, text, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, text, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN m USING (r) WHERE score > 0
) WHERE rank <= 50
"""
