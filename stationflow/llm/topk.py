"""Exact top-k search by inner product: three phases with a uniform threshold.

Vectors count by their whole-number form floor(scale * x), x as double. Vectors
that are null or hold null or non-finite components take no part; vectors only
meet others of their length; scores beyond 64 bits are cut to the largest
long. A candidate with the query's own id is never returned to it. Rows that
repeat an id are separate candidates of equal rank, told apart by their
content; queries that repeat an id are answered once for each different
vector, numbered on. Extra columns are ignored, whatever their names are.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import staged

K = 10
SCALE = 1024
LISTS = 4
QUERY_BLOCK = 1024
_EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the components as whole doubles; rows that take no part are gone."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.col("x").isNotNull() & ~F.exists(
        "x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    ) & (F.size("x") > 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where(good & F.col("vec_id").isNotNull())
    # rounded in numpy: Spark's floor is a long, which very large components leave
    return rows.select("vec_id", "x", F.lit(scale).cast("double").alias("scale"))


def _matrix(lists: pa.ListArray, dim: int, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * scale)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles where no sum can leave their whole numbers, else in Python integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _cuts(dim: int, lists: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(lists, dim) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, smaller ids first among equal ones."""
    if len(scores) > k:
        at_least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= at_least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search(queries: DataFrame, rows: DataFrame, k: int = K, lists: int = LISTS, block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows of each query: ``query_id rank vec_id score``.

    Both sides are ``whole_vectors``. A score is the sum of ``lists`` partial
    scores, over as many slices of the components. Queries go out in blocks of
    ``block``, each block with one pass of the phases:

    1. every task gathers, for each query, its k best of each list; the merged
       best are scored in full, and the k-th best full score of a query is
       its cutoff: no result lies below.
    2. the cutoffs go out with the block. A row whose partial scores are all
       below cutoff / ``lists`` cannot reach the cutoff; the others are
       collected in each task.
    3. those are resolved exactly where they are, as a row holds all of its
       slices, and the ones that reach the cutoff are returned; their best k are the result.

    A task returns at most k rows for each query and phase (and the rows that
    tie with a cutoff are cut by id in the same order), so nothing grows with
    the pairs.
    """
    spark = queries.sparkSession
    out = None
    numbered = staged(
        queries.dropDuplicates(["vec_id", "x"])
        .withColumn("dim", F.size("x")), "queries",
    )
    dims = sorted(r.dim for r in numbered.groupBy("dim").count().collect())
    schema = "query_id long, qkey long, vec_id long, score long"
    for dim in dims:
        own = rows.where(F.size("x") == dim)
        mine = numbered.where(F.col("dim") == dim).select("vec_id", "x", "scale", F.xxhash64("x").alias("qkey"))
        last = None
        while True:
            take = mine if last is None else mine.where(
                (F.col("vec_id") > last[0]) | ((F.col("vec_id") == last[0]) & (F.col("qkey") > last[1]))
            )
            got = take.orderBy("vec_id", "qkey").limit(block).collect()
            if not got:
                break
            last = (got[-1].vec_id, got[-1].qkey)
            ids = np.array([r.vec_id for r in got])
            keys = np.array([r.qkey for r in got])
            with np.errstate(over="ignore"):
                q = np.floor(np.array([r.x for r in got], dtype=np.float64) * got[0].scale)
            first = own.mapInArrow(_gather(q, ids, keys, k, lists, dim), schema)
            upto = W.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
            merged = first.dropDuplicates().withColumn("r", F.row_number().over(upto)).where(F.col("r") <= k)
            cutoff = {
                (r.query_id, r.qkey): r.least for r in
                merged.groupBy("query_id", "qkey").agg(F.min("score").alias("least"), F.count("*").alias("n"))
                .where(F.col("n") >= k).collect()
            }
            cut = np.array([cutoff.get((i, h), -(1 << 63)) for i, h in zip(ids.tolist(), keys.tolist())])
            found = own.mapInArrow(_resolve(q, ids, keys, cut, k, lists, dim), schema)
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _table(ids, keys, found) -> pa.RecordBatch:
    at = np.concatenate([np.full(len(v), i) for i, v, _ in found]).astype(int) if found else np.empty(0, dtype=int)
    vec = np.concatenate([v for _, v, _ in found]) if found else np.empty(0, dtype=np.int64)
    score = np.concatenate([s for _, _, s in found]) if found else np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at], pa.int64()), pa.array(keys[at], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
        names=["query_id", "qkey", "vec_id", "score"],
    )


def _gather(q: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int, lists: int, dim: int):
    """Phase 1 of a task: the k best of each list, scored in full, the k best of these kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column("vec_id").to_numpy()
            x = _matrix(batch.column("x"), dim, batch.column("scale")[0].as_py())
            seen: list[set] = [set() for _ in ids]
            for a, b in _cuts(dim, lists):
                part = _products(q[:, a:b], x[:, a:b])
                for i in range(len(ids)):
                    part[i, vec == ids[i]] = -(1 << 63)
                near = np.argpartition(part, max(0, part.shape[1] - k), axis=1)[:, max(0, part.shape[1] - k) :]
                for i in range(len(ids)):
                    seen[i].update(near[i].tolist())
            for i in range(len(ids)):
                at = np.array([j for j in sorted(seen[i]) if vec[j] != ids[i]], dtype=int)
                if not len(at):
                    continue
                total = _products(q[i : i + 1], x[at])[0]
                old = kept[i]
                v = np.concatenate([old.get("v", np.empty(0, dtype=np.int64)), vec[at]])
                s = np.concatenate([old.get("s", np.empty(0, dtype=np.int64)), total])
                best = _best(s, v, k)
                kept[i] = {"v": v[best], "s": s[best]}
        yield _table(ids, keys, [(i, o["v"], o["s"]) for i, o in enumerate(kept) if o])

    return run


def _resolve(q: np.ndarray, ids: np.ndarray, keys: np.ndarray, cut: np.ndarray, k: int, lists: int, dim: int):
    """Phases 2 and 3 of a task: rows with a partial score at the uniform threshold, scored in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in ids]
        # any part >= cutoff / lists, in whole numbers: part >= ceil(cutoff / lists)
        parts = len(_cuts(dim, lists))
        least = np.array([c if c == -(1 << 63) else -(-c // parts) for c in cut.tolist()], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column("vec_id").to_numpy()
            x = _matrix(batch.column("x"), dim, batch.column("scale")[0].as_py())
            enough = np.zeros((len(ids), len(vec)), dtype=bool)
            for a, b in _cuts(dim, lists):
                enough |= _products(q[:, a:b], x[:, a:b]) >= least[:, None]
            for i in range(len(ids)):
                at = np.flatnonzero(enough[i] & (vec != ids[i]))
                if not len(at):
                    continue
                total = _products(q[i : i + 1], x[at])[0]
                good = total >= cut[i]
                v, s = vec[at][good], total[good]
                if not len(v):
                    continue
                old = kept[i]
                v = np.concatenate([old.get("v", np.empty(0, dtype=np.int64)), v])
                s = np.concatenate([old.get("s", np.empty(0, dtype=np.int64)), s])
                best = _best(s, v, k)
                kept[i] = {"v": v[best], "s": s[best]}
        yield _table(ids, keys, [(i, o["v"], o["s"]) for i, o in enumerate(kept) if o])

    return run


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
