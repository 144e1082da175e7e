"""Vector centroids, drift and nearest documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions import numbers as N
from ..session import shared_dir

MAX_QUERY_BLOCK = 1024
MOST_SCORES = 2 << 20
HELD_BLOCKS = 16


def centroid(df: DataFrame, vec: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean. Only (group, position) sums are shuffled."""
    by = list(by)
    means = (
        df.select(*by, F.posexplode(vec).alias("__pos", "__v"))
        .groupBy(*by, "__pos")
        .agg(F.avg(F.col("__v").cast("double")).alias("__m"), F.count(F.lit(1)).alias("__n"))
    )
    # One entry per dimension of the vector.
    ordered = F.sort_array(F.collect_list(F.struct("__pos", "__m")))
    return means.groupBy(*by).agg(
        F.transform(ordered, lambda p: p["__m"]).alias("centroid"), F.max("__n").alias("n")
    )


def semantic_drift(
    base: DataFrame, current: DataFrame, vec: str = "embedding", by: Sequence[str] = (),
    threshold: float = S.DRIFT_THRESHOLD, digits: int | None = 4,
) -> DataFrame:
    """1 - cosine between the base centroid and each current one, with an alert flag."""
    reference = centroid(base, vec).select("centroid").scalar()
    drift = F.lit(1.0) - N.cosine_similarity("centroid", "__ref")
    value = N.round_even(drift, digits) if digits is not None else drift
    both = centroid(current, vec, by).withColumn("__ref", reference)
    return both.select(*by, value.alias("drift"), (value > threshold).alias("alert"))


def matrix_of(values: pa.Array, n: int) -> np.ndarray:
    """``n`` vectors end to end as rows of doubles."""
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def first_of_each(group: np.ndarray, distance: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest (distance, id) of each group, in order."""
    values = ids.to_pandas()
    rank = values.to_numpy() if values.dtype.kind in "iu" else pd.factorize(values, sort=True)[0]
    order = np.lexsort((rank, distance, group))
    sorted_group = group[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group) < k]


def nearest(q: np.ndarray, d: np.ndarray, ids: pa.Array, k: int, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``d``, squared distance) of the ``k`` nearest to each, ties by id; none beyond ``worst``.

    Products tell which rows can be among them, with slack for their rounding; distances of those are exact.
    """
    found = []
    d2, step = (d * d).sum(axis=1), max(1, MOST_SCORES // max(1, len(d)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        q2 = (part * part).sum(axis=1)
        near = q2[:, None] + d2[None, :] - 2.0 * (part @ d.T)
        slack = 1e-9 * (q2 + d2.max() + 1.0)
        limit = np.full(len(part), np.inf) if worst is None else worst[at : at + step] + slack
        good = near <= limit[:, None]
        if k < len(d) and good.sum() > 4 * k * len(part):
            good &= near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None]
        qi, di = np.nonzero(good)
        cuts = range(0, len(qi), max(1, MOST_SCORES // q.shape[1]))
        exact = [((part[qi[c : c + cuts.step]] - d[di[c : c + cuts.step]]) ** 2).sum(axis=1) for c in cuts]
        exact = np.concatenate(exact) if exact else np.empty(0)
        best = first_of_each(qi, exact, ids.take(pa.array(di)), k)
        found.append((qi[best] + at, di[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(rows: DataFrame, vec: str, block: int, max_bytes: int) -> DataFrame:
    """One row for ``block`` rows, or as many as ``max_bytes`` hold: the columns as lists, vectors end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = max(1, min(block, max_bytes // (8 * max(1, len(batch.column(vec)[0])))))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values = [part.column(c).flatten() if c == vec else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) for v in values], names=part.schema.names)

    kinds = ", ".join(f"`{c}` {kind}" if c == vec else f"`{c}` array<{kind}>" for c, kind in rows.dtypes)
    return rows.mapInArrow(run, kinds)


def topk_similar(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 3,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vec: str = "embedding",
    block: int = MAX_QUERY_BLOCK,
    max_bytes: int = 8 << 20,
) -> DataFrame:
    """The ``k`` documents nearest to each query (squared distance), exact.

    Different vectors under one ``query_id`` are queries of their own, ranked
    apart; rows that repeat a query count once. Queries and documents are written as blocks
    of ``block`` rows, or fewer where their vectors would take more than ``max_bytes``;
    Spark pairs the blocks, and a task keeps only the ``k`` best of each query over the blocks
    of documents it sees. Neither side passes the driver, and pairs of rows are never shuffled.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    qkind = dict(queries.dtypes)[query_id]
    double = F.col(vec).cast("array<double>").alias("v")
    asked = queries.select(F.col(query_id).alias("query"), F.xxhash64(vec).alias("qvec"), double).dropDuplicates(["query", "qvec"])
    rows = docs.select(F.col(doc_id).alias("doc"), double)
    sides = []
    for name, side in (("queries", asked), ("docs", rows)):
        path = shared_dir(spark, "nearest-" + name)
        _blocks(side, "v", block, max_bytes).write.parquet(path)
        sides.append(spark.read.parquet(path))
    numbered = sides[0].withColumnRenamed("v", "q").withColumn("block", F.xxhash64("query", "qvec"))
    schema = f"query {qkind}, qvec long, doc {kinds[doc_id]}, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # block of queries -> ids, vector hashes, row of the block, documents, distances

        def out(kept: tuple) -> pa.RecordBatch:
            query, qvec, row, doc, distance = kept
            at = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [query.take(at), qvec.take(at), doc, pa.array(distance)], names=["query", "qvec", "doc", "distance"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                key, query, doc = one["block"].as_py(), one["query"].values, one["doc"].values
                n = len(query)
                q = matrix_of(one["q"].values, n)
                d = matrix_of(one["v"].values, len(doc))
                if q.shape[1] != d.shape[1]:
                    raise ValueError(f"vectors of {q.shape[1]} and {d.shape[1]} components")
                if key not in held and len(held) >= HELD_BLOCKS:
                    yield out(held.pop(next(iter(held))))
                if key in held:
                    _, _, row, docs_, distance = held[key]
                    worst = np.full(n, np.inf)
                    counts = np.bincount(row, minlength=n)
                    full = np.flatnonzero(counts >= k)
                    worst[full] = distance[np.cumsum(counts)[full] - 1]
                    qi, di, new = nearest(q, d, doc, k, worst)
                    row, distance = np.concatenate([row, qi]), np.concatenate([distance, new])
                    both = pa.concat_arrays([docs_, doc.take(pa.array(di))])
                    best = first_of_each(row, distance, both, k)
                    held[key] = query, one["qvec"].values, row[best], both.take(pa.array(best)), distance[best]
                else:
                    qi, di, new = nearest(q, d, doc, k)
                    held[key] = query, one["qvec"].values, qi, doc.take(pa.array(di)), new
        for kept in held.values():
            yield out(kept)

    found = numbered.crossJoin(sides[1]).mapInArrow(run, schema)
    w = Window.partitionBy("query", "qvec").orderBy("distance", "doc")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "distance", "rank")
