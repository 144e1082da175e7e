"""Index for nearest documents: random-projection buckets, stored as a partitioned table, with exact re-scoring.

Each table cuts space by a few random projections into cells of one width; near
vectors share a cell of some table with the wanted probability. Vectors that are null or
of another length take no part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from .retrieval import matrix_of, nearest, topk_similar

SAMPLE_QUERIES = 64
SAMPLE_VECTORS = 2_000
MOST_TABLES = 24
MOST_HASHES = 12
SHARD_ROWS = 1_000_000
MOST_IDS = 100
FULL_BYTES = 32 << 20
SEND_ROWS = 10_000


def meeting(distance: np.ndarray, width: float) -> np.ndarray:
    """Chance that two vectors fall into the same cell of one random projection."""
    u = width / np.maximum(distance, 1e-12)
    tail = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.ravel(u)]).reshape(np.shape(u))
    return np.clip(1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * u) * (1 - np.exp(-u * u / 2)), 0.0, 1.0)


@dataclass(frozen=True)
class Projections:
    """``tables`` tables of ``hashes`` projections each, with cells of ``width``; drawn from ``seed``."""

    dim: int
    width: float
    hashes: int
    tables: int
    seed: int = 1

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """One number for each vector (row) and table."""
        rng = np.random.default_rng(self.seed)
        a = rng.normal(size=(self.tables * self.hashes, self.dim))
        shift = rng.uniform(0, self.width, len(a))
        cells = np.floor((x @ a.T + shift) / self.width).astype(np.int64).reshape(len(x), self.tables, self.hashes)
        out = np.zeros((len(x), self.tables), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.hashes):
                out = (out ^ cells[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)


def fit_projections(docs: DataFrame, k: int = 3, target: float = 0.95, doc_id: str = "doc_id", vec: str = "embedding", seed: int = 1) -> Projections:
    """Projections that find the ``k`` nearest with about the ``target`` chance and the fewest candidates.

    The distance to reach is measured: ``SAMPLE_QUERIES`` documents, drawn by a hash, are searched
    exactly among all. ``SAMPLE_VECTORS`` documents tell how far apart vectors are otherwise.
    """
    good = docs.select(doc_id, vec).where(F.col(vec).isNotNull() & (F.size(vec) > 0))
    drawn = good.orderBy(F.xxhash64(doc_id, F.lit(seed)), doc_id).limit(SAMPLE_VECTORS).collect()
    if not drawn:
        return Projections(1, 1.0, 1, 1, seed)
    x = np.array([r[1] for r in drawn if len(r[1]) == len(drawn[0][1])], dtype=np.float64)
    spark = docs.sparkSession
    same = good.where(F.size(vec) == x.shape[1])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:SAMPLE_QUERIES])], f"query_id long, {vec} array<double>")
    found = topk_similar(asked, same, k + 1, "query_id", doc_id, vec).groupBy("query_id").agg(F.max("distance").alias("d")).collect()
    radius = math.sqrt(float(np.quantile([r.d for r in found], 0.9))) or 1e-9
    apart = np.sqrt(np.maximum(((x[:SAMPLE_QUERIES, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0)).ravel()
    best = None
    for width in radius * np.array([1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]):
        near, other = float(meeting(np.array([radius]), width)[0]), meeting(apart, width)
        for hashes in range(1, MOST_HASHES + 1):
            p = near**hashes
            tables = math.ceil(math.log(1 - target) / math.log(1 - p)) if p < 1 else 1
            if tables > MOST_TABLES:
                break
            share = float((1 - (1 - other**hashes) ** tables).mean())
            cost = share * len(x) + tables  # candidates of the sample, and a reading of each table
            if best is None or cost < best[0]:
                best = (cost, Projections(x.shape[1], float(width), hashes, max(1, tables), seed))
    return best[1]


def _bucketed(rows: DataFrame, projections: Projections, vec: str) -> DataFrame:
    """Rows with ``table`` and ``bucket``, one for each table."""
    kept = rows.where(F.size(vec) == projections.dim).withColumn(vec, F.col(vec).cast("array<double>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(buckets=projections.buckets(np.array(pdf[vec].tolist(), dtype=np.float64)).tolist())

    schema = kept.selectExpr("*", "array(0L) buckets").schema
    return kept.mapInPandas(run, schema).select(*kept.columns, F.posexplode("buckets").alias("table", "bucket"))


def build_index(docs: DataFrame, path: str, projections: Projections, doc_id: str = "doc_id", vec: str = "embedding", shards: int | None = None) -> None:
    """Write the index: ``path``/``rows`` dealt into folders by table and shard of the bucket, ``path``/``projections``.

    Documents of equal vectors are one row with its ``MOST_IDS`` smallest ids, so copies do not fill a
    bucket; no search for that many results or fewer needs the others.
    """
    spark = docs.sparkSession
    good = docs.select(doc_id, vec).where(F.col(vec).isNotNull())
    numbered = good.withColumn("__r", F.row_number().over(Window.partitionBy(vec).orderBy(doc_id))).where(F.col("__r") <= MOST_IDS)
    one = numbered.groupBy(vec).agg(F.sort_array(F.collect_list(doc_id)).alias("ids"))
    shards = shards or max(1, good.count() // SHARD_ROWS)
    rows = _bucketed(one, projections, vec).withColumn("shard", F.pmod("bucket", F.lit(shards)).cast("int"))
    spread = F.pmod(F.xxhash64(vec), F.lit(8))  # a full bucket goes into several files
    rows.repartition("table", "shard", spread).write.partitionBy("table", "shard").parquet(f"{path}/rows")
    note = json.dumps({**asdict(projections), "shards": shards})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{path}/projections")


def read_index(spark: SparkSession, path: str) -> tuple[Projections, int]:
    """The projections of an index and its number of shards."""
    note = json.loads(spark.read.text(f"{path}/projections").first().value)
    shards = note.pop("shards")
    return Projections(**note), shards


def search_index(queries: DataFrame, path: str, k: int = 3, query_id: str = "query_id", doc_id: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` (at most ``MOST_IDS``) nearest documents of each query among those that share a bucket: ``query_id doc_id distance rank``.

    Rows and queries of a bucket lie one after the other in a task: the rows are held, the queries stream past them, and
    only ``k`` results of a query leave the bucket. Buckets of more than ``FULL_BYTES`` are spread over several tasks. Nothing passes
    the driver; folders that no query needs are left out by Spark where the queries are few. Distances are exact.
    Different vectors under one id are ranked apart, as in ``topk_similar``.
    """
    if k > MOST_IDS:
        raise ValueError(f"k is at most {MOST_IDS}")
    spark = queries.sparkSession
    projections, shards = read_index(spark, path)
    asked = queries.select(F.col(query_id).alias("query"), F.col(vec).alias("v")).withColumn("qvec", F.xxhash64("v")).dropDuplicates(["query", "qvec"])
    asked = _bucketed(asked, projections, "v").withColumn("shard", F.pmod("bucket", F.lit(shards)).cast("int"))
    index = spark.read.parquet(f"{path}/rows")
    cell, most = ["table", "bucket"], max(1, FULL_BYTES // (8 * projections.dim))
    parts = F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")
    crowded = index.groupBy(*cell).agg(parts).where("parts > 1")
    wanted = index.join(asked.select("table", "shard").distinct(), ["table", "shard"], "left_semi")
    own = F.pmod(F.xxhash64(vec), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    rows = wanted.join(crowded, cell, "left").select(
        *cell, own.alias("salt"), F.lit(False).alias("asks"), F.col(vec).alias("v"), F.xxhash64(vec).alias("dvec"), "ids",
        F.lit(None).cast(asked.schema["query"].dataType).alias("query"), F.lit(None).cast("long").alias("qvec"),
    )
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    probes = asked.join(crowded, cell, "left").select(
        *cell, every.alias("salt"), F.lit(True).alias("asks"), "v", F.lit(None).cast("long").alias("dvec"),
        F.lit(None).cast(index.schema["ids"].dataType).alias("ids"), "query", "qvec",
    )
    dealt = rows.unionByName(probes).repartition(*cell, "salt").sortWithinPartitions(*cell, "salt", "asks")
    kinds = dict(dealt.dtypes)
    met = dealt.mapInArrow(_meet(k, projections.dim), f"query {kinds['query']}, qvec long, dvec long, ids {kinds['ids']}, distance double")
    scored = met.select("query", "qvec", "dvec", "distance", F.explode("ids").alias("doc"))
    near = Window.partitionBy("query", "qvec").orderBy("distance", "doc")
    # a document comes once from each table it shares; as many times k are enough to hold k different ones
    few = scored.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k * projections.tables)
    once = few.dropDuplicates(["query", "qvec", "doc", "dvec"])
    ranked = once.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "distance", "rank")


def _meet(k: int, dim: int):
    """The ``k`` nearest rows of a bucket for each of its queries; rows come before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, packed, made = None, [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "bucket", "salt", "asks")])
            edges = (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if (here := tuple(at[:3, a].tolist())) != cell:
                    cell, held, packed = here, [], None
                part = batch.slice(a, b - a)
                if not at[3, a]:
                    held.append(part)
                    packed = None
                elif held:
                    if packed is None:
                        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        packed = rows, matrix_of(rows.column("v").flatten(), rows.num_rows), pc.list_element(rows.column("ids"), 0)
                    rows, d, first = packed
                    qi, di, distance = nearest(matrix_of(part.column("v").flatten(), part.num_rows), d, first, k)
                    qi, di = pa.array(qi), pa.array(di)
                    made.append(pa.RecordBatch.from_arrays(
                        [part.column("query").take(qi), part.column("qvec").take(qi), rows.column("dvec").take(di), rows.column("ids").take(di), pa.array(distance)],
                        names=["query", "qvec", "dvec", "ids", "distance"],
                    ))
                    if sum(m.num_rows for m in made) >= SEND_ROWS or len(made) >= SEND_ROWS // 10:
                        yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                        made = []
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return run


def indexed(docs: DataFrame, k: int = 3, target: float = 0.95, doc_id: str = "doc_id", vec: str = "embedding") -> str:
    """Fit and build an index in the shared folder; gives its path."""
    path = shared_dir(docs.sparkSession, "vectors")
    build_index(docs, path, fit_projections(docs, k, target, doc_id, vec), doc_id, vec)
    return path


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Share of the exact results that were found: one row, ``results`` and ``recall``."""
    hit = exact.join(found.select(query_id, doc_id, F.lit(1).alias("__hit")), [query_id, doc_id], "left")
    return hit.agg(F.count(F.lit(1)).alias("results"), (F.count("__hit") / F.count(F.lit(1))).alias("recall"))
