"""Small helpers of the operators in this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stationflow.session import shared_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Cuts the lineage: later jobs read files that survive a lost executor
    instead of repeating the work.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def written(df: DataFrame, purpose: str, make: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
    """As ``staged`` for operators on Arrow batches; in a local folder each task writes its file itself.

    For the mode of each file that Spark's writer creates in a local folder, Hadoop starts two child
    processes of the executor, and a child that is just being started shares, and counts, all its memory.
    ``make`` is applied to the batches before, as by ``mapInArrow`` with ``schema``. Each batch is a row group.
    A file gets its name when it is whole; a task that is run again replaces it.
    """
    spark = df.sparkSession
    made = df.mapInArrow(make, schema) if make else df
    path = shared_dir(spark, purpose)
    if not path.startswith("file:/"):
        made.write.parquet(path)
        return spark.read.schema(made.schema).parquet(path)
    folder = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(folder)

    def run(batches: Batches) -> Batches:
        part = f"part-{TaskContext.get().partitionId():05d}.parquet"
        name, out = f"{folder}/.{part}-{TaskContext.get().taskAttemptId()}", None
        try:
            for batch in make(batches) if make else batches:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(name, batch.schema, use_dictionary=False)
                    out.write_table(pa.Table.from_batches([batch]))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            os.replace(name, f"{folder}/{part}")
        yield from ()

    df.mapInArrow(run, "done boolean").collect()
    return spark.read.schema(made.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs run inside send rows to Python in batches of this size; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def text_key(text: Column) -> Column:
    """Digest of a text; tells rows apart that share a ``doc_id``."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` and the ASCII rule agree on texts of one-byte characters;
    the others are translated letter by letter.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def held_out(doc_id: Column, of: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold`` (null ids: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == fold, F.lit(False))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges [start, start + length), one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths) + np.arange(int(lengths.sum()))


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``, one row at least."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
