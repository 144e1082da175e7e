"""Tables whose partitions are replaced without ever touching the files that readers use.

A table is a folder. Each change writes its partitions below ``version=n``,
then ``_parts/version=n``, a small table that tells for every partition of
the whole table which version holds its rows, and last the file
``_commits/n``: the pointer. Readers follow the highest pointer. A job that
dies before its pointer is written leaves the table as it was; the next one
writes over what it left. The pointer also names the writer and its batch,
so a batch that is sent again changes nothing.

Values of partition columns must not be null. One writer at a time: of two that
make the same version, the second fails when it writes its pointer.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

VERSION = "version"


@dataclass(frozen=True)
class Pointer:
    """What the newest pointer of a table says; version 0 is the empty table."""

    version: int = 0
    by: tuple[str, ...] = ()
    schema: StructType | None = None
    batches: dict[str, int] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def pointer(spark: SparkSession, root: str, version: int | None = None) -> Pointer:
    """The newest pointer, or that of a version that is still kept."""
    found = [int(n) for n in _children(spark, f"{root}/_commits") if n.isdigit()]
    if version is None:
        version = max(found, default=0)
    elif version not in found:
        raise ValueError(f"{root} has no version {version}")
    if version == 0:
        return Pointer()
    fs, p = _path(spark, f"{root}/_commits/{version}")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    said = json.loads(text)
    return Pointer(version, tuple(said["by"]), StructType.fromJson(said["schema"]), said["batches"])


def _parts(spark: SparkSession, root: str, at: Pointer) -> DataFrame:
    fields = [at.schema[c] for c in at.by]
    return spark.read.schema(StructType(fields).add(VERSION, LongType())).parquet(f"{root}/_parts/{VERSION}={at.version}")


def read(spark: SparkSession, root: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Rows of the newest version, or of an older one; ``only`` names partitions to read (their columns).

    The list of partitions is joined by partition columns alone, so Spark
    prunes the folders that it does not name.
    """
    at = pointer(spark, root, version)
    if at.version == 0:
        raise FileNotFoundError(f"no version in {root}")
    # always true; a join side with a filter is one that Spark prunes folders by
    parts = _parts(spark, root, at).where(F.col(VERSION) <= at.version)
    if only is not None:
        parts = parts.join(only.select(*at.by).distinct(), list(at.by), "left_semi")
    live = [r[0] for r in _parts(spark, root, at).select(VERSION).distinct().collect()]  # at most one a change
    kinds = StructType([*at.schema.fields]).add(VERSION, LongType())
    if not live:
        return spark.createDataFrame([], kinds).select(*at.schema.names)
    stored = spark.read.schema(kinds).option("basePath", root).parquet(*[f"{root}/{VERSION}={v}" for v in live])
    return stored.join(parts, [*at.by, VERSION], "left_semi").select(*at.schema.names)


def replace(
    df: DataFrame, root: str, by: Sequence[str], writer: str | None = None, batch: int | None = None,
) -> Pointer:
    """Replace the partitions present in ``df``, leave the others; returns the new pointer.

    With ``writer`` and ``batch``, a batch not above the last one of this
    writer changes nothing.
    """
    spark = df.sparkSession
    at = pointer(spark, root)
    if writer is not None and batch is not None and at.batches.get(writer, -1) >= batch:
        return at
    if at.version and (at.by != tuple(by) or sorted(at.schema.names) != sorted(df.columns)):
        raise ValueError(f"columns {df.columns} by {list(by)} are not those of {root}: {at.schema.names} by {list(at.by)}")
    n = at.version + 1
    schema = at.schema or StructType([*[f for f in df.schema if f.name not in by], *[df.schema[c] for c in by]])
    data = f"{root}/{VERSION}={n}"
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").partitionBy(*by).parquet(data)
    written = spark.read.schema(schema).parquet(data).select(*by).distinct().withColumn(VERSION, F.lit(n).cast("long"))
    if at.version:
        written = written.unionByName(_parts(spark, root, at).join(written.select(*by), list(by), "left_anti"))
    written.write.mode("overwrite").parquet(f"{root}/_parts/{VERSION}={n}")
    batches = dict(at.batches) if writer is None or batch is None else {**at.batches, writer: batch}
    said = {"by": list(by), "schema": schema.jsonValue(), "batches": batches}
    _publish(spark, f"{root}/_commits/{n}", json.dumps(said))
    return Pointer(n, tuple(by), schema, batches)


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then rename it; fails if the file is there already."""
    fs, p = _path(spark, path)
    _, draft = _path(spark, f"{path}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        raise FileExistsError(f"another writer has made {path}")


def tidy(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete pointers older than the last ``keep`` and the versions that no kept one names; returns those versions."""
    commits = sorted(int(n) for n in _children(spark, f"{root}/_commits") if n.isdigit())
    kept, old = commits[-keep:], commits[:-keep]
    live: set[int] = set()
    for n in kept:
        live |= {r[0] for r in _parts(spark, root, pointer(spark, root, n)).select(VERSION).distinct().collect()}
    for n in old:
        for path in (f"{root}/_commits/{n}", f"{root}/_parts/{VERSION}={n}"):
            fs, p = _path(spark, path)
            fs.delete(p, True)
    stale = [n for n in old if n not in live]
    for n in stale:
        fs, p = _path(spark, f"{root}/{VERSION}={n}")
        fs.delete(p, True)
    return stale
