"""WARC archives as a Spark data source, and payloads stored once.

The source ``warc`` writes and reads uncompressed WARC/1.1 files. A null url is
left out, a null payload is empty, a null id has an empty record id. Rows that
repeat an id are separate records. Empty tables give an archive without records,
which reads back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from stationflow.session import shared_dir

from .common import staged

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
EPOCH = "1970-01-01T00:00:00Z"


def _filesystem(path: str):
    """File system and path inside it, for any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(row: dict) -> bytes:
    """A record; revisits carry no payload."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    block = b"" if kind == "revisit" else (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    ) + payload
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        value = row.get(name)
        if value is not None:
            value = f"<{_line(value)}>" if name in ("record_id", "refers_to") else _line(str(value))
            lines.append(f"{header}: {'sha1:' if name == 'payload_digest' else ''}{value}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, each with the offsets at which it can be split."""

    files: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Every attempt writes files of its own; those of the attempts that count are listed in a manifest."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        done, out, name, at, cuts = Written(), None, None, 0, []

        def close():
            if out is not None:
                out.close()
                done.files.append({"name": name, "size": at, "cuts": cuts})

        for batch in iterator:
            columns = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                if out is None or at >= FILE_BYTES:
                    close()
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done.files)}.warc"
                    out, at, cuts = system.open_output_stream(f"{base}/{name}", buffer_size=1 << 20), 0, [0]
                elif at - cuts[-1] >= SPLIT_BYTES:
                    cuts.append(at)
                data = record_bytes({c: v[i].as_py() for c, v in columns.items()})
                out.write(data)
                at += len(data)
        close()
        return done

    def commit(self, messages: list) -> None:
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        system, base = _filesystem(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{base}/{f['name']}")


@dataclass
class Range(InputPartition):
    """A run of whole records."""

    name: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    """Reads headers first; the blocks of records that filters rule out, or whose payload nobody asked for, are skipped."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.wanted = path, names, {}

    def pushFilters(self, filters):
        """Take equality and membership tests on header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_bytes" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name in self.wanted):
                yield f

    def partitions(self) -> list[Range]:
        """Ranges from the manifest; without one, every file of the folder whole."""
        from pyarrow import fs

        system, base = _filesystem(self.path)
        if system.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
        else:
            found = system.get_file_info(fs.FileSelector(base))
            files = [{"name": x.base_name, "size": x.size, "cuts": [0]} for x in found if x.base_name.endswith(".warc")]
        out = [
            Range(f["name"], a, b) for f in sorted(files, key=lambda f: f["name"])
            for a, b in zip(f["cuts"], [*f["cuts"][1:], f["size"]])
        ]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, base = _filesystem(self.path)
        kinds = {n: pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in self.names}
        rows: dict[str, list] = {n: [] for n in self.names}
        count = size = 0
        with io.BufferedReader(system.open_input_file(f"{base}/{partition.name}"), 1 << 20) as f:
            f.seek(partition.start)
            while f.tell() < partition.end:
                headers, length = self._headers(f)
                after = f.tell() + length + 4
                if all(headers.get(n) in values for n, values in self.wanted.items()):
                    for n in self.names:
                        rows[n].append(self._payload(f, headers, length) if n == "payload" else headers.get(n))
                    count += 1
                    size += length if "payload" in rows else 0
                f.seek(after)
                if count >= 5_000 or size >= 16 << 20:
                    yield self._batch(rows, kinds)
                    rows, count, size = {n: [] for n in self.names}, 0, 0
        if count:
            yield self._batch(rows, kinds)

    @staticmethod
    def _batch(rows: dict[str, list], kinds: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in rows.items()], names=list(rows))

    @staticmethod
    def _headers(f) -> tuple[dict, int]:
        """Header values by column name, and the length of the block."""
        line = f.readline()
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {f.tell() - len(line)}")
        found = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            found[key.strip().lower()] = value.strip()
        out = {n: found[h.lower()] for n, h in HEADERS.items() if h.lower() in found}
        for n in ("record_id", "refers_to"):
            if n in out:
                out[n] = out[n].removeprefix("<").removesuffix(">")
        if "payload_digest" in out:
            out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
        length = int(found["content-length"])
        out["payload_bytes"] = int(out["payload_bytes"]) if "payload_bytes" in out else None
        return out, length

    @staticmethod
    def _payload(f, headers: dict, length: int) -> bytes | None:
        if headers.get("record_type") == "revisit":
            return None
        block = f.read(length)
        return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; leave ``payload`` out of the schema to skip all payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let it take filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of an archive folder, by default without payloads."""
    register(spark)
    schema = SCHEMA if payload else SCHEMA.replace(", payload binary", "")
    return spark.read.format("warc").schema(schema).load(path)


def digests(pages: DataFrame) -> DataFrame:
    """``page_id url payload payload_bytes payload_digest`` of pages (``page_id url html``)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )

    @F.pandas_udf("string")
    def sha1(payloads):
        return payloads.map(lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode())

    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", sha1("payload")
    )


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, date: str = EPOCH) -> None:
    """Write a record for each page; equal payloads of ``least_bytes`` or more are stored once.

    Of records with an equal payload, the one with the largest ``page_id`` is the
    response and the others revisit it. Payloads are compared by digest and
    length. Only the groups of two or more meet the pages again, one row each;
    they are written first, so Spark knows their size and deals pages out only if it must.
    """
    spark = pages.sparkSession
    register(spark)
    rows = digests(pages)
    groups = (
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    groups = staged(groups, "payloads")
    typed = rows.join(groups, ["payload_digest", "payload_bytes"], "left").withColumn(
        "again", F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    )
    typed.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), "payload_digest",
        F.when(F.col("again"), F.concat(F.lit("urn:page:"), F.col("kept"))).alias("refers_to"), "payload_bytes",
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages as an archive in the shared folder and read its headers back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_pages(pages, path)
    number = F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1)
    refers = F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1)
    return read_warc(spark, path).select(
        F.when(number != "", number).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {5 * j + 1}, 5) AS BIGINT) >> {15 - 5 * i}) & 31 AS INTEGER), 1)"
    for j in range(8) for i in range(4)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY t) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to FROM d
"""
