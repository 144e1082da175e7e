"""Python data sources that read large files piece by piece: members of zip archives, digests of files.

A file is opened where it lies and read by ranges; no file or member is held whole.
"""

from __future__ import annotations

import hashlib
import io
import os
import pathlib
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES = 8 << 20
MOST_FILES = 500


def _filesystem(path: str):
    from pyarrow import fs

    uri = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
    scheme, name = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(name, safe='/:@?&=,+~')}")  # a percent sign is part of a name


def open_file(path: str) -> io.BufferedReader:
    """A file on any storage that pyarrow knows, read by ranges."""
    system, name = _filesystem(path)
    return system.open_input_file(name)


def create_file(path: str):
    """A new file to write to, with the folders above it."""
    system, name = _filesystem(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def clear(folder: str) -> None:
    """Remove the files of a folder, which may not be there."""
    from pyarrow import fs

    system, name = _filesystem(folder)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir_contents(name)


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_lines(rows: DataFrame, root: str, by: Sequence[str], order: Sequence[str], value: str = "value") -> int:
    """A text file ``name=value/.../lines.txt`` for each different ``by``, lines in ``order``; gives the number of files.

    Meant for very many small files: a task opens each file where it lies and streams its rows into it, so a file costs no
    folder of an attempt, no move and no permission call. A task that is run again writes the same files again. Values
    in names are quoted as in addresses, nulls are ``NO_VALUE``.
    """
    system, base = _filesystem(root)
    system.create_dir(base, recursive=True)
    keys = [F.col(c).cast("string").alias(c) for c in by]
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order).select(*keys, F.coalesce(F.col(value), F.lit("")).alias(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(root)
        last, out, n = None, None, 0
        try:
            for batch in batches:
                lines = batch.column(value).to_pylist()
                at = 0
                for key, own in groupby(zip(*[batch.column(c).to_pylist() for c in by])):
                    size = len(list(own))
                    if key != last:
                        if out is not None:
                            out.close()
                        folder = "/".join([base, *[f"{c}={NO_VALUE if v is None else quote(v, safe='')}" for c, v in zip(by, key)]])
                        system.create_dir(folder, recursive=True)
                        last, out, n = key, system.open_output_stream(folder + "/lines.txt"), n + 1
                    out.write("".join(line + "\n" for line in lines[at : at + size]).encode())
                    at += size
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return dealt.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def files_under(root: str, suffixes: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of one file, by name."""
    from pyarrow import fs

    system, base = _filesystem(root)
    info = system.get_file_info(base)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
    # hidden and unfinished files begin with a dot or a line
    shown = [f for f in found if f.is_file and not any(p.startswith((".", "_")) for p in f.path[len(base):].split("/") if "=" not in p)]
    prefix = root[: root.index("://") + 3] if "://" in root else ""
    return sorted((f"{prefix}{f.path}", f.size) for f in shown if not suffixes or f.path.lower().endswith(tuple(suffixes)))


def table_members(archive: zipfile.ZipFile, suffix: str = ".csv") -> list[tuple[str, str]]:
    """(name, member) of the tables in an archive: folders are dropped, equal names get ``_1``, ``_2``, ..."""
    taken: dict[str, str] = {}
    for info in archive.infolist():
        base = pathlib.PurePosixPath(info.filename)
        if info.is_dir() or base.suffix.lower() != suffix:
            continue
        name, copy = base.name, 0
        while name in taken:
            copy += 1
            name = f"{base.stem}_{copy}{base.suffix}"
        taken[name] = info.filename
    return list(taken.items())


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    member: str


class MembersReader(DataSourceReader):
    """Plans one partition for each member, from the directories at the ends of the archives."""

    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[Member]:
        planned = []
        for path, _ in files_under(self.path, (".zip",)):
            with open_file(path) as f, zipfile.ZipFile(f) as archive:
                members = table_members(archive)
            if not members:
                raise ValueError(f"no CSV in archive {path}")
            planned += [Member(path, name, member) for name, member in members]
        return planned or [Member("", "", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        with open_file(partition.archive) as f, zipfile.ZipFile(f) as archive, archive.open(partition.member) as member:
            part = 0
            data = member.read(self.chunk)
            while data or not part:  # an empty member is one empty part
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.archive]), pa.array([partition.name]), pa.array([partition.member]),
                     pa.array([part], pa.int64()), pa.array([data], pa.binary())],
                    names=["archive", "name", "member", "part", "content"],
                )
                part += 1
                data = member.read(self.chunk)


class MembersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, member string, part bigint, content binary"

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options["path"], int(self.options.get("chunk", CHUNK_BYTES)))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class DigestReader(DataSourceReader):
    """Plans partitions of about equal bytes or ``MOST_FILES`` files, a large file alone; hashes each file as it is read."""

    def __init__(self, path: str, suffixes: Sequence[str], chunk: int, split: int):
        self.path, self.suffixes, self.chunk, self.split = path, suffixes, chunk, split

    def partitions(self) -> list[Files]:
        planned, own, size = [], [], 0
        for path, n in files_under(self.path, self.suffixes):
            own.append((path, n))
            size += n
            if size >= self.split or len(own) >= MOST_FILES:
                planned.append(Files(own))
                own, size = [], 0
        return planned + ([Files(own)] if own or not planned else [])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, n in partition.files:
            digest = hashlib.sha256()
            with open_file(path) as f:
                while data := f.read(self.chunk):
                    digest.update(data)
            rows.append((path, n, digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "length", "sha256"])


class DigestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, length bigint, sha256 string"

    def reader(self, schema) -> DigestReader:
        of = self.options
        suffixes = [s for s in of.get("suffixes", "").split(",") if s]
        return DigestReader(of["path"], suffixes, int(of.get("chunk", CHUNK_BYTES)), int(of.get("split", 128 << 20)))


def read_members(spark: SparkSession, root: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``archive name member part content`` of the tables in the zip archives below ``root``, ``chunk`` bytes a row."""
    spark.dataSource.register(MembersSource)
    return spark.read.format("zip_members").option("path", root).option("chunk", chunk).load()


def read_digests(spark: SparkSession, root: str, suffixes: Sequence[str] = (), split: int = 128 << 20) -> DataFrame:
    """``path length sha256`` of the files below ``root``."""
    spark.dataSource.register(DigestSource)
    return spark.read.format("file_digests").option("path", root).option("suffixes", ",".join(suffixes)).option("split", split).load()
