"""Raw station files, archives and index pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schema as S
from ..functions import text as X
from ..operators.joins import spread_join
from . import snapshots, streams


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def raw_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = S.RAW_ENCODING) -> DataFrame:
    """Lines of raw files: ``path, at, line``.

    The text source keeps the bytes of a line, so they can be decoded here and
    large files stay splittable.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(_paths(paths))
    return numbered_lines(lines.select("value", *[F.col(LINE_SOURCE[c]).alias(c) for c in ("path", "block")]), encoding)


LINE_SOURCE = {
    "path": "_metadata.file_path", "block": "_metadata.file_block_start", "file_time": "_metadata.file_modification_time",
}


def numbered_lines(lines: DataFrame, encoding: str = S.RAW_ENCODING) -> DataFrame:
    """``path, at, line`` from ``value`` and the columns of ``LINE_SOURCE``; ``at`` orders the lines of a file."""
    kept = [c for c in lines.columns if c not in ("path", "block", "value")]
    return lines.select(
        *kept, "path", F.struct("block", F.monotonically_increasing_id().alias("n")).alias("at"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
    )


def read_station_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    sep: str = S.RAW_SEP,
    encoding: str = S.RAW_ENCODING,
    skip: int = 8,
    required: Sequence[str] = (S.RAW_DATE, S.RAW_HOUR),
) -> DataFrame:
    """Raw station rows, all text: ``path``, ``municipio`` from the file name, the header columns but the last.

    A line is told by its content, as a split of a large file does not know
    its line numbers: the header names the date and hour columns, a data line
    starts with a date. Up to ``skip`` other lines may stand before the header;
    more, or any after it, fail the job. Separators inside quotes belong to
    the value. A name that a header repeats gets ``.1``, ``.2`` and so on.
    ``columns`` fixes the output; without it the headers of all files are
    united by name. Columns a file does not have are null.
    """
    return parse_lines(raw_lines(spark, paths, encoding), columns, sep, skip, required)


def _unquoted(line: Column, sep: str) -> Column:
    """Fields of a line; quotes around a value go, doubled ones inside become one."""
    plain = F.split(line, _literal(sep), -1)
    outside = F.split(line, _literal(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = F.transform(
        outside, lambda x: F.replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"'))
    )
    return F.when(line.contains('"'), bare).otherwise(plain)


def _numbered(names: Column) -> Column:
    """Names with a number added to those that occurred before."""

    def name(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
        return F.when((before > 0) & (x != ""), F.concat_ws(".", x, before.cast("string"))).otherwise(x)

    return F.transform(names, name)


def parse_lines(
    lines: DataFrame, columns: Sequence[str] | None = None, sep: str = S.RAW_SEP, skip: int = 8,
    required: Sequence[str] = (S.RAW_DATE, S.RAW_HOUR),
) -> DataFrame:
    """``read_station_csv`` of lines (``path, at, line`` and columns to keep)."""
    kept = [c for c in lines.columns if c not in ("path", "at", "line")]
    fields = _unquoted(F.col("line"), sep)
    trimmed = F.transform(fields, F.trim)
    is_header = F.lit(True)
    for name in required:
        is_header = is_header & F.array_contains(trimmed, name)
    is_data = F.col("line").rlike(r"^\s*\d{4}[/-]\d{2}[/-]\d{2}\s*" + _literal(sep))
    other = ~is_data & ~is_header & (F.trim("line") != "")
    files = lines.groupBy("path").agg(
        F.min(F.when(is_header & ~is_data, F.struct("at", trimmed.alias("names")))).alias("__first"),
        F.count_if(other).alias("__other"), F.max(F.when(other, F.col("at"))).alias("__last_other"),
    ).select("path", "__other", "__last_other", F.col("__first.at").alias("__at"), _numbered(F.col("__first.names")).alias("__h"))
    problem = F.when(F.col("__h").isNull(), F.lit("no header in ")).when(
        (F.col("__other") > skip) | (F.col("__last_other") > F.col("__at")), F.lit("unreadable lines in ")
    )
    checked = F.when(
        problem.isNotNull(), F.raise_error(F.concat(problem, F.col("path"))).cast("array<string>")
    ).otherwise(F.slice("__h", F.lit(1), F.greatest(F.size("__h") - 1, F.lit(0))))
    slug = X.parse_station_filename(plain_name(X.file_name("path")))["slug"]
    headers = files.select("path", checked.alias("__names"), slug.alias(S.KEY))
    if columns is None:
        # the names themselves come here, one row each: they are the columns of the result
        names = headers.select(F.posexplode("__names").alias("pos", "name")).where("name <> ''")
        columns = [r.name for r in names.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").collect()]
    # One row per file; the lines of a large file are spread, should it not be broadcast.
    body = spread_join(lines.where(is_data), headers, ["path"], ["line"])

    def value(name: str) -> Column:
        at = F.array_position("__names", name)
        return F.when(at > 0, F.nullif(F.get(fields, (at - 1).cast("int")), F.lit(""))).alias(name)

    return body.select("path", S.KEY, *kept, *[value(c) for c in columns])


def plain_name(name: Column) -> Column:
    """File name as it is on disk; paths come URL-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _literal(sep: str) -> str:
    return "\\" + sep if sep in r"|.\^$*+?()[]{}" else sep


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, name, length`` of the files under a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(root)
    )
    return files.select("path", X.file_name("path").alias("name"), "length")


def discover_station_files(spark: SparkSession, root: str) -> DataFrame:
    """``municipio, original, path`` of the station files under a folder."""
    return station_files(list_files(spark, root, "*.{csv,CSV,Csv}"))


def station_files(files: DataFrame, name: str = "name") -> DataFrame:
    parsed = X.parse_station_filename(plain_name(F.col(name)))
    return (
        files.withColumn("__p", parsed).where(F.col("__p").isNotNull())
        .select(F.col("__p.slug").alias(S.KEY), F.col("__p.original").alias("original"), "path")
    )


def discover_staging_files(spark: SparkSession, root: str) -> DataFrame:
    """``municipio, path`` of files named like their folder; a missing folder has none."""
    if not _exists(spark, root):
        return spark.createDataFrame([], f"{S.KEY} string, path string")
    return staging_files(list_files(spark, root, "*.csv"))


def staging_files(files: DataFrame) -> DataFrame:
    """Rows of ``path`` whose file is named like its folder."""
    folder = F.element_at(F.split("path", "/"), -2)
    return files.where(X.file_name("path") == F.concat(folder, F.lit(".csv"))).select(
        folder.alias(S.KEY), "path"
    )


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_staging(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Clean rows from staging: Parquet (default), CSV with a header, or the newest version of a snapshot table."""
    if fmt == "snapshot":
        return snapshots.read(spark, root)
    if fmt == "csv":
        return spark.read.schema(S.CLEAN_SCHEMA).option("header", "true").csv(root)
    return spark.read.parquet(root)


def expand_archives(spark: SparkSession, root: str, chunk: int = streams.CHUNK_BYTES) -> DataFrame:
    """CSV members of the zip archives below a folder: ``archive name member part content``.

    Folders inside an archive are dropped; equal names get ``_1``, ``_2``, ... A member is a
    partition of its own and comes in parts of ``chunk`` bytes, in order, read by ranges
    of the archive; neither needs to fit in memory. An archive without CSV fails the job.
    """
    return streams.read_members(spark, root, chunk)


def extract_archives(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Write the CSV members of all archives below ``root`` into ``out``, replacing what is there: ``name length``.

    Each member is one task that copies part by part. Names are unique in an archive; with several archives
    each has a folder of its own, named like it.
    """
    archives = len(streams.files_under(root, (".zip",)))
    streams.clear(out)

    def copy(batches: Iterator) -> Iterator:
        sink, name, size = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                archive, base, content = (batch.column(c)[i].as_py() for c in ("archive", "name", "content"))
                if sink is None:
                    folder = "" if archives == 1 else archive.rsplit("/", 1)[1].rsplit(".", 1)[0] + "/"
                    name = folder + base
                    sink = streams.create_file(f"{out}/{name}")
                sink.write(content)
                size += len(content)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], names=["name", "length"])

    return streams.read_members(spark, root).mapInArrow(copy, "name string, length bigint")


def year_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Years from start to end, both included."""
    for value in (start, end):
        if not isinstance(value, int) or isinstance(value, bool):
            raise ValueError("years must be integers")
    if start > end:
        raise ValueError("the first year must not be after the last")
    return spark.range(start, end + 1).select(F.col("id").cast("int").alias("year"))


def _anchors(html: str) -> list[tuple[str, str]]:
    """Address and text of each anchor with an address, in the order of the page."""
    from html.parser import HTMLParser

    found: list[tuple[str, str]] = []

    class Anchors(HTMLParser):
        href, words = None, []

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.close_anchor()
                self.href, self.words = dict(reversed(attrs)).get("href"), []

        def handle_endtag(self, tag):
            if tag == "a":
                self.close_anchor()

        def handle_data(self, data):
            if self.href and data.strip():
                self.words.append(data.strip())

        def close_anchor(self):
            if self.href:
                found.append((self.href, " ".join(self.words)))
            self.href = None

    parser = Anchors(convert_charrefs=True)
    parser.feed(html)
    parser.close()
    parser.close_anchor()
    return found


def page_links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Anchors of each page: ``page_id, position, href, text``, in page order.

    Pages go through an HTML parser in batches, so quotes, entities and tags
    inside anchors count as a browser reads them. An anchor ends at its end
    tag, at the next anchor or with the page.
    """
    @F.pandas_udf("array<struct<href: string, text: string>>")
    def anchors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"href": h, "text": x} for h, x in _anchors(t or "")])

    found = pages.select(page_id, F.posexplode(anchors(F.col(html))).alias("position", "__a"))
    return found.select(page_id, "position", "__a.href", "__a.text")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", shorter).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(whole, F.when(whole != "/", closed).otherwise(F.lit("")))).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link address found on a page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(path, "[^/]*$", ""), F.lit("")), F.lit("/"))
    target, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(target), rest))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, target)), rest))
    )


def pick_archive_links(
    pages: DataFrame, years: Sequence[int], token: str = ".zip", page_id: str = "page_id",
    url: str = "url", html: str = "html", required: bool = True,
) -> DataFrame:
    """Best archive link per page and year; the first on the page wins ties.

    With ``required`` a page without a link for a year fails the job, else it
    keeps a row without address.
    """
    wanted = F.explode(F.array(*[F.lit(int(y)) for y in years]))
    links = page_links(pages, page_id, html).select("*", wanted.alias("year"))
    links = links.where(F.lower("href").contains(token))
    score = X.link_score(F.col("href"), F.col("text"), F.col("year").cast("string"), token)
    best = (
        links.select(page_id, "year", score.alias("score"), "position", "href")
        .groupBy(page_id, "year")
        .agg(F.max(F.struct("score", (-F.col("position")).alias("p"), "href")).alias("__b"))
    )
    asked = pages.select(page_id, F.col(url).alias("__base"), wanted.alias("year"))
    out = asked.join(best, [page_id, "year"], "left")
    address = resolve_url(F.col("__base"), F.col("__b.href"))
    if required:
        address = F.when(
            F.col("__b").isNull(), F.raise_error(F.concat(F.lit("no archive link for year "), F.col("year").cast("string"))).cast("string")
        ).otherwise(address)
    return out.select(page_id, "year", F.col("__b.score").alias("score"), address.alias("url"))
