"""Typing, naming and choosing raw columns and stations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import numbers as N, text as X, times as D


def combine_date_hour(df: DataFrame, date: str = S.RAW_DATE, hour: str = S.RAW_HOUR,
                      out: str = "DATA_HORA") -> DataFrame:
    """Raw date and hour become one timestamp column."""
    stamp = D.combine_date_hour(F.col(f"`{date}`"), F.col(f"`{hour}`"))
    return df.withColumn(out, stamp).drop(date, hour)


def parse_decimals(df: DataFrame, cols: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """Text columns become numbers; what is not a number becomes null."""
    chosen = {n for n, kind in df.dtypes if kind == "string"} if cols is None else set(cols)
    return df.select(
        *[N.parse_decimal(F.col(f"`{c}`"), sep).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns]
    )


def rename_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by map; other columns keep their name, unknown names are ignored."""
    mapping = S.RENAME_MAP if mapping is None else mapping
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def clean(df: DataFrame, keep: Sequence[str] = (S.KEY,), mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Raw station rows to the clean table: time, numbers, names."""
    texts = [c for c in df.columns if c not in (*keep, S.RAW_DATE, S.RAW_HOUR)]
    return rename_columns(parse_decimals(combine_date_hour(df), texts), mapping)


def station_slug(slug: Column | str, overrides: Mapping[str, str] | None) -> Column:
    """Slug after overrides; several slugs may map to one."""
    return X.label_lookup(slug, dict(overrides)) if overrides else X.as_col(slug)


def filter_stations(
    df: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
    by: str = S.KEY,
) -> DataFrame:
    """Overrides first, then include (empty means all), then exclude."""
    out = df.withColumn(by, station_slug(by, overrides))
    if include:
        out = out.where(F.col(by).isin(*include))
    if exclude:
        out = out.where(~F.col(by).isin(*exclude))
    return out


def match_terms(files: DataFrame, terms: Sequence[str], name: str = "name", path: str = "path") -> DataFrame:
    """Rows ``term, path``: files whose name contains the term, any case.

    The terms are a short parameter list, so each file is tested once against
    all of them. A term without a file keeps one row with a null path.
    """
    terms = list(dict.fromkeys(terms))
    lowered = F.lower(F.col(name))
    hits = F.array_compact(
        F.array(*[F.when(lowered.contains(x.lower()), F.lit(x)) for x in terms])
    ) if terms else F.array().cast("array<string>")
    found = files.select(F.explode(hits).alias("term"), F.col(path).alias("path"))
    if not terms:
        return found
    wanted = files.sparkSession.createDataFrame([(x,) for x in terms], "term string")
    return wanted.join(found, "term", "left")


def match_terms_count(files: DataFrame, terms: Sequence[str], name: str = "name") -> DataFrame:
    """Number of files per term, 0 included."""
    return match_terms(files, terms, name, name).groupBy("term").agg(F.count("path").alias("n_files"))


def resolve_time_column(df: DataFrame) -> str:
    """Time column: a time type first, then a known name, then the first text column all of whose values are readable."""
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            return name
    for name in S.TIME_CANDIDATES:
        if name in df.columns:
            return name
    texts = [n for n, kind in df.dtypes if kind in ("string", "date")]
    if texts:
        probe = df.select(*texts).agg(
            *[
                (F.count_if(F.col(c).cast("string").isNotNull() & F.try_to_timestamp(F.col(c).cast("string")).isNull()) == 0).alias(c)
                for c in texts
            ]
        ).first()
        for name in texts:
            if probe[name]:
                return name
    raise ValueError(f"no time column among {df.columns}")
