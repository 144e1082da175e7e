"""Climate profiles and the texts made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import numbers as N, text as X
from .quantiles import approx_quantiles, exact_quantiles


def monthly_profiles(
    df: DataFrame, cols: Sequence[str] = tuple(S.TARGET_COLUMNS), by: str = S.KEY, t: str = S.TIME,
    digits: int | None = 2,
) -> DataFrame:
    """mean, std, min, max per station, calendar month and column, over all years."""
    cols = [c for c in cols if c in df.columns]
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(by, F.month(t).alias("month")).agg(
        *[F.struct(*[f(c).cast("double").alias(n) for n, f in stats.items()]).alias(c) for c in cols]
    )
    long = wide.select(
        by, "month",
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])),
    )
    rounded = [
        (N.round_even(F.col("s")[n], digits) if digits is not None else F.col("s")[n]).alias(n)
        for n in stats
    ]
    return long.select(by, "month", "column", *rounded)


def seasonal_extremes(
    df: DataFrame, cols: Sequence[str] = tuple(S.TARGET_COLUMNS), by: str = S.KEY, t: str = S.TIME,
    approx: bool = False, digits: int | None = 2,
) -> DataFrame:
    """p5 and p95 per station, month and column; exact unless ``approx``."""
    cols = [c for c in cols if c in df.columns]
    probs = {"p5": 0.05, "p95": 0.95}
    rows = df.select(by, F.month(t).alias("month"), *[F.col(c).cast("double").alias(c) for c in cols])
    if approx:
        long = rows.unpivot([by, "month"], cols, "column", "value")
        out = approx_quantiles(long, [by, "month", "column"], "value", probs)
    else:
        out = exact_quantiles(rows, [by, "month"], cols, probs)
    p = [(N.round_even(c, digits) if digits is not None else F.col(c)).alias(c) for c in ("p5", "p95")]
    return out.select(by, "month", "column", *p)


def snapshot_metadata(
    df: DataFrame, now: Column, cols: Sequence[str] = tuple(S.TARGET_COLUMNS), by: str = S.KEY,
    t: str = S.TIME, files: DataFrame | None = None,
) -> DataFrame:
    """Station, time range, rows, profile columns; with ``files`` also their path and hash."""
    present = [c for c in cols if c in df.columns]
    meta = df.groupBy(by).agg(
        F.min(t).alias("date_start"), F.max(t).alias("date_end"), F.count(F.lit(1)).alias("row_count")
    ).select(
        "*", F.lit(",".join(present)).alias("profile_columns"), now.alias("snapshot_at")
    )
    return meta if files is None else meta.join(files, by, "left")


def annual_summary(profiles: DataFrame, meta: DataFrame, by: str = S.KEY, col: str = "temp_ar_c") -> DataFrame:
    """Hottest and coldest month, the earliest on ties, with range and rows."""
    temps = profiles.where((F.col("column") == col) & F.col("mean").isNotNull())
    ends = temps.groupBy(by).agg(
        F.max(F.struct(F.col("mean"), (-F.col("month")).alias("m"))).alias("hot"),
        F.min(F.struct(F.col("mean"), F.col("month").alias("m"))).alias("cold"),
    )
    return ends.join(meta.select(by, "date_start", "date_end", "row_count"), by, "left").select(
        by,
        (-F.col("hot.m")).alias("hottest_month"), F.col("hot.mean").alias("hottest_mean"),
        F.col("cold.m").alias("coldest_month"), F.col("cold.mean").alias("coldest_mean"),
        "date_start", "date_end", "row_count",
    )


def _number(col: Column) -> Column:
    """Two decimals without trailing zeros, at least one digit after the point."""
    return F.regexp_replace(N.fixed_text(col, 2), r"(\.\d)0$", "$1")


def _or_unknown(col: Column) -> Column:
    return F.coalesce(_number(col), F.lit("?"))


def monthly_chunks(profiles: DataFrame, extremes: DataFrame, by: str = S.KEY) -> DataFrame:
    """One text per station and month. Columns without a profile are skipped."""
    keys = [by, "month", "column"]
    rows = profiles.join(extremes, keys, "left")
    stats = F.struct("mean", "std", "min", "max", "p5", "p95")
    wide = rows.groupBy(by, "month").pivot("column", S.TARGET_COLUMNS).agg(F.first(stats))

    def piece(col: str, *parts: str | Column) -> Column:
        present = F.col(col).isNotNull() & F.col(col)["mean"].isNotNull()
        return F.when(present, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    def num(col: str, stat: str) -> Column:
        return _number(F.col(col)[stat])

    t, u, p, r = S.TARGET_COLUMNS
    name = X.month_label("month")
    # The wording below is a fixed value.
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Em "), name, F.lit(" em "), F.col(by), F.lit(":")),
        piece(
            t, "Temperatura média de ", num(t, "mean"), "°C (mín: ", num(t, "min"), "°C, máx: ",
            num(t, "max"), "°C, desvio: ", F.coalesce(num(t, "std"), F.lit("nan")),
            "°C). Percentil 5%: ", _or_unknown(F.col(t)["p5"]), "°C, percentil 95%: ",
            _or_unknown(F.col(t)["p95"]), "°C.",
        ),
        piece(
            u, "Umidade relativa média de ", num(u, "mean"), "% (mín: ", num(u, "min"), "%, máx: ",
            num(u, "max"), "%).",
        ),
        piece(p, "Pressão atmosférica média de ", num(p, "mean"), " mb."),
        piece(r, "Precipitação: média de ", num(r, "mean"), " mm, máximo de ", num(r, "max"), " mm."),
    )
    return wide.select(by, F.col("month").alias("mes"), name.alias("mes_nome"), text.alias("text"))


def annual_chunk(profiles: DataFrame, meta: DataFrame, by: str = S.KEY) -> DataFrame:
    """One text per station about the year; month number 0."""
    s = annual_summary(profiles, meta, by)

    def month(col: str) -> Column:
        return F.coalesce(F.date_format(col, "yyyy-MM"), F.lit("?"))

    # The wording below is a fixed value.
    text = F.concat(
        F.lit("Resumo climático anual de "), F.col(by), F.lit(": mês mais quente é "),
        X.month_label("hottest_month"), F.lit(" (média "), _number(F.col("hottest_mean")),
        F.lit("°C), mês mais frio é "), X.month_label("coldest_month"), F.lit(" (média "),
        _number(F.col("coldest_mean")), F.lit("°C). Histórico de "), month("date_start"),
        F.lit(" a "), month("date_end"), F.lit(", total de "),
        F.format_number(F.coalesce(F.col("row_count"), F.lit(0)), 0),
        F.lit(" observações horárias."),
    )
    return s.select(by, F.lit(0).alias("mes"), F.lit(S.ANNUAL_NAME).alias("mes_nome"), text.alias("text"))


def replace_docs(existing: DataFrame, new: DataFrame, by: str = S.KEY) -> DataFrame:
    """All documents of the stations in ``new`` are replaced, the others stay."""
    keys = new.select(by).distinct()
    return existing.join(keys, by, "left_anti").unionByName(new, allowMissingColumns=True)


def build_docs(
    profiles: DataFrame, extremes: DataFrame, meta: DataFrame, existing: DataFrame | None = None,
    by: str = S.KEY,
) -> DataFrame:
    """Monthly and annual texts with their metadata and a stable id."""
    docs = monthly_chunks(profiles, extremes, by).unionByName(annual_chunk(profiles, meta, by))
    docs = docs.select(F.concat_ws("_", by, "mes").alias("doc_id"), by, "mes", "mes_nome", "text")
    return docs if existing is None else replace_docs(existing, docs, by)
