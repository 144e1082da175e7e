"""Exploratory aggregates: the tables behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import numbers as N, times as D
from .quantiles import box_stats


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, with table row and column counts."""
    info = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(k).alias("dtype"))
            for i, (n, k) in enumerate(df.dtypes)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows", F.lit(len(df.columns)).alias("num_columns"), F.inline(info)
    )


def feature_summary(before: DataFrame, after: DataFrame, index: str = S.TIME) -> DataFrame:
    """Shape of a feature table against its input. The time column counts as an input column only."""
    names = [c for c in after.columns if c != index]
    if not set(names) - set(before.columns):
        raise ValueError("the second table has no derived columns")
    return after.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows",
        F.lit(len(names)).alias("num_columns"),
        F.lit(len(before.columns)).alias("original_features"),
        F.lit(len(names) - len(before.columns)).alias("new_features"),
        F.lit(",".join(names)).alias("feature_names"),
        F.lit("DatetimeIndex" if index in after.columns else "RangeIndex").alias("index_type"),
    )


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "column") -> DataFrame:
    """Long form of some columns."""
    return df.unpivot(list(ids), list(cols), name, "value")


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing values per column, most first, complete columns left out."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    rows = counts.unpivot("__n", list(df.columns), "column", "nulls").where(F.col("nulls") > 0)
    return rows.select(
        "column", "nulls", (F.col("nulls") / F.col("__n") * 100).alias("percent")
    ).orderBy(F.desc("nulls"), "column")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of 64-bit columns, over rows where both are present."""
    cols = list(cols or [n for n, kind in df.dtypes if kind in ("double", "bigint")])
    aggs, cells = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
            y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
            value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            name = f"{a}|{b}"
            aggs.append(value.alias(name))
            for left, right in {(a, b), (b, a)}:
                cells.append(
                    F.struct(
                        F.lit(left).alias("col_a"), F.lit(right).alias("col_b"),
                        F.col(f"`{name}`").alias("corr"),
                    )
                )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def distribution(df: DataFrame, col: str, n_bins: int = 20) -> DataFrame:
    """Histogram with equal bins between min and max; the last bin is closed."""
    ends = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("e")).scalar()
    lo, hi, v = ends["lo"], ends["hi"], F.col(col)
    width = (hi - lo) / n_bins
    pos = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(v - lo, width)), F.lit(n_bins - 1))
    )
    return (
        df.where(v.isNotNull())
        .groupBy(pos.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_calendar(df: DataFrame, t: str = S.TIME) -> DataFrame:
    """Adds year, month, month name, day of year, hour and date."""
    if t not in df.columns:
        raise ValueError(f"column {t} is required")
    return df.withColumns(D.calendar_parts(t))


def distribution_by_year(df: DataFrame, col: str, t: str = S.TIME) -> DataFrame:
    return box_stats(df.select(F.year(t).alias("ano"), col), ["ano"], col)


def hourly_distribution_by_year(df: DataFrame, col: str, t: str = S.TIME) -> DataFrame:
    parts = df.select(F.year(t).alias("ano"), F.hour(t).alias("hora"), col)
    return box_stats(parts, ["ano", "hora"], col)


def _by_parts(df: DataFrame, parts: dict[str, Column], col: str, agg) -> DataFrame:
    return df.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(agg(col).alias(col))


def monthly_by_year(df: DataFrame, col: str, agg: str = "mean", t: str = S.TIME) -> DataFrame:
    parts = {"ano": F.year(t), "mes": F.month(t)}
    return _by_parts(df, parts, col, N.aggregation(agg))


def rain_by_year(df: DataFrame, col: str = "precipitacao_total_mm", t: str = S.TIME) -> DataFrame | None:
    if col not in df.columns:
        return None
    return _by_parts(df, {"ano": F.year(t)}, col, N.zero_sum)


def hourly_profile_by_year(df: DataFrame, col: str, agg: str = "mean", t: str = S.TIME) -> DataFrame:
    parts = {"ano": F.year(t), "hora": F.hour(t)}
    out = _by_parts(df, parts, col, N.aggregation(agg, strict=False))
    return out.withColumn("ano", F.col("ano").cast("string"))


def daily_by_year(df: DataFrame, col: str, agg: str = "mean", t: str = S.TIME) -> DataFrame:
    parts = {"ano": F.year(t), "dia_do_ano": F.dayofyear(t)}
    out = _by_parts(df, parts, col, N.aggregation(agg, strict=False))
    return out.withColumn("ano", F.col("ano").cast("string"))


def hour_month_cells(df: DataFrame, col: str, agg: str = "mean", t: str = S.TIME) -> DataFrame:
    parts = {"ano": F.year(t), "mes": F.month(t), "hora": F.hour(t)}
    return _by_parts(df, parts, col, N.aggregation(agg, strict=False))


def densify(
    cells: DataFrame, by: str, row: str, rows: Sequence[int], column: str, columns: Sequence[int],
    value: str, prefix: str = "h",
) -> DataFrame:
    """Full grid per group: one line per row value, one field per column value, gaps null.

    The grid has a fixed size, so each group becomes one array of its cells.
    """
    grid = cells.groupBy(by).pivot(row, list(rows)).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(column), F.col(value))))
    )
    lines = F.array(*[F.struct(F.lit(r).alias(row), F.col(f"`{r}`").alias("__m")) for r in rows])
    return grid.select(by, F.inline(lines)).select(
        by, row, *[F.try_element_at("__m", F.lit(c)).alias(f"{prefix}{c:02d}") for c in columns]
    )


def hour_month_heatmap(df: DataFrame, col: str, agg: str = "mean", t: str = S.TIME) -> DataFrame:
    """12 x 24 grid per year with the smallest and largest cell of all years."""
    cells = hour_month_cells(df, col, agg, t)
    grid = densify(cells, "ano", "mes", range(1, 13), "hora", range(24), col)
    ends = cells.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("e")).scalar()
    return grid.select("*", ends["lo"].alias("z_min"), ends["hi"].alias("z_max"))


def left_fill(keys: DataFrame, values: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Every key with its values, 0 where there are none."""
    return keys.join(values, on, "left").fillna(0, subset=list(cols))


def extreme_days(df: DataFrame, limit: float, kind: str = "max", t: str = S.TIME) -> DataFrame:
    """Days per year at or beyond a limit; years without such days show 0."""
    daily = df.groupBy(F.year(t).alias("ano"), F.to_date(t).alias("dia")).agg(
        F.max("temp_max_c").alias("hi"), F.min("temp_min_c").alias("lo")
    )
    hit = F.col("hi") >= limit if kind == "max" else F.col("lo") <= limit
    return daily.groupBy("ano").agg(F.count_if(hit).alias("qtd_dias"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def series_projection(df: DataFrame, cols: Sequence[str], t: str = S.TIME) -> DataFrame:
    """Time and the named columns, in time order."""
    return df.select(t, *cols).orderBy(t, *cols)


def series_extent(df: DataFrame, by: str = S.KEY, t: str = S.TIME) -> DataFrame:
    return df.groupBy(by).agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("row_count")
    )


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, population deviation and lower-rank p95 of the text length."""
    from .quantiles import values_at_ranks

    sized = df.select(F.length(F.coalesce(F.col(col), F.lit(""))).alias("__len"))
    base = sized.agg(
        F.count(F.lit(1)).alias("n"), F.avg("__len").alias("mean"), F.stddev_pop("__len").alias("stdev")
    )
    rank = F.array(F.floor(F.lit(0.95) * (F.col("n") - 1)).cast("bigint"))
    p95 = values_at_ranks(sized, [], "__len", rank).agg(F.max("value").cast("bigint")).scalar()
    return base.withColumn("p95", p95)


def score_rollup(df: DataFrame) -> DataFrame:
    """Mean of every floating column and the number of rows."""
    cols = [n for n, kind in df.dtypes if kind in ("double", "float")]
    means = df.agg(F.count(F.lit(1)).alias("n_examples"), *[F.avg(c).alias(c) for c in cols])
    return means.unpivot("n_examples", cols, "metric", "score")


def ingest_summary(files: DataFrame) -> DataFrame:
    """Years and CSV files; a year without files is an error.

    ``files`` has ``year`` and ``csv_count``.
    """
    bad = F.count_if(F.col("csv_count") <= 0)
    return files.agg(
        F.count(F.lit(1)).alias("years"), F.sum("csv_count").alias("csv_files"), bad.alias("__bad")
    ).select(
        F.when(F.col("__bad") > 0, F.raise_error(F.lit("years without extracted files")).cast("bigint"))
        .otherwise(F.col("years")).alias("years"),
        "csv_files",
    )


def station_summary(rows: DataFrame, file_col: str, by: str = S.KEY) -> DataFrame:
    """Files and rows per station. Files are made distinct before they are counted."""
    per_file = rows.groupBy(by, file_col).agg(F.count(F.lit(1)).alias("__n"))
    return per_file.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("__n").alias("rows")
    )
