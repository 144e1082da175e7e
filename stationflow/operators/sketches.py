"""Quantile sketches stored per group and merged when new data come."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schema as S

K = 400
RANK_ERROR = 0.02


def quantile_sketches(
    df: DataFrame, cols: Sequence[str] = tuple(S.TARGET_COLUMNS), by: str = S.KEY, t: str = S.TIME, k: int = K
) -> DataFrame:
    """``by month column n sketch``: a sketch of each column's values per station and month.

    A sketch takes a few kilobytes whatever it has seen, and is made in partial aggregates. With ``k`` at 400 a
    rank is off by about 0.7 % of the rows, ``RANK_ERROR`` is never expected to be passed.
    """
    cols = [c for c in cols if c in df.columns]
    rows = df.select(by, F.month(t).alias("month"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = rows.unpivot([by, "month"], cols, "column", "value").where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy(by, "month", "column").agg(
        F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")
    )


def merged(sketches: DataFrame, by: str = S.KEY) -> DataFrame:
    """Sketches of the same group, from stored tables and new data together, as one."""
    return sketches.groupBy(by, "month", "column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, probs: Mapping[str, float], by: str = S.KEY) -> DataFrame:
    """One column for each of ``probs``, estimated from the sketch."""
    return sketches.select(
        by, "month", "column", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(c) for c, p in probs.items()]
    )


def rank_errors(df: DataFrame, estimates: DataFrame, probs: Mapping[str, float], by: str = S.KEY, t: str = S.TIME) -> DataFrame:
    """How far, as a share of the rows, each estimate is from a value of the wanted rank: 0 where it has that rank itself."""
    cols = [r[0] for r in estimates.select("column").distinct().collect()]
    rows = df.select(by, F.month(t).alias("month"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = rows.unpivot([by, "month"], cols, "column", "value").where("value IS NOT NULL AND NOT isnan(value)")
    met = long.join(estimates.drop("n"), [by, "month", "column"])
    counts = met.groupBy(by, "month", "column").agg(
        F.count("value").alias("n"),
        *[F.count_if(F.col("value") < F.col(c)).alias(f"__below_{c}") for c in probs],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"__upto_{c}") for c in probs],
    )
    off = [
        F.greatest(F.col(f"__below_{c}") - p * F.col("n"), p * F.col("n") - F.col(f"__upto_{c}"), F.lit(0.0)) / F.col("n") for c, p in probs.items()
    ]
    return counts.select(by, "month", "column", "n", *[e.alias(c) for e, c in zip(off, probs)])
