"""Least squares from sums: Gram matrices per station and day, added, taken away, and solved.

A matrix is the upper triangle of the sums of products of (1, features..., target). Products are
rounded to 10 decimals and added as decimals, so sums are exact in any order and
a window is the difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from .series import running

PRODUCT = "decimal(28,10)"
DAY_BLOCK = 256


def entries(features: int) -> list[tuple[int, int]]:
    """Positions of the upper triangle; the intercept is first, the target last."""
    return list(combinations_with_replacement(range(features + 2), 2))


def names(features: int) -> list[str]:
    return [f"g{i}_{j}" for i, j in entries(features)]


def gram_sums(pairs: DataFrame, by: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Sums of products per group, in one aggregation; rows with a null in them are left out.

    Sums of parts of the data add up to those of all (``merged``).
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)]]
    return pairs.dropna(subset=[*features, target]).groupBy(*by).agg(
        *[F.sum((columns[i] * columns[j]).cast(PRODUCT)).alias(n) for n, (i, j) in zip(names(len(features)), entries(len(features)))]
    )


def merged(sums: DataFrame, by: Sequence[str], features: int) -> DataFrame:
    """Sums of sums."""
    return sums.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names(features)])


def rolling(sums: DataFrame, days: int, features: int, by: str = S.KEY, day: str = "day") -> DataFrame:
    """For each station and day that has sums: those of the ``days`` days that end with it.

    Running sums are carried from block to block of days; the sum that ends before the window is taken away.
    """
    got = names(features)
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    own = sums.select(by, number.alias("__d"), F.lit(0).alias("__kind"), F.col(day).alias("__of"), *got)
    before = sums.select(by, (number - days).alias("__d"), F.lit(1).alias("__kind"), F.col(day).alias("__of"))
    total = running(
        own.unionByName(before, allowMissingColumns=True), [by], ["__d", "__kind"], F.floor(F.col("__d") / F.lit(DAY_BLOCK)),
        {f"__{n}": ("sum", F.col(n)) for n in got},
    )
    upto = lambda n, kind: F.max(F.when(F.col("__kind") == kind, F.col(f"__{n}")))  # noqa: E731  one row of each kind
    return total.groupBy(by, F.col("__of").alias(day)).agg(
        *[(upto(n, 0) - F.coalesce(upto(n, 1), F.lit(0))).cast("decimal(38,10)").alias(n) for n in got]
    )


def matrix(row: Sequence[float], features: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    out = np.zeros((features + 2, features + 2))
    for (i, j), v in zip(entries(features), row):
        out[i, j] = out[j, i] = float(v)
    return out


def solved(sums: DataFrame, features: int, penalties: Sequence[float] = (0.0,)) -> DataFrame:
    """Rows of sums with ``penalty`` and ``weights`` (intercept first), one row for each penalty.

    The slopes are penalised, the intercept is not. Features that depend on each other get the shortest solution.
    """
    got = names(features)
    grid = sums.withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties])))
    schema = grid.selectExpr("*", "array(0D) weights").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights = []
            for *row, penalty in pdf[[*got, "penalty"]].itertuples(index=False):
                g = matrix(row, features)
                n = max(g[0, 0], 1.0)
                mean = g[0, 1:-1] / n
                centred = g[1:-1, 1:-1] - n * np.outer(mean, mean) + penalty * np.eye(features)
                slopes = np.linalg.lstsq(centred, g[1:-1, -1] - mean * g[0, -1], rcond=None)[0]
                weights.append([g[0, -1] / n - float(mean @ slopes), *slopes.tolist()])
            yield pdf.assign(weights=weights)

    return grid.mapInPandas(run, schema)


def squared_error(features: int, weights: str = "weights", prefix: str = "") -> Column:
    """Mean squared error of ``weights`` on the rows behind a matrix (columns ``prefix`` + name), from its sums alone."""
    # (y - w x)^2 is a square form of the vector (w, -1)
    w = [F.get(F.col(weights), F.lit(i)) for i in range(features + 1)] + [F.lit(-1.0)]
    total = sum(
        (w[i] * w[j] * F.col(f"{prefix}{n}").cast("double") * (1 if i == j else 2) for n, (i, j) in zip(names(features), entries(features))),
        F.lit(0.0),
    )
    return F.greatest(total, F.lit(0.0)) / F.col(f"{prefix}g0_0").cast("double")
