"""Standard scaling with statistics of the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from .joins import spread_join


def fit_scaler(train: DataFrame, features: Sequence[str], by: str = S.KEY) -> DataFrame:
    """One row per station: mean and population deviation of each feature; 0 deviation becomes 1."""
    def deviation(c: str) -> Column:
        std = F.stddev_pop(c)
        return F.when(std == 0, F.lit(1.0)).otherwise(std)

    return train.groupBy(by).agg(
        *[x for c in features for x in (F.avg(c).alias(f"{c}__mean"), deviation(c).alias(f"{c}__std"))]
    )


def _others(df: DataFrame, by: str) -> list[str]:
    return [n for n, kind in df.dtypes if n != by and not kind.startswith(("map", "array", "struct"))]


def apply_scaler(df: DataFrame, stats: DataFrame, features: Sequence[str], by: str = S.KEY) -> DataFrame:
    """(x - mean) / deviation with the statistics of the training rows."""
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in features}
    return spread_join(df, stats, [by], _others(df, by)).select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])


def inverse_scaler(
    df: DataFrame, stats: DataFrame, targets: dict[str, str], by: str = S.KEY
) -> DataFrame:
    """Back to original units. ``targets`` maps a column to the feature it was scaled as."""
    real = {c: F.col(c) * F.col(f"{f}__std") + F.col(f"{f}__mean") for c, f in targets.items()}
    return spread_join(df, stats, [by], _others(df, by)).select(*[real[c].alias(c) if c in real else c for c in df.columns])


def group_normalizer(
    df: DataFrame, target: str, transform: str = "softplus", by: str = S.KEY, eps: float = 1e-8
) -> DataFrame:
    """Target normalised per station after an invertible transform.

    ``softplus`` maps values to the scale on which softplus gives them back.
    """
    v = F.col(target).cast("double")
    # log(exp(v) - 1) equals v for large values and would overflow there
    inverse_softplus = F.when(v > 20, v).otherwise(F.log(F.greatest(F.expm1(F.least(v, F.lit(20.0))), F.lit(eps))))
    value = {"softplus": inverse_softplus, "none": v, "log": F.log(v + eps)}[transform]
    rows = df.withColumn("__v", value)
    stats = rows.groupBy(by).agg(F.avg("__v").alias("center"), (F.stddev_samp("__v") + eps).alias("scale"))
    return spread_join(rows, stats, [by], _others(df, by)).select(
        *df.columns, ((F.col("__v") - F.col("center")) / F.col("scale")).alias(f"{target}_norm"),
        "center", "scale",
    )
