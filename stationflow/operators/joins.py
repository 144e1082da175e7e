"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

COPIES = 32


def spread_join(
    rows: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner",
    copies: int = COPIES,
) -> DataFrame:
    """Join many rows with one row per key.

    The rows of a key are spread over ``copies`` sub-keys by a hash of the
    ``spread`` columns, and ``small`` is repeated once per sub-key. Spark still
    broadcasts ``small`` when its measured size allows; if it cannot, no task
    receives more than a share of a large key.
    """
    on = list(on)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(copies)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")
