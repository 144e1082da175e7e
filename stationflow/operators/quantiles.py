"""Exact quantiles per group without collecting a group.

Values are counted per value range first. Only the ranges that hold a wanted
rank are looked at again, as (value, count) pairs; ranges that still hold many
rows are cut again, each at its own quantiles, until they are small or one value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir
from .joins import spread_join

SEGMENTS = 32
RANGES = 32
# A range with more rows than this is cut again; one task sorts at most about this many (value, count) pairs.
MOST_IN_RANGE = 1_000_000
MOST_ROUNDS = 6
_CUT_AT = [0.0005, *[i / SEGMENTS for i in range(1, SEGMENTS)], 0.9995]


def _range_of(v: Column, cuts: Sequence[float] | None, ranges: int) -> Column:
    """Number of the value range, growing with the value.

    Approximate quantiles cut the values into segments of equal weight, so a
    peak in the data is spread; a segment has ``ranges`` parts of equal width.
    """
    cuts = sorted(set(cuts or []))

    def segment(j: int) -> Column:
        first = F.lit(j * (ranges + 2)).cast("bigint")
        if j in (0, len(cuts)):
            return first
        low, high = cuts[j - 1], cuts[j]
        width = (high - low) / ranges
        if width == 0 or width == float("inf"):
            return first
        return first + F.floor((v - F.lit(low)) / F.lit(width)).cast("bigint")

    def search(low: int, high: int) -> Column:
        if low == high:
            return segment(low)
        mid = (low + high + 1) // 2
        return F.when(v < F.lit(cuts[mid - 1]), search(low, mid - 1)).otherwise(search(mid, high))

    return search(0, len(cuts))


def _ranged(df: DataFrame, by: Sequence[str], cols: Sequence[str], ranges: int) -> DataFrame:
    """Long rows ``by..., __col, __v, __range``.

    One pass over the data finds the cuts of all columns: a few numbers each.
    """
    cuts = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), _CUT_AT).alias(f"__{i}") for i, c in enumerate(cols)]
    ).first()
    parts = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        parts.append(
            df.where(v.isNotNull()).select(
                *by, F.lit(c).alias("__col"), v.alias("__v"), _range_of(v, cuts[i], ranges).alias("__range")
            )
        )
    return reduce(DataFrame.unionAll, parts)


def values_at_ranks(
    df: DataFrame, by: Sequence[str], cols: Sequence[str] | str, ranks: Column, ranges: int = RANGES,
    name: str = "column",
) -> DataFrame:
    """Rows ``by..., column, n, rank, value`` for zero-based ranks.

    ``ranks`` is an array expression over ``n``, the number of values of the
    group. A single column name leaves the ``column`` field out.
    """
    if isinstance(cols, str):
        return values_at_ranks(df, by, [cols], ranks, ranges, "__col").drop("__col")
    tagged = _ranged(df, by, list(cols), ranges).withColumnRenamed("__col", name)
    by = [*by, name]
    counts = tagged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.select(
        *by, "__range",
        (F.sum("__c").over(upto) - F.col("__c")).alias("__before"), "__c",
        F.sum("__c").over(group).alias("n"),
    )
    wanted = spans.select(
        *by, "__range", "__before", "n",
        F.filter(
            F.array_distinct(ranks),
            lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c")),
        ).alias("__ranks"),
    ).where(F.size("__ranks") > 0)
    inside_wanted = tagged.join(wanted.select(*by, "__range", "__before", "n", "__ranks"), [*by, "__range"])
    pairs = (
        _refined(inside_wanted, by)
        .groupBy(*by, "__round", "__range", "__v")
        .agg(
            F.count(F.lit(1)).alias("__c"), F.first("__before").alias("__before"),
            F.first("n").alias("n"), F.first("__ranks").alias("__ranks"),
        )
    )
    inside = (
        Window.partitionBy(*by, "__round", "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = pairs.withColumn("__end", F.col("__before") + F.sum("__c").over(inside))
    hit = F.filter(
        F.col("__ranks"), lambda r: (r >= F.col("__end") - F.col("__c")) & (r < F.col("__end"))
    )
    return placed.select(*by, "n", F.col("__v").alias("value"), F.explode(hit).alias("rank"))


def _refined(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of wanted ranges, those of large ranges cut down to parts that hold a wanted rank.

    Each round writes what is left of the large ranges, so later ones read
    little. A range of one value needs no cut: it is one (value, count) pair.
    """
    place = [*by, "__range"]
    done: list[DataFrame] = []
    for r in range(MOST_ROUNDS):
        sizes = rows.groupBy(*place).agg(
            F.count(F.lit(1)).alias("__size"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
        )
        large = sizes.where((F.col("__size") > MOST_IN_RANGE) & (F.col("__low") < F.col("__high")))
        if large.isEmpty():
            break
        large = large.select(*place)
        done.append(rows.join(large, place, "left_anti"))
        rest = rows.join(large, place)
        cuts = rest.groupBy(*place).agg(F.percentile_approx("__v", _CUT_AT[1:-1], 1000).alias("__cuts"))
        part = F.size(F.filter(F.array_distinct("__cuts"), lambda c: c <= F.col("__v")))
        cut = spread_join(rest, cuts, place, ["__v"]).withColumn("__part", part).drop("__cuts")
        counts = cut.groupBy(*place, "__part").agg(F.count(F.lit(1)).alias("__c"))
        upto = Window.partitionBy(*place).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
        spans = counts.withColumn("__skip", F.sum("__c").over(upto) - F.col("__c"))
        kept = (
            cut.join(spans, [*place, "__part"])
            .withColumn("__before", F.col("__before") + F.col("__skip"))
            .withColumn("__ranks", F.filter("__ranks", lambda x: (x >= F.col("__before")) & (x < F.col("__before") + F.col("__c"))))
            .where(F.size("__ranks") > 0)
            .withColumn("__range", F.col("__range") * (SEGMENTS + 1) + F.col("__part"))
            .select(*rows.columns)
        )
        path = shared_dir(rows.sparkSession, "ranges")
        kept.write.parquet(path)
        rows = rows.sparkSession.read.schema(kept.schema).parquet(path)
    # numbers of parts could meet numbers of ranges that were not cut: the rounds stay apart
    out = rows.withColumn("__round", F.lit(len(done)))
    for i, part in enumerate(done):
        out = out.unionByName(part.withColumn("__round", F.lit(i)))
    return out


def exact_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str] | str, probs: dict[str, float], ranges: int = RANGES
) -> DataFrame:
    """One field per name in ``probs``, linear interpolation between neighbours.

    One row per group for a single column name, per group and ``column`` for a list.
    """
    n = F.col("n")
    keys = [*by] if isinstance(cols, str) else [*by, "column"]

    def position(p: float) -> Column:
        return F.lit(float(p)) * (n - 1)

    ranks = F.array(
        *[f(position(p)).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)]
    )
    found = values_at_ranks(df, by, cols, ranks, ranges)
    merged = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("__at"),
        F.first("n").alias("n"),
    )

    def interpolated(p: float) -> Column:
        pos = position(p)
        low = F.try_element_at("__at", F.floor(pos).cast("bigint"))
        high = F.try_element_at("__at", F.ceil(pos).cast("bigint"))
        return low + (high - low) * (pos - F.floor(pos))

    return merged.select(*keys, *[interpolated(p).alias(name) for name, p in probs.items()])


def approx_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Sketch-based quantiles in one pass."""
    q = df.groupBy(*by).agg(F.percentile_approx(col, list(probs.values()), 10000).alias("__q"))
    return q.select(*by, *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(probs)])


def box_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Count, min, quartiles and max per group."""
    by = list(by)
    ends = df.groupBy(*by).agg(
        F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    quarts = exact_quantiles(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    if not by:  # one row each
        return ends.withColumn("__q", quarts.select(F.struct("*")).scalar()).select("n", "min", "max", "__q.*")
    return ends.join(quarts, by)
