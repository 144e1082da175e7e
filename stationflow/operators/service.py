"""Service metrics: counters, histograms, rates, repeated requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..session import shared_dir


def metric_counters(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def metric_gauges(events: DataFrame, labels: Sequence[str], ts: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Last value per label; ties in time go to the larger tie column."""
    last = F.max(F.struct(ts, *tie, value))
    return events.groupBy(*labels).agg(last.alias("__l")).select(
        *labels, F.col("__l")[value].alias("value"), F.col("__l")[ts].alias("at")
    )


def metric_histogram(
    events: DataFrame, value: str, edges: Sequence[float] = tuple(S.INFERENCE_EDGES), by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative counts per upper edge, the open edge last, with sum and count."""
    names = [f"__le_{i}" for i in range(len(edges))]
    counts = [F.count_if(F.col(value) <= F.lit(float(e))).alias(n) for n, e in zip(names, edges)]
    wide = events.groupBy(*by).agg(
        *counts, F.count(value).alias("count"), F.sum(value).alias("sum")
    )
    buckets = F.array(
        *[F.struct(F.lit(float(e)).alias("le"), F.col(n).alias("cumulative")) for n, e in zip(names, edges)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative")),
    )
    return wide.select(*by, "count", "sum", buckets.alias("buckets"))


def bucket_rows(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per edge."""
    return hist.select(*by, "count", "sum", F.inline("buckets"))


def histogram_quantile(buckets: Column | str, q: float) -> Column:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    In the open bucket it is the largest finite edge; without values, null.
    """
    arr = F.col(buckets) if isinstance(buckets, str) else buckets
    total = F.element_at(arr, -1)["cumulative"]
    rank = F.lit(float(q)) * total
    pos = F.array_position(F.transform(arr, lambda b: b["cumulative"] >= rank), F.lit(True))
    here, prev = F.get(arr, (pos - 1).cast("int")), F.get(arr, (pos - 2).cast("int"))
    low = F.coalesce(prev["le"], F.lit(0.0))
    below = F.coalesce(prev["cumulative"], F.lit(0))
    share = F.try_divide(rank - below, here["cumulative"] - below)
    inside = low + (here["le"] - low) * share
    last_edge = F.element_at(arr, -2)["le"]
    first_negative = prev.isNull() & (here["le"] <= 0)
    return (
        F.when(total == 0, F.lit(None).cast("double"))
        .when(pos == F.size(arr), last_edge)
        .when(first_negative, here["le"])
        .otherwise(inside)
    )


def quantile_columns(hist: DataFrame, by: Sequence[str] = (), q: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    return hist.select(
        *by, "count", *[histogram_quantile("buckets", x).alias(f"p{int(round(x * 100))}") for x in q]
    )


def metric_rates(
    events: DataFrame, ts: str, label: str, minutes: int = 5, slide: int = 1
) -> DataFrame:
    """Events per second in sliding windows.

    Counted per slide first: a window only adds up the few slide counts it covers.
    """
    step, span = slide * 60, minutes * 60
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(step)) * step
    small = events.groupBy(label, bucket.cast("bigint").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(minutes // slide - 1)), lambda i: F.col("__b") - i * step)
    return (
        small.select(label, "__n", F.explode(starts).alias("__s"))
        .groupBy(label, "__s")
        .agg(F.sum("__n").alias("n"))
        .select(
            label, F.timestamp_seconds("__s").alias("window_start"),
            "n", (F.col("n") / F.lit(float(span))).alias("per_second"),
        )
    )


def latency_quantiles(
    events: DataFrame, ts: str, value: str, edges: Sequence[float] = tuple(S.INFERENCE_EDGES),
    minutes: int = 5, q: Sequence[float] = (0.5, 0.95, 0.99),
) -> DataFrame:
    """Bucket quantiles per time window."""
    step = minutes * 60
    start = F.timestamp_seconds(
        (F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(step)) * step).cast("bigint")
    )
    hist = metric_histogram(events.withColumn("window_start", start), value, edges, ["window_start"])
    return quantile_columns(hist, ["window_start"], q)


def ttl_dedupe(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    row_id: str,
    ttl: int = S.CACHE_TTL_SECONDS,
    spans: int = 64,
) -> DataFrame:
    """Adds ``is_hit`` and ``anchor``, the time of the result a request reuses.

    A result lives ``ttl`` seconds from the request that made it; hits do not
    extend it. Each distinct instant points to the first one of its key after
    its expiry (``_successors``). The results made are what the first instant of
    a key leads to: pointers are joined with themselves, so that they span
    1, 2, 4, ... steps, and followed from the longest to the shortest. Every step
    is a join by key and instant; no list or task holds a whole key. Results
    lie more than a lifetime apart, so a row finds its own among two, by the
    lifetime it falls into. ``spans`` has no effect and is kept for callers.
    """
    key, ttl_us = list(key), ttl * 1_000_000
    rows = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    times = _staged(rows.groupBy(*key, "__us").agg(F.min(row_id).alias("__first")), "instants")
    levels, level = [], _staged(_successors(times.select(*key, "__us"), key, ttl_us), "steps")
    while not level.isEmpty():
        levels.append(level)
        onward = level.select(*key, F.col("__us").alias("__to"), F.col("__to").alias("__next"))
        level = _staged(level.join(onward, [*key, "__to"]).select(*key, "__us", F.col("__next").alias("__to")), "steps")
    made = times.groupBy(*key).agg(F.min("__us").alias("__us"))
    for level in reversed(levels):
        made = _staged(made, "results")
        made = made.unionByName(made.join(level, [*key, "__us"]).select(*key, F.col("__to").alias("__us")))
    cell = F.floor(F.col("__us") / F.lit(ttl_us)).cast("bigint")
    lives = (
        made.join(times, [*key, "__us"])
        .select(*key, "__us", "__first", F.posexplode(F.array(cell, cell + 1)).alias("__later", "__cell"))
        .groupBy(*key, "__cell").agg(
            F.max(F.when(F.col("__later") == 0, F.col("__us"))).alias("__own"),
            F.max(F.when(F.col("__later") == 0, F.col("__first"))).alias("__first"),
            F.max(F.when(F.col("__later") == 1, F.col("__us"))).alias("__before"),
        )
    )
    anchor = F.when(F.col("__own") <= F.col("__us"), F.col("__own")).otherwise(F.col("__before"))
    is_hit = ~((F.col("__own") == F.col("__us")) & (F.col(row_id) == F.col("__first")))
    return rows.withColumn("__cell", cell).join(_staged(lives, "lives"), [*key, "__cell"]).select(
        *df.columns, F.coalesce(is_hit, F.lit(True)).alias("is_hit"), F.timestamp_micros(anchor).alias("anchor")
    )


def _successors(times: DataFrame, key: Sequence[str], ttl_us: int) -> DataFrame:
    """``__to``: the first instant of the key more than ``ttl_us`` after ``__us``; instants without one are left out.

    Instants and expiries are sorted together into ranges of equal size, which
    cut a busy key as well. Each looks ahead in its range, the last ones of a
    range to the first instants of the ranges that follow.
    """
    both = times.select(*key, F.col("__us").alias("__v"), F.lit(0).alias("__kind")).unionByName(
        times.select(*key, (F.col("__us") + ttl_us).alias("__v"), F.lit(1).alias("__kind"))
    )
    cut = _staged(both.repartitionByRange(*key, "__v", "__kind").withColumn("__range", F.spark_partition_id()), "ranges")
    instant = F.when(F.col("__kind") == 0, F.col("__v"))
    ahead = Window.partitionBy("__range", *key).orderBy(F.desc("__v"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.groupBy(*key, "__range").agg(F.min(instant).alias("__least")).select(
        *key, "__range", F.min("__least").over(after).alias("__after")
    )
    return (
        cut.withColumn("__in", F.min(instant).over(ahead)).where("__kind = 1").join(edges, [*key, "__range"])
        .select(*key, (F.col("__v") - ttl_us).alias("__us"), F.coalesce("__in", "__after").alias("__to"))
        .where("__to IS NOT NULL")
    )


def _staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write rows to the shared folder and read them back, so that later steps do not repeat the work."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cache_counts(deduped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return deduped.groupBy(*by).agg(
        F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses")
    )
