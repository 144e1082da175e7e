"""Sliding samples, look-ups before an instant, and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..session import shared_dir
from .joins import spread_join
from .series import BLOCK_ROWS, running, time_chunk


def make_windows(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    length: int,
    horizon: int,
    stride: int = 1,
    by: str = S.KEY,
    split: str = "split",
    idx: str = "split_idx",
) -> DataFrame:
    """One row per sample: ``x`` holds ``length`` feature rows, ``y`` the next ``horizon`` target rows.

    Samples stay inside their split. Rows are grouped in blocks of positions;
    a block also receives the first rows of the next one, so no task sees more
    than a block and its overlap.
    """
    span = length + horizon
    block_rows = max(BLOCK_ROWS, span)
    home = F.floor(F.col(idx) / F.lit(block_rows)).cast("bigint")
    into_previous = (F.col(idx) % block_rows < span - 1) & (home > 0)
    copies = F.when(into_previous, F.array(home, home - 1)).otherwise(F.array(home))
    rows = df.select(
        by, split, idx,
        F.array(*[F.col(c).cast("float") for c in features]).alias("__f"),
        F.array(*[F.col(c).cast("float") for c in targets]).alias("__t"),
        home.alias("__home"),
        F.explode(copies).alias("__block"),
    )
    w = Window.partitionBy(by, split, "__block").orderBy(idx)
    out = rows.select(
        by, split, F.col(idx).alias("start_idx"), "__home", "__block",
        F.collect_list("__f").over(w.rowsBetween(0, length - 1)).alias("x"),
        F.collect_list("__t").over(w.rowsBetween(length, span - 1)).alias("y"),
    )
    keep = (
        (F.col("__home") == F.col("__block"))
        & (F.size("x") == length)
        & (F.size("y") == horizon)
        & (F.col("start_idx") % stride == 0)
    )
    return out.where(keep).select(by, split, "start_idx", "x", "y")


def window_index(
    df: DataFrame, length: int, horizon: int, by: str = S.KEY, split: str = "split",
    idx: str = "split_idx",
) -> DataFrame:
    """Start positions only, for training jobs that read the rows themselves."""
    return _starts(df, length + horizon, by, split, idx).select(by, split, "start_idx")


def _starts(df: DataFrame, span: int, by: str, split: str, idx: str) -> DataFrame:
    """Rows that have ``span`` rows of their split from themselves on; ``__n`` is the split's size."""
    ends = df.groupBy(by, split).agg((F.max(idx) + 1).alias("__n"))
    rows = df.select(by, split, F.col(idx).alias("start_idx"))
    return spread_join(rows, ends, [by, split], ["start_idx"]).where(
        F.col("start_idx") + span <= F.col("__n")
    )


def encoder_windows(
    df: DataFrame,
    length: int,
    horizon: int,
    model_type: str = "tft",
    target: str = "temp_ar_c",
    features: Sequence[str] = tuple(S.FEATURE_COLUMNS),
    by: str = S.KEY,
    split: str = "split",
    idx: str = "split_idx",
) -> DataFrame:
    """Encoder/decoder positions: variable encoder length, fixed prediction length.

    A sample starts at every position. Its encoder takes ``length`` rows, or
    what is left near the end of the split, but not less than the shortest
    length allowed.
    """
    known, unknown = classify_features(features, model_type, target)
    shortest = length if model_type == "nbeats" else max(1, length - horizon)
    samples = _starts(df, shortest + horizon, by, split, idx).withColumnRenamed("start_idx", "encoder_start")
    encoder = F.least(F.lit(length), F.col("__n") - F.col("encoder_start") - horizon).cast("bigint")
    return samples.select(
        by, split, "encoder_start",
        encoder.alias("encoder_length"),
        (F.col("encoder_start") + encoder).alias("decoder_start"),
        F.lit(horizon).cast("bigint").alias("prediction_length"),
        F.lit(",".join(known)).alias("known_reals"),
        F.lit(",".join(unknown)).alias("unknown_reals"),
    )


def classify_features(
    cols: Sequence[str], model_type: str = "tft", target: str = "temp_ar_c"
) -> tuple[list[str], list[str]]:
    """Features known ahead of time and the others, in their order."""
    if model_type == "nbeats":
        return [], [target]
    return [c for c in cols if c in S.KNOWN_FUTURE], [c for c in cols if c not in S.KNOWN_FUTURE]


def rows_until(
    requests: DataFrame, series: DataFrame, ref: str = "reference_date", by: str = S.KEY,
    t: str = S.TIME, out: str = "rows_until",
) -> DataFrame:
    """Requests with the number of series rows at or before their instant."""
    marks = series.select(by, F.col(t).alias("__t"), F.lit(0).alias("__kind"), F.lit(1).alias("__one"))
    asks = requests.select(
        by, F.col(ref).alias("__t"), F.lit(1).alias("__kind"),
        F.lit(None).cast("int").alias("__one"), F.struct(*requests.columns).alias("__req"),
    )
    both = marks.unionByName(asks, allowMissingColumns=True)
    counted = running(
        both, [by], ["__t", "__kind"], time_chunk("__t"), {out: ("count", F.col("__one"))}
    )
    return counted.where(F.col("__kind") == 1).select("__req.*", F.col(out).cast("bigint").alias(out))


def span_index(series: DataFrame, by: str = S.KEY, t: str = S.TIME, hours: int = 24 * 21) -> DataFrame:
    """As-of index of a series: a row for each span of time that holds rows.

    ``chunk`` is the span, ``n`` its rows, ``before`` the rows of earlier spans of the station and ``ordinal`` the
    span's place among them, from 1. It is written to the shared folder: made in one
    pass over the series, small beside it, and read by every look-up.
    """
    counts = series.groupBy(by, time_chunk(t, hours).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(
        counts, [by], ["chunk"], F.floor(F.col("chunk") / F.lit(BLOCK_ROWS)),
        {"__through": ("sum", F.col("n")), "ordinal": ("count", F.lit(1))},
    ).select(by, "chunk", "n", (F.col("__through") - F.col("n")).alias("before"), "ordinal")
    path = shared_dir(series.sparkSession, "spans")
    placed.write.parquet(path)
    return series.sparkSession.read.schema(placed.schema).parquet(path)


def _span_at(
    asked: DataFrame, index: DataFrame, axis: str, at: str, out: str, request_id: str, by: str, block: int
) -> DataFrame:
    """Adds ``out``, the last span of the station whose ``axis`` is at most ``at`` (null where there is none).

    Spans and the different values asked for are sorted together, ``block`` units of the axis at a time; the
    last span of a block is carried to the blocks that follow.
    """
    span = F.struct("ordinal", "chunk", "before", "n")
    marks = index.select(by, F.col(axis).alias(at), F.lit(0).alias("__kind"), span.alias("__span"))
    asks = asked.select(by, at).where(F.col(at).isNotNull()).distinct().withColumn("__kind", F.lit(1))
    both = marks.unionByName(asks, allowMissingColumns=True)
    seen = running(both, [by], [at, "__kind"], F.floor(F.col(at) / F.lit(block)), {out: ("max", F.col("__span"))})
    found = seen.where("__kind = 1").select(by, at, out)
    return spread_join(asked, found, [by, at], [request_id], "left")


def _with_series(
    requests: DataFrame, series: DataFrame, n: Column | int, request_id: str, ref: str, by: str, t: str,
    hours: int | None,
) -> DataFrame:
    """Requests with the rows of their spans, newest first.

    Adds ``__row`` (the row of the series, null for a request without one),
    ``__back`` (1 for the newest), ``__need``, ``rows_until`` and ``status``.
    """
    need = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    hours = hours or (max(24, n) if isinstance(n, int) else 24 * 21)
    index = span_index(series, by, t, hours)
    asked = requests.withColumn("__need", need).withColumn("__at", time_chunk(ref, hours))
    asked = _span_at(asked, index, "chunk", "__at", "__last", request_id, by, BLOCK_ROWS)
    whole = F.when(F.col("__last.chunk") < F.col("__at"), F.col("__last.n")).otherwise(0)  # the span of the instant counts row by row
    low = F.col("__last.before") + whole - F.greatest(F.col("__need"), F.lit(0))
    asked = asked.withColumn("__low", low)
    asked = _span_at(asked, index, "before", "__low", "__first", request_id, by, BLOCK_ROWS * hours)
    # a request with less than it needs looks at all its spans; one that needs no rows at the last
    first = F.when(F.col("__first.ordinal") > F.col("__last.ordinal"), F.col("__last")).otherwise(F.col("__first"))
    asked = asked.withColumn("__first", first)
    spans = F.sequence(F.coalesce("__first.ordinal", F.lit(1).cast("bigint")), F.col("__last.ordinal"))
    wanted = asked.withColumn("__base", F.coalesce("__first.before", F.lit(0))).withColumn(
        "__ordinal", F.explode_outer(spans)
    ).drop("__at", "__low", "__last", "__first")
    places = index.select(by, F.col("ordinal").alias("__ordinal"), F.col("chunk").alias("__chunk"))
    wanted = spread_join(wanted, places, [by, "__ordinal"], [request_id], "left").drop("__ordinal")
    rows = series.select(
        F.col(by).alias("__by"), time_chunk(t, hours).alias("__span"), F.col(t).alias("__t"), F.struct(*series.columns).alias("__row")
    )
    found = wanted.join(
        rows, (F.col(by) == F.col("__by")) & (F.col("__chunk") == F.col("__span")) & (F.col("__t") <= F.col(ref)), "left"
    )
    # A request sees its n rows and at most two spans more.
    group = Window.partitionBy(request_id)
    total = F.col("__base") + F.count("__t").over(group)
    enough = (F.col("rows_until") >= F.col("__need")) & (F.col("__need") > 0)
    return (
        found.withColumn("__back", F.row_number().over(group.orderBy(F.desc_nulls_last("__t"))))
        .withColumn("rows_until", total)
        .withColumn("status", F.when(enough, "ok").otherwise("insufficient_rows"))
        .drop("__by", "__span", "__chunk", "__base")
    )


def last_n_before(
    requests: DataFrame,
    series: DataFrame,
    n: Column | int,
    request_id: str = "request_id",
    ref: str = "reference_date",
    by: str = S.KEY,
    t: str = S.TIME,
    hours: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Last ``n`` rows at or before each request.

    Returns (requests with ``status`` and ``rows_until``, rows with
    ``position`` 0 to n-1). A request with fewer rows than it needs is
    ``insufficient_rows`` and gets none.

    An index of the series (``span_index``, a row for each span) tells which spans a request can need. Only
    their rows are joined, by equality on (station, span); few requests are
    broadcast and the series is not shuffled at all. It is read twice: for the index, and for the rows.
    """
    joined = _with_series(requests, series, n, request_id, ref, by, t, hours)
    status = joined.where(F.col("__back") == 1).select(*requests.columns, "rows_until", "status")
    rows = joined.where((F.col("status") == "ok") & (F.col("__back") <= F.col("__need"))).select(
        request_id, "__row.*", (F.col("__need") - F.col("__back")).alias("position")
    )
    return status, rows


def last_n_stats(
    requests: DataFrame, series: DataFrame, n: Column | int, stats: Sequence[Column], request_id: str = "request_id",
    ref: str = "reference_date", by: str = S.KEY, t: str = S.TIME, hours: int | None = None,
) -> DataFrame:
    """Aggregates of the last ``n`` rows of each request in one pass.

    ``stats`` are aggregates over the fields of ``__row``, which is null for rows
    that do not count. Gives ``request_id, status, rows_until`` and the stats.
    """
    joined = _with_series(requests, series, n, request_id, ref, by, t, hours)
    counts = (F.col("status") == "ok") & (F.col("__back") <= F.col("__need"))
    return joined.withColumn("__row", F.when(counts, F.col("__row"))).groupBy(request_id, "status", "rows_until").agg(*stats)


def interval_join(
    intervals: DataFrame,
    series: DataFrame,
    start: str,
    end: str,
    by: str = S.KEY,
    t: str = S.TIME,
    hours: int = 24,
) -> DataFrame:
    """Series rows with ``start <= t <= end``, both ends included.

    Each interval is listed once per time slot it touches, which turns the
    range condition into an equality on ``(key, slot)``.
    """
    slots = intervals.withColumn(
        "__slot", F.explode(F.sequence(time_chunk(start, hours), time_chunk(end, hours)))
    )
    return (
        slots.join(series.withColumn("__slot", time_chunk(t, hours)), [by, "__slot"])
        .where(F.col(t).between(F.col(start), F.col(end)))
        .drop("__slot")
    )
