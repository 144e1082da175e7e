"""Ordered operators over keyed series.

No operator here puts a whole series into one task. Rows are grouped by
``(key, chunk)``, a chunk being a fixed span of time, and what a chunk needs
from earlier ones travels as a small carry: running totals, or the last few
rows. The chunk is a plain function of the row, so a task that is run again
after an executor is lost sees the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import numbers as N, times as D

CHUNK_HOURS = 24 * 30
BLOCK_ROWS = 4096

_RUNNING = {
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "sum": (F.sum, F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
}


def time_chunk(t: Column | str, hours: int = CHUNK_HOURS) -> Column:
    """Number of the time span a row falls into."""
    value = F.col(t) if isinstance(t, str) else t
    return F.floor(F.unix_seconds(value.cast("timestamp")) / F.lit(hours * 3600)).cast("bigint")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, tuple[str, Column]],
    upto: int = 0,
) -> DataFrame:
    """Running aggregates from the start of each series to the current row.

    ``chunk`` must not decrease along ``order``. ``values`` maps an output
    name to (count | sum | min | max, column). ``upto=-1`` leaves the current
    row out.
    """
    by = list(by)
    tagged = df.withColumn("__chunk", chunk)
    inner = (
        Window.partitionBy(*by, "__chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, upto)
    )
    local = tagged.select(
        "*", *[_RUNNING[fn][0](col).over(inner).alias(f"__in_{out}") for out, (fn, col) in values.items()]
    )
    totals = tagged.groupBy(*by, "__chunk").agg(
        *[_RUNNING[fn][0](col).alias(f"__all_{out}") for out, (fn, col) in values.items()]
    )
    before = (
        Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *by, "__chunk",
        *[_RUNNING[fn][1](f"__all_{out}").over(before).alias(f"__pre_{out}") for out, (fn, _) in values.items()],
    )
    joined = local.join(carry, [*by, "__chunk"])
    return joined.select(
        *df.columns,
        *[_RUNNING[fn][2](F.col(f"__pre_{out}"), F.col(f"__in_{out}")).alias(out) for out, (fn, _) in values.items()],
    )


def index_series(
    df: DataFrame,
    by: str = S.KEY,
    t: str = S.TIME,
    tie: Sequence[str] = (),
    out: str = "time_idx",
    total: str | None = None,
    hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Zero-based position of each row in its series; ``total`` adds the row count."""
    tagged = df.withColumn("__chunk", time_chunk(t, hours))
    local = tagged.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(by, "__chunk").orderBy(t, *tie))
    )
    counts = tagged.groupBy(by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        by, "__chunk",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        *([F.sum("__n").over(Window.partitionBy(by)).alias(total)] if total else []),
    )
    return local.join(offsets, [by, "__chunk"]).select(
        *df.columns,
        (F.col("__offset") + F.col("__rn") - 1).cast("bigint").alias(out),
        *([total] if total else []),
    )


def _rows_before_chunks(
    tagged: DataFrame, by: str, t: str, tie: Sequence[str], cols: Sequence[str], depth: int
) -> DataFrame:
    """For each chunk the last ``depth`` rows before it, labelled with that chunk.

    A chunk is reduced to its last ``depth`` rows, in each task before they are
    sent, and then to one list. The lists of the ``depth`` chunks before hold
    the rows looked for, as a chunk has a row at least.
    """
    kept = list(dict.fromkeys([t, *tie, *cols]))
    backwards = Window.partitionBy(by, "__chunk").orderBy(*[F.desc(c) for c in (t, *tie)])
    last = (
        tagged.select(by, "__chunk", *kept)
        .withColumn("__back", F.row_number().over(backwards))
        .where(F.col("__back") <= depth)
    )
    tail = F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("__at"), *kept)))
    tails = last.groupBy(by, "__chunk").agg(tail.alias("__tail"))
    before = F.flatten(
        F.collect_list("__tail").over(Window.partitionBy(by).orderBy("__chunk").rowsBetween(-depth, -1))
    )
    earlier = tails.select(by, "__chunk", before.alias("__before"))
    first = F.greatest(F.size("__before") - depth, F.lit(0)) + 1
    return earlier.select(by, "__chunk", F.inline(F.slice("__before", first, F.lit(depth)))).drop("__at")


def add_lags(
    df: DataFrame,
    col: str = "temp_ar_c",
    lags: Sequence[int] = tuple(S.LAG_HOURS),
    by: str = S.KEY,
    t: str = S.TIME,
    mode: str = "rows",
    tie: Sequence[str] = (),
    prefix: str = "temp_lag_",
) -> DataFrame:
    """Value ``k`` rows (or, with ``mode='time'``, ``k`` hours) earlier.

    With ``mode='time'`` a (station, hour) that occurs more than once fails the job.
    """
    if mode == "time":
        # one copy of the series, moved on by each lag: one join
        moved = df.select(by, F.col(t).alias("__t"), F.col(col).alias("__v"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("__k"))
        moved = moved.select(by, D.hours_after(F.col("__t"), F.col("__k")).alias(t), "__k", "__v")
        twice = F.raise_error(F.concat_ws(" ", F.lit("more than one row of"), F.col(by).cast("string"), F.col(t).cast("string")))

        def value(k: int) -> Column:
            own = F.col("__k") == k
            only = F.max(F.when(own, F.col("__v")))
            return F.when(F.count_if(own) > 1, twice.cast(df.schema[col].dataType)).otherwise(only).alias(f"{prefix}{k}h")

        return df.join(moved.groupBy(by, t).agg(*[value(k) for k in lags]), [by, t], "left")
    if mode != "rows":
        raise ValueError("mode must be 'rows' or 'time'")
    return add_series_features(df, by, t, tie, lags={f"{prefix}{k}h": (col, k) for k in lags})


def add_moving_averages(
    df: DataFrame,
    cols: Mapping[str, str] | None = None,
    sizes: Sequence[int] = tuple(S.AVERAGE_HOURS),
    by: str = S.KEY,
    t: str = S.TIME,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Mean of the current and the previous ``size - 1`` rows, missing values skipped."""
    cols = cols or {"temp": "temp_ar_c", "pressao": "pressao_atm_estacao_mb"}
    means = {f"{name}_ma_{size}h": (col, size) for size in sizes for name, col in cols.items()}
    return add_series_features(df, by, t, tie, means=means)


def add_trends(
    df: DataFrame,
    cols: Mapping[str, str] | None = None,
    by: str = S.KEY,
    t: str = S.TIME,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Difference to the row before."""
    cols = cols or {"pressao": "pressao_atm_estacao_mb", "temp": "temp_ar_c"}
    diffs = {f"{name}_tendencia_1h": col for name, col in cols.items()}
    return add_series_features(df, by, t, tie, diffs=diffs)


def add_series_features(
    df: DataFrame,
    by: str = S.KEY,
    t: str = S.TIME,
    tie: Sequence[str] = (),
    lags: Mapping[str, tuple[str, int]] | None = None,
    means: Mapping[str, tuple[str, int]] | None = None,
    diffs: Mapping[str, str] | None = None,
    hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Lags, moving averages and differences from one shuffle and one sort.

    Each chunk also receives the few rows before it that its first rows look
    back at; they are dropped once the windows are computed.
    """
    lags, means, diffs = dict(lags or {}), dict(means or {}), dict(diffs or {})
    reach = [k for _, k in lags.values()] + [size - 1 for _, size in means.values()] + [1] * len(diffs)
    if not reach:
        return df
    used = [c for c, _ in (*lags.values(), *means.values())] + list(diffs.values())
    tagged = df.withColumn("__chunk", time_chunk(t, hours))
    earlier = _rows_before_chunks(tagged, by, t, tie, list(dict.fromkeys(used)), max(*reach, 1))
    rows = tagged.withColumn("__own", F.lit(True)).unionByName(
        earlier.withColumn("__own", F.lit(False)), allowMissingColumns=True
    )
    w = Window.partitionBy(by, "__chunk").orderBy(t, *tie)
    computed = {out: F.lag(c, k).over(w) for out, (c, k) in lags.items()}
    computed.update({out: F.avg(c).over(w.rowsBetween(-(size - 1), 0)) for out, (c, size) in means.items()})
    computed.update({out: F.col(c) - F.lag(c, 1).over(w) for out, c in diffs.items()})
    return (
        rows.select(*df.columns, "__own", *[col.alias(out) for out, col in computed.items()])
        .where("__own").drop("__own")
    )


def select_required(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exactly these columns; a missing one is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*cols)


def select_available(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The requested columns that exist, and the names that do not."""
    present = [c for c in dict.fromkeys(cols) if c in df.columns]
    return df.select(*present), [c for c in cols if c not in df.columns]


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities become null in the floating-point columns."""
    floating = [n for n, kind in df.dtypes if kind in ("double", "float") and (cols is None or n in cols)]
    return df.withColumns({n: N.finite_or_null(n) for n in floating})


def add_cyclic_hour(df: DataFrame, t: str = S.TIME) -> DataFrame:
    return df.withColumns(D.cyclic_hour(t))


def feature_table(
    df: DataFrame,
    targets: Sequence[str] = tuple(S.TARGET_COLUMNS),
    lags: Sequence[int] = tuple(S.LAG_HOURS),
    sizes: Sequence[int] = tuple(S.AVERAGE_HOURS),
    seasonal: bool = True,
    remove_nan: bool = True,
    by: str = S.KEY,
    t: str = S.TIME,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Clean rows to the feature table: targets, hour angle, lags, averages, trends."""
    base = select_required(df, [by, t, *tie, *targets])
    means = {}
    for size in sizes:
        means[f"temp_ma_{size}h"] = ("temp_ar_c", size)
        means[f"pressao_ma_{size}h"] = ("pressao_atm_estacao_mb", size)
    out = add_series_features(
        base, by, t, tie,
        lags={f"temp_lag_{k}h": ("temp_ar_c", k) for k in lags},
        means=means,
        diffs={"pressao_tendencia_1h": "pressao_atm_estacao_mb", "temp_tendencia_1h": "temp_ar_c"},
    )
    if seasonal:
        out = add_cyclic_hour(out, t)
    return drop_null_rows(out) if remove_nan else out


def add_group(df: DataFrame, value: str = S.GROUP_VALUE) -> DataFrame:
    return df.withColumn("group", F.lit(value))


def add_time_idx(df: DataFrame, by: str = S.KEY, t: str = S.TIME, tie: Sequence[str] = ()) -> DataFrame:
    """Constant group label and the position of each row."""
    return add_group(index_series(df, by, t, tie))


def temporal_split(
    df: DataFrame, train: float = 0.8, val: float = 0.1, by: str = S.KEY, t: str = S.TIME,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Adds ``time_idx``, ``split`` and ``split_idx`` (position inside the split)."""
    idx = index_series(df, by, t, tie, total="__total")
    n, i = F.col("__total"), F.col("time_idx")
    train_end = F.floor(n * F.lit(float(train))).cast("bigint")
    val_end = F.floor(n * F.lit(float(train) + float(val))).cast("bigint")
    split = F.when(i < train_end, "train").when(i < val_end, "val").otherwise("test")
    start = F.when(i < train_end, F.lit(0)).when(i < val_end, train_end).otherwise(val_end)
    return idx.select(*df.columns, "time_idx", split.alias("split"), (i - start).alias("split_idx"))


def training_slice(df: DataFrame, train: float = 0.8, **kw) -> DataFrame:
    return temporal_split(df, train, 0.0, **kw).where(F.col("split") == "train").drop("split", "split_idx")


def dataset_counts(split_df: DataFrame, length: int, horizon: int, by: str = S.KEY) -> DataFrame:
    """Rows and window counts per split."""
    return split_df.groupBy(by, "split").agg(F.count(F.lit(1)).alias("n_rows")).select(
        by, "split", "n_rows",
        F.greatest(F.col("n_rows") - length - horizon + 1, F.lit(0)).cast("bigint").alias("n_samples"),
    )


def stride_sample(
    df: DataFrame, max_points: int, by: str = S.KEY, t: str = S.TIME, tie: Sequence[str] = ()
) -> DataFrame:
    """Every k-th row of a series so that at most ``max_points`` remain."""
    if max_points <= 0:
        return df
    idx = index_series(df, by, t, tie, out="__i", total="__total")
    stride = F.greatest(F.ceil(F.col("__total") / F.lit(max_points)), F.lit(1))
    return idx.where(F.col("__i") % stride == 0).select(*df.columns)


def tail_rows(df: DataFrame, n: int, by: str = S.KEY, t: str = S.TIME) -> DataFrame:
    """Last ``n`` rows per series; Spark keeps ``n`` per task before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(t).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def head_rows(df: DataFrame, n: int, by: str = S.KEY, t: str = S.TIME) -> DataFrame:
    w = Window.partitionBy(by).orderBy(t)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def union_stations(*dfs: DataFrame) -> DataFrame:
    """All rows, columns matched by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def check_unique(df: DataFrame, by: str = S.KEY, t: str = S.TIME) -> DataFrame:
    """The (key, time) pairs that occur more than once."""
    return df.groupBy(by, t).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
