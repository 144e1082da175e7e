"""Experiment runs, promotion and production versions as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schema as S
from ..functions import numbers as N
from .series import running


def flatten_config(df: DataFrame, exclude: str = "governance.") -> DataFrame:
    """Nested configuration to a ``params`` map with dotted keys and text values."""
    keys: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, prefix: str) -> None:
        for field in kind.fields:
            name = prefix + field.name
            col = F.col(".".join(f"`{p}`" for p in name.split(".")))
            if isinstance(field.dataType, T.StructType):
                walk(field.dataType, name + ".")
            elif not (exclude and name.startswith(exclude)):
                keys.append((name, _as_text(col, field.dataType)))

    walk(df.schema, "")
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), c.alias("v")) for n, c in keys])
    present = F.filter(pairs, lambda p: p["v"].isNotNull())
    return df.select("*", F.map_from_entries(present).alias("params"))


def _as_text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(kind, T.ArrayType):
        quoted = F.transform(col, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'")))
        plain = F.transform(col, lambda x: x.cast("string"))
        items = quoted if isinstance(kind.elementType, T.StringType) else plain
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return col.cast("string")


def resolve_governance(df: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """Each field from the first filled of its source columns, else a fixed word."""
    kinds = dict(df.dtypes)

    def source(c: str) -> Column:
        return F.lower(F.col(c).cast("string")) if kinds.get(c) == "boolean" else F.col(c)

    return df.withColumns({f: N.first_filled(*[source(c) for c in cols]) for f, cols in fields.items()})


def top1(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Smallest row per group as one aggregate with map-side combine."""
    key = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c) for c in cols])
    best = df.groupBy(*by).agg(F.min(key).alias("__b"))
    return best.select(*by, *[F.col("__b")[c].alias(c) for c in cols])


def select_best_run(
    runs: DataFrame, metric: str = "mape", by: str = "experiment", run: str = "run_id",
    status: str = "status",
) -> DataFrame:
    """Finished run with the lowest metric per experiment; missing metrics come last."""
    done = runs.where(F.col(status) == "FINISHED")
    order = [F.col(metric).isNull() | F.isnan(F.col(metric).cast("double")), F.col(metric), F.col(run)]
    return top1(done, [by], order, [run, metric])


def require_best_run(runs: DataFrame, experiment: str, **kw) -> DataFrame:
    """Best run of one experiment; none is an error."""
    best = select_best_run(runs.where(F.col(kw.get("by", "experiment")) == experiment), **kw)
    if best.isEmpty():
        raise ValueError(f"no finished run in experiment {experiment!r}")
    return best


def promotion_gate(
    candidates: DataFrame, production: DataFrame, force: bool = False, on: str = "model_name"
) -> DataFrame:
    """Decision per candidate. A missing value or NaN on either side never blocks.

    ``candidates``: model, run_id, mape. ``production``: model, mape.
    """
    current = production.select(on, F.col("mape").alias("current_mape"))
    out = candidates.join(current, on, "left")
    comparable = ~F.isnan("mape") & ~F.isnan("current_mape")  # Spark sorts NaN above all numbers
    worse = F.coalesce(comparable & (F.col("mape") > F.col("current_mape")), F.lit(False))
    rejected = worse & F.lit(not force)
    return out.select(
        on, "run_id", "mape", "current_mape",
        (F.col("mape") - F.col("current_mape")).alias("delta"),
        F.when(rejected, "rejected").otherwise("promoted").alias("decision"),
        F.coalesce(F.col("mape").cast("string"), F.lit("")).alias("mape_tag"),
    )


def production_versions(
    versions: DataFrame, manifests: DataFrame | None = None, on: str = "model_name"
) -> DataFrame:
    """Newest production version per model; an exported manifest takes precedence."""
    fields = ["version", "run_id", "mape", "promoted_at", "promoted_by", "experiment_name"]
    live = versions.where(F.col("alias") == "production")
    newest = top1(live, [on], [-F.col("version")], fields)
    if manifests is None:
        return newest
    m = manifests.select(on, *[F.col(c).alias(f"__m_{c}") for c in fields if c != "promoted_by"])
    both = newest.join(m, on, "full_outer")
    has = F.col("__m_run_id").isNotNull()
    picked = [
        F.when(has, F.col(f"__m_{c}")).otherwise(F.col(c)).alias(c) if c != "promoted_by"
        else F.when(has, F.lit("export")).otherwise(F.col(c)).alias(c)
        for c in fields
    ]
    return both.select(on, *picked)


def early_stop_trace(
    epochs: DataFrame, patience: int, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss",
    block: int = 1024,
) -> DataFrame:
    """Best epoch and the epoch training stops at, per run. Epochs count from 1.

    The least (loss, epoch) so far is the last gain: on equal losses the
    earlier epoch stays. It travels from block to block, so a long run is not one task.
    """
    chunk = F.floor(F.col(epoch) / F.lit(block)).cast("bigint")
    valid = F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double"))
    traced = running(
        epochs, [run], [epoch], chunk,
        {"__gain": ("min", F.when(valid, F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e")))), "__low": ("min", F.col(loss))},
    )
    best = F.coalesce(F.col("__gain.e"), F.lit(0))
    stop = F.min(F.when(F.col(epoch) - best >= patience, F.struct(F.col(epoch), best.alias("b"), F.col("__low"))))
    out = traced.groupBy(run).agg(
        stop.alias("__s"), F.max(epoch).alias("__n"), F.max(best).alias("__b"), F.min(loss).alias("__l")
    )
    halted = F.col("__s").isNotNull()
    return out.select(
        run,
        F.when(halted, F.col("__s")["b"]).otherwise(F.col("__b")).cast("bigint").alias("best_epoch"),
        F.when(halted, F.col("__s")["__low"]).otherwise(F.col("__l")).alias("best_val_loss"),
        F.when(halted, F.col("__s")[epoch]).otherwise(F.col("__n")).cast("bigint").alias("total_epochs"),
        halted.alias("stopped_early"),
    )


def coalesce_metric(df: DataFrame, metrics: str = "metrics", skip_nan: bool = False, out: str = "mape") -> DataFrame:
    return df.withColumn(out, N.first_metric(metrics, skip_nan))
