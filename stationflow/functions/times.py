"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S
from .text import as_col


def combine_date_hour(date: Column | str, hour: Column | str) -> Column:
    """Timestamp of a raw ``yyyy/MM/dd`` date and ``HHmm UTC`` hour.

    A two-digit hour is read as a full hour. A value that cannot be read
    fails the job, as a half-read file must not pass.
    """
    text = F.trim(F.regexp_replace(as_col(hour), "^[UTC]+|[UTC]+$", ""))
    text = F.when(F.length(text) == 2, F.concat(text, F.lit("00"))).otherwise(text)
    return F.to_timestamp(F.concat(as_col(date), text), "yyyy/MM/ddHHmm")


def hours_after(t: Column, hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(t.cast("timestamp")) + hours.cast("bigint") * 3600)


def calendar_parts(t: Column | str) -> dict[str, Column]:
    value = as_col(t)
    return {
        "ano": F.year(value),
        "mes": F.month(value),
        "nome_mes": F.date_format(value, "MMM"),
        "dia_do_ano": F.dayofyear(value),
        "hora": F.hour(value),
        "data_sem_hora": F.to_date(value),
    }


def cyclic_hour(t: Column | str) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * F.hour(as_col(t)) / F.lit(24.0)
    return {"hora_sin": F.sin(angle), "hora_cos": F.cos(angle)}


def period_of_day(t: Column | str) -> Column:
    hour = F.hour(as_col(t))
    out = F.lit(None).cast("string")
    for name, (first, end, _) in S.DAY_PERIODS.items():
        out = F.when((hour >= first) & (hour < end), F.lit(name)).otherwise(out)
    return out


def period_label(period: Column | str) -> Column:
    from .text import label_lookup

    return label_lookup(period, {k: v[2] for k, v in S.DAY_PERIODS.items()})


def horizon_bucket(hour_ahead: Column | str) -> Column:
    """Bucket of a forecast hour, null before hour 1."""
    value = as_col(hour_ahead)
    out = F.lit(None).cast("string")
    for name, first, last in S.HORIZON_BUCKETS:
        out = F.when(value.between(first, last), F.lit(name)).otherwise(out)
    return out


def buckets_of(horizon: Column | str) -> Column:
    """Array of (bucket, start_h, end_h) that a horizon reaches."""
    value = as_col(horizon)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("bucket"),
                F.lit(first).alias("start_h"),
                F.least(F.lit(last), value.cast("int")).alias("end_h"),
            )
            for name, first, last in S.HORIZON_BUCKETS
        ]
    )
    return F.filter(rows, lambda r: r["start_h"] <= value)


_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?)?$"
)


def parse_instant(col: Column | str, strict: bool = False) -> Column:
    """Timestamp of an ISO text: a date alone is midnight, ``Z`` is UTC.

    Unreadable text gives null, or fails the job with ``strict``.
    """
    text = F.trim(as_col(col))
    full = F.regexp_replace(text, r"([T ]\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    value = F.when(text.rlike(_ISO), F.try_to_timestamp(F.replace(full, F.lit(","), F.lit("."))))
    if strict:
        bad = F.raise_error(F.concat(F.lit("invalid instant: "), text)).cast("timestamp")
        value = F.when(value.isNull() & text.isNotNull(), bad).otherwise(value)
    return value


def newer_than(t: Column | str, now: Column, days: int = S.RETENTION_DAYS) -> Column:
    return as_col(t).cast("timestamp") >= now - F.expr(f"INTERVAL {int(days)} DAYS")
