"""Number and vector expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from .. import schema as S
from .text import as_col

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_decimal(col: Column | str, sep: str = ",") -> Column:
    """Number written with a decimal separator, null when it is not one."""
    text = F.replace(as_col(col), F.lit(sep), F.lit("."))
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def finite_or_null(col: Column | str) -> Column:
    value = as_col(col)
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def fixed_text(col: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals, decided by the exact binary value."""
    return F.replace(F.format_number(as_col(col).cast("double"), digits), F.lit(","), F.lit(""))


def round_even(col: Column | str, digits: int) -> Column:
    """Rounding decided by the exact binary value, halves to even."""
    return fixed_text(col, digits).cast("double")


def zero_sum(col: Column | str) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(as_col(col)), F.lit(0.0))


def aggregation(name: str, strict: bool = True):
    """Aggregate by name; without ``strict`` any other name means sum."""
    if name == "mean":
        return lambda c: F.avg(as_col(c))
    if name == "sum" or not strict:
        return zero_sum
    raise ValueError("aggregation must be 'mean' or 'sum'")


def error_columns(pred: Column, actual: Column) -> list[Column]:
    """mae, rmse, mape as a fraction without zero actuals, number of pairs."""
    diff = pred - actual
    return [
        F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.when(actual != 0, F.abs(diff) / F.abs(actual))).alias("mape_frac"),
        F.count(diff).alias("n_points"),
    ]


def training_error_columns(pred: Column, actual: Column, eps: float = 1e-6) -> list[Column]:
    """mae, rmse, mape in percent with a floor under the denominator."""
    diff = pred - actual
    floor = F.greatest(F.abs(actual), F.lit(float(eps)))
    return [
        F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        (F.avg(F.abs(diff) / floor) * 100).alias("mape_pct"),
    ]


def dot(a: Column | str, b: Column | str) -> Column:
    prod = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 when one of them is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    sq = F.zip_with(
        as_col(a), as_col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x)


def first_metric(
    metrics: Column | str, skip_nan: bool = False, keys: Sequence[str] = tuple(S.MAPE_KEYS)
) -> Column:
    """First metric present in a map; ``skip_nan`` looks past NaN aliases but keeps the first key."""
    values = as_col(metrics)
    found = []
    for pos, key in enumerate(keys):
        value = F.try_element_at(values, F.lit(key))
        if skip_nan and pos > 0:
            value = F.when(~F.isnan(value), value)
        found.append(value)
    merged = F.coalesce(*found)
    if skip_nan:
        present = F.map_contains_key(values, keys[0])
        return F.when(present, found[0]).otherwise(merged)
    return merged


_PARAM = (
    "kind string, int_value bigint, float_value double, bool_value boolean, list_value array<string>, "
    "text_value string, json_value string"
)


def _param_value(text: str):
    """The value that a parameter text spells; a text that spells none is itself."""
    import ast

    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return text


def _param_row(text: str | None) -> tuple:
    import json

    if text is None:
        return (None,) * 7
    value = _param_value(text)
    if isinstance(value, (set, frozenset)):
        value = sorted(value, key=repr)
    if not isinstance(value, (bool, int, float, list, tuple, dict, type(None))):
        value = str(value)
    kinds = ((bool, "bool"), (int, "int"), (float, "float"), ((list, tuple), "list"), (dict, "map"), (type(None), "none"), (str, "text"))
    kind = next(name for types, name in kinds if isinstance(value, types))
    encode = lambda v: json.dumps(v, ensure_ascii=False, default=str)
    if kind == "map":
        value = {str(k): v for k, v in value.items()}
    return (
        kind,
        value if kind == "int" and -(1 << 63) <= value < 1 << 63 else None,
        value if kind == "float" else None,
        value if kind == "bool" else None,
        [x if isinstance(x, str) else encode(x) for x in value] if kind == "list" else None,
        value if kind == "text" else None,
        encode(value),
    )


def parse_param(col: Column | str) -> Column:
    """Struct (kind, int_value, float_value, bool_value, list_value, text_value, json_value) of a parameter text.

    Lists, tuples and mappings may be nested and hold typed items; ``json_value``
    has the whole value, also integers beyond 64 bits. ``list_value`` has texts
    as they are and other items as JSON.
    """
    names = [f.split()[0] for f in _PARAM.split(", ")]

    @F.pandas_udf(_PARAM)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([_param_row(t) for t in texts], columns=names, dtype=object)
        rows["int_value"] = rows["int_value"].astype("Int64")
        return rows

    return parse(as_col(col).cast("string"))


def require_param(params: Column | str, key: str) -> Column:
    """Parsed parameter of a map; a missing key fails the job."""
    values = as_col(params)
    text = F.when(F.map_contains_key(values, key), F.element_at(values, key)).otherwise(
        F.raise_error(F.lit(f"missing parameter: {key}")).cast("string")
    )
    return parse_param(text)


def first_filled(*cols: Column | str, default: str = S.UNKNOWN) -> Column:
    """First text that is not empty once quotes and blanks are trimmed."""
    cleaned = [
        F.nullif(F.trim(F.regexp_replace(F.trim(as_col(c).cast("string")), "^[\"']+|[\"']+$", "")), F.lit(""))
        for c in cols
    ]
    return F.coalesce(*cleaned, F.lit(default))
