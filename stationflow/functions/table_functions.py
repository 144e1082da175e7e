"""Python table functions for SQL: window statistics, forecasts and summaries over partitioned, ordered tables.

``register(spark)`` makes them known to a session under their names:

* ``window_stats(TABLE(t), 'c1,c2', key => .., place => ..)`` — rows, least, greatest and mean value of each named column
* ``season_forecast(TABLE(t), season => 24, ...)`` — each hour ahead repeats the value one season earlier
* ``period_stats(TABLE(t), ...)`` — a row for each date and part of the day

Each names the partition key and the order of its table itself (``analyze``),
so a query cannot forget them; the key column comes back with its own type.
A partition is one window or one forecast. Rows are taken one after the
other and only sums, or the values of one season, are kept. Nulls and NaN do not count. Times are
wall times (``TIMESTAMP_NTZ``).
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import (
    DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampNTZType,
)

# --- fixed values: parts of the day, by the hour they end before ------------------
PERIODS = ((7, "madrugada"), (12, "manha"), (17, "tarde"), (24, "noite"))
# --- end of fixed values -----------------------------------------------------------


def _plan(table: AnalyzeArgument, names: dict[str, AnalyzeArgument | None], defaults: dict[str, str],
          rest: dict[str, DataType], needed: tuple[str, ...] = (), wall_time: str | None = None) -> AnalyzeResult:
    """Check the named columns of a table argument; result: its key, then ``rest``, by key and in order."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ...)")
    chosen = {}
    for what, default in defaults.items():
        given = names.get(what)
        if given is not None and (not given.isConstantExpression or not isinstance(given.value, str)):
            raise ValueError(f"{what} is the name of a column, a constant text")
        chosen[what] = default if given is None else given.value
    kinds: dict[str, DataType] = {f.name: f.dataType for f in table.dataType}
    missing = [c for c in (*chosen.values(), *needed) if c not in kinds]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}: {', '.join(kinds)}")
    clock = chosen.get(wall_time, wall_time)
    if clock and not isinstance(kinds[clock], TimestampNTZType):
        raise ValueError(f"cast {clock} to TIMESTAMP_NTZ: a worker does not know the time zone of the session")
    schema = StructType().add(chosen["key"], kinds[chosen["key"]])
    for name, kind in rest.items():
        schema = schema.add(name, kind)
    return AnalyzeResult(
        schema=schema, partitionBy=[PartitioningColumn(chosen["key"])], orderBy=[OrderingColumn(chosen["place"])],
    )


def _number(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


@udtf
class WindowStats:
    """``key, column, window_rows, min, max, mean`` of each named column; rows without a value count as rows only."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, columns: AnalyzeArgument, key: AnalyzeArgument | None = None,
                place: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not columns.isConstantExpression or not isinstance(columns.value, str):
            raise ValueError("columns is a constant text of names with commas between them")
        return _plan(
            rows, {"key": key, "place": place}, {"key": "request_id", "place": "position"},
            {"column": StringType(), "window_rows": LongType(), "min": DoubleType(), "max": DoubleType(), "mean": DoubleType()},
            tuple(c.strip() for c in columns.value.split(",")),
        )

    def __init__(self) -> None:
        self.seen = None

    def eval(self, rows, columns, key="request_id", place="position"):
        if self.seen is None:
            self.id, self.n = rows[key], 0
            self.seen = {c.strip(): [0, 0.0, math.inf, -math.inf] for c in columns.split(",")}
        self.n += 1
        for name, s in self.seen.items():
            x = _number(rows[name])
            if x is not None:
                s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + x, min(s[2], x), max(s[3], x)

    def terminate(self):
        for name, (n, total, low, high) in (self.seen or {}).items():
            yield (self.id, name, self.n, low, high, total / n) if n else (self.id, name, self.n, None, None, None)


@udtf
class SeasonForecast:
    """``key, reference_date, hour_ahead, value``; a window shorter than ``season`` gives no rows.

    The table has ``reference_date`` and ``horizon``, alike in all rows of a key.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, season: AnalyzeArgument | None = None, key: AnalyzeArgument | None = None,
                place: AnalyzeArgument | None = None, value: AnalyzeArgument | None = None) -> AnalyzeResult:
        if season is not None and (not season.isConstantExpression or not isinstance(season.value, int) or season.value < 1):
            raise ValueError("season is a constant number of rows, 1 at least")
        return _plan(
            rows, {"key": key, "place": place, "value": value},
            {"key": "request_id", "place": "position", "value": "temp_ar_c"},
            {"reference_date": TimestampNTZType(), "hour_ahead": IntegerType(), "value": DoubleType()},
            ("reference_date", "horizon"), "reference_date",
        )

    def __init__(self) -> None:
        self.last: list[float | None] = []
        self.n = 0

    def eval(self, rows, season=24, key="request_id", place="position", value="temp_ar_c"):
        if self.n < season:
            self.last.append(rows[value])
        else:
            self.last[self.n % season] = rows[value]
        self.n += 1
        self.season, self.id, self.at, self.horizon = season, rows[key], rows["reference_date"], rows["horizon"]

    def terminate(self):
        if self.n and self.n >= self.season:
            for h in range(int(self.horizon or 0)):
                yield self.id, self.at, h + 1, _number(self.last[(self.n + h) % self.season])


@udtf
class PeriodStats:
    """``key, target_date, period`` with least, greatest and mean value, peak hour (first on ties) and hours."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument | None = None, place: AnalyzeArgument | None = None,
                value: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _plan(
            rows, {"key": key, "place": place, "value": value},
            {"key": "request_id", "place": "timestamp", "value": "temp_ar_c"},
            {"target_date": DateType(), "period": StringType(), "temperature_min_c": DoubleType(),
             "temperature_max_c": DoubleType(), "temperature_avg_c": DoubleType(), "peak_hour": StringType(),
             "n_hours": LongType()},
            wall_time="place",
        )

    def __init__(self) -> None:
        self.part = None

    def eval(self, rows, key="request_id", place="timestamp", value="temp_ar_c"):
        t, x = rows[place], _number(rows[value])
        if t is None or x is None:
            return
        part = (t.date(), next(name for end, name in PERIODS if t.hour < end))
        if part != self.part:
            yield from self.terminate()
            self.part, self.id = part, rows[key]
            self.low, self.high, self.total, self.n, self.peak = x, x, 0.0, 0, t.hour
        if x > self.high:
            self.high, self.peak = x, t.hour
        self.low, self.total, self.n = min(self.low, x), self.total + x, self.n + 1

    def terminate(self):
        if self.part is not None:
            yield (self.id, *self.part, self.low, self.high, self.total / self.n, f"{self.peak:02d}h", self.n)
            self.part = None


FUNCTIONS = {"window_stats": WindowStats, "season_forecast": SeasonForecast, "period_stats": PeriodStats}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    for name, fn in FUNCTIONS.items():
        spark.udtf.register(name, fn)
