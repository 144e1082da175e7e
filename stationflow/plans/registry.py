"""Registered queries: name -> Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

from .views import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a callable under its own name; without SQL it is tested by other means."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import catalog_ingest, catalog_series, catalog_analytics, catalog_forecast, catalog_text, catalog_streaming  # noqa: F401
