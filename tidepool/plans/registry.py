"""The registry of queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.sources.fixtures import duckdb_view
from tidepool.sources.stored import scratch, stored  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query and its SQL; views are named fx_<view> in it."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            with_views = ",\n".join(f"fx_{v} AS ({duckdb_view(v)})" for v in views)
            if not with_views:
                SQL[name] = sql
            elif sql.lstrip().startswith("WITH RECURSIVE"):
                SQL[name] = f"WITH RECURSIVE {with_views},\n{sql.lstrip()[14:]}"
            else:
                SQL[name] = f"WITH {with_views}" + (f",\n{sql.lstrip()[4:]}" if sql.lstrip().startswith("WITH") else f"\n{sql}")
        return f

    return register
