"""Queries by id over the driver's tables, each with the SQL that states its result where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.plans import retrieval as _retrieval  # noqa: F401  registers its queries
from tidepool.plans import state as _state  # noqa: F401
from tidepool.plans import tables as _tables  # noqa: F401
from tidepool.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
