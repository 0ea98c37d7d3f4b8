"""Naming an expression, so that it is evaluated once for each row however often it is used."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value); inside lambdas Spark would evaluate the expression again for every element."""
    return F.transform(F.array(value), use)[0]
