"""Registration of catalog queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name; sql is what it must equal, if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Fixed places for columns whose last bits depend on the order of a sum; no negative zeros.

    Means of a round number of prices need eight places (they end in 5 at the seventh), others six.
    """
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def r(c: str | Column, digits: int = 8) -> Column:
    return F.round(c, digits) + 0.0
