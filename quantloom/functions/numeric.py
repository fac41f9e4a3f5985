"""Null-safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where either is null or b is 0."""
    return F.try_divide(a, b)


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    """Bound a value; null stays null."""
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(value.isNotNull(), F.greatest(bound(low), F.least(bound(high), value)))


def or_default(value: Column, default: float | Column) -> Column:
    """The default where value is null or 0: configuration values of 0 mean "not set"."""
    return F.coalesce(F.when(value != 0, value), default if isinstance(default, Column) else F.lit(default))


def passes_unless_false(gate: Column) -> Column:
    """Three-valued gate: unknown passes."""
    return F.coalesce(gate, F.lit(True))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def sample_z(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (value - mean) / deviation)
