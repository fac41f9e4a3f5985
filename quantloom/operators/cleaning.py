"""Cleaning of bars: types, gaps, staleness, look-ahead cuts, non-equities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICES = ("open", "high", "low", "close", "volume")


def coerce_bars(raw: DataFrame) -> DataFrame:
    """Cast what is castable; rows without a date or a close go; NaN counts as missing."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c)
    return raw.select("ticker", F.col("date").try_cast("date").alias("date"), *map(number, PRICES)).where("date is not null and close is not null")


def fill_gaps(bars: DataFrame) -> DataFrame:
    """Carry each price forward over gaps; leading gaps take the first value that follows."""
    by = Window.partitionBy("ticker").orderBy("date")
    back, every = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # where nothing stands before, the first value that follows is the first of all: one pass over a ticker's bars
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(every)) for c in PRICES}
    return bars.withColumns(filled)


def as_of(bars: DataFrame, day: str, years: int = 5) -> DataFrame:
    """Bars of the years up to a day, that day included: the cut stands below every window."""
    end = F.to_date(F.lit(day))
    return bars.where((F.col("date") <= end) & (F.col("date") >= F.add_months(end, -12 * years)))


def fresh_tickers(bars: DataFrame, day: str, stale_days: int = 10) -> DataFrame:
    """ticker, last_date, stale: stale where the last bar is more than stale_days before the day."""
    last = bars.where(F.col("date") <= F.to_date(F.lit(day))).groupBy("ticker").agg(F.max("date").alias("last_date"))
    return last.withColumn("stale", F.datediff(F.to_date(F.lit(day)), "last_date") > stale_days)


def not_equity(name: Column) -> Column:
    """Names of funds, trusts, notes and indices (by part of the name)."""
    return F.coalesce(F.upper(name).rlike("ETF|ETN|TRUST|INDEX|FUND"), F.lit(False))


def reported_by(statements: DataFrame, day: str) -> DataFrame:
    """Statements whose period had ended by the day, and, where known, that were available then."""
    end = F.to_date(F.lit(day))
    kept = statements.where(F.col("period_end") <= end)
    return kept.where(F.col("available_date").isNull() | (F.col("available_date") <= end)) if "available_date" in statements.columns else kept
