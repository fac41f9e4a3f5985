"""Vendor routing: whole-record fallback by priority, cached results by age, unions without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a vendor's attempt ended with.
STATUSES = ("ok", "no_data", "rate_limited", "not_configured", "error")


def first_vendor(records: DataFrame, keys: list[str], order: list[str], by: str = "vendor") -> DataFrame:
    """For each key the whole record of the first vendor in order that has one; vendors not named are skipped.

    An aggregate with partial minima, so the records of a hot key never meet in one sort.
    """
    rest = [c for c in records.columns if c not in keys]
    place = F.array_position(F.array(*map(F.lit, order)), F.col(by))
    best = records.withColumn("_p", place).where("_p > 0").groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("_r"))
    return best.select(*keys, "_r.*")


def attempts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, vendor, status of the attempt that decides: the first ok one, else the last one tried."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("vendor"))
    named = rows.withColumn("_p", place).where("_p > 0")
    good = F.min_by(F.struct("vendor", "status"), F.when(F.col("status") == "ok", F.col("_p")))
    last = F.max_by(F.struct("vendor", "status"), "_p")
    out = named.groupBy(*keys).agg(F.when(F.count_if(F.col("status") == "ok") > 0, good).otherwise(last).alias("_a"))
    return out.select(*keys, "_a.vendor", "_a.status")


def cache_key(method: Column, arguments: Column) -> Column:
    return F.sha2(F.concat_ws("|", method, F.to_json(arguments)), 256)


def fresh(cached: DataFrame, now: str, ttl_seconds: int = 21_600, live: tuple[str, ...] = ("news",)) -> DataFrame:
    """Cached rows (category, ingested_at, status, ...) that may be served: ok, young enough, not of a live category."""
    at = F.to_timestamp(F.lit(now))
    return cached.where((F.col("status") == "ok") & ~F.col("category").isin(*live) & (F.col("ingested_at") > at - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))))


def union_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames of the same columns; of rows with equal keys, the one of the earliest frame (by ord inside it)."""
    every = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("_f", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*keys, "_f")]
    order = F.struct("_f", "ord") if "ord" in every.columns else F.struct("_f")
    return every.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def benchmark_of(symbol: Column, suffixes: dict[str, str], default: str = "SPY") -> Column:
    """The benchmark of the first suffix that a symbol ends with."""
    out = F.lit(None).cast("string")
    for suffix, name in reversed(list(suffixes.items())):
        out = F.when(symbol.endswith(suffix), name).otherwise(out)
    return F.coalesce(out, F.lit(default))
