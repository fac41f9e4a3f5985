"""Relative strength against a benchmark, and sector ranking."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import by, with_far


def by_date(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add rs = close / benchmark close of the same date; bars without one have no row.

    The benchmark has one row per calendar date, so its size is bounded and it is broadcast: bars stay in
    their exchange and order by ticker.
    """
    out = bars.join(F.broadcast(benchmark.select("date", F.col("close").alias("bench_close"))), "date").where("close > 0 and bench_close > 0")
    return out.withColumn("rs", F.col("close") / F.col("bench_close"))


def by_tail(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add rs with both series lined up at their ends, whatever their dates: the n-th bar from the
    end of one meets the n-th from the end of the other."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    other = benchmark.select((F.max("bar").over(Window.partitionBy()) - F.col("bar") + 1).alias("_back"), F.col("close").alias("bench_close"))
    out = bars.withColumn("_back", back).join(other, "_back").where("close > 0 and bench_close > 0")
    return out.withColumn("rs", F.col("close") / F.col("bench_close")).drop("_back")


def with_trend_columns(df: DataFrame, n: int = 63, bar: str = "bar", *parts: str) -> DataFrame:
    """Add rs_slope_pct per bar (of the mean), rs_above_sma, rs_uptrend; null before n values.

    Wants an rs on every bar, numbered from 1 by `bar`: the least-squares slope then follows from two sums.
    """
    many = _factor(n)
    df = df.withColumn("_at", F.col("rs") * F.col(bar))
    df = with_far(df, {"_sum": "rs", "_turn": "_at"}, "sum", many, n // many, 0, *parts)
    mean = F.col("_sum") / n
    slope = (F.col("_turn") - F.col("_sum") * (F.col(bar) - (n - 1) / 2)) / (n * (n * n - 1) / 12)
    pct = F.when(F.abs(mean) >= 1e-12, slope / F.abs(mean))
    whole = F.col(bar) >= n
    above = F.when(mean > 0, F.col("rs") >= mean)
    out = {"rs_slope_pct": F.when(whole, pct * 100), "rs_above_sma": F.when(whole, above), "rs_uptrend": F.when(whole, F.coalesce((pct > 0) & above, F.lit(False)))}
    return df.withColumns(out).drop("_at", "_sum", "_turn")


def _factor(n: int) -> int:
    """The divisor of n next to its root, from below or one above."""
    return next(k for k in range(math.isqrt(n) + 1, 0, -1) if n % k == 0)


def report(bars: DataFrame, benchmark: DataFrame, n: int = 63, lookback: int = 252, align: str = "date") -> DataFrame:
    """Verdict on every bar: diverging (a price high without one in rs), leading, uptrend, lagging, unknown."""
    return _verdicts((by_date if align == "date" else by_tail)(bars, benchmark), n, lookback)


def with_verdict(bars: DataFrame, benchmark: DataFrame, n: int = 63, lookback: int = 252) -> DataFrame:
    """Add rs_verdict as `report` by date gives it, null on bars that it leaves out.

    No bar is dropped, so the verdict shares the exchange of the other windows over the ticker: bars
    with a benchmark close and those without are separate series inside it.
    """
    out = bars.join(F.broadcast(benchmark.select("date", F.col("close").alias("bench_close"))), "date", "left")
    out = out.withColumn("_has", F.coalesce((F.col("close") > 0) & (F.col("bench_close") > 0), F.lit(False)))
    out = out.withColumn("rs", F.when(F.col("_has"), F.col("close") / F.col("bench_close")))
    out = _verdicts(out, n, lookback, "_bar", "_has")
    return out.select(*bars.columns, F.when(F.col("_has"), F.col("rs_verdict")).alias("rs_verdict"))


def _verdicts(df: DataFrame, n: int, lookback: int, bar: str = "bar", *parts: str) -> DataFrame:
    df = with_trend_columns(df.withColumn(bar, F.row_number().over(by(*parts))), n, bar, *parts)
    many = _factor(lookback)  # 252 bars: 21 times 12
    df = with_far(df, {"_top": "rs", "_price_top": "close"}, "max", many, lookback // many, 1, *parts)
    top, price_top = F.col("_top"), F.col("_price_top")
    df = df.withColumns({"rs_new_high": F.col("rs") > top, "rs_near_high": F.col("rs") >= 0.97 * top, "rs_dist": F.col("rs") / top - 1, "price_new_high": F.col("close") > price_top})
    split = F.coalesce(F.col("price_new_high") & ~F.col("rs_near_high"), F.lit(False))
    up = F.coalesce(F.col("rs_uptrend"), F.lit(False))
    verdict = F.when(F.col(bar) < 2, "unknown").when(split, "diverging").when(up & F.col("rs_near_high"), "leading").when(up, "uptrend").otherwise("lagging")
    return df.withColumns({"rs_divergence": split, "rs_verdict": verdict}).drop("_top", "_price_top")


def rank_sectors(sector_bars: DataFrame, one: int = 21, three: int = 63) -> DataFrame:
    """sector, ret_1m, ret_3m, rank, top3_3m, top3_1m of each sector's last bar (`ticker` is the sector).

    Ranks go by the return rounded to four places, ties by name; no rank without a return. One row
    a sector, so the ranking window is small whatever the input.
    """
    back = lambda n: F.round(F.try_divide(F.col("close"), F.lag("close", n).over(by())) - 1, 4)
    df = sector_bars.withColumns({"ret_1m": back(one), "ret_3m": back(three)})
    last = df.groupBy(F.col("ticker").alias("sector")).agg(F.max_by("ret_1m", "date").alias("ret_1m"), F.max_by("ret_3m", "date").alias("ret_3m"))
    place = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc_nulls_last(), "sector"))
    out = last.withColumns({"_r3": place("ret_3m"), "_r1": place("ret_1m")})
    return out.select("sector", "ret_1m", "ret_3m", F.when(F.col("ret_3m").isNotNull(), F.col("_r3")).alias("rank"), F.coalesce((F.col("_r3") <= 3) & F.col("ret_3m").isNotNull(), F.lit(False)).alias("top3_3m"), F.coalesce((F.col("_r1") <= 3) & F.col("ret_1m").isNotNull(), F.lit(False)).alias("top3_1m"))


def sector_standing(names: DataFrame, ranking: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """names (sector_text) -> with rank and verdict of the first sector by rank whose name equals,
    contains or is contained in the text (lower case, after the aliases).

    The distinct texts, not the rows, meet the ranking, which has a row for each sector.
    """
    key = F.lower(F.trim("sector_text"))
    if aliases:
        key = F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[key], key)
    texts = names.select("sector_text").distinct().withColumn("_key", key)
    known = ranking.agg(F.collect_list(F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("o"), "sector", "rank", "top3_3m")).alias("_all"))
    every = texts.join(F.broadcast(known))  # one row: the sectors as an array
    name = lambda s: F.lower(s["sector"])
    hits = F.filter(F.array_sort("_all"), lambda s: (name(s) == F.col("_key")) | ((F.col("_key") != "") & (name(s).contains(F.col("_key")) | F.col("_key").contains(name(s)))))
    found = every.withColumn("_hit", F.try_element_at(hits, F.lit(1)))
    verdict = F.when(F.col("_hit").isNull(), "unknown").when(F.col("_hit.top3_3m"), "top3").otherwise("tracking")
    return names.join(found.select("sector_text", F.col("_hit.sector").alias("sector"), F.col("_hit.rank").alias("rank"), verdict.alias("verdict")), "sector_text", "left")

