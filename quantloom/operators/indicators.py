"""Technical indicators as columns over a ticker's whole history. Nulls mean "not enough bars"."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import by, decayed_sum, decayed_sums, ema, emas, full, prior, sma, trail, weighted_means

YEAR = 252.0


def with_steps(bars: DataFrame) -> DataFrame:
    """Add prev_close, change, ret, log_return, true_range."""
    out = bars.withColumn("prev_close", F.lag("close").over(by()))
    c, p = F.col("close"), F.col("prev_close")
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))
    return out.withColumns({"change": c - p, "ret": F.try_divide(c, p) - 1, "log_return": F.when((p > 0) & (c > 0), F.ln(c / p)), "true_range": F.when(p.isNotNull(), spread)})


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(gain + loss == 0, 50.0).when(loss > 0, 100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))).otherwise(100.0)


def rsi(n: int = 14) -> Column:
    """From plain sums of the last n gains and losses (not smoothed); 50 when flat, 100 without losses."""
    up, down = F.greatest("change", F.lit(0.0)), F.greatest(-F.col("change"), F.lit(0.0))
    return full(n + 1, F.round(_strength(F.sum(up).over(trail(n)), F.sum(down).over(trail(n))), 2))


def with_rsi_series(df: DataFrame, n: int = 14, wilder: bool = False, name: str = "rsi_series") -> DataFrame:
    """Recursive RSI. It starts from the sums of the first n gains and losses and then averages
    (value - value / n + step / n); with `wilder` it starts from their means."""
    start = F.lit(1.0 / n if wilder else 1.0)
    bar = F.col("bar")
    df = df.withColumns({"_gain": F.greatest("change", F.lit(0.0)), "_loss": F.greatest(-F.col("change"), F.lit(0.0))})
    run = by().rowsBetween(Window.unboundedPreceding, 0)  # read at bar n + 1; the first bar has no step
    df = df.withColumns({f"{c}0": F.sum(c).over(run) for c in ("_gain", "_loss")})
    term = lambda c: F.when(bar > n + 1, F.col(c) / n).when(bar == n + 1, F.col(f"{c}0") * start)
    df = decayed_sums(df, {"_up": (term("_gain"), 1 - 1 / n), "_down": (term("_loss"), 1 - 1 / n)}).drop("_gain", "_loss", "_gain0", "_loss0")
    return df.withColumn(name, full(n + 1, _strength(F.col("_up"), F.col("_down")))).drop("_up", "_down")


def atr(n: int = 14) -> Column:
    """Plain mean of the last n true ranges; shorter histories use what there is."""
    return full(2, F.avg("true_range").over(trail(n)))


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Add macd, macd_signal, macd_hist; the signal starts where the line does."""
    df = emas(df, {"_fast": ("close", fast), "_slow": ("close", slow)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ema(df, "macd", signal, "macd_signal", first=slow).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Bands by the population deviation; pct_b is null where the band is flat."""
    mid, sd = F.avg("close").over(trail(n)), F.stddev_pop("close").over(trail(n))
    low, high = mid - k * sd, mid + k * sd
    pct = F.when(high - low > 0, F.round((F.col("close") - low) / (high - low), 4))
    return {"bb_mid": full(n, mid), "bb_lower": full(n, low), "bb_upper": full(n, high), "pct_b": full(n, pct)}


def with_squeeze(df: DataFrame, n: int = 20) -> DataFrame:
    """Add squeeze: band width is the least of the last n + 1 (but for the last bits); false before 2 n bars."""
    df = df.withColumn("_width", full(n, 4 * F.stddev_pop("close").over(trail(n)) / F.avg("close").over(trail(n))))
    least = F.min("_width").over(trail(n + 1))
    return df.withColumn("squeeze", (F.col("bar") >= 2 * n) & (F.col("_width") <= least * (1 + 1e-12))).drop("_width")


def high_distance(n: int = 252) -> Column:
    top = F.max("close").over(trail(n))
    return F.when(top > 0, F.col("close") / top - 1)


def rvol(n: int = 50) -> Column:
    """Volume against the mean of up to n bars before."""
    base = F.avg("volume").over(prior(n))
    return F.when(base > 0, F.col("volume") / base)


def momentum(lookback: int = 252, skip: int = 21) -> Column:
    """close[-skip] / close[-lookback - skip] - 1; needs more than lookback + skip bars."""
    start = F.lag("close", lookback + skip - 1).over(by())
    end = F.col("close") if skip == 0 else F.lag("close", skip - 1).over(by())
    return full(lookback + skip + 1, F.when(start > 0, end / start - 1))


def realized_vol(n: int = 21) -> Column:
    """Annualised sample deviation of the log returns between the last n closes; 0 with under two."""
    return F.when(F.col("bar") >= 3, F.stddev_samp("log_return").over(trail(n - 1)) * math.sqrt(YEAR)).otherwise(0.0)


def vol_adjusted_momentum(lookback: int = 126, n: int = 21) -> Column:
    vol = realized_vol(n)
    return F.when(vol > 0, momentum(lookback, 0) / vol)


def trend_strength(n: int = 200) -> Column:
    mean = F.avg("close").over(trail(n))
    return F.when(mean > 0, (F.col("close") - mean) / mean).otherwise(0.0)


def choppiness(n: int = 14, flat: float = 0.5) -> Column:
    """Deviation of the last n log returns; 0.5 with under three, `flat` where they are all equal."""
    sd = F.stddev_pop("log_return").over(trail(n))
    return F.when((F.col("bar") >= 4) & (sd > 0), sd).when(sd.isNotNull() & (F.col("bar") >= 4), flat).otherwise(0.5)


def with_vol_scale(df: DataFrame, target: float = 0.15, decay: float = 0.94, name: str = "vol_scale") -> DataFrame:
    """target / exponentially weighted deviation (from 0), within 0 and 3; 0 with under five returns."""
    r = F.col("log_return")
    df = decayed_sum(df, (1 - decay) * r * r, decay, "_var")
    scale = F.least(F.lit(3.0), F.try_divide(F.lit(target), F.sqrt(F.col("_var") * YEAR)))
    return df.withColumn(name, F.when((F.col("bar") >= 6) & (F.col("_var") > 0), scale).otherwise(0.0)).drop("_var")


def with_vol_percentile(df: DataFrame, n: int = 21) -> DataFrame:
    """Per ticker: volatility of each tumbling run of n bars, and the share of runs up to the last one's.

    ticker, window, vol, share: one row per run; share is 0.5 where a ticker has a single run.
    """
    runs = df.withColumn("window", F.floor((F.col("bar") - 1) / n))
    first = F.min("bar").over(Window.partitionBy("ticker", "window"))
    inside = runs.withColumn("_r", F.when(F.col("bar") > first, F.col("log_return")))
    vol = F.when(F.count("_r") >= 2, F.stddev_samp("_r") * math.sqrt(YEAR)).otherwise(0.0)
    out = inside.groupBy("ticker", "window").agg(vol.alias("vol"))
    every = Window.partitionBy("ticker")
    last = F.max_by("vol", "window").over(every)
    share = F.sum((F.col("vol") <= last).cast("int")).over(every) / F.count("*").over(every)
    return out.select("ticker", "window", "vol", F.when(F.count("*").over(every) < 2, 0.5).otherwise(share).alias("share"))


def slope(y: str, n: int, bar: str = "bar", *parts: str) -> Column:
    """Least-squares slope of the last n values against the bar number."""
    return F.regr_slope(F.col(y), F.col(bar).cast("double")).over(trail(n, *parts))


def with_indicator_set(bars: DataFrame) -> DataFrame:
    """The named indicator set: means, MACD, smoothed RSI, bands by sample deviation, smoothed ATR,
    volume-weighted mean, money flow. Exponential means are normalised by the weights seen."""
    out = with_steps(bars)
    out = out.withColumns({"_up": F.greatest("change", F.lit(0.0)), "_down": F.greatest(-F.col("change"), F.lit(0.0)), "_tr": F.coalesce("true_range", F.col("high") - F.col("low"))})
    day, smooth = lambda n: ("close", 1 - 2 / (n + 1)), 13 / 14
    out = weighted_means(out, {"close_10_ema": day(10), "_fast": day(12), "_slow": day(26), "_gain": ("_up", smooth), "_loss": ("_down", smooth), "atr": ("_tr", smooth)})
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).withColumn("rsi", full(2, _strength(F.col("_gain"), F.col("_loss"))))
    out = weighted_means(out, {"macds": ("macd", 1 - 2 / 10)}).withColumn("macdh", F.col("macd") - F.col("macds"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = out.withColumn("_flow", typical * F.col("volume")).withColumn("_typical", typical)
    move = F.col("_typical") - F.lag("_typical").over(by())
    out = out.withColumns({"_in": F.when(move > 0, F.col("_flow")).otherwise(0.0), "_out": F.when(move < 0, F.col("_flow")).otherwise(0.0)})
    sd = F.stddev_samp("close").over(trail(20))
    mid = sma("close", 20)
    inflow, outflow = F.sum("_in").over(trail(14)), F.sum("_out").over(trail(14))
    out = out.withColumns({
        "close_50_sma": sma("close", 50), "close_200_sma": sma("close", 200), "boll": mid, "boll_ub": mid + 2 * sd, "boll_lb": mid - 2 * sd,
        "vwma": F.try_divide(F.sum("_flow").over(trail(14)), F.sum("volume").over(trail(14))), "mfi": full(15, F.try_divide(inflow, inflow + outflow) * 100),
    })
    return out.select("ticker", "date", "bar", "close", *INDICATORS)


INDICATORS = ("close_50_sma", "close_200_sma", "close_10_ema", "macd", "macds", "macdh", "rsi", "boll", "boll_ub", "boll_lb", "atr", "vwma", "mfi")


def calendar_spine(values: DataFrame, as_of: str, days: int) -> DataFrame:
    """Every calendar day of the last `days` up to as_of for every ticker; columns are null on days without a bar."""
    end = F.to_date(F.lit(as_of))
    spine = values.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.date_sub(end, days), end)).alias("date"))
    return spine.join(values.where(F.col("date").between(F.date_sub(end, days), end)), ["ticker", "date"], "left")
