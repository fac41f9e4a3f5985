"""Chart setups, evaluated on every bar. Flags keep three values: null is "cannot be told"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import passes_unless_false as ok
from . import indicators as ind
from .windows import by, ema, full, prior, sma, trail


def scan_signals(bars: DataFrame) -> DataFrame:
    """Trend pullback (a) and breakout (b) on bars with at least 200 bars of history."""
    df = ind.with_squeeze(ema(ind.with_steps(bars), "close", 20, "ema20"))
    volume = F.avg("volume").over(trail(20))
    df = df.withColumns({
        **{f"sma{n}": F.round(sma("close", n), 8) for n in (20, 50, 200)}, "rsi": ind.rsi(), "hi52_dist": ind.high_distance(),
        "qret": full(64, F.try_divide(F.col("close"), F.lag("close", 63).over(by())) - 1), "rvol": F.when(volume != 0, F.col("volume") / volume),
    }).where("bar >= 200")
    c = F.col
    a = (c("close") > c("sma50")) & (c("sma50") > c("sma200")) & (c("low") <= c("ema20")) & (c("close") >= c("ema20")) & c("rsi").between(40, 55) & (c("qret") >= 0.10)
    b = (c("hi52_dist") >= -0.10) & (c("close") > c("sma20")) & (c("close") > c("sma50")) & ((c("rvol") > 1.5) | ((c("rvol") < 0.75) & c("squeeze")))
    no = F.lit(False)
    return df.select("ticker", "date", "close", F.coalesce(a, no).alias("a"), F.coalesce(b, no).alias("b"), "rsi", "qret", "rvol", "squeeze", "hi52_dist")


def with_trend(df: DataFrame) -> DataFrame:
    """Add sma50, sma200, ema20, above_sma50, above_sma200, sma50_rising, sma200_rising, ema20_above_sma50, stacked.

    The plain means are rounded to eight places, which holds means of four-digit prices exactly: a mean that
    equals the one before doesn't rise, in whatever order its sum was taken.
    """
    df = ema(df, "close", 20, "ema20").withColumns({f"sma{n}": F.round(sma("close", n), 8) for n in (50, 200)})
    c = F.col
    df = df.withColumns({
        "above_sma50": c("close") > c("sma50"), "above_sma200": c("close") > c("sma200"),
        "sma50_rising": c("sma50") > F.lag("sma50", 5).over(by()), "sma200_rising": c("sma200") > F.lag("sma200", 15).over(by()), "ema20_above_sma50": c("ema20") > c("sma50"),
    })
    every = F.coalesce(c("ema20_above_sma50") & (c("sma50") > c("sma200")) & c("sma50_rising") & c("sma200_rising"), F.lit(False))
    return df.withColumn("stacked", F.when(c("sma200").isNotNull(), every))


def rsi_band(value: Column) -> Column:
    """unknown, broken (< 40), hot (> 70), strong (from 45), else reset."""
    return F.when(value.isNull(), "unknown").when(value < 40, "broken").when(value > 70, "hot").when(value >= 45, "strong").otherwise("reset")


def with_pullback(df: DataFrame, window: int = 6) -> DataFrame:
    """Add near_ema, volume_fade, uptrend_base, pullback; wants ema20 and sma50."""
    c = F.col
    recent, before = F.avg("volume").over(trail(window)), F.avg("volume").over(prior(2 * window - 1, window))
    up = F.coalesce(c("ema20") > F.lag("sma50", window).over(by()), F.lit(False))
    df = df.withColumns({"near_ema": (c("low") <= c("ema20")) & (c("close") >= c("ema20")), "volume_fade": full(2 * window, recent <= before), "uptrend_base": F.when(c("ema20").isNotNull(), up)})
    return df.withColumn("pullback", F.coalesce(c("near_ema") & ok(c("volume_fade")) & c("uptrend_base"), F.lit(False)))


def swing_stop(lookback: int = 10, mult: float = 1.0) -> dict[str, Column]:
    """swing_low, stop below it by mult ATR (a column atr is wanted), risk_pct of the close."""
    low = full(lookback, F.when(F.col("atr") > 0, F.min("low").over(trail(lookback))))
    stop = low - mult * F.col("atr")
    return {"swing_low": low, "stop": stop, "risk_pct": F.when((F.col("close") > stop) & (stop > 0), (F.col("close") - stop) / F.col("close"))}


def targets(entry: Column, stop: Column, r1: float = 2.0, r2: float = 3.0) -> tuple[Column, Column]:
    """Profit targets at multiples of the risk; null where the stop is not below the entry."""
    risk = F.when(entry - stop > 0, entry - stop)
    return entry + r1 * risk, entry + r2 * risk


def with_troughs(df: DataFrame, k: int = 3, strict: bool = True, carry: tuple[str, ...] = (), name: str = "trough") -> DataFrame:
    """Add name: at bar i + k, the struct (bar, low, carried columns) of bar i when its low is a trough.

    A trough is below the k lows before it and below (strict) or not above those after it. It stands
    where it becomes known, so that no later bar is looked at.
    """
    before, after = by().rowsBetween(-k, -1), by().rowsBetween(1, k)
    right = F.min("low").over(after)
    low = F.col("low")
    is_low = (F.col("bar") > k) & (F.count("low").over(after) == k) & (low < F.min("low").over(before)) & ((low < right) if strict else (low <= right))
    df = df.withColumn("_p", F.when(is_low, F.struct("bar", "low", *carry)))
    return df.withColumn(name, F.lag("_p", k).over(by())).drop("_p")


def with_last_two(df: DataFrame, window: int, k: int = 3, trough: str = "trough", one: str = "low1", two: str = "low2") -> DataFrame:
    """Add the last trough (two) and the one before it (one) among those inside the last `window` bars."""
    pair = F.when(F.col(trough).isNotNull(), F.struct(F.col(trough).alias("q"), F.last(trough, ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, -1)).alias("p")))
    df = df.withColumn("_pair", pair)
    df = df.withColumn("_pair", F.last("_pair", ignorenulls=True).over(by().rowsBetween(2 * k + 1 - window, 0)))
    inside = F.col("_pair.p.bar") >= F.greatest(F.col("bar") - window + 1, F.lit(1)) + k
    return df.withColumns({one: F.when(inside, F.col("_pair.p")), two: F.col("_pair.q")}).drop("_pair")


def higher_low(df: DataFrame, k: int = 3, window: int = 60) -> DataFrame:
    """Add higher_low: the last trough is above the one before; null with under two troughs."""
    df = with_last_two(with_troughs(df, k, strict=False), window, k)
    return df.withColumns({"higher_low": F.col("low2.low") > F.col("low1.low"), "recent_low": F.when(F.col("low1").isNotNull(), F.col("low2.low")), "prior_low": F.col("low1.low")}).drop("trough", "low1", "low2")


def macd_divergence(df: DataFrame, k: int = 3, window: int = 120) -> DataFrame:
    """Add momentum_verdict and momentum_bullish from the last two troughs' lows and MACD histograms, and
    rsi_also: the recursive RSI diverges too. Wants macd_hist and rsi_series."""
    df = with_last_two(with_troughs(df, k, strict=False, carry=("macd_hist", "rsi_series"), name="_t"), window, k, "_t", "_a", "_b")
    c = F.col
    falls, rises, up = c("_b.low") < c("_a.low"), c("_b.low") > c("_a.low"), c("_b.macd_hist") > c("_a.macd_hist")
    verdict = (
        F.when(c("bar") < 44, "unknown")
        .when(c("_a").isNull() | c("_a.macd_hist").isNull() | c("_b.macd_hist").isNull(), "none")
        .when(falls, F.when(up, "bullish-divergence").otherwise("lower-low-confirmation"))
        .when(rises, F.when(up, "higher-low").otherwise("higher-low-weak-indicator"))
        .otherwise("none")
    )
    df = df.withColumn("momentum_verdict", verdict)
    bullish = F.when(c("momentum_verdict") != "unknown", c("momentum_verdict").isin("bullish-divergence", "higher-low"))
    also = F.coalesce(falls & (c("_b.rsi_series") > c("_a.rsi_series")), F.lit(False))
    return df.withColumns({"momentum_bullish": bullish, "rsi_also": also}).drop("_t", "_a", "_b")


def volume_dry_up(window: int = 20, lookback: int = 5, ratio: float = 0.7, whole_prior: bool = False) -> dict[str, Column]:
    """Mean of the `lookback` volumes before the current bar against earlier ones.

    Earlier: the `lookback` bars that end `window` bars before the current one; with whole_prior, all
    `window` bars before the recent ones.
    """
    recent = F.avg("volume").over(prior(lookback))
    base = F.avg("volume").over(prior(window + lookback, lookback + 1) if whole_prior else prior(window + lookback, window + 1))
    value = full(window + lookback + 1, F.when(base > 0, recent / base))
    return {"vdu_ratio": F.round(value, 4), "dry_up": value <= ratio}


def trigger_candle(window: int = 20, rvol_min: float = 1.3) -> dict[str, Column]:
    """Close above the high before, on volume of at least rvol_min times the mean of the window before."""
    base = F.avg("volume").over(prior(window))
    value = full(window + 2, F.when(base > 0, F.col("volume") / base))
    above = F.col("close") > F.lag("high").over(by())
    return {"trigger_rvol": F.round(value, 3), "trigger": full(window + 2, F.coalesce((value >= rvol_min) & above, F.lit(False)))}


def vdu_entry(df: DataFrame) -> DataFrame:
    """Volume dry-up entry on every bar: trigger, confirmation by momentum or a higher low, dry-up not absent."""
    df = ind.with_rsi_series(ind.with_macd(ind.with_steps(df)))
    df = macd_divergence(higher_low(df.withColumns(volume_dry_up() | trigger_candle())))
    c = F.col
    confirmed = F.coalesce(c("momentum_bullish"), F.lit(False)) | F.coalesce(c("higher_low"), F.lit(False))
    candidate = F.coalesce(c("trigger"), F.lit(False)) & confirmed & ok(c("dry_up")) & (c("bar") >= 30)
    return df.withColumn("vdu_candidate", candidate)


def vcp(bars: DataFrame, window: int = 90, k: int = 3, least: int = 3, max_depth: float = 0.3, tolerance: float = 1.1) -> DataFrame:
    """Volatility contraction: ticker, date, bar, base_high, close_to_base, n_pullbacks, depths, contraction_ok,
    volume_fade, candidate; bars with under `window` bars of history are left out.

    Depths are taken below the highest high of the window without its last k bars; the last `least`
    pullbacks of at least 1 % must not deepen by more than the tolerance, the first of them not
    exceed max_depth, and mean volumes between them not grow by more than 5 %.
    """
    df = bars.withColumn("_cum", F.sum("volume").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    df = with_troughs(df, k, strict=True, carry=("_cum", "volume"))
    lows = F.collect_list("trough").over(by().rowsBetween(2 * k + 1 - window, 0))
    df = df.withColumns({"_lows": lows, "base_high": F.max("high").over(by().rowsBetween(1 - window, -k))}).where(F.col("bar") >= window)
    deep = F.transform("_lows", lambda p: F.struct(p["bar"].alias("bar"), ((F.col("base_high") - p["low"]) / F.col("base_high")).alias("d"), (p["_cum"] - p["volume"]).alias("before")))
    df = df.withColumn("_deep", F.filter(deep, lambda p: p["d"] >= 0.01)).withColumn("n_pullbacks", F.size("_deep"))
    last = F.when(F.col("n_pullbacks") >= least, F.slice("_deep", -least, least))
    df = df.withColumn("_last", last)
    end = F.struct((F.col("bar") + 1).cast("int").alias("bar"), F.lit(0.0).alias("d"), F.col("_cum").alias("before"))
    df = df.withColumn("_ends", F.concat(F.slice("_last", 2, least - 1), F.array(end)))
    df = df.withColumn("_vols", F.zip_with("_last", "_ends", lambda a, b: (b["before"] - a["before"]) / (b["bar"] - a["bar"])))
    steps = F.sequence(F.lit(2), F.lit(least))
    contract = F.forall(steps, lambda i: F.element_at("_last", i.cast("int"))["d"] <= F.element_at("_last", (i - 1).cast("int"))["d"] * tolerance)
    fade = F.forall(steps, lambda i: F.element_at("_vols", i.cast("int")) <= F.element_at("_vols", (i - 1).cast("int")) * 1.05)
    measured = F.col("_last").isNotNull()
    df = df.withColumns({"contraction_ok": F.when(measured, contract), "volume_fade": F.when(measured, fade), "close_to_base": (F.col("base_high") - F.col("close")) / F.col("base_high")})
    good = F.col("contraction_ok") & (F.element_at("_last", 1)["d"] <= max_depth) & ok(F.col("volume_fade"))
    depths = F.transform("_last", lambda p: F.round(p["d"], 4))
    return df.select("ticker", "date", "bar", "base_high", "close_to_base", "n_pullbacks", depths.alias("depths"), "contraction_ok", "volume_fade", F.coalesce(good, F.lit(False)).alias("candidate"))


def support(df: DataFrame, sma_n: int = 200, base_n: int = 150) -> DataFrame:
    """Add support_verdict, base_low, base_high and distances; wants atr. Unknown before 205 bars."""
    df = df.withColumns({"sma200": sma("close", sma_n), "base_low": F.min("low").over(trail(base_n)), "base_high": F.max("high").over(trail(base_n))})
    c = F.col
    gap, near = c("close") - c("base_low"), F.abs(c("close") - c("sma200"))
    has = c("atr") > 0
    verdict = (
        F.when(c("bar") < max(sma_n, base_n) + 5, "unknown")
        .when(has & (gap <= 1.5 * c("atr")), "multi-month-base-support")
        .when((has & (near <= c("atr"))) | (near / c("sma200") <= 0.03), "200-day-sma-support")
        .when(gap / c("close") < 0.15, "holding-above-base")
        .otherwise("no-near-support")
    )
    return df.withColumns({"support_verdict": verdict, "distance_to_base": gap / c("close"), "distance_to_sma200": (c("close") - c("sma200")) / c("sma200")})


def swing_report(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Swing candidates on bars with at least 200 bars of history: trend stack, RSI band, pullback, stop, targets.

    With a benchmark, relative strength must be leading or rising; unknown strength passes.
    """
    strong = F.lit(True)
    if benchmark is not None:
        from .relative_strength import with_verdict

        bars = with_verdict(bars, benchmark)
        strong = F.coalesce(F.col("rs_verdict").isin("leading", "uptrend"), F.lit(True))
    df = with_pullback(with_trend(ind.with_steps(bars).withColumn("rsi", ind.rsi())).withColumn("atr", ind.atr()))
    df = df.withColumn("rsi_label", rsi_band(F.col("rsi"))).withColumns(swing_stop())
    t1, t2 = targets(F.col("close"), F.col("stop"))
    df = df.withColumns({"t1": t1, "t2": t2, "trail_exit": F.col("close") < F.col("ema20")}).where("bar >= 200")
    candidate = F.coalesce(F.col("stacked"), F.lit(False)) & F.col("rsi_label").isin("strong", "reset") & F.col("pullback") & strong
    return df.withColumn("candidate", candidate)


def value_dip(df: DataFrame) -> DataFrame:
    """The dip allocation matrix on every bar. df: bars joined with margin_of_safety, fcf_yield, roe, fcf,
    debt_to_equity, current_ratio (nulls where not measured; unmeasured gates pass)."""
    df = ind.with_steps(df).withColumns({"rsi": ind.rsi(), "atr": ind.atr(), "pct_b": ind.bollinger()["pct_b"]})
    c, no = F.col, F.lit(False)
    stop_pct = F.when(c("atr") > 0, 2.0 * c("atr") / c("close"))
    sheet = F.when(c("debt_to_equity").isNotNull() | c("current_ratio").isNotNull(), F.coalesce(c("debt_to_equity") < 1, no) | F.coalesce(c("current_ratio") > 1.5, no))
    cash = F.coalesce(c("fcf") > 0, c("fcf_yield") > 0)
    profit = F.when(cash.isNotNull() | c("roe").isNotNull(), ok(cash) & ok(c("roe") > 0.15))
    df = df.withColumns({
        "stop_pct": stop_pct, "value_floor": F.coalesce(c("margin_of_safety") >= 0.2, no) | F.coalesce(c("fcf_yield") >= 0.06, no),
        "technical_entry": F.coalesce((c("rsi") <= 35) & (c("pct_b") <= 0.1), no), "trade_risk": F.coalesce(stop_pct <= 0.02, no), "sheet_ok": sheet, "profit_ok": profit,
    }).where("bar >= 20")
    return df.withColumn("candidate", c("value_floor") & c("technical_entry") & c("trade_risk") & ok(c("sheet_ok")) & ok(c("profit_ok")))


def first_pullback(bars: DataFrame, window: int = 6) -> DataFrame:
    """Momentum pullback flags on every bar from bar window + 4 on.

    `candidate` follows the stated rule, which no bar can meet (a close above the recent high leaves a
    reward below the risk); `candidate_corrected` takes the move's size above the close as reward.
    """
    c = F.col
    df = ema(bars, "close", 9, "ema9")
    run = by().rowsBetween(Window.unboundedPreceding, 0)
    high, low = F.max("high").over(prior(window)), F.min("low").over(prior(window))
    df = df.withColumns({
        "vwap_all": F.try_divide(F.sum(c("close") * c("volume")).over(run), F.sum("volume").over(run)),
        "surge": c("close") / F.lag("close", window - 1).over(by()) - 1 >= 0.03, "recent_high": high, "low_start": low, "pull_low": F.min("low").over(trail(window)),
    })
    red, green = F.when(c("close") < c("open"), c("volume")), F.when(c("close") >= c("open"), c("volume"))
    colour = F.when((F.count(red).over(trail(window)) >= 2) & (F.count(green).over(trail(window)) >= 2), F.avg(red).over(trail(window)) < F.avg(green).over(trail(window)))
    body = F.abs(c("close") - c("open"))
    tail = F.max(F.when(body > 1e-9, (c("high") - F.greatest("close", "open")) / body)).over(trail(window)) < 1.5
    df = df.withColumns({"volume_ok": colour, "tail_ok": tail}).where(c("bar") >= window + 4)
    risk = F.when(c("close") > c("pull_low"), c("close") - c("pull_low"))
    df = df.withColumns({
        "retrace_ok": (c("recent_high") - c("pull_low")) / F.greatest(c("recent_high") - c("low_start"), F.lit(1e-9)) <= 0.5,
        "holds_9ema": c("close") > c("ema9"), "holds_vwap": F.coalesce(c("close") > c("vwap_all"), F.lit(False)), "trigger": c("close") > c("recent_high"),
        "rr": (c("recent_high") - c("pull_low")) / risk, "rr_move": (c("recent_high") - c("low_start")) / risk,
    })
    flags = c("surge") & c("retrace_ok") & c("holds_9ema") & c("holds_vwap") & c("trigger") & ok(c("volume_ok")) & ok(c("tail_ok"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    return df.withColumns({"candidate": yes(flags & (c("rr") >= 2)), "candidate_corrected": yes(flags & (c("rr_move") >= 1))})


def pillars(close: Column, day_volume: Column, prev_close: Column, day_open: Column, rv: Column, float_shares: Column, low: float = 2.0, high: float = 20.0) -> dict[str, Column]:
    """Five flags, each null where its input is."""
    return {
        "p_rvol": rv >= 2,
        "p_high_volume": day_volume >= 1_000_000,
        "p_gap": F.when(prev_close > 0, day_open / prev_close - 1) >= 0.02,
        "p_price_band": close.between(low, high),
        "p_float": float_shares <= 20_000_000,
    }


def session_flags(peak: Column, current: Column, max_loss: float = 0.03) -> dict[str, Column]:
    give = F.when(peak > 0, (peak - current) / peak >= 0.5)
    loss = current <= -max_loss
    return {"giveback_50": give, "max_daily_loss_hit": loss, "walk_away": F.coalesce(give, F.lit(False)) | F.coalesce(loss, F.lit(False))}


def psych_level(price: Column, step: float = 0.5) -> dict[str, Column]:
    """The multiples of step around a price, and the distance up in percent."""
    up, down = F.ceil(price / step) * step, F.floor(price / step) * step
    good = price > 0
    return {"psych_above": F.when(good, up), "psych_below": F.when(good, down), "psych_dist_pct": F.when(good, (up - price) / price * 100)}


def past_optimal_window(ts: Column, hour: int = 10, minute: int = 0, zone: str = "America/New_York") -> Column:
    """Whether a UTC time is at or past a time of day in the exchange's zone."""
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute


def session_vwap(intraday: DataFrame) -> DataFrame:
    """ticker, session, session_vwap, last_close, holds_session_vwap over bars (ticker, ts, o, h, l, c, v, vw)."""
    price = F.coalesce("vw", (F.col("h") + F.col("l") + F.col("c")) / 3)
    out = intraday.groupBy("ticker", F.to_date("ts").alias("session")).agg(F.try_divide(F.sum(price * F.col("v")), F.sum("v")).alias("session_vwap"), F.max_by("c", "ts").alias("last_close"), F.count("*").alias("n_bars"))
    return out.withColumn("holds_session_vwap", F.col("last_close") > F.col("session_vwap"))
