"""Queries on chart setups, relative strength and regimes: flags on every bar, not only the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import indicators as ind
from ..operators import relative_strength as rs
from ..operators import setups, windows
from ..sources import warehouse as wh
from . import sql as S
from .prices import MACD
from .registry import query, r, rounded

_SCAN = f"""s AS (SELECT *, {S.sma("close", 20)} AS sma20, {S.sma("close", 50)} AS sma50, {S.sma("close", 200)} AS sma200, {S.rsi()} AS rsi, close / max(close) OVER {S.over(252)} - 1 AS hi52_dist,
  CASE WHEN bar >= 64 THEN close / lag(close, 63) OVER ({S.W}) - 1 END AS qret, volume / nullif(avg(volume) OVER {S.over(20)}, 0) AS rvol,
  CASE WHEN bar >= 20 THEN 4 * stddev_pop(close) OVER {S.over(20)} / avg(close) OVER {S.over(20)} END AS width FROM e1),
q AS (SELECT *, bar >= 40 AND width <= min(width) OVER {S.over(21)} * (1 + 1e-12) AS squeeze FROM s)"""


@query(
    S.with_(
        S.STEPS,
        S.ema("steps", "e1", "close", 20, "ema20"),
        _SCAN,
        """SELECT ticker, date, close, coalesce(close > sma50 AND sma50 > sma200 AND low <= ema20 AND close >= ema20 AND rsi BETWEEN 40 AND 55 AND qret >= 0.10e0, false) AS a,
        coalesce(hi52_dist >= -0.10e0 AND close > sma20 AND close > sma50 AND (rvol > 1.5e0 OR (rvol < 0.75e0 AND squeeze)), false) AS b, rsi, round(qret, 6) + 0e0 AS qret, round(rvol, 6) AS rvol, squeeze, round(hi52_dist, 6) + 0e0 AS hi52_dist
        FROM q WHERE bar >= 200""",
    )
)
def scan_trend_pullback_breakout(spark, sf):
    return rounded(setups.scan_signals(wh.bars(spark, sf)), "qret", "rvol", "hi52_dist", digits=6)


_TREND = f"""t1 AS (SELECT *, {S.sma("close", 50)} AS sma50, {S.sma("close", 200)} AS sma200, {S.rsi()} AS rsi, CASE WHEN bar >= 2 THEN avg(true_range) OVER {S.over(14)} END AS atr FROM e1),
t2 AS (SELECT *, close > sma50 AS above_sma50, close > sma200 AS above_sma200, sma50 > lag(sma50, 5) OVER ({S.W}) AS sma50_rising, sma200 > lag(sma200, 15) OVER ({S.W}) AS sma200_rising, ema20 > sma50 AS ema20_above_sma50,
  low <= ema20 AND close >= ema20 AS near_ema, CASE WHEN bar >= 12 THEN avg(volume) OVER {S.over(6)} <= avg(volume) OVER {S.between(11, 6)} END AS volume_fade,
  coalesce(ema20 > lag(sma50, 6) OVER ({S.W}), false) AS up, CASE WHEN bar >= 10 AND atr > 0 THEN min(low) OVER {S.over(10)} END AS swing_low FROM t1),
t3 AS (SELECT *, CASE WHEN sma200 IS NOT NULL THEN coalesce(ema20_above_sma50 AND sma50 > sma200 AND sma50_rising AND sma200_rising, false) END AS stacked,
  coalesce(near_ema AND coalesce(volume_fade, true) AND up, false) AS pullback, swing_low - atr AS stop,
  CASE WHEN rsi IS NULL THEN 'unknown' WHEN rsi < 40 THEN 'broken' WHEN rsi > 70 THEN 'hot' WHEN rsi >= 45 THEN 'strong' ELSE 'reset' END AS rsi_label FROM t2)"""


@query(S.with_(S.STEPS, S.ema("steps", "e1", "close", 20, "ema20"), _TREND, "SELECT ticker, date, above_sma50, above_sma200, sma50_rising, sma200_rising, ema20_above_sma50, stacked FROM t3"))
def trend_stack(spark, sf):
    return setups.with_trend(wh.bars(spark, sf)).select("ticker", "date", "above_sma50", "above_sma200", "sma50_rising", "sma200_rising", "ema20_above_sma50", "stacked")


_RS = f"""r0 AS (SELECT b.ticker, b.date, b.close, b.close / k.close AS rs FROM bars b JOIN bench k ON b.date = k.date),
r1 AS (SELECT *, CAST(row_number() OVER ({S.W}) AS INT) AS bar FROM r0),
r2 AS (SELECT *, avg(rs) OVER {S.over(63)} AS m, regr_slope(rs, bar) OVER {S.over(63)} AS sl, max(rs) OVER {S.between(252, 1)} AS top, max(close) OVER {S.between(252, 1)} AS ptop FROM r1),
r3 AS (SELECT *, CASE WHEN bar >= 63 THEN sl / abs(m) * 100 END AS rs_slope_pct, CASE WHEN bar >= 63 THEN coalesce(sl / abs(m) > 0 AND rs >= m, false) END AS rs_uptrend, rs >= 0.97e0 * top AS rs_near_high, rs > top AS rs_new_high,
  coalesce(close > ptop AND NOT (rs >= 0.97e0 * top), false) AS rs_divergence FROM r2),
r4 AS (SELECT *, CASE WHEN bar < 2 THEN 'unknown' WHEN rs_divergence THEN 'diverging' WHEN coalesce(rs_uptrend, false) AND rs_near_high THEN 'leading' WHEN coalesce(rs_uptrend, false) THEN 'uptrend' ELSE 'lagging' END AS rs_verdict FROM r3)"""
_RS_COLUMNS = ("rs_uptrend", "rs_new_high", "rs_near_high", "rs_divergence", "rs_verdict")


@query(S.with_(S.BARS, S.BENCH, _RS, f"SELECT ticker, date, round(rs, 6) AS rs, round(rs_slope_pct, 6) + 0e0 AS rs_slope_pct, {', '.join(_RS_COLUMNS)} FROM r4"))
def rs_report(spark, sf):
    df = rs.report(wh.bars(spark, sf), wh.benchmark(spark, sf))
    return rounded(df.select("ticker", "date", "rs", "rs_slope_pct", *_RS_COLUMNS), "rs", "rs_slope_pct", digits=6)


@query(S.with_(S.BARS, S.BENCH, "SELECT b.ticker, b.date, round(b.close / k.close, 6) AS rs FROM bars b JOIN bench k ON b.date = k.date"))
def rs_date_join(spark, sf):
    return rounded(rs.by_date(wh.bars(spark, sf), wh.benchmark(spark, sf)).select("ticker", "date", "rs"), "rs", digits=6)


@query(
    S.with_(
        S.BARS,
        S.BENCH,
        "b AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars)",
        "k AS (SELECT close, row_number() OVER (ORDER BY date DESC) AS n FROM bench)",
        "SELECT ticker, date, round(b.close / k.close, 6) AS rs FROM b JOIN k ON b.n = k.n",
    )
)
def rs_tail_join(spark, sf):
    return rounded(rs.by_tail(wh.bars(spark, sf), wh.benchmark(spark, sf)).select("ticker", "date", "rs"), "rs", digits=6)


@query(
    S.with_(
        S.STEPS,
        S.BENCH,
        S.ema("steps", "e1", "close", 20, "ema20"),
        _TREND,
        _RS,
        """SELECT t3.ticker, t3.date, stacked, rsi_label, pullback, round(swing_low, 4) AS swing_low, round(stop, 6) AS stop, round(CASE WHEN t3.close > stop THEN t3.close + 2 * (t3.close - stop) END, 6) AS t1, t3.close < ema20 AS trail_exit, rs_verdict,
        coalesce(stacked, false) AND rsi_label IN ('strong', 'reset') AND pullback AND coalesce(rs_verdict IN ('leading', 'uptrend'), true) AS candidate
        FROM t3 LEFT JOIN r4 ON t3.ticker = r4.ticker AND t3.date = r4.date WHERE t3.bar >= 200""",
    )
)
def swing_report(spark, sf):
    df = setups.swing_report(wh.bars(spark, sf), wh.benchmark(spark, sf))
    return df.select("ticker", "date", "stacked", "rsi_label", "pullback", r("swing_low", 4).alias("swing_low"), r("stop", 6).alias("stop"), r("t1", 6).alias("t1"), "trail_exit", "rs_verdict", "candidate")


def _troughs(strict: bool, extra: str = "", source: str = "bars") -> str:
    right = "<" if strict else "<="
    return f"""p AS MATERIALIZED (SELECT ticker, bar, low{extra} FROM (SELECT *, min(low) OVER ({S.W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lo, min(low) OVER {S.ahead(1, 3)} AS hi, count(*) OVER {S.ahead(1, 3)} AS n FROM {source})
WHERE bar > 3 AND n = 3 AND low < lo AND low {right} hi)"""


@query(S.with_(S.BARS, _troughs(True), "SELECT * FROM p"))
def pivots(spark, sf):
    return setups.with_troughs(wh.bars(spark, sf)).where("trough is not null").select("ticker", "trough.bar", "trough.low")


def _last_two(window: int, alias: str, base: str = "steps") -> str:
    """For each bar, its last two troughs inside the window, latest first: the last one by a frame of bars,
    the one before it by the troughs' own order."""
    return f"""{alias}_at AS MATERIALIZED (SELECT ticker, bar, max(pb) OVER (PARTITION BY ticker ORDER BY bar ROWS BETWEEN {window - 4} PRECEDING AND 3 PRECEDING) AS pb FROM (SELECT b.ticker, b.bar, p.bar AS pb FROM {base} b LEFT JOIN p ON p.ticker = b.ticker AND p.bar = b.bar)),
{alias}_pair AS MATERIALIZED (SELECT ticker, bar, one, lag(one) OVER (PARTITION BY ticker ORDER BY bar) AS two FROM (SELECT ticker, bar, p AS one FROM p)),
{alias} AS MATERIALIZED (SELECT a.ticker AS t, a.bar AS at, CASE WHEN two.bar >= greatest(a.bar - {window} + 1, 1) + 3 THEN [one, two] ELSE [one] END AS ps FROM {alias}_at a JOIN {alias}_pair q ON q.ticker = a.ticker AND q.bar = a.pb)"""


@query(
    S.with_(
        S.STEPS,
        _troughs(False),
        _last_two(60, "h"),
        "SELECT b.ticker, b.date, CASE WHEN len(ps) >= 2 THEN ps[1].low > ps[2].low END AS higher_low, CASE WHEN len(ps) >= 2 THEN ps[1].low END AS recent_low, CASE WHEN len(ps) >= 2 THEN ps[2].low END AS prior_low FROM bars b LEFT JOIN h ON h.t = b.ticker AND h.at = b.bar",
    )
)
def higher_low(spark, sf):
    return setups.higher_low(wh.bars(spark, sf)).select("ticker", "date", "higher_low", "recent_low", "prior_low")


_MOM = """mo AS (SELECT b.ticker, b.date, b.bar, CASE WHEN b.bar < 44 THEN 'unknown' WHEN ps IS NULL OR len(ps) < 2 OR ps[2].macd_hist IS NULL OR ps[1].macd_hist IS NULL THEN 'none'
  WHEN ps[1].low < ps[2].low THEN CASE WHEN ps[1].macd_hist > ps[2].macd_hist THEN 'bullish-divergence' ELSE 'lower-low-confirmation' END
  WHEN ps[1].low > ps[2].low THEN CASE WHEN ps[1].macd_hist > ps[2].macd_hist THEN 'higher-low' ELSE 'higher-low-weak-indicator' END ELSE 'none' END AS momentum_verdict
  FROM bars b LEFT JOIN h ON h.t = b.ticker AND h.at = b.bar)"""


@query(S.with_(S.STEPS, MACD, _troughs(False, ", macd_hist", "m5"), _last_two(120, "h"), _MOM, "SELECT ticker, date, momentum_verdict FROM mo"))
def macd_divergence(spark, sf):
    df = ind.with_rsi_series(ind.with_macd(ind.with_steps(wh.bars(spark, sf))))
    return setups.macd_divergence(df).select("ticker", "date", "momentum_verdict")


_DRY = f"""d1 AS (SELECT ticker, date, bar, close, volume, CASE WHEN bar >= 26 THEN avg(volume) OVER {S.between(5, 1)} / nullif(avg(volume) OVER {S.between(25, 21)}, 0) END AS vdu, CASE WHEN bar >= 26 THEN avg(volume) OVER {S.between(5, 1)} / nullif(avg(volume) OVER {S.between(25, 6)}, 0) END AS vdu_doc,
  CASE WHEN bar >= 22 THEN volume / nullif(avg(volume) OVER {S.between(20, 1)}, 0) END AS trv, close > lag(high) OVER ({S.W}) AS above FROM bars)"""


@query(S.with_(S.BARS, _DRY, "SELECT ticker, date, round(vdu, 6) AS vdu_ratio, vdu <= 0.7e0 AS dry_up, round(vdu_doc, 6) AS vdu_ratio_doc FROM d1"))
def volume_dry_up(spark, sf):
    bars = wh.bars(spark, sf)
    from ..operators.windows import full, prior

    recent = F.avg("volume").over(prior(5))
    return bars.withColumns(setups.volume_dry_up()).select("ticker", "date", F.round(full(26, F.try_divide(recent, F.avg("volume").over(prior(25, 21)))), 6).alias("vdu_ratio"), "dry_up", F.round(full(26, F.try_divide(recent, F.avg("volume").over(prior(25, 6)))), 6).alias("vdu_ratio_doc"))


@query(S.with_(S.BARS, _DRY, "SELECT ticker, date, CASE WHEN bar >= 22 THEN coalesce(trv >= 1.3e0 AND above, false) END AS trigger FROM d1"))
def trigger_candle(spark, sf):
    return wh.bars(spark, sf).withColumns(setups.trigger_candle()).select("ticker", "date", "trigger")


@query(
    S.with_(
        S.STEPS, MACD, _troughs(False, ", macd_hist", "m5"), _last_two(120, "h"), _MOM, _last_two(60, "h60"), _DRY,
        """SELECT d1.ticker, d1.date, d1.bar >= 30 AND coalesce(CASE WHEN d1.bar >= 22 THEN coalesce(trv >= 1.3e0 AND above, false) END, false)
        AND (momentum_verdict IN ('bullish-divergence', 'higher-low') OR coalesce(len(h60.ps) >= 2 AND h60.ps[1].low > h60.ps[2].low, false)) AND coalesce(vdu <= 0.7e0, true) AS vdu_candidate
        FROM d1 JOIN mo ON mo.ticker = d1.ticker AND mo.bar = d1.bar LEFT JOIN h60 ON h60.t = d1.ticker AND h60.at = d1.bar""",
    )
)
def vdu_entry(spark, sf):
    return setups.vdu_entry(wh.bars(spark, sf)).select("ticker", "date", "vdu_candidate")


@query(
    S.with_(
        S.BARS,
        _troughs(True),
        f"v0 AS (SELECT *, sum(volume) OVER ({S.W} ROWS UNBOUNDED PRECEDING) AS cum, max(high) OVER {S.between(89, 3)} AS base_high FROM bars)",
        "v1 AS (SELECT p.ticker, p.bar, p.low, v0.cum - v0.volume AS before FROM p JOIN v0 ON p.ticker = v0.ticker AND p.bar = v0.bar)",
        "v2 AS (SELECT v0.ticker, v0.date, v0.bar, v0.close, v0.base_high, v0.cum, list({'b': v1.bar, 'd': (v0.base_high - v1.low) / v0.base_high, 'v': v1.before} ORDER BY v1.bar) FILTER (v1.bar IS NOT NULL AND (v0.base_high - v1.low) / v0.base_high >= 0.01e0) AS ps FROM v0 LEFT JOIN v1 ON v1.ticker = v0.ticker AND v1.bar BETWEEN v0.bar - 86 AND v0.bar - 3 WHERE v0.bar >= 90 GROUP BY 1, 2, 3, 4, 5, 6)",
        "v3 AS (SELECT *, coalesce(len(ps), 0) AS n, ps[len(ps) - 2] AS a, ps[len(ps) - 1] AS b, ps[len(ps)] AS c FROM v2)",
        "v4 AS (SELECT *, CASE WHEN n >= 3 THEN b.d <= a.d * 1.1e0 AND c.d <= b.d * 1.1e0 END AS contraction_ok, CASE WHEN n >= 3 THEN (c.v - b.v) / (c.b - b.b) <= (b.v - a.v) / (b.b - a.b) * 1.05e0 AND (cum - c.v) / (bar + 1 - c.b) <= (c.v - b.v) / (c.b - b.b) * 1.05e0 END AS volume_fade FROM v3)",
        "SELECT ticker, date, bar, base_high, round((base_high - close) / base_high, 6) + 0e0 AS close_to_base, CAST(n AS INT) AS n_pullbacks, contraction_ok, volume_fade, coalesce(contraction_ok AND a.d <= 0.3e0 AND coalesce(volume_fade, true), false) AS candidate FROM v4",
    )
)
def vcp(spark, sf):
    return rounded(setups.vcp(wh.bars(spark, sf)).drop("depths"), "close_to_base", digits=6)


@query(
    S.with_(
        S.STEPS,
        f"u AS (SELECT *, avg(close) OVER {S.over(200)} AS sma200, min(low) OVER {S.over(150)} AS base_low, max(high) OVER {S.over(150)} AS base_high, avg(true_range) OVER {S.over(14)} AS atr FROM steps)",
        """SELECT ticker, date, base_low, base_high, round((close - base_low) / close, 6) AS distance_to_base, CASE WHEN bar < 205 THEN 'unknown' WHEN atr > 0 AND close - base_low <= 1.5e0 * atr THEN 'multi-month-base-support'
        WHEN (atr > 0 AND abs(close - sma200) <= atr) OR abs(close - sma200) / sma200 <= 0.03e0 THEN '200-day-sma-support' WHEN (close - base_low) / close < 0.15e0 THEN 'holding-above-base' ELSE 'no-near-support' END AS support_verdict FROM u""",
    )
)
def support_structure(spark, sf):
    df = setups.support(ind.with_steps(wh.bars(spark, sf)).withColumn("atr", ind.atr()))
    return df.select("ticker", "date", "base_low", "base_high", r("distance_to_base", 6).alias("distance_to_base"), "support_verdict")


_Y = "y AS (SELECT ticker, year, CASE WHEN year % 3 = 0 THEN NULL ELSE (cfo - abs(capex)) / market_cap END AS fcf_yield, net_income / total_equity AS roe, total_debt / total_equity AS de, CASE WHEN year % 2 = 0 THEN current_assets / current_liabilities END AS cr, cfo - abs(capex) AS fcf FROM fin)"


@query(
    S.with_(
        S.STEPS,
        S.FIN,
        _Y,
        f"g AS (SELECT *, {S.rsi()} AS rsi, avg(true_range) OVER {S.over(14)} AS atr, avg(close) OVER {S.over(20)} AS m, stddev_pop(close) OVER {S.over(20)} AS sd FROM steps)",
        """SELECT g.ticker, g.date, coalesce(fcf_yield >= 0.06e0, false) AS value_floor, coalesce(rsi <= 35 AND sd > 0 AND round((close - (m - 2 * sd)) / (4 * sd), 4) <= 0.1e0, false) AS technical_entry,
        coalesce(atr > 0 AND 2 * atr / close <= 0.02e0, false) AS trade_risk, CASE WHEN de IS NOT NULL OR cr IS NOT NULL THEN coalesce(de < 1, false) OR coalesce(cr > 1.5e0, false) END AS sheet_ok,
        CASE WHEN coalesce(fcf, fcf_yield) IS NOT NULL OR roe IS NOT NULL THEN coalesce(fcf > 0, fcf_yield > 0, true) AND coalesce(roe > 0.15e0, true) END AS profit_ok
        FROM g LEFT JOIN y ON y.ticker = g.ticker AND y.year = year(g.date) WHERE bar >= 20""",
    )
)
def value_dip_matrix(spark, sf):
    from ..operators import forensics as fx

    c = F.col
    fin = wh.fundamentals(spark, sf).select(
        "ticker", "year", F.when(c("year") % 3 != 0, fx.fcf_yield()).alias("fcf_yield"), (c("net_income") / c("total_equity")).alias("roe"), (c("total_debt") / c("total_equity")).alias("debt_to_equity"),
        F.when(c("year") % 2 == 0, c("current_assets") / c("current_liabilities")).alias("current_ratio"), fx.fcf().alias("fcf"), F.lit(None).cast("double").alias("margin_of_safety"),
    )
    df = wh.bars(spark, sf).withColumn("year", F.year("date")).join(fin, ["ticker", "year"], "left")
    return setups.value_dip(df).select("ticker", "date", "value_floor", "technical_entry", "trade_risk", "sheet_ok", "profit_ok")


@query(
    S.with_(
        S.STEPS,
        S.ema("steps", "e1", "close", 9, "ema9"),
        f"""k1 AS (SELECT *, close / lag(close, 5) OVER ({S.W}) - 1 AS mv, max(high) OVER {S.between(6, 1)} AS rh, min(low) OVER {S.between(6, 1)} AS ls, min(low) OVER {S.over(6)} AS pl,
        sum(close * volume) OVER ({S.W} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({S.W} ROWS UNBOUNDED PRECEDING) AS vw FROM e1)""",
        "SELECT ticker, date, mv >= 0.03e0 AS surge, (rh - pl) / greatest(rh - ls, 1e-9) <= 0.5e0 AS retrace_ok, close > ema9 AS holds_9ema, close > vw AS holds_vwap, close > rh AS trigger, round(CASE WHEN close > pl THEN (rh - pl) / (close - pl) END, 6) AS rr, false AS candidate FROM k1 WHERE bar >= 10",
    )
)
def first_pullback(spark, sf):
    df = setups.first_pullback(wh.bars(spark, sf))
    return df.select("ticker", "date", "surge", "retrace_ok", "holds_9ema", "holds_vwap", "trigger", r("rr", 6).alias("rr"), "candidate")


@query(
    S.with_(
        S.STEPS,
        f"g AS (SELECT *, volume / nullif(avg(volume) OVER {S.between(50, 1)}, 0) AS rv FROM steps)",
        "SELECT ticker, date, rv >= 2 AS p_rvol, volume * 50000 >= 1000000 AS p_high_volume, open / prev_close - 1 >= 0.002e0 AND NULL IS NULL AS p_gap, close BETWEEN 50 AND 100 AS p_price_band, ceil(close / 0.5e0) * 0.5e0 AS psych_above, round((ceil(close / 0.5e0) * 0.5e0 - close) / close * 100, 6) + 0e0 AS psych_dist_pct FROM g",
    ).replace("0.002e0 AND NULL IS NULL", "0.02e0")
)
def pillars(spark, sf):
    df = ind.with_steps(wh.bars(spark, sf)).withColumn("rv", ind.rvol())
    c = F.col
    df = df.withColumns(setups.pillars(c("close"), c("volume") * 50000, c("prev_close"), c("open"), c("rv"), F.lit(None).cast("double"), 50, 100)).withColumns(setups.psych_level(c("close")))
    return df.select("ticker", "date", "p_rvol", "p_high_volume", "p_gap", "p_price_band", "psych_above", r("psych_dist_pct", 6).alias("psych_dist_pct"))


_SECTOR_BARS = "sb AS (SELECT sector AS ticker, date, avg(close) AS close FROM bars JOIN sectors USING (ticker) GROUP BY 1, 2)"
_SECTOR_RANK = f"""s1 AS (SELECT ticker, date, round(close / lag(close, 21) OVER ({S.W}) - 1, 4) AS r1, round(close / lag(close, 63) OVER ({S.W}) - 1, 4) AS r3 FROM sb),
s2 AS (SELECT ticker AS sector, arg_max(r1, date) AS ret_1m, arg_max(r3, date) AS ret_3m FROM s1 GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY ret_3m DESC NULLS LAST, sector) AS n3, row_number() OVER (ORDER BY ret_1m DESC NULLS LAST, sector) AS n1 FROM s2),
ranking AS (SELECT sector, ret_1m, ret_3m, CASE WHEN ret_3m IS NOT NULL THEN CAST(n3 AS INT) END AS rank, n3 <= 3 AND ret_3m IS NOT NULL AS top3_3m, n1 <= 3 AND ret_1m IS NOT NULL AS top3_1m FROM rk)"""


def _sector_bars(spark, sf):
    joined = wh.bars(spark, sf).join(wh.sectors(spark, sf), "ticker")
    return joined.groupBy(F.col("sector").alias("ticker"), "date").agg(F.avg("close").alias("close"))


@query(S.with_(S.BARS, S.SECTORS, _SECTOR_BARS, _SECTOR_RANK, "SELECT * FROM ranking"))
def sector_rank(spark, sf):
    return rs.rank_sectors(_sector_bars(spark, sf))


@query(
    S.with_(
        S.BARS, S.SECTORS, _SECTOR_BARS, _SECTOR_RANK,
        "t AS (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN 'The ' || r_name || ' Fund' WHEN 1 THEN left(r_name, 4) WHEN 2 THEN r_name ELSE n_name END AS sector_text FROM nation JOIN region ON n_regionkey = r_regionkey)",
        "h AS (SELECT sector_text, arg_min(ranking, coalesce(rank, 2147483647)) AS hit FROM t JOIN ranking ON lower(sector) = lower(trim(sector_text)) OR contains(lower(sector), lower(trim(sector_text))) OR contains(lower(trim(sector_text)), lower(sector)) GROUP BY 1)",
        "SELECT t.sector_text, hit.sector AS sector, hit.rank AS rank, CASE WHEN hit IS NULL THEN 'unknown' WHEN hit.top3_3m THEN 'top3' ELSE 'tracking' END AS verdict FROM t LEFT JOIN h ON t.sector_text = h.sector_text",
    )
)
def sector_standing_fuzzy(spark, sf):
    nations = wh.table(spark, sf, "nation").join(wh.table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    text = F.expr("case n_nationkey % 4 when 0 then 'The ' || r_name || ' Fund' when 1 then left(r_name, 4) when 2 then r_name else n_name end")
    return rs.sector_standing(nations.select(text.alias("sector_text")).distinct(), rs.rank_sectors(_sector_bars(spark, sf)))


@query(
    S.with_(
        S.STEPS,
        S.decayed("steps", "v", "0.06 * log_return * log_return", 0.94, "var"),
        f"""o1 AS MATERIALIZED (SELECT *, sqrt(avg(log_return * log_return) OVER {S.over(21)}) AS now, CASE WHEN bar > 252 THEN sqrt(avg(log_return * log_return) OVER {S.over(252)}) END AS al, sum(close) OVER ({S.W} ROWS UNBOUNDED PRECEDING) AS cum,
        CASE WHEN bar >= 6 AND var > 0 THEN least(3, 0.15e0 / sqrt(var * 252)) ELSE 0 END AS vs FROM v)""",
        "o2 AS (SELECT a.*, CAST(least(200, floor(a.bar / 2)) AS INT) AS half FROM o1 a WHERE a.bar >= 60)",
        "o3 AS (SELECT o2.*, (o2.cum - p.cum) / half AS mean FROM o2 JOIN o1 p ON p.ticker = o2.ticker AND p.bar = o2.bar - half)",
        "o4 AS (SELECT *, CASE WHEN now > 0 AND al > 0 AND now > 1.5e0 * al THEN 0.9e0 WHEN al > 0 AND now < 0.5e0 * al THEN 0.1e0 ELSE 0.5e0 END AS vol_pct, (close - mean) / mean AS trend FROM o3)",
        "SELECT ticker, date, vol_pct, round(trend, 6) + 0e0 AS trend, CASE WHEN vol_pct >= 0.75e0 THEN 'high_vol' WHEN vol_pct <= 0.25e0 AND abs(trend) >= 0.02e0 THEN CASE WHEN trend > 0 THEN 'bull' ELSE 'bear' END ELSE 'neutral' END AS regime FROM o4",
    )
)
def regime_overlay(spark, sf):
    return ev.overlays(wh.bars(spark, sf)).select("ticker", "date", "vol_pct", r("trend", 6).alias("trend"), "regime")


@query()
def hmm_regime(spark, sf):
    """An iterative fit; tests compare it with planted two-state series."""
    return ev.two_state_regime(wh.returns(wh.bars(spark, sf)))


@query(
    S.with_(
        S.BARS,
        f"SELECT ticker, session, round(sum(vwap * volume) / sum(volume) + {S.OFF}, 6) AS session_vwap, arg_max(close, date) AS last_close, count(*) AS n_bars, arg_max(close, date) > sum(vwap * volume) / sum(volume) AS holds_session_vwap FROM (SELECT *, CAST(date_trunc('month', date) AS DATE) AS session FROM bars) GROUP BY 1, 2",
    )
)
def session_vwap(spark, sf):
    rows = wh.bars(spark, sf).select("ticker", F.trunc("date", "month").cast("timestamp").alias("ts"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), "date")
    out = rows.groupBy("ticker", F.to_date("ts").alias("session")).agg(F.max_by("c", "date").alias("last_close"))
    vw = setups.session_vwap(rows).select("ticker", "session", "session_vwap", "n_bars")
    return vw.join(out, ["ticker", "session"]).select("ticker", "session", F.round(F.col("session_vwap") + S.OFF, 6).alias("session_vwap"), "last_close", "n_bars", (F.col("last_close") > F.col("session_vwap")).alias("holds_session_vwap"))


@query(S.with_(S.STEPS, f"t AS (SELECT *, avg(true_range) OVER {S.over(14)} AS atr, lag(close, 5) OVER ({S.W}) AS entry FROM steps)", f"SELECT ticker, date, round(entry + atr + {S.OFF}, 6) AS be_stop, round(close + 4 * atr + {S.OFF}, 6) AS exit_target, CASE WHEN close >= close + 4 * atr THEN 'target' WHEN close < entry + atr THEN 'stop' ELSE 'hold' END AS exit_action FROM t WHERE bar >= 6"))
def exit_check(spark, sf):
    from ..operators import portfolio as pf

    df = ind.with_steps(wh.bars(spark, sf)).withColumns({"atr": ind.atr(), "entry": F.lag("close", 5).over(windows.by())}).where("bar >= 6")
    df = df.withColumns(pf.exit_check(F.col("entry"), F.col("close"), F.col("atr")))
    return df.select("ticker", "date", r(F.col("be_stop") + S.OFF, 6).alias("be_stop"), r(F.col("exit_target") + S.OFF, 6).alias("exit_target"), "exit_action")
