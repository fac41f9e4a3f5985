"""Queries on bars: cleaning, returns, indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, windows
from ..operators import indicators as ind
from ..sources import warehouse as wh
from . import sql as S
from .registry import query, r, rounded


@query(S.with_(S.BARS, "SELECT * FROM bars"))
def bars_daily(spark, sf):
    return wh.bars(spark, sf)


@query(S.with_(S.STEPS, "SELECT ticker, date, round(ret, 6) + 0e0 AS ret, round(log_return, 6) + 0e0 AS log_return, round(true_range, 8) AS true_range FROM steps"))
def returns_daily(spark, sf):
    return ind.with_steps(wh.bars(spark, sf)).select("ticker", "date", r("ret", 6).alias("ret"), r("log_return", 6).alias("log_return"), F.round("true_range", 8).alias("true_range"))


_HOLES = "CASE WHEN (bar + ticker) % 7 < 2 THEN NULL ELSE {0} END AS {0}"


@query(
    S.with_(
        S.BARS,
        f"holed AS (SELECT ticker, date, bar, {', '.join(_HOLES.format(c) for c in cleaning.PRICES)} FROM bars)",
        "SELECT ticker, date, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER ({S.W} ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({S.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in cleaning.PRICES) + " FROM holed",
    )
)
def clean_ffill_bfill(spark, sf):
    bars = wh.bars(spark, sf)
    holes = bars.withColumns({c: F.when((F.col("bar") + F.col("ticker")) % 7 >= 2, F.col(c)) for c in cleaning.PRICES})
    return cleaning.fill_gaps(holes).select("ticker", "date", *cleaning.PRICES)


@query(S.with_(S.BARS, "SELECT ticker, max(date) AS last_date, date_diff('day', max(date), DATE '2001-10-01') > 10 AS stale FROM bars WHERE date <= DATE '2001-10-01' GROUP BY ticker"))
def stale_guard(spark, sf):
    return cleaning.fresh_tickers(wh.bars(spark, sf), "2001-10-01")


@query(S.with_(S.BARS, "SELECT ticker, date, bar, " + ", ".join(f"{S.places(c, 2)} AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'"))
def bars_range(spark, sf):
    rows = wh.bars(spark, sf).where("date between date'1999-01-01' and date'1999-06-30'")
    return rows.select("ticker", "date", "bar", *(wh.places(F.col(c), 2).alias(c) for c in ("open", "high", "low", "close")), "volume")


@query(S.with_(S.BARS, f"SELECT ticker, date, {', '.join(f'round({S.sma("close", n)}, 8) AS sma{n}' for n in (20, 50, 200))} FROM bars"))
def sma_stack(spark, sf):
    return wh.bars(spark, sf).select("ticker", "date", *(F.round(windows.sma("close", n), 8).alias(f"sma{n}") for n in (20, 50, 200)))


@query(S.with_(S.STEPS, f"SELECT ticker, date, {S.rsi()} AS rsi FROM steps"))
def rsi_simple(spark, sf):
    return ind.with_steps(wh.bars(spark, sf)).select("ticker", "date", ind.rsi().alias("rsi"))


@query(S.with_(S.STEPS, f"SELECT ticker, date, round(CASE WHEN bar >= 2 THEN avg(true_range) OVER {S.over(14)} END, 8) AS atr FROM steps"))
def atr14(spark, sf):
    return ind.with_steps(wh.bars(spark, sf)).select("ticker", "date", F.round(ind.atr(), 8).alias("atr"))


_BB = f"avg(close) OVER {S.over(20)} AS m, stddev_pop(close) OVER {S.over(20)} AS s"


@query(S.with_(S.BARS, f"b AS (SELECT *, {_BB} FROM bars)", "SELECT ticker, date, CASE WHEN bar >= 20 THEN round(m, 8) END AS bb_mid, CASE WHEN bar >= 20 THEN round(m - 2 * s, 6) END AS bb_lower, CASE WHEN bar >= 20 THEN round(m + 2 * s, 6) END AS bb_upper, CASE WHEN bar >= 20 AND s > 0 THEN round((close - (m - 2 * s)) / (4 * s), 4) + 0e0 END AS pct_b FROM b"))
def bollinger_pctb(spark, sf):
    c = ind.bollinger()
    return wh.bars(spark, sf).select("ticker", "date", *(F.round(c[k], d).alias(k) for k, d in (("bb_mid", 8), ("bb_lower", 6), ("bb_upper", 6))), (c["pct_b"] + 0.0).alias("pct_b"))


@query(S.with_(S.BARS, f"SELECT ticker, date, round(volume / nullif(avg(volume) OVER {S.between(50, 1)}, 0), 8) AS rvol FROM bars"))
def rvol50(spark, sf):
    return wh.bars(spark, sf).select("ticker", "date", F.round(ind.rvol(), 8).alias("rvol"))


@query(S.with_(S.BARS, f"SELECT ticker, date, round(close / max(close) OVER {S.over(252)} - 1, 6) + 0e0 AS high_distance FROM bars"))
def high_distance(spark, sf):
    return wh.bars(spark, sf).select("ticker", "date", r(ind.high_distance(), 6).alias("high_distance"))


@query(
    S.with_(
        S.BARS,
        f"SELECT ticker, date, round(CASE WHEN bar > 273 THEN lag(close, 20) OVER ({S.W}) / lag(close, 272) OVER ({S.W}) - 1 END, 6) + 0e0 AS mom_12_1, round(CASE WHEN bar > 60 THEN close / lag(close, 59) OVER ({S.W}) - 1 END, 6) + 0e0 AS mom_60 FROM bars",
    )
)
def momentum_12_1(spark, sf):
    return wh.bars(spark, sf).select("ticker", "date", r(ind.momentum(), 6).alias("mom_12_1"), r(ind.momentum(60, 0), 6).alias("mom_60"))


@query(S.with_(S.STEPS, f"SELECT ticker, date, round(CASE WHEN bar >= 3 THEN stddev_samp(log_return) OVER {S.over(20)} * sqrt(252) ELSE 0 END, 6) AS realized_vol, round(CASE WHEN bar >= 4 THEN stddev_pop(log_return) OVER {S.over(14)} ELSE 0.5e0 END, 6) AS choppiness, round((close - avg(close) OVER {S.over(200)}) / avg(close) OVER {S.over(200)}, 6) + 0e0 AS trend_strength FROM steps"))
def realized_vol21(spark, sf):
    df = ind.with_steps(wh.bars(spark, sf))
    return df.select("ticker", "date", F.round(ind.realized_vol(), 6).alias("realized_vol"), F.round(ind.choppiness(flat=0.0), 6).alias("choppiness"), r(ind.trend_strength(), 6).alias("trend_strength"))


@query(
    S.with_(
        S.STEPS,
        "w AS (SELECT ticker, CAST(floor((bar - 1) / 21) AS BIGINT) AS win, bar, log_return FROM steps)",
        'v AS (SELECT ticker, win AS "window", CASE WHEN count(x) >= 2 THEN stddev_samp(x) * sqrt(252) ELSE 0 END AS vol FROM (SELECT *, CASE WHEN bar > win * 21 + 1 THEN log_return END AS x FROM w) GROUP BY 1, 2)',
        'l AS (SELECT ticker, arg_max(vol, "window") AS last FROM v GROUP BY 1)',
        'SELECT v.ticker, any_value(l.last) IS NOT NULL AS measured, round(sum(CASE WHEN vol <= last THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS share, count(*) AS windows FROM v JOIN l ON v.ticker = l.ticker GROUP BY 1',
    )
)
def vol_percentile(spark, sf):
    runs = ind.with_vol_percentile(ind.with_steps(wh.bars(spark, sf)))
    return runs.groupBy("ticker").agg(F.lit(True).alias("measured"), F.round(F.max("share"), 6).alias("share"), F.count("*").alias("windows"))


_WIDTH = f"w AS (SELECT *, CASE WHEN bar >= 20 THEN 4 * stddev_pop(close) OVER {S.over(20)} / avg(close) OVER {S.over(20)} END AS width FROM bars)"


@query(S.with_(S.BARS, _WIDTH, f"SELECT ticker, date, round(width, 6) AS width, bar >= 40 AND width <= min(width) OVER {S.over(21)} * (1 + 1e-12) AS squeeze FROM w"))
def squeeze(spark, sf):
    df = ind.with_squeeze(wh.bars(spark, sf))
    width = 4 * F.stddev_pop("close").over(windows.trail(20)) / F.avg("close").over(windows.trail(20))
    return df.select("ticker", "date", F.round(windows.full(20, width), 6).alias("width"), "squeeze")


@query(S.with_(S.BARS, S.ema("bars", "e1", "close", 20, "ema20"), S.ema("e1", "e2", "close", 9, "ema9"), "SELECT ticker, date, round(ema20, 6) AS ema20, round(ema9, 6) AS ema9 FROM e2"))
def ema20(spark, sf):
    df = windows.ema(windows.ema(wh.bars(spark, sf), "close", 20, "ema20"), "close", 9, "ema9")
    return rounded(df.select("ticker", "date", "ema20", "ema9"), "ema20", "ema9", digits=6)


MACD = ",\n".join([S.ema("steps", "m1", "close", 12, "fast"), S.ema("m1", "m2", "close", 26, "slow"), "m3 AS (SELECT *, fast - slow AS macd FROM m2)", S.ema("m3", "m4", "macd", 9, "macd_signal", first=26), "m5 AS (SELECT *, macd - macd_signal AS macd_hist FROM m4)"])


@query(S.with_(S.STEPS, MACD, "SELECT ticker, date, round(macd, 6) + 0e0 AS macd, round(macd_signal, 6) + 0e0 AS macd_signal, round(macd_hist, 6) + 0e0 AS macd_hist FROM m5"))
def macd_hist(spark, sf):
    df = ind.with_macd(ind.with_steps(wh.bars(spark, sf)))
    return rounded(df.select("ticker", "date", "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist", digits=6)


@query(S.with_(S.STEPS, S.decayed("steps", "v", "0.06 * log_return * log_return", 0.94, "var"), "SELECT ticker, date, round(CASE WHEN bar >= 6 AND var > 0 THEN least(3, 0.15e0 / sqrt(var * 252)) ELSE 0 END, 6) AS vol_scale FROM v"))
def ewma_vol_scale(spark, sf):
    return rounded(ind.with_vol_scale(ind.with_steps(wh.bars(spark, sf))).select("ticker", "date", "vol_scale"), "vol_scale", digits=6)


def _rsi_series_sql(wilder: bool, target: str) -> str:
    part = lambda sign, name, source: S.decayed(f"(SELECT *, sum(greatest({sign}change, 0)) OVER {S.over(14)} AS s_{name} FROM {source})", f"t_{name}", f"CASE WHEN bar > 15 THEN greatest({sign}change, 0) / 14 WHEN bar = 15 THEN s_{name}{' / 14' if wilder else ''} END", 1 - 1 / 14, name)
    return part("", f"{target}_up", "steps" if not wilder else "t_ref_down") + ",\n" + part("-", f"{target}_down", f"t_{target}_up")


_STRENGTH = "round(CASE WHEN bar < 15 THEN NULL WHEN {0}_up + {0}_down = 0 THEN 50 WHEN {0}_down > 0 THEN 100 - 100 / (1 + {0}_up / {0}_down) ELSE 100 END, 6) AS {1}"


@query(S.with_(S.STEPS, _rsi_series_sql(False, "ref"), _rsi_series_sql(True, "wil"), f"SELECT ticker, date, {_STRENGTH.format('ref', 'rsi_series')}, {_STRENGTH.format('wil', 'rsi_wilder')} FROM t_wil_down"))
def rsi_series_ref(spark, sf):
    df = ind.with_rsi_series(ind.with_steps(wh.bars(spark, sf)))
    return rounded(ind.with_rsi_series(df, wilder=True, name="rsi_wilder").select("ticker", "date", "rsi_series", "rsi_wilder"), "rsi_series", "rsi_wilder", digits=6)


def _ewm(source: str, c: str, q: float, name: str, at: str) -> str:
    top = S.decayed(source, f"{at}_a", c, q, f"{name}_t")
    low = S.decayed(f"{at}_a", f"{at}_b", f"CASE WHEN {c} IS NOT NULL THEN 1 END", q, f"{name}_w")
    return top + ",\n" + low + f",\n{at} AS (SELECT *, {name}_t / nullif({name}_w, 0) AS {name} FROM {at}_b)"


_SET = ",\n".join([
    "i0 AS (SELECT *, greatest(change, 0) AS u, greatest(-change, 0) AS dn, coalesce(true_range, high - low) AS tr, (high + low + close) / 3 AS tp FROM steps)",
    "i1 AS (SELECT * REPLACE (CASE WHEN change IS NULL THEN 0 ELSE u END AS u, CASE WHEN change IS NULL THEN 0 ELSE dn END AS dn), tp - lag(tp) OVER (PARTITION BY ticker ORDER BY date) AS mv FROM i0)",
    _ewm("i1", "close", 1 - 2 / 11, "close_10_ema", "i2"), _ewm("i2", "close", 1 - 2 / 13, "ef", "i3"), _ewm("i3", "close", 1 - 2 / 27, "es", "i4"),
    "i5 AS (SELECT *, ef - es AS macd FROM i4)", _ewm("i5", "macd", 1 - 2 / 10, "macds", "i6"), _ewm("i6", "u", 13 / 14, "g", "i7"), _ewm("i7", "dn", 13 / 14, "l", "i8"), _ewm("i8", "tr", 13 / 14, "atr", "i9"),
])


@query(
    S.with_(
        S.STEPS,
        _SET,
        f"""SELECT ticker, date, round({S.sma("close", 50)}, 8) AS close_50_sma, round({S.sma("close", 200)}, 8) AS close_200_sma, round(close_10_ema, 6) AS close_10_ema, round(macd, 6) + 0e0 AS macd, round(macds, 6) + 0e0 AS macds,
        round(macd - macds, 6) + 0e0 AS macdh, round(CASE WHEN bar < 2 THEN NULL WHEN g + l = 0 THEN 50 WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END, 6) AS rsi, round({S.sma("close", 20)}, 8) AS boll,
        round({S.sma("close", 20)} + 2 * stddev_samp(close) OVER {S.over(20)}, 6) AS boll_ub, round({S.sma("close", 20)} - 2 * stddev_samp(close) OVER {S.over(20)}, 6) AS boll_lb, round(atr, 6) AS atr,
        round(sum(tp * volume) OVER {S.over(14)} / sum(volume) OVER {S.over(14)} + {S.OFF}, 6) AS vwma,
        round(CASE WHEN bar >= 15 THEN sum(CASE WHEN mv > 0 THEN tp * volume ELSE 0 END) OVER {S.over(14)} / nullif(sum(CASE WHEN mv > 0 THEN tp * volume ELSE 0 END) OVER {S.over(14)} + sum(CASE WHEN mv < 0 THEN tp * volume ELSE 0 END) OVER {S.over(14)}, 0) * 100 END, 6) AS mfi FROM i9""",
    )
)
def indicator_set(spark, sf):
    plain = ("close_50_sma", "close_200_sma", "boll")
    df = ind.with_indicator_set(wh.bars(spark, sf)).drop("bar", "close").withColumn("vwma", F.col("vwma") + S.OFF)
    return rounded(rounded(df, *plain), *(c for c in ind.INDICATORS if c not in plain), digits=6)


@query(
    S.with_(
        S.STEPS,
        f"v AS (SELECT ticker, date, {S.rsi()} AS rsi, round({S.sma('close', 50)}, 8) AS sma50 FROM steps)",
        "spine AS (SELECT ticker, CAST(d AS DATE) AS date FROM (SELECT DISTINCT ticker FROM bars), generate_series(DATE '2000-06-30' - INTERVAL 30 DAY, TIMESTAMP '2000-06-30', INTERVAL 1 DAY) g(d))",
        "SELECT spine.ticker, spine.date, rsi, sma50 FROM spine LEFT JOIN v ON spine.ticker = v.ticker AND spine.date = v.date",
    )
)
def indicator_calendar_spine(spark, sf):
    df = ind.with_steps(wh.bars(spark, sf)).select("ticker", "date", ind.rsi().alias("rsi"), F.round(windows.sma("close", 50), 8).alias("sma50"))
    return ind.calendar_spine(df, "2000-06-30", 30)


@query(
    S.with_(
        S.STEPS,
        f"v AS (SELECT ticker, date, close, {S.rsi()} AS rsi, round({S.sma('close', 50)}, 8) AS sma50, round(CASE WHEN bar >= 2 THEN avg(true_range) OVER {S.over(14)} END, 8) AS atr, list(close) OVER {S.over(30)} AS last_closes FROM steps WHERE date <= DATE '2001-01-31')",
        "SELECT ticker, max(date) AS date, arg_max(close, date) AS close, arg_max(rsi, date) AS rsi, arg_max(sma50, date) AS sma50, arg_max(atr, date) AS atr, CAST(len(arg_max(last_closes, date)) AS INT) AS n_closes, round(list_sum(arg_max(last_closes, date)), 8) AS sum_closes FROM v GROUP BY ticker",
    )
)
def verified_snapshot(spark, sf):
    df = cleaning.as_of(wh.bars(spark, sf), "2001-01-31", years=100)
    df = ind.with_steps(df).select("ticker", "date", "close", ind.rsi().alias("rsi"), F.round(windows.sma("close", 50), 8).alias("sma50"), F.round(ind.atr(), 8).alias("atr"), F.collect_list("close").over(windows.trail(30)).alias("last_closes"))
    return windows.latest(df).select("ticker", "date", "close", "rsi", "sma50", "atr", F.size("last_closes").alias("n_closes"), F.round(F.aggregate("last_closes", F.lit(0.0), lambda a, x: a + x), 8).alias("sum_closes"))
