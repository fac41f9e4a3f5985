"""Queries on files as vendors send them: written from the tables, read back by the readers; and tool scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import forensics as fx
from ..operators import indicators as ind
from ..operators import markets as mk
from ..operators import setups
from ..sources import files
from ..sources import warehouse as wh
from . import sql as S
from .registry import query, r


def _path(spark, name: str) -> str:
    return f"{wh.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(S.with_(S.BARS, "SELECT 'T' || ticker AS ticker, date, open, high, low, close, volume FROM bars"))
def flat_bars(spark, sf):
    """Two bulk files hold each ticker, one of them only its later bars: the longer history is read."""
    path = _path(spark, "flat")  # each task writes its tickers: bars come by ticker, so that a ticker is whole in a file
    c = F.col
    start = (F.unix_micros(c("date").cast("timestamp")) + 5 * 3600 * 1_000_000) * 1000
    bars = wh.bars(spark, sf)
    rows = bars.select(F.concat(F.lit("t"), "ticker").alias("ticker"), "volume", "open", "close", "high", "low", start.alias("window_start"), F.lit(1).alias("transactions"), "bar")
    rows.drop("bar").write.option("header", True).csv(f"{path}/a")
    rows.where("bar > 100").drop("bar").write.option("header", True).csv(f"{path}/b")
    return files.longest_history(files.flat_bars(spark, f"{path}/*")).select("ticker", F.to_date("date").alias("date"), "open", "high", "low", "close", "volume")


@query(S.with_(S.BARS, "SELECT 'T' || ticker AS ticker, date, " + ", ".join(f"round({c} + {S.OFF}, 2) AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def vendor_csv(spark, sf):
    """Files of many tickers each: a file a ticker would be more of them than rows pay for."""
    path = _path(spark, "vendor")
    bars = wh.bars(spark, sf).select(F.concat(F.lit("T"), "ticker").alias("ticker"), F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    bars.write.option("header", True).csv(path)
    return files.vendor_csv(spark, path, "1996-01-01", "1998-12-31")


@query(S.with_(S.BARS, "SELECT 'T' || ticker AS ticker, CAST(date AS TIMESTAMP) AS ts, open AS o, high AS h, low AS l, close AS c, volume AS v, vwap AS vw FROM bars"))
def json_bars(spark, sf):
    path = _path(spark, "rest")
    bar = F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"))
    days = wh.bars(spark, sf).groupBy("ticker", F.year("date").alias("y")).agg(F.collect_list(bar).alias("bars"))  # a page is a ticker's year
    days.select(F.concat(F.lit("t"), "ticker").alias("symbol"), "bars").write.json(path)
    return files.json_bars(spark, path)


@query(S.with_(S.BARS, "z AS (SELECT ticker, arg_max(close, date) AS c, arg_max(low, date) AS l, arg_max(high, date) AS h FROM bars GROUP BY 1)", "SELECT 'T' || ticker AS ticker, CASE ticker % 4 WHEN 0 THEN h WHEN 1 THEN l WHEN 2 THEN h ELSE c END AS price FROM z"))
def snapshots(spark, sf):
    path = _path(spark, "snapshot")
    k = F.col("ticker")
    last = wh.bars(spark, sf).groupBy("ticker").agg(*(F.max_by(c, "date").alias(c) for c in ("close", "low", "high")))
    last.select(F.concat(F.lit("t"), "ticker").alias("symbol"), F.when(k % 4 == 0, F.col("high")).when(k % 4 == 2, 0.0).alias("trade"), F.when(k % 4 == 1, F.col("low")).alias("bid"), F.when(k % 4 == 2, F.col("high")).alias("ask"), F.col("close").alias("day_close")).write.json(path)
    return files.snapshots(spark, path)


@query(S.with_(S.OUTCOMES, "SELECT ord, 'T' || ticker AS ticker, date, rating, ord % 3 = 0 AS pending, CASE WHEN ord % 3 <> 0 THEN round(ord % 200 - 100, 1) / 100e0 END AS raw, CASE WHEN ord % 3 <> 0 THEN CAST(ord % 9 AS INT) END AS holding_days FROM outcomes"))
def decision_log(spark, sf):
    path = _path(spark, "log")
    o = F.col("ord")
    known = F.concat((o % 200 - 100).cast("string"), F.lit("% | +1.0% | "), (o % 9).cast("string"), F.lit("d"))
    tag = F.concat(F.lit("["), F.col("date").cast("string"), F.lit(" | T"), "ticker", F.lit(" | "), "rating", F.lit(" | "), F.when(o % 3 == 0, F.lit("pending")).otherwise(known), F.lit("]"))
    entry = F.concat(tag, F.lit("\n\nDECISION:\n"), o.cast("string"), F.lit("\n\nREFLECTION:\nnone\n\n"))
    wh.outcomes(spark, sf).select(entry.alias("value")).write.option("lineSep", "<!-- ENTRY_END -->").text(path)
    return files.decision_log(spark, path).select(F.col("decision").cast("long").alias("ord"), "ticker", "date", "rating", "pending", "raw", "holding_days")


@query(S.with_(S.FIN, "SELECT CAST(ticker AS VARCHAR) AS ticker, CAST(year AS VARCHAR) AS period, i AS label, v AS value FROM (SELECT ticker, year, unnest(['Total Revenue', 'Free: Cash', 'Shares']) AS i, unnest([CAST(round(revenue) AS DOUBLE) * 1000, NULL, CAST(shares AS DOUBLE)]) AS v FROM fin)"))
def statement_text(spark, sf):
    path = _path(spark, "statements")
    f = wh.fundamentals(spark, sf)
    whole = lambda c: F.round(c).cast("long").cast("string")
    lines = F.array(*(F.concat_ws("|", F.col("ticker").cast("string"), F.col("year").cast("string"), x) for x in (F.concat(F.lit("Total Revenue: "), whole("revenue"), F.lit("K")), F.lit("Free: Cash: n/a"), F.concat(F.lit("Shares: "), whole("shares")))))
    f.select(F.explode(lines).alias("value")).write.text(path)
    out = files.statements(spark, path)
    return out.select("ticker", "period", F.when(F.col("label") == "Free", "Free: Cash").otherwise(F.col("label")).alias("label"), "value")


_RATIO = "q AS (SELECT ticker, year, CASE WHEN year % 3 <> 0 THEN total_debt / total_equity END AS de, CASE WHEN year % 2 = 0 THEN current_assets / current_liabilities END AS cr, CASE WHEN year % 3 <> 1 THEN cfo - abs(capex) END AS f, (cfo - abs(capex)) / market_cap AS fy, CASE WHEN year % 2 = 0 THEN net_income / total_equity END AS roe, market_cap / shares AS price, net_income / shares AS eps FROM fin)"


@query(S.with_(S.FIN, _RATIO, "SELECT ticker, year, CASE WHEN de IS NOT NULL OR cr IS NOT NULL THEN coalesce(de < 1, false) OR coalesce(cr > 1.5e0, false) END AS sheet_ok, coalesce(f > 0, fy > 0, true) AND coalesce(roe > 0.15e0, true) AS profit_ok, round(CASE WHEN price > 0 AND eps > 0 THEN price / eps END, 6) AS price_earnings FROM q"))
def balance_and_profit(spark, sf):
    """The balance sheet and profitability gates, and the price multiple of each period."""
    c, y = F.col, F.col("year")
    q = wh.fundamentals(spark, sf).select(
        "ticker", "year", F.when(y % 3 != 0, c("total_debt") / c("total_equity")).alias("de"), F.when(y % 2 == 0, c("current_assets") / c("current_liabilities")).alias("cr"), F.when(y % 3 != 1, fx.fcf()).alias("f"),
        fx.fcf_yield().alias("fy"), F.when(y % 2 == 0, c("net_income") / c("total_equity")).alias("roe"), (c("market_cap") / c("shares")).alias("price"), (c("net_income") / c("shares")).alias("eps"),
    )
    return q.select("ticker", "year", fx.sheet_health(c("de"), c("cr")).alias("sheet_ok"), fx.profitability(c("f"), c("fy"), c("roe")).alias("profit_ok"), F.round(fx.period_multiple(c("price"), c("eps")), 6).alias("price_earnings"))


@query(S.with_(S.STEPS, f"v AS (SELECT ticker, date, bar, close / lag(close, 125) OVER ({S.W}) - 1 AS m, stddev_samp(log_return) OVER {S.over(20)} * sqrt(252) AS vol, ret FROM steps)", "SELECT ticker, date, round(CASE WHEN bar >= 127 AND vol > 0 THEN m / vol END, 6) + 0e0 AS vol_adjusted, round(ret - 0.001e0, 8) + 0e0 AS net FROM v"))
def vol_adjusted_momentum(spark, sf):
    df = ind.with_steps(wh.bars(spark, sf))
    return df.select("ticker", "date", r(ind.vol_adjusted_momentum(), 6).alias("vol_adjusted"), r(mk.net_of_cost(F.col("ret"))).alias("net"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS peak, value * (event_id % 10) / 10 AS now, ts FROM events) SELECT event_id, CASE WHEN peak > 0 THEN (peak - now) / peak >= 0.5e0 END AS giveback_50, now / 100 - 0.5e0 <= -0.03e0 AS max_daily_loss_hit, extract(hour FROM ts - INTERVAL 5 HOUR) * 60 + extract(minute FROM ts - INTERVAL 5 HOUR) >= 600 AS past_window FROM e")
def session_discipline(spark, sf):
    """Session flags, and whether the exchange's clock (winter time in January) is past ten."""
    e = wh.table(spark, sf, "events")
    peak, now = F.when(F.col("event_id") % 5 != 0, F.col("value")), F.col("value") * (F.col("event_id") % 10) / 10
    give, loss = setups.session_flags(peak, now), setups.session_flags(peak, now / 100 - 0.5)
    return e.select("event_id", give["giveback_50"].alias("giveback_50"), loss["max_daily_loss_hit"].alias("max_daily_loss_hit"), setups.past_optimal_window(F.col("ts").cast("timestamp")).alias("past_window"))


@query("SELECT o_orderkey AS ord, 'T' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS updated, 'pending' AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY updated DESC, ticker, ord LIMIT 10")
def ipo_events(spark, sf):
    o = wh.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("listed")
    rows = o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("T"), "o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("updated"), status.alias("status"))
    return mk.ipos(rows, limit=10)


@query("WITH p AS (SELECT s_nationkey AS ticker, s_name AS peer, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) SELECT ticker, string_agg(peer, ', ' ORDER BY place) AS peers FROM p WHERE place <= 24 GROUP BY 1")
def company_peers(spark, sf):
    """Suppliers of one nation as each other's peers: more than 24 of them in most nations at larger scales."""
    s = wh.table(spark, sf, "supplier")
    return mk.peers(s.select(F.col("s_nationkey").alias("ticker"), F.col("s_name").alias("peer"), F.col("s_suppkey").alias("ord")))


@query("SELECT c_custkey AS k, c_name AS security FROM customer WHERE contains(upper(c_name), 'R#00000001')")
def security_filter(spark, sf):
    return mk.of_security(wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("security")), "r#00000001")
