"""Queries on news by ticker, sessions, floats, tail budgets, yields and sizes after an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import evaluate as evl
from ..operators import events as ev
from ..operators import forensics as fx
from ..operators import markets as mk
from ..sources import warehouse as wh
from . import sql as S
from .registry import query, r

_NEWS = """a AS (SELECT event_id AS id, 'n' || event_id AS title, [CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 't' END || user_id % 40, 'X' || event_id % 3] AS tickers,
  CASE WHEN event_id % 4 <> 3 THEN [{'t': 't' || (user_id + event_id) % 40, 's': event_type}, {'t': 'T' || (user_id + event_id) % 40, 's': 'second'}] END AS insights FROM events),
q AS (SELECT 'T' || unnest(range(40)) AS ticker)"""


@query(f"WITH {_NEWS} SELECT q.ticker, id, title, CASE WHEN lower(insights[1].t) = lower(q.ticker) THEN insights[1].s END AS sentiment FROM q JOIN a ON lower(a.tickers[1]) = lower(q.ticker) OR coalesce(lower(insights[1].t) = lower(q.ticker), false)")
def ticker_news(spark, sf):
    """Articles that name a ticker among their tickers or insights, with what their own insight on it says."""
    e, n = wh.table(spark, sf, "events"), F.col("event_id")
    own = lambda mark, said: F.struct(F.concat(F.lit(mark), ((F.col("user_id") + n) % 40).cast("string")).alias("ticker"), said.alias("sentiment"), F.lit("why").alias("reasoning"))
    tickers = F.array(F.concat(F.when(n % 2 == 0, "T").otherwise("t"), (F.col("user_id") % 40).cast("string")), F.concat(F.lit("X"), (n % 3).cast("string")))
    insights = F.when(n % 4 != 3, F.array(own("t", F.col("event_type")), own("T", F.lit("second"))))
    articles = e.select(n.alias("id"), F.concat(F.lit("n"), n.cast("string")).alias("title"), tickers.alias("tickers"), insights.alias("insights"))
    return mk.ticker_news(articles, spark.range(40).select(F.concat(F.lit("T"), "id").alias("ticker"))).select("ticker", "id", "title", "sentiment")


@query(S.with_(S.BARS, "s AS (SELECT DISTINCT date, CAST(date AS TIMESTAMP) + INTERVAL 570 MINUTE AS open, CAST(date AS TIMESTAMP) + INTERVAL 960 MINUTE AS close FROM bars WHERE date_part('isodow', date) < 6)", "i AS (SELECT o_orderkey AS ord, CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 48) HOUR AS ts FROM orders)", "o AS (SELECT ord, ts, min(open) AS next_open FROM i LEFT JOIN s ON open > ts GROUP BY 1, 2)", "c AS (SELECT ord, min(close) AS next_close FROM i LEFT JOIN s ON close > ts GROUP BY 1)", "SELECT o.ord, EXISTS (SELECT 1 FROM s WHERE s.open <= o.ts AND o.ts < s.close) AS is_open, next_open, next_close FROM o JOIN c USING (ord)"))
def session_clock(spark, sf):
    """Whether the exchange is open at each order's time, and when it opens and closes next."""
    day = F.col("date").cast("timestamp")
    days = wh.bars(spark, sf).select("date").distinct().where(F.weekday("date") < 5)
    sessions = days.select("date", (day + F.expr("interval 570 minutes")).alias("open"), (day + F.expr("interval 960 minutes")).alias("close"))
    at = F.to_date("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 48)
    return mk.session_clock(wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), at.alias("ts")), sessions).drop("ts")


@query("SELECT c_custkey AS ticker, CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN c_custkey * 100e0 WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey + 1 AS DOUBLE) END AS float_shares FROM customer")
def float_shares(spark, sf):
    """Floats of a profile, empty or 0 for most tickers, with a fallback."""
    k = F.col("c_custkey")
    profile = F.when(k % 3 == 0, (k * 100).cast("string")).when(k % 3 == 1, "0").otherwise("")
    rows = wh.table(spark, sf, "customer").select(k.alias("ticker"), profile.alias("profile_float"), F.when(k % 5 != 0, F.col("c_nationkey") + 1).otherwise(0).alias("fallback_float"))
    return rows.select("ticker", mk.float_shares().alias("float_shares"))


@query(S.with_(S.BARS, "r AS (SELECT ticker, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 9) AS r FROM bars)", "k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY r) AS p, greatest(1, CAST(floor(0.05e0 * count(*) OVER (PARTITION BY ticker)) AS BIGINT)) AS k FROM r WHERE r IS NOT NULL)", "t AS (SELECT ticker, avg(r) AS tail FROM k WHERE p <= k GROUP BY 1)", "SELECT s_suppkey AS ticker, round(coalesce(tail, 0), 6) + 0e0 AS tail, greatest(-coalesce(tail, 0), 0) <= 0.02e0 AS within FROM supplier LEFT JOIN t ON t.ticker = s_suppkey"))
def cvar_budget(spark, sf):
    """The tail of every ticker's daily returns against a budget of 2 %."""
    names = wh.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"))
    out = evl.cvar_budget(wh.returns(wh.bars(spark, sf)), names, ["ticker"], budget=0.02)
    return out.select("ticker", r("tail", 6).alias("tail"), "within")


@query(S.with_(S.FIN, "l AS (SELECT ticker, year + 20 AS year, cfo - abs(capex) AS fcf, market_cap, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS p FROM fin WHERE year % 3 <> 0)", "SELECT ticker, year, round(CASE WHEN market_cap > 0 THEN fcf / market_cap END, 6) + 0e0 AS fcf_yield, CASE WHEN market_cap > 0 THEN CASE WHEN fcf / market_cap >= 0.06e0 THEN 'floor-pass' ELSE 'below-floor' END END AS band FROM l WHERE p = 1"))
def fcf_yield(spark, sf):
    """Free cash flow yield of each ticker's latest period, told from the period's label, and whether it is at the floor."""
    f = wh.fundamentals(spark, sf).where(F.col("year") % 3 != 0).withColumn("period", F.concat((F.col("year") + 20).cast("string"), F.lit("/FY")))
    own = f.select("ticker", dates.period_year(F.col("period")).alias("year"), "cfo", "capex", "market_cap")
    last = mk.top_per(own, ["ticker"], [F.desc("year")], 1)
    return last.select("ticker", "year", r(fx.fcf_yield(), 6).alias("fcf_yield"), fx.yield_band(fx.fcf_yield()).alias("band"))


@query("SELECT o_orderkey AS ord, CASE o_orderstatus WHEN 'P' THEN 0 ELSE least(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0.5e0 END * 1.25e0, 1.5e0) END AS multiple FROM orders")
def beat_miss_sizing(spark, sf):
    """The size after a beat (F), a miss (O) or neither (P), with a catalyst scale."""
    side = F.when(F.col("o_orderstatus") == "F", "beat").when(F.col("o_orderstatus") == "O", "miss").otherwise("flat")
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), ev.side_multiple(side, 1.25).alias("multiple"))
