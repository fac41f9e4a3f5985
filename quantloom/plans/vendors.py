"""Queries on vendor tables, sizing scalars, folds and renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import clamp
from ..operators import cleaning
from ..operators import evaluate as evl
from ..operators import events as ev
from ..operators import ledgers as lg
from ..operators import markets as mk
from ..operators import portfolio as pf
from ..sources import files, routing
from ..sources import warehouse as wh
from . import sql as S
from .registry import query, r, rounded
from .values import _RET, _SPLITS


def _orders(spark, sf):
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus", "o_orderpriority")


_O = "o AS (SELECT o_orderkey AS ord, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice, o_orderstatus, o_orderpriority FROM orders)"


@query(S.with_(S.BARS, "SELECT date, count(*) AS n_tickers FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1"))
def trading_days(spark, sf):
    return mk.trading_days(wh.bars(spark, sf), "1999-01-01", "1999-12-31")


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), nullif(l_quantity, 0), l_extendedprice) AS price FROM lineitem")
def price_fallback(spark, sf):
    c = lambda x: F.nullif(F.col(x), F.lit(0.0))
    return wh.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.coalesce(c("l_discount"), c("l_tax"), c("l_quantity"), "l_extendedprice").alias("price"))


@query(S.with_(S.FIN, "SELECT ticker, 'revenue' AS item, round(max(CASE WHEN year = 1996 THEN revenue END), 2) AS y1996, round(max(CASE WHEN year = 1997 THEN revenue END), 2) AS y1997 FROM fin GROUP BY 1 UNION ALL SELECT ticker, 'cfo', round(max(CASE WHEN year = 1996 THEN cfo END), 2), round(max(CASE WHEN year = 1997 THEN cfo END), 2) FROM fin GROUP BY 1"))
def statement_pivot(spark, sf):
    items = wh.fundamentals(spark, sf).select("ticker", F.concat(F.lit("y"), F.col("year")).alias("period"), "revenue", "cfo").unpivot(["ticker", "period"], ["revenue", "cfo"], "item", "value")
    return rounded(mk.pivot_statement(items, ["y1996", "y1997"]), "y1996", "y1997", digits=2)


@query(S.with_(_O, "SELECT ord, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE o_orderpriority END AS field FROM o"))
def field_names(spark, sf):
    names = spark.createDataFrame([("1-URGENT", "Urgent"), ("2-HIGH", "High")], "field_id string, name string")
    return mk.named_fields(_orders(spark, sf).select("ord", F.col("o_orderpriority").alias("field_id")), names).select("ord", "field")


@query(S.with_(_O, "p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ord DESC) AS p FROM o)", "SELECT ticker, date, ord, o_totalprice AS shares_short FROM p WHERE p <= 4"))
def short_interest(spark, sf):
    return mk.top_per(_orders(spark, sf), ["ticker"], [F.desc("date"), F.desc("ord")], 4).select("ticker", "date", "ord", F.col("o_totalprice").alias("shares_short"))


@query("SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS short_ratio FROM lineitem GROUP BY 1, 2")
def short_volume(spark, sf):
    rows = wh.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("short_volume"), F.sum("l_quantity").alias("total_volume"))
    return mk.short_volume(rows).select("ticker", "date", "short_ratio")


@query("WITH n AS (SELECT l_partkey AS ticker, sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS net FROM lineitem GROUP BY 1) SELECT ticker, net, CASE WHEN net > 0 THEN 'BUY' WHEN net < 0 THEN 'SELL' ELSE 'flat' END AS side FROM n")
def smart_money(spark, sf):
    q = F.col("l_quantity")
    net = wh.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ticker")).agg(F.sum(F.when(F.col("l_returnflag") == "A", q).when(F.col("l_returnflag") == "R", -q).otherwise(0.0)).alias("net"))
    return net.withColumn("side", mk.net_side(F.col("net")))


@query("SELECT l_suppkey AS ticker, l_returnflag AS kind, l_linestatus AS name, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3")
def revenue_breakdown(spark, sf):
    cells = wh.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("name")).agg(F.sum("l_quantity").alias("value"))
    items = cells.groupBy("ticker", "kind").agg(F.collect_list(F.struct("name", "value")).alias("item_list"))  # a few names
    return mk.revenue_breakdown(items.groupBy("ticker").agg(F.collect_list(F.struct("kind", "item_list")).alias("breakdown_list")))


@query(
    S.with_(
        _O,
        "d AS (SELECT ticker, date, ord, o_totalprice AS amount, 'dividend' AS kind, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ord DESC) AS p FROM o WHERE o_orderstatus = 'F')",
        "s AS (SELECT ticker, date, ord, ord % 5 + 1 AS ratio, 'split' AS kind, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ord DESC) AS p FROM o WHERE o_orderstatus = 'O')",
        "SELECT ticker, date, ord, kind, amount, NULL AS ratio FROM d WHERE p <= 2 UNION ALL SELECT ticker, date, ord, kind, NULL, ratio FROM s WHERE p <= 2",
    )
)
def corporate_actions(spark, sf):
    o = _orders(spark, sf)
    dividends = o.where("o_orderstatus = 'F'").select("ticker", "date", "ord", F.col("o_totalprice").alias("amount"))
    splits = o.where("o_orderstatus = 'O'").select("ticker", "date", "ord", (F.col("ord") % 5 + 1).alias("ratio"))
    return mk.corporate_actions(dividends, splits, 2).select("ticker", "date", "ord", "kind", "amount", "ratio")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_name END AS sector FROM customer")
def sector_fallback(spark, sf):
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("c_mktsegment")).otherwise("None")
    return wh.table(spark, sf, "customer").select(k.alias("k"), mk.first_known(first, F.lit(None).cast("string"), F.col("c_name")).alias("sector"))


_ACTION = "CASE ord % 4 WHEN 0 THEN 'Upgrade' WHEN 1 THEN 'downgrade' WHEN 2 THEN 'up/down' ELSE 'reiterate' END"


@query(S.with_(_O, f"a AS (SELECT ticker, lower({_ACTION}) AS t FROM o)", "SELECT ticker, count_if(contains(t, 'up')) AS up, count_if(contains(t, 'down') AND NOT contains(t, 'up')) AS down, count_if(contains(t, 'up')) - count_if(contains(t, 'down') AND NOT contains(t, 'up')) AS net FROM a GROUP BY 1"))
def revision_actions(spark, sf):
    return mk.revision_counts(_orders(spark, sf).select("ticker", F.expr(_ACTION).alias("action")))


_FORM = "CASE ord % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN '10-Q' ELSE 'S-1' END"


@query(S.with_(_O, f"f AS (SELECT ticker, {_FORM} AS form, date, ord, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ord DESC) AS p FROM o)", "q AS (SELECT ticker, form, date AS filed, 'u' || ord AS url, row_number() OVER (PARTITION BY ticker ORDER BY p) AS n FROM f WHERE form <> 'S-1')", "SELECT ticker, form, filed, url FROM q WHERE n <= 3"))
def sec_filings(spark, sf):
    rows = _orders(spark, sf).select("ticker", F.struct(F.col("date").alias("d"), F.col("ord").alias("o"), F.expr(_FORM).alias("f")).alias("x"))
    listed = rows.groupBy("ticker").agg(F.sort_array(F.collect_list("x"), asc=False).alias("x"))  # filings of one ticker
    raw = listed.select("ticker", F.col("x.f").alias("form"), F.col("x.d").alias("filed"), F.transform("x", lambda x: F.concat(F.lit("u"), x["o"])).alias("url"))
    return files.filings(raw, limit=3)


@query(S.with_(_O, "m AS (SELECT o_orderpriority AS series, CASE WHEN ord % 3 = 0 THEN '.' ELSE CAST(round(o_totalprice) AS VARCHAR) END AS v, date, ord FROM o)", "d AS (SELECT series, date, max(TRY_CAST(v AS DOUBLE)) AS v FROM m GROUP BY 1, 2)", "SELECT series, arg_max(v, date) AS value FROM d WHERE v IS NOT NULL GROUP BY 1"))
def latest_parseable(spark, sf):
    o = _orders(spark, sf).select(F.col("o_orderpriority").alias("series"), "date", F.when(F.col("ord") % 3 == 0, ".").otherwise(F.round("o_totalprice").cast("string")).alias("v"))
    daily = o.groupBy("series", "date").agg(F.max(F.col("v").try_cast("double")).alias("v"))
    return mk.first_number_by_date(daily, "series", F.col("v").cast("string"))


@query("SELECT o_orderkey AS ord, CASE WHEN coalesce(o_orderkey % 50 / 10e0 < o_orderkey % 43 / 10e0, false) THEN 0.7e0 ELSE 1e0 END * CASE WHEN coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 37 / 10e0 END > 3, false) THEN 0.75e0 ELSE 1e0 END AS scale FROM orders")
def macro_backdrop(spark, sf):
    k = F.col("o_orderkey")
    return wh.table(spark, sf, "orders").select(k.alias("ord"), ev.macro_backdrop(k % 50 / 10.0, k % 43 / 10.0, F.when(k % 7 != 0, k % 37 / 10.0)).alias("scale"))


@query(
    S.with_(
        S.BARS, _O,
        "p AS (SELECT ticker % 10 AS ticker, ord % 4 AS period, date, arg_min(o_totalprice, ord) AS a, min(ord) AS m FROM o GROUP BY 1, 2, 3)",
        f"m AS (SELECT ticker, date, close / lag(close) OVER ({S.W}) - 1 AS mv FROM bars)",
        "SELECT p.ticker, p.period, p.date, round(CASE WHEN m % 100 <> 0 THEN (a - m % 100) / (m % 100) * 100 END, 4) + 0e0 AS surprise_pct, round(mv, 6) + 0e0 AS day_move FROM p LEFT JOIN m ON m.ticker = p.ticker AND m.date = p.date",
    )
)
def surprise_history(spark, sf):
    o = _orders(spark, sf)
    prints = o.select((F.col("ticker") % 10).alias("ticker"), (F.col("ord") % 4).alias("period"), "date", "ord", F.col("o_totalprice").alias("eps_actual"), (F.col("ord") % 100).cast("double").alias("eps_estimate"))
    out = mk.surprise_history(prints, wh.bars(spark, sf))
    return out.select("ticker", "period", "date", r("surprise_pct", 4).alias("surprise_pct"), r("day_move", 6).alias("day_move"))


@query(S.with_(S.BARS, _O, "h AS (SELECT ticker % 10 AS ticker, ord, ord % 17 / 100e0 AS mv, ord % 11 = 0 AS cur FROM o)", "b AS (SELECT ticker, coalesce(arg_min(mv, ord) FILTER (cur), arg_min(mv, ord)) AS move FROM h GROUP BY 1)", "c AS (SELECT ticker, arg_max(close, date) AS close FROM bars GROUP BY 1)", "SELECT b.ticker, move, round(close * (1 - move), 6) AS low, round(close * (1 + move), 6) AS high FROM b JOIN c ON b.ticker = c.ticker"))
def expected_move(spark, sf):
    history = _orders(spark, sf).select((F.col("ticker") % 10).alias("ticker"), "ord", (F.col("ord") % 17 / 100.0).alias("move"), (F.col("ord") % 11 == 0).alias("is_current"))
    return rounded(mk.expected_move(history, wh.bars(spark, sf)), "low", "high", digits=6)



@query(
    "WITH a AS (SELECT r_regionkey AS id0 FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS p FROM region) WHERE p <= 2), "
    "b AS (SELECT n_nationkey AS id1, n_regionkey AS id0 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) WHERE p <= 3), "
    "c AS (SELECT c_custkey AS id2, c_nationkey AS id1 FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer) WHERE p <= 2), "
    "d AS (SELECT o_orderkey AS id3, o_custkey AS id2, o_orderkey % 11 / 10e0 AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p <= 20) "
    "SELECT id0, id1, id2, id3, price FROM a JOIN b USING (id0) JOIN c USING (id1) JOIN d USING (id2) WHERE price > 0 AND price < 1"
)
def prediction_walk(spark, sf):
    t = lambda name, i, parent, *more: wh.table(spark, sf, name).select(F.col(i).alias("id"), parent.alias("parent"), F.col(i).alias("ord"), *more)
    levels = [t("region", "r_regionkey", F.lit(0)), t("nation", "n_nationkey", F.col("n_regionkey")), t("customer", "c_custkey", F.col("c_nationkey")), t("orders", "o_orderkey", F.col("o_custkey"), (F.col("o_orderkey") % 11 / 10.0).alias("price"))]
    return mk.contract_walk(levels)


@query("SELECT p_partkey AS k, regexp_matches(upper(n), 'ETF|ETN|TRUST|INDEX|FUND') AS fund FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' Etf' WHEN 1 THEN 'trustco ' || p_name ELSE p_name END AS n FROM part)")
def non_equity(spark, sf):
    name = F.expr("case p_partkey % 4 when 0 then p_name || ' Etf' when 1 then 'trustco ' || p_name else p_name end")
    return wh.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), cleaning.not_equity(name).alias("fund"))


@query(
    "WITH k AS (SELECT o_orderkey AS ord, o_orderkey % 101 / 100e0 AS p, o_orderkey % 13 / 4e0 AS rr, o_orderkey % 9 / 2e0 AS atr, 50e0 AS close FROM orders), "
    "f AS (SELECT *, greatest(0, least(1, (1.5e0 * p - (1 - p)) / 1.5e0)) AS kf FROM k) "
    "SELECT ord, round(kf, 6) AS kelly, round(least(kf * 0.25e0, 1), 6) AS quarter, round(greatest(0, least(kf * 0.25e0, CASE WHEN atr > 0 THEN 0.01e0 / (atr * 2 / close) ELSE 1 END, 1)), 6) AS with_risk, round(CASE WHEN rr > 0 THEN 1 / (1 + rr) END, 6) AS breakeven, round(p * rr - (1 - p) * CASE WHEN atr <> 0 THEN atr ELSE 1e-9 END, 6) + 0e0 AS expectancy FROM f"
)
def sizing_scalars(spark, sf):
    k = F.col("o_orderkey")
    df = wh.table(spark, sf, "orders").select(k.alias("ord"), (k % 101 / 100.0).alias("p"), (k % 13 / 4.0).alias("rr"), (k % 9 / 2.0).alias("atr"), F.lit(50.0).alias("close"))
    c = F.col
    return df.select("ord", r(pf.kelly_fraction(c("p"), 1.5), 6).alias("kelly"), r(pf.kelly_size(c("p"), 1.5), 6).alias("quarter"), r(pf.size_with_risk(c("p"), 1.5, c("atr"), c("close")), 6).alias("with_risk"), r(pf.breakeven_win_rate(c("rr")), 6).alias("breakeven"), r(pf.expectancy(c("p"), c("rr"), c("atr")), 6).alias("expectancy"))


@query("WITH b AS (SELECT r_name AS book, s_acctbal / 100000 AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT book, round(0.1e0 * sum(greatest(0, weight)), 8) AS stress_loss FROM b GROUP BY 1")
def stress_loss(spark, sf):
    w = wh.sectors(spark, sf).join(wh.table(spark, sf, "supplier"), F.expr("ticker = s_suppkey")).select(F.col("sector").alias("book"), (F.col("s_acctbal") / 100000).alias("weight"))
    return rounded(evl.stress_loss(w), "stress_loss")


@query("SELECT o_orderkey AS ord, round(o_orderkey % 31 / 20e0 * coalesce(greatest(0, least(1, 1 - CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 13 / 10e0 END)), 1), 6) + 0e0 AS folded, round(greatest(0, least(o_orderkey % 31 / 20e0 * CASE WHEN o_orderkey % 21 = 0 THEN 1 ELSE o_orderkey % 21 / 20e0 END, 1.5e0)), 6) AS with_catalyst, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 60 END >= 30, false) AS rebalance FROM orders")
def overlay_folds(spark, sf):
    from ..functions.numeric import or_default

    k = F.col("o_orderkey")
    base = k % 31 / 20.0
    scale = or_default(k % 21 / 20.0, 1.0)
    return wh.table(spark, sf, "orders").select(k.alias("ord"), r(ev.fold_flow(base, F.when(k % 4 != 0, k % 13 / 10.0)), 6).alias("folded"), r(clamp(base * scale, 0.0, 1.5), 6).alias("with_catalyst"), pf.rebalance_due(F.when(k % 5 != 0, k % 60)).alias("rebalance"))


@query(
    S.with_(
        _RET, _SPLITS,
        "wd AS (SELECT ticker, split, max(CASE part WHEN 'train' THEN round(sharpe, 9) END) AS a, max(CASE part WHEN 'test' THEN round(sharpe, 9) END) AS b FROM ws GROUP BY 1, 2)",
        "of AS (SELECT ticker, count(*) AS n_splits, arg_max(b, {'a': a, 's': -split}) < -0.1e0 AS bad FROM wd GROUP BY 1)",
        "pe AS (SELECT ticker, (pow(exp(sum(ln(1 + r))), 252e0 / count(r)) - 1) / (stddev_samp(r) * sqrt(252)) - sqrt(2 * ln(20)) AS ds FROM rr GROUP BY 1)",
        "SELECT pe.ticker, NOT bad AND ds > 0 AS ok, CASE WHEN bad THEN 'PBO' WHEN ds <= 0 THEN 'deflated_sharpe<=0' ELSE 'pass' END AS reason, round(ds, 6) + 0e0 AS deflated_sharpe, n_splits FROM pe JOIN of ON of.ticker = pe.ticker",
    )
)
def config_gate(spark, sf):
    return rounded(evl.config_gate(wh.returns(wh.bars(spark, sf))), "deflated_sharpe", digits=6)


_WHY = "list_filter([CASE WHEN ord % 2 = 0 THEN 'size' END, CASE WHEN ord % 3 = 0 THEN 'cvar' END], lambda x: x IS NOT NULL)"


@query(S.with_(_O, f"a AS (SELECT ord, unnest({_WHY}) AS reason FROM o)", "SELECT reason, min(ord) AS first_ord FROM a GROUP BY 1"))
def audit_reasons(spark, sf):
    o = F.col("ord")
    entries = _orders(spark, sf).select("ord", F.lit("REJECT").alias("verdict"), F.array_compact(F.array(F.when(o % 2 == 0, F.lit("size")), F.when(o % 3 == 0, F.lit("cvar")))).alias("reasons"))
    return lg.audit_summary(entries)[1]


@query(S.with_(S.OUTCOMES, "w AS (SELECT *, pow(0.5e0, greatest(0, date_diff('day', date, DATE '2001-08-01')) / 30e0) AS w FROM outcomes)", "SELECT analyst, CASE WHEN sum(CASE WHEN delta_r > 0 THEN w ELSE 0 END) / sum(w) >= 0.5e0 THEN 'verify-winners' ELSE 'critique' END AS hint FROM w GROUP BY 1"))
def reflection_hints(spark, sf):
    s = lg.analyst_scores(wh.outcomes(spark, sf), "2001-08-01")
    return s.select("analyst", lg.reflection_hint(F.col("total"), F.col("score")).alias("hint"))


@query("SELECT o_orderkey AS ord, sha256(o_orderpriority || '|{\"k\":' || o_custkey || '}') AS key FROM orders")
def cache_keys(spark, sf):
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), routing.cache_key(F.col("o_orderpriority"), F.struct(F.col("o_custkey").alias("k"))).alias("key"))


@query("WITH c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'bars' ELSE 'fundamentals' END AS category, ts, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status FROM events) SELECT event_id FROM c WHERE status = 'ok' AND category <> 'news' AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 6 HOUR")
def cache_fresh(spark, sf):
    e = F.col("event_id")
    rows = wh.table(spark, sf, "events").select("event_id", F.when(e % 3 == 0, "news").when(e % 3 == 1, "bars").otherwise("fundamentals").alias("category"), F.col("ts").alias("ingested_at"), F.when(e % 5 == 0, "error").otherwise("ok").alias("status"))
    return routing.fresh(rows, "2024-01-20 12:00:00").select("event_id")


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '^HSI' WHEN 1 THEN '^N225' ELSE 'SPY' END AS benchmark, CASE WHEN c_custkey % 3 = 0 THEN ['a', 'b'] END AS items FROM customer")
def lookups(spark, sf):
    k = F.col("c_custkey")
    symbol = F.when(k % 4 == 0, "0700.HK").when(k % 4 == 1, "7203.T").otherwise("AAPL")
    listed = F.when(k % 3 == 0, '["a", "b"]').otherwise("not a list")
    return wh.table(spark, sf, "customer").select(k.alias("k"), routing.benchmark_of(symbol, {".HK": "^HSI", ".T": "^N225"}).alias("benchmark"), text.json_list(listed).alias("items"))


@query(S.with_(_O, "SELECT ord, 'risk snapshot: verdict=' || CASE WHEN ord % 41 > 30 THEN 'REJECT' WHEN ord % 41 >= 27 THEN 'WARN' ELSE 'PASS' END || '; size_pct=' || (ord % 41) || '.0%' || CASE WHEN ord % 41 > 30 THEN '; reasons=size' ELSE '' END AS line FROM o"))
def risk_snapshot(spark, sf):
    none = F.lit(None).cast("double")
    df = _orders(spark, sf).select("ord", (F.col("ord") % 41 / 100.0).alias("size_pct"), *(none.alias(c) for c in ("book_total_pct", "cvar_pct", "drawdown_pct", "sector_pct", "capital_at_risk_pct", "risk_cap_pct")), F.lit(False).alias("halted"))
    return pf.govern(df).select("ord", pf.snapshot_text().alias("line"))
