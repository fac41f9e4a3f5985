"""Queries on statements, scores, ranks, portfolios and return series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluate as evl
from ..operators import forensics as fx
from ..operators import indicators as ind
from ..operators import ledgers as lg
from ..operators import markets as mk
from ..operators import portfolio as pf
from ..operators import ranking as rk

from ..sources import warehouse as wh
from . import sql as S
from .registry import query, r, rounded


@query(S.with_(S.FIN, "SELECT ticker, year, round(revenue, 2) AS revenue, round(operating_income, 2) AS operating_income, round(total_assets, 2) AS total_assets, round(revenue_prior, 2) AS revenue_prior FROM fin"))
def fundamentals(spark, sf):
    return rounded(wh.fundamentals(spark, sf).select("ticker", "year", "revenue", "operating_income", "total_assets", "revenue_prior"), "revenue", "operating_income", "total_assets", "revenue_prior", digits=2)


def _d(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _m(textbook: bool) -> str:
    s = "+" if textbook else "-"
    soft = lambda p: _d(f"total_assets{p} - current_assets{p} - ppe{p} - securities{p}", f"total_assets{p}")
    aqi = _d(soft(""), soft("_prior")) if textbook else _d(f"1 - {soft('')}", f"1 - {soft('_prior')}")
    terms = [
        (0.92, _d(_d("receivables", "revenue"), _d("receivables_prior", "revenue_prior"))), (0.528, _d(_d("revenue_prior - cogs_prior", "revenue_prior"), _d("revenue - cogs", "revenue"))), (0.404, aqi), (0.892, _d("revenue", "revenue_prior")),
        (0.115, _d(_d("depreciation_prior", f"(ppe_prior {s} depreciation_prior)"), _d("depreciation", f"(ppe {s} depreciation)"))), (-0.172, _d(_d("sga", "revenue"), _d("sga_prior", "revenue_prior"))),
        (-0.327, _d(_d(f"current_liabilities {s} total_debt", "total_assets"), _d(f"current_liabilities_prior {s} total_debt_prior", "total_assets_prior"))), (4.679, _d("net_income - cfo", "total_assets")),
    ]
    return "-4.84e0 + " + " + ".join(f"({w!r}e0) * {x}" for w, x in terms)


@query(S.with_(S.FIN, f"SELECT ticker, year, round({_m(False)}, 6) + 0e0 AS m_score, round({_m(True)}, 6) + 0e0 AS m_textbook FROM fin"))
def beneish(spark, sf):
    return wh.fundamentals(spark, sf).select("ticker", "year", r(fx.beneish_m(), 6).alias("m_score"), r(fx.beneish_m(textbook=True), 6).alias("m_textbook"))


_Z = "1.2e0 * working_capital / total_assets + 1.4e0 * retained_earnings / total_assets + 3.3e0 * operating_income / total_assets + 0.6e0 * market_cap / nullif(total_liabilities, 0) + revenue / total_assets"


@query(S.with_(S.FIN, f"SELECT ticker, year, round({_Z}, 6) + 0e0 AS altman_z FROM fin"))
def altman(spark, sf):
    return wh.fundamentals(spark, sf).select("ticker", "year", r(fx.altman_z(), 6).alias("altman_z"))


def _ratios(p: str) -> str:
    return f"net_income{p} / total_assets{p} AS roa{p}, total_debt{p} / total_assets{p} AS lev{p}, current_assets{p} / nullif(current_liabilities{p}, 0) AS cur{p}, (revenue{p} - cogs{p}) / nullif(revenue{p}, 0) AS gm{p}, revenue{p} / total_assets{p} AS turn{p}"


_F = "(coalesce(roa, 0) <> 0)::INT + (cfo > 0)::INT + (cfo - net_income > 0)::INT + coalesce(roa > roa_prior, false)::INT + coalesce(lev < lev_prior, false)::INT + coalesce(cur > cur_prior, false)::INT + coalesce(shares_issued <= 0, false)::INT + coalesce(gm > gm_prior, false)::INT + coalesce(turn > turn_prior, false)::INT"
_RATIOS = f"fr AS (SELECT *, {_ratios('')}, {_ratios('_prior')}, shares - lag(shares) OVER (PARTITION BY ticker ORDER BY year) AS shares_issued FROM fin)"


def _fin(spark, sf):
    issued = F.col("shares") - F.lag("shares").over(Window.partitionBy("ticker").orderBy("year"))
    return wh.fundamentals(spark, sf).withColumn("shares_issued", issued)


@query(S.with_(S.FIN, _RATIOS, f"SELECT ticker, year, {_F} AS f_score FROM fr"))
def piotroski(spark, sf):
    return fx.with_piotroski_inputs(_fin(spark, sf)).select("ticker", "year", fx.piotroski_f().alias("f_score"))


_EV = "market_cap + total_debt - cash"


@query(S.with_(S.FIN, f"SELECT ticker, year, round({_EV}, 5) AS ev, round(operating_income / nullif({_EV}, 0), 6) + 0e0 AS earnings_yield, round(({_EV}) / nullif(operating_income, 0), 6) + 0e0 AS ev_ebit, round((net_income - cfo) / total_assets, 6) + 0e0 AS accruals, round((cfo - abs(capex)) / market_cap, 6) + 0e0 AS fcf_yield FROM fin"))
def ev_family(spark, sf):
    return wh.fundamentals(spark, sf).select("ticker", "year", r(fx.enterprise_value(), 5).alias("ev"), r(fx.earnings_yield(), 6).alias("earnings_yield"), r(fx.acquirers_multiple(), 6).alias("ev_ebit"), r(fx.accruals_ratio(), 6).alias("accruals"), r(fx.fcf_yield(), 6).alias("fcf_yield"))


_SCREEN = f"sc AS (SELECT *, {_m(False)} AS m, {_Z} AS z, {_F} AS f, operating_income / nullif({_EV}, 0) AS ey, ({_EV}) / nullif(operating_income, 0) AS am, market_cap < (2e0 / 3e0) * (current_assets - total_liabilities) AS nn, CASE WHEN total_equity > 0 THEN net_income / total_equity END AS roe FROM fr)"
_TRAP = "coalesce(z < 1.78e0, false)::INT + coalesce(m > -1.78e0, false)::INT + coalesce(f < 4, false)::INT"


@query(S.with_(S.FIN, _RATIOS, _SCREEN, f"SELECT ticker, year, round(am, 6) + 0e0 AS ev_ebit, round(ey, 6) + 0e0 AS earnings_yield, f AS f_score, round(m, 6) + 0e0 AS beneish_m, round(z, 6) + 0e0 AS altman_z, nn AS net_net, round(roe, 6) + 0e0 AS roe, CASE {_TRAP} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS trap FROM sc"))
def screen(spark, sf):
    df = fx.screen(_fin(spark, sf)).select("ticker", "year", "ev_ebit", "earnings_yield", "f_score", "beneish_m", "altman_z", "net_net", "roe", "trap")
    return rounded(df, "ev_ebit", "earnings_yield", "beneish_m", "altman_z", "roe", digits=6)


@query(S.with_(S.FIN, _RATIOS, _SCREEN, "w AS (SELECT ticker, round(ey, 6) + 0e0 AS earnings_yield, round(am, 6) + 0e0 AS ev_ebit, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS p FROM sc)", "SELECT ticker, earnings_yield, ev_ebit, CAST(row_number() OVER (ORDER BY coalesce(earnings_yield, -1) DESC, coalesce(ev_ebit, 'inf'::DOUBLE), ticker) AS INT) AS rank FROM w WHERE p = 1 ORDER BY rank LIMIT 50"))
def watchlist_rank(spark, sf):
    """The best 50 of all tickers by their latest statements."""
    last = mk.top_per(fx.screen(_fin(spark, sf)), ["ticker"], [F.desc("year")], 1)
    return rk.watchlist(rounded(last.select("ticker", "earnings_yield", "ev_ebit"), "earnings_yield", "ev_ebit", digits=6), 50)


@query(
    S.with_(
        S.FIN,
        "a AS (SELECT ticker, (max(cfo - abs(capex))) AS base, arg_max(shares, year) AS shares, arg_max(cash, year) AS cash, arg_max(total_debt, year) AS debt FROM fin GROUP BY ticker)",
        "v AS (SELECT ticker, shares, cash, debt, base, list_sum(list_transform(range(1, 6), lambda y: base * pow(1.025e0, y) / pow(1.09e0, y))) AS pv, base * 1.025e0 / (0.09e0 - 0.025e0) / pow(1.09e0, 5) AS tv FROM a WHERE base > 0)",
        "SELECT ticker, round(pv, 2) AS pv_explicit, round(tv, 2) AS pv_tv, round((pv + tv + cash - debt) / shares, 4) AS price, round(((pv + tv + cash - debt) / shares - 100) / ((pv + tv + cash - debt) / shares), 6) + 0e0 AS margin_of_safety FROM v WHERE pv + tv + cash - debt > 0",
    )
)
def dcf(spark, sf):
    fin = wh.fundamentals(spark, sf)
    last = lambda c: F.max_by(c, "year").alias(c)
    df = fin.groupBy("ticker").agg(F.collect_list(fx.fcf()).alias("h"), last("shares"), last("cash"), last("total_debt"))  # some years a ticker
    value = fx.dcf(F.col("h"), F.lit(0.04), F.lit(1.0), F.col("shares"), F.col("cash"), F.col("total_debt"))
    df = df.withColumn("v", value).where("v is not null")
    return df.select("ticker", r("v.pv_explicit", 2).alias("pv_explicit"), r("v.pv_tv", 2).alias("pv_tv"), r("v.price", 4).alias("price"), r(fx.margin_of_safety(F.lit(100.0), F.col("v.price")), 6).alias("margin_of_safety"))


@query(
    S.with_(
        S.FIN,
        "m AS (SELECT ticker, year, revenue / nullif(net_income, 0) AS x FROM fin)",
        "g AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS sd FROM m WINDOW w AS (PARTITION BY ticker ORDER BY year ROWS UNBOUNDED PRECEDING))",
        "SELECT ticker, year, round(CASE WHEN n >= 4 AND sd > 0 THEN (x - mean) / sd END, 6) + 0e0 AS z, CASE WHEN n < 4 OR sd IS NULL OR sd <= 0 OR x IS NULL THEN 'unknown' WHEN (x - mean) / sd <= -1.5e0 THEN 'cheap' WHEN (x - mean) / sd >= 1.5e0 THEN 'rich' ELSE 'fair' END AS z_verdict FROM g",
    )
)
def valuation_z(spark, sf):
    by = Window.partitionBy("ticker").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    df = wh.fundamentals(spark, sf).withColumn("x", F.try_divide("revenue", "net_income"))
    df = df.withColumns({"n": F.count("x").over(by), "mean": F.avg("x").over(by), "sd": F.stddev_samp("x").over(by)})
    z = fx.valuation_z(F.col("x"), F.col("n"), F.col("mean"), F.col("sd"))
    return df.select("ticker", "year", r(z["z"], 6).alias("z"), z["z_verdict"].alias("z_verdict"))


@query(S.with_(S.FIN, "SELECT ticker, round(list_sort(list(operating_income / revenue ORDER BY year DESC)[1:5])[least(5, count(*)) // 2 + 1] * arg_max(revenue, year), 4) + 0e0 AS norm_ebit FROM fin GROUP BY ticker"))
def norm_ebit(spark, sf):
    fin = wh.fundamentals(spark, sf).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("year", (F.col("operating_income") / F.col("revenue")).alias("m")))).alias("y"), F.max_by("revenue", "year").alias("sales"))  # some years a ticker
    return fin.select("ticker", r(fx.norm_ebit(F.col("y.m"), F.col("sales")), 4).alias("norm_ebit"))


@query(
    S.with_(
        S.FIN, _RATIOS, _SCREEN,
        "e AS (SELECT *, lag(net_income) OVER (PARTITION BY ticker ORDER BY year) AS ni0 FROM sc)",
        f"""n AS (SELECT ticker, year, CASE {_TRAP} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS trap, (net_income - cfo) / total_assets AS ac, cfo - abs(capex) AS fc, roe, (net_income - ni0) / abs(ni0) AS yoy FROM e)""",
        "k AS (SELECT *, (trap = 'HIGH')::INT + coalesce(ac > 0.06e0, false)::INT + coalesce(fc <= 0, false)::INT + coalesce(roe <= 0, false)::INT + coalesce(yoy < -0.3e0, false)::INT AS c FROM n)",
        "SELECT ticker, year, CASE WHEN trap = 'HIGH' OR c >= 2 THEN 'structural' WHEN c = 1 OR trap = 'MEDIUM' THEN 'caution' ELSE 'clean' END AS decline FROM k",
    )
)
def decline_driver(spark, sf):
    df = fx.screen(_fin(spark, sf))
    before = F.col("net_income_prior")
    none = F.lit(None).cast("double")
    return df.select("ticker", "year", fx.decline_driver(F.col("trap"), F.col("accrual"), none, fx.fcf(), F.col("roe"), (F.col("net_income") - before) / F.abs(before)).alias("decline"))


_FACTORS = S.with_(
    S.BARS, S.FIN,
    f"fa AS (SELECT ticker, year(date) AS year, arg_max(mom, date) AS mom, arg_max(dist, date) AS dist FROM (SELECT ticker, date, CASE WHEN bar > 60 THEN close / lag(close, 59) OVER ({S.W}) - 1 END AS mom, close / max(close) OVER {S.over(252)} - 1 AS dist FROM bars) GROUP BY 1, 2)",
    f"fe AS (SELECT ticker, year, operating_income / nullif({_EV}, 0) AS ey FROM fin)",
    "l AS (SELECT fe.year, fe.ticker, unnest([{'f': 'ey', 'v': ey}, {'f': 'mom', 'v': mom}, {'f': 'dist', 'v': dist}]) AS x FROM fe JOIN fa ON fa.ticker = fe.ticker AND fa.year = fe.year)",
    "c AS (SELECT year, ticker, x.f AS factor, cume_dist() OVER (PARTITION BY year, x.f ORDER BY x.v) AS pct FROM l WHERE x.v IS NOT NULL)",
    "SELECT year, ticker, round(avg(CASE factor WHEN 'dist' THEN -0.5e0 * (1 - pct) WHEN 'ey' THEN 2 * pct ELSE pct END), 6) + 0e0 AS composite, count(*) AS n_factors FROM c GROUP BY 1, 2",
)


@query(_FACTORS)
def composite_rank(spark, sf):
    bars = wh.bars(spark, sf).select("ticker", F.year("date").alias("year"), "date", ind.momentum(60, 0).alias("mom"), ind.high_distance().alias("dist"))
    own = bars.groupBy("ticker", "year").agg(F.max_by("mom", "date").alias("mom"), F.max_by("dist", "date").alias("dist"))
    fin = wh.fundamentals(spark, sf).select("ticker", "year", fx.earnings_yield().alias("ey")).join(own, ["ticker", "year"])
    out = rk.composite(rk.unpivot_factors(fin, ["ey", "mom", "dist"], ["year", "ticker"]), ["year"], {"ey": 2.0, "dist": -0.5})
    return rounded(out.select("year", "ticker", "composite", "n_factors"), "composite", digits=6)


@query(
    S.with_(
        S.FIN, _RATIOS, _SCREEN,
        "q AS (SELECT sc.ticker, sc.year, s_name LIKE '%7%' AS ne, market_cap / nullif(shares, 0) AS price, market_cap / nullif(net_income, 0) AS pe, market_cap, shares * 1000 AS vol, 2.5e0 AS atr, CASE WHEN sc.year % 2 = 0 THEN net_income / net_income_prior - 1 END AS eps, revenue / revenue_prior - 1 AS rev, roe FROM sc JOIN supplier ON s_suppkey = ticker)",
        """SELECT ticker, year, CASE WHEN ne THEN 'non_equity' WHEN NOT coalesce(price >= 15, false) THEN 'price' WHEN NOT coalesce(pe > 0 AND pe <= 40, false) THEN 'pe' WHEN NOT coalesce(market_cap >= 150000, false) THEN 'market_cap'
        WHEN NOT coalesce(vol >= 1e6, false) THEN 'volume' WHEN NOT coalesce(atr >= 2, false) THEN 'atr' WHEN eps < 0 THEN 'eps_growth' WHEN rev < 0 THEN 'revenue_growth' WHEN roe < 0 THEN 'roe' END AS failed FROM q""",
    )
)
def gate_cascade(spark, sf):
    df = fx.screen(_fin(spark, sf)).join(wh.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), "s_name"), "ticker")
    c = F.col
    df = df.select(
        "ticker", "year", c("s_name").contains("7").alias("not_equity"), F.try_divide("market_cap", "shares").alias("price"), F.try_divide("market_cap", "net_income").alias("pe"), "market_cap", (c("shares") * 1000).alias("avg_volume"),
        F.lit(2.5).alias("atr_pct"), F.when(c("year") % 2 == 0, c("net_income") / c("net_income_prior") - 1).alias("eps_yoy"), (c("revenue") / c("revenue_prior") - 1).alias("revenue_yoy"), "roe",
    )
    return rk.gate_cascade(df, min_cap=150_000).select("ticker", "year", "failed")


# --- return series -----------------------------------------------------------------------------------

_RET = S.BARS + f",\nrr AS (SELECT * FROM (SELECT ticker, date, bar, close / lag(close) OVER ({S.W}) - 1 AS r FROM bars) WHERE r IS NOT NULL)"


@query(S.with_(_RET, "k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(r, 9)) AS p, greatest(1, floor(0.05e0 * count(*) OVER (PARTITION BY ticker))) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM rr)", "SELECT ticker, max(n) AS n, round(max(round(r, 9)), 9) + 0e0 AS var, round(avg(round(r, 9)) + 3.3e-10, 6) + 0e0 AS cvar FROM k WHERE p <= k GROUP BY ticker"))
def var_cvar(spark, sf):
    out = evl.tail_risk(wh.returns(wh.bars(spark, sf)), ["ticker"])
    return out.select("ticker", "n", r("var", 9).alias("var"), r(F.col("cvar") + S.OFF, 6).alias("cvar"))


_PERF = "count(r) AS n, round(exp(sum(ln(1 + r))) - 1, 6) + 0e0 AS total_return, round(pow(exp(sum(ln(1 + r))), 252e0 / count(r)) - 1, 6) + 0e0 AS cagr, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round((pow(exp(sum(ln(1 + r))), 252e0 / count(r)) - 1) / (stddev_samp(r) * sqrt(252)), 6) + 0e0 AS sharpe, round((pow(exp(sum(ln(1 + r))), 252e0 / count(r)) - 1) / (stddev_samp(r) * sqrt(252)) - sqrt(2 * ln(100)), 6) + 0e0 AS deflated_sharpe"


@query(S.with_(_RET, f"SELECT ticker, {_PERF} FROM (SELECT ticker, r - 0.001e0 AS r FROM rr) GROUP BY ticker"))
def cagr_sharpe(spark, sf):
    net = wh.returns(wh.bars(spark, sf)).withColumn("r", F.col("r") - 0.001)
    return rounded(evl.performance(net, ["ticker"]), "total_return", "cagr", "volatility", "sharpe", "deflated_sharpe", digits=6)


@query(S.with_(_RET, f"e AS (SELECT *, 100 * exp(sum(ln(1 + r)) OVER ({S.W} ROWS UNBOUNDED PRECEDING)) AS e FROM rr)", f"d AS (SELECT *, 1 - e / max(e) OVER ({S.W} ROWS UNBOUNDED PRECEDING) AS d FROM e)", "SELECT ticker, round(max(d), 6) AS max_drawdown, round(arg_max(e, date), 4) AS final_equity FROM d GROUP BY ticker"))
def max_drawdown(spark, sf):
    out = evl.drawdowns(wh.returns(wh.bars(spark, sf)))
    return out.select("ticker", r("max_drawdown", 6).alias("max_drawdown"), r("final_equity", 4).alias("final_equity"))


_BOOK = "bk AS (SELECT r_name AS book, s_suppkey AS ticker, abs(s_acctbal) / 20000 AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_SHARES = "sh AS (SELECT book, ticker, CASE WHEN s <= 0 THEN 1e0 / n WHEN s > 1 THEN weight / s ELSE weight END AS share, n FROM (SELECT *, sum(weight) OVER (PARTITION BY book) AS s, count(*) OVER (PARTITION BY book) AS n FROM bk))"


@query(
    S.with_(
        _RET, _BOOK, _SHARES,
        "pr AS (SELECT book, bar, sum(share * r) AS r, count(r) AS c, max(n) AS n FROM sh JOIN rr ON rr.ticker = sh.ticker WHERE n >= 2 GROUP BY 1, 2)",
        "k AS (SELECT book, round(r, 9) AS r, row_number() OVER (PARTITION BY book ORDER BY round(r, 9)) AS p, greatest(1, floor(0.05e0 * count(*) OVER (PARTITION BY book))) AS k, count(*) OVER (PARTITION BY book) AS m FROM pr WHERE c = n)",
        "SELECT book, max(m) AS n, round(max(r), 6) + 0e0 AS var, round(avg(r), 6) + 0e0 AS cvar FROM k WHERE p <= k GROUP BY book",
    )
)
def portfolio_cvar(spark, sf):
    weights = wh.sectors(spark, sf).join(wh.table(spark, sf, "supplier"), F.expr("ticker = s_suppkey")).select(F.col("sector").alias("book"), "ticker", (F.abs("s_acctbal") / 20000).alias("weight"))
    rows = wh.returns(wh.bars(spark, sf)).withColumnRenamed("bar", "place")
    out = evl.tail_risk(evl.portfolio_returns(evl.normalised_weights(weights), rows), ["book"])
    return rounded(out, "var", "cvar", digits=6)


_SPLITS = f"""ix AS (SELECT *, row_number() OVER ({S.W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM rr),
sp AS (SELECT ticker, s AS split, unnest(['train', 'test']) AS part FROM (SELECT DISTINCT ticker, n FROM ix), range(0, 100) q(s) WHERE s * 20 + 80 <= n),
ws AS (SELECT sp.ticker, split, part, count(*) AS n, (pow(exp(sum(ln(1 + r))), 252e0 / count(r)) - 1) / (stddev_samp(r) * sqrt(252)) AS sharpe FROM sp JOIN ix ON ix.ticker = sp.ticker AND CASE part WHEN 'train' THEN i >= split * 20 AND i < split * 20 + 60 ELSE i >= split * 20 + 60 AND i < split * 20 + 80 END GROUP BY 1, 2, 3)"""


@query(S.with_(_RET, _SPLITS, "SELECT ticker, split, part, n, round(sharpe, 5) + 0e0 AS sharpe FROM ws"))
def walk_forward(spark, sf):
    out = evl.walk_forward(wh.returns(wh.bars(spark, sf)))
    return rounded(out.select("ticker", "split", "part", "n", "sharpe"), "sharpe", digits=5)


@query(S.with_(_RET, _SPLITS, "wd AS (SELECT ticker, split, max(CASE part WHEN 'train' THEN round(sharpe, 9) END) AS a, max(CASE part WHEN 'test' THEN round(sharpe, 9) END) AS b FROM ws GROUP BY 1, 2)", "SELECT ticker, count(*) AS n_splits, round(max(a), 5) + 0e0 AS in_best, round(arg_max(b, {'a': a, 's': -split}), 5) + 0e0 AS oos_of_best, round(max(b), 5) + 0e0 AS oos_best, arg_max(b, {'a': a, 's': -split}) < -0.1e0 AS overfit FROM wd GROUP BY ticker"))
def pbo(spark, sf):
    out = evl.overfit(evl.walk_forward(wh.returns(wh.bars(spark, sf))))
    return rounded(out, "in_best", "oos_of_best", "oos_best", digits=5)


# --- weights and sizes -------------------------------------------------------------------------------

_SCORES = "vs AS (SELECT s_suppkey AS ticker, s_acctbal / 100 AS score, sector FROM supplier JOIN sectors ON s_suppkey = ticker)"
_W = "vw AS (SELECT ticker, score, sector, CASE WHEN score > 0 THEN score / (SELECT sum(greatest(score, 0)) FROM vs) ELSE 0 END AS weight FROM vs)"


def _weights(spark, sf):
    rows = wh.table(spark, sf, "supplier").join(wh.sectors(spark, sf), F.expr("s_suppkey = ticker")).select("ticker", (F.col("s_acctbal") / 100).alias("score"), "sector")
    return pf.value_weights(rows)


@query(S.with_(S.SECTORS, _SCORES, _W, "SELECT ticker, round(weight, 9) AS weight FROM vw"))
def value_weights(spark, sf):
    return rounded(_weights(spark, sf).select("ticker", "weight"), "weight", digits=9)


@query(S.with_(S.SECTORS, _SCORES, _W, "cl AS (SELECT *, least(weight, 0.02e0) AS w FROM vw)", "SELECT ticker, sector, round(w * CASE WHEN sum(w) OVER (PARTITION BY sector) > 0.15e0 THEN 0.15e0 / sum(w) OVER (PARTITION BY sector) ELSE 1 END, 9) AS capped FROM cl"))
def cap_adjust(spark, sf):
    out = pf.adjust_for_caps(_weights(spark, sf), name_cap=0.02, sector_cap=0.15)
    return rounded(out.select("ticker", "sector", "capped"), "capped", digits=9)


@query(S.with_(S.SECTORS, _SCORES, _W, "SELECT count(*) AS names, count_if(weight > 0) AS active, round(sum(weight), 4) AS allocated, count_if(weight > 0) >= 10 AS min_names_ok, list(round(weight, 4) ORDER BY weight DESC)[1:3] AS top3 FROM vw"))
def book_summary(spark, sf):
    return pf.summary(_weights(spark, sf))


_CONTRACT = S.with_(
    S.STEPS,
    S.decayed("steps", "v", "0.06 * log_return * log_return", 0.94, "var"),
    f"c1 AS (SELECT ticker, date, bar, close, CASE WHEN bar >= 2 THEN avg(true_range) OVER {S.over(14)} END AS atr, CASE WHEN bar >= 6 AND var > 0 THEN least(3, 0.15e0 / sqrt(var * 252)) ELSE 0 END AS vs FROM v)",
    "c2 AS (SELECT *, greatest(0.005e0, least(0.5e0, CASE WHEN atr > 0 THEN 2 * atr / close ELSE 0.02e0 END)) AS sp, CASE WHEN vs > 0 THEN greatest(0.2e0, least(1.5e0, vs)) ELSE 1 END AS vm, CASE WHEN bar % 3 = 0 THEN NULL ELSE bar % 10 / 20e0 + 0.45e0 END AS p, CASE WHEN bar % 4 = 0 THEN NULL ELSE bar % 7 / 10e0 END AS ds, CASE WHEN bar % 5 = 0 THEN NULL ELSE bar % 11 / 10e0 END AS ag FROM c1)",
    "SELECT ticker, date, round(sp, 6) AS stop_pct, round(close * (1 - sp), 7) AS stop_loss, round(greatest(0, least(0.3e0, least(greatest(0, least(0.3e0, greatest(0, least(1, 2 * greatest(0, least(1, coalesce(p, 0.5e0))) - 1)) * 0.25e0)), 0.01e0 / sp) * vm * coalesce(greatest(0, least(1, 1 - ds)), 1) * coalesce(greatest(0, least(1, ag)), 1))), 6) AS size_pct FROM c2",
)


def _contracts(spark, sf):
    df = ind.with_vol_scale(ind.with_steps(wh.bars(spark, sf))).withColumn("atr", ind.atr())
    bar = F.col("bar")
    df = df.withColumns({"calibrated_p": F.when(bar % 3 != 0, bar % 10 / 20.0 + 0.45), "distribution_score": F.when(bar % 4 != 0, bar % 7 / 10.0), "agreement": F.when(bar % 5 != 0, bar % 11 / 10.0), "catalyst_scale": F.lit(None).cast("double")})
    return pf.position_contract(df)


@query(_CONTRACT)
def kelly_contract(spark, sf):
    out = _contracts(spark, sf)
    return out.select("ticker", "date", r("stop_pct", 6).alias("stop_pct"), r("stop_loss", 7).alias("stop_loss"), r("size_pct", 6).alias("size_pct"))


@query(
    S.with_(
        S.STEPS,
        f"t0 AS (SELECT ticker, date, close AS p1, CASE WHEN bar >= 2 THEN avg(true_range) OVER {S.over(14)} END AS a FROM steps)",
        "t1 AS (SELECT *, p1 - a AS p2, p1 - 2 * a AS p3, p1 - 2 * a - 1.5e0 * a AS stop, 0.3e0 * p1 + 0.3e0 * (p1 - a) + 0.4e0 * (p1 - 2 * a) AS en FROM t0)",
        "t2 AS (SELECT *, coalesce(a > 0 AND p1 > 0 AND stop > 0 AND en - stop > 0, false) AS valid, CAST(floor(1500e0 / CASE WHEN a > 0 AND stop > 0 THEN en - stop END) AS BIGINT) AS sh FROM t1)",
        "t3 AS (SELECT *, CAST(floor(sh * 0.3e0) AS BIGINT) AS n1, CAST(floor(sh * 0.3e0) AS BIGINT) AS n2 FROM t2)",
        "SELECT ticker, date, valid, sh AS total_shares, n1, n2, sh - n1 - n2 AS n3, round((n1 * (p1 - stop) + n2 * (p2 - stop) + (sh - n1 - n2) * (p3 - stop)) / 100000 + 3.3e-10, 6) AS capital_at_risk_pct, round((n1 * p1 + n2 * p2 + (sh - n1 - n2) * p3) / 100000 + 3.3e-10, 6) AS peak_deployed_pct FROM t3",
    )
)
def tranche_plan(spark, sf):
    df = pf.tranche_plan(ind.with_steps(wh.bars(spark, sf)).withColumn("atr", ind.atr()))
    return df.select("ticker", "date", "valid", "total_shares", "n1", "n2", "n3", r(F.col("capital_at_risk_pct") + S.OFF, 6).alias("capital_at_risk_pct"), r(F.col("peak_deployed_pct") + S.OFF, 6).alias("peak_deployed_pct"))


@query(
    S.with_(
        "g AS (SELECT o_orderkey AS k, o_orderkey % 41 / 100e0 AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 29 / 100e0 END AS bk, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 37 / 1000e0 END AS cv, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 13 / 100e0 END AS dd, o_orderkey % 23 / 100e0 AS sec, o_orderkey % 101 = 0 AS halted, o_orderkey % 11 = 0 AS nosize FROM orders)",
        "v AS (SELECT *, CASE WHEN nosize THEN NULL ELSE s END AS z FROM g)",
        "x AS (SELECT *, list_filter([CASE WHEN z > 0.3e0 THEN 'size' END, CASE WHEN bk + z > 0.45e0 THEN 'book' END, CASE WHEN cv > 0.03e0 THEN 'cvar' END, CASE WHEN dd > 0.1e0 THEN 'drawdown' END, CASE WHEN sec + CASE WHEN sec > 0 THEN z ELSE 0 END > 0.35e0 THEN 'sector' END], lambda t: t IS NOT NULL) AS re, list_filter([CASE WHEN z >= 0.9e0 * 0.3e0 AND NOT z > 0.3e0 THEN 'size' END, CASE WHEN cv >= 0.7e0 * 0.03e0 AND NOT cv > 0.03e0 THEN 'cvar' END], lambda t: t IS NOT NULL) AS tc FROM v)",
        "SELECT k AS ord, CASE WHEN halted THEN 'REJECT' WHEN z IS NULL THEN 'PASS' WHEN len(re) > 0 THEN 'REJECT' WHEN len(tc) > 0 THEN 'WARN' ELSE 'PASS' END AS governor, CASE WHEN halted THEN 'halt' WHEN z IS NULL THEN '' ELSE array_to_string(re, ',') END AS reasons FROM x",
    )
)
def risk_govern(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("double")
    df = wh.table(spark, sf, "orders").select(
        k.alias("ord"), F.when(k % 11 != 0, k % 41 / 100.0).alias("size_pct"), F.when(k % 3 != 0, k % 29 / 100.0).alias("book_total_pct"), F.when(k % 5 != 0, k % 37 / 1000.0).alias("cvar_pct"), F.when(k % 7 != 0, k % 13 / 100.0).alias("drawdown_pct"),
        (k % 23 / 100.0).alias("sector_pct"), none.alias("capital_at_risk_pct"), none.alias("risk_cap_pct"), (k % 101 == 0).alias("halted"),
    )
    return pf.govern(df).select("ord", "governor", F.array_join("reasons", ",").alias("reasons"))


# --- ledgers -----------------------------------------------------------------------------------------

_BUCKET = "CASE WHEN confidence < 0.5e0 THEN 0e0 WHEN confidence < 0.6e0 THEN 0.5e0 WHEN confidence < 0.7e0 THEN 0.6e0 WHEN confidence < 0.8e0 THEN 0.7e0 WHEN confidence < 1.01e0 THEN 0.8e0 END"


@query(S.with_(S.OUTCOMES, f"SELECT {_BUCKET} AS bucket, count(*) AS n, count_if(delta_r > 0) AS won, round(count_if(delta_r > 0) / CAST(count(*) AS DOUBLE), 6) AS win_rate FROM outcomes GROUP BY 1"))
def calibration_buckets(spark, sf):
    return rounded(lg.fit_buckets(wh.outcomes(spark, sf)), "win_rate", digits=6)


@query(S.with_(S.OUTCOMES, f"b AS (SELECT *, {_BUCKET} AS bucket FROM outcomes)", "t AS (SELECT bucket, count(*) AS n, count_if(delta_r > 0) / CAST(count(*) AS DOUBLE) AS w FROM b GROUP BY 1)", "SELECT ord, round(CASE WHEN n >= 5 THEN confidence + least(1, n / 10e0) * (w - confidence) ELSE confidence END, 6) AS calibrated_p FROM b JOIN t USING (bucket)"))
def calibrated_confidence(spark, sf):
    entries = wh.outcomes(spark, sf)
    return rounded(lg.calibrated(entries, lg.fit_buckets(entries)).select("ord", "calibrated_p"), "calibrated_p", digits=6)


@query(S.with_(S.OUTCOMES, "w AS (SELECT *, pow(0.5e0, greatest(0, date_diff('day', date, DATE '2001-08-01')) / 30e0) AS w FROM outcomes)", "SELECT analyst, count_if(delta_r > 0) AS hits, count(*) AS total, round(sum(CASE WHEN delta_r > 0 THEN w ELSE 0 END) / sum(w), 6) AS score FROM w GROUP BY 1"))
def analyst_half_life(spark, sf):
    return rounded(lg.analyst_scores(wh.outcomes(spark, sf), "2001-08-01"), "score", digits=6)


@query(S.with_(S.OUTCOMES, "SELECT analyst, count(*) AS total, count_if(delta_r > 0) AS wins, round(count_if(delta_r > 0) / CAST(count(*) AS DOUBLE), 6) AS win_rate, round(avg(delta_r), 6) + 0e0 AS mean_alpha FROM outcomes GROUP BY GROUPING SETS ((), (analyst))"))
def ledger_rollup(spark, sf):
    return rounded(lg.metrics(wh.outcomes(spark, sf)), "win_rate", "mean_alpha", digits=6)


@query(S.with_(S.OUTCOMES, "p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ord DESC) AS p FROM outcomes)", "SELECT ticker, count(*) AS n, round(count_if(delta_r > 0) / CAST(count(*) AS DOUBLE), 6) AS win_rate, round(avg(delta_r), 6) + 0e0 AS mean_alpha FROM p WHERE p <= 5 GROUP BY ticker"))
def track_record(spark, sf):
    return rounded(lg.track_record(wh.outcomes(spark, sf), 5), "win_rate", "mean_alpha", digits=6)


@query(S.with_(S.OUTCOMES, "v AS (SELECT ticker, CASE rating WHEN 'Buy' THEN 1 WHEN 'Overweight' THEN 0.5e0 WHEN 'Hold' THEN 0 WHEN 'Underweight' THEN -0.5e0 ELSE -1 END AS v FROM outcomes)", "a AS (SELECT ticker, count(v) AS n_valid, CASE WHEN count(v) >= 2 THEN 1 - (max(v) - min(v)) / 2 END AS agreement FROM v GROUP BY 1)", "SELECT *, CASE WHEN agreement IS NULL THEN 'unknown' WHEN agreement >= 0.7e0 THEN 'high' ELSE 'low' END AS consensus FROM a"))
def agreement(spark, sf):
    return lg.agreement(wh.outcomes(spark, sf), ["ticker"])


@query(S.with_(S.OUTCOMES, "c AS (SELECT ticker, rating, count(*) AS c, min(ord) AS o FROM outcomes GROUP BY 1, 2)", "SELECT ticker, CAST(sum(c) AS BIGINT) AS n, max(c) / CAST(sum(c) AS DOUBLE) AS overlap, CASE WHEN max(c) / CAST(sum(c) AS DOUBLE) < 0.5e0 THEN 'mixed' ELSE arg_max(rating, {'c': c, 'o': -o}) END AS verdict FROM c GROUP BY ticker"))
def consensus(spark, sf):
    return lg.consensus(wh.outcomes(spark, sf).withColumnRenamed("rating", "verdict"), ["ticker"])


@query(S.with_(S.OUTCOMES, "SELECT ticker, round(coalesce(sum(CASE WHEN ord % 4 <> 0 THEN coalesce(CASE WHEN ord % 3 <> 0 THEN confidence END, 1) * delta_r END) / nullif(sum(CASE WHEN ord % 4 <> 0 THEN coalesce(CASE WHEN ord % 3 <> 0 THEN confidence END, 1) END), 0), 0), 6) + 0e0 AS blended FROM outcomes GROUP BY 1"))
def blended_score(spark, sf):
    df = wh.outcomes(spark, sf).select("ticker", F.when(F.col("ord") % 4 != 0, F.col("delta_r")).alias("score"), F.when(F.col("ord") % 3 != 0, F.col("confidence")).alias("weight"))
    return rounded(lg.blended_score(df, ["ticker"]), "blended", digits=6)


@query(
    S.with_(
        S.OUTCOMES,
        "SELECT count(*) AS trades, count_if(confidence > 0.5e0) AS candidates, count_if(o_orderstatus = 'F') AS wins, count_if(o_orderstatus = 'O') AS losses, count_if(o_orderstatus = 'F') / CAST(nullif(count_if(o_orderstatus IN ('F', 'O')), 0) AS DOUBLE) AS win_rate, round(avg(CASE WHEN ord % 5 <> 0 THEN ord % 4 END), 2) AS avg_rr, count_if(ord % 9 = 0) AS fomo_count, round(count_if(ord % 2 = 0 AND ord % 6 = 0) / CAST(nullif(count_if(ord % 2 = 0), 0) AS DOUBLE), 3) AS pass_rvol, round(count_if(ord % 10 = 0) / CAST(count(*) AS DOUBLE), 3) AS pass_gap FROM outcomes",
    )
)
def journal_stats(spark, sf):
    o = F.col("ord")
    rows = wh.outcomes(spark, sf).select(
        F.map_from_arrays(F.array(F.lit("rvol"), F.lit("gap")), F.array(F.when(o % 2 == 0, o % 6 == 0), o % 10 == 0)).alias("pillars"),
        F.struct((F.col("confidence") > 0.5).alias("candidate"), F.when(o % 5 != 0, (o % 4).cast("double")).alias("rr")).alias("pullback"),
        F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").alias("exit_class"), (o % 9 == 0).alias("fomo"),
    )
    return lg.journal_stats(rows, ("rvol", "gap"))


@query(
    S.with_(
        S.BARS, S.BENCH, S.OUTCOMES,
        "dec AS (SELECT ord, ticker, date FROM outcomes)",
        "ent AS (SELECT d.ord, d.ticker, d.date, b.bar AS eb FROM dec d ASOF LEFT JOIN bars b ON b.ticker = d.ticker AND d.date <= b.date)",
        "mx AS (SELECT ticker, max(bar) AS mb FROM bars GROUP BY 1)",
        "SELECT e.ord, e.ticker, e.date, i.date AS entry_date, CASE WHEN o.bar > i.bar THEN CAST(o.bar - i.bar AS BIGINT) END AS held, round(CASE WHEN o.bar > i.bar THEN o.close / i.close - 1 END, 6) + 0e0 AS raw, round(CASE WHEN o.bar > i.bar THEN o.close / i.close - 1 END - (k1.close / k0.close - 1), 6) + 0e0 AS alpha FROM ent e LEFT JOIN mx ON mx.ticker = e.ticker LEFT JOIN bars i ON i.ticker = e.ticker AND i.bar = e.eb LEFT JOIN bars o ON o.ticker = e.ticker AND o.bar = least(e.eb + 5, mx.mb) LEFT JOIN bench k0 ON k0.date = i.date LEFT JOIN bench k1 ON k1.date = o.date",
    )
)
def pending_outcome_resolution(spark, sf):
    pending = wh.outcomes(spark, sf).select("ticker", "date", "ord")
    out = lg.resolve_pending(pending, wh.bars(spark, sf), wh.benchmark(spark, sf))
    return rounded(out.select("ord", "ticker", "date", "entry_date", "held", "raw", "alpha"), "raw", "alpha", digits=6)


@query(S.with_(S.OUTCOMES, "d AS (SELECT ord, ticker, date, rating, ord % 3 = 0 AS pending FROM outcomes)", "SELECT * FROM d WHERE pending UNION ALL (SELECT * FROM d WHERE NOT pending ORDER BY date DESC, ord DESC LIMIT 100)"))
def rotation(spark, sf):
    return lg.rotate(wh.outcomes(spark, sf).select("ord", "ticker", "date", "rating", (F.col("ord") % 3 == 0).alias("pending")), 100)


@query(S.with_(S.OUTCOMES, "d AS (SELECT ord, ticker, date, rating, ord % 3 = 0 AS pending FROM outcomes)", "SELECT *, 'same' AS kind FROM (SELECT * FROM d WHERE NOT pending AND ticker = 7 ORDER BY date DESC, ord DESC LIMIT 5) UNION ALL SELECT *, 'cross' FROM (SELECT * FROM d WHERE NOT pending AND ticker <> 7 ORDER BY date DESC, ord DESC LIMIT 3)"))
def past_context(spark, sf):
    return lg.past_context(wh.outcomes(spark, sf).select("ord", "ticker", "date", "rating", (F.col("ord") % 3 == 0).alias("pending")), 7)


@query(S.with_(S.OUTCOMES, "SELECT ticker, max(ord) AS last_ord FROM outcomes GROUP BY 1 ORDER BY 2 DESC LIMIT 10"))
def recent_tickers(spark, sf):
    return lg.recent_tickers(wh.outcomes(spark, sf))


@query(
    S.with_(
        S.OUTCOMES,
        "d AS (SELECT ord, ticker, date, rating, ord % 3 = 0 AS pending, CASE WHEN ord % 3 <> 0 THEN delta_r END AS raw FROM outcomes)",
        "o AS (SELECT ticker, date, max(delta_r) AS n FROM outcomes WHERE ord % 6 = 0 GROUP BY 1, 2)",
        "SELECT ord, d.ticker, d.date, rating, pending AND n IS NULL AS pending, CASE WHEN pending AND n IS NOT NULL THEN n ELSE raw END AS raw FROM d LEFT JOIN o ON o.ticker = d.ticker AND o.date = d.date",
    )
)
def merge_outcomes(spark, sf):
    from ..sources import sinks

    d = wh.outcomes(spark, sf)
    extra = {c: F.lit(None).cast(t) for c, t in (("alpha", "double"), ("holding_days", "int"), ("reflection", "string"))}
    decisions = d.select("ord", "ticker", "date", "rating", (F.col("ord") % 3 == 0).alias("pending"), F.when(F.col("ord") % 3 != 0, F.col("delta_r")).alias("raw")).withColumns(extra)
    got = d.where("ord % 6 = 0").groupBy("ticker", "date").agg(F.max("delta_r").alias("raw")).withColumns(extra)
    return sinks.with_outcomes(decisions, got).select("ord", "ticker", "date", "rating", "pending", "raw")


