"""Queries on events, catalysts, order flow, sentiment, text and vendor tables, and the imbalance stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import events as ev
from ..operators import markets as mk
from ..operators import ranking as rk
from ..operators import sentiment as st
from ..sources import routing
from ..sources import warehouse as wh
from ..streaming import frame_log, noi
from . import sql as S
from .registry import query, r, rounded

DAYS = ["1997-03-01", "1998-06-15", "1999-09-30"]
_DAYS = "td AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in DAYS) + "]) AS trade_date)"
_CAL = "cal AS (SELECT ord, ticker, date, round(o_totalprice * 100 / (delta_r + 1) / 100, 2) AS eps_estimate, CASE WHEN ord % 7 = 0 THEN NULL ELSE o_totalprice END AS eps_actual, CASE analyst WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS star FROM outcomes)"


def _calendar(spark, sf):
    o = wh.outcomes(spark, sf)
    star = F.when(F.col("analyst") == "1-URGENT", "HIGH").when(F.col("analyst") == "2-HIGH", "MEDIUM").otherwise("LOW")
    return o.select("ord", "ticker", "date", F.round(F.col("o_totalprice") * 100 / (F.col("delta_r") + 1) / 100, 2).alias("eps_estimate"), F.when(F.col("ord") % 7 != 0, F.col("o_totalprice")).alias("eps_actual"), star.alias("star"))


@query(S.with_(S.OUTCOMES, _CAL, _DAYS, "n AS (SELECT trade_date, ticker, arg_min({'ord': ord, 'date': date}, {'d': date_diff('day', trade_date, date), 'o': ord}) AS b FROM cal, td WHERE date_diff('day', trade_date, date) BETWEEN 0 AND 60 GROUP BY 1, 2)", "SELECT trade_date, ticker, b.date AS date, CAST(date_diff('day', trade_date, b.date) AS INT) AS days_until, b.ord AS ord FROM n"))
def next_earnings_interval(spark, sf):
    return ev.next_event(_calendar(spark, sf).select("ticker", "date", "ord"), DAYS)


_SURPRISE = "sp AS (SELECT *, CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) END AS s FROM cal)"
_LAST = "la AS (SELECT ticker, max(date) AS date, arg_max(s, {'d': date, 'o': -ord}) AS s FROM sp WHERE s IS NOT NULL GROUP BY 1)"


@query(S.with_(S.OUTCOMES, _CAL, _SURPRISE, _LAST, "SELECT ticker, date, round(s, 6) + 0e0 AS surprise, CASE WHEN abs(s) < 1e-9 THEN 'flat' WHEN s > 0 THEN 'beat' ELSE 'miss' END AS side FROM la"))
def last_surprise(spark, sf):
    return rounded(ev.last_surprise(_calendar(spark, sf)), "surprise", digits=6)


@query(S.with_(S.BARS, S.OUTCOMES, "SELECT o.ord, o.ticker, o.date AS event_date, b.date AS bar_date, b.close AS bar_close FROM outcomes o ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND o.date <= b.date"))
def print_bar_asof(spark, sf):
    events = wh.outcomes(spark, sf).select("ticker", F.col("date").alias("event_date"), "ord")
    return ev.asof_forward(events, wh.bars(spark, sf), ("date", "close")).select("ord", "ticker", "event_date", "bar_date", "bar_close")


@query(
    S.with_(
        S.BARS,
        f"d AS (SELECT ticker, date, close / lag(close) OVER ({S.W}) - 1 AS r0, volume / nullif(avg(volume) OVER {S.between(20, 1)}, 0) AS vr, count(*) OVER {S.ahead(1, 4)} AS n, max(high) OVER {S.ahead(1, 4)} AS rh, max(high) OVER {S.ahead(1, 3)} AS ph, last_value(close) OVER {S.ahead(1, 4)} AS lc FROM bars)",
        "SELECT ticker, date, coalesce(r0 > 0 AND vr >= 2.5e0, false) AS gap, CASE WHEN n >= 2 THEN lc > rh END AS breakout, CASE WHEN n >= 2 THEN lc > ph END AS breakout_prior, CASE WHEN r0 IS NULL OR vr IS NULL OR n = 0 THEN 'no-data' WHEN NOT coalesce(r0 > 0 AND vr >= 2.5e0, false) THEN 'no-gap' WHEN n >= 2 AND lc > rh THEN 'setup' ELSE 'consolidating' END AS verdict FROM d",
    )
)
def pead_play(spark, sf):
    return ev.post_earnings(ev.with_drift_window(wh.bars(spark, sf))).select("ticker", "date", "gap", "breakout", "breakout_prior", "verdict")


@query(S.with_(S.OUTCOMES, _CAL, _DAYS, "SELECT trade_date, count(ord) AS count_high, CAST(min(date_diff('day', trade_date, date)) AS INT) AS min_days FROM td LEFT JOIN cal ON star = 'HIGH' AND date_diff('day', trade_date, date) BETWEEN 0 AND 3 GROUP BY 1"))
def macro_imminence(spark, sf):
    return ev.macro_imminence(_calendar(spark, sf), DAYS)


@query(S.with_(S.OUTCOMES, _DAYS, "f AS (SELECT trade_date, date_diff('day', trade_date, date) AS d, max(confidence) AS p FROM outcomes, td WHERE date_diff('day', trade_date, date) BETWEEN 0 AND 14 GROUP BY 1, 2)", "SELECT trade_date, CAST(min(d) AS INT) AS days_until, arg_min(p, d) AS modal_prob FROM f GROUP BY 1"))
def fed_modal(spark, sf):
    rows = wh.outcomes(spark, sf).select(F.col("date").alias("meeting_date"), F.col("confidence").alias("probability"))
    return ev.fed_imminence(rows, DAYS)


@query(
    S.with_(
        "c AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 12 END AS du, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 / 100e0 END AS im, o_orderkey % 5 = 0 AS missed, o_orderkey % 6 // 4 AS mc, CASE WHEN o_orderkey % 8 = 0 THEN 3 END AS fd, CASE WHEN o_orderkey % 7 = 0 THEN 0.7e0 END AS bs FROM orders)",
        "n AS (SELECT *, coalesce(du BETWEEN 0 AND 5, false) AS near, coalesce(du BETWEEN 0 AND 1, false) AS block, bs IS NOT NULL AND mc = 0 AND fd IS NULL AS back FROM c)",
        """SELECT ord, round(greatest(0.25e0, least(1, CASE WHEN near THEN CASE WHEN im > 0 THEN 1 / (1 + im / 0.02e0 * 3) ELSE 0.5e0 END ELSE 1 END * CASE WHEN near AND missed THEN 0.5e0 ELSE 1 END * CASE WHEN mc > 0 THEN 0.6e0 ELSE 1 END * CASE WHEN fd IS NOT NULL THEN 0.6e0 ELSE 1 END * CASE WHEN back THEN bs ELSE 1 END)), 6) AS scale,
        CASE WHEN block THEN 'earnings-hard-block' WHEN near THEN 'earnings-window' WHEN mc > 0 THEN 'macro-catalyst' WHEN fd IS NOT NULL THEN 'fed-catalyst' WHEN back THEN 'macro-backdrop' ELSE 'no-imminent-catalyst' END AS verdict, block AS hard_block FROM n""",
    )
)
def catalyst_scale(spark, sf):
    k = F.col("o_orderkey")
    df = wh.table(spark, sf, "orders").select(
        k.alias("ord"), F.when(k % 3 != 0, k % 12).alias("days_until"), F.when(k % 4 != 0, k % 9 / 100.0).alias("implied_move"), F.when(k % 5 == 0, "miss").otherwise("beat").alias("last_side"),
        F.floor(k % 6 / 4).alias("macro_count"), F.when(k % 8 == 0, 3).alias("fed_days"), F.when(k % 7 == 0, 0.7).alias("backdrop_scale"),
    )
    return rounded(ev.catalyst_scale(df, block_days=1).select("ord", "scale", "verdict", "hard_block"), "scale", digits=6)


@query(
    "WITH v AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 70 / 10e0 END AS hy, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 180 / 10e0 END AS ccc, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 61 / 10e0 END AS bb FROM orders), "
    "b AS (SELECT ord, greatest(CASE WHEN hy < 3 THEN 0 WHEN hy < 4.5e0 THEN 1 WHEN hy <= 5.5e0 THEN 2 WHEN hy IS NOT NULL THEN 3 END, CASE WHEN ccc < 8 THEN 0 WHEN ccc < 11 THEN 1 WHEN ccc <= 15 THEN 2 WHEN ccc IS NOT NULL THEN 3 END, CASE WHEN bb < 3 THEN 0 WHEN bb < 4.5e0 THEN 1 WHEN bb <= 5.5e0 THEN 2 WHEN bb IS NOT NULL THEN 3 END) AS w FROM v) "
    "SELECT ord, coalesce(['low', 'moderate', 'high', 'severe'][w + 1], 'unknown') AS level, coalesce([1e0, 0.85e0, 0.7e0, 0.5e0][w + 1], 1e0) AS scale FROM b"
)
def credit_stress(spark, sf):
    k = F.col("o_orderkey")
    out = ev.credit_stress(F.when(k % 5 != 0, k % 70 / 10.0), F.when(k % 3 != 0, k % 180 / 10.0), F.when(k % 2 == 0, k % 61 / 10.0))
    return wh.table(spark, sf, "orders").select(k.alias("ord"), out["level"].alias("level"), out["scale"].alias("scale"))


_TIER = {"super": "purchase", "big": "signup", "mid": "view", "small": "click"}
_FLOW = ", ".join(f"sum(CASE WHEN event_type = '{e}' AND ord % 3 <> 0 THEN round(value * 100) END) AS {t}_in, sum(CASE WHEN event_type = '{e}' AND ord % 3 = 0 THEN round(value * 100) END) AS {t}_out" for t, e in _TIER.items())
_Z = lambda t, s: f"coalesce({t}_{s}, 0)"
_N = {t: f"({_Z(t, 'in')} - {_Z(t, 'out')})" for t in _TIER}
_SH = lambda t: f"CASE WHEN {_Z(t, 'in')} + {_Z(t, 'out')} > 0 THEN {_Z(t, 'out')} / ({_Z(t, 'in')} + {_Z(t, 'out')}) ELSE 0.5e0 END"


@query(
    S.with_(
        S.SOCIAL,
        f"fl AS (SELECT ticker, {_FLOW} FROM social GROUP BY 1)",
        "wk AS (SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS week, sum(CASE WHEN ord % 3 <> 0 THEN round(value * 100) ELSE -round(value * 100) END) AS net FROM social GROUP BY 1, 2)",
        "pw AS (SELECT ticker, list(net ORDER BY week) AS nets FROM wk GROUP BY 1)",
        f"s AS (SELECT fl.ticker, {_N['super']} + {_N['big']} AS inst, {_N['mid']} + {_N['small']} AS ret, round(({_SH('super')}) * 0.6e0 + ({_SH('big')}) * 0.4e0, 4) AS dist, CASE fl.ticker % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS dir, ({' + '.join(f'({n} < -1e-9)::INT' for n in _N.values())}) AS lo, ({' + '.join(f'({n} > 1e-9)::INT' for n in _N.values())}) AS hi, nets FROM fl JOIN pw ON pw.ticker = fl.ticker)",
        "z AS (SELECT *, CASE WHEN inst > 1e-9 THEN CASE WHEN dir <> 'up' THEN 'silent_accumulation' ELSE 'aligned' END WHEN inst < -1e-9 THEN CASE WHEN dir <> 'down' THEN 'distribution_into_strength' ELSE 'aligned' END ELSE 'neutral_flow' END AS divergence, CASE WHEN lo = 4 THEN 'all_four_negative' WHEN hi = 4 THEN 'all_four_positive' ELSE 'mixed' END AS alignment, list_avg(list_transform(nets[-3:], lambda x: abs(x))) AS m FROM s)",
        "SELECT ticker, inst AS institutional_net, ret AS retail_net, dist AS distribution_score, divergence, alignment, CASE WHEN m > 0 THEN CASE WHEN abs(inst) <= 0.5e0 * m THEN 'exhaustion_candidate' ELSE 'active' END ELSE 'unknown' END AS exhaustion, CASE WHEN dist >= 0.7e0 OR divergence = 'distribution_into_strength' OR alignment = 'all_four_negative' THEN 'distribution' ELSE 'ok' END AS flag FROM z",
    )
)
def orderflow_summary(spark, sf):
    s = wh.social(spark, sf).withColumn("v", F.round(F.col("value") * 100))
    put = lambda e, out: F.sum(F.when((F.col("event_type") == e) & ((F.col("ord") % 3 == 0) == F.lit(out)), F.col("v")))
    flow = s.groupBy("ticker").agg(*(put(e, side == "out").alias(f"{t}_{side}") for t, e in _TIER.items() for side in ("in", "out")))
    weeks = mk.weekly_flow(s.select("ticker", "ts", F.when(F.col("ord") % 3 != 0, F.col("v")).otherwise(-F.col("v")).alias("net")))
    nets = weeks.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("week", "net"))).alias("w"))  # weeks of one ticker
    side = F.when(F.col("ticker") % 3 == 0, "up").when(F.col("ticker") % 3 == 1, "down").otherwise("flat")
    df = flow.join(nets, "ticker").withColumns({"direction": side, "prior_nets": F.col("w.net")})
    return ev.flow_summary(df).select("ticker", "institutional_net", "retail_net", "distribution_score", "divergence", "alignment", "exhaustion", "flag")


# --- sentiment ---------------------------------------------------------------------------------------

_SC = "CASE label WHEN 'bullish' THEN 1e0 WHEN 'bearish' THEN -1e0 ELSE 0e0 END"


@query(S.with_(S.SOCIAL, f"SELECT ticker, count(*) AS n, round(sum({_SC} * pow(0.5e0, age_days / 7e0) * greatest(0, credibility)) / nullif(sum(pow(0.5e0, age_days / 7e0) * greatest(0, credibility)), 0), 6) + 0e0 AS sentiment FROM social GROUP BY 1"))
def weighted_sentiment(spark, sf):
    return rounded(st.weighted_sentiment(wh.social(spark, sf), ["ticker"]), "sentiment", digits=6)


@query(S.with_(S.SOCIAL, "p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, ord DESC) AS p FROM social)", "SELECT ticker, count_if(label = 'bullish') AS bullish, count_if(label = 'bearish') AS bearish, count_if(label = 'neutral') AS unlabeled, round((count_if(label = 'bullish') - count_if(label = 'bearish')) / CAST(nullif(count_if(label <> 'neutral'), 0) AS DOUBLE), 4) AS score FROM p WHERE p <= 30 GROUP BY 1"))
def social_score(spark, sf):
    return st.latest_counts(wh.social(spark, sf))


_DAILY = "dl AS (SELECT ticker, CAST(ts AS DATE) AS date, count(*) AS n, round((count_if(label = 'bullish') - count_if(label = 'bearish')) / CAST(nullif(count_if(label <> 'neutral'), 0) AS DOUBLE), 4) AS score FROM social GROUP BY 1, 2)"


@query(S.with_(S.SOCIAL, _DAILY, "i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM dl WHERE score IS NOT NULL)", f"SELECT ticker, date, score, round(CASE WHEN i >= 3 THEN regr_slope(score, i) OVER {S.over(5)} END, 6) + 0e0 AS velocity FROM i"))
def sentiment_velocity(spark, sf):
    return rounded(st.velocity(st.daily_scores(wh.social(spark, sf))).select("ticker", "date", "score", "velocity"), "velocity", digits=6)


@query(
    S.with_(
        S.SOCIAL, _DAILY,
        f"i AS (SELECT *, count(*) OVER {S.between(30, 1)} AS c, avg(score) OVER {S.between(30, 1)} AS m, stddev_pop(score) OVER {S.between(30, 1)} AS sd FROM dl WHERE score IS NOT NULL)",
        "SELECT ticker, date, score, round(CASE WHEN c < 8 THEN NULL WHEN sd <= 1e-9 THEN 0 ELSE (score - m) / sd END, 6) + 0e0 AS surprise_z FROM i",
    )
)
def surprise_z(spark, sf):
    return rounded(st.surprise(st.daily_scores(wh.social(spark, sf))).select("ticker", "date", "score", "surprise_z"), "surprise_z", digits=6)


@query(S.with_(S.SOCIAL, _DAILY, "p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS p FROM dl)", "SELECT ticker, round(sum(CASE WHEN p = 1 THEN n END) / greatest(1, coalesce(avg(CASE WHEN p > 1 THEN n END), 1)), 6) AS mention_volume FROM p GROUP BY 1"))
def mention_volume(spark, sf):
    return rounded(st.mention_volume(st.daily_scores(wh.social(spark, sf))), "mention_volume", digits=6)


# --- text --------------------------------------------------------------------------------------------

_NUMBERS = "CASE o_orderkey % 8 WHEN 0 THEN '$' || o_totalprice || 'M' WHEN 1 THEN '-' || o_totalprice WHEN 2 THEN '1,234.5' || 'k' WHEN 3 THEN 'n/a' WHEN 4 THEN '' WHEN 5 THEN '+2.5e3' WHEN 6 THEN o_orderkey || 'B' ELSE ' 7 T' END"


@query(
    "WITH a AS (SELECT o_orderkey AS ord, trim(" + _NUMBERS.replace("o_totalprice", "CAST(o_totalprice AS DECIMAL(18, 2))") + ") AS t FROM orders), "
    "b AS (SELECT *, CASE WHEN t LIKE '-%' THEN -1e0 ELSE 1e0 END AS s, regexp_replace(t, '^[-+]+', '') AS u FROM a), "
    "c AS (SELECT *, CASE lower(right(u, 1)) WHEN 't' THEN 1e12 WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1e0 END AS f, regexp_extract(CASE WHEN lower(right(u, 1)) IN ('t', 'b', 'm', 'k') THEN left(u, len(u) - 1) ELSE u END, '[-+]?[0-9][0-9,]*(\\.[0-9]+)?([eE][-+]?[0-9]+)?') AS d FROM b) "
    "SELECT ord, s * f * TRY_CAST(replace(d, ',', '') AS DOUBLE) AS value FROM c"
)
def first_number_parse(spark, sf):
    t = F.expr(_NUMBERS.replace("o_totalprice", "cast(o_totalprice as decimal(18, 2))"))
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), text.first_number(t).alias("value"))


_PCT = "CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 100) || '.5%' WHEN 1 THEN '-5.2%' WHEN 2 THEN '--' WHEN 3 THEN 'n/a' WHEN 4 THEN 'abc%' ELSE ' 7 ' END"


@query(f"SELECT o_orderkey AS ord, TRY_CAST(rtrim(trim({_PCT}), '%') AS DOUBLE) / 100 AS fraction FROM orders")
def percent_parse(spark, sf):
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), text.percent_fraction(F.expr(_PCT)).alias("fraction"))


_PROSE = "CASE o_orderkey % 7 WHEN 0 THEN 'My view.\\nFinal Rating: **Sell** now' WHEN 1 THEN 'We would buy; hold later' WHEN 2 THEN 'No words' WHEN 3 THEN 'rating - overweight, not sell' WHEN 4 THEN 'Say *Underweight*. Rating: n/a' WHEN 5 THEN NULL ELSE 'holding, BUY:' END"
_LABEL = "CASE o_orderkey % 7 WHEN 0 THEN 'Sell' WHEN 1 THEN 'Hold' WHEN 2 THEN 'Hold' WHEN 3 THEN 'Overweight' WHEN 4 THEN 'Underweight' WHEN 5 THEN 'Hold' ELSE 'Buy' END"


@query(f"SELECT o_orderkey AS ord, {_LABEL} AS rating FROM orders")
def rating_parse(spark, sf):
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), text.rating(F.expr(_PROSE)).alias("rating"))


_PAY = "CASE n_nationkey % 4 WHEN 0 THEN '(FY 2025, currency: jpy)' WHEN 1 THEN 'Financial Currency: EUR' WHEN 2 THEN '{\"reportedCurrency\" : \"usd\"}' ELSE n_name END"


@query("SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE '' END AS currency FROM nation")
def currency_detect(spark, sf):
    return wh.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), text.currency(F.expr(_PAY)).alias("currency"))


@query(
    "SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) || ' Café ’t’ &lt; 1–2 ¬it; x & y' AS visible FROM pages"
)
def strip_html(spark, sf):
    return wh.table(spark, sf, "pages").select("page_id", text.strip_html(F.concat("html", F.lit("<p>Caf&eacute;&nbsp;&#8217;t&#x2019; &amp;lt; 1&#150;2 &notit; x & y</p>"))).alias("visible"))


#: symbol, what it is on the price feed, its market code (none for indices and exchanges not covered), safe in a path
SYMBOLS = [
    ("btc-usd", "BTC-USD", "CC.BTCUSD", True), ("ETHUSDT", "ETH-USD", "CC.ETHUSD", True), ("eurusd", "EURUSD=X", "US.EURUSD", True), ("XAUUSD+", "GC=F", "US.XAUUSD+", True), ("700.hk", "700.HK", "HK.00700", True), ("^GSPC", "^GSPC", None, True), ("brk.b ", "BRK.B", "US.BRK.B", False),
    ("7203.T", "7203.T", "JP.7203", True), ("AZN.L", "AZN.L", None, True), ("ry.to", "RY.TO", "CA.RY", True), ("1155.KL", "1155.KL", "MY.1155", True), ("BCH-USD", "BCH-USD", "CC.BCHUSD", True), ("LINKUSDT", "LINK-USD", "CC.LINKUSD", True), ("DOT-USDC", "DOT-USD", "CC.DOTUSD", True), ("AVAXUSD+", "AVAX-USD", "CC.AVAXUSD", True),
    ("TCS.NS", "TCS.NS", None, True), ("500325.BO", "500325.BO", None, True), ("D05.SI", "D05.SI", "SG.D05", True), ("600519.SS", "600519.SS", "SH.600519", True), ("000001.SZ", "000001.SZ", "SZ.000001", True), ("bhp.ax", "BHP.AX", "AU.BHP", True), ("..", "..", "US...", False), ("a/b", "A/B", "US.A/B", False),
]
_PICK = lambda i: "CASE c_custkey % " + str(len(SYMBOLS)) + "".join(f" WHEN {n} THEN " + ("NULL" if row[i] is None else str(row[i]).lower() if isinstance(row[i], bool) else f"'{row[i]}'") for n, row in enumerate(SYMBOLS)) + " END"


@query(f"SELECT c_custkey AS k, {_PICK(1)} AS symbol, {_PICK(2)} AS code, {_PICK(3)} AS safe FROM customer")
def symbol_rules(spark, sf):
    s = F.expr(_PICK(0))
    return wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.normalize_symbol(s, {"XAUUSD": "GC=F"}).alias("symbol"), text.market_code(s).alias("code"), text.safe_path_part(s).alias("safe"))


_DATE = "CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T09:30' WHEN 1 THEN '3/14/2024' WHEN 2 THEN '25/12/2023' WHEN 3 THEN 'soon' ELSE NULL END"


@query(f"SELECT o_orderkey AS ord, coalesce(TRY_CAST(left({_DATE}, 10) AS DATE), CAST(try_strptime({_DATE}, '%m/%d/%Y') AS DATE), CAST(try_strptime({_DATE}, '%d/%m/%Y') AS DATE)) AS day, CAST(coalesce(date_diff('day', coalesce(TRY_CAST(left({_DATE}, 10) AS DATE), CAST(try_strptime({_DATE}, '%m/%d/%Y') AS DATE), CAST(try_strptime({_DATE}, '%d/%m/%Y') AS DATE)), DATE '2024-01-01'), -1) AS INT) AS gap FROM orders")
def date_parse(spark, sf):
    d = F.expr(_DATE.replace("VARCHAR", "STRING"))
    return wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), dates.parse_date(d).alias("day"), dates.days_between(d, F.lit("2024-01-01")).alias("gap"))


ALIASES = [("goods", "economy", 0), ("goods", "standard plated", 1), ("metal", "steel", 0), ("metal", "brass", 1), ("size", "small", 0)]


@query(
    "WITH al AS (SELECT unnest([" + ", ".join(f"{{'c': '{c}', 'a': '{a}', 'o': {o}}}" for c, a, o in ALIASES) + "]) AS x), "
    "it AS (SELECT p_size AS ticker, p_brand AS period, CASE WHEN p_partkey % 9 = 0 THEN '-' ELSE '' END || p_name || ' ' || p_type AS label, p_partkey AS ord, p_retailprice AS value FROM part), "
    "m AS (SELECT ticker, period, x.c AS canonical, arg_min({'l': label, 'v': value}, {'a': x.o, 'o': ord}) AS b FROM it, al WHERE label NOT LIKE '-%' AND contains(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), x.a) GROUP BY 1, 2, 3) "
    "SELECT ticker, period, canonical, b.l AS label, b.v AS value FROM m"
)
def label_alias_match(spark, sf):
    label = F.expr("case when p_partkey % 9 = 0 then '-' else '' end || p_name || ' ' || p_type")
    items = wh.table(spark, sf, "part").select(F.col("p_size").alias("ticker"), F.col("p_brand").alias("period"), label.alias("label"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("value"))
    return rk.match_labels(items, spark.createDataFrame(ALIASES, "canonical string, alias string, alias_ord int"))


# --- vendor tables -----------------------------------------------------------------------------------

_VENDOR = "CASE l_linenumber % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'rest' WHEN 2 THEN 'cache' ELSE 'other' END"


@query(
    f"WITH v AS (SELECT l_suppkey AS ticker, l_orderkey AS k, {_VENDOR} AS vendor, min(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2, 3), "
    "p AS (SELECT *, list_position(['flat', 'cache', 'rest'], vendor) AS p FROM v) SELECT ticker, k, arg_min(vendor, p) AS vendor, arg_min(close, p) AS close FROM p WHERE p > 0 GROUP BY 1, 2"
)
def vendor_priority_coalesce(spark, sf):
    rows = wh.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_orderkey").alias("k"), F.expr(_VENDOR).alias("vendor")).agg(F.min("l_extendedprice").alias("close"))
    return routing.first_vendor(rows, ["ticker", "k"], ["flat", "cache", "rest"])


@query(
    f"WITH a AS (SELECT l_orderkey AS k, {_VENDOR} AS vendor, CASE WHEN count(*) > 1 THEN 'ok' WHEN l_orderkey % 2 = 0 THEN 'rate_limited' ELSE 'no_data' END AS status FROM lineitem GROUP BY 1, 2), p AS (SELECT *, list_position(['flat', 'cache', 'rest'], vendor) AS p FROM a), "
    "q AS (SELECT k, coalesce(arg_min({'v': vendor, 's': status}, p) FILTER (status = 'ok'), arg_max({'v': vendor, 's': status}, p)) AS b FROM p WHERE p > 0 GROUP BY 1) SELECT k, b.v AS vendor, b.s AS status FROM q"
)
def vendor_attempts(spark, sf):
    status = F.when(F.count("*") > 1, "ok").when(F.col("k") % 2 == 0, "rate_limited").otherwise("no_data")
    rows = wh.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.expr(_VENDOR).alias("vendor")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") > 1, "ok").when(F.col("k") % 2 == 0, "rate_limited").otherwise("no_data")
    return routing.attempts(rows.withColumn("status", status), ["k"], ["flat", "cache", "rest"])


_QUOTES = "q AS (SELECT ticker, arg_max(ret, date) AS change, arg_max(volume, date) * 1e9 AS market_cap FROM steps GROUP BY 1)"


def _quotes(spark, sf):
    from ..operators.indicators import with_steps

    return with_steps(wh.bars(spark, sf)).groupBy("ticker").agg(F.max_by("ret", "date").alias("change"), (F.max_by("volume", "date") * 1e9).alias("market_cap"))


@query(S.with_(S.STEPS, _QUOTES, "u AS (SELECT * FROM (SELECT ticker, change FROM q ORDER BY change DESC, ticker LIMIT 8) UNION SELECT * FROM (SELECT ticker, change FROM q ORDER BY change, ticker LIMIT 8))", "SELECT ticker, round(change, 6) + 0e0 AS change FROM u"))
def movers_union_dedup(spark, sf):
    return mk.hot_movers(_quotes(spark, sf), 8).select("ticker", r("change", 6).alias("change"))


@query(S.with_(S.STEPS, "SELECT CAST(floor(ret / 0.02e0) AS BIGINT) AS bucket, count(*) AS n FROM steps WHERE ret IS NOT NULL GROUP BY 1"))
def market_breadth(spark, sf):
    from ..operators.indicators import with_steps

    return mk.breadth(with_steps(wh.bars(spark, sf)).select(F.col("ret").alias("change")))


@query("SELECT l_suppkey AS ticker, count_if(l_returnflag = 'A') AS buys, count_if(l_returnflag = 'R') AS sells, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS buy_value, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS sell_value, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) - coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS net_value FROM lineitem GROUP BY 1")
def insider_summary(spark, sf):
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("G")
    return mk.insider_summary(wh.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ticker"), code.alias("code"), F.col("l_quantity").alias("value")))


@query(
    "WITH p AS (SELECT o_custkey AS ticker, round(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), "
    "s AS (SELECT ticker, count(*) AS n, coalesce(sum(CASE WHEN p <= greatest(1, n // 2) THEN c END), 0) AS recent, coalesce(sum(CASE WHEN p > greatest(1, n // 2) THEN c END), 0) AS earlier FROM p GROUP BY 1) SELECT *, CASE WHEN recent > earlier THEN 'rising' WHEN recent < earlier THEN 'falling' ELSE 'flat' END AS trend FROM s"
)
def insider_half_trend(spark, sf):
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return mk.half_trend(wh.table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("ord"), (F.round("o_totalprice") * sign).alias("change")))


@query(S.with_(S.FIN, "h AS (SELECT ticker, year, round(cash / total_assets * 100, 6) + year % 3 AS pct FROM fin)", "d AS (SELECT *, pct - lag(pct) OVER (PARTITION BY ticker ORDER BY year) AS d, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS p FROM h)", "SELECT ticker, round(max(CASE WHEN p = 1 THEN d END), 7) + 0e0 AS latest_pp, round(sum(CASE WHEN p <= 2 THEN d END), 7) + 0e0 AS two_q_pp, sum(CASE WHEN p <= 2 THEN d END) > 0 AS accumulate FROM d GROUP BY 1"))
def holdings_change(spark, sf):
    rows = wh.fundamentals(spark, sf).select("ticker", F.col("year").alias("period"), (F.round(F.col("cash") / F.col("total_assets") * 100, 6) + F.col("year") % 3).alias("pct"))
    return rounded(mk.holdings_change(rows), "latest_pp", "two_q_pp", digits=7)


@query(
    "WITH c AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS expiry, CASE WHEN l_linenumber % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS side, l_tax + l_discount AS iv, l_quantity AS oi FROM lineitem), "
    "n AS (SELECT ticker, coalesce(min(expiry) FILTER (expiry >= DATE '1999-06-04'), max(expiry)) AS expiry FROM c GROUP BY 1), "
    "a AS (SELECT c.ticker, c.expiry, avg(iv) FILTER (side = 'CALL') AS ci, avg(iv) FILTER (side = 'PUT') AS pi, sum(oi) FILTER (side = 'CALL') AS co, sum(oi) FILTER (side = 'PUT') AS po FROM c JOIN n ON n.ticker = c.ticker AND n.expiry = c.expiry GROUP BY 1, 2) "
    "SELECT ticker, expiry, round(ci, 6) AS call_iv, round(pi, 6) AS put_iv, CASE WHEN pi - ci IS NULL THEN 'unknown' WHEN round(pi - ci, 6) > 0.02e0 THEN 'put-skew' WHEN round(pi - ci, 6) < -0.02e0 THEN 'call-skew' ELSE 'balanced' END AS skew, round(co / po, 6) AS call_put_oi_ratio, round(po / co, 6) AS put_call_oi_ratio FROM a"
)
def option_chain(spark, sf):
    rows = wh.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("expiry"), F.when(F.col("l_linenumber") % 2 == 0, "CALL").otherwise("PUT").alias("side"), (F.col("l_tax") + F.col("l_discount")).alias("iv"), F.col("l_quantity").alias("oi"))
    out = mk.option_chain(rows, "1999-06-01")
    return rounded(out.select("ticker", "expiry", "call_iv", "put_iv", "skew", "call_put_oi_ratio", "put_call_oi_ratio"), "call_iv", "put_iv", "call_put_oi_ratio", "put_call_oi_ratio", digits=6)


@query(
    "WITH m AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(max(o_totalprice)) END AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, o_orderkey), "
    "d AS (SELECT series_id, date, max(v) AS v FROM m GROUP BY 1, 2) SELECT series_id, arg_min(v, date) AS first, arg_max(v, date) AS last, count(*) AS n, arg_max(v, date) - arg_min(v, date) AS delta, round((arg_max(v, date) - arg_min(v, date)) / abs(arg_min(v, date)) * 100, 6) + 0e0 AS pct FROM d WHERE v IS NOT NULL AND date BETWEEN DATE '1998-01-30' AND DATE '1998-03-31' GROUP BY 1"
)
def macro_series(spark, sf):
    o = wh.table(spark, sf, "orders").join(wh.table(spark, sf, "customer"), F.expr("c_custkey = o_custkey"))
    value = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.round("o_totalprice"))
    daily = o.groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.max(value).alias("v"))
    daily = daily.select("series_id", "date", F.coalesce(F.col("v").cast("string"), F.lit(".")).alias("value"))
    return rounded(mk.macro_window(daily, "1998-03-31", 60), "pct", digits=6)


@query(S.with_(S.FIN, "g AS (SELECT ticker, item, year, value, lag(value) OVER (PARTITION BY ticker, item ORDER BY year) AS b FROM (SELECT ticker, year, unnest([{'i': 'revenue', 'v': revenue}, {'i': 'cfo', 'v': cfo}], recursive := true) FROM fin) t(ticker, year, item, value))", "SELECT ticker, item, year AS period_end, round(value, 2) + 0e0 AS value, round(CASE WHEN b <> 0 THEN (value - b) / abs(b) END, 6) + 0e0 AS growth FROM g"))
def statement_growth(spark, sf):
    items = wh.fundamentals(spark, sf).select("ticker", F.col("year").alias("period_end"), "revenue", "cfo").unpivot(["ticker", "period_end"], ["revenue", "cfo"], "item", "value")
    return mk.statement_growth(items).select("ticker", "item", "period_end", r("value", 2).alias("value"), r("growth", 6).alias("growth"))


@query(
    "WITH t AS (SELECT split_part(text, chr(10), 1) AS title, doc_id % 7 AS query_ord, doc_id AS pos, source FROM documents WHERE text IS NOT NULL), f AS (SELECT title, arg_min({'q': query_ord, 'p': pos, 's': source}, {'q': query_ord, 'p': pos}) AS b FROM t GROUP BY 1) SELECT title, b.q AS query_ord, b.p AS pos, b.s AS source FROM f ORDER BY b.q, b.p LIMIT 40"
)
def title_dedup(spark, sf):
    news = wh.table(spark, sf, "documents").where("text is not null").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (F.col("doc_id") % 7).alias("query_ord"), F.col("doc_id").alias("pos"), "source")
    return mk.title_dedup(news, 40)


@query("WITH n AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts FROM events) SELECT event_id, CASE WHEN ts IS NOT NULL THEN ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' ELSE DATE '2024-01-10' >= DATE '2024-01-11' - INTERVAL 1 DAY END AS kept FROM n")
def news_window(spark, sf):
    ts = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    day = lambda d: F.to_date(F.lit(d))
    return wh.table(spark, sf, "events").select("event_id", dates.in_news_window(ts, day("2024-01-05"), day("2024-01-10"), day("2024-01-11")).alias("kept"))


@query("WITH m AS (SELECT user_id, event_id, value, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_id % 4 <> 0) SELECT 'u' || user_id AS title, 'q' || event_id AS question, value AS volume, 'Yes' AS outcome, event_id % 100 / 100e0 AS price FROM m ORDER BY value DESC, 1, 2 LIMIT 6")
def pred_market_topk(spark, sf):
    e = F.col("event_id")
    prices = F.concat(F.lit('["'), (e % 100 / 100.0).cast("string"), F.lit('", "0"]'))
    market = F.struct(F.concat(F.lit("q"), e).alias("question"), F.lit('["Yes", "No"]').alias("outcomes"), prices.alias("outcomePrices"), F.col("value").alias("volumeNum"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("endDate"), (e % 4 == 0).alias("closed"))
    rows = wh.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("title"), F.array(market).alias("markets"))
    return mk.prediction_markets(rows, "2024-01-20 00:00:00")


# --- stream ------------------------------------------------------------------------------------------

_AUCTION = "CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'M' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'H' ELSE 'Z' END"


def frames(spark, sf):
    """Events as the feed's JSON text; errors come as frames of another kind."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = F.struct(F.when(F.col("event_type") == "error", "AM").otherwise("NOI").alias("ev"), F.concat(F.lit("T"), F.col("user_id") % 40).alias("T"), (micros * 1000).alias("t"), F.lit(930).cast("long").alias("at"), F.expr(_AUCTION).alias("a"), F.lit("N").alias("x"), F.round(F.col("value") * 100).alias("o"), F.lit(1.0).alias("p"), F.col("value").alias("b"))
    return wh.table(spark, sf, "events").select(F.to_json(frame).alias("value"))


def _drained(spark, sf, name: str, step, logged: bool = True):
    """Run `step` over a stream of the frames' log (or of plain files of frames, for a last batch without rows that
    closes windows) until it is drained, and read back what it wrote."""
    root = f"{wh.shared_dir(spark)}/noi-{name}-{uuid.uuid4().hex}"
    rows = frames(spark, sf).repartition(4)
    if logged:
        frame_log.register(spark)
        rows.write.format("frame_log").mode("append").save(f"{root}/in")
        events = noi.parse_frames(spark.readStream.format("frame_log").load(f"{root}/in"))
    else:
        rows.write.text(f"{root}/in")
        events = noi.parse_frames(spark.readStream.schema("value string").text(f"{root}/in"))
    out = step(events)
    run = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


EVENT_SQL = f"ev AS (SELECT 'T' || user_id % 40 AS ticker, ts, {_AUCTION} AS auction, round(value * 100) AS imbalance, value AS clearing_price FROM events WHERE event_type <> 'error')"


@query(f"WITH {EVENT_SQL} SELECT ticker, CAST(ts AS TIMESTAMP) AS ts, CASE auction WHEN 'O' THEN 'early-open' WHEN 'M' THEN 'open' WHEN 'C' THEN 'close' WHEN 'H' THEN 'halt-reopen' END AS auction, imbalance, clearing_price FROM ev")
def noi_stream_parse(spark, sf):
    return _drained(spark, sf, "parse", lambda e: e.select("ticker", "ts", noi.auction_name(F.col("auction")).alias("auction"), "imbalance", "clearing_price"))


@query(f"WITH {EVENT_SQL}, w AS (SELECT ticker, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(imbalance) AS imbalance, arg_max(imbalance, ts) AS last_imbalance FROM ev GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE")
def noi_window_agg(spark, sf):
    """Windows that the watermark has closed: those that end ten minutes before the latest event."""
    return _drained(spark, sf, "window", lambda e: noi.by_window(e, width="1 hour"), logged=False)


@query(f"WITH {EVENT_SQL} SELECT DISTINCT ticker, ts FROM ev")
def noi_dedup(spark, sf):
    return _drained(spark, sf, "dedup", lambda e: noi.without_repeats(e.union(e), late="40 days").select("ticker", "ts"))


@query(f"WITH {EVENT_SQL} SELECT ticker, least(count(*), 5) AS n FROM ev GROUP BY 1")
def noi_cap(spark, sf):
    out = _drained(spark, sf, "cap", lambda e: noi.capped(e.select("ticker", "timestamp_ns", "imbalance"), 5))
    return out.groupBy("ticker").agg(F.count("*").alias("n"))
