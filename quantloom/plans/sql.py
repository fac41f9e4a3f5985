"""Pieces of DuckDB SQL that the counterparts share. They follow the definitions, not the Spark plans."""

from __future__ import annotations

#: Added before rounding to six places where exact ties occur: sums in another order then can't part them.
OFF = 3.3e-10

BARS = """
daily AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, SUM(CAST(round(l_discount * 100) AS BIGINT)) AS d,
  SUM(CAST(round(l_tax * 100) AS BIGINT)) AS t, COUNT(*) AS n, SUM(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
walk AS (SELECT ticker, date, volume, CAST(row_number() OVER w AS INT) AS bar,
  floor(100e0 * exp(SUM(floor(4000e0 * d / n - 20000e0)) OVER (w ROWS UNBOUNDED PRECEDING) / 1e6) * 1e4 + 0.5e0) / 1e4 AS close, t / (n * 100e0) AS tax
  FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)),
opened AS (SELECT *, floor(coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY date), 100e0) * (1 + 0.1e0 * (tax - 0.04e0)) * 1e4 + 0.5e0) / 1e4 AS open FROM walk),
edged AS (SELECT ticker, date, bar, open, floor(greatest(open, close) * (1 + 0.1e0 * tax) * 1e4 + 0.5e0) / 1e4 AS high, floor(least(open, close) * (1 - 0.1e0 * tax) * 1e4 + 0.5e0) / 1e4 AS low, close, volume FROM opened),
bars AS MATERIALIZED (SELECT *, floor((high + low + close) / 3 * 1e4 + 0.5e0) / 1e4 AS vwap FROM edged)"""

STEPS = (
    BARS
    + """,
lagged AS MATERIALIZED (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM bars),
steps AS MATERIALIZED (SELECT *, close - prev_close AS change, close / prev_close - 1 AS ret, ln(close / prev_close) AS log_return,
  CASE WHEN prev_close IS NOT NULL THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS true_range FROM lagged)"""
)

BENCH = """
bench_daily AS (SELECT CAST(l_shipdate AS DATE) AS date, SUM(CAST(round(l_discount * 100) AS BIGINT)) AS d, COUNT(*) AS n FROM lineitem GROUP BY 1),
bench AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS bar,
  floor(100e0 * exp(SUM(floor(4000e0 * d / n - 20000e0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) / 1e6) * 1e4 + 0.5e0) / 1e4 AS close FROM bench_daily)"""

OUTCOMES = """
outcomes AS (SELECT o_orderkey AS ord, o_orderpriority AS analyst, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Buy' WHEN '2-HIGH' THEN 'Overweight' WHEN '3-MEDIUM' THEN 'Hold' WHEN '4-NOT SPECIFIED' THEN 'Underweight' WHEN '5-LOW' THEN 'Sell' END AS rating,
  round(o_totalprice * 100 / mean_c - 1, 6) AS delta_r, (o_orderkey * 37 % 100) / 100e0 AS confidence, o_totalprice, o_orderstatus
  FROM orders JOIN (SELECT o_custkey AS k, SUM(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(COUNT(*) AS DOUBLE) AS mean_c FROM orders GROUP BY 1) m ON o_custkey = k)"""

SOCIAL = """
social AS (SELECT event_id AS ord, user_id AS ticker, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS label,
  value / 100 AS credibility, CAST(DATE '2024-02-01' - CAST(ts AS DATE) AS INT) AS age_days, event_type, value, props FROM events)"""

SECTORS = """
sectors AS (SELECT s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_ITEMS = ("revenue", "cogs", "sga", "receivables", "current_assets", "total_assets", "ppe", "securities", "depreciation", "current_liabilities", "total_debt", "net_income", "cfo")


def places(x: str, digits: int) -> str:
    """Rounded half up by plain arithmetic."""
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits}"


def _cents(x: str) -> str:
    return f"SUM(CAST(round(({x}) * 100) AS BIGINT)) / 100e0"


FIN = f"""
f0 AS (SELECT l_suppkey AS ticker, CAST(year(l_shipdate) AS INT) AS year, {_cents("l_extendedprice * (1 - l_discount)")} AS revenue, {_cents("p_retailprice * l_quantity")} * 0.5e0 AS cogs,
  {_cents("l_extendedprice * l_tax")} AS sga, {_cents("CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END")} * 0.2e0 + 1e0 AS receivables, {_cents("p_retailprice")} AS ppe,
  {_cents("l_extendedprice * l_discount")} AS total_liabilities, SUM(l_quantity) AS shares FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
f1 AS (SELECT f0.*, abs(s_acctbal) AS cash, revenue - cogs - sga AS operating_income FROM f0 JOIN supplier ON ticker = s_suppkey),
f2 AS (SELECT *, operating_income * 0.79e0 AS net_income, receivables + cash AS current_assets, ppe * 0.1e0 + sga * 0.01e0 AS depreciation, ppe * 0.3e0 AS capex, cash * 0.25e0 AS securities,
  total_liabilities * 0.4e0 AS current_liabilities, total_liabilities * 0.3e0 AS total_debt, shares * 100e0 AS market_cap FROM f1),
f3 AS (SELECT *, current_assets + ppe * 10 AS total_assets, net_income + depreciation - receivables * 0.5e0 AS cfo, current_assets - current_liabilities AS working_capital, net_income * 0.5e0 AS retained_earnings FROM f2),
f4 AS (SELECT *, total_assets - total_liabilities AS total_equity FROM f3),
fin AS (SELECT *, {", ".join(f"lag({c}) OVER w AS {c}_prior" for c in _ITEMS)} FROM f4 WINDOW w AS (PARTITION BY ticker ORDER BY year))"""

W = "PARTITION BY ticker ORDER BY date"


def over(n: int, f: str = "") -> str:
    """A frame of the last n rows."""
    return f"({W} ROWS {n - 1} PRECEDING)"


def between(a: int, b: int) -> str:
    return f"({W} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


def ahead(a: int, b: int) -> str:
    return f"({W} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


def sma(c: str, n: int) -> str:
    return f"CASE WHEN bar >= {n} THEN avg({c}) OVER {over(n)} END"


def rsi(n: int = 14) -> str:
    g, d = f"sum(greatest(change, 0)) OVER {over(n)}", f"sum(greatest(-change, 0)) OVER {over(n)}"
    return f"CASE WHEN bar >= {n + 1} THEN round(CASE WHEN {g} + {d} = 0 THEN 50 WHEN {d} > 0 THEN 100 - 100 / (1 + {g} / {d}) ELSE 100 END, 2) END"


def decayed(source: str, target: str, term: str, q: float, name: str) -> str:
    """A table with the decayed sum of a term, by one prefix sum of the whole series."""
    return f"{target} AS MATERIALIZED (SELECT *, sum(coalesce({term}, 0) * pow({q!r}, 1 - bar)) OVER ({W} ROWS UNBOUNDED PRECEDING) * pow({q!r}, bar - 1) AS {name} FROM {source})"


def ema(source: str, target: str, c: str, n: int, name: str, first: int = 1) -> str:
    k, seed = 2.0 / (n + 1), first + n - 1
    inner = f"(SELECT *, avg({c}) OVER {over(n)} AS seed_{name} FROM {source})"
    term = f"CASE WHEN bar > {seed} THEN {k!r} * {c} WHEN bar = {seed} THEN seed_{name} END"
    return decayed(inner, f"{target}_raw", term, 1 - k, f"raw_{name}") + f",\n{target} AS MATERIALIZED (SELECT * EXCLUDE (seed_{name}, raw_{name}), CASE WHEN bar >= {seed} THEN raw_{name} END AS {name} FROM {target}_raw)"


def with_(*parts: str) -> str:
    """Tables in turn and the final SELECT."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]
