"""Operators on hand-made inputs: nulls, flat series, short histories, ties, unknown gates, stale dates."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions import dates, numeric, text
from quantloom.operators import cleaning, evaluate, events, forensics, indicators, ledgers, markets, portfolio, ranking, relative_strength, sentiment, setups, windows
from quantloom.settings import Settings
from quantloom.sources import files, routing, sinks
from quantloom.streaming import noi

DAY = datetime.date(2020, 1, 1)


def make(spark, closes, ticker="A", highs=None, lows=None, volumes=None, opens=None):
    n = len(closes)
    highs, lows = highs or [c + 1 for c in closes], lows or [c - 1 for c in closes]
    volumes, opens = volumes or [1000.0] * n, opens or closes
    rows = [(ticker, DAY + datetime.timedelta(i), i + 1, float(o), float(h), float(lo), float(c), float(v)) for i, (o, h, lo, c, v) in enumerate(zip(opens, highs, lows, closes, volumes))]
    return spark.createDataFrame(rows, "ticker string, date date, bar int, open double, high double, low double, close double, volume double")


def last(df, *columns):
    row = df.orderBy(F.desc("date")).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def loop_ema(values, n):
    k, ema = 2 / (n + 1), sum(values[:n]) / n
    for v in values[n:]:
        ema = v * k + ema * (1 - k)
    return ema


@pytest.mark.parametrize("n", [9, 12, 26, 20])
def test_ema_equals_the_loop_over_many_blocks(spark, n):
    rng = random.Random(n)
    closes = [100 + 10 * math.sin(i / 7) + rng.random() for i in range(3000)]
    got = windows.ema(make(spark, closes), "close", n, "e")
    assert last(got, "e") == pytest.approx(loop_ema(closes, n), rel=1e-12)
    assert got.where(f"bar < {n} and e is not null").count() == 0


def test_recursive_rsi_equals_the_loop(spark):
    rng = random.Random(4)
    closes = [100.0]
    for _ in range(700):
        closes.append(closes[-1] + rng.uniform(-1, 1))
    up = down = 0.0
    for i in range(1, 15):
        d = closes[i] - closes[i - 1]
        up, down = up + max(d, 0), down + max(-d, 0)
    for i in range(15, len(closes)):
        d = closes[i] - closes[i - 1]
        up, down = (up * 13 + max(d, 0)) / 14, (down * 13 + max(-d, 0)) / 14
    got = last(indicators.with_rsi_series(indicators.with_steps(make(spark, closes))), "rsi_series")
    assert got == pytest.approx(100 - 100 / (1 + up / down), rel=1e-9)


def test_rsi_of_rises_flats_and_short_series(spark):
    rise = indicators.with_steps(make(spark, [100 + i for i in range(40)]))
    assert last(rise.withColumn("r", indicators.rsi()), "r") == 100.0
    flat = indicators.with_steps(make(spark, [100] * 40))
    assert last(flat.withColumn("r", indicators.rsi()), "r") == 50.0
    assert last(indicators.with_steps(make(spark, [100] * 14)).withColumn("r", indicators.rsi()), "r") is None


def test_flat_series_has_no_band_position(spark):
    bars = make(spark, [50.0] * 30)
    out = indicators.bollinger()
    assert last(bars.withColumns(out), "bb_mid", "pct_b") == (50.0, None)
    steps = indicators.with_steps(bars).withColumns({"v": indicators.realized_vol(), "c": indicators.choppiness(), "h": indicators.high_distance()})
    assert last(steps, "v", "c", "h") == (0.0, 0.5, 0.0)
    assert last(indicators.with_vol_scale(indicators.with_steps(bars)), "vol_scale") == 0.0


def test_zero_volume_day_and_rvol(spark):
    bars = make(spark, [10.0] * 5, volumes=[0, 0, 0, 5, 10])
    got = [r["v"] for r in bars.withColumn("v", indicators.rvol()).orderBy("date").collect()]
    assert got == [None, None, None, None, 8.0]


def test_momentum_offsets(spark):
    bars = make(spark, list(range(100, 400)))
    assert last(bars.withColumn("m", indicators.momentum(60, 0)), "m") == 399 / 340 - 1
    assert last(bars.withColumn("m", indicators.momentum(252, 21)), "m") == 379 / 127 - 1
    assert last(bars.limit(273).withColumn("m", indicators.momentum(252, 21)), "m") is None


def test_scan_needs_two_hundred_bars(spark):
    up = [100 + 0.2 * i for i in range(230)]
    bars = make(spark, up, highs=[c + 0.5 for c in up], lows=[c - 0.5 for c in up], volumes=[1000.0] * 229 + [10_000.0])
    assert last(setups.scan_signals(bars), "b", "squeeze")[0] is True
    assert setups.scan_signals(make(spark, up[:199])).count() == 0


@pytest.mark.parametrize(("value", "label"), [(50.0, "strong"), (42.0, "reset"), (35.0, "broken"), (78.0, "hot"), (None, "unknown")])
def test_rsi_band(spark, value, label):
    assert spark.createDataFrame([(value,)], "v double").select(setups.rsi_band(F.col("v"))).first()[0] == label


def test_swing_candidate(spark):
    closes = [100 + 0.5 * i + 8 * math.sin(i / 6) for i in range(252)]
    top = loop_ema(closes, 20)
    closes += [top + d for d in (5, 4, 3, 2, 1, 1.6)]
    volumes = [5e6] * (len(closes) - 6) + [1e6] * 6
    bars = make(spark, closes, highs=[c + 2 for c in closes], lows=[c - 2 for c in closes], volumes=volumes)
    report = setups.swing_report(bars)
    pulled, stop, t1 = last(report, "pullback", "stop", "t1")
    assert pulled and stop < closes[-1] < t1
    assert setups.swing_report(make(spark, closes[:150])).count() == 0


def test_troughs_differ_on_ties(spark):
    lows = [5, 4, 3, 2, 2, 3, 4, 5, 6]
    bars = make(spark, [9] * 9, lows=lows)
    assert setups.with_troughs(bars, 3, strict=True).where("trough is not null").count() == 0
    assert [r["b"] for r in setups.with_troughs(bars, 3, strict=False).where("trough is not null").select("trough.bar").toDF("b").collect()] == [4]


def test_vdu_prior_window_forms(spark):
    volumes = [100.0] * 30 + [10.0] * 5 + [50.0]
    bars = make(spark, [10.0] * 36, volumes=volumes)
    assert last(bars.withColumns(setups.volume_dry_up()), "vdu_ratio", "dry_up") == (0.1, True)
    assert last(bars.withColumns(setups.volume_dry_up(whole_prior=True)), "dry_up") is True
    assert last(make(spark, [10.0] * 25).withColumns(setups.volume_dry_up()), "dry_up") is None


def test_pullback_candidate_is_unreachable_but_corrected_is_not(spark):
    rng = random.Random(2)
    closes = [50 + 5 * math.sin(i / 4) + 0.3 * i + rng.random() for i in range(300)]
    out = setups.first_pullback(make(spark, closes, highs=[c + 0.3 for c in closes], lows=[c - 0.3 for c in closes], opens=[c - 0.2 for c in closes]))
    assert out.where("candidate").count() == 0
    assert out.where("trigger").count() > 0


def test_session_flags_and_pillars_keep_unknown(spark):
    df = spark.createDataFrame([(100.0, 40.0), (None, -0.05), (None, None)], "peak double, now double").withColumns(setups.session_flags(F.col("peak"), F.col("now")))
    assert [tuple(r)[2:] for r in df.collect()] == [(True, False, True), (None, True, True), (None, None, False)]
    p = spark.range(1).select(*(c.alias(k) for k, c in setups.pillars(F.lit(15.0), F.lit(5e6), F.lit(14.0), F.lit(14.5), F.lit(5.0), F.lit(4e6)).items())).first()
    assert all(p)
    none = F.lit(None).cast("double")
    assert not any(spark.range(1).select(*(c.alias(k) for k, c in setups.pillars(none, none, none, none, none, none).items())).first())


def test_past_optimal_window_follows_daylight_saving(spark):
    df = spark.sql("select timestamp'2024-01-10 14:59:00' a, timestamp'2024-01-10 15:00:00' b, timestamp'2024-07-10 14:00:00' c")
    assert tuple(df.select(*(setups.past_optimal_window(F.col(x)) for x in "abc")).first()) == (False, True, True)


def test_relative_strength_keeps_bars_without_benchmark(spark):
    closes = [100 + 7 * ((i * 37) % 11) - 0.3 * i for i in range(120)]
    closes[50] = 0.0
    bars = make(spark, closes)
    bench = make(spark, [100.0 + i % 5 for i in range(120)]).where("bar % 9 <> 4")
    rows = {x.bar: x.rs_verdict for x in relative_strength.with_verdict(bars, bench).collect()}
    kept = relative_strength.report(bars, bench).select("ticker", "date", "rs_verdict")
    expected = {x.bar: x.rs_verdict for x in bars.join(kept, ["ticker", "date"], "left").collect()}
    assert rows == expected and len(rows) == 120 and None in rows.values() and len(set(rows.values())) > 2


def test_relative_strength_of_unequal_lengths(spark):
    bars = make(spark, [100 + i for i in range(100)])
    bench = make(spark, [100.0] * 40).select("date", F.col("bar"), "close")
    assert relative_strength.by_tail(bars, bench).count() == 40
    assert relative_strength.by_date(bars, bench).count() == 40
    assert last(relative_strength.report(bars, make(spark, [100.0] * 100)), "rs_verdict") == "leading"
    assert last(relative_strength.report(make(spark, [100 - 0.5 * i for i in range(100)]), make(spark, [100.0] * 100)), "rs_verdict") == "lagging"


def test_cleaning(spark):
    raw = spark.createDataFrame([("A", "2024-01-01", "x", "2", "1", "5", "1"), ("A", "bad", "1", "1", "1", "1", "1"), ("A", "2024-01-02", "3", "NaN", "1", None, "1"), ("A", "2024-01-03", "3", "NaN", "1", "6", "1")], "ticker string, date string, open string, high string, low string, close string, volume string")
    clean = cleaning.fill_gaps(cleaning.coerce_bars(raw)).orderBy("date").collect()
    assert [(r["open"], r["high"], r["close"]) for r in clean] == [(3.0, 2.0, 5.0), (3.0, 2.0, 6.0)]
    names = spark.createDataFrame([("SPDR Trust",), ("Acme",), (None,), ("trustco",)], "n string").select(cleaning.not_equity(F.col("n"))).collect()
    assert [r[0] for r in names] == [True, False, False, True]


def test_as_of_date_inside_the_series(spark):
    bars = make(spark, [100 + i for i in range(60)])
    cut = cleaning.as_of(bars, "2020-02-01")
    assert cut.agg(F.max("date")).first()[0] == datetime.date(2020, 2, 1)
    assert cleaning.fresh_tickers(bars, "2020-02-01").first()["stale"] is False
    assert cleaning.fresh_tickers(bars, "2020-12-01").first()["stale"] is True


@pytest.mark.parametrize(("returns", "total"), [([0.1, 0.1], 0.21), ([0.01] * 3, 1.01**3 - 1), ([None, 0.5, -1.0], -1.0), ([], 0.0)])
def test_total_return(spark, returns, total):
    df = spark.createDataFrame([("A", r) for r in returns], "ticker string, r double")
    assert df.agg(evaluate.total_return()).first()[0] == pytest.approx(total)


def test_drawdown_and_tails(spark):
    curve = [100, 120, 110, 130]
    rows = [("A", DAY + datetime.timedelta(i), b / a - 1) for i, (a, b) in enumerate(zip(curve, curve[1:]))]
    df = spark.createDataFrame(rows, "ticker string, date date, r double")
    assert evaluate.drawdowns(df).first()["max_drawdown"] == pytest.approx(10 / 120)
    tails = evaluate.tail_risk(spark.createDataFrame([("A", -0.5), ("A", -0.5), ("A", 0.1), ("A", None)], "ticker string, r double"), ["ticker"], alpha=0.7).first()
    assert (tails["n"], tails["var"], tails["cvar"]) == (3, -0.5, -0.5)


def test_portfolio_needs_two_names_and_whole_rows(spark):
    w = spark.createDataFrame([("b", "A", 0.6), ("b", "B", 0.2), ("one", "A", 1.0), ("none", "A", 0.0), ("none", "B", None)], "book string, ticker string, weight double")
    r = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.2), ("B", 1, 0.3), ("B", 2, None)], "ticker string, place int, r double")
    got = {(x["book"], x["place"]): x["r"] for x in evaluate.portfolio_returns(evaluate.normalised_weights(w), r).collect()}
    assert got == {("b", 1): pytest.approx(0.12), ("none", 1): pytest.approx(0.2)}


def test_walk_forward_splits(spark):
    rows = [("A", DAY + datetime.timedelta(i), 0.01 * math.sin(i)) for i in range(103)]
    got = evaluate.walk_forward(spark.createDataFrame(rows, "ticker string, date date, r double"), 60, 20)
    assert sorted((r["split"], r["part"], r["n"]) for r in got.collect()) == [(0, "test", 20), (0, "train", 60), (1, "test", 20), (1, "train", 60)]
    assert evaluate.walk_forward(spark.createDataFrame(rows[:70], "ticker string, date date, r double"), 60, 20).count() == 0


def test_ranks_with_ties_equal_a_cumulative_share(spark):
    rng = random.Random(8)
    rows = [("f", i, float(rng.randint(0, 30))) for i in range(2000)]
    df = spark.createDataFrame([(f, str(i), v) for f, i, v in rows], "factor string, ticker string, value double")
    got = {r["ticker"]: r["pct"] for r in ranking.share_at_or_below(df.withColumn("k", F.lit(1)), ["k"]).collect()}
    values = sorted(v for *_, v in rows)
    import bisect

    assert all(got[str(i)] == bisect.bisect_right(values, v) / len(values) for _, i, v in rows)


def test_watchlist_order_of_missing_values(spark):
    df = spark.createDataFrame([("a", None, None), ("b", -2.0, 1.0), ("c", 0.1, 9.0), ("d", 0.1, 3.0)], "ticker string, earnings_yield double, ev_ebit double")
    assert [r["ticker"] for r in ranking.watchlist(df, 10).orderBy("rank").collect()] == ["d", "c", "a", "b"]


def test_gates_count_only_what_is_measured(spark):
    row = lambda **k: {"ticker": "A", "not_equity": False, "price": 20.0, "pe": 10.0, "market_cap": 2e10, "avg_volume": 2e6, "atr_pct": 3.0, "eps_yoy": None, "revenue_yoy": None, "roe": None} | k
    rows = [row(), row(pe=None), row(eps_yoy=-0.1), row(not_equity=True), row(price=10.0)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "ticker string, not_equity boolean, price double, pe double, market_cap double, avg_volume double, atr_pct double, eps_yoy double, revenue_yoy double, roe double")
    assert [r["failed"] for r in ranking.gate_cascade(df).collect()] == [None, "pe", "eps_growth", "non_equity", "price"]


def test_label_aliases(spark):
    items = spark.createDataFrame([("A", "2024", "Total Revenue", 0, 9.0), ("A", "2024", "-Total Revenue parts", 1, 1.0), ("A", "2024", "Long-Term Debt", 2, 5.0), ("A", "2024", "Total Liabilities", 3, 7.0)], "ticker string, period string, label string, ord long, value double")
    aliases = spark.createDataFrame([("revenue", "revenue", 1), ("revenue", "total revenue", 0), ("total_debt", "long-term debt", 0), ("total_debt", "total liabilities", 1)], "canonical string, alias string, alias_ord int")
    assert {r["canonical"]: r["value"] for r in ranking.match_labels(items, aliases).collect()} == {"revenue": 9.0, "total_debt": 5.0}


def test_weights_caps_and_summary(spark):
    s = spark.createDataFrame([("A", 8.0, "x"), ("B", 1.0, "x"), ("C", 1.0, None), ("D", -3.0, "y")], "ticker string, score double, sector string")
    w = portfolio.value_weights(s)
    assert {r["ticker"]: r["weight"] for r in w.collect()} == {"A": 0.8, "B": 0.1, "C": 0.1, "D": 0.0}
    capped = {r["ticker"]: r["capped"] for r in portfolio.adjust_for_caps(w, 0.25, 0.3).collect()}
    assert capped["A"] == pytest.approx(0.25 * 0.3 / 0.35) and capped["C"] == 0.1
    assert portfolio.summary(w).first()["active"] == 3
    assert portfolio.value_weights(s.where("score < 0")).first()["weight"] == 0.0


def test_governor(spark):
    schema = "size_pct double, book_total_pct double, cvar_pct double, drawdown_pct double, sector_pct double, capital_at_risk_pct double, risk_cap_pct double, halted boolean"
    rows = [(0.1, None, None, None, None, None, None, False), (0.28, None, None, None, None, None, None, False), (0.31, 0.2, 0.04, 0.2, 0.3, 0.02, 0.01, False), (None, None, 1.0, None, None, None, None, False), (0.1, None, None, None, None, None, None, True)]
    got = portfolio.govern(spark.createDataFrame(rows, schema), Settings()).collect()
    assert [r["governor"] for r in got] == ["PASS", "WARN", "REJECT", "PASS", "REJECT"]
    assert got[2]["reasons"] == ["size", "book", "cvar", "capital-at-risk", "drawdown", "sector"]


def test_tranches_without_atr(spark):
    df = spark.createDataFrame([(100.0, 2.0), (100.0, None), (1.0, 5.0)], "close double, atr double")
    got = portfolio.tranche_plan(df).collect()
    assert [r["valid"] for r in got] == [True, False, False]
    assert got[0]["total_shares"] == int(1500 / (0.3 * 100 + 0.3 * 98 + 0.4 * 96 - 93)) and got[1]["total_shares"] is None


def test_scores_with_missing_items(spark):
    fin = {"revenue": 100.0, "revenue_prior": 90.0, "total_assets": 200.0, "total_liabilities": 0.0, "working_capital": 10.0, "retained_earnings": 5.0, "operating_income": 20.0, "market_cap": 300.0}
    df = spark.createDataFrame([tuple(fin.values())], ", ".join(f"{k} double" for k in fin))
    assert df.select(forensics.altman_z()).first()[0] is None
    ok = df.withColumn("total_liabilities", F.lit(50.0)).select(forensics.altman_z()).first()[0]
    assert ok == pytest.approx(1.2 * 0.05 + 1.4 * 0.025 + 3.3 * 0.1 + 0.6 * 6 + 0.5)


def test_norm_ebit_upper_median(spark):
    margins = [0.04, 0.04, 0.03, 0.3, 0.05]
    df = spark.createDataFrame([(margins, 1000.0), ([0.1, 0.2], 10.0), ([], 10.0), ([None, 0.1], 10.0)], "m array<double>, s double")
    assert [r[0] and round(r[0], 6) for r in df.select(forensics.norm_ebit(F.col("m"), F.col("s"))).collect()] == [40.0, 2.0, None, 1.0]


def test_dcf_by_hand(spark):
    df = spark.createDataFrame([([5.0, 10.0], 0.04, 1.0, 10.0, 3.0, 1.0), ([-1.0], 0.04, 1.0, 10.0, 0.0, 0.0)], "h array<double>, rf double, b double, s double, c double, d double")
    got = df.select(forensics.dcf(*map(F.col, ("h", "rf", "b", "s", "c", "d"))).alias("v")).collect()
    pv = sum(10 * 1.025**y / 1.09**y for y in range(1, 6))
    tv = 10 * 1.025 / 0.065 / 1.09**5
    assert got[0]["v"]["price"] == pytest.approx((pv + tv + 2) / 10) and got[1]["v"] is None


def test_trap_levels(spark):
    df = spark.createDataFrame([(2, -1.0, None), (8, -3.0, 3.0), (None, None, 1.0)], "f int, m double, z double")
    level = forensics.trap_level(forensics.trap_evidence(F.col("f"), F.col("m"), F.col("z")))
    assert [r[0] for r in df.select(level).collect()] == ["HIGH", "LOW", "MEDIUM"]


def test_asof_takes_the_first_bar_on_or_after(spark):
    bars = make(spark, [1.0, 2.0, 3.0])
    ev = spark.createDataFrame([("A", DAY - datetime.timedelta(5), 1), ("A", DAY + datetime.timedelta(2), 2), ("A", DAY + datetime.timedelta(9), 3), ("Z", DAY, 4)], "ticker string, event_date date, k int")
    assert {r["k"]: r["bar_close"] for r in events.asof_forward(ev, bars).collect()} == {1: 1.0, 2: 3.0, 3: None, 4: None}


def test_credit_bands(spark):
    df = spark.createDataFrame([(2.0, 7.0, None), (5.5, None, None), (None, 15.1, None), (None, None, None)], "a double, b double, c double")
    out = events.credit_stress(*map(F.col, "abc"))
    assert [tuple(r) for r in df.select(out["level"], out["scale"]).collect()] == [("low", 1.0), ("high", 0.7), ("severe", 0.5), ("unknown", 1.0)]


def test_regimes_and_two_states(spark):
    rng = random.Random(3)
    rows = [(t, DAY + datetime.timedelta(i), rng.gauss(m if i >= 150 else -m, 0.004)) for t, m in (("up", 0.02), ("down", -0.02)) for i in range(300)]
    rows += [("flat", DAY + datetime.timedelta(i), 0.0) for i in range(40)] + [("few", DAY, 0.1)]
    got = {r["ticker"]: r["regime"] for r in events.two_state_regime(spark.createDataFrame(rows, "ticker string, date date, r double")).collect()}
    assert got == {"up": "bull", "down": "bear", "flat": "unknown", "few": "unknown"}


def test_two_states_by_blocks_equal_the_whole_series(spark):
    """Series of several lengths, the last block full, of one return, or in between; noisy, so that both ends occur."""
    rng = random.Random(5)
    rows = []
    for k, n in enumerate((40, 57, 64, 65, 200, 201, 202, 203)):
        side = 1
        for i in range(n):
            side = -side if rng.random() < 0.1 else side
            rows.append((f"t{k}", DAY + datetime.timedelta(i), rng.gauss(0.01 * side, 0.012)))
    rows += [("flat", DAY + datetime.timedelta(i), 0.5) for i in range(70)] + [("t0", DAY + datetime.timedelta(900), None), ("none", DAY, None)]
    frame = spark.createDataFrame(rows, "ticker string, date date, r double")
    own = {r["ticker"]: r["regime"] for r in events.two_state_regime(frame, steps=4).collect()}
    cut = {r["ticker"]: r["regime"] for r in events.two_state_regime(frame, steps=4, whole=30, block=8).collect()}
    assert own == cut and set(own.values()) == {"bull", "bear", "unknown"} and own["none"] == "unknown"


def test_series_are_fitted_side_by_side():
    """Series of several lengths have the regimes that each has alone, and thousands of them take seconds."""
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    series = [rng.normal(0.01 * np.where(rng.random(n) < 0.5, 1, -1), 0.012) for n in rng.integers(15, 90, 150)] + [np.full(40, 0.1)]
    own = [events._fit_together([x], 6, 20)[0] for x in series]
    assert events._fit_together(series, 6, 20) == own and set(own) == {"bull", "bear", "unknown"}
    start = time.perf_counter()
    assert len(events._fit_together([rng.normal(0, 0.01, 500) for _ in range(1000)], 50, 20)) == 1000
    assert time.perf_counter() - start < 60  # one by one it is several minutes


def test_equal_means_do_not_rise(spark):
    """Fifty closes with the sum of the fifty from five bars before, taken in another order, and one place more."""
    rng = random.Random(4)
    for more in (0.0, 0.0001):
        got = []
        for k in range(40):
            closes = [round(rng.uniform(50, 150), 4) for _ in range(55)]
            head = closes[:5]
            rng.shuffle(head)
            closes[50:] = [*head[:4], round(head[4] + more, 4)]
            got.append(make(spark, closes, f"T{k}"))
        frame = got[0]
        for other in got[1:]:
            frame = frame.unionByName(other)
        rises = setups.with_trend(frame.coalesce(4)).where("bar = 55").groupBy("sma50_rising").count().collect()
        assert [tuple(r) for r in rises] == [(more > 0, 40)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recursive_means_share_one_sort(spark):
    """One order by ticker and date serves smoothers and windows: a task sorts once, whatever the chain."""
    bars = make(spark, [100.0 + i % 7 for i in range(60)])
    chain = indicators.with_rsi_series(indicators.with_macd(windows.ema(indicators.with_steps(bars), "close", 9, "ema9")))
    assert plan(chain).count(" Sort [") == 1


def test_gaps_are_filled_in_one_pass(spark):
    """No frame that runs from the current bar to the last, which takes the square of a ticker's bars."""
    filled = cleaning.fill_gaps(make(spark, [1.0, 2.0, 3.0]))
    assert "currentrow$(), unboundedfollowing$()" not in plan(filled)


def test_overlays_collect_no_closes_by_bar(spark):
    bars = make(spark, [100.0 + (i * i) % 13 for i in range(450)])
    out = events.overlays(bars)
    assert "-199, currentrow$()" not in plan(out) and "-251, currentrow$()" not in plan(out.select("vol_pct", "trend"))
    closes = [100.0 + (i * i) % 13 for i in range(450)]
    for r in out.select("bar", "trend").collect():
        half = min(200, r["bar"] // 2)
        mean = sum(closes[r["bar"] - half : r["bar"]]) / half
        assert r["trend"] == pytest.approx((closes[r["bar"] - 1] - mean) / mean, abs=1e-12)


def test_strength_needs_no_exchange_by_date(spark):
    bars = make(spark, [100.0 + (i * i) % 13 for i in range(300)])
    benchmark = bars.select("date", "bar", (F.col("close") + F.col("bar") % 5).alias("close")).repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(relative_strength.report(bars, benchmark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r["bar"]: r["rs_slope_pct"] for r in relative_strength.report(bars, benchmark).collect()}
    rs = [(100.0 + (i * i) % 13) / (100.0 + (i * i) % 13 + (i + 1) % 5) for i in range(300)]
    for n in (62, 63, 200, 300):
        own, mid = rs[n - 63 : n], (n - 31)
        want = sum((n - 62 + k - mid) * x for k, x in enumerate(own)) / sum((k - 31) ** 2 for k in range(63)) / (sum(own) / 63) * 100 if n >= 63 else None
        assert got[n] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_vendor_files_hold_many_tickers(spark, sf):
    """Files grow with rows, not with tickers; bulk files are written by the tasks that hold the tickers' bars."""
    from quantloom.plans import readers

    assert len(readers.vendor_csv(spark, sf).inputFiles()) <= 8
    written = readers.flat_bars(spark, sf)
    assert 0 < len(written.inputFiles()) and written.groupBy("ticker", "date").count().where("count > 1").isEmpty()


def test_skew_of_two_points_is_balanced(spark):
    rows = [("A", "CALL", 0.05), ("A", "PUT", 0.07), ("B", "CALL", 0.07), ("B", "PUT", 0.05), ("C", "CALL", 0.05), ("C", "PUT", 0.0701)]
    chain = spark.createDataFrame([(t, DAY, s, v, 1.0) for t, s, v in rows], "ticker string, expiry date, side string, iv double, oi double")
    assert {r["ticker"]: r["skew"] for r in markets.option_chain(chain, "2019-01-01").collect()} == {"A": "balanced", "B": "balanced", "C": "put-skew"}


def test_choppiness_of_flat_closes(spark):
    steps = indicators.with_steps(make(spark, [50.0] * 6))
    got = [(r["a"], r["b"]) for r in steps.select("date", indicators.choppiness().alias("a"), indicators.choppiness(flat=0.0).alias("b")).orderBy("date").collect()]
    assert got == [(0.5, 0.5)] * 3 + [(0.5, 0.0)] * 3


def test_sentiment_weights(spark):
    rows = [("A", "Bullish", 0, 1.0), ("A", "bearish", 7, 1.0), ("A", "odd", 0, 1.0), ("A", "sell", -1, 1.0), ("B", None, 0, -1.0)]
    df = spark.createDataFrame(rows, "ticker string, label string, age_days int, credibility double")
    got = {r["ticker"]: r["sentiment"] for r in sentiment.weighted_sentiment(df, ["ticker"]).collect()}
    assert got == {"A": pytest.approx(0.5 / 1.5), "B": None}


def test_consensus_ties_take_the_first_seen(spark):
    df = spark.createDataFrame([("A", "x", 1), ("A", "y", 0), ("B", "x", 0), ("B", "y", 1), ("B", "z", 2)], "k string, verdict string, ord int")
    assert {r["k"]: r["verdict"] for r in ledgers.consensus(df, ["k"]).collect()} == {"A": "y", "B": "mixed"}


def test_buckets_keep_empty_cells(spark):
    table = ledgers.fit_buckets(spark.createDataFrame([(0.55, True), (0.55, False), (None, True), (1.5, True)], "confidence double, won boolean"))
    assert {r["bucket"]: (r["n"], r["won"], r["win_rate"]) for r in table.collect()} == {0.0: (0, 0, None), 0.5: (2, 1, 0.5), 0.6: (0, 0, None), 0.7: (0, 0, None), 0.8: (0, 0, None)}


@pytest.mark.parametrize(("value", "number"), [("$1.23B", 1.23e9), ("1,234", 1234.0), ("-5.5k", -5500.0), ("n/a", None), ("", None), (None, None), ("2e3", 2000.0), ("400M", 4e8)])
def test_first_number(spark, value, number):
    got = spark.createDataFrame([(value,)], "v string").select(text.first_number(F.col("v"))).first()[0]
    assert got == (None if number is None else pytest.approx(number))


@pytest.mark.parametrize(("prose", "rating"), [("Rating: **Sell**", "Sell"), ("I would buy.", "Buy"), ("nothing", "Hold"), (None, "Hold"), ("*Underweight*, maybe", "Underweight"), ("holding", "Hold"), ("Rating: strong\nOverweight", "Overweight")])
def test_rating(spark, prose, rating):
    assert spark.createDataFrame([(prose,)], "v string").select(text.rating(F.col("v"))).first()[0] == rating


def test_html_and_symbols(spark):
    html = "<b>x</b> &amp;lt; <!-- SC_OFF --><p>in&nbsp;side</p><!-- SC_ON --> out"
    df = spark.createDataFrame([(html, "btc-usd"), (None, None)], "h string, s string")
    got = df.select(text.strip_html(F.col("h")), text.normalize_symbol(F.col("s")), text.safe_path_part(F.col("s"))).collect()
    assert tuple(got[0]) == ("in side", "BTC-USD", True) and tuple(got[1]) == ("", None, False)


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29T10:00",), ("2/3/2024",), ("31/12/2023",), ("never",), (None,)], "d string")
    assert [r[0] and r[0].isoformat() for r in df.select(dates.parse_date(F.col("d"))).collect()] == ["2024-02-29", "2024-02-03", "2023-12-31", None, None]
    assert spark.range(1).select(dates.from_nanos(F.lit(1679976000000000001))).first()[0] == datetime.date(2023, 3, 28)


def test_unknown_gates_and_defaults(spark):
    df = spark.createDataFrame([(None, 0.0), (False, 2.0), (True, None)], "g boolean, v double")
    assert [tuple(r) for r in df.select(numeric.passes_unless_false(F.col("g")), numeric.or_default(F.col("v"), 5.0)).collect()] == [(True, 5.0), (False, 2.0), (True, 5.0)]


def test_flat_files(spark, tmp_path):
    head = "ticker,volume,open,close,high,low,window_start,transactions\n"
    (tmp_path / "a.csv").write_text(head + "aapl,1,1,120.47,1,1,1679976000000000000,1\nAAPL,1,,120.6,1,1,1680062400000000000,1\nBAD,1,1,,1,1,1679976000000000000,1\n")
    (tmp_path / "b.csv").write_text(head + "AAPL,1,1,9,1,1,1679976000000000000,1\n")
    bars = files.longest_history(files.flat_bars(spark, str(tmp_path)))
    assert [(str(r["date"]), r["close"]) for r in bars.orderBy("date").collect()] == [("2023-03-28", 120.47), ("2023-03-29", 120.6)]


def test_vendor_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# head\nDate,Open,High,Low,Close,Volume\n2024-01-01,1.005,2,3,4,5\n2024-02-01,1,2,3,bad,5\nnope,1,1,1,1,1\n")
    rows = files.vendor_csv(spark, str(tmp_path / "x.csv"), "2024-01-01", "2024-03-01", "A").orderBy("date").collect()
    assert [r["close"] for r in rows] == [4.0, None]


def test_ledger_and_decision_log(spark, tmp_path):
    from quantloom import schemas

    (tmp_path / "l.jsonl").write_text('{"analyst": "a", "ticker": "T", "trade_date": "2024-01-01", "delta_r": 0.1, "ts": 1}\nnot json\n')
    assert files.json_ledger(spark, str(tmp_path / "l.jsonl"), schemas.REFLECTION_LEDGER).count() == 1
    (tmp_path / "d.md").write_text("[2024-01-02 | AAPL | Buy | pending]\nDECISION:\nwait\n<!-- ENTRY_END -->\n[2024-01-03 | MSFT | Sell | +2.5% | 2.5% | -1.0% | 5d]\nDECISION:\ngo\nREFLECTION:\nfine\n<!-- ENTRY_END -->\n")
    got = {r["ticker"]: r for r in files.decision_log(spark, str(tmp_path / "d.md")).collect()}
    assert got["AAPL"]["pending"] and got["AAPL"]["decision"] == "wait"


def test_vendor_fallback_takes_whole_records(spark):
    df = spark.createDataFrame([("A", "x", None, 1.0), ("A", "y", 2.0, 2.0), ("B", "y", 3.0, 3.0), ("C", "q", 1.0, 1.0)], "k string, vendor string, a double, b double")
    got = {r["k"]: (r["vendor"], r["a"], r["b"]) for r in routing.first_vendor(df, ["k"], ["x", "y"]).collect()}
    assert got == {"A": ("x", None, 1.0), "B": ("y", 3.0, 3.0)}


def test_cache_freshness(spark):
    df = spark.sql("select * from values ('bars', timestamp'2024-01-01 06:00:01', 'ok'), ('bars', timestamp'2024-01-01 05:59:59', 'ok'), ('news', timestamp'2024-01-01 11:00:00', 'ok'), ('bars', timestamp'2024-01-01 11:00:00', 'no_data') t(category, ingested_at, status)")
    assert routing.fresh(df, "2024-01-01 12:00:00").count() == 1


def test_decisions_are_written_once(spark):
    schema = "date date, ticker string, pending boolean"
    stored = spark.createDataFrame([(DAY, "A", True), (DAY, "B", False)], schema)
    new = spark.createDataFrame([(DAY, "A", True), (DAY, "B", True), (DAY, "B", True)], schema)
    assert [r["ticker"] for r in sinks.new_decisions(new, stored).collect()] == ["B"]


def test_sink_replaces_and_renders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "k int, s string, n double")
    for _ in range(2):
        sinks.replace_table(df, str(tmp_path / "t"), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert "| n |" not in sinks.markdown(df) and "| k | s |" in sinks.markdown(df)
    sinks.append_ledger(df, str(tmp_path / "led"))
    sinks.append_ledger(df, str(tmp_path / "led"))
    assert spark.read.json(str(tmp_path / "led")).count() == 4


def test_expiry_and_chain(spark):
    rows = [("A", datetime.date(2024, 1, 2), "CALL", 0.2, 10.0), ("A", datetime.date(2024, 1, 5), "CALL", 0.2, 10.0), ("A", datetime.date(2024, 1, 5), "PUT", 0.3, 5.0), ("A", datetime.date(2024, 1, 5), "PUT", float("nan"), 5.0), ("B", datetime.date(2023, 1, 1), "PUT", 0.1, 0.0)]
    got = {r["ticker"]: r for r in markets.option_chain(spark.createDataFrame(rows, "ticker string, expiry date, side string, iv double, oi double"), "2024-01-01").collect()}
    assert got["A"]["expiry"] == datetime.date(2024, 1, 5) and got["A"]["skew"] == "put-skew" and got["A"]["call_put_oi_ratio"] == 1.0
    assert got["B"]["skew"] == "unknown" and got["B"]["call_put_oi_ratio"] is None


def test_macro_window_skips_missing(spark):
    rows = [("DGS10", DAY + datetime.timedelta(i), v) for i, v in enumerate(["4.0", ".", "4.4", "4.2"])]
    got = markets.macro_window(spark.createDataFrame(rows, "series_id string, date date, value string"), "2020-01-03", 30).first()
    assert (got["first"], got["last"], got["n"]) == (4.0, 4.4, 2)


def test_prediction_markets(spark):
    from quantloom import schemas

    rows = [("e", [("open", '["Yes","No"]', '["0.4","0.6"]', 5.0, "2030-01-01T00:00:00", False), ("shut", "[]", "[]", 9.0, "2030-01-01T00:00:00", True), ("past", "[]", "[]", 9.0, "2020-01-01T00:00:00", False)])]
    got = markets.prediction_markets(spark.createDataFrame(rows, schemas.PREDICTION_EVENTS), "2024-01-01").collect()
    assert [(r["question"], r["price"]) for r in got] == [("open", 0.4)]


def test_noi_frames(spark):
    frames = ['{"ev":"NOI","T":"X","t":1700000000123456789,"at":930,"a":"C","x":"N","o":480,"p":1,"b":25.03}', '{"ev":"T","T":"X"}', "broken"]
    got = noi.parse_frames(spark.createDataFrame([(f,) for f in frames], "value string")).withColumn("d", noi.describe()).collect()
    assert len(got) == 1 and got[0]["imbalance"] == 480 and got[0]["d"].startswith("[NOI] X close@930")


def test_replace_of_macro_backdrop_and_penalties(spark):
    df = spark.createDataFrame([(4.0, 4.5, 3.5), (5.0, 4.0, None)], "t double, w double, b double")
    assert [round(r[0], 4) for r in df.select(events.macro_backdrop(*map(F.col, "twb"))).collect()] == [0.525, 1.0]
    p = spark.createDataFrame([(None,), (0.02,)], "m double").select(events.risk_penalty(F.col("m"))).collect()
    assert [r[0] for r in p] == [0.5, 0.25]


def test_share_at_or_below_doesnt_hang_on_exchange_reuse(spark):
    import random

    from quantloom.operators import ranking

    rng = random.Random(3)
    rows = [(f, i, rng.choice([-1, 1]) * round(rng.random() ** 3 * 50, 3) if i % 7 else 0.0) for f in "ab" for i in range(3000)]
    frame = spark.createDataFrame(rows, "factor string, ticker int, value double").withColumn("year", F.lit(1))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        got = {(r["factor"], r["ticker"]): r["pct"] for r in ranking.share_at_or_below(frame, ["year"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for f in "ab":
        values = sorted(v for g, _, v in rows if g == f)
        for g, i, v in rows:
            if g == f:
                assert got[f, i] == pytest.approx(__import__("bisect").bisect_right(values, v) / len(values))
