"""Weights with hard caps, position sizes, tranches, exits and the risk governor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, or_default
from ..settings import Settings


def value_weights(scores: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """scores (ticker, score) -> with weight: positive scores by share of their sum, others min_weight.

    The sum is one aggregate row joined back, not a window over all rows.
    """
    total = scores.agg(F.sum(F.greatest("score", F.lit(0.0))).alias("_total"))
    out = scores.join(F.broadcast(total))  # one row
    return out.withColumn("weight", F.when(F.col("score") > 0, F.col("score") / F.col("_total")).otherwise(F.lit(min_weight))).drop("_total")


def adjust_for_caps(weights: DataFrame, name_cap: float = 0.25, sector_cap: float = 0.35) -> DataFrame:
    """Clip names, then scale down sectors above their cap; what is cut stays cash. Null sectors are one.

    Sector sums are pre-aggregated and joined, so a large sector is not one window task.
    """
    key = F.coalesce("sector", F.lit("?"))
    clipped = weights.withColumns({"_sector": key, "_w": F.least("weight", F.lit(name_cap))})
    sums = clipped.groupBy("_sector").agg(F.sum("_w").alias("_sum"))
    out = clipped.join(sums, "_sector")
    scale = F.when((F.col("_sum") > 0) & (F.col("_sum") > sector_cap), sector_cap / F.col("_sum")).otherwise(1.0)
    return out.withColumn("capped", F.col("_w") * scale).drop("_sector", "_w", "_sum")


def summary(weights: DataFrame, c: str = "weight", min_names: int = 10) -> DataFrame:
    """One row: names, active, allocated, min_names_ok, the three largest weights."""
    active = F.count_if(F.col(c) > 0)
    own = weights.agg(F.count("*").alias("names"), active.alias("active"), F.round(F.sum(c), 4).alias("allocated"), (active >= max(1, min_names)).alias("min_names_ok"))
    top = weights.orderBy(F.desc(c)).limit(3).agg(F.sort_array(F.collect_list(F.round(c, 4)), asc=False).alias("top3"))  # three rows
    return own.join(F.broadcast(top))


def kelly_fraction(p: Column, odds: float = 1.0) -> Column:
    q = clamp(p, 0.0, 1.0)
    return clamp((odds * q - (1 - q)) / odds, 0.0, 1.0) if odds > 0 else F.lit(0.0)


def kelly_size(p: Column, odds: float = 1.0, fraction: float = 0.25, most: float = 1.0) -> Column:
    return clamp(kelly_fraction(p, odds) * fraction, 0.0, most)


def size_with_risk(p: Column, odds: float, atr: Column, close: Column, risk: float = 0.01, cap: float = 1.0) -> Column:
    stop = F.when((close > 0) & (atr > 0), atr * 2 / close)
    return clamp(F.least(kelly_fraction(p, odds) * 0.25, F.coalesce(F.lit(risk) / stop, F.lit(cap)), F.lit(cap)), 0.0, cap)


def position_contract(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add stop_pct, stop_loss, vol_mult, size_pct, breakeven_stop, target.

    Wants close, atr, vol_scale; uses calibrated_p (else 0.5), distribution_score, agreement and
    catalyst_scale where they are not null (else they scale by 1).
    """
    c = F.col
    stop_pct = clamp(F.when(c("atr") > 0, s.atr_mult * c("atr") / c("close")).otherwise(0.02), 0.005, 0.5)
    vol = F.when(c("vol_scale") > 0, clamp(c("vol_scale"), 0.2, 1.5)).otherwise(1.0)
    kelly = kelly_size(F.coalesce("calibrated_p", F.lit(0.5)), s.position_odds, s.kelly_fraction, s.max_position_pct)
    scales = [F.coalesce(clamp(1 - c("distribution_score"), 0.0, 1.0), F.lit(1.0)), F.coalesce(clamp(c("agreement"), 0.0, 1.0), F.lit(1.0)), F.coalesce(clamp(c("catalyst_scale"), 0.0, 1.0), F.lit(1.0))]
    df = df.withColumns({"stop_pct": stop_pct, "vol_mult": vol, "kelly_part": kelly}).withColumn("risk_part", s.risk_per_trade / c("stop_pct"))
    size = F.least("kelly_part", "risk_part") * c("vol_mult") * scales[0] * scales[1] * scales[2]
    return df.withColumns({"stop_loss": c("close") * (1 - c("stop_pct")), "size_pct": clamp(size, 0.0, s.max_position_pct), "breakeven_stop": c("close") + c("atr"), "target": c("close") + 4 * c("atr")})


def tranche_plan(df: DataFrame, weights: tuple[float, float, float] = (0.3, 0.3, 0.4), stop_mult: float = 1.5, account: float = 100_000.0, risk_pct: float = 0.015) -> DataFrame:
    """Three entries an ATR apart with a common stop: prices, whole shares, capital at risk and peak.

    Wants close and atr. `valid` is false without a usable ATR or where the stop is not positive; the
    other columns are null there.
    """
    c = F.col
    p1, a = c("close"), c("atr")
    p2, p3 = p1 - a, p1 - 2 * a
    stop = p3 - stop_mult * a
    entry = weights[0] * p1 + weights[1] * p2 + weights[2] * p3
    df = df.withColumns({"p2": p2, "p3": p3, "stop": stop, "avg_entry": entry, "valid": F.coalesce((a > 0) & (p1 > 0) & (stop > 0) & (entry - stop > 0), F.lit(False))})
    per_share = c("avg_entry") - c("stop")
    df = df.withColumn("total_shares", F.when(c("valid"), F.floor(account * risk_pct / F.when(c("valid"), per_share))))
    df = df.withColumns({"n1": F.floor(c("total_shares") * weights[0]), "n2": F.floor(c("total_shares") * weights[1])}).withColumn("n3", c("total_shares") - c("n1") - c("n2"))
    risk = c("n1") * (p1 - c("stop")) + c("n2") * (c("p2") - c("stop")) + c("n3") * (c("p3") - c("stop"))
    peak = c("n1") * p1 + c("n2") * c("p2") + c("n3") * c("p3")
    return df.withColumns({"capital_at_risk_pct": risk / account, "peak_deployed_pct": peak / account, "tranche_t1": c("avg_entry") + 1.8 * per_share, "tranche_t2": c("avg_entry") + 3 * per_share})


def exit_check(entry: Column, close: Column, atr: Column, target_mult: float = 4.0, cushion: float = 1.0) -> dict[str, Column]:
    """The target is measured from the close, so it is met only where the ATR is 0."""
    even, goal = entry + cushion * atr, close + target_mult * atr
    return {"be_stop": even, "exit_target": goal, "exit_action": F.when(close >= goal, "target").when(close < even, "stop").otherwise("hold")}


def breakeven_win_rate(rr: Column) -> Column:
    return F.when(rr > 0, 1 / (1 + rr))


def expectancy(p: Column, win: Column, loss: Column) -> Column:
    q = clamp(p, 0.0, 1.0)
    return q * win - (1 - q) * or_default(loss, 1e-9)


def govern(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add governor (PASS, WARN, REJECT), reasons and touches; unknown measures are skipped.

    Wants size_pct, book_total_pct, cvar_pct, drawdown_pct, sector_pct, capital_at_risk_pct,
    risk_cap_pct, halted.
    """
    c = F.col
    lone = F.when(c("sector_pct") > 0, c("size_pct")).otherwise(0.0)
    reasons = {
        "size": c("size_pct") > s.max_position_pct,
        "book": c("book_total_pct") + c("size_pct") > s.max_book_position_pct,
        "cvar": c("cvar_pct") > s.cvar_budget_pct,
        "capital-at-risk": c("capital_at_risk_pct") > c("risk_cap_pct"),
        "drawdown": c("drawdown_pct") > s.max_drawdown_pct,
        "sector": c("sector_pct") + lone > s.sector_cap,
    }
    near = {
        "size": (c("size_pct") >= 0.9 * s.max_position_pct) & ~reasons["size"],
        "cvar": (c("cvar_pct") >= 0.7 * s.cvar_budget_pct) & ~reasons["cvar"],
        "capital-at-risk": (c("capital_at_risk_pct") >= 0.9 * c("risk_cap_pct")) & ~reasons["capital-at-risk"],
    }
    held = lambda tests: F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    sized = c("size_pct").isNotNull()
    none = F.array().cast("array<string>")
    df = df.withColumns({"reasons": F.when(c("halted"), F.array(F.lit("halt"))).when(sized, held(reasons)).otherwise(none), "touches": F.when(sized & ~c("halted"), held(near)).otherwise(none)})
    return df.withColumn("governor", F.when(F.size("reasons") > 0, "REJECT").when(F.size("touches") > 0, "WARN").otherwise("PASS"))


def rebalance_due(days_since: Column, interval: int = 30) -> Column:
    return F.coalesce(days_since >= max(1, interval), F.lit(False))


def snapshot_text() -> Column:
    """One line for a governed row: verdict, size, stop and reasons; unknown parts are left out."""
    pct = lambda c: F.concat(F.lit(f"{c}="), F.format_number(F.col(c) * 100, 1), F.lit("%"))
    reasons = F.when(F.size("reasons") > 0, F.concat(F.lit("reasons="), F.array_join("reasons", " | ")))
    return F.concat(F.lit("risk snapshot: "), F.concat_ws("; ", F.concat(F.lit("verdict="), F.col("governor")), pct("size_pct"), pct("drawdown_pct"), reasons))
