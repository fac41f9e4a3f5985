"""Return series: performance, drawdown, tail risk, portfolios, walk-forward checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR = 252.0


def total_return(r: str = "r") -> Column:
    """Compounded; nulls are skipped; a loss of everything or more gives -1."""
    growth = F.sum(F.when(F.col(r) > -1, F.log1p(F.col(r))))
    return F.when(F.count_if(F.col(r) <= -1) > 0, -1.0).otherwise(F.coalesce(F.exp(growth) - 1, F.lit(0.0)))


def performance(df: DataFrame, keys: list[str], r: str = "r", trials: int = 100, risk_free: float = 0.0) -> DataFrame:
    """keys, n, total_return, cagr, volatility, sharpe, deflated_sharpe; one aggregate, partial sums first."""
    out = df.groupBy(*keys).agg(F.count(r).alias("n"), total_return(r).alias("total_return"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("_sd"))
    cagr = F.when(F.col("n") > 0, F.pow(1 + F.col("total_return"), YEAR / F.col("n")) - 1).otherwise(0.0)
    out = out.withColumns({"cagr": cagr, "volatility": F.when(F.col("n") > 1, F.col("_sd") * math.sqrt(YEAR)).otherwise(0.0)})
    out = out.withColumn("sharpe", F.when(F.col("volatility") > 0, (F.col("cagr") - risk_free) / F.col("volatility")).otherwise(0.0))
    penalty = math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0
    return out.withColumn("deflated_sharpe", F.col("sharpe") - penalty).drop("_sd")


def drawdowns(df: DataFrame, start: float = 100.0) -> DataFrame:
    """ticker, max_drawdown, final_equity of the compounded curve of r (null as 0)."""
    run = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = df.withColumn("_e", start * F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(run)))
    curve = curve.withColumn("_d", 1 - F.col("_e") / F.max("_e").over(run))
    return curve.groupBy("ticker").agg(F.max("_d").alias("max_drawdown"), F.max_by("_e", "date").alias("final_equity"))


def tail_risk(df: DataFrame, keys: list[str], r: str = "r", alpha: float = 0.05, digits: int = 9) -> DataFrame:
    """keys, n, var, cvar: the k-th smallest return and the mean of the k smallest, k = max(1, int(alpha n)).

    Works on counts of distinct returns, rounded to `digits`, so ties and hot keys shrink before the
    sort; the running count in a key then finds the k-th.
    """
    rows = df.where(F.col(r).isNotNull()).groupBy(*keys, F.round(r, digits).alias("_r")).agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*keys)
    upto = F.sum("_c").over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_upto": upto, "_n": F.sum("_c").over(by)}).withColumn("_k", F.greatest(F.lit(1), F.floor(alpha * F.col("_n"))))
    used = rows.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_k") - (F.col("_upto") - F.col("_c"))))).where("_take > 0")
    return used.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_r").alias("var"), (F.sum(F.col("_r") * F.col("_take")) / F.max("_k")).alias("cvar"))


def cvar_budget(df: DataFrame, names: DataFrame, keys: list[str], r: str = "r", alpha: float = 0.05, budget: float = 0.05) -> DataFrame:
    """names (keys) with tail, the mean of the k smallest returns (0 without returns), and within, whether the
    tail's loss fits the budget."""
    tails = tail_risk(df, keys, r, alpha).select(*keys, F.col("cvar").alias("tail"))
    return names.join(tails, keys, "left").withColumn("tail", F.coalesce("tail", F.lit(0.0))).withColumn("within", F.greatest(-F.col("tail"), F.lit(0.0)) <= abs(budget))


def normalised_weights(weights: DataFrame) -> DataFrame:
    """weights (book, ticker, weight) -> share: equal where their sum is not positive, scaled down to 1
    where above 1, as they are between (the rest is cash)."""
    sums = weights.groupBy("book").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("_sum"), F.count("*").alias("_names"))
    w = F.coalesce("weight", F.lit(0.0))
    share = F.when(F.col("_sum") <= 0, 1.0 / F.col("_names")).when(F.col("_sum") > 1, w / F.col("_sum")).otherwise(w)
    return weights.join(sums, "book").select("book", "ticker", share.alias("share"), F.col("_names").alias("names"))


def portfolio_returns(shares: DataFrame, returns: DataFrame) -> DataFrame:
    """book, place, r: weighted sum by place in the series; a place counts only where every name has a return.

    returns: ticker, place, r. A book of under two names has no rows.
    """
    legs = shares.where("names >= 2").join(returns, "ticker")
    out = legs.groupBy("book", "place").agg(F.sum(F.col("share") * F.col("r")).alias("r"), F.count("r").alias("_legs"), F.max("names").alias("_names"))
    return out.where("_legs = _names").select("book", "place", "r")


def stress_loss(weights: DataFrame, shock: float = -0.10) -> DataFrame:
    return weights.groupBy("book").agg((-shock * F.sum(F.greatest("weight", F.lit(0.0)))).alias("stress_loss"))


def walk_forward(returns: DataFrame, train: int = 60, test: int = 20) -> DataFrame:
    """ticker, split, part (train or test), n, sharpe and the rest of performance().

    Every return is in one test run and at most ceil(train / test) training runs: an explode by
    arithmetic, not a join.
    """
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    rows = returns.withColumns({"_i": place, "_n": F.count("*").over(Window.partitionBy("ticker"))})
    last = F.floor((F.col("_n") - train - test) / test)  # the last split that is whole
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("_i") - train + 1) / test)), F.least(last, F.floor(F.col("_i") / test))
    none = F.array().cast("array<bigint>")
    in_train = F.transform(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(none), lambda s: F.struct(s.alias("split"), F.lit("train").alias("part")))
    at = F.floor((F.col("_i") - train) / test)
    in_test = F.transform(F.when((at >= 0) & (at <= last), F.array(at.cast("long"))).otherwise(none), lambda s: F.struct(s.alias("split"), F.lit("test").alias("part")))
    rows = rows.where("_n >= %d" % (train + test)).withColumn("_s", F.explode(F.concat(in_train, in_test)))
    return performance(rows.select("ticker", "_s.split", "_s.part", "r"), ["ticker", "split", "part"])


def overfit(splits: DataFrame, threshold: float = -0.1) -> DataFrame:
    """ticker, n_splits, in_best, oos_of_best, oos_best, overfit: whether the split that is best in training
    (the first of equals) falls under the threshold in its test run."""
    wide = splits.groupBy("ticker", "split").agg(F.max(F.when(F.col("part") == "train", F.round("sharpe", 9))).alias("in_s"), F.max(F.when(F.col("part") == "test", F.round("sharpe", 9))).alias("oos_s"))
    out = wide.groupBy("ticker").agg(F.count("*").alias("n_splits"), F.max("in_s").alias("in_best"), F.max_by("oos_s", F.struct("in_s", -F.col("split"))).alias("oos_of_best"), F.max("oos_s").alias("oos_best"))
    return out.withColumn("overfit", F.col("oos_of_best") < threshold)


def config_gate(returns: DataFrame, train: int = 60, test: int = 20, trials: int = 20) -> DataFrame:
    """ticker, ok, reason: walk-forward splits must not overfit and the deflated Sharpe ratio be positive."""
    split = overfit(walk_forward(returns, train, test))
    whole = performance(returns, ["ticker"], trials=trials).select("ticker", "deflated_sharpe")
    out = whole.join(split, "ticker", "left")
    reason = F.when(F.col("n_splits").isNull(), "too few samples").when(F.col("overfit"), "PBO").when(F.col("deflated_sharpe") <= 0, "deflated_sharpe<=0").otherwise("pass")
    return out.select("ticker", F.when(F.col("n_splits").isNotNull(), reason == "pass").alias("ok"), reason.alias("reason"), "deflated_sharpe", "n_splits")
