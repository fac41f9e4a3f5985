"""Decision ledgers: calibration, track records, consensus, journals, pending outcomes, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of the confidence buckets, the upper one exclusive.
BUCKETS = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.01))
#: The five-tier scale.
RATING_VALUE = {"Buy": 1.0, "Overweight": 0.5, "Hold": 0.0, "Underweight": -0.5, "Sell": -1.0}


def bucket(p: Column) -> Column:
    """The lower bound of the bucket that holds p, or null."""
    out = F.lit(None).cast("double")
    for lo, hi in BUCKETS:
        out = F.when((p >= lo) & (p < hi), lo).otherwise(out)
    return out


def fit_buckets(entries: DataFrame) -> DataFrame:
    """bucket, n, won, win_rate of all five buckets; empty ones stay, without a rate."""
    every = entries.sparkSession.createDataFrame([(lo,) for lo, _ in BUCKETS], "bucket double")
    got = entries.withColumn("bucket", bucket(F.col("confidence"))).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("won").alias("won"))
    out = every.join(F.broadcast(got), "bucket", "left").fillna(0, ["n", "won"])  # five rows
    return out.withColumn("win_rate", F.try_divide("won", "n"))


def calibrated(entries: DataFrame, table: DataFrame, least: int = 5) -> DataFrame:
    """Add calibrated_p: confidence drawn to its bucket's win rate by n / (2 least), 1 at most; buckets of
    under `least` entries leave it."""
    cells = table.select("bucket", F.col("n").alias("_n"), F.col("win_rate").alias("_w"))  # five rows
    out = entries.withColumn("bucket", bucket(F.col("confidence"))).join(F.broadcast(cells), "bucket", "left")
    p, trust = F.col("confidence"), F.least(F.lit(1.0), F.col("_n") / (2 * least))
    return out.withColumn("calibrated_p", F.when((F.col("_n") >= least) & F.col("_w").isNotNull(), p + trust * (F.col("_w") - p)).otherwise(p)).drop("_n", "_w")


def analyst_scores(ledger: DataFrame, now: str, half_life_days: float = 30.0) -> DataFrame:
    """analyst, hits, total, score: share of gains by weights that halve every half-life; ages under 0 count as 0."""
    age = F.greatest(F.lit(0), F.datediff(F.to_date(F.lit(now)), "date"))
    rows = ledger.withColumn("_w", F.pow(F.lit(0.5), age / half_life_days))
    won = F.col("delta_r") > 0
    return rows.groupBy(F.coalesce("analyst", F.lit("?")).alias("analyst")).agg(F.count_if(won).alias("hits"), F.count("*").alias("total"), F.try_divide(F.sum(F.when(won, F.col("_w")).otherwise(0.0)), F.sum("_w")).alias("score"))


def metrics(ledger: DataFrame) -> DataFrame:
    """analyst (null: overall), total, wins, win_rate, mean_alpha: both levels in one pass."""
    out = ledger.rollup("analyst").agg(F.count("*").alias("total"), F.count_if(F.col("delta_r") > 0).alias("wins"), F.avg("delta_r").alias("mean_alpha"))
    return out.select("analyst", "total", "wins", (F.col("wins") / F.col("total")).alias("win_rate"), "mean_alpha")


def reflection_hint(total: Column, score: Column, baseline: float = 0.5) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, "no-record").when(score >= baseline, "verify-winners").otherwise("critique")


def track_record(ledger: DataFrame, n: int = 20) -> DataFrame:
    """ticker, n, win_rate, mean_alpha over each ticker's last n outcomes."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("ord")))
    last = ledger.withColumn("_p", place).where(F.col("_p") <= n)
    return last.groupBy("ticker").agg(F.count("*").alias("n"), (F.count_if(F.col("delta_r") > 0) / F.count("*")).alias("win_rate"), F.avg("delta_r").alias("mean_alpha"))


def rating_value(rating: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in RATING_VALUE.items() for x in kv))[F.initcap(F.trim(rating))]


def agreement(ratings: DataFrame, keys: list[str], high_at: float = 0.7) -> DataFrame:
    """keys, n_valid, agreement (1 less half the spread of the ratings; null with under two), consensus."""
    rows = ratings.withColumn("_v", rating_value(F.col("rating")))
    out = rows.groupBy(*keys).agg(F.count("_v").alias("n_valid"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("_hi") - F.col("_lo")) / 2))
    out = out.withColumn("agreement", F.when(F.col("n_valid") >= 2, spread))
    return out.withColumn("consensus", F.when(F.col("agreement").isNull(), "unknown").when(F.col("agreement") >= high_at, "high").otherwise("low")).drop("_lo", "_hi")


def consensus(verdicts: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """keys, n, overlap, verdict: the most frequent verdict (the first seen of equals, by ord), or mixed."""
    counts = verdicts.groupBy(*keys, "verdict").agg(F.count("*").alias("_c"), F.min("ord").alias("_o"))
    out = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_c").alias("_top"), F.max_by("verdict", F.struct("_c", -F.col("_o"))).alias("_v"))
    out = out.withColumn("overlap", F.col("_top") / F.col("n"))
    return out.select(*keys, "n", "overlap", F.when(F.col("overlap") < threshold, "mixed").otherwise(F.col("_v")).alias("verdict"))


def blended_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, blended: mean by weight (1 where not given); missing scores are left out; 0 without any."""
    w = F.coalesce("weight", F.lit(1.0))
    held = F.col("score").isNotNull()
    return scores.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.when(held, w * F.col("score"))), F.sum(F.when(held, w))), F.lit(0.0)).alias("blended"))


def audit_summary(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict, n) and the distinct reasons in the order first seen (reason, first_ord)."""
    reasons = entries.select("ord", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.min("ord").alias("first_ord"))
    return entries.groupBy("verdict").agg(F.count("*").alias("n")), reasons


def journal_stats(rows: DataFrame, pillars: tuple[str, ...] = ("rvol", "high_volume", "gap", "price_band", "float")) -> DataFrame:
    """One row: trades, candidates, wins, losses, win_rate, avg_rr, fomo_count, and each pillar's pass rate over
    the trades in which it was measured."""
    wins, losses = F.count_if(F.col("exit_class") == "win"), F.count_if(F.col("exit_class") == "loss")
    rate = lambda k: F.round(F.try_divide(F.count_if(F.col("pillars")[k]), F.count(F.col("pillars")[k])), 3).alias(f"pass_{k}")
    return rows.agg(
        F.count("*").alias("trades"), F.count_if("pullback.candidate").alias("candidates"), wins.alias("wins"), losses.alias("losses"), F.try_divide(wins, wins + losses).alias("win_rate"),
        F.round(F.avg("pullback.rr"), 2).alias("avg_rr"), F.count_if("fomo").alias("fomo_count"), *map(rate, pillars),
    )


def resolve_pending(decisions: DataFrame, bars: DataFrame, benchmark: DataFrame, holding: int = 5) -> DataFrame:
    """Pending decisions (ticker, date, ...) of all tickers at once -> entry_date, held, raw, alpha.

    A decision enters at the first bar on or after its date and leaves `holding` bars later, or at the
    last bar there is; the benchmark is read on the same two dates. Nulls where no later bar exists.
    """
    from .events import asof_forward

    by = Window.partitionBy("ticker").orderBy("date")
    ahead = by.rowsBetween(0, holding)
    priced = bars.withColumns({"exit_close": F.last("close").over(ahead), "exit_date": F.last("date").over(ahead), "held": F.count("*").over(ahead) - 1})
    out = asof_forward(decisions.withColumnRenamed("date", "event_date"), priced, ("date", "close", "exit_close", "exit_date", "held"))
    bench = benchmark.select("date", "close")
    for at, name in (("bar_date", "_b0"), ("bar_exit_date", "_b1")):
        out = out.join(bench.select(F.col("date").alias(at), F.col("close").alias(name)), at, "left")
    raw = F.when(F.col("bar_held") > 0, F.col("bar_exit_close") / F.col("bar_close") - 1)
    out = out.withColumn("raw", raw).withColumn("alpha", F.col("raw") - (F.col("_b1") / F.col("_b0") - 1))
    return out.select("ticker", F.col("event_date").alias("date"), *(c for c in decisions.columns if c not in ("ticker", "date")), F.col("bar_date").alias("entry_date"), F.when(F.col("bar_held") > 0, F.col("bar_held")).alias("held"), "raw", "alpha")


def rotate(decisions: DataFrame, keep: int) -> DataFrame:
    """All pending decisions and the newest `keep` resolved ones: one partial top-k, no global sort."""
    done = decisions.where("not pending").orderBy(F.desc("date"), F.desc("ord")).limit(keep)
    return decisions.where("pending").unionByName(done)


def recent_tickers(ledger: DataFrame, limit: int = 10) -> DataFrame:
    """Distinct tickers by their latest entry."""
    return ledger.groupBy("ticker").agg(F.max("ord").alias("last_ord")).orderBy(F.desc("last_ord")).limit(limit)


def past_context(decisions: DataFrame, ticker, same: int = 5, others: int = 3) -> DataFrame:
    """The latest resolved decisions of a ticker, and of the others."""
    done = decisions.where("not pending")
    newest = [F.desc("date"), F.desc("ord")]
    own = done.where(F.col("ticker") == ticker).orderBy(*newest).limit(same).withColumn("kind", F.lit("same"))
    return own.unionByName(done.where(F.col("ticker") != ticker).orderBy(*newest).limit(others).withColumn("kind", F.lit("cross")))
