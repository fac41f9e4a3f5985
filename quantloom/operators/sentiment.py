"""Sentiment of messages: weighted means, counts, velocity and surprise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_score(label: Column) -> Column:
    """1, -1, 0 or null (not understood); a missing label is neutral."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(text.isin("bullish", "positive", "buy", "long"), 1.0).when(text.isin("bearish", "negative", "sell", "short"), -1.0).when(text.isin("neutral", "hold", "flat", ""), 0.0)


def decayed_weight(age_days: Column, half_life: float = 7.0) -> Column:
    return F.when(age_days < 0, 0.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def weighted_sentiment(messages: DataFrame, keys: list[str], half_life: float = 7.0) -> DataFrame:
    """keys, n, sentiment: mean score by age decay and credibility; scores beyond +-1 are dropped; null
    where no weight is left."""
    score = F.coalesce("score", label_score(F.col("label"))) if "score" in messages.columns else label_score(F.col("label"))
    weight = decayed_weight(F.coalesce("age_days", F.lit(0)), half_life) * F.greatest(F.lit(0.0), F.coalesce("credibility", F.lit(1.0)))
    rows = messages.withColumns({"_s": score, "_w": weight}).where("_s between -1 and 1")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_s") * F.col("_w")), F.sum("_w")).alias("sentiment"))


def counts_score(bull: Column, bear: Column) -> Column:
    return F.round(F.try_divide(bull - bear, bull + bear), 4)


def latest_counts(messages: DataFrame, limit: int = 30) -> DataFrame:
    """ticker, bullish, bearish, unlabeled, score over each ticker's latest messages.

    Times are cut by each ticker's limit-th latest, found over counts per hour first, so that a ticker
    with most of the messages does not sort them all in one task.
    """
    hours = messages.groupBy("ticker", F.date_trunc("hour", "ts").alias("_h")).agg(F.count("*").alias("_n"))
    later = Window.partitionBy("ticker").orderBy(F.desc("_h")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = hours.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_after") < limit)
    cut = wanted.groupBy("ticker").agg(F.min("_h").alias("_from"))
    recent = messages.join(cut, "ticker").where("ts >= _from")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts"), F.desc("ord")))
    last = recent.withColumn("_p", place).where(F.col("_p") <= limit)
    out = last.groupBy("ticker").agg(F.count_if(F.col("label") == "bullish").alias("bullish"), F.count_if(F.col("label") == "bearish").alias("bearish"), F.count("*").alias("_all"))
    return out.select("ticker", "bullish", "bearish", (F.col("_all") - F.col("bullish") - F.col("bearish")).alias("unlabeled"), counts_score(F.col("bullish"), F.col("bearish")).alias("score"))


def daily_scores(messages: DataFrame) -> DataFrame:
    """ticker, date, n, score: by counts of labelled messages per day."""
    day = messages.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "bullish").alias("bull"), F.count_if(F.col("label") == "bearish").alias("bear"))
    return day.withColumn("score", counts_score(F.col("bull"), F.col("bear")))


def velocity(daily: DataFrame, window: int = 5) -> DataFrame:
    """Add velocity: least-squares slope of the last scores (nulls left out); null with under three."""
    rows = daily.where("score is not null").withColumn("_i", F.row_number().over(Window.partitionBy("ticker").orderBy("date")).cast("double"))
    own = F.regr_slope("score", "_i").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - window, 0))
    return rows.withColumn("velocity", F.when(F.col("_i") >= 3, own)).drop("_i")


def surprise(daily: DataFrame, baseline: int = 30, least: int = 8) -> DataFrame:
    """Add surprise_z: the score against the up to 30 before it, by population deviation; 0 where they are flat."""
    rows = daily.where("score is not null")
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(-baseline, -1)
    sd = F.stddev_pop("score").over(before)
    z = F.when(sd <= 1e-9, 0.0).otherwise((F.col("score") - F.avg("score").over(before)) / F.when(sd > 1e-9, sd))
    return rows.withColumn("surprise_z", F.when(F.count("score").over(before) >= least, z))


def mention_volume(daily: DataFrame, recent: int = 1) -> DataFrame:
    """ticker, mention_volume: mentions of the last days against the mean of the days before (1 at least)."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    rows = daily.withColumn("_new", place <= recent)
    base = F.greatest(F.lit(1.0), F.coalesce(F.avg(F.when(~F.col("_new"), F.col("n"))), F.lit(1.0)))
    return rows.groupBy("ticker").agg((F.sum(F.when(F.col("_new"), F.col("n"))) / base).alias("mention_volume"))
