"""Cross-sectional ranks, composites, gate cascades and statement label matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INF = float("inf")


def watchlist_order() -> list[Column]:
    """Earnings yield falling (missing as -1), then EV / EBIT rising (missing last)."""
    return [F.coalesce("earnings_yield", F.lit(-1.0)).desc(), F.coalesce("ev_ebit", F.lit(INF)).asc()]


def watchlist(screened: DataFrame, top: int) -> DataFrame:
    """The first `top` rows by the watchlist order, ties by ticker, with their rank: a partial top-k in
    every task, then one merge."""
    best = screened.orderBy(*watchlist_order(), "ticker").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*watchlist_order(), "ticker")))


def unpivot_factors(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """keys, factor, value: one row for each measured factor."""
    return df.unpivot(keys, names, "factor", "value").where("value is not null")


def share_at_or_below(factors: DataFrame, keys: list[str], ranges: int = 256) -> DataFrame:
    """Add pct: the share of the factor's values that are not above this one (ties included; 0 and -0 are one).

    Factors number a few, so a window per factor would sort all rows in as many tasks. Instead the distinct
    values are counted first and cut at approximate quantiles into `ranges` of about equal size. Running counts
    come from each range's total, so no task holds a whole factor; wherever the cuts fall, the counts are exact.
    """
    group = [*keys, "factor"]
    rows = factors.withColumn("value", F.col("value") + F.lit(0.0))
    counts = rows.groupBy(*group, "value").agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    placed = counts.join(cuts, group).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    inner = Window.partitionBy(*group, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"))
    every = Window.partitionBy(*group)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_size").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_size").over(every)})
    shares = placed.withColumn("_upto", F.sum("_n").over(inner)).join(parts.drop("_size"), [*group, "_part"])
    shares = shares.select(*group, "value", ((F.col("_before") + F.col("_upto")) / F.col("_all")).alias("pct"))
    return rows.join(shares, [*group, "value"])


def composite(factors: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """keys, ticker, composite: mean over a ticker's factors of weight * pct; a negative weight takes
    1 - pct. The divisor is the number of factors, not the sum of weights."""
    pct = share_at_or_below(factors, keys)
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("factor")], F.lit(1.0))
    part = F.when(w >= 0, w * F.col("pct")).otherwise(w * (1 - F.col("pct")))
    return pct.groupBy(*keys, "ticker").agg(F.avg(part).alias("composite"), F.count("*").alias("n_factors"))


def measured(test: Column, value: Column) -> Column:
    """A gate that applies only where its value is measured."""
    return value.isNull() | test


def gate_cascade(df: DataFrame, price_min: float = 15.0, pe_max: float = 40.0, min_cap: float = 10e9, min_volume: float = 1e6, min_atr_pct: float = 2.0) -> DataFrame:
    """Add `failed`: the first gate that a mover fails, null for those that pass all.

    Hard gates fail on missing values; growth and quality gates only count where measured. Wants
    not_equity, price, pe, market_cap, avg_volume, atr_pct, eps_yoy, revenue_yoy, roe.
    """
    c = F.col
    no = lambda test: ~F.coalesce(test, F.lit(False))
    gates = [
        ("non_equity", c("not_equity")),
        ("price", no(c("price") >= price_min)),
        ("pe", no((c("pe") > 0) & (c("pe") <= pe_max))),
        ("market_cap", no(c("market_cap") >= min_cap)),
        ("volume", no(c("avg_volume") >= min_volume)),
        ("atr", no(c("atr_pct") >= min_atr_pct)),
        ("eps_growth", ~measured(c("eps_yoy") >= 0.0, c("eps_yoy"))),
        ("revenue_growth", ~measured(c("revenue_yoy") >= 0.0, c("revenue_yoy"))),
        ("roe", ~measured(c("roe") >= 0.0, c("roe"))),
    ]
    out = F.lit(None).cast("string")
    for name, failed in reversed(gates):
        out = F.when(failed, name).otherwise(out)
    return df.withColumn("failed", out)


def match_labels(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """items (ticker, period, label, ord, value) x aliases (canonical, alias, alias_ord): canonical values.

    A label matches an alias it contains, in lower case with runs of other characters as single
    blanks; labels that begin with "-" are parts of others and never match. The first alias wins,
    then the first label. The distinct labels meet the aliases, a fixed list, by words: every word run
    of the label that could be an alias is a join key, so nothing is compared pairwise.
    """
    from ..functions.text import norm

    words = F.split(norm(F.col("label")), " ")
    texts = items.where(~F.col("label").startswith("-")).select("label").distinct().withColumn("_text", norm(F.col("label"))).withColumn("_words", words)
    first_word = aliases.withColumn("_alias", norm(F.col("alias"))).withColumn("_key", F.substring("_alias", 1, 3))
    grams = texts.withColumn("_key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_text") - 2)), lambda i: F.substring(F.col("_text"), i, F.lit(3))))))
    hits = grams.join(first_word, "_key").where(F.col("_text").contains(F.col("_alias")) & (F.col("_alias") != "")).select("label", "canonical", "alias_ord").distinct()
    best = hits.groupBy("label", "canonical").agg(F.min("alias_ord").alias("alias_ord"))
    rows = items.join(best, "label")
    return rows.groupBy("ticker", "period", "canonical").agg(F.min_by(F.struct("label", "value"), F.struct("alias_ord", "ord")).alias("_b")).select("ticker", "period", "canonical", "_b.label", "_b.value")
