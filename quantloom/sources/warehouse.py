"""Market views over the warehouse tables.

Every view is a lazy DataFrame. Prices are a walk over each supplier's daily mean discount, in whole
millionths, so that a running sum is exact in any order; levels are rounded to four decimals by plain arithmetic.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(x: Column, digits: int) -> Column:
    """Rounded half up by plain arithmetic, so that ties fall alike in every engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _hundredths(c: str) -> Column:
    return F.sum(F.round(F.col(c) * 100).cast("long"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, bar (1-based place in the series), open, high, low, close, volume, vwap.

    Two exchanges: one for the daily sums (partial sums first), one by ticker for the walk.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax", "l_quantity")
    daily = lines.groupBy("ticker", "date").agg(_hundredths("l_discount").alias("d"), _hundredths("l_tax").alias("t"), F.count("*").alias("n"), F.sum("l_quantity").alias("volume"))
    by = Window.partitionBy("ticker").orderBy("date")
    step = F.floor(F.lit(4000.0) * F.col("d") / F.col("n") - 20000.0)
    walk = F.sum(step).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = daily.select("ticker", "date", "volume", F.row_number().over(by).alias("bar"), places(100.0 * F.exp(walk / 1e6), 4).alias("close"), (F.col("t") / (F.col("n") * 100.0)).alias("tax"))
    out = out.withColumn("open", places(F.coalesce(F.lag("close").over(by), F.lit(100.0)) * (1 + 0.1 * (F.col("tax") - 0.04)), 4))
    out = out.withColumn("high", places(F.greatest("open", "close") * (1 + 0.1 * F.col("tax")), 4)).withColumn("low", places(F.least("open", "close") * (1 - 0.1 * F.col("tax")), 4))
    return out.select("ticker", "date", "bar", "open", "high", "low", "close", "volume", places((F.col("high") + F.col("low") + F.col("close")) / 3, 4).alias("vwap"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, bar, close of the walk over all lines' mean discount per date.

    One row per calendar date, so the walk's single window is bounded by the calendar, not the data.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_discount")
    daily = lines.groupBy("date").agg(_hundredths("l_discount").alias("d"), F.count("*").alias("n"))
    by = Window.orderBy("date")
    walk = F.sum(F.floor(F.lit(4000.0) * F.col("d") / F.col("n") - 20000.0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("date", F.row_number().over(by).alias("bar"), places(100.0 * F.exp(walk / 1e6), 4).alias("close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector: a supplier's region."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


#: Statement items that get a value of the year before.
ITEMS = ("revenue", "cogs", "sga", "receivables", "current_assets", "total_assets", "ppe", "securities", "depreciation", "current_liabilities", "total_debt", "net_income", "cfo")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, year, statement items in whole cents turned to doubles, and <item>_prior.

    The economics are arbitrary: the view exists to exercise formulas.
    """
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    priced = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    ext = F.col("l_extendedprice")
    sums = priced.groupBy(F.col("l_suppkey").alias("ticker"), "year").agg(
        cents(ext * (1 - F.col("l_discount"))).alias("revenue_c"),
        cents(F.col("p_retailprice") * F.col("l_quantity")).alias("cost_c"),
        cents(ext * F.col("l_tax")).alias("sga_c"),
        cents(F.when(F.col("l_linestatus") == "O", ext).otherwise(0.0)).alias("recv_c"),
        cents(F.col("p_retailprice")).alias("ppe_c"),
        cents(ext * F.col("l_discount")).alias("liab_c"),
        F.sum("l_quantity").alias("shares"),
    )
    held = sums.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.abs("s_acctbal").alias("cash")), "ticker")
    d = lambda c: F.col(c) / 100.0
    out = held.select(
        "ticker", "year", "shares", "cash",
        d("revenue_c").alias("revenue"), (d("cost_c") * 0.5).alias("cogs"), d("sga_c").alias("sga"), (d("recv_c") * 0.2 + 1.0).alias("receivables"), d("ppe_c").alias("ppe"), d("liab_c").alias("total_liabilities"),
    )
    out = out.withColumn("operating_income", F.col("revenue") - F.col("cogs") - F.col("sga"))
    out = out.withColumn("net_income", F.col("operating_income") * 0.79).withColumn("current_assets", F.col("receivables") + F.col("cash"))
    out = out.withColumn("total_assets", F.col("current_assets") + F.col("ppe") * 10).withColumn("depreciation", F.col("ppe") * 0.1 + F.col("sga") * 0.01)
    out = out.withColumn("cfo", F.col("net_income") + F.col("depreciation") - F.col("receivables") * 0.5).withColumn("capex", F.col("ppe") * 0.3)
    out = out.withColumn("securities", F.col("cash") * 0.25).withColumn("current_liabilities", F.col("total_liabilities") * 0.4).withColumn("total_debt", F.col("total_liabilities") * 0.3)
    out = out.withColumn("working_capital", F.col("current_assets") - F.col("current_liabilities")).withColumn("retained_earnings", F.col("net_income") * 0.5)
    out = out.withColumn("total_equity", F.col("total_assets") - F.col("total_liabilities")).withColumn("market_cap", F.col("shares") * 100.0)
    by = Window.partitionBy("ticker").orderBy("year")
    return out.select("*", *(F.lag(c).over(by).alias(f"{c}_prior") for c in ITEMS))


RATING_OF = {"1-URGENT": "Buy", "2-HIGH": "Overweight", "3-MEDIUM": "Hold", "4-NOT SPECIFIED": "Underweight", "5-LOW": "Sell"}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision ledger: ord, analyst, ticker, date, rating, delta_r, confidence, won."""
    orders = table(spark, sf_dir, "orders")
    mean = orders.groupBy("o_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*")).alias("mean_c"))
    rating = F.create_map(*(F.lit(x) for kv in RATING_OF.items() for x in kv))
    delta = F.round(F.col("o_totalprice") * 100 / F.col("mean_c") - 1, 6)
    out = orders.join(mean, "o_custkey").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("analyst"), F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"),
        rating[F.col("o_orderpriority")].alias("rating"), delta.alias("delta_r"), ((F.col("o_orderkey") * 37 % 100) / 100.0).alias("confidence"), "o_totalprice", "o_orderstatus",
    )
    return out.withColumn("won", F.col("delta_r") > 0)


LABEL_OF = {"purchase": "bullish", "signup": "bullish", "error": "bearish", "view": "neutral", "click": "neutral"}


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: ord, ticker, ts, label, credibility, age_days at 2024-02-01."""
    label = F.create_map(*(F.lit(x) for kv in LABEL_OF.items() for x in kv))
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("ticker"), "ts", label[F.col("event_type")].alias("label"), (F.col("value") / 100).alias("credibility"), age.alias("age_days"), "event_type", "value", "props",
    )


def returns(bar_view: DataFrame) -> DataFrame:
    """ticker, date, bar, r: simple daily returns of bars; the first bar has none and is left out."""
    by = Window.partitionBy("ticker").orderBy("date")
    return bar_view.select("ticker", "date", "bar", (F.col("close") / F.lag("close").over(by) - 1).alias("r")).where("r is not null")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set in code.

    Only a local master may do without: it gets a folder of its own. On a cluster its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
