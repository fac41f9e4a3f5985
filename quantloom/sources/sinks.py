"""Writers: append-only ledgers, decisions written once, outcomes merged into staged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_ledger(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("append").format(fmt).save(path)


def batch_ledger(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends to a ledger: each batch of a stream has a folder of its own, told from its
    number, and a batch that Spark delivers again replaces what its first try left."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch}")

    return write


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger's entries by all streams; empty if there are none yet."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, stream string, batch long").parquet(path).drop("stream", "batch")


def _now(ts: Column | None) -> Column:
    return F.unix_micros(F.current_timestamp()) / 1e6 if ts is None else ts


def reflection_entries(outcomes: DataFrame, ts: Column | None = None, enabled: bool = True) -> DataFrame:
    """outcomes (analyst, ticker, trade_date, alpha) -> entries of the reflection ledger; outcomes without an alpha
    are none, and nothing is written where reflection is off."""
    rows = outcomes.where(F.col("alpha").isNotNull() & F.lit(enabled))
    return rows.select("analyst", F.col("ticker").cast("string").alias("ticker"), F.col("trade_date").cast("date").alias("trade_date"), F.round(F.col("alpha").cast("double"), 6).alias("delta_r"), _now(ts).alias("ts"))


def calibration_entries(outcomes: DataFrame, ts: Column | None = None) -> DataFrame:
    """outcomes (analyst, ticker, trade_date, confidence, won) -> entries of the calibration ledger; an unknown end is no win."""
    return outcomes.select("analyst", F.col("ticker").cast("string").alias("ticker"), F.col("trade_date").cast("date").alias("trade_date"), F.col("confidence").cast("double").alias("confidence"), F.coalesce("won", F.lit(False)).alias("won"), _now(ts).alias("ts"))


def journal_entries(trades: DataFrame, ts: Column | None = None) -> DataFrame:
    """trades -> entries of the trade journal (schemas.TRADE_JOURNAL). Pillars and session flags that are null are
    left out of their maps, an open trade has no exit class, the date is today's where none is given."""
    known = lambda c: F.map_filter(F.coalesce(c, F.create_map().cast("map<string, boolean>")), lambda k, v: v.isNotNull())
    pullback = F.struct(F.coalesce(F.col("pullback.candidate"), F.lit(False)).alias("candidate"), F.col("pullback.rr").alias("rr"), F.col("pullback.stop").alias("stop"))
    return trades.select(
        _now(ts).alias("ts"), F.upper("ticker").alias("ticker"), F.coalesce(F.col("date").cast("date"), F.current_date()).alias("date"), F.col("price").cast("double").alias("price"),
        known(F.col("pillars")).alias("pillars"), pullback.alias("pullback"), known(F.col("session")).alias("session"), "exit_class", F.coalesce("fomo", F.lit(False)).alias("fomo"), "note",
    )


def new_decisions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming decisions whose (date, ticker) is not pending yet; repeats among them are one."""
    held = stored.where("pending").select("date", "ticker")
    return incoming.dropDuplicates(["date", "ticker"]).join(held, ["date", "ticker"], "left_anti")


def with_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decisions with pending ones resolved where an outcome (date, ticker, raw, alpha, holding_days,
    reflection) exists. Outcomes are unique by date and ticker; the result replaces the table."""
    names = ("raw", "alpha", "holding_days", "reflection")
    new = outcomes.select("date", "ticker", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit"))
    joined = decisions.join(new, ["date", "ticker"], "left")
    use = F.col("pending") & F.coalesce("_hit", F.lit(False))
    out = joined.withColumns({c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in names} | {"pending": F.col("pending") & ~use})
    return out.select(decisions.columns)


def replace_table(rows: DataFrame, path: str, staging: str) -> None:
    """Write to a staging path, then swap it with the target by renaming: rows may read the target, a job
    that fails leaves it, and a swap that fails puts it back. Both paths are on one file system."""
    rows.write.mode("overwrite").parquet(staging)
    jvm = rows.sparkSession.sparkContext._jvm
    new, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path, f"{path.rstrip('/')}.old"))
    store = target.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if store.exists(old):
        store.delete(old, True)
    held = store.exists(target)
    if held and not store.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not store.rename(new, target):
        if held:
            store.rename(old, target)
        raise OSError(f"{staging} can't be moved to {path}")
    store.delete(old, True)


def markdown(rows: DataFrame, most: int = 50) -> str:
    """A table of the first rows as markdown; columns without any value among them are left out."""
    head = rows.limit(most).collect()  # `most` rows
    shown = [c for c in rows.columns if any(r[c] is not None for r in head)]
    lines = ["| " + " | ".join(shown) + " |", "|" + " --- |" * len(shown)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c]) for c in shown) + " |" for r in head])
