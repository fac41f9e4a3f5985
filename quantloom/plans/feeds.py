"""Queries on the frame log, the monitor and the ledgers that streams append to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import calendars, runs, sinks
from ..sources import warehouse as wh
from ..streaming import frame_log, noi
from . import sql as S
from .flows import EVENT_SQL, frames
from .registry import query


def _root(spark: SparkSession, name: str) -> str:
    return f"{wh.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _logged(spark, sf, root: str, part: int | None = None) -> DataFrame:
    """The feed's frames appended to a log (all, or one of two halves), and the log as a stream of events."""
    frame_log.register(spark)
    rows = frames(spark, sf)
    rows = rows if part is None else rows.where(F.pmod(F.xxhash64("value"), F.lit(2)) == part)
    rows.repartition(4).write.format("frame_log").mode("append").save(f"{root}/log")
    return noi.parse_frames(spark.readStream.format("frame_log").load(f"{root}/log"))


@query(f"WITH {EVENT_SQL} SELECT ticker, CAST(ts AS TIMESTAMP) AS ts, imbalance, clearing_price FROM ev")
def noi_replay(spark, sf):
    """Half of the feed, a restart from the checkpoint, the other half; every batch is delivered twice."""
    root = _root(spark, "replay")
    write = sinks.batch_ledger(f"{root}/ledger", "noi")

    def twice(rows: DataFrame, batch: int) -> None:
        write(rows, batch)
        write(rows, batch)

    for part in (0, 1):
        events = _logged(spark, sf, root, part)
        events.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_ledger(spark, f"{root}/ledger", noi.EVENT).select("ticker", "ts", "imbalance", "clearing_price")


@query(f"WITH {EVENT_SQL} SELECT least(count(*), 300) AS delivered, least(count(DISTINCT ticker), 3) AS tickers FROM ev WHERE ticker IN ('T1', 'T2', 'T3')")
def noi_monitor(spark, sf):
    """A monitor of three tickers that ends after 300 events in all."""
    root = _root(spark, "monitor")
    monitor = noi.Monitor(f"{root}/ledger", stop_after=300)
    monitor.run(noi.of_tickers(_logged(spark, sf, root), ["t1", "T2", "t3"]), f"{root}/state", {"availableNow": True})
    return sinks.read_ledger(spark, f"{root}/ledger", noi.EVENT).agg(F.count("*").alias("delivered"), F.count_distinct("ticker").alias("tickers"))


def _appended(spark, sf, name: str, schema: str, entries) -> DataFrame:
    """The orders' outcomes as a stream of several micro-batches, appended to a ledger of entries."""
    root = _root(spark, name)
    wh.outcomes(spark, sf).repartition(4).write.parquet(f"{root}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    query = entries(rows).writeStream.foreachBatch(sinks.batch_ledger(f"{root}/ledger", name)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sinks.read_ledger(spark, f"{root}/ledger", schema)


def _ord() -> Column:
    return F.col("ord").cast("double")


@query(S.with_(S.OUTCOMES, "SELECT analyst, CAST(ticker AS VARCHAR) AS ticker, CAST(date AS DATE) AS trade_date, round(delta_r, 6) + 0e0 AS delta_r, CAST(ord AS DOUBLE) AS ts FROM outcomes WHERE ord % 7 <> 0"))
def reflection_ledger(spark, sf):
    rows = _appended(spark, sf, "reflection", schemas.REFLECTION_LEDGER, lambda o: sinks.reflection_entries(o.select("analyst", "ticker", F.col("date").alias("trade_date"), F.when(F.col("ord") % 7 != 0, F.col("delta_r")).alias("alpha"), "ord"), _ord()))
    return rows.withColumn("delta_r", F.col("delta_r") + 0.0)


@query(S.with_(S.OUTCOMES, "SELECT analyst, CAST(ticker AS VARCHAR) AS ticker, CAST(date AS DATE) AS trade_date, CAST(confidence AS DOUBLE) AS confidence, coalesce(CASE WHEN ord % 5 <> 0 THEN delta_r > 0 END, false) AS won, CAST(ord AS DOUBLE) AS ts FROM outcomes"))
def calibration_ledger(spark, sf):
    won = F.when(F.col("ord") % 5 != 0, F.col("delta_r") > 0).alias("won")
    return _appended(spark, sf, "calibration", schemas.CALIBRATION_LEDGER, lambda o: sinks.calibration_entries(o.select("analyst", "ticker", F.col("date").alias("trade_date"), "confidence", won, "ord"), _ord()))


@query(S.with_(S.OUTCOMES, "SELECT CAST(ord AS DOUBLE) AS ts, upper(CAST(ticker AS VARCHAR)) AS ticker, CAST(date AS DATE) AS date, o_totalprice AS price, CASE WHEN ord % 2 = 0 THEN ord % 6 = 0 END AS rvol, ord % 10 = 0 AS gap, coalesce(confidence > 0.5e0, false) AS candidate, CASE WHEN ord % 5 <> 0 THEN CAST(ord % 4 AS DOUBLE) END AS rr, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' END AS exit_class, coalesce(CASE WHEN ord % 3 <> 0 THEN ord % 9 = 1 END, false) AS fomo, CASE WHEN ord % 2 = 0 THEN 2 ELSE 1 END AS n_pillars FROM outcomes"))
def momentum_journal(spark, sf):
    o = F.col("ord")

    def entries(rows: DataFrame) -> DataFrame:
        flags = F.map_from_arrays(F.array(F.lit("rvol"), F.lit("gap")), F.array(F.when(o % 2 == 0, o % 6 == 0), o % 10 == 0))
        pullback = F.struct((F.col("confidence") > 0.5).alias("candidate"), F.when(o % 5 != 0, (o % 4).cast("double")).alias("rr"), F.lit(None).cast("double").alias("stop"))
        exits = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss")
        trades = rows.select(F.col("ticker").cast("string").alias("ticker"), "date", F.col("o_totalprice").alias("price"), flags.alias("pillars"), pullback.alias("pullback"), F.lit(None).cast("map<string, boolean>").alias("session"), exits.alias("exit_class"), F.when(o % 3 != 0, o % 9 == 1).alias("fomo"), F.lit(None).cast("string").alias("note"), "ord")
        return sinks.journal_entries(trades, _ord())

    held = _appended(spark, sf, "journal", schemas.TRADE_JOURNAL, entries)
    return held.select("ts", "ticker", "date", "price", F.col("pillars")["rvol"].alias("rvol"), F.col("pillars")["gap"].alias("gap"), "pullback.candidate", "pullback.rr", "exit_class", "fomo", F.size("pillars").alias("n_pillars"))


def _fetcher(path: str, estimate: str):
    """What a calendar vendor answers for some days: here from a table that the tasks read themselves."""

    def fetch(begin, end):
        from pyarrow import dataset, fs

        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        day = dataset.field("day")
        found = dataset.dataset(folder, filesystem=store).to_table(filter=(day >= begin) & (day <= end))
        for row in found.to_pylist():
            yield row["security"], row["day"].isoformat(), row[estimate], row["actual"]

    return fetch


@query(S.with_(S.OUTCOMES, "SELECT 'T' || ticker AS security, date, o_totalprice AS eps_estimate, CASE WHEN ord % 3 <> 0 THEN o_totalprice - 1 END AS eps_actual FROM outcomes"))
def calendar_chunks(spark, sf):
    """The whole calendar of a vendor that answers for seven days at a time."""
    root = _root(spark, "calendar")
    o = wh.outcomes(spark, sf)
    actual = F.when(F.col("ord") % 3 == 0, F.element_at(F.array(*map(F.lit, (" n/a", "NA", "", "None"))), (F.col("ord") % 4 + 1).cast("int"))).otherwise((F.col("o_totalprice") - 1).cast("string"))
    o.select(F.concat(F.lit("T"), "ticker").alias("security"), F.col("date").alias("day"), F.col("o_totalprice").alias("estimate"), actual.alias("actual")).repartitionByRange(4, "day").write.parquet(f"{root}/vendor")
    first, last = o.agg(F.min("date"), F.max("date")).first()
    spark.dataSource.register(calendars.calendar_source("earnings_calendar", _fetcher(f"{root}/vendor", "estimate")))
    return calendars.canonical(calendars.read_calendar(spark, "earnings_calendar", str(first), str(last)))


@query(S.with_(S.FIN, "q AS (SELECT year, ticker, operating_income / 1000e0 AS ey FROM fin WHERE year IN (1996, 1997))", "t AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ey DESC, ticker) AS place FROM q)", "SELECT year AS run, 'screened' AS part, CAST(place AS INT) AS place, CAST(ticker AS VARCHAR) AS ticker, ey AS earnings_yield, CAST(NULL AS VARCHAR) AS rating, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS error FROM t WHERE place <= 10 UNION ALL SELECT year, 'analysed', NULL, CAST(ticker AS VARCHAR), NULL, CASE WHEN ticker % 3 <> 0 THEN CASE WHEN ticker % 2 = 0 THEN 'Buy' ELSE '-' END END, CASE WHEN ticker % 3 <> 0 THEN left('Run ' || year || ' says ' || repeat('yes ', 20), 60) END, CASE WHEN ticker % 3 = 0 THEN 'no data' END FROM q"))
def run_summaries(spark, sf):
    """Two runs' summaries in one table; the second run was first written with other rows and is then run again."""
    root, f = _root(spark, "runs"), wh.fundamentals(spark, sf)
    for run, times in ((1996, 1), (1997, 1000), (1997, 1)):
        own = f.where(F.col("year") == run).where(F.col("ticker") % times == 0)
        null = F.lit(None).cast("double")
        screened = own.select("ticker", (F.col("operating_income") / 1000.0).alias("earnings_yield"), null.alias("ev_ebit"), F.lit(None).cast("int").alias("fscore"), null.alias("mscore"), null.alias("zscore"))
        ok = F.col("ticker") % 3 != 0
        results = own.select("ticker", F.when(F.col("ticker") % 2 == 0, "Buy").alias("rating"), F.concat(F.lit(f"Run {run} says "), F.repeat(F.lit("yes "), F.lit(20))).alias("decision"), F.when(~ok, "no data").alias("error"))
        runs.replace_partitions(runs.summary(screened, results).withColumn("run", F.lit(run)), f"{root}/table", ["run"])
    return spark.read.schema(f"{runs.SUMMARY}, run int").parquet(f"{root}/table").select("run", "part", "place", "ticker", "earnings_yield", "rating", "decision", "error")
