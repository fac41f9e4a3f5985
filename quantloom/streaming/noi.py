"""Order-imbalance feed: parse frames, drop repeats, cap per ticker, aggregate by event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..sources.sinks import batch_ledger, read_ledger

#: Auction codes of the feed.
AUCTIONS = {"O": "early-open", "M": "open", "H": "halt-reopen", "C": "close", "P": "close-extreme", "R": "close-regulatory"}
EVENT = "type string, ticker string, timestamp_ns long, planned_at long, auction string, exchange string, imbalance double, paired double, clearing_price double, ts timestamp"


def parse_frames(messages: DataFrame) -> DataFrame:
    """Rows of JSON text in `value` -> events; frames of other kinds and broken ones are left out."""
    m = F.from_json("value", schemas.NOI_FRAME)
    at = lambda key, kind="string": F.col("m")[key].try_cast(kind)
    rows = messages.select(m.alias("m")).where(F.col("m")["ev"] == "NOI")
    return rows.select(
        at("ev").alias("type"), at("T").alias("ticker"), at("t", "long").alias("timestamp_ns"), at("at", "long").alias("planned_at"), at("a").alias("auction"), at("x").alias("exchange"),
        at("o", "double").alias("imbalance"), at("p", "double").alias("paired"), at("b", "double").alias("clearing_price"), F.timestamp_micros(F.call_function("div", at("t", "long"), F.lit(1000))).alias("ts"),
    )


def auction_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in AUCTIONS.items() for x in kv))[code], code, F.lit("?"))


def describe() -> Column:
    """One line of text for an event."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return F.concat(F.lit("[NOI] "), said("ticker"), F.lit(" "), auction_name(F.col("auction")), F.lit("@"), said("planned_at"), F.lit(" imbalance="), said("imbalance"), F.lit(" priced="), said("clearing_price"))


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (ticker, ts) once; state is kept only as long as repeats may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ticker", "ts"])


def by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """ticker, start, n, imbalance, last_imbalance per tumbling window of event time."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "ticker").agg(F.count("*").alias("n"), F.sum("imbalance").alias("imbalance"), F.max_by("imbalance", "ts").alias("last_imbalance"))
    return out.select("ticker", F.col("window.start").alias("start"), "n", "imbalance", "last_imbalance")


def of_tickers(events: DataFrame, tickers: list[str]) -> DataFrame:
    """Events of the subscribed tickers; "*" is all of them."""
    return events if "*" in tickers else events.where(F.col("ticker").isin(*(t.upper() for t in tickers)))


def capped(events: DataFrame, most: int, idle: timedelta = timedelta(days=1)) -> DataFrame:
    """At most `most` events of each ticker over the life of the stream. A number a ticker is all the state;
    it goes when the ticker has been idle for so long, after which its count starts anew."""

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "n long", int(idle.total_seconds() * 1000))

        def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
            n = self.seen.get()[0] if self.seen.exists() else 0
            for batch in rows:
                part = batch.head(most - n)
                n += len(part)
                if len(part):
                    yield part
            self.seen.update((n,))

        def close(self) -> None:
            pass

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("ticker").transformWithStateInPandas(Counter(), events.schema, "Append", "ProcessingTime")


class Monitor:
    """Runs a query until its ledger holds `stop_after` events in all, or `most` of one ticker.

    Every micro-batch goes to the ledger by its number (sinks.batch_ledger), so a batch that is replayed after
    a restart counts once. `stop_after` is exact: the stream itself ends there, whatever a batch holds.
    """

    def __init__(self, path: str, name: str = "monitor", stop_after: int | None = None, most: int | None = None):
        self.path, self.name, self.stop_after, self.most = path, name, stop_after, most

    def full(self, spark: SparkSession) -> bool:
        held = read_ledger(spark, self.path, EVENT)
        if self.stop_after is not None and held.count() >= self.stop_after:
            return True
        return self.most is not None and not held.groupBy("ticker").count().where(F.col("count") >= self.most).isEmpty()

    def run(self, events: DataFrame, checkpoint: str, trigger: dict, poll: float = 0.2) -> int:
        """Events delivered in all, once the query has ended: by a limit, or because its trigger says so."""
        spark = events.sparkSession
        shown = events if self.stop_after is None else events.limit(self.stop_after)
        query = shown.writeStream.foreachBatch(batch_ledger(self.path, self.name)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        batches = -1
        while query.isActive:
            done = (query.lastProgress or {}).get("batchId", -1)
            if done > batches and self.full(spark):
                query.stop()
            batches = done
            query.awaitTermination(poll)
        if query.exception() is not None:
            raise query.exception()
        return read_ledger(spark, self.path, EVENT).count()
