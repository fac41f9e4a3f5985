"""Tables of runs: a run's rows replace that run's rows only; and what a run's stages took."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import safe_path_part
from ..operators.ranking import watchlist

SUMMARY = "part string, place int, ticker string, earnings_yield double, ev_ebit double, fscore int, mscore double, zscore double, rating string, decision string, error string"
#: Longest decision or error in a summary.
SHORT = 60


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows to a table partitioned by `by`: partitions that occur in rows are replaced, others stay. A rerun of
    a run thus replaces it, whatever it wrote before."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def summary(screened: DataFrame, results: DataFrame, top: int = 10) -> DataFrame:
    """A run's summary as rows: the best `top` candidates by composite rank (part "screened"), then every analysed
    ticker by name (part "analysed") with its rating and decision, or the error that it ended with."""
    best = watchlist(screened, top)
    best = best.select(F.lit("screened").alias("part"), F.col("rank").cast("int").alias("place"), F.col("ticker").cast("string").alias("ticker"), "earnings_yield", "ev_ebit", F.col("fscore").cast("int").alias("fscore"), "mscore", "zscore")
    short = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(SHORT))
    failed = F.col("error").isNotNull()
    done = results.select(
        F.lit("analysed").alias("part"), F.col("ticker").cast("string").alias("ticker"), F.when(~failed, F.coalesce("rating", F.lit("-"))).alias("rating"),
        F.when(~failed, short("decision")).alias("decision"), F.when(failed, short("error")).alias("error"),
    )
    return best.unionByName(done, allowMissingColumns=True)


def log_states(states: DataFrame, path: str) -> None:
    """states (ticker, trade_date, state: a struct) -> a table by ticker and date, the state as JSON. Logging a day
    again replaces it. Tickers that can't stand in a path are an error: nothing is written."""
    unsafe = states.where(~safe_path_part(F.col("ticker"))).select("ticker").limit(1).collect()
    if unsafe:
        raise ValueError(f"not a ticker: {unsafe[0]['ticker']!r}")
    replace_partitions(states.select("ticker", F.col("trade_date").cast("date").alias("trade_date"), F.to_json("state").alias("state")), path, ["ticker", "trade_date"])


class StageTracker:
    """Rows and seconds of a run's stages, gathered while they run: rows are counted by an observation inside the
    job that writes a stage's result, so no result is read a second time.

        with tracker.stage("screen") as watched:
            watched(screened).write.parquet(path)
    """

    def __init__(self):
        self.stages: dict[str, dict] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A stage that is run again keeps its first figures. A stage that fails has none."""
        seen = Observation(f"{name}-{time.monotonic_ns()}")
        used: list[bool] = []

        def watched(rows: DataFrame) -> DataFrame:
            used.append(True)
            return rows.observe(seen, F.count(F.lit(1)).alias("rows"))

        began = time.monotonic()
        yield watched
        took = max(0.0, time.monotonic() - began)
        self.stages.setdefault(name, {"rows": seen.get["rows"] if used else None, "seconds": took})

    def summary(self) -> str:
        told = (f"{name} {s['seconds']:.2f}s" + ("" if s["rows"] is None else f", {s['rows']} rows") for name, s in self.stages.items())
        return "Stages: " + (" | ".join(told) if self.stages else "pending")
