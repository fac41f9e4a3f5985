"""Calendars of vendors that answer for a few days at a time, as a data source with a task for each request."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Days that one request covers, and texts that stand for an actual that is not out yet.
DAYS = 7
NOT_YET = ("N/A", "NA", "", "NONE")
RAW = "security string, date string, estimate double, actual string"


@dataclass
class Chunk(InputPartition):
    """A request: begin to end, both included."""

    begin: date
    end: date

    def __post_init__(self):
        super().__init__((self.begin, self.end))


def chunks(start: date, end: date, days: int = DAYS) -> list[Chunk]:
    """The days from start to end in requests of at most `days`, each day in one."""
    begins = range(0, (end - start).days + 1, days)
    return [Chunk(start + timedelta(b), min(start + timedelta(b + days - 1), end)) for b in begins]


def calendar_source(name: str, fetch: Callable[[date, date], Iterable[tuple]], schema: str = RAW) -> type[DataSource]:
    """A data source whose rows are what `fetch(begin, end)` gives; options start and end (yyyy-mm-dd), days.

    fetch runs in the tasks, once for each chunk: it brings its own client. An empty answer is no rows; an error
    fails its task, which Spark tries again.
    """

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.first, self.last = (date.fromisoformat(options[k]) for k in ("start", "end"))
            self.days = int(options.get("days", DAYS))

        def partitions(self) -> list[InputPartition]:
            return chunks(self.first, self.last, self.days)

        def read(self, partition: Chunk | None) -> Iterator[tuple]:
            if partition is not None:  # else a window without days
                yield from fetch(partition.begin, partition.end)

    class Calendar(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Calendar


def read_calendar(spark: SparkSession, name: str, start: str, end: str, days: int = DAYS) -> DataFrame:
    return spark.read.format(name).options(start=start, end=end, days=str(days)).load()


def actual(c: Column) -> Column:
    """The actual figure, null while it is not out."""
    return F.when(~F.upper(F.trim(c)).isin(*NOT_YET), c).try_cast("double")


def canonical(rows: DataFrame, security: str | None = None) -> DataFrame:
    """security, date, eps_estimate, eps_actual of calendar rows; of one security if it is given."""
    out = rows.select(F.coalesce("security", F.lit("")).alias("security"), F.trim("date").try_cast("date").alias("date"), F.col("estimate").alias("eps_estimate"), actual(F.col("actual")).alias("eps_actual"))
    return out if security is None else out.where(F.col("security") == security)
