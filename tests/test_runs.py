"""Calendars by chunks, tables of runs, and trackers of stages."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.sources import calendars, runs


def test_every_day_is_in_one_chunk():
    for n in range(1, 30):
        got = calendars.chunks(date(2024, 2, 20), date(2024, 2, 20) + timedelta(n - 1))
        days = [c.begin + timedelta(i) for c in got for i in range((c.end - c.begin).days + 1)]
        assert days == [date(2024, 2, 20) + timedelta(i) for i in range(n)] and all((c.end - c.begin).days < 7 for c in got)
    assert calendars.chunks(date(2024, 1, 2), date(2024, 1, 1)) == []


def test_a_task_for_each_chunk(spark):
    def fetch(begin, end):
        day = begin
        while day <= end:
            yield "A", f" {day} ", 1.0, "n/a" if day.day % 2 else "2.5"
            day += timedelta(1)

    spark.dataSource.register(calendars.calendar_source("odd_days", fetch))
    rows = calendars.read_calendar(spark, "odd_days", "2024-01-01", "2024-01-17")
    assert rows.rdd.getNumPartitions() == 3
    got = calendars.canonical(rows, "A").orderBy("date").collect()
    assert [(r.date.day, r.eps_actual) for r in got] == [(d, None if d % 2 else 2.5) for d in range(1, 18)]
    assert calendars.canonical(rows, "B").count() == 0
    assert calendars.read_calendar(spark, "odd_days", "2024-01-02", "2024-01-01").count() == 0


def test_a_rerun_replaces_its_run_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda run, n: spark.range(n).select("id", F.lit(run).alias("run"))
    for run, n in ((1, 3), (2, 4), (1, 2), (3, 0)):
        runs.replace_partitions(rows(run, n), path, ["run"])
    assert {(r["run"], r["count"]) for r in spark.read.parquet(path).groupBy("run").count().collect()} == {(1, 2), (2, 4)}


def test_states_are_logged_by_ticker_and_day(spark, tmp_path):
    path = str(tmp_path / "states")
    state = lambda t, d, x: spark.createDataFrame([(t, d, (x, None))], "ticker string, trade_date string, state struct<report: string, debate: struct<bull: string>>")
    for t, d, x in (("A", "2024-01-02", "old"), ("B", "2024-01-02", "b"), ("A", "2024-01-02", "new"), ("A", "2024-01-03", "next")):
        runs.log_states(state(t, d, x), path)
    got = {(r["ticker"], str(r["trade_date"]), r["state"]) for r in spark.read.parquet(path).collect()}
    assert got == {("A", "2024-01-02", '{"report":"new"}'), ("A", "2024-01-03", '{"report":"next"}'), ("B", "2024-01-02", '{"report":"b"}')}
    with pytest.raises(ValueError, match="not a ticker"):
        runs.log_states(state("../x", "2024-01-02", "x"), path)


def test_stages_are_counted_while_they_run(spark, tmp_path):
    tracker = runs.StageTracker()
    assert tracker.summary() == "Stages: pending"
    with tracker.stage("screen") as watched:
        watched(spark.range(7)).write.parquet(str(tmp_path / "a"))
    with tracker.stage("wait"):
        pass
    with pytest.raises(RuntimeError), tracker.stage("fails"):
        raise RuntimeError
    with tracker.stage("screen") as watched:
        watched(spark.range(9)).write.parquet(str(tmp_path / "b"))
    assert {k: s["rows"] for k, s in tracker.stages.items()} == {"screen": 7, "wait": None}
    assert "screen" in tracker.summary() and "7 rows" in tracker.summary()
