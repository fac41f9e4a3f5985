"""The frame log, the monitor and the ledgers: restarts, replays, limits."""

import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.sources import sinks
from quantloom.streaming import frame_log, noi

NOW = {"availableNow": True}


def frame(i, ticker="A"):
    return json.dumps({"ev": "NOI", "T": ticker, "t": 1_700_000_000_000_000_000 + i * 1_000_000_000, "a": "O", "o": float(i)})


def append(spark, path, frames, **options):
    rows = spark.createDataFrame([(f,) for f in frames], "value string").coalesce(2)
    rows.write.format("frame_log").options(**options).mode("append").save(path)


@pytest.fixture
def log(spark, tmp_path):
    frame_log.register(spark)
    return str(tmp_path / "log")


def events(spark, log):
    return noi.parse_frames(spark.readStream.format("frame_log").load(log))


def deliver(stream, ledger, state):
    query = stream.writeStream.foreachBatch(sinks.batch_ledger(ledger, "s")).option("checkpointLocation", state).trigger(**NOW).start()
    query.awaitTermination()


def test_log_numbers_frames_without_gaps(spark, log):
    append(spark, log, [f"x{i}" for i in range(7)], segment=2)
    append(spark, log, ["with\na line end", None])
    rows = spark.read.format("frame_log").load(log).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(9))
    assert {r.value for r in rows} == {f"x{i}" for i in range(7)} | {"with a line end", ""}
    assert all(count <= 2 for first, count, _ in frame_log.segments(log) if first < 7)


def test_empty_log_has_no_rows(spark, log):
    assert spark.read.format("frame_log").load(log).count() == 0


def test_lost_segments_are_an_error(spark, log):
    reader = frame_log._StreamReader(log)
    with pytest.raises(ValueError, match="no longer"):
        reader.partitions({"next": 0}, {"next": 3})


def test_recorder_stops_at_a_limit_and_at_the_end(spark, log):
    left = [frame(i) for i in range(5)] + [None]
    assert frame_log.record(lambda: left.pop(0), log, stop_after=2, segment=1) == 2
    assert frame_log.record(lambda: left.pop(0), log) == 3
    assert [first for first, _, _ in frame_log.segments(log)] == [0, 1, 2]
    got = noi.parse_frames(spark.read.format("frame_log").load(log)).orderBy("ts").collect()
    assert [r.imbalance for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_restart_loses_and_doubles_nothing(spark, log, tmp_path):
    ledger, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for part in range(3):
        append(spark, log, [frame(i) for i in range(10 * part, 10 * part + 10)], segment=3)
        deliver(events(spark, log), ledger, state)
    got = sinks.read_ledger(spark, ledger, noi.EVENT)
    assert sorted(r.imbalance for r in got.collect()) == [float(i) for i in range(30)]


def test_batch_without_commit_is_delivered_again_and_counts_once(spark, log, tmp_path):
    ledger, state = str(tmp_path / "ledger"), tmp_path / "state"
    append(spark, log, [frame(i) for i in range(10)])
    deliver(events(spark, log), ledger, str(state))
    (state / "commits" / "0").unlink()  # as if the driver was lost between the sink and the commit
    (state / "commits" / ".0.crc").unlink(missing_ok=True)
    append(spark, log, [frame(i) for i in range(10, 15)])
    deliver(events(spark, log), ledger, str(state))  # the batch that was lost
    deliver(events(spark, log), ledger, str(state))  # what came after it
    assert sorted(r.imbalance for r in sinks.read_ledger(spark, ledger, noi.EVENT).collect()) == [float(i) for i in range(15)]


def test_cap_is_exact_over_batches_and_restarts(spark, log, tmp_path):
    ledger, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for part in range(3):
        append(spark, log, [frame(100 * part + i, t) for i in range(4) for t in ("A", "B")] + [frame(part, "C")])
        deliver(noi.capped(events(spark, log), 6), ledger, state)
    got = sinks.read_ledger(spark, ledger, noi.EVENT).groupBy("ticker").count().collect()
    assert {r["ticker"]: r["count"] for r in got} == {"A": 6, "B": 6, "C": 3}


def test_idle_tickers_leave_no_state(spark, log, tmp_path):
    ledger, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    append(spark, log, [frame(i, f"T{i}") for i in range(20)])
    stream = lambda: noi.capped(events(spark, log), 1, idle=timedelta(seconds=2))
    deliver(stream(), ledger, state)
    held = lambda: {r["key"]["ticker"] for r in spark.read.format("statestore").option("stateVarName", "seen").load(state).collect()}
    assert held() == {f"T{i}" for i in range(20)}
    time.sleep(2.5)
    append(spark, log, [frame(99, "T99")])
    deliver(stream(), ledger, state)
    assert held() == {"T99"}
    append(spark, log, [frame(100, "T1"), frame(101, "T99")])
    deliver(stream(), ledger, state)
    got = sinks.read_ledger(spark, ledger, noi.EVENT).groupBy("ticker").count().collect()
    assert {r["ticker"]: r["count"] for r in got}["T1"] == 2  # counted anew after its idle time


def test_monitor_stops_itself_at_a_total(spark, log, tmp_path):
    monitor = noi.Monitor(str(tmp_path / "ledger"), stop_after=12)
    append(spark, log, [frame(i) for i in range(7)])
    assert monitor.run(events(spark, log), str(tmp_path / "state"), NOW) == 7
    append(spark, log, [frame(i) for i in range(7, 20)])
    assert monitor.run(events(spark, log), str(tmp_path / "state"), {"processingTime": "100 milliseconds"}) == 12
    assert monitor.full(spark)


def test_monitor_stops_itself_when_a_ticker_is_full(spark, log, tmp_path):
    monitor = noi.Monitor(str(tmp_path / "ledger"), most=3)
    append(spark, log, [frame(i, "A" if i % 2 else "B") for i in range(8)] + [frame(9, "C")])
    rows = noi.of_tickers(events(spark, log), ["a", "C"])
    assert monitor.run(noi.capped(rows, 3), str(tmp_path / "state"), {"processingTime": "100 milliseconds"}) == 4


def test_entries_of_ledgers(spark):
    rows = spark.createDataFrame([("x", "t", "2024-01-02", 0.12345678, None), ("x", "t", "2024-01-03", None, True)], "analyst string, ticker string, trade_date string, alpha double, won boolean")
    got = sinks.reflection_entries(rows, F.lit(1.0)).collect()
    assert [(r.delta_r, str(r.trade_date), r.ts) for r in got] == [(0.123457, "2024-01-02", 1.0)]
    assert sinks.reflection_entries(rows, enabled=False).count() == 0
    got = sinks.calibration_entries(rows.withColumn("confidence", F.lit(1)), F.lit(1.0)).collect()
    assert [r.won for r in got] == [False, True]
    trade = spark.createDataFrame([("nvda", None, 1.0, {"gap": True, "rvol": None}, None, None, None, None, None)], "ticker string, date date, price double, pillars map<string, boolean>, pullback struct<candidate: boolean, rr: double, stop: double>, session map<string, boolean>, exit_class string, fomo boolean, note string")
    entry = sinks.journal_entries(trade)
    assert entry.schema.simpleString() == spark.createDataFrame([], schemas.TRADE_JOURNAL).schema.simpleString()
    one = entry.first()
    assert (one.ticker, one.pillars, one.pullback.candidate, one.session, one.fomo) == ("NVDA", {"gap": True}, False, {}, False) and one.date is not None and one.ts > 1e9
