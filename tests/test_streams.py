"""Streams that arrive in deliveries: late rows, evicted state, timers, and runs that go on where the last one ended."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.streaming import commands, runs, windows

SECOND = 1_000_000


def dropped(told):
    return sum(o["numRowsDroppedByWatermark"] for p in told for o in p["stateOperators"])


def held(told):
    """Rows of state after each batch."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in told]


@pytest.fixture(scope="module")
def ticks(spark):
    """Three deliveries of (k, s): seconds 0-59, 60-119 with one late and one early enough, 600-659."""
    rows = [[("a", s) for s in range(0, 60)], [("a", s) for s in range(60, 120)] + [("a", 5), ("b", 55)], [("a", s) for s in range(600, 660)] + [("b", 130)]]
    return [spark.createDataFrame(r, "k string, s long").withColumn("t", F.timestamp_seconds("s")).repartition(3) for r in rows]


def test_late_rows_go_and_state_is_evicted(ticks):
    """Windows of 20 s, 10 s late at most: second 5 comes when the watermark stands at 49, second 130 at 109."""
    result, told = runs.deliver(ticks, lambda s: windows.sliding(s, "t", "10 seconds", "20 seconds", "20 seconds", ["k"], F.count("*").alias("n")))
    got = {(r.k, r.start_us // SECOND): r.n for r in result.collect()}
    want = Counter(("a", s // 20 * 20) for s in [*range(120), *range(600, 640)])
    want["b", 40], want["b", 120] = 1, 1
    assert got == dict(want)  # the window that begins at 640 is still open
    assert dropped(told) == 1
    assert held(told)[-1] == 1 and max(held(told)) < 12


def test_sliding_windows_overlap(ticks):
    result, _ = runs.deliver(ticks[:1], lambda s: windows.sliding(s, "t", "0 seconds", "20 seconds", "10 seconds", [], F.count("*").alias("n")))
    assert sorted((r.start_us // SECOND, r.n) for r in result.collect()) == [(-10, 10), (0, 20), (10, 20), (20, 20), (30, 20)]


def test_sessions_end_a_gap_after_their_last_event(spark):
    first = spark.createDataFrame([("x", 1), ("x", 5), ("x", 30), ("y", 2)], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    second = spark.createDataFrame([("x", 36), ("x", 12), ("y", 500)], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    result, told = runs.deliver([first, second], lambda s: windows.sessions(s, "t", "5 seconds", "10 seconds", ["k"], F.count("*").alias("n")))
    assert sorted((r.k, r.start_us // SECOND, r.end_us // SECOND, r.n) for r in result.collect()) == [("x", 1, 15, 2), ("x", 30, 46, 2), ("y", 2, 12, 1)]
    assert dropped(told) == 1 and held(told)[-1] == 1  # second 12 ended at 22, before the watermark of 25


def test_starts_without_completion_are_written_when_their_time_is_over(spark):
    def rows(*own):
        return spark.createDataFrame(own, "k string, id long, s long, what string").withColumn("t", F.timestamp_seconds("s"))

    def build(s):
        a = s.filter("what = 'a'").select("k", F.col("id").alias("a_id"), F.col("t").alias("started"))
        b = s.filter("what = 'b'").select("k", F.col("id").alias("b_id"), F.col("t").alias("completed"))
        return windows.completions_of(a, b, ["k"], "10 seconds", "60 seconds").select("a_id", "b_id")

    parts = [rows(("x", 1, 100, "a"), ("x", 2, 130, "b"), ("x", 3, 140, "b"), ("y", 4, 100, "a")), rows(("y", 5, 150, "b"), ("x", 6, 161, "b"), ("z", 7, 150, "a"), ("z", 8, 50, "b")), rows(("q", 9, 900, "a"), ("q", 10, 901, "b"))]
    result, told = runs.deliver(parts, build)
    assert sorted((r.a_id, r.b_id or 0) for r in result.collect()) == [(1, 2), (1, 3), (4, 5), (7, 0), (9, 10)]
    assert held(told)[-1] == 2


def trace(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, id string, seq long, s long, phase string").withColumn("t", F.timestamp_seconds("s"))


def test_commands_time_out(spark):
    """Each delivery is a run of its own, which takes up the state of the one before."""
    parts = [
        trace(spark, ("r", "a", 1, 100, "start"), ("r", "b", 2, 110, "start"), ("r", "a", 3, 150, "complete"), (None, "n", 4, 151, "start")),
        trace(spark, ("r", "b", 5, 300, "start"), ("r", "b", 6, 310, "start"), ("r", "c", 7, 310, "complete"), (None, "n", 8, 312, "complete")),
        trace(spark, ("r", "b", 9, 330, "complete"), ("r", "d", 10, 5000, "start")),
        trace(spark, ("r", "d", 11, 5050, "complete"), ("r", "e", 12, 20, "start"), ("r", "z", 13, 7000, "start")),
        trace(spark, ("r", "z", 14, 9000, "complete"), ("r", "y", 15, 9001, "start")),
    ]
    result, told = runs.deliver(parts, lambda s: commands.paired_commands(s, "t", "100 seconds", 1000 * SECOND))
    got = sorted((r.run_id, r.id, (r.started_us or 0) // SECOND, (r.completed_us or 0) // SECOND, r.outcome) for r in result.collect())
    assert got == [
        ("", "n", 151, 312, "completed"), ("r", "a", 100, 150, "completed"), ("r", "b", 110, 0, "timed out"), ("r", "b", 300, 0, "timed out"), ("r", "b", 310, 330, "completed"),
        ("r", "c", 0, 310, "unpaired"), ("r", "d", 5000, 5050, "completed"), ("r", "z", 0, 9000, "unpaired"), ("r", "z", 7000, 0, "timed out"),
    ]
    assert dropped(told) == 1  # the start at 20
    assert sum(p["numInputRows"] > 0 for p in told) == len(parts)


def test_a_run_without_news_changes_nothing(spark, ticks):
    inbox, state, out = (runs.scratch(spark) for _ in range(3))
    ticks[0].write.parquet(inbox)

    def again():
        return runs.catch_up(windows.sliding(spark.readStream.schema(ticks[0].schema).parquet(inbox), "t", "0 seconds", "20 seconds", "20 seconds", [], F.count("*").alias("n")), out, state)

    again()
    first = sorted(spark.read.parquet(out).collect())
    again()
    assert sorted(spark.read.parquet(out).collect()) == first and len(first) == 2


def test_a_row_meets_only_the_span_of_its_key(spark):
    """Keys of spans of time are in the join: a key's rows of other days are not looked through. A start at a span's end finds what follows it."""
    rows = [("x", i, s, "a") for i, s in enumerate((0, 59, 60, 119, 120, 239, 100_000))] + [("x", 10 + i, s, "b") for i, s in enumerate((0, 60, 119, 120, 180, 299, 300, 100_060))]
    events = spark.createDataFrame(rows, "k string, id long, s long, what string").withColumn("t", F.timestamp_seconds("s"))
    a = events.filter("what = 'a'").select("k", F.col("id").alias("a_id"), F.col("t").alias("started"))
    b = events.filter("what = 'b'").select("k", F.col("id").alias("b_id"), F.col("t").alias("completed"))
    joined = windows.completions_of(a, b, ["k"], "10 seconds", "60 seconds")
    assert "__span" in joined._jdf.queryExecution().optimizedPlan().toString() and joined.columns == ["k", "a_id", "started", "b_id", "completed"]
    want = sorted((i, j) for _, i, s, p in rows if p == "a" for _, j, e, q in rows if q == "b" and s <= e <= s + 60)
    assert sorted((r.a_id, r.b_id or 0) for r in joined.collect()) == want


def test_a_key_costs_one_read_of_its_open_start():
    """Rows, not frames, of a key: a pair in one batch reads the open start once and touches no other state."""
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    class Handle(State):
        def getValueState(self, *a):  # noqa: N802
            return State()

        getListState = getValueState  # noqa: N815

    worker = commands.Commands(1000)
    worker.init(Handle())
    rows = [Row(time_us=20, seq=2, phase="complete"), Row(time_us=10, seq=1, phase="start")]
    assert [tuple(r) for r in worker.handleInputRows(("r", "x"), iter(rows), None)] == [("r", "x", 10, 20, "completed")]
    assert calls == ["get"]
