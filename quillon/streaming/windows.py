"""Event time: sliding and session windows, and starts joined with completions, under a watermark.

A row is late once the watermark, the greatest event time of earlier batches less `delay`, has
passed the end of what it belongs to; late rows are dropped. State goes as the watermark passes it,
so it is as large as what is open, and results are written once, when they can change no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(ts: str) -> Column:
    """The time of a column with or without a zone, as if written in UTC, whatever the session's zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))"))


def _ends(df: DataFrame, window: str) -> DataFrame:
    rest = [c for c in df.columns if c != window]
    return df.select(F.unix_micros(F.col(window)["start"]).alias("start_us"), F.unix_micros(F.col(window)["end"]).alias("end_us"), *rest)


def sliding(events: DataFrame, time: str, delay: str, size: str, slide: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """(start_us, end_us, keys, aggregates) of windows of a size, one of which begins every `slide`."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, size, slide), *keys)
    return _ends(grouped.agg(*aggregates), "window")


def sessions(events: DataFrame, time: str, delay: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """(start_us, end_us, keys, aggregates) of runs of events of which no two neighbours are `gap` apart; a session ends a gap after its last event."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys)
    return _ends(grouped.agg(*aggregates), "session_window")


def completions_of(starts: DataFrame, completions: DataFrame, keys: list[str], delay: str, within: str) -> DataFrame:
    """Every start (keys, started) with each completion (keys, completed) that follows within a time, or null.

    Both sides are streams. The range of times in the condition lets Spark drop starts that nothing
    can complete any more, which is when their null row is written. A row meets only held rows of
    its key, so keys are cut into spans of time twice as long as `within`, a fixed length: a start lies
    in one, a completion in its own and in that of the first start it may complete, if that is another.
    """
    span = lambda t: F.expr(f"cast(floor(unix_micros({t}) / (2 * unix_micros(timestamp_micros(0) + interval {within}))) as bigint)")
    a = starts.withWatermark("started", delay).withColumn("__span", span("started")).alias("a")
    b = completions.withWatermark("completed", delay).withColumn("__span", F.explode(F.sequence(span(f"completed - interval {within}"), span("completed")))).alias("b")
    on = F.expr(f"a.__span = b.__span and b.completed >= a.started and b.completed <= a.started + interval {within}")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    b_rest = [F.col(f"b.{c}") for c in completions.columns if c not in keys]
    return a.join(b, on, "left_outer").select(*(F.col(f"a.{c}") for c in starts.columns), *b_rest)
