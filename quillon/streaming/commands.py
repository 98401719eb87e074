"""Commands of a trace as they run: typed state for open starts, and timers for those that never complete."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_id string, id string, started_us long, completed_us long, outcome string"
_Out = Row("run_id", "id", "started_us", "completed_us", "outcome")


class Commands(StatefulProcessor):
    """State of a (run_id, id): the open start as a value, starts that another one replaced as a list.

    A completion ends the open start unless that is older than the timeout. Each start that nothing
    has ended sets a timer; when the watermark passes it, the start is reported and forgotten. So
    state is what runs and has not timed out, and a key whose last start has ended holds nothing.
    """

    def __init__(self, timeout_us: int) -> None:
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long")
        self.replaced = handle.getListState("replaced", "started long")

    def _due(self, started: int) -> int:
        return -(-(started + self.timeout) // 1000)  # timers count milliseconds

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        batch = sorted((r["time_us"], r["seq"] is None, r["seq"], r["phase"]) for r in rows)
        held = self.open.get()
        before = started = held[0] if held else None
        out = []
        for time, _, _, phase in batch:
            if phase == "start":
                if started is not None:
                    self._replace(started, before)
                started = time
            elif phase == "complete":
                if started is not None and time - started > self.timeout:
                    self._replace(started, before)
                    started = None
                out.append(_Out(*key, started, time, "unpaired" if started is None else "completed"))
                if started is not None and started == before:
                    self.handle.deleteTimer(self._due(started))
                started = None
        if started is None:
            if before is not None:
                self.open.clear()
        elif started != before:
            self.open.update((started,))
            self.handle.registerTimer(self._due(started))
        yield from out

    def _replace(self, started: int, before: int | None) -> None:
        """A start that can no longer be completed waits for its timer."""
        self.replaced.appendValue((started,))
        if started != before:
            self.handle.registerTimer(self._due(started))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        starts = [r[0] for r in self.replaced.get()] if self.replaced.exists() else []
        gone, left = [s for s in starts if self._due(s) <= now], [(s,) for s in starts if self._due(s) > now]
        if gone:
            if left:
                self.replaced.put(left)
            else:
                self.replaced.clear()
        held = self.open.get()
        if held and self._due(held[0]) <= now:
            gone.append(held[0])
            self.open.clear()
        for s in sorted(gone):
            yield _Out(*key, s, None, "timed out")

    def close(self) -> None:
        pass


def paired_commands(events: DataFrame, time: str, delay: str, timeout_us: int) -> DataFrame:
    """(run_id, id, started_us, completed_us, outcome) of a stream of (run_id, id, seq, phase) and a time.

    `outcome` is `completed`, `unpaired` for completions without a start that is open and young
    enough, or `timed out`. Rows of a key go by time and seq within a batch; rows later than the
    watermark are dropped. Null keys are empty ones. State needs runs.on_disk().
    """
    rows = events.withWatermark(time, delay)
    rows = rows.select(F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce("id", F.lit("")).alias("id"), "seq", "phase", time, F.unix_micros(time).alias("time_us"))
    return rows.groupBy("run_id", "id").transformWithState(statefulProcessor=Commands(timeout_us), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
