"""Steps that build on one another's tables: each is run, skipped or rehearsed, and the log says which and why."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quillon.sources import sinks

Tables = Mapping[str, DataFrame]
#: Why a step is skipped.
AFTER_FAILURE, NOT_WANTED, NO_INPUT = "an earlier step failed", "not asked for", "missing input: "
LOG = "name string, returncode int, seconds double, rows long, mode string, reason string"


@dataclass(frozen=True)
class Step:
    """A table made from earlier ones. `needs` are the tables it reads; `mode` is `run`, `skip`, or
    `auto`, which runs `rehearse` in place of `build` unless `ready` (a key, a model) holds."""

    name: str
    build: Callable[[Tables], DataFrame]
    needs: tuple[str, ...] = ()
    mode: str = "run"
    ready: bool = True
    rehearse: Callable[[Tables], DataFrame] | None = None


def _first_line(e: Exception) -> str:
    """What an error says first; a failed job names its cause."""
    told = str(e)
    if isinstance(e, Py4JJavaError):
        cause = e.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        told = cause.getMessage() or cause.toString()
    return told.strip().splitlines()[0] if told.strip() else type(e).__name__


def run_steps(spark: SparkSession, steps: Sequence[Step], inputs: Tables, out: str, continue_on_error: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(log, tables): every step in order, its table written to `out`/name before the next one reads it.

    A step that raises is `failed` with the error's first line and leaves no table; the steps behind
    it are skipped unless `continue_on_error`, which lets those go on whose inputs there are. A
    table of an earlier run at the same place is replaced only by a step that succeeds.
    """
    tables, log, stopped = dict(inputs), [], False
    for s in steps:
        missing = [n for n in s.needs if n not in tables]
        rehearsed = s.mode == "auto" and not s.ready
        mode = "rehearsed" if rehearsed else "run"
        reason = AFTER_FAILURE if stopped else NOT_WANTED if s.mode == "skip" else NO_INPUT + ", ".join(missing) if missing else None
        if reason:
            log.append((s.name, None, 0.0, None, "skipped", reason))
            continue
        began = time.monotonic()
        try:
            made = (s.rehearse if rehearsed and s.rehearse else s.build)(tables)
            made.write.mode("overwrite").parquet(f"{out}/{s.name}")
            tables[s.name] = spark.read.schema(made.schema).parquet(f"{out}/{s.name}")
            log.append((s.name, 0, time.monotonic() - began, tables[s.name].count(), mode, ""))
        except (PySparkException, Py4JJavaError) as e:
            stopped = not continue_on_error
            log.append((s.name, 1, time.monotonic() - began, None, mode, _first_line(e)))
    return sinks.step_log(spark.createDataFrame(log, LOG)), {s.name: tables[s.name] for s in steps if s.name in tables}
