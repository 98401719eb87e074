"""Start and completion pairing over a stream of trace events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "run_id string, id string, started_at double, completed_at double, paired boolean"
STATE = "open boolean, started double"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    rows = pd.concat(batches).sort_values("seq")
    is_open, started = state.get if state.exists else (False, 0.0)
    out = []
    for time, phase in zip(rows["time"].tolist(), rows["phase"].tolist()):
        if phase == "start":
            is_open, started = True, time
        elif phase == "complete":
            out.append((*key, started if is_open else time, time, bool(is_open)))
            is_open = False
    if is_open:
        state.update((True, float(started)))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["run_id", "id", "started_at", "completed_at", "paired"])


def paired_stream(events: DataFrame) -> DataFrame:
    """Completions of a stream of events (run_id, id, seq, time, phase) with the start that they end.

    The state of a key is one open start, and goes when that has ended, so state is as large as
    what runs at the moment. Rows of a micro-batch go by seq; batches must arrive in order, as files
    of one trace do.
    """
    keyed = events.select(F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce("id", F.lit("")).alias("id"), "seq", F.col("time").cast("double").alias("time"), "phase")
    return keyed.groupBy("run_id", "id").applyInPandasWithState(_pair, OUTPUT, STATE, "append", "NoTimeout")


def trace_stream(spark, path: str, schema) -> DataFrame:  # noqa: ANN001
    """JSON trace events that arrive as files in a folder."""
    return spark.readStream.schema(schema).json(path)
