"""Timings from trace events: start and completion pairs, durations, token use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import escape_cell


def paired(events: DataFrame, keys: list[str], seq: str, time: str, phase: str) -> DataFrame:
    """Completions with `started_at`, the time of the start that they end.

    A later start replaces an earlier one, a completion uses its start up, and a completion without
    a start begins at its own time. `phase` is 'start' or 'complete'; other rows do not count. Each
    key's events are one window: keep runs or ids in the keys, so that none grows with the input.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = events.filter(F.col(phase).isin("start", "complete"))
    rows = rows.withColumn("__p", F.lag(phase).over(w)).withColumn("__t", F.lag(time).over(w))
    done = rows.filter(F.col(phase) == "complete")
    started = F.when(F.col("__p") == "start", F.col("__t")).otherwise(F.col(time))
    return done.withColumn("started_at", started).withColumn("completed_at", F.col(time)).withColumn("paired", F.coalesce(F.col("__p") == "start", F.lit(False))).drop("__p", "__t")


def parsed(trace: DataFrame) -> DataFrame:
    """Trace lines (run_id, seq, stream, time, line) as events; lines that hold no JSON object go.

    Gives kind ('command', 'turn'), phase, id, command, exit_code, output_bytes and usage.
    """
    v = F.try_parse_json("line")
    get = lambda path, kind="string": F.try_variant_get("__v", path, kind)
    rows = trace.filter("stream = 'stdout'").withColumn("__v", v).filter(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")))
    what = get("$.type")
    command = get("$.item.type") == "command_execution"
    kind = F.when(command & what.isin("item.started", "item.completed"), "command").when(what.isin("turn.started", "turn.completed"), "turn")
    phase = F.when(F.endswith(what, F.lit(".started")), "start").otherwise("complete")
    usage = F.struct(*(get(f"$.usage.{k}", "bigint").alias(k) for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")))
    said = F.coalesce(F.to_json(get("$.usage", "variant")), F.lit("{}"))
    return rows.withColumn("kind", kind).filter("kind is not null").select(
        "run_id", "seq", "time", "kind", phase.alias("phase"), get("$.item.id").alias("id"), get("$.item.command").alias("command"), get("$.item.exit_code", "int").alias("exit_code"),
        F.octet_length(F.coalesce(get("$.item.aggregated_output"), F.lit(""))).cast("long").alias("output_bytes"), usage.alias("usage"), said.alias("usage_json"),
    )


def commands(events: DataFrame) -> DataFrame:
    """Executions of parsed() events, longest first within a run."""
    rows = paired(events.filter("kind = 'command'"), ["run_id", "id"], "seq", "time", "phase")
    rows = rows.withColumn("elapsed", F.col("completed_at") - F.col("started_at"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("elapsed"), "seq"))
    return rows.select("run_id", "id", "command", "started_at", "completed_at", "elapsed", "exit_code", "output_bytes", rank.alias("rank"))


def turns(events: DataFrame) -> DataFrame:
    """Turns of parsed() events with their token use; a run has one turn at a time."""
    rows = paired(events.filter("kind = 'turn'"), ["run_id"], "seq", "time", "phase")
    return rows.select("run_id", "seq", "started_at", "completed_at", (F.col("completed_at") - F.col("started_at")).alias("elapsed"), "usage", "usage_json")


def comparable_tokens(runs: DataFrame, baseline: str | DataFrame, key: str = "config") -> DataFrame:
    """input - cached + output + reasoning of every run, and its change in percent against a baseline run, named or given as a row with its key."""
    total = runs.withColumn("comparable", F.expr("input_tokens - cached_tokens + output_tokens + reasoning_tokens"))
    own = total.filter(F.col(key) == baseline) if isinstance(baseline, str) else total.join(baseline.select(key), key, "left_semi")
    base = own.agg(F.max("comparable").alias("__b"))
    change = F.expr("try_divide(cast(comparable - __b as double) * 100, __b)")
    return total.crossJoin(F.broadcast(base)).withColumn("change_percent", change).drop("__b")


#: Headings of the timing report.
TURNS_HEAD = "| Turn | Duration (s) | Input Tokens | Cached Input | Output Tokens | Reasoning Tokens |\n|---:|---:|---:|---:|---:|---:|"
COMMANDS_HEAD = "| Rank | Duration (s) | Exit | Output Bytes | Command |\n|---:|---:|---:|---:|---|"
NO_TURNS = "|  |  |  |  |  |  |"


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))


def timing_markdown(runs: DataFrame, executions: DataFrame, run_turns: DataFrame) -> DataFrame:
    """(run_id, markdown) of runs (run_id, cve, elapsed, returncode): their turns and commands as tables.

    Durations have three decimals, pipes in commands are escaped, and a run without turns has a
    blank row.
    """
    seconds = lambda c: F.format_string("%.3f", F.coalesce(F.col(c), F.lit(0.0)))
    turn_no = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    numbered = run_turns.withColumn("n", turn_no)
    turn = _cells(F.col("n"), seconds("elapsed"), *(F.col(f"usage.{k}") for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")))
    command = F.concat(F.lit("`"), escape_cell(F.coalesce("command", F.lit(""))), F.lit("`"))
    row = _cells(F.col("rank"), seconds("elapsed"), F.col("exit_code"), F.coalesce("output_bytes", F.lit(0)), command)

    def lines(df: DataFrame, order: str, line: Column, name: str) -> DataFrame:
        rows = df.select("run_id", F.struct(F.col(order).alias("o"), line.alias("l")).alias("x"))
        return rows.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n").alias(name))

    both = runs.join(lines(numbered, "n", turn, "__t"), "run_id", "left").join(lines(executions, "rank", row, "__c"), "run_id", "left")
    top = F.format_string("# Codex Exec Timing: %s\n\nTotal wall time: %.3fs\nReturn code: %s\n", F.col("cve"), F.col("elapsed"), F.coalesce(F.col("returncode").cast("string"), F.lit("None")))
    parts = F.concat_ws("\n", top, F.lit("## Turns\n"), F.lit(TURNS_HEAD), F.coalesce("__t", F.lit(NO_TURNS)), F.lit("\n## Command Executions\n"), F.lit(COMMANDS_HEAD), F.col("__c"), F.lit(""))
    return both.select("run_id", parts.alias("markdown"))


def timing_document(runs: DataFrame, executions: DataFrame, run_turns: DataFrame) -> DataFrame:
    """(run_id, json) of runs (run_id, cve, started_at, elapsed, returncode, command): one document for
    each, with its turns in order and its commands, longest first. Missing values are null."""

    def listed(df: DataFrame, order: str, name: str, **fields: str) -> DataFrame:
        item = F.struct(F.col(order).alias("__o"), *sorted({c for c in fields.values()}))
        said = lambda x: F.struct(*(F.parse_json(x[c]).alias(k) if c == "usage_json" else x[c].alias(k) for k, c in fields.items()))
        return df.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(item)), said).alias(name))

    times = {"started_at_epoch": "started_at", "completed_at_epoch": "completed_at", "elapsed_seconds": "elapsed"}
    own_turns = listed(run_turns, "seq", "turns", **times, usage="usage_json")
    own_commands = listed(executions, "rank", "command_executions", id="id", command="command", **times, exit_code="exit_code", output_bytes="output_bytes")
    both = runs.join(own_turns, "run_id", "left").join(own_commands, "run_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    payload = F.struct("cve", F.col("started_at").alias("started_at_epoch"), F.col("elapsed").alias("elapsed_seconds"), "returncode", "command", none("turns"), none("command_executions"))
    return both.select("run_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("json"))
