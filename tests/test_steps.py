"""The step driver: what runs, what is skipped and why, and what is left behind."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.plans.steps import Step, run_steps


@pytest.fixture()
def numbers(spark):
    return {"numbers": spark.range(10)}


def told(log):
    return [(r.name, r.status, r["rows"], r["mode"], r.reason) for r in log.collect()]


def test_a_failure_skips_what_follows(spark, numbers, tmp_path):
    bad = Step("bad", lambda t: t["even"].select(F.raise_error(F.lit("no")).cast("long").alias("x")), ("even",))
    plan = [Step("even", lambda t: t["numbers"].filter("id % 2 = 0"), ("numbers",)), bad, Step("after", lambda t: t["even"], ("even",))]
    log, tables = run_steps(spark, plan, numbers, str(tmp_path))
    rows = told(log)
    assert [r[:4] for r in rows] == [("even", "ok", 5, "run"), ("bad", "failed", None, "run"), ("after", "skipped", None, "skipped")]
    assert rows[1][4] and rows[2][4] == "an earlier step failed" and set(tables) == {"even"}
    log, tables = run_steps(spark, plan, numbers, str(tmp_path), continue_on_error=True)
    assert [r[1] for r in told(log)] == ["ok", "failed", "ok"] and tables["after"].count() == 5


def test_a_failed_step_keeps_the_table_of_an_earlier_run(spark, numbers, tmp_path):
    run_steps(spark, [Step("t", lambda t: t["numbers"])], numbers, str(tmp_path))
    log, _ = run_steps(spark, [Step("t", lambda t: t["numbers"].select("missing"))], numbers, str(tmp_path))
    assert told(log)[0][1] == "failed" and spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_rehearsals_and_what_is_not_asked_for(spark, numbers, tmp_path):
    ask = {"build": lambda t: t["numbers"], "rehearse": lambda t: t["numbers"].limit(0)}
    plan = [Step("dry", mode="auto", ready=False, **ask), Step("live", mode="auto", **ask), Step("off", mode="skip", **ask), Step("lost", lambda t: t["gone"], ("gone", "numbers"))]
    log, tables = run_steps(spark, plan, numbers, str(tmp_path))
    assert told(log) == [("dry", "ok", 0, "rehearsed", ""), ("live", "ok", 10, "run", ""), ("off", "skipped", None, "skipped", "not asked for"), ("lost", "skipped", None, "skipped", "missing input: gone")]
    assert tables["dry"].columns == ["id"]
