"""Sink variables: events are dealt out once."""

from __future__ import annotations

from quillon.operators import dataflow


def test_sinks_deal_events_out_once(spark, tmp_path):
    spark.createDataFrame([("a", "x", 1, "s1"), ("a", "y", 2, "s2"), ("b", "x", 1, "s1"), ("b", "z", 2, "s2"), ("c", "z", 5, "s2"), ("d", "q", 1, "")], "fn string, var string, line int, stmt_code string").write.parquet(f"{tmp_path}/e")
    names = spark.createDataFrame([("a", "y"), ("b", "gone")], "fn string, name string")
    old = spark.createDataFrame([("a", 1, "s1"), ("b", 1, "other"), ("c", 9, "an  s2 ;"), ("d", 7, "")], "fn string, ln int, content string")
    got = dataflow.sinks(names, old, spark.read.parquet(f"{tmp_path}/e"))
    assert sorted(map(tuple, got.collect())) == [("a", "y"), ("b", "x"), ("c", "z")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan and "Broadcast" not in plan
