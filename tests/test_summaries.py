"""Mergeable summaries against exact counts, frames against plain loops, and a table that is written in parts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import frames, sketches
from quillon.sources import store


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), d, f"i{int(rng.paretovariate(0.6)) % 5000}", rng.gauss(d, 3)) for d in range(6) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "run string, day int, item string, v double").repartition(4)


def test_merged_summaries_are_near(numbers):
    rows, df = numbers
    stored = sketches.summaries(df, ["run", "day"], "item", "v")
    for r in sketches.merged(stored, [["run", "day"], ["run"], ["day"], []], (0.1, 0.5, 0.99)).collect():
        own = [x for x in rows if r.run in (None, x[0]) and r.day in (None, x[1])]
        items, values = len({x[2] for x in own}), sorted(x[3] for x in own)
        assert r.n == len(own) and abs(r.distinct_items - items) <= 0.08 * items
        for q, got in zip((0.1, 0.5, 0.99), r.quantiles):
            assert abs(sum(v <= got for v in values) / len(values) - q) < 0.03


def test_merging_days_is_as_near_as_one_summary(numbers):
    rows, df = numbers
    by_day = {r.run: r for r in sketches.merged(sketches.summaries(df, ["run", "day"], "item", "v"), [["run"]]).collect()}
    at_once = {r.run: r for r in sketches.merged(sketches.summaries(df, ["run"], "item", "v"), [["run"]]).collect()}
    for k in "abc":
        items = len({x[2] for x in rows if x[0] == k})
        assert by_day[k].n == at_once[k].n and all(abs(s[k].distinct_items - items) <= 0.08 * items for s in (by_day, at_once))


def test_frequencies_are_never_too_low(spark, numbers):
    rows, df = numbers
    tables = sketches.frequencies(df, ["run", "day"], "item")
    assert tables.groupBy("run", "day").count().agg(F.max("count")).first()[0] <= sketches.DEPTH * sketches.WIDTH
    exact = Counter((r[0], r[2]) for r in rows)
    asked = spark.createDataFrame([*exact, ("a", "never seen")], "run string, item string")
    got = {(r.run, r["item"]): r.estimate for r in sketches.estimated(asked, "item", tables, ["run"]).collect()}
    total = Counter(r[0] for r in rows)
    assert len(got) == len(exact) + 1 and all(exact[k] <= n <= exact[k] + 2.72 * total[k[0]] / sketches.WIDTH + 1 for k, n in got.items())


def test_frames(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(60), rng.choice([None, *range(6)]), i) for i, k in enumerate(rng.choice("ab") for _ in range(120))]
    df = spark.createDataFrame(rows, "k string, t int, v int, i int")
    got = {r.i: (r.recent, r.recent_rows) for r in frames.within(df, ["k"], "t", "v", 5).collect()}
    for k, t, _, i in rows:
        own = [x for x in rows if x[0] == k and t - 5 <= x[1] <= t]
        assert got[i] == (sum(x[2] or 0 for x in own), len(own))
    near = {r.i: r.near for r in frames.near_groups(df, ["k"], "t", 2).collect()}
    for k, t, _, i in rows:
        order = sorted({x[1] for x in rows if x[0] == k})
        at = order.index(t)
        assert near[i] == sum(x[0] == k and x[1] in order[max(0, at - 2) : at + 3] for x in rows)
    own = {r.i: r for r in frames.standing(df, ["k"], "t", "i").collect()}
    for k in "ab":
        values = sorted((x[1], x[3]) for x in rows if x[0] == k)
        assert {own[i].second for _, i in values} == {values[1][0]} and own[values[0][1]].percent_rank == 0
        assert [own[i].tile for _, i in values] == sorted(own[i].tile for _, i in values) and own[values[-1][1]].cume_dist == 1


def listing(path):
    return {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("part-*")}


def test_upserts_leave_other_parts_alone(spark, tmp_path):
    path = str(tmp_path / "results")
    assert store.load(spark, path) is None
    schema = "cve string, binary string, status string, written long"
    first = [(f"C{i}", b, "absent", 1) for i in range(40) for b in ("x", "y")]
    store.upsert(path, spark.createDataFrame(first, schema), parts=16)
    before = listing(path)
    second = [("C3", "x", "present", 2), ("C3", "z", "error", 2), ("C5", "x", "old news", 0), ("C3", "y", "twice", 2), ("C3", "y", "thrice", 3)]
    done = store.upsert(path, spark.createDataFrame(second, schema), parts=16)
    want = {(c, b): (s, w) for c, b, s, w in first} | {("C3", "x"): ("present", 2), ("C3", "z"): ("error", 2), ("C3", "y"): ("thrice", 3)}

    def held():
        return {(r.cve, r.binary): (r.status, r.written) for r in store.load(spark, path).collect()}

    assert held() == want and store.load(spark, path).count() == len(want)
    after = listing(path)
    parts = defaultdict(set)
    for f in before:
        parts[f.parent.name].add(before[f] == after.get(f))
    touched = {f"part={r[0]}" for r in spark.createDataFrame(second, schema).select(F.pmod(F.xxhash64("cve"), F.lit(16))).distinct().collect()}
    assert {p for p, same in parts.items() if same != {True}} == touched and len(parts) > len(touched)
    # a commit that is marked is not done again, whatever it brings
    store.upsert(path, spark.createDataFrame([("C1", "x", "lost", 9)], schema), parts=16, commit=done)
    assert held() == want and listing(path) == after
    store.upsert(path, spark.createDataFrame([], schema), parts=16)
    assert held() == want


def test_buckets_join_where_they_lie(spark):
    left, right = spark.range(0, 3000).withColumn("k", F.col("id") % 500), spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    a, b = store.bucketed(left, ["k"], 8), store.bucketed(right, ["k"], 8)
    joined = a.hint("merge").join(b.hint("merge"), "k").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    assert sorted(map(tuple, joined.collect())) == [(k, 6, 7 * k) for k in range(500)]
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in left.hint("merge").join(right.hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
