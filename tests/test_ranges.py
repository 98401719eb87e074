"""Range joins over bins and nearest nodes by a sweep, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import cparse
from quillon.operators import diff, intervals, ranges, sweep, syntax


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)

    def some(n, start):
        out = []
        for i in range(n):
            low = rng.choice([rng.randrange(-50, 400), rng.randrange(0, 60), 8 * rng.randrange(40), rng.randrange(-(10**6), 10**6)])
            out.append((start + i, rng.choice("xxxy"), low, low + rng.choice([0, 1, 7, 8, 63, 64, 100, 5000, -1, rng.randrange(200_000)])))
        return out

    a, b = some(300, 0), some(300, 1000)
    a += [(900, "x", None, 4), (901, None, 1, 4), a[0], (902, "x", 5, None)]
    return a, b, spark.createDataFrame(a, "i int, k string, a_low long, a_high long").repartition(3), spark.createDataFrame(b, "j int, k string, b_low long, b_high long").repartition(3)


def pairs(a, b, test):
    return sorted((x[0], y[0]) for x in a for y in b if None not in (x[1], x[2], x[3], y[1]) and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and test(x, y))


def test_overlaps(sides):
    a, b, left, right = sides
    got = ranges.overlaps(left, right, ["k"], ("a_low", "a_high"), ("b_low", "b_high"))
    assert sorted((r.i, r.j) for r in got.collect()) == pairs(a, b, lambda x, y: x[2] <= y[3] and y[2] <= x[3])


def test_containment(sides):
    a, b, left, right = sides
    got = ranges.containing(right, left, ["k"], ("b_low", "b_high"), ("a_low", "a_high"))
    got, want = sorted((r.i, r.j) for r in got.collect()), pairs(a, b, lambda x, y: x[2] <= y[2] and y[3] <= x[3])
    assert got == want, (set(got) ^ set(want), len(got), len(want))
    assert ranges.overlaps(left.limit(0), right, ["k"], ("a_low", "a_high"), ("b_low", "b_high")).count() == 0


def test_bins_cover_a_range_once(spark):
    rng = random.Random(1)
    spans = [(i, low, low + n) for i in range(200) for low in [rng.randrange(-(10**5), 10**5)] for n in [rng.choice([0, 1, 8, 63, 64, 700, 4096])]]
    got = ranges.cover(spark.createDataFrame(spans, "i int, low long, high long"), "low", "high").collect()
    cells = {}
    for r in got:
        cells.setdefault(r.i, []).extend(range(r.bin * 8**r.bin_level, (r.bin + 1) * 8**r.bin_level))
    assert {i: sorted(c) for i, c in cells.items()} == {i: list(range(a, b + 1)) for i, a, b in spans}
    assert max(sum(r.i == i for r in got) for i in cells) <= 14 * 5


def test_a_hot_key_of_a_million_ranges(spark):
    """Ranges [2i, 2i + 3] of one key; the join gives only the pairs that there are, for points and ranges alike."""
    n = 1_000_000
    spans = spark.range(0, n, 1, 8).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (2 * F.col("id")).alias("low"), (2 * F.col("id") + 3).alias("high"))
    points = spark.range(0, 2 * n, 100, 8).select(F.lit("hot").alias("k"), F.col("id").alias("at"), (F.col("id") + 9).alias("to"))
    met = ranges.stab(points, spans, ["k"], "at", "low", "high")
    assert met.count() == 2 * points.count() - 1 and met.filter("at not between low and high").isEmpty()
    assert ranges.cover(spans, "low", "high").count() <= 4 * n
    assert ranges.overlaps(points, spans, ["k"], ("at", "to"), ("low", "high")).groupBy("at").count().groupBy("count").count().orderBy("count").collect()[-1]["count"] == 6


def test_uncovered_equals_pairs(spark):
    rng = random.Random(3)
    inner = [(rng.choice("ab"), s, s + rng.randrange(4), f"c{i}") for i in range(200) for s in [rng.randrange(60)]]
    kept = [(rng.choice("ab"), s, s + rng.randrange(6)) for _ in range(12) for s in [rng.randrange(60)]]
    got = intervals.uncovered(spark.createDataFrame(inner, "fn string, start_line int, end_line int, code string"), spark.createDataFrame(kept, "fn string, start_line int, end_line int"), "fn")
    want = [r for r in inner if not any(k[0] == r[0] and k[2] > k[1] and k[1] <= r[1] and r[2] <= k[2] for k in kept)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hunks_equal_pairs(spark):
    rng = random.Random(5)
    hunks = [(c, f"@@ -1 +{rng.randrange(80)},{rng.randrange(9)} @@" if i % 7 else "@@ bad @@", i) for i in range(90) for c in [rng.choice("abc")]]
    functions = [(c, f"f{i}", s, s + rng.randrange(12)) for i in range(20) for c in [rng.choice("abcd")] for s in [rng.randrange(90)]]
    got = diff.overlapping(spark.createDataFrame(hunks, "cve string, header string, n int"), spark.createDataFrame(functions, "cve string, function string, start_line int, end_line int"), "cve")
    want = []
    for f in functions:
        own = [h for h in hunks if h[0] == f[0]]
        hit = []
        for h in own:
            if "+" in h[1]:
                s, n = map(int, h[1].split("+")[1].split(" ")[0].split(","))
                if s + max(n, 1) - 1 >= f[2] and s <= f[3]:
                    hit.append(h)
        want += [(h[0], f[1], h[1], h[2]) for h in hit or own]
    assert sorted((r.cve, r.function, r.header, r.n) for r in got.collect()) == sorted(want)


def tree(rng, kinds, size):
    """A random tree in preorder: (node_id, last_id, type)."""
    out = []

    def grow(left):
        at = len(out)
        out.append([at, at, rng.choice(kinds)])
        left -= 1
        while left > 0 and rng.random() < 0.8:
            used = rng.randint(1, left)
            grow(used)
            left -= used
        out[at][1] = len(out) - 1

    grow(size)
    return out


def test_nearest_around_equals_all_pairs(spark):
    rng = random.Random(11)
    wanted = {"e": ("s", "t"), "s": ("t",), "t": ("t",)}
    nodes = [(f"f{k}", *n) for k in range(40) for n in tree(rng, "estu", rng.randrange(1, 80))]
    nodes += [("deep", i, 4999 if i < 2500 else i, "s" if i % 2 else "e") for i in range(5000)]  # 2,500 open nodes at once
    df = spark.createDataFrame(nodes, "fn_id string, node_id int, last_id int, type string").repartition(5)
    got = {(r.fn_id, r.node_id): r.around for r in sweep.nearest_around(df, wanted).collect()}
    want = {}
    for f, n, last, kind in nodes:
        if kind in wanted and f != "deep":
            want[f, n] = max((a for g, a, b, k in nodes if g == f and k in wanted[kind] and a <= n <= b), default=n)
    assert {k: v for k, v in got.items() if k[0] != "deep"} == want
    assert len(got) == sum(n[3] in wanted for n in nodes) and got["deep", 4000] == 2499


def test_work_grows_with_nodes(spark, monkeypatch):
    """A function ten times as long makes ten times the rows: each node comes once, each spanned line not at all."""
    def source(n):
        return "int f(int a)\n{\n" + "".join(f"  if (a > {i})\n    a = g(a,\n      {i});\n" for i in range(n)) + "  return a;\n}\n"

    sizes = {}
    for n in (20, 200):
        nodes = syntax.parse(spark.createDataFrame([("f", source(n))], "fn_id string, text string")).cache()
        lines = nodes.select("fn_id", F.col("start_line").alias("line")).distinct()
        sizes[n] = (nodes.count(), sweep.nearest_around(nodes, syntax._OF_PARENT).count(), syntax.named_spans(nodes).count(), ranges.cover(syntax.named_spans(nodes), "start_line", "end_line").count(), syntax.entities(nodes, lines).count())
    assert all(9 < b / a < 11.5 for a, b in zip(sizes[20], sizes[200]))


def test_entities_of_lines(spark):
    text = "int f(int a)\n{\n  a = g(a,\n    h(b,\n      c));\n  return a;\n}\n"
    nodes = syntax.parse(spark.createDataFrame([("f", text)], "fn_id string, text string"))
    lines = spark.createDataFrame([("f", i) for i in (3, 5, 6)] + [("f", 3), ("g", 3)], "fn_id string, line int")
    got = {(r.line, r.name, r.is_call) for r in syntax.entities(nodes, lines).collect()}
    own = [(n[5], n[6], n[7]) for n in cparse.rows(text) if n[3] == "identifier"]
    assert {(i, name, False) for i in (3, 5, 6) for a, b, name in own if a <= i <= b} <= got
    assert {(3, "g", True), (5, "h", True), (5, "g", True)} <= got and not any(r[0] == 4 for r in got)
    assert {name for line, name, call in got if line == 5 and not call} >= {"a", "b", "c"}
