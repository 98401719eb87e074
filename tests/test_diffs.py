from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import attribution, diff
from quillon.plans import oracle
from quillon.plans import queries as catalogue
from tests.compare import duck, same

DIFF = """noise
diff --git a/x.c b/x.c
index 1..2
--- a/x.c
+++ b/x.c
@@ -10,4 +10,5 @@ int f(void)
 a
-b
+c
+++i;
 d
+e
diff --git a/y.txt b/y.txt
@@ -1 +1 @@ in a - b
-one
+two
"""


def test_numbers_skip_lines_that_look_like_heads(spark):
    rows = diff.numbered(diff.blocks(spark.createDataFrame([("C", DIFF)], "cve string, text string"), "cve"), "cve").collect()
    own = [r for r in rows if r.path == "x.c"]
    assert {r.new_ln: r.content for r in own if r.sign == "+"} == {11: "c", 13: "e"}
    assert {r.old_ln: r.content for r in own if r.sign == "-"} == {11: "b"}
    assert not [r for r in rows if r.path == "y.txt"]  # its last token with a sign is no number


def test_hunks_and_files(spark):
    blocks = diff.blocks(spark.createDataFrame([("C", DIFF)], "cve string, text string"), "cve")
    hunks = {r.path: (r.old_lines, r.new_lines) for r in diff.split_hunks(blocks, "cve").collect()}
    assert hunks == {"x.c": (["b"], ["c", "e"]), "y.txt": (["one"], ["two"])}
    files = diff.files(spark.createDataFrame([("C", DIFF)], "cve string, text string"), "cve")
    assert [r.path for r in files.orderBy("ord").collect()] == ["x.c", "y.txt"]


def test_attribution_scores(spark):
    text = "\n".join([
        "diff --git a/d.c b/d.c", "@@ -1 +1 @@", "+int defined(int a) {", "diff --git a/h.c b/h.c", "@@ -1 +1 @@ int headed(void)", "+x", "diff --git a/c.c b/c.c", "@@ -1 +1 @@", " y = called (1);", "diff --git a/m.c b/m.c", "@@ -1 +1 @@", " use mentioned here",
    ])
    blocks = diff.blocks(spark.createDataFrame([("C", text)], "cve string, text string"), "cve")
    names = spark.createDataFrame([("C", n) for n in ("defined", "headed", "called", "mentioned", "nothing")], "cve string, function string")
    got = {r.function: (r.file, r.inferred_by, r.score) for r in attribution.inferred_files(attribution.block_scores(blocks, names)).collect()}
    assert got == {
        "defined": ("d.c", "function_definition_hunk_match", 105), "headed": ("h.c", "function_header_hunk_match", 55), "called": ("c.c", "function_reference_hunk_match", 40),
        "mentioned": ("m.c", "function_reference_hunk_match", 15), "nothing": ("d.c", "", 0),
    }


NAMES = ("get", "set_x", "x", "operator+", "a::b", "naïve", "", "do it", "absent", "get", None)


def test_a_line_is_read_once_for_all_names(spark):
    """Plain names come from a line's words, odd ones by search: the same scores as every pair of a line and a name gives."""
    said = [
        "get(1)", " get(1)", "+get", "+int get (void)", "+int *get(void)", "-int\tget  (", "+struct s get(int (*x)(int))", " int get(void)", "+ (get)", "+forget(x)", "+getx get_ 9get", "-static a::b (c)", "+T operator+ (T)",
        " f(set_x (2))", "+naïve x(", "+unnaïve get\u00e9(", "+do it (now)", "+a * x (", "", "+", "-- get", "+ x\t\u2028(",
    ]
    heads = ["@@ -1 +1 @@ int set_x(void)", "@@ -1 +1 @@", "@@ get -1 +1 @@ operator+ a::b", "@@ -1 +1"]
    texts = [(f"C{i}", f"noise\ndiff --git a/e.c b/e.c\nindex get\ndiff --git a/{i}.c b/{i}.c\n{heads[i % 4]}\n{x}\n@@ -9 +9 @@\n{said[i - 1]}\n") for i, x in enumerate(said)]
    blocks = diff.blocks(spark.createDataFrame(texts, "cve string, text string"), "cve")
    names = spark.createDataFrame([(f"C{i}", n) for i in range(len(said)) for n in NAMES], "cve string, function string")
    scores = attribution.block_scores(blocks, names)
    pair = F.when(F.col("hunk_ord") > 0, attribution.line_score(F.when(F.col("is_header"), "").otherwise(F.col("line")), F.col("header"), F.col("function"))).otherwise(0)
    pairs = blocks.join(names, "cve").groupBy("cve", "function", "file_ord", "path").agg(F.max(pair).alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s") + attribution.CODE).otherwise(0))
    want = sorted(map(str, pairs.select("cve", "function", "file_ord", "path", "s").collect()))
    assert want == sorted(map(str, scores.select("cve", "function", "file_ord", "path", F.col("score").alias("s")).collect()))
    assert len({r.score for r in scores.collect()}) == 5
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan  # lines times functions are not sorted by their paths


def test_diffs_are_taken_apart_in_place(spark):
    """Files, hunks and line numbers of a diff need no other row, so nothing is dealt out or sorted."""
    text = "\n".join(["noise", "@@ no hunk", "diff --git a/x.c b/x.c", "--- a/x.c", "@@ -1 +1 @@ f", "+a", "", "@@ -5 +5 @@", "diff --git a/o.c /dev/null", "@@ -1 +0,0 @@", "-b", "", ""])
    rows = diff.blocks(spark.createDataFrame([("C", text), ("D", ""), ("E", None), ("F", "diff --git a b\n")], "cve string, text string"), "cve")
    got = [(r.cve, r.line_no, r.file_ord, r.hunk_ord, r.header, r.path, r.is_header) for r in rows.orderBy("cve", "line_no").collect()]
    first, second = "@@ -1 +1 @@ f", "@@ -5 +5 @@"
    assert got == [
        ("C", 3, 1, 0, None, "x.c", True), ("C", 4, 1, 0, None, "x.c", False), ("C", 5, 1, 1, first, "x.c", True), ("C", 6, 1, 1, first, "x.c", False), ("C", 7, 1, 1, first, "x.c", False), ("C", 8, 1, 2, second, "x.c", True),
        ("C", 9, 2, 0, None, "", True), ("C", 10, 2, 1, "@@ -1 +0,0 @@", "", True), ("C", 11, 2, 1, "@@ -1 +0,0 @@", "", False), ("C", 12, 2, 1, "@@ -1 +0,0 @@", "", False), ("F", 1, 1, 0, None, "", True),
    ]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_exact_ids(spark):
    cves = spark.createDataFrame([("CVE-2014-36", "")], "cve string, commit string")
    paths = spark.createDataFrame([("p/x_CVE-2014-3613_1.diff",)], "path string")
    assert attribution.match_diff_files(cves, paths, "x").first().path and attribution.match_diff_files(cves, paths, "x", exact=True).first().path is None


def test_a_first_word_with_a_sign_keeps_its_diff(spark, tmp_path):
    """The synthetic diffs put the first word into the hunk's header, where a sign before it is no line number."""
    texts = [(1, "+1 (017) a\nb\nc"), (2, "--x y\nz"), (3, "plain\n\nq")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(str(tmp_path))
    for name in ("diff_parse_lines", "changed_in_range", "hunk_old_new", "hunk_score_argmax"):
        same(catalogue.QUERIES[name](spark, str(tmp_path)), con, oracle.ORACLES[name])


def test_overlaps_are_not_broadcast(spark, tmp_path):
    """A compressed file of few bytes may hold more rows than a driver; neither hunks nor functions have a bound."""
    hunks = spark.createDataFrame([("C", "@@ -1,2 +5,3 @@", 1), ("C", "@@ -1 +40 @@", 2), ("D", "@@ -1 +1 @@", 3)], "cve string, header string, n long")
    functions = spark.createDataFrame([("C", "f", 6, 9), ("C", "g", 100, 110), ("D", "h", 1, 1)], "cve string, function string, start_line int, end_line int")
    hunks.write.parquet(f"{tmp_path}/hunks")
    functions.write.parquet(f"{tmp_path}/functions")
    got = diff.overlapping(spark.read.parquet(f"{tmp_path}/hunks"), spark.read.parquet(f"{tmp_path}/functions"), "cve")
    assert sorted((r.function, r.n) for r in got.collect()) == [("f", 1), ("g", 1), ("g", 2), ("h", 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
