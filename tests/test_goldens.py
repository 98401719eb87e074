"""Small inputs with answers worked by hand, one for each quirk that is kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import diff, intervals, linescan, macros, normalise, planning, rollup, syntax, verdict


def _values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_symbols_at_one_address_end_at_once(spark):
    rows = spark.createDataFrame([(0x10, "a", 0), (0x10, "b", 1), (0x40, "c", 2), (0x400, "d", 3)], "addr long, name string, seq long")
    got = _values(linescan.symbol_ranges(rows, 0x100), "name", "addr", "stop")
    assert got == [("a", 0x10, 0x11), ("b", 0x10, 0x40), ("c", 0x40, 0x140), ("d", 0x400, 0x500)]


def test_symbol_table_lines(spark):
    rows = spark.createDataFrame([(1, "0000000000000040 T main"), (2, "0000000000000010 t f(int, char)"), (3, "                 U puts"), (4, "0000000000000080 D data"), (5, "zz T bad")], "line_no int, line string")
    assert _values(linescan.parse_symbols(rows), "addr", "kind", "name") == [(16, "t", "f(int, char)"), (64, "T", "main")]


def test_context_around_hits(spark):
    lines = spark.createDataFrame([("k", i, "x" if i in (3, 4, 8) else "-") for i in range(1, 10)], "k string, line_no int, line string")
    rows = linescan.grep(lines, "x", 1, "k").orderBy("line_no").collect()
    assert [(r.line_no, r.separator) for r in rows] == [(2, False), (3, False), (4, True), (5, False), (7, True), (8, False), (9, False)]


def test_limit_zero(spark):
    cves = spark.createDataFrame([("B",), ("A",), ("C",)], "cve string")
    assert planning.select_cves(cves, limit=0).count() == 0
    assert planning.select_cves(cves, limit=0, zero_is_all=True).count() == 3
    assert _values(planning.select_cves(cves, limit=2), "cve") == [("A",), ("B",)]
    ordered = spark.createDataFrame([("B", 0), ("A", 1), ("C", 2)], "cve string, ord int")
    assert _values(planning.select_in_order(ordered, "ord", 2), "cve") == [("A",), ("B",)] and planning.select_in_order(ordered, "ord").count() == 3


def test_ids_and_levels(spark):
    row = spark.range(1).select(text.run_id_of(F.lit("CVE-1__a b/c")), *(text.optimisation_level(F.lit(x)) for x in ("o0", "O2", "Os", "o10"))).first()
    assert tuple(row) == ("CVE-1__a_b_c", "O0", "O2", "Os", "o10")


def test_quoted_names_in_patterns(spark):
    said = spark.createDataFrame([("x->op*(y)", "op*"), ("my_free (p)", "free"), ("free (p)", "free"), ("a.b", "a\\Eb")], "t string, n string")
    got = [tuple(r) for r in said.select(text.mentions(F.col("t"), text.identifier_pattern(F.col("n"))), text.mentions(F.col("t"), text.call_pattern(F.col("n")))).collect()]
    assert got == [(True, True), (False, False), (True, True), (False, False)]


def test_code_snippets(spark):
    long = "\n".join(f"  line {i}" for i in range(10))
    row = spark.range(1).select(text.compact_code(F.lit(long)), text.line_at(F.lit("a\nb"), F.lit(2)), text.line_at(F.lit("a\nb"), F.lit(3)), text.line_at(F.lit("a\nb"), F.lit(0)), text.shell_quote(F.lit("it's"))).first()
    assert tuple(row) == (" ".join(f"line {i}" for i in range(8)) + " ...", "b", "", "", "'it'\"'\"'s'")


def test_containment_golden(spark):
    rows = spark.createDataFrame([("f", 1, 10, 0), ("f", 2, 3, 1), ("f", 10, 12, 2), ("f", 1, 10, 3)], "fn string, start_line int, end_line int, seq int")
    assert _values(intervals.outermost(rows, "fn"), "start_line", "end_line", "seq") == [(1, 10, 0), (10, 12, 2)]


def test_hunks_without_overlap_all_stay(spark):
    hunks = spark.createDataFrame([("C", "@@ -1,2 +1,2 @@"), ("C", "@@ -9 +9 @@")], "cve string, header string")
    functions = spark.createDataFrame([("C", "f", 50, 60)], "cve string, function string, start_line int, end_line int")
    assert diff.overlapping(hunks, functions, "cve").count() == 2


def test_macro_heads(spark):
    rows = macros.definitions(spark.createDataFrame([("f", "#define F(a, b) x\n#define G(x) y\n#define H\n#define K 1\n#define K 2")], "file string, text string"), "file")
    assert _values(rows, "name", "body") == [("F(a,", "b) x"), ("H", "1"), ("K", "2")]
    cut = macros.definitions(spark.createDataFrame([("f", "#define K 1\n#define K 2", 1)], "file string, text string, n int"), "file", until="n")
    assert _values(cut, "name", "body") == [("K", "1")]


def test_declared_names(spark):
    nodes = syntax.parse(spark.createDataFrame([("1", "void f(void)\n{\n  char buf[SIZE], *p = q;\n  do { n--; } while (n);\n}\n")], "fn_id string, text string"))
    assert _values(syntax.declarations(nodes), "var", "ids") == [("SIZE", ["SIZE", "buf", "p", "q"]), ("p", ["SIZE", "buf", "p", "q"])]
    assert _values(syntax.local_names(nodes), "name") == [("SIZE",), ("buf",), ("p",), ("q",)]


def test_final_text_and_status(spark):
    rows = spark.createDataFrame([("  ", "out"), ("said", "out"), (None, "out"), ("\n", "out"), (" a\n", "out"), ("\u2003\x1c", "out")], "last string, stdout string")
    assert [r[0] for r in rows.select(verdict.final_text(F.col("last"), F.col("stdout"))).collect()] == ["out", "said", "out", "out", " a\n", "out"]
    said = spark.createDataFrame([("C", "absent"), ("C", "error"), ("D", "absent")], "cve string, status string")
    assert _values(verdict.has_status(said, "error"), "cve", "has") == [("C", True), ("D", False)]


def test_enrichment(spark):
    items = spark.createDataFrame([("A",), ("B",), ("C",)], "cve string")
    old = spark.createDataFrame([("A", "r", "i"), ("B", "r", "")], "cve string, root_cause_analysis string, patch_intent_analysis string")
    assert _values(verdict.unfinished(items, old), "cve") == [("B",), ("C",)]


def test_rollup_keeps_repeats_and_first_values(spark):
    rows = spark.createDataFrame([("p", "C", 1, "g", ["h1"], "", ["c2"], "s2", "m2"), ("p", "C", 0, "f", ["h1", "h2"], "code", ["c1", "c3"], "s1", "m1")], "project string, cve string, ord int, function string, hunks array<string>, code string, cwe array<string>, summary string, message string")
    r = rollup.compact(rows).first()
    assert (r.cwe, r.patch_commit_message, r.patch_hunk, r.functions) == ("c1", "m1", ["h1", "h2", "h1"], ["f", "g"]) and [x.function for x in r.reduced_function_code] == ["f"]


def test_report(spark):
    """A run without files, steps and counters has its headings and nothing under them."""
    runs = spark.createDataFrame([("p", "/o", None)], "project string, output_dir string, repo_path string")
    files = spark.createDataFrame([], "project string, ord int, label string, path string, exists boolean")
    steps = spark.createDataFrame([], "project string, ord int, name string, status string, returncode int, seconds double, log string, note string, command array<string>")
    counters = spark.createDataFrame([("p", "source", "cve_count", 2), ("p", "source", "analysis_status.ok", 5)], "project string, section string, key string, n long")
    want = "# p metadata pipeline run\n\n## 产物\n\n## 输入\n- project: `p`\n- output_dir: `/o`\n- repo_path: ``\n\n## 步骤\n## 源码分析统计\n- cve_count: `2`\n- function_count: `0`\n- analysis_status.ok: `5`\n\n## 说明\n- n\n"
    assert rollup.report(runs, files, steps, counters, ("n",)).first().report == want


def test_bad_records_fail_the_load(spark):
    rows = spark.createDataFrame([(0, "A", None, ["x"], None, None), (1, "", None, ["x"], None, None), (2, "B", [], None, None, None), (3, "C", None, [None], None, None), (4, "D", None, ["x"], [None], None)], "ord int, CVE string, binaries array<string>, vuln array<string>, patch array<string>, not_affected array<string>")
    assert tuple(normalise.invalid_testset(rows).first()) == (5, "1, 2, 3, 3, 4")
    with pytest.raises(Exception, match="Bad item indexes: 1, 2, 3, 3, 4"):
        normalise.testset(rows.withColumn("functions", F.lit(None).cast("array<string>")), strict=True).collect()
    with pytest.raises(Exception, match="Bad item indexes: 1, 3, 4"):
        normalise.groundtruth(rows, strict=True).collect()
    good = rows.filter("ord = 0").withColumn("functions", F.lit(None).cast("array<string>"))
    assert _values(normalise.testset(good, strict=True), "cve", "binaries") == [("A", ["x"])]


def test_missing_paths_fail(spark):
    asked = spark.createDataFrame([("1", None, "/b", "/x", "O0", "a", None, None, None)], "id string, project string, base string, binaries string, opt string, project_json string, testset_json string, target_dir string, output string")
    derived = planning.derived_paths(asked, spark.createDataFrame([], "path string"))
    with pytest.raises(Exception, match="missing required arguments: --testset-json, --target-dir, --output"):
        planning.required(derived).collect()


def test_a_view_configuration_is_one_row(spark):
    asked = spark.createDataFrame([(1, 2, 3)], "window long, context long, max_output long")
    config = spark.sql("SELECT 1L AS default_window, 5L AS max_window, 1L AS default_context, 1L AS max_context, 9L AS default_max_output, 4L AS min_max_output, 9L AS max_max_output")
    assert _values(linescan.clamped_limits(asked, config), "window", "context", "max_output") == [(1, 1, 4)]
    with pytest.raises(Exception, match="not one row"):
        linescan.clamped_limits(asked, config.union(config)).collect()


def test_suffixes_and_integers(spark):
    paths = {"..c": True, ".c": False, "a/.b.h": True, "a.": False, "x.tar.HPP": True, "c": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: bool(r.c) for r in rows.select("p", text.is_code_path(F.col("p")).alias("c")).collect()} == paths
    rows = spark.createDataFrame([(t,) for t in ("_1", "1__0", "1_0", "0x_f", "0x", "0_0", "00", "01", "-0b1", "+7", "\t8 ", "1_", "0o8", "x")], "t string")

    def python(t):
        try:
            return int(t, 0)
        except ValueError:
            return None

    assert all(r.v == python(r.t) for r in rows.select("t", text.parse_int(F.col("t")).cast("long").alias("v")).collect())


def test_products_are_no_declarations(spark):
    nodes = syntax.parse(spark.createDataFrame([("1", "void f(void)\n{\n  T * b;\n  a * b(c);\n  T g(int);\n}\n")], "fn_id string, text string"))
    assert _values(nodes.filter("type = 'declaration'"), "start_line") == [(3,), (5,)]


def test_whole_streams_give_the_same(spark):
    lines = spark.createDataFrame([(k, i, "é" * (i % 4)) for k in (1, 2) for i in range(1, 40 * k)], "k int, line_no int, line string")
    for cap in (1, 7, 50, 10_000):
        a, b = (_values(linescan.output(lines, cap, "k"), "k", "text", "truncated"), _values(linescan.capped(lines, cap, "k", whole=True), "k", "line_no", "out", "truncated"))
        assert b == _values(linescan.capped(lines, cap, "k"), "k", "line_no", "out", "truncated")
        assert [t for _, t, _ in a] == ["".join(r[2] for r in b if r[0] == k) for k in (1, 2)]


def test_names_in_order(spark):
    row = spark.range(1).select(normalise.function_names(F.expr("array('b', 'a')"), F.expr("array('c', 'a')"))).first()
    assert row[0] == ["b", "a", "c"]
