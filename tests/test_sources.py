from __future__ import annotations

import json

import pytest

from quillon.operators import analysis, syntax
from quillon.sources import readers, schemas, sinks
from quillon.streaming import pairing


def test_texts_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "a.diff").write_bytes(b"ok \xff\xfe end")
    assert readers.texts(spark, str(tmp_path), "*.diff").first().text == "ok  end"


def test_env_file(spark, tmp_path):
    (tmp_path / "e").write_text("# no\n\nexport A='1=2'\nB = x \nA=\"3\"\nC=\"lone\nexportD=1\n=5\n")
    rows = readers.env_file(spark, str(tmp_path / "e"))
    assert {r.name: r.value for r in rows.collect()} == {"A": "1=2", "B": "x", "C": "lone", "exportD": "1"}
    here = spark.createDataFrame([("B", "kept")], "name string, value string")
    assert {r.name: r.value for r in readers.with_environment(rows, here).collect()} == {"A": "1=2", "B": "kept", "C": "lone", "exportD": "1"}


def test_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"CVE": "A", "vuln": ["x"]}, {"CVE": "B"}]))
    rows = readers.json_documents(spark, str(tmp_path / "t.json"), schemas.GROUNDTRUTH)
    assert sorted((r.CVE, r.vuln) for r in rows.collect()) == [("A", ["x"]), ("B", None)]
    (tmp_path / "k.json").write_text(json.dumps({"A": {"n": 1}, "B": {"n": 2}}))
    assert {r.key: r.value.n for r in readers.keyed_json(spark, str(tmp_path / "k.json"), "struct<n:int>").collect()} == {"A": 1, "B": 2}
    said = spark.createDataFrame([('q"\\é', '{"z": 1, "a": {"y": [], "x": null}}'), ("b", "{}")], "k string, v string")
    sinks.write_json(sinks.object_text(said, "k", said["v"]), str(tmp_path / "out"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    told = {'q"\\é': {"z": 1, "a": {"y": [], "x": None}}, "b": {}}
    assert whole == json.dumps(told, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    assert json.loads(sinks.object_text(said.limit(0), "k", said["v"]).first().json) == {}


def test_configurations(spark, tmp_path):
    def model(**more):
        (tmp_path / "m.json").write_text(json.dumps({"active_profile": "a", "aliases": {"x": "a"}, "profiles": {"a": {"provider": "codex", "reasoning": {"mode": "inherit"}}}} | more))
        return readers.model_config(spark, str(tmp_path / "m.json"))

    assert [(r.name, r.provider, r.mode, r.api_key_envs) for r in readers.profile_rows(model()).collect()] == [("a", "codex", "inherit", None)]
    with pytest.raises(Exception, match="unknown profiles: gone, lost"):
        model(aliases={"x": "lost", "y": "gone", "z": "a"}).collect()
    with pytest.raises(Exception, match="non-empty active_profile"):
        model(active_profile="").collect()

    def view(more):
        bounds = {"default_window": 384, "max_window": 4096, "default_context": 4, "max_context": 16, "default_max_output_bytes": 8192, "min_max_output_bytes": 1024, "max_output_bytes": 65536}
        (tmp_path / "v.json").write_text(json.dumps({"tool": {k: v for k, v in (bounds | more).items() if v is not None}, "other": 1}))
        return readers.view_config(spark, str(tmp_path / "v.json"), "tool")

    assert view({}).first().asDict() == {"default_window": 384, "max_window": 4096, "default_context": 4, "max_context": 16, "default_max_output": 8192, "min_max_output": 1024, "max_max_output": 65536}
    for more, said in (({"max_window": None}, "missing required key: tool.max_window"), ({"max_window": "9"}, "must be int: tool.max_window"), ({"max_window": 1.5}, "must be int: tool.max_window")):
        with pytest.raises(Exception, match=said):
            view(more).collect()
    with pytest.raises(Exception, match="section must be a JSON object: other"):
        readers.view_config(spark, str(tmp_path / "v.json"), "other").collect()


def test_result_schema_offers_no_error():
    row = sinks.result_schema()["properties"]["results"]["items"]["properties"]
    assert "error" not in row["status"]["enum"] and len(row["status"]["enum"]) == 5


def test_nested_results(spark):
    rows = spark.createDataFrame([("C", "b", "present", "high", ["e"], "r"), ("C", "a", "absent", "low", [], "")], schemas.VERDICT)
    got = json.loads(sinks.nested_results(rows).first().json)
    assert list(got) == ["a", "b"] and got["b"]["status"] == "present"


def test_streamed_pairs(spark, tmp_path):
    schema = "run_id string, id string, seq long, time double, phase string"
    (tmp_path / "in").mkdir()
    lines = [("r", "x", 1, 1.0, "start"), ("r", "x", 2, 2.0, "start"), ("r", "x", 3, 3.0, "complete"), ("r", "x", 4, 4.0, "complete"), ("r", "y", 5, 5.0, "complete")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "id", "seq", "time", "phase"), x))) for x in lines))
    q = pairing.paired_stream(pairing.trace_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.id, r.started_at, r.completed_at) for r in spark.table("pairs").collect()) == [("x", 2.0, 3.0), ("x", 4.0, 4.0), ("y", 5.0, 5.0)]


POST = "#define MAX 8\nint f(int n)\n{\n  int d = MAX;\n  if (n > MAX)\n    d = g(n, MAX);\n  return d;\n}\n"
PRE = POST.replace("  if (n > MAX)\n", "")
PATCH = "diff --git a/s.c b/s.c\n@@ -3,4 +3,5 @@ int f(int n)\n {\n   int d = MAX;\n+  if (n > MAX)\n-    d = g(n);\n+    d = g(n, MAX);\n   return d;\n"


def test_analysis(spark):
    functions = spark.createDataFrame([("1", "f", "r", "c", "s.c"), ("2", "gone", "r", "c", "s.c"), ("3", "f", "r", "", "s.c")], "fn string, function string, repo string, commit string, file string")
    blobs = spark.createDataFrame([("r", "c", "s.c", POST), ("r", "c^", "s.c", PRE)], schemas.BLOB)
    diffs = spark.createDataFrame([("1", PATCH), ("2", PATCH)], "fn string, text string")
    out = analysis.analysed(functions, blobs, diffs)
    assert {r.fn: r.status for r in out["status"].collect()} == {"1": "ok", "2": "failed", "3": "failed"}
    edges = {(r.source, r.to) for r in out["edges"].collect()}
    assert {("param:n", "d"), ("macro:MAX", "d"), ("param:n", "n")} <= edges
    code = {r.fn: r.code for r in out["code"].collect()}["1"]
    assert code.startswith("int f(int n)\n{") and "if (n > MAX)" in code and code.endswith("}")
    assert [r.path for r in out["hunks"].collect() if r.fn == "1"] == ["s.c"]


def test_tables_of_an_analysis_are_made_when_asked_for(spark):
    functions = spark.createDataFrame([(str(i), "f", "r", "c", "s.c") for i in range(40)], "fn string, function string, repo string, commit string, file string")
    blobs = spark.createDataFrame([("r", "c", "s.c", POST), ("r", "c^", "s.c", PRE)], schemas.BLOB)
    out = analysis.analysed(functions, blobs, spark.createDataFrame([(str(i), PATCH) for i in range(40)], "fn string, text string"))
    assert {r.status for r in out["status"].collect()} == {"ok"}
    made = set(vars(out))
    assert "_nodes" in made and not made & {"_inside", "_pre_inside", "_old_names", "events", "pre_events", "edges"}
    assert sorted(out) == sorted(analysis.Analysis.TABLES)


def test_parsing_is_dealt_out_and_sliced(spark, monkeypatch):
    """Small sources are not left to one task, and a worker hands its nodes on before it has all."""
    monkeypatch.setattr(syntax, "SLICE", 10)
    sources = spark.createDataFrame([(str(i), POST) for i in range(64)], "fn_id string, text string").coalesce(1)
    nodes = syntax.parse(sources)
    assert nodes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert nodes.groupBy("fn_id").count().select("count").distinct().count() == 1 and nodes.select("fn_id").distinct().count() == 64
