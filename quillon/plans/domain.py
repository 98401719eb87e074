"""Queries of the operators on domain records, which are made from the volume tables by fixed rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import jsons, text
from quillon.operators import analysis, attribution, dataflow, diff, evaluation, intervals, linescan, macros, models, normalise, planning, rollup, trace, verdict
from quillon.sources import readers, schemas, sinks
from quillon.sources.tables import shared_dir, table
from quillon.streaming import pairing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


# -- inputs


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).selectExpr(
        "doc_id as ord", "source as CVE", "array(lang, concat('b', doc_id % 7), lang) as vuln", "array(concat('b', doc_id % 5), concat('b', doc_id % 5), 'p') as patch",
        "case when doc_id % 3 > 0 then array(concat('b', doc_id % 4), 'n') end as not_affected",
    )


@query
def groundtruth_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalise.groundtruth(_truth(spark, sf), strict=True)
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("l")) for s in normalise.SIDES))
    return rows.select("cve", F.explode(sides).alias("x")).select("cve", "x.side", F.posexplode("x.l").alias("pos", "binary"))


@query
def groundtruth_invalid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _truth(spark, sf).withColumn("CVE", F.when(F.col("ord") % 40 != 7, F.col("CVE"))).withColumn("patch", F.when(F.col("ord") % 50 == 9, F.array(F.lit(None).cast("string"))).otherwise(F.col("patch")))
    return normalise.invalid_groundtruth(rows)


@query
def expected_status(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.expected_statuses(normalise.groundtruth(_truth(spark, sf)))


def _testset(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).withColumn("functions", F.array("CVE")).withColumn("binaries", F.when(F.col("ord") % 2 == 0, F.array(F.lit("x"), F.concat(F.lit("x"), F.col("ord") % 9), F.lit("x"))))


@query
def testset_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.testset(_testset(spark, sf), strict=True).select("cve", F.posexplode("binaries").alias("pos", "binary"))


@query
def testset_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """No CVE; no binaries; a null in the first list (told twice) and in the second (told once)."""
    k, null = F.pmod("ord", F.lit(60)), F.array(F.lit(None).cast("string"))
    rows = _testset(spark, sf).withColumn("CVE", F.when(k != 11, F.col("CVE")).otherwise("")).withColumn("binaries", F.when(k == 20, F.array().cast("array<string>")).when(k.isin(31, 41), None).otherwise(F.col("binaries")))
    return normalise.invalid_testset(rows.withColumn("vuln", F.when(k == 31, null).otherwise(F.col("vuln"))).withColumn("patch", F.when(k == 41, null).otherwise(F.col("patch"))))


@query
def cveinfo_normalize(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.when(F.col("doc_id") % 11 == 0, "X-").otherwise("CVE-"), F.col("doc_id") % 97)
    at = lambda n, other: F.when(F.col("doc_id") % 3 == n, key).otherwise(other)
    raw = _docs(spark, sf).select(F.col("doc_id").alias("ord"), at(0, F.lit("")).alias("id"), at(1, F.lit(None)).alias("cve"), at(2, F.lit(None)).alias("upper_cve"), F.col("source").alias("summary"), F.array("lang", "source").alias("cwe"))
    return normalise.cveinfo(raw).select("cve", "summary", F.posexplode("cwe").alias("pos", "cwe"))


@query
def source_diff_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = _docs(spark, sf).select(F.nullif(F.col("lang"), F.lit("fr")).alias("project"), F.concat(F.when(F.col("doc_id") % 5 > 0, "CVE-").otherwise("note-"), "doc_id").alias("cve"), F.col("source").alias("commit"))
    return normalise.source_diff(raw, "en").select("cve", "commit")


def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: F.concat(F.lit("f"), (F.col("doc_id") + k) % 3)
    item = lambda f, t: F.struct(f.alias("function"), t.alias("type"))
    listed = F.array(item(n(0), F.col("lang")), item(n(1), F.lit("")), item(F.lit(""), F.lit("added")), item(n(0), F.when(F.col("doc_id") % 4 > 0, F.col("source"))))
    return _docs(spark, sf).select(F.col("doc_id").alias("cve"), listed.alias("analysis"))


@query
def change_types(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.change_types(_analysis(spark, sf))


@query
def function_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A record's functions, and the union with those of its code, in order; a function's commit is its own or the record's."""
    own = normalise.functions_of(F.col("analysis"))
    every = normalise.function_names(own, F.array(F.concat(F.lit("f"), F.col("cve") % 2), F.lit("g")))
    commit = normalise.function_commit(F.when(F.col("cve") % 3 == 0, F.lit("own")).otherwise(""), F.when(F.col("cve") % 2 == 0, F.lit("cve")))
    return _analysis(spark, sf).select("cve", F.array_join(own, ",").alias("functions"), F.array_join(every, ",").alias("names"), commit.alias("commit"))


@query
def info_join(spark: SparkSession, sf: str) -> DataFrame:
    records = _docs(spark, sf).select(F.col("doc_id").alias("cve"))
    info = table(spark, sf, "labels").select(F.col("doc_id").alias("cve"), F.col("quality").cast("string").alias("summary"), F.array(F.col("toxic").cast("string")).alias("cwe"))
    return attribution.with_info(records, info).select("cve", "summary", F.size("cwe").alias("cwes"), "no_info")


@query
def cve_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The key goes into records that lack it; a null under the key stays."""
    own = F.when(F.col("event_id") % 3 == 0, '"cve_id":"kept",').when(F.col("event_id") % 3 == 1, '"cve_id":null,').otherwise("")
    items = table(spark, sf, "events").select("event_id", F.concat(F.lit("CVE-"), "event_id").alias("cve"), F.concat(F.lit("{"), own, F.expr("substring(props, 2)")).alias("item"))
    v = F.parse_json("item")
    return normalise.cve_payload(items).select("event_id", F.try_variant_get(v, "$.cve_id", "string").alias("cve_id"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query
def compact_functions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "source").when(F.col("doc_id") % 3 == 1, "").alias("reduced_code"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("prompt_code"))
    return normalise.compact_function(rows)


@query
def env_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Env files, one of each user; names that the environment has already do not count."""
    k, name = F.col("event_id") % 8, F.concat(F.lit("N"), F.col("event_id") % 11)
    value = F.concat(F.lit("v="), F.col("event_id").cast("string"))
    line = (
        F.when(k == 0, F.concat(F.lit("# "), name, F.lit("=1"))).when(k == 1, "   ").when(k == 2, F.concat(F.lit("export "), name, F.lit('="'), value, F.lit("'\""))).when(k == 3, F.concat(F.lit("  "), name, F.lit(" = '"), value, F.lit("  ")))
        .when(k == 4, name).when(k == 5, F.concat(F.lit("="), value)).when(k == 6, F.concat(F.lit("export"), name, F.lit("=\""), value)).otherwise(F.concat(name, F.lit("="), value))
    )
    found = readers.env_lines(table(spark, sf, "events").select("user_id", "event_id", line.alias("line")), "line", "event_id", "user_id")
    every = readers.env_lines(table(spark, sf, "events").select("event_id", line.alias("line")), "line", "event_id")
    mine = readers.with_environment(every, spark.sql("SELECT 'N3' AS name, 'set' AS value")).withColumn("user_id", F.lit(-7).cast("long"))
    return found.unionByName(mine).select("user_id", "name", "value")


# -- planning


@query
def select_all_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Limit 0 is no row in one place, all in another, in order either way; and rows in input order."""
    cves = _docs(spark, sf).select(F.col("source").alias("cve")).distinct()
    rows = _docs(spark, sf).select(F.col("source").alias("cve"), F.col("doc_id").alias("ord"))
    every = planning.select_cves(cves, limit=0, zero_is_all=True).select(F.lit("all").alias("how"), "cve")
    none = planning.select_cves(cves, limit=0).select(F.lit("none").alias("how"), "cve")
    first = planning.select_in_order(rows, "ord", 7).select(F.lit("first").alias("how"), "cve")
    return every.union(none).union(first).union(planning.select_in_order(rows, "ord", 0).groupBy().agg(F.count("*").cast("string").alias("cve")).select(F.lit("whole").alias("how"), "cve"))


@query
def path_derivation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 6
    given = lambda n, c: F.when(k == n, F.lit(c)).alias
    asked = _docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.when(k != 0, F.concat(F.lit("p"), "doc_id")).alias("project"), F.lit("/base").alias("base"), F.lit("/bin").alias("binaries"), F.lit("O0").alias("opt"),
        given(1, "/own.json")("project_json"), given(0, "/t.json")("testset_json"), F.lit(None).cast("string").alias("target_dir"), given(0, "/o.json")("output"),
    )
    p = F.concat(F.lit("p"), "doc_id")
    there = F.array_compact(F.array(F.when(k == 2, F.concat(F.lit("/base/"), p, F.lit(".json"))), F.when(k == 3, F.concat(F.lit("/base/"), p, F.lit("/targets"))), F.when(k == 4, F.concat(F.lit("/base/"), p)), F.when(k == 5, "/base/testset.json")))
    present = _docs(spark, sf).select(F.explode(there).alias("path"))
    return planning.derived_paths(asked, present).select("id", *planning.NEEDED, "problem")


@query
def first_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(F.col("source").alias("project"), F.col("doc_id").alias("rank"), F.concat(F.lit("/r/"), "doc_id").alias("path"), (F.col("doc_id") % 9 == 4).alias("exists"))
    return planning.first_existing(rows, "project")


@query
def exposed_answers(spark: SparkSession, sf: str) -> DataFrame:
    answers = _docs(spark, sf).select(F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/t"), "doc_id").alias("path"))
    near = F.element_at(F.array(*map(F.lit, ("en", "de", "es", "e"))), (F.col("item_id") % 4 + 1).cast("int"))
    roots = table(spark, sf, "benchmark").select(F.concat(F.lit("/"), near, F.lit("/src"), F.col("item_id"), F.when(F.col("item_id") % 3 == 0, "/").otherwise("")).alias("root")).union(spark.sql("SELECT '/fr' UNION ALL SELECT '/e' UNION ALL SELECT '/it//'"))
    return planning.exposed_answers(answers, roots)


@query
def resolve_binaries(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("b"), "doc_id")
    asked = _docs(spark, sf).select(name.alias("binary"), F.col("lang").alias("compiler"))
    files = _docs(spark, sf).select(F.when(F.col("doc_id") % 4 == 0, name).when(F.col("doc_id") % 4 == 1, F.concat(name, F.lit("-deployed"))).otherwise(F.concat(name, F.lit("-"), "lang", F.lit("-O0"))).alias("name"))
    both = files.union(_docs(spark, sf).filter("doc_id % 8 = 0").select(F.concat(name, F.lit("-deployed"))))
    return planning.resolve_binaries(asked, both, text.optimisation_level(F.lit("o0"))).select("binary", "actual")


@query
def mapping_record(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded mapping of anonymous targets, in request order within a CVE."""
    targets = _docs(spark, sf).select(F.col("source").alias("cve"), F.col("doc_id").alias("ord"), F.concat(F.lit("b"), "doc_id").alias("original"), F.concat(F.lit("b"), "doc_id", F.lit("-deployed")).alias("actual"))
    return sinks.mapping_payload(planning.anonymous_names(targets, "cve", "ord"), "/h")


@query
def pipeline_steps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("doc_id", F.lit(4)).cast("int")
    return sinks.step_log(_docs(spark, sf).select(F.col("doc_id").alias("name"), F.when(k > 0, k - 1).alias("returncode"), (F.col("n_chars") / 8).alias("seconds")))


# -- texts and paths


@query
def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (".c", "..c", "/x.H", ".tar.gz", "/.c", "/Makefile", ".c/readme", " é.cpp", ".C.", "/a.hxx"))), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = _docs(spark, sf).select("doc_id", F.concat("lang", F.lit("/"), "source", tail).alias("path"))
    return rows.select("doc_id", F.coalesce(text.is_code_path(F.col("path")), F.lit(False)).alias("code"), text.safe_name(F.col("path")).alias("safe"), text.run_id_of(F.col("path")).alias("run_id"))


@query
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/w/"), "source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("/"), "lang", F.lit(".v1.json"))).otherwise(""))
    rows = _docs(spark, sf).select("doc_id", path.alias("path"))
    said = text.capped(F.col("path"), 8)
    return rows.select("doc_id", text.is_inside(F.col("path"), F.lit("/w/src1/")).alias("inside"), text.project_name(F.col("path"), "src2").alias("project"), text.project_of_diff(F.concat("path", F.lit("/")), ("src11", "src1", "en_")).alias("of_diff"), said.alias("capped"))


@query
def parse_integers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    octal = F.conv(n.cast("string"), 10, 8)
    shapes = [
        n.cast("string"), F.concat(F.lit("0x"), F.hex(n)), F.concat(F.lit("-0X_"), F.lower(F.hex(n))), F.concat(F.lit(" 0b"), F.bin(n), F.lit("\t")), F.concat(F.lit("+0o"), octal), F.concat(n.cast("string"), F.lit("_7")),
        F.concat(F.lit("_"), n.cast("string")), F.concat(n.cast("string"), F.lit("__0")), F.concat(F.lit("0"), n.cast("string")), F.lit("0_0"), F.concat(F.lit("0x"), n.cast("string"), F.lit("_")), F.lit(""),
    ]
    said = F.element_at(F.array(*shapes), (n % len(shapes) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.parse_int(said).cast("long").alias("v"))


@query
def line_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).filter("text is not null").select("doc_id", F.octet_length(text.line_at(F.col("text"), (F.col("doc_id") % 4).cast("int"))).cast("long").alias("bytes"))


@query
def shell_words(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(F.col("source"), F.concat("source", F.lit(" "), "lang"), F.concat(F.lit("it's "), "lang"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", text.shell_quote(said).alias("word"))


@query
def deanonymize_text(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("see target_010/target_001 in /t/target_0011, "), "role", F.lit(" /t/target_010"))
    names = F.array(F.struct(F.lit("target_001").alias("anonymous"), F.concat(F.lit("y"), "conv_id").alias("original")), F.struct(F.lit("target_010").alias("anonymous"), F.concat(F.lit("x"), "turn").alias("original")))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.remap_names(said, names, F.lit("/t")).alias("said"))


# -- verdicts


@query
def final_texts(spark: SparkSession, sf: str) -> DataFrame:
    last = F.element_at(F.array(F.lit(None), F.lit(" \n\t"), F.concat(F.lit(" "), "source", F.lit("\n")), F.col("lang"), F.lit("\n")), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", verdict.final_text(last, F.concat(F.lit("out "), "doc_id")).alias("said"))


@query
def verdict_validate(spark: SparkSession, sf: str) -> DataFrame:
    cve = F.concat(F.lit("C"), "doc_id")
    row = lambda status: F.concat(F.lit('{"binary": "'), "lang", F.lit(f'", "status": "{status}"'))
    forms = [
        F.concat(F.lit('{"results": ['), row("absent"), F.lit("}, "), row("present"), F.lit(', "confidence": "high", "evidence": "one", "reasoning": "r"}, {"cve": "other", "binary": "'), "source", F.lit('", "status": "present"}]}')),
        F.concat(F.lit('text {"'), cve, F.lit('": {"'), "source", F.lit('": {"status": "not_found", "evidence": 7}}} more')),
        F.concat(F.lit('```json\n{"'), "lang", F.lit('": {"status": "inconclusive", "confidence": "odd", "evidence": ["x", 1, true, null]}}\n```')),
        F.concat(F.lit('```json\n{bad}\n``` {"'), "lang", F.lit('": {"status": "present"}}')),
        F.concat(F.lit('{"results": ['), row("foo"), F.lit("}]}")),
        F.lit(""),
    ]
    raw = _docs(spark, sf).select(cve.alias("cve"), F.array("lang", "source").alias("binaries"), F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int")).alias("final_text"))
    rows = verdict.validated(verdict.extracted(raw))
    return rows.select("cve", "binary", "status", "confidence", F.array_join("evidence", "|").alias("evidence"), "reasoning")


@query
def deanonymize_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    targets = _docs(spark, sf).select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 200)).alias("cve"), "doc_id", F.concat(F.lit("lib"), "doc_id").alias("original"))
    names = planning.anonymous_names(targets, "cve", "doc_id")
    said = names.filter("doc_id % 3 > 0").select("cve", F.col("anonymous").alias("binary"), F.lit("present").alias("status"), F.lit("high").alias("confidence"), F.array(F.concat(F.lit("in /t/"), "anonymous"), F.lit("none")).alias("evidence"), F.concat("anonymous", F.lit(" has it")).alias("reasoning"))
    rows = verdict.deanonymised(said, names.select("cve", "anonymous", "original"), F.lit("/t"))
    return rows.select("cve", "binary", "status", "confidence", F.array_join("evidence", "|").alias("evidence"), "reasoning")


@query
def any_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("source").alias("cve"), F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "error").otherwise("present").alias("status"))
    return verdict.has_status(rows, "error")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    forms = [
        F.concat(F.lit('```json\n{"root_cause_analysis": {"summary": " '), "source", F.lit(' ", "unsafe_mechanism": 7}, "patch_intent_analysis": {"summary": "i", "behavior_changes": [" b ", "", "'), "lang", F.lit('"]}}\n```')),
        F.lit('x {"root_cause_analysis": {}} y'), F.lit("[1]"), F.lit('{"root_cause_analysis": {}, "patch_intent_analysis": {"behavior_changes": [1]}}'), F.lit('{"root_cause_analysis": 1, "patch_intent_analysis": {}}'), F.lit("none"),
    ]
    return _docs(spark, sf).select(F.col("doc_id").alias("cve"), F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int")).alias("text"))


@query
def analysis_validate(spark: SparkSession, sf: str) -> DataFrame:
    made = verdict.analyses(_answers(spark, sf))
    root, intent = "analysis.root_cause_analysis", "analysis.patch_intent_analysis"
    return made.select("cve", "analysis_error", F.col(f"{root}.summary").alias("cause"), F.col(f"{root}.unsafe_mechanism").alias("mechanism"), F.array_join(f"{intent}.behavior_changes", "|").alias("behaviors"))


@query
def behaviour_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Items that are still to be analysed, with their analysis or its error."""
    items = _docs(spark, sf).select(F.col("doc_id").alias("cve"), "source")
    old = table(spark, sf, "labels").select(F.col("doc_id").alias("cve"), F.when(F.col("quality") == 1, "r").alias("root_cause_analysis"), F.when(F.col("toxic") == 0, "i").otherwise("").alias("patch_intent_analysis"))
    made = verdict.enriched(verdict.unfinished(items, old), verdict.analyses(_answers(spark, sf)))
    return made.select("cve", "source", F.col("analysis.root_cause_analysis.summary").alias("cause"), "behavior_analysis_error")


@query
def results_document(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as one JSON document with keys in order, and read back."""
    docs = _docs(spark, sf)
    said = docs.select(F.concat("source", F.lit('"\\é')).alias("cve"), F.col("doc_id").cast("string").alias("binary"), F.lit("present").alias("status"), F.lit("low").alias("confidence"), F.array("lang").alias("evidence"), F.concat("lang", F.lit(' "\n')).alias("reasoning"))
    path = _scratch(spark)
    sinks.write_json(sinks.results_text(said), path)
    back = readers.keyed_json(spark, path, "map<string,struct<confidence:string,evidence:array<string>,reasoning:string,status:string>>")
    rows = back.select(F.col("key").alias("cve"), F.explode("value").alias("binary", "v"))
    return rows.select("cve", "binary", "v.status", "v.confidence", F.array_join("v.evidence", "|").alias("evidence"), "v.reasoning")


@query
def results_by_cve(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as one document for each CVE, some of them once more, and read back."""
    docs = _docs(spark, sf).filter("source is not null")
    said = docs.select(F.concat("source", F.lit('"/é')).alias("cve"), F.col("doc_id").cast("string").alias("binary"), F.lit("present").alias("status"), F.lit("low").alias("confidence"), F.array("lang").alias("evidence"), F.concat("lang", F.lit(' "\n')).alias("reasoning"))
    path = _scratch(spark)
    sinks.write_results(said, path)
    sinks.write_results(said.filter("startswith(cve, 'src1')").withColumn("status", F.lit("absent")), path)
    return readers.results(spark, path).select("cve", "binary", "v.status", F.array_join("v.evidence", "|").alias("evidence"), "v.reasoning")


@query
def document_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a document: two spaces of indent, keys sorted at every depth."""
    rows = _docs(spark, sf).select("doc_id", F.concat(F.lit('{"z": {"b": 1, "a": [true, "'), "lang", F.lit('"]}, "é": null, "a": '), F.col("doc_id").cast("string"), F.lit("}")).alias("json"))
    return rows.select("doc_id", F.concat(jsons.pretty(F.col("json"), True), F.lit("\n")).alias("text"))


@query
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written to text files and read back whole, by a pattern of names."""
    path = _scratch(spark)
    sinks.write_text(_docs(spark, sf).select(F.concat("lang", F.lit(" "), "source").alias("value")), path, "value")
    lines = linescan.lines_of(readers.texts(spark, path, "part-*.txt"), "text", "path")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query
def metrics_document(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of all verdicts as a document, written and read back; nothing is written without ground truth."""
    from quillon.plans.queries import simulated

    rows = simulated(spark, sf)
    said, expected, known = rows.select("cve", "binary", "predicted"), rows.filter("expected is not null").select("cve", "binary", "expected"), rows.filter("known").select("cve")
    path = _scratch(spark)
    none, done = sinks.write_metrics(said, None, None, path), sinks.write_metrics(said, expected, known, path)
    v = F.parse_json(F.concat_ws("\n", F.sort_array(F.collect_list("value"))))
    whole = spark.read.text(path, wholetext=True).agg(v.alias("v"))
    get = lambda p, t="bigint": F.try_variant_get("v", p, t)
    counts = [get(f"$.counts.{c}").alias(c) for c in ("TP", "TN", "FP", "FN", "TC", "not_affected_FN")]
    return whole.select(*counts, F.round(get("$.metrics.A", "double"), 6).alias("A"), F.round(get("$.metrics.DSR", "double"), 6).alias("DSR"), F.size(get("$.mismatches", "array<variant>")).cast("long").alias("mismatches"), F.lit(done and not none).alias("written"))


@query
def answer_schema(spark: SparkSession, sf: str) -> DataFrame:
    """What each status of the verdicts would be under the schema that a judge is given."""
    offered = sinks.result_schema()["properties"]["results"]["items"]["properties"]["status"]["enum"]
    said = F.element_at(F.array(*map(F.lit, schemas.STATUSES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).select(said.alias("status")).groupBy("status").agg(F.count("*").alias("n")).withColumn("offered", F.col("status").isin(*offered))


# -- traces


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    """Trace lines, one run for each user: views start a command, purchases end it, sign-ups start a turn, clicks end it; errors are noise."""
    kind = F.col("event_type")
    item = lambda what, more: F.concat(F.lit(f'{{"type":"item.{what}","item":{{"id":"c'), F.col("event_id") % 2, F.lit('","type":"command_execution","command":"a|b '), "event_id", F.lit('"'), more, F.lit("}}"))
    ended = F.concat(F.lit(',"exit_code":'), F.when(F.col("event_id") % 5 == 0, "null").otherwise((F.col("event_id") % 3).cast("string")), F.lit(',"aggregated_output":"é'), F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int")), F.lit('"'))
    used = F.concat(F.lit('{"type":"turn.completed","usage":{"input_tokens":'), "event_id", F.lit(',"cached_input_tokens":2}}'))
    line = F.when(kind == "view", item("started", F.lit(""))).when(kind == "purchase", item("completed", ended)).when(kind == "signup", '{"type":"turn.started"}').when(kind == "click", used).otherwise('{"type":')
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, "stderr").otherwise("stdout").alias("stream"), F.col("event_id").cast("double").alias("time"), line.alias("line"))


@query
def trace_commands(spark: SparkSession, sf: str) -> DataFrame:
    rows = trace.commands(trace.parsed(_trace(spark, sf)))
    return rows.select("run_id", "id", "command", "started_at", "completed_at", "elapsed", F.col("exit_code").cast("long").alias("exit_code"), "output_bytes", F.col("rank").cast("long").alias("rank"))


@query
def trace_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = trace.turns(trace.parsed(_trace(spark, sf)))
    return rows.select("run_id", "started_at", "completed_at", "elapsed", "usage.input_tokens", "usage.cached_input_tokens", "usage.output_tokens")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.min("event_id").cast("double").alias("started_at"), F.count("*").cast("double").alias("elapsed"))
    return rows.union(spark.sql("SELECT 'none', 0D, 1.5D")).select("run_id", F.concat(F.lit("CVE-"), "run_id").alias("cve"), "started_at", "elapsed", F.when(F.col("run_id") != "none", 0).alias("returncode"), F.array(F.lit("run"), "run_id").alias("command"))


@query
def timing_report(spark: SparkSession, sf: str) -> DataFrame:
    events = trace.parsed(_trace(spark, sf))
    return trace.timing_markdown(_runs(spark, sf), trace.commands(events), trace.turns(events))


@query
def timing_documents(spark: SparkSession, sf: str) -> DataFrame:
    events = trace.parsed(_trace(spark, sf))
    v = F.parse_json("json")
    rows = trace.timing_document(_runs(spark, sf), trace.commands(events), trace.turns(events)).withColumn("v", v)
    get = lambda p, t: F.try_variant_get("v", p, t)
    return rows.select(
        "run_id", get("$.cve", "string").alias("cve"), get("$.started_at_epoch", "double").alias("started"), get("$.command[1]", "string").alias("second"), F.size(get("$.turns", "array<variant>")).cast("long").alias("turns"),
        F.size(get("$.command_executions", "array<variant>")).cast("long").alias("commands"), get("$.command_executions[0].elapsed_seconds", "double").alias("longest"), get("$.command_executions[0].command", "string").alias("command"),
        get("$.turns[0].usage.input_tokens", "bigint").alias("first_tokens"), F.contains("json", F.lit('"returncode":null')).alias("no_code"),
    )


@query
def comparable_tokens(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").groupBy(F.concat(F.lit("run"), "user_id").alias("config")).agg(F.sum("event_id").alias("input_tokens"), F.sum(F.col("event_id") % 50).alias("cached_tokens"), F.count("*").alias("output_tokens"), F.count_if(F.col("event_type") == "view").alias("reasoning_tokens"))
    base = table(spark, sf, "events").agg(F.concat(F.lit("run"), F.min("user_id")).alias("config"))
    return trace.comparable_tokens(runs, base).select("config", F.col("comparable").cast("long").alias("comparable"), F.round("change_percent", 6).alias("change_percent"))


@query
def stream_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs found by the stateful operator over a stream of the events' file, one batch for all of it."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    phase = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete")
    rows = source.select(F.col("user_id").cast("string").alias("run_id"), F.lit("x").alias("id"), F.col("event_id").alias("seq"), F.col("event_id").alias("time"), phase.alias("phase")).filter("phase is not null")
    out, state = _scratch(spark), _scratch(spark)
    running = pairing.paired_stream(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(pairing.OUTPUT).parquet(out).select(F.col("run_id").cast("long").alias("user_id"), "started_at", "completed_at", "paired")


# -- line streams


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Events as symbols: a binary for each user, addresses by event."""
    return table(spark, sf, "events").select(F.col("user_id").alias("binary"), F.col("event_id").alias("addr"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"))


@query
def symbol_table_lines(spark: SparkSession, sf: str) -> DataFrame:
    address = F.lpad(F.lower(F.hex("event_id")), 16, "0")
    kind = F.element_at(F.array(*map(F.lit, ("T", "t", "W", "U", "D", "w"))), (F.col("event_id") % 6 + 1).cast("int"))
    line = F.when(kind == "U", F.concat(F.lit(" " * 17 + "U "), "event_type")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("zz "), kind, F.lit(" "), "event_type")).otherwise(F.concat(F.lit("  "), address, F.lit(" "), kind, F.lit("  "), "event_type", F.lit("(int, char) ")))
    return linescan.parse_symbols(table(spark, sf, "events").select(F.col("event_id").alias("line_no"), line.alias("line"))).select("addr", "kind", "name", "seq")


@query
def debug_sections(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("  ["), F.col("event_id") % 40, F.lit("] "), F.when(F.col("event_id") % 97 == 5, ".debug_line").otherwise(".text"), F.lit(" PROGBITS"))
    return linescan.has_debug_lines(table(spark, sf, "events").select("user_id", line.alias("line")), "user_id")


@query
def address_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a half-open range of addresses, around the tenth part of each user's id."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("addr"))
    low, high = linescan.address_window(F.col("user_id") * 50, F.lit(1001))
    return linescan.in_range(rows, low, high)


@query
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Where named symbols reach; a binary without the name gives an error that names its first symbols."""
    asked = _symbols(spark, sf).groupBy("binary").agg(F.count("*").alias("n")).select(F.col("binary").alias("id"), "binary", F.element_at(F.array(F.lit("error"), F.lit("view"), F.lit("gone")), (F.col("n") % 3 + 1).cast("int")).alias("symbol"), F.lit(None).cast("long").alias("addr"), F.lit(16).cast("long").alias("window"))
    return linescan.located(asked, _symbols(spark, sf)).select("binary", F.when(F.col("error").isNull(), F.col("start")).alias("start"), F.when(F.col("error").isNull(), F.col("stop")).alias("stop"), "error")


@query
def bounded_view(spark: SparkSession, sf: str) -> DataFrame:
    """Views of binaries (users) whose disassembly is their events: by symbol, by address, by pattern, and by both."""
    lines = table(spark, sf, "events").select(F.col("user_id").alias("binary"), F.col("event_id").alias("addr"), F.col("event_id").alias("line_no"), F.concat(F.hex("event_id"), F.lit(": "), "event_type").alias("line"))
    k = F.col("id") % 4
    asked = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("top")).select(F.col("user_id").alias("id"), F.col("user_id").alias("binary"), "top")
    asked = asked.select(
        "id", "binary", F.when(k == 0, F.lit("error")).alias("symbol"), F.when(k.isin(1, 2), F.col("top")).alias("addr"), F.when(k.isin(2, 3), F.lit("view|sign")).alias("pattern"), F.when(k != 3, F.lit(900)).cast("long").alias("window"),
        F.lit(0).cast("long").alias("context"), F.when(F.col("id") % 5 == 0, 70000).otherwise(1).cast("long").alias("max_output"), (F.col("id") % 2 == 0).alias("line_numbers"),
    )
    bounds = {"default_window": 384, "max_window": 500, "default_context": 4, "max_context": 16, "default_max_output_bytes": 256, "min_max_output_bytes": 64, "max_output_bytes": 300}
    path = _scratch(spark)
    sinks.write_json(spark.range(1).select(F.to_json(F.struct(F.struct(*(F.lit(n).alias(k) for k, n in bounds.items())).alias("view"))).alias("json")), path)
    config = readers.view_config(spark, path, "view")
    debug = table(spark, sf, "events").groupBy(F.col("user_id").alias("binary")).agg((F.max("event_id") % 3 == 0).alias("has_debug_line"))
    return linescan.view(asked, config, _symbols(spark, sf), lines, debug)


# -- diffs


@query
def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.concat(F.lit("x\ndiff --git a/"), "lang", F.lit(".c b/"), "source", F.lit(".c\n+diff --git a/n b/n\ndiff --git a/d /dev/null\ndiff --git a/q b/"), "lang", F.lit(" two.c\ndiff --git a/r b/"), "source", F.lit(".c"))
    return diff.files(_docs(spark, sf).select("doc_id", heads.alias("text")), "doc_id").select("doc_id", "path", F.col("ord").cast("long").alias("ord"))


@query
def diff_file_match(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.md5(F.col("doc_id").cast("string"))
    cve = F.concat(F.lit("CVE-2014-"), "doc_id")
    cves = _docs(spark, sf).select(cve.alias("cve"), F.when(F.col("doc_id") % 3 > 0, F.upper(sha)).otherwise("").alias("commit"))
    named = lambda tail: F.concat(F.lit("d/"), F.when(F.col("doc_id") % 4 == 3, "other_").otherwise("curl_"), cve, F.lit("_"), tail)
    one = _docs(spark, sf).select(named(F.concat(F.substring(sha, 1, 7), F.lit(".diff"))).alias("path"))
    two = _docs(spark, sf).filter("doc_id % 2 = 1").select(named(F.concat(F.lit("0"), F.substring(sha, 1, 10), F.lit(".diff"))).alias("path"))
    return attribution.match_diff_files(cves, one.union(two), "curl")


@query
def diff_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(F.col("source").alias("cve"), F.when(F.col("source") != "src3", "abc").otherwise("").alias("commit"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("x/"), F.when(F.col("doc_id") % 7 == 5, "abc-").otherwise(""), "doc_id")).alias("file"), (F.col("doc_id") % 3 == 1).alias("exists"))
    return attribution.pick_candidate(rows)


@query
def hunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_linenumber") * 10
    header = F.concat(F.lit("@@ -1,9 +"), start, F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit(","), (F.col("l_quantity").cast("int") % 12).cast("string"))).otherwise(""), F.lit(" @@ a - +b"))
    lines = table(spark, sf, "lineitem")
    hunks = lines.select(F.col("l_orderkey").alias("cve"), header.alias("header"), F.col("l_linenumber").alias("n"))
    functions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cve"), F.lit("f").alias("function"), (F.col("o_custkey") % 70).alias("start_line"), (F.col("o_custkey") % 70 + 8).alias("end_line"))
    return diff.overlapping(hunks, functions, "cve").select("cve", "function", "header", F.col("n").cast("long").alias("n"))


@query
def decl_closure(spark: SparkSession, sf: str) -> DataFrame:
    fn = (F.col("l_orderkey") % 60).alias("fn")
    edges = table(spark, sf, "lineitem").select(fn, F.concat(F.lit("v"), F.col("l_partkey") % 400).alias("var"), F.concat(F.lit("v"), F.col("l_suppkey") * 7 % 400).alias("dep")).distinct()
    needed = edges.select("fn", F.concat(F.lit("v"), F.col("fn")).alias("var")).distinct()
    return intervals.closure(needed, edges)


# -- macros, names, events


@query
def macro_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of macros for each document, a cycle, one glued to its parenthesis, and one in hexadecimal."""
    k = F.col("doc_id") % 6 + 1
    chain = F.array_join(F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.concat(F.lit("#define A"), i, F.lit(" ( A"), i + 1, F.lit(" + "), F.col("doc_id") % 9, F.lit(" )"))), "\n")
    said = F.concat(chain, F.lit("\n#define A"), k, F.lit(" 0x10\n  #define B (A0+1)\n#define T U\n#define U T\n#define H\n#define F(a, b) x\n#define G(x) y\n#define S 7 / 2\n#define L 1 << 5000\n#define M 1 << 3"))
    return macros.resolved(macros.definitions(_docs(spark, sf).select(F.col("doc_id").cast("string").alias("file"), said.alias("text")), "file"), "file")


def _fn() -> Column:
    return F.col("l_orderkey").cast("string").alias("fn")


@query
def identifier_classify(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    name = F.concat(F.lit("n"), F.col("l_partkey") % 6).alias("name")
    names = lines.select(_fn(), F.col("l_linenumber").alias("line"), name)
    apis = lines.filter("l_suppkey % 3 = 0").select(_fn(), F.col("l_linenumber").alias("line"), name)
    named = lines.filter("l_partkey % 6 = 2").select(_fn(), name)
    own = lines.filter("l_partkey % 6 in (2, 3, 4) and l_suppkey % 2 = 0").select(_fn(), name)
    kinds = dataflow.classified(names, apis, named, own)
    variables = dataflow.line_variables(kinds).withColumn("variable", F.lit(True))
    return kinds.join(variables, ["fn", "line", "name"], "left").select("fn", F.col("line").cast("long").alias("line"), "name", "kind", F.coalesce("variable", F.lit(False)).alias("variable"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as def/use events of variables v0 to v4."""
    op = F.element_at(F.array(*map(F.lit, ("def", "param_def", "def_decl", "use_call", "use", "def"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    rhs = F.when((op == "def") & (F.col("l_partkey") % 4 > 0), F.array(F.concat(F.lit("v"), F.col("l_suppkey") % 5), F.concat(F.lit("K"), F.col("l_partkey") % 3)))
    return table(spark, sf, "lineitem").select(_fn(), F.concat(F.lit("v"), F.col("l_partkey") % 5).alias("var"), F.col("l_linenumber").alias("line"), op.alias("op"), rhs.alias("rhs_vars"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("s"), F.col("l_partkey") % 5).alias("stmt_code"))


@query
def source_sink_edges(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    sink = events.filter("var in ('v1', 'v3')").select("fn", "var").distinct()
    symbols = events.select("fn", F.explode(F.expr("array(struct('v0' as name, 'param' as role), struct('v1' as name, 'local' as role), struct('v1' as name, 'param' as role), struct('K1' as name, 'macro' as role), struct('v2' as name, 'local' as role))")).alias("x")).select("fn", "x.name", "x.role").distinct()
    return dataflow.edges(events, sink, symbols).select("fn", "source", "to", F.col("line").cast("long").alias("line"), "kind")


@query
def sink_variables(spark: SparkSession, sf: str) -> DataFrame:
    """By names on removed lines, else by removed lines, else by removed text, whichever a function has first."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("fn"), (F.col("o_custkey") % 3).alias("k"), F.col("o_custkey"))
    names = orders.select("fn", F.when(F.col("k") == 0, F.concat(F.lit("v"), F.col("o_custkey") % 5)).otherwise("other").alias("name"))
    old = orders.select("fn", F.when(F.col("k") == 1, F.col("o_custkey") % 7 + 1).otherwise(99).cast("int").alias("ln"), F.concat(F.lit("a  s"), F.col("o_custkey") % 5, F.lit("\tz")).alias("content"))
    return dataflow.sinks(names, old, _events(spark, sf))


@query
def defuse_group(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    tracked = events.select("fn").distinct().select("fn", F.explode(F.array(*map(F.lit, ("v0", "v1", "none")))).alias("var"))
    rows = dataflow.by_variable(tracked, dataflow.of_variables(events, tracked))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("fn", "var", joined("defs"), joined("uses"), joined("all_events"))


# -- models


@query
def provider_settings(spark: SparkSession, sf: str) -> DataFrame:
    made = models.provider_overrides(F.col("source"), F.concat(F.lit("http://"), "lang", F.lit("/v1")), F.lit("chat"), F.concat(F.lit("K"), "doc_id"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 == 0)
    hosts = models.without_proxy(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("a, "), "lang", F.lit(",a"))), F.lit("localhost"), F.col("lang"), F.lit("localhost"), F.lit(""))
    return _docs(spark, sf).select("doc_id", F.array_join(made, "|").alias("settings"), hosts.alias("no_proxy"))


@query
def model_profiles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 11
    raw = _docs(spark, sf).select(
        F.concat("source", F.lit("."), "doc_id").alias("name"), F.when(k == 0, "").when(k == 1, "codex").otherwise("x").alias("provider"), F.lit("u").alias("base_url"), F.when(k == 2, "").otherwise("w").alias("wire_api"), F.lit("m").alias("model"),
        F.when(k == 3, None).when(k == 4, F.array(F.lit("K"), F.lit(""))).when(k == 5, None).otherwise(F.array(F.col("lang"), F.lit("L"))).alias("api_key_envs"), (k == 5).alias("requires_auth"),
        F.when(k == 6, "on").when(k == 7, "maybe").when(k == 8, "on").otherwise(F.lit(None)).alias("mode"), F.when(k == 8, "high").when(k == 9, "huge").otherwise(F.lit(None)).alias("effort"), F.when(k == 10, "").when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("provider_name"),
    )
    rows = models.profiles(raw)
    return rows.select("name", "base_url", "api_key_env", "provider_name", "problem", models.reasoning_effort(F.when(F.length("name") % 2 == 0, "low").otherwise(""), F.col("mode"), F.col("effort")).alias("effort"))


@query
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    known = _docs(spark, sf).select(F.concat(F.lit("p"), "source").alias("name")).distinct()
    aliases = spark.sql("SELECT * FROM VALUES ('fast', 'psrc1'), ('old', 'gone'), ('older', 'away') AS t(alias, target)")
    k = F.col("doc_id") % 5
    asked = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.when(k == 0, "fast").when(k == 1, "none").when(k == 2, "old").when(k == 3, "").alias("provider"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("x"))).alias("profile"))
    return models.resolved(asked, aliases, known, "psrc2")


@query
def dangling_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of aliases that are no profile, from a configuration written as a document and read by its schema."""
    aliases = F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.concat(F.lit("a"), "source").alias("k"), F.concat(F.lit("p"), F.length("source")).alias("v")))))
    config = _docs(spark, sf).agg(F.to_json(F.struct(F.lit("p4").alias("active_profile"), aliases.alias("aliases"), F.create_map(F.lit("p4"), F.struct(F.lit("codex").alias("provider"))).alias("profiles"))).alias("json"))
    path = _scratch(spark)
    sinks.write_json(config, path)
    read = readers.model_config(spark, path, strict=False)
    known = readers.profile_rows(read).select("name")
    return models.dangling_aliases(read.select(F.explode("aliases").alias("alias", "target")), known).crossJoin(F.broadcast(read.agg(F.first("active_profile").alias("active"))))


@query
def profile_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles, one of each source, from a configuration written as a document and loaded strictly."""
    n = F.substring("source", 4, 9).cast("int")
    key = F.when(n % 3 == 0, F.concat(F.lit(', "api_key_env": "K'), n, F.lit('"'))).when(n % 3 == 1, ', "api_key_env": ["L", "M"]').otherwise("")
    said = F.concat(
        F.lit('{"provider": "'), F.when(n % 5 == 0, "codex").otherwise("x"), F.lit('", "base_url": "u", "wire_api": "w", "model": "m"'), key, F.when(n % 2 == 0, ', "requires_openai_auth": true').otherwise(""),
        F.when(n % 4 == 0, ', "reasoning": {"mode": "on", "effort": "high"}').otherwise(""), F.when(n % 7 == 0, ', "codex_provider_name": "own"').otherwise(""), F.lit("}"),
    )
    sources = _docs(spark, sf).select("source").distinct()
    profiles = sinks.object_text(sources, "source", said)
    path = _scratch(spark)
    sinks.write_json(profiles.select(F.concat(F.lit('{"active_profile": "src0", "aliases": {"one": "src1"}, "profiles": '), "json", F.lit("}")).alias("json")), path)
    rows = models.profiles(readers.profile_rows(readers.model_config(spark, path)))
    return rows.select("name", "base_url", "api_key_env", "requires_auth", "mode", "effort", "provider_name", "problem")


# -- roll-ups


@query
def build_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.build_statistics(*_build(spark, sf))


@query
def build_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.build_histograms(_build(spark, sf)[2])


def _build(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, labels = _docs(spark, sf), table(spark, sf, "labels")
    cves = docs.filter("lang <> 'fr'").join(labels.select("doc_id", F.lit(True).alias("has")), "doc_id", "left").select(F.col("doc_id").alias("cve"), F.col("has").isNull().alias("no_info"), F.when(F.col("doc_id") % 3 > 0, "p").alias("path"))
    functions = docs.filter("lang <> 'fr'").select(F.col("doc_id").alias("cve"), F.col("source").alias("function"), F.when(F.col("doc_id") % 5 > 0, "f.c").otherwise("").alias("file"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise("").alias("change_type"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("m"), F.col("doc_id") % 3)).alias("inferred_by"))
    return docs, cves, functions


@query
def analysis_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(F.col("source").alias("cve"), F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 5 > 0, "ok").alias("status"))
    counts = rollup.analysis_statistics(rows)
    one = rollup.source_statistics(rows, table(spark, sf, "labels"))
    return counts.union(one.select(F.explode(F.expr("array(struct('cves' as k, cve_count as n), struct('functions' as k, function_count as n), struct('compact' as k, compact_cve_count as n))")).alias("x")).select("x.k", "x.n"))


@query
def statistics_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of recorded statistics; a document that is no object has none."""
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 4 == 1, "7").when(F.col("event_id") % 4 == 2, F.expr("left(props, 3)")).otherwise(F.col("props"))
    return rollup.object_fields(table(spark, sf, "events").select("event_id", said.alias("text")), "event_id")


@query
def pipeline_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a run for each language."""
    docs = _docs(spark, sf)
    runs = docs.select(F.col("lang").alias("project")).distinct().select("project", F.concat(F.lit("/o/"), "project").alias("output_dir"), F.when(F.col("project") != "fr", F.concat(F.lit("/r/"), "project")).alias("repo_path"))
    files = runs.select("project", F.posexplode(F.array(F.lit("initial"), F.lit("report"))).alias("ord", "label")).select("project", "ord", "label", F.concat(F.lit("/o/"), "label").alias("path"), (F.col("project") == "en").alias("exists"))
    steps = runs.select("project", F.posexplode(F.array(F.lit("build"), F.lit("analyse"))).alias("ord", "name"))
    ran = F.col("ord") == 0
    steps = steps.select("project", "ord", "name", F.when(ran, "ok").otherwise("skipped").alias("status"), F.when(ran, 0).alias("returncode"), F.when(ran, 1.239).otherwise(0.0).alias("seconds"), F.when(ran, "/l").alias("log"), F.when(~ran, "no repository").alias("note"), F.when(ran, F.array(F.lit("run"), F.lit("a b"))).otherwise(F.array().cast("array<string>")).alias("command"))
    initial = docs.groupBy(F.col("lang").alias("project")).agg(F.count("*").alias("selected_cves"), F.count_if(F.col("doc_id") % 3 == 0).alias("change_type.added"), F.count_if(F.col("doc_id") % 3 > 0).alias("change_type.modified"))
    counted = initial.unpivot("project", [F.col("selected_cves"), F.col("`change_type.added`"), F.col("`change_type.modified`")], "key", "n").select("project", F.lit("initial").alias("section"), "key", "n")
    behaviour = docs.groupBy(F.col("lang").alias("project")).agg(F.count("*").alias("n")).filter("project <> 'de'").select("project", F.lit("behaviour").alias("section"), F.lit("cve_count").alias("key"), "n")
    return rollup.report(runs, files, steps, counted.union(behaviour), ("one", "two"))


@query
def prompt_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(F.concat(F.lit("C-"), "doc_id").alias("cve"), F.concat(F.lit('{"a": {"b": [1, "'), "lang", F.lit('é"]}}')).alias("metadata"), F.array("source").alias("binaries"), "source", "lang")
    made = jsons.prompt_payload(F.col("cve"), F.col("metadata"), F.col("binaries"), F.create_map(F.col("source"), F.concat("source", F.lit("-gcc-O0"))), F.lit("/t"), F.lit("gcc"), F.lit("O0"))
    return rows.select("cve", made.alias("payload"))


# -- whole-function analysis


def _project(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A C function for each document, its text before and after a patch, and the diff.

    With n = doc_id % 4 + 2 assignments, the patch changes number c = doc_id % n + 1. Of ten
    documents one has its changes outside the function (3), one no file (4), no repository (5), no
    diff (6), no text before the patch (7), another name (8), no text after it (9).
    """
    docs = _docs(spark, sf).select("doc_id", (F.col("doc_id") % 4 + 2).cast("int").alias("n"), F.pmod("doc_id", F.lit(10)).alias("k")).withColumn("c", (F.col("doc_id") % F.col("n") + 1).cast("int"))
    each = F.sequence(F.lit(1), F.col("n"))
    own = lambda i, old: F.concat(F.lit("  v"), i, F.lit(" = v"), i - 1, F.when(old & (i == F.col("c")), "").otherwise(F.concat(F.lit(" + K"), i)), F.lit(";\n"))

    def source(old: bool) -> Column:
        return F.concat(
            F.lit("#define K"), "c", F.lit(" (2 + "), F.col("doc_id") % 7, F.lit(")\nint f"), "doc_id", F.lit("(int v0, char *p)\n{\n  int "), F.array_join(F.transform(each, lambda i: F.concat(F.lit("v"), i)), ", "), F.lit(";\n"),
            F.array_join(F.transform(each, lambda i: own(i, F.lit(old))), ""), F.lit("  if (v"), "n", F.lit(" > LIMIT)\n    send(p, v"), "n", F.lit(");\n  return v"), "n", F.lit(";\n}\n"),
        )

    fn = F.col("doc_id").cast("string").alias("fn")
    functions = docs.select(fn, F.when(F.col("k") == 8, "gone").otherwise(F.concat(F.lit("f"), "doc_id")).alias("function"), F.when(F.col("k") == 5, "").otherwise("r").alias("repo"), F.concat(F.lit("c"), "doc_id").alias("commit"), F.when(F.col("k") == 4, "").otherwise("src/s.c").alias("file"))
    post = docs.filter("k <> 9").select(F.lit("r").alias("repo"), F.concat(F.lit("c"), "doc_id").alias("rev"), F.lit("src/s.c").alias("path"), source(False).alias("text"))
    pre = docs.filter("k <> 7").select(F.lit("r").alias("repo"), F.concat(F.lit("c"), "doc_id", F.lit("^")).alias("rev"), F.lit("src/s.c").alias("path"), source(True).alias("text"))
    at = (F.col("c") + 4).cast("string")
    hunk = F.concat(F.lit("@@ -"), at, F.lit(",1 +"), at, F.lit(",1 @@ int f\n-"), own(F.col("c"), F.lit(True)), F.lit("+"), own(F.col("c"), F.lit(False)))
    far = F.lit("@@ -900,1 +900,1 @@\n-x;\n+y;\n")
    text_ = F.concat(F.lit("diff --git a/src/s.c b/src/s.c\n--- a/src/s.c\n+++ b/src/s.c\n"), F.when(F.col("k") != 3, hunk).otherwise(""), far)
    return functions, post.union(pre), docs.filter("k <> 6").select(fn, text_.alias("text"))


_ANALYSED: dict[tuple[str, str, int], analysis.Analysis] = {}


def _analysed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One table of the analysis, which a session does once for all queries that read it, and again when its input has changed."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    changed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()
    key = (spark.sparkContext.applicationId, sf, changed)
    if key not in _ANALYSED:
        _ANALYSED[key] = analysis.analysed(*_project(spark, sf))
    return _ANALYSED[key][name]


@query
def analysis_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = _analysed(spark, sf, "status")
    return rows.select("fn", "status", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query
def analysis_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "entities").select("fn", F.col("line").cast("long").alias("line"), "name", "kind", "resolved_value")


@query
def def_use_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _analysed(spark, sf, "events")
    return rows.select("fn", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "var", "op", "node_type", F.array_join("rhs_vars", ",").alias("rhs"), "callee")


@query
def analysis_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "edges").select("fn", "source", "to", F.col("line").cast("long").alias("line"), "kind")


@query
def analysis_flow(spark: SparkSession, sf: str) -> DataFrame:
    rows = _analysed(spark, sf, "flow")
    return rows.select("fn", F.array_join("sink_vars", ",").alias("sink_vars"), F.array_join("sources", ",").alias("sources"), "text")


@query
def analysis_hunks(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "hunks").select("fn", "header", F.array_join("old_lines", "|").alias("old_lines"), F.array_join("new_lines", "|").alias("new_lines"))


@query
def reduced_code(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "code")
