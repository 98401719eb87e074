"""Roll-ups of functions to CVEs, statistics of stages, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import shell_quote


def compact(functions: DataFrame) -> DataFrame:
    """One record for each CVE of its functions (project, cve, ord, function, cwe, summary, message, hunks, code).

    Hunks are put end to end in the functions' order, repeats kept; the first function's record
    gives the first cwe and the message. Functions without code have no entry among the codes.
    """
    item = F.struct("ord", "function", "hunks", "code", "cwe", "summary", "message")
    rows = functions.groupBy("project", "cve").agg(F.sort_array(F.collect_list(item)).alias("f"))
    first = F.col("f")[0]
    return rows.select(
        "project", F.col("cve").alias("cve_id"), F.coalesce(F.try_element_at(first["cwe"], F.lit(1)), F.lit("")).alias("cwe"), first["summary"].alias("vulnerability_description"),
        first["message"].alias("patch_commit_message"), F.flatten(F.transform("f", lambda x: F.coalesce(x["hunks"], F.array().cast("array<string>")))).alias("patch_hunk"),
        F.filter(F.transform("f", lambda x: F.struct(x["function"].alias("function"), x["code"].alias("code"))), lambda x: F.coalesce(x["code"], F.lit("")) != "").alias("reduced_function_code"), F.transform("f", lambda x: x["function"]).alias("functions"),
    )


def analysis_statistics(functions: DataFrame) -> DataFrame:
    """(status, n) of analysed functions, and their total under `total`."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    return functions.groupBy(status.alias("status")).agg(F.count("*").alias("n")).union(functions.select(F.lit("total").alias("status"), F.lit(1).alias("n")).groupBy("status").agg(F.count("*")))


def behaviour_statistics(items: DataFrame) -> DataFrame:
    """One row: items with both analyses, and items with an error; one item may be both."""
    both = (F.coalesce("root_cause_analysis", F.lit("")) != "") & (F.coalesce("patch_intent_analysis", F.lit("")) != "")
    return items.agg(F.count_if(both).alias("analyzed"), F.count_if(F.coalesce("behavior_analysis_error", F.lit("")) != "").alias("errors"))


def source_statistics(functions: DataFrame, compact_cves: DataFrame) -> DataFrame:
    """One row of an analysis' counts: CVEs and functions of the full document, CVEs of the compact one."""
    full = functions.agg(F.count_distinct("cve").alias("cve_count"), F.count("*").alias("function_count"))
    return full.crossJoin(compact_cves.agg(F.count("*").alias("compact_cve_count")))  # one row each


def object_fields(documents: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, name, value) of statistics documents, values as JSON text; what is no JSON object has no fields."""
    v = F.try_parse_json(text)
    fields = F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.try_variant_get(v, "$", "map<string,variant>"))
    return documents.select(*keys, F.explode(fields).alias("name", "v")).select(*keys, "name", F.to_json("v").alias("value"))


#: Headings and marks of the report, and the counters that it lists.
HEADINGS = {"files": "## 产物", "inputs": "## 输入", "steps": "## 步骤", "initial": "## 初始 JSON 统计", "source": "## 源码分析统计", "behaviour": "## DeepSeek 行为分析统计", "notes": "## 说明"}
THERE, NOT_THERE = "存在", "未生成"
INITIAL = ("input_source_diff_cves", "selected_cves", "emitted_cves", "total_functions", "diff_files_found", "diff_files_missing", "cveinfo_found", "cveinfo_missing", "functions_with_file", "functions_without_file")
SECTIONS = {"initial": INITIAL, "source": ("cve_count", "function_count"), "behaviour": ("cve_count", "analyzed", "errors")}


def report(runs: DataFrame, files: DataFrame, steps: DataFrame, counters: DataFrame, notes: tuple[str, ...] = ()) -> DataFrame:
    """(project, report): the Markdown report of pipeline runs (project, output_dir, repo_path).

    `files` are (project, ord, label, path, exists), `steps` (project, ord, name, status,
    returncode, seconds, log, note, command), `counters` (project, section, key, n) with the keys of
    SECTIONS and further ones, such as `change_type.added`, which follow in order. A section without
    counters is left out; a counter that a section lacks is 0.
    """
    order = {name: k for k, name in enumerate(HEADINGS)}
    quoted = lambda label, value: F.concat(F.lit(f"- {label}: `"), value, F.lit("`"))

    def part(df: DataFrame, section: str, at: Column, line: Column) -> DataFrame:
        return df.select("project", F.lit(order[section]).alias("s"), at.alias("at"), line.alias("line"))

    there = F.when(F.col("exists") | (F.col("label") == "report"), THERE).otherwise(NOT_THERE)
    place = lambda *k: F.format_string("%010d" * len(k), *k)
    parts = [part(files, "files", place(F.col("ord")), F.concat(F.lit("- `"), "label", F.lit("`: `"), "path", F.lit("` ("), there, F.lit(")")))]
    inputs = F.concat_ws("\n", quoted("project", F.col("project")), quoted("output_dir", F.col("output_dir")), quoted("repo_path", F.coalesce("repo_path", F.lit(""))))
    parts.append(part(runs, "inputs", F.lit(""), inputs))
    plain = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    step = F.concat_ws(
        "\n", F.concat(F.lit("### "), "name"), quoted("status", F.col("status")), F.when(F.col("returncode").isNotNull(), quoted("returncode", F.col("returncode").cast("string"))),
        F.when(F.coalesce("seconds", F.lit(0.0)) != 0, quoted("seconds", F.format_string("%.2f", "seconds"))), F.when(plain("log"), quoted("log", F.col("log"))),
        F.when(plain("note"), F.concat(F.lit("- note: "), "note")), F.when(F.size("command") > 0, F.concat(F.lit("\n```bash\n"), F.array_join(F.transform("command", shell_quote), " "), F.lit("\n```"))), F.lit(""),
    )
    parts.append(part(steps, "steps", place(F.col("ord")), step))
    for section, keys in SECTIONS.items():
        mine = counters.filter(F.col("section") == section)
        given = mine.select("project").distinct().select("project", F.posexplode(F.array(*map(F.lit, keys))).alias("pos", "key"))
        fixed = given.join(mine.select("project", "key", "n"), ["project", "key"], "left").select("project", place(F.col("pos")).alias("at"), "key", F.coalesce("n", F.lit(0)).alias("n"))
        more = mine.filter(~F.col("key").isin(*keys)).select("project", F.concat(F.lit("x"), "key").alias("at"), "key", "n")
        rows = fixed.union(more)
        parts.append(part(rows, section, F.col("at"), F.concat(F.lit("- "), "key", F.lit(": `"), F.col("n").cast("string"), F.lit("`"))))
    told = parts[0]
    for p in parts[1:]:
        told = told.union(p)
    lines = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["line"]), "\n")
    sections = told.groupBy("project", "s").agg(lines(F.struct("at", "line")).alias("body"))
    heads = F.element_at(F.array(*map(F.lit, HEADINGS.values())), F.col("s") + 1)
    sections = sections.select("project", F.struct("s", F.concat(heads, F.lit("\n"), "body", F.when(F.col("s") == order["steps"], "").otherwise("\n")).alias("line")).alias("x"))
    # sections without rows still have their heading
    always = runs.select("project", F.explode(F.array(*(F.struct(F.lit(order[k]).alias("s"), F.lit(HEADINGS[k] + end).alias("line")) for k, end in (("files", "\n"), ("steps", ""))))).alias("x"))
    every = sections.union(always.join(sections.select("project", F.col("x.s").alias("k")), (always["project"] == sections["project"]) & (F.col("x.s") == F.col("k")), "left_anti"))
    body = every.groupBy("project").agg(lines("x").alias("body"))
    end = "\n".join([HEADINGS["notes"], *(f"- {n}" for n in notes)]) + "\n"
    return runs.join(body, "project").select("project", F.concat(F.lit("# "), "project", F.lit(" metadata pipeline run\n\n"), "body", F.lit("\n" + end)).alias("report"))
