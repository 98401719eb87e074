"""Sinks: JSON documents, Markdown, results nested by CVE, metrics, and the result schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.jsons import pretty
from quillon.operators import evaluation
from quillon.sources.schemas import CONFIDENCES, JUDGED


def object_text(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(json) of a table as one JSON object, key to value (JSON text); one row, also of an empty table.

    It is one document and so one row: it holds what a reader of the document would hold.
    """
    pairs = rows.select(F.col(key).cast("string").alias("k"), value.alias("v"))
    field = F.concat(F.to_json(F.array("k")).substr(F.lit(2), F.length(F.to_json(F.array("k"))) - 2), F.lit(":"), "v")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", field.alias("f")))), lambda x: x["f"]), ",")
    return pairs.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def document(one: DataFrame, column: str = "json", sort_keys: bool = True) -> DataFrame:
    """JSON text as it is written: indented by two, keys sorted at every depth if asked, characters
    kept, a line feed at the end."""
    return one.select(F.concat(pretty(F.col(column), sort_keys), F.lit("\n")).alias(column))


def write_json(one: DataFrame, path: str, column: str = "json", sort_keys: bool = True) -> None:
    """Writes document()s; the committer makes the result appear at once, and the writer ends the last line."""
    document(one, column, sort_keys).select(F.regexp_replace(column, "\\n$", "").alias(column)).write.mode("overwrite").text(path)


def write_metrics(verdicts: DataFrame, expected: DataFrame | None, known_cves: DataFrame | None, path: str) -> bool:
    """Writes the metrics of all merged verdicts as a document; without ground truth nothing is written."""
    if expected is None or known_cves is None:
        return False
    write_json(metrics_text(evaluation.with_expected(verdicts, expected, known_cves)), path)
    return True


def metrics_text(judged: DataFrame) -> DataFrame:
    """(json) of the counts, ratios and mismatches of judged verdicts (cve, binary, expected, predicted, known)."""
    m = evaluation.metrics(judged)
    named = {"A": "accuracy", "P": "precision", "R": "recall", "F1": "f1"}
    ratios = F.struct(*(F.col(c).alias(k) for k, c in named.items()), "DSR", "not_affected_included_DSR", "not_affected_accuracy")
    counts = F.struct(*evaluation.COUNTS, "TC", "accuracy_denominator", "not_affected_total", "not_affected_included_TC", "not_affected_included_correct")
    wrong = evaluation.mismatches(judged).agg(F.sort_array(F.collect_list(F.struct("cve", "binary", "expected", "predicted"))).alias("mismatches"))
    return m.select(counts.alias("counts"), ratios.alias("metrics")).crossJoin(F.broadcast(wrong)).select(F.to_json(F.struct("counts", "metrics", "mismatches")).alias("json"))


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def results_text(verdicts: DataFrame) -> DataFrame:
    """(json) of all results as one object: CVE to binary to verdict."""
    return object_text(nested_results(verdicts), "cve", F.col("json"))


def nested_results(verdicts: DataFrame) -> DataFrame:
    """(cve, json): one document for each CVE, its binaries in order."""
    row = F.struct("binary", F.struct("confidence", "evidence", "reasoning", "status").alias("v"))
    return verdicts.groupBy("cve").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(row)))).alias("json"))


def write_results(verdicts: DataFrame, path: str) -> None:
    """Results in parts: a folder for each CVE with one document in it, its binaries in order.

    Folders of other CVEs at the path stay as they are, and no task holds more than the documents of
    its share of CVEs, one after the other. The name of a CVE is a part of its path.
    """
    rows = nested_results(verdicts).select("cve", document_text(F.col("json")).alias("json"))
    rows.repartition("cve").sortWithinPartitions("cve").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cve").text(path)


def document_text(json: Column) -> Column:
    """JSON text as document() lays it out, without the last line feed, which the writer sets."""
    return pretty(json, True)


def result_schema() -> dict:
    """JSON Schema of the answer that a judge gives."""
    text = {"type": "string"}
    row = {
        "cve": text, "binary": text, "status": {"type": "string", "enum": list(JUDGED)}, "confidence": {"type": "string", "enum": list(CONFIDENCES)},
        "evidence": {"type": "array", "items": text}, "reasoning": text,
    }
    item = {"type": "object", "additionalProperties": False, "required": list(row), "properties": row}
    return {"type": "object", "additionalProperties": False, "required": ["results"], "properties": {"results": {"type": "array", "items": item}}}


def mapping_payload(names: DataFrame, helper: str) -> DataFrame:
    """The mapping of anonymous targets as it is recorded."""
    return names.select("cve", "anonymous", "original", "actual", F.lit(helper).alias("helper"))


def step_log(steps: DataFrame) -> DataFrame:
    """Pipeline steps (name, returncode, seconds, reason) with a status: skipped, ok or failed."""
    status = F.when(F.col("returncode").isNull(), "skipped").when(F.col("returncode") == 0, "ok").otherwise("failed")
    return steps.withColumn("status", status)
