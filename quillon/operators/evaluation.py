"""Verdicts against ground truth: expected status, outcome of each verdict, metrics, mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The outcomes that are counted, in the order in which reports list them.
COUNTS = (
    "TP", "TN", "FP", "FN", "not_affected_TP", "not_affected_FP", "not_affected_FN", "inconclusive", "error",
    "not_found", "not_affected", "version_not_in_groundtruth", "missing_groundtruth_cve",
)
#: The list that wins when a binary stands in several.
PRIORITY = {"present": ("patch", 0), "absent": ("vuln", 1), "not_affected": ("not_affected", 2)}


def expected_statuses(truth: DataFrame) -> DataFrame:
    """(cve, binary, expected) from ground truth (cve, vuln, patch, not_affected)."""
    def side(status: str, lst: str, rank: int) -> Column:
        names = F.coalesce(F.col(lst), F.array().cast("array<string>"))
        return F.transform(names, lambda b: F.struct(b.alias("binary"), F.lit(rank).alias("rank"), F.lit(status).alias("expected")))

    sides = [side(status, *where) for status, where in PRIORITY.items()]
    rows = truth.select("cve", F.explode(F.concat(*sides)).alias("x")).select("cve", "x.*")
    return rows.groupBy("cve", "binary").agg(F.min_by("expected", "rank").alias("expected"))


def with_expected(verdicts: DataFrame, expected: DataFrame, known_cves: DataFrame) -> DataFrame:
    """Verdicts with `expected` (null: no such binary) and `known` (whether the CVE is in ground truth)."""
    known = known_cves.select("cve").distinct().withColumn("known", F.lit(True))
    return verdicts.join(expected, ["cve", "binary"], "left").join(known, "cve", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def outcomes(expected: Column, predicted: Column, known: Column) -> dict[str, Column]:
    """Whether a verdict counts under each of COUNTS, in TC, and as a mismatch."""
    judged = known & expected.isNotNull() & (predicted != "not_found")
    na_true, na_said = expected == "not_affected", predicted == "not_affected"
    weak = predicted.isin("inconclusive", "error")
    plain = judged & ~na_true & ~na_said
    clear = plain & predicted.isin("present", "absent")
    out = {
        "TP": clear & (expected == "present") & (predicted == "present"),
        "TN": clear & (expected == "absent") & (predicted == "absent"),
        "FP": clear & (expected == "absent") & (predicted == "present"),
        "FN": clear & (expected == "present") & (predicted == "absent"),
        "not_affected_TP": judged & na_true & na_said,
        "not_affected_FP": judged & ~na_true & na_said,
        "not_affected_FN": judged & na_true & ~na_said,
        "inconclusive": judged & (predicted == "inconclusive"),
        "error": judged & ((predicted == "error") | (plain & ~weak & ~predicted.isin("present", "absent"))),
        "not_found": known & expected.isNotNull() & (predicted == "not_found"),
        "not_affected": judged & na_said,
        "version_not_in_groundtruth": known & expected.isNull(),
        "missing_groundtruth_cve": ~known,
    }
    out["mismatch"] = out["FP"] | out["FN"] | out["not_affected_FP"] | (out["not_affected_FN"] & ~weak)
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def _ratio(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.expr(top).cast("double"), F.expr(bottom).cast("double")), F.lit(0.0))


def metrics(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts and ratios over rows (expected, predicted, known), in all or by columns.

    A not_affected binary judged inconclusive or error is in TC and in not_affected_total. Ratios
    with denominator 0 are 0; an empty table gives one row of zeros if no columns are named.
    """
    said = outcomes(F.col("expected"), F.col("predicted"), F.col("known"))
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias("mismatches" if k == "mismatch" else k) for k, c in said.items()]
    counted = verdicts.groupBy(*by).agg(*sums) if by else verdicts.agg(*sums)
    counted = counted.withColumn("accuracy_denominator", F.expr("TP + TN + FP + FN"))
    counted = counted.withColumn("TC", F.expr("accuracy_denominator + inconclusive + error"))
    counted = counted.withColumn("not_affected_total", F.expr("not_affected_TP + not_affected_FN"))
    counted = counted.withColumn("not_affected_included_TC", F.expr("TC + not_affected_total"))
    counted = counted.withColumn("not_affected_included_correct", F.expr("TP + TN + not_affected_TP"))
    counted = counted.withColumn("accuracy", _ratio("TP + TN", "accuracy_denominator")).withColumn("precision", _ratio("TP", "TP + FP")).withColumn("recall", _ratio("TP", "TP + FN"))
    counted = counted.withColumn("f1", F.coalesce(F.expr("try_divide(2 * precision * recall, precision + recall)"), F.lit(0.0)))
    counted = counted.withColumn("DSR", _ratio("TP + TN", "TC"))
    counted = counted.withColumn("not_affected_included_DSR", _ratio("not_affected_included_correct", "not_affected_included_TC"))
    return counted.withColumn("not_affected_accuracy", _ratio("not_affected_TP", "not_affected_total"))


def mismatches(verdicts: DataFrame) -> DataFrame:
    """The verdicts that contradict ground truth."""
    return verdicts.filter(outcomes(F.col("expected"), F.col("predicted"), F.col("known"))["mismatch"])
