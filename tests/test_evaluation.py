from __future__ import annotations

from quillon.operators import evaluation

_SCHEMA = "expected string, predicted string, known boolean"
# the truth table, one row for each kind of verdict, with its counters worked by hand
TRUTH = [
    ("present", "present", True), ("absent", "absent", True), ("absent", "present", True), ("present", "absent", True), ("not_affected", "not_affected", True), ("not_affected", "present", True), ("present", "not_affected", True),
    ("not_affected", "inconclusive", True), ("present", "error", True), ("not_affected", "not_found", True), (None, "present", True), (None, "present", False), ("present", "bogus", True),
]


def test_truth_table(spark):
    m = evaluation.metrics(spark.createDataFrame(TRUTH, _SCHEMA)).first().asDict()
    want = {"TP": 1, "TN": 1, "FP": 1, "FN": 1, "not_affected_TP": 1, "not_affected_FP": 1, "not_affected_FN": 2, "inconclusive": 1, "error": 2, "not_found": 1, "not_affected": 2, "version_not_in_groundtruth": 1, "missing_groundtruth_cve": 1, "accuracy_denominator": 4, "TC": 7, "not_affected_total": 3, "not_affected_included_TC": 10, "not_affected_included_correct": 3, "mismatches": 4}
    assert {k: m[k] for k in want} == want
    assert [m[k] for k in ("accuracy", "precision", "recall", "f1")] == [0.5] * 4
    assert abs(m["DSR"] - 2 / 7) < 1e-12 and abs(m["not_affected_included_DSR"] - 0.3) < 1e-12 and abs(m["not_affected_accuracy"] - 1 / 3) < 1e-12


def test_empty_gives_zeros(spark):
    m = evaluation.metrics(spark.createDataFrame([], _SCHEMA)).first().asDict()
    assert set(m.values()) == {0}


def test_mismatches(spark):
    got = evaluation.mismatches(spark.createDataFrame(TRUTH, _SCHEMA)).collect()
    assert sorted((r.expected, r.predicted) for r in got) == [("absent", "present"), ("not_affected", "present"), ("present", "absent"), ("present", "not_affected")]
