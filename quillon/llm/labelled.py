"""Bounded samples of labelled documents, and a logistic calibrator."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_remainder, materialise

#: Bytes of text, at most, that the documents of part 'fit' bring to the driver.
FIT_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, fit_rows: int, calibration_rows: int, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(id, text, y, part) of labelled documents to learn from.

    Only rows whose crc32(doc_id) modulo `modulus` is not `held` count. Part 'fit' has up to
    fit_rows rows of each class; part 'calibrate' up to calibration_rows in their natural mix; the
    parts share no document. Rows of least id hash are taken, so a rerun takes the same. At most
    2 * fit_rows + calibration_rows ids are broadcast. Labels that are null or stand on a null id
    do not count; a document labelled twice has the lesser label. Where rows repeat a labelled id,
    that with the text of least hash counts, chosen before rows meet, so an id may stand on any
    number of rows. Whole texts of part 'fit' are taken in order of the id's hash as long as they stay
    within `fit_bytes`; one that does not is left out and the next is tried.
    """
    y = F.col(label).cast("int")
    known = labels.select("doc_id", y.alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.filter(id_remainder("doc_id", modulus) != held).withColumn("h", F.xxhash64("doc_id"))
    fit = known.filter("h % 2 = 0")
    parts = [fit.filter(F.col("y") == c).orderBy("h", "doc_id").limit(fit_rows).withColumn("part", F.lit("fit")) for c in (0, 1)]
    parts.append(known.filter("h % 2 <> 0").orderBy("h", "doc_id").limit(calibration_rows).withColumn("part", F.lit("calibrate")))
    ids = parts[0].union(parts[1]).union(parts[2]).select(F.col("doc_id").alias("id"), "y", "part")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    rows = materialise(rows.groupBy("id", "y", "part").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    told = rows.filter("part = 'fit'").select("id", F.octet_length("text").alias("n"), F.xxhash64("id").alias("h")).collect()
    left, out = fit_bytes, []
    for r in sorted(told, key=lambda r: (r.h, r.id)):
        if r.n <= left:
            left -= r.n
        else:
            out.append(r.id)
    return rows.filter(~((F.col("part") == "fit") & F.col("id").isin(out))) if out else rows


def _products(x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    return np.hstack([x, *(x[:, [i]] * x[:, [j]] for i in range(k) for j in range(i, k))])


@dataclass
class Logistic:
    """Logistic regression on features and their products, by Newton steps with an L2 penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> Logistic:
        """With one class or no rows the model is constant: the smoothed share of ones."""
        x = _products(np.asarray(x, float))
        share = (np.sum(y) + 0.5) / (len(y) + 1)
        out = cls(x.mean(0) if len(x) else np.zeros(x.shape[1]), (x.std(0) if len(x) else np.zeros(x.shape[1])) + 1e-9, np.zeros(1 + x.shape[1]))
        out.weights[0] = np.log(share / (1 - share))
        if len(np.unique(y)) < 2:
            return out
        a = out._standard(x)
        ridge = penalty * len(x) * np.eye(len(out.weights))
        ridge[0, 0] = 0
        loss = lambda w: np.logaddexp(0, np.clip(a @ w, -500, 500)).sum() - y @ (a @ w) + w @ ridge @ w / 2
        now = loss(out.weights)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ out.weights, -30, 30)))
            step = np.linalg.solve(a.T * (p * (1 - p)) @ a + ridge + 1e-6 * np.eye(len(ridge)), a.T @ (p - y) + ridge @ out.weights)
            size = 1.0
            while size > 1e-6 and (then := loss(out.weights - size * step)) > now:
                size /= 2
            if size <= 1e-6:
                break
            out.weights, gain, now = out.weights - size * step, now - then, then
            if gain < 1e-9 * (1 + abs(now)):
                break
        return out

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if not len(x):
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self._standard(_products(x)) @ self.weights, -30, 30)))
