"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into
chunks, small ones and large ones, and each chunk is compressed with either dictionary. What is
read of a chunk is the difference of its two compressed sizes alone, normalised by their sum and by
the chunk's own size. The differences of the whole text and their spread over its chunks are
calibrated to a probability by logistic regression on documents that built neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_remainder
from quillon.llm.labelled import Logistic, sample

#: Bytes of the chunks that are compressed, and of those that dictionaries are built from.
WINDOWS, CHUNK = (256, 1024), 1024
LEVEL, DICTIONARY = 3, 110 * 1024
#: Bounds of the labelled sample: documents of each class whose whole texts build the dictionaries,
#: and documents for the calibration.
FIT_ROWS, CALIBRATION_ROWS = 2000, 8000
MODULUS, HELD = 5, 0
THRESHOLD = 0.3
#: Numbers that features() gives for a text.
FEATURES = 8 * len(WINDOWS)


def _chunks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, max(len(data), 1), size)]


def _dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes; for samples too few to train on, their raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary or len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, **plain)


class Features:
    """Normalised compressed-size differences of a text under a pair of dictionaries.

    A last chunk that is shorter than the others counts towards the extremes by its share of a
    chunk, towards means and spreads by its bytes.
    """

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: str) -> list[float]:
        data, out = text.encode("utf-8", "replace"), []
        for size in WINDOWS:
            parts = _chunks(data, size)
            raw = np.array([len(p) for p in parts], float)
            good = np.array([len(self.good.compress(p)) for p in parts], float)
            bad = np.array([len(self.bad.compress(p)) for p in parts], float)
            weight = (raw + 1e-9) / (raw + 1e-9).sum()
            full = np.minimum(1, raw / size) if len(parts) > 1 else np.ones(1)
            for norm in (good + bad, np.maximum(raw, 32)):
                own, whole = (bad - good) / norm, (bad - good).sum() / norm.sum()
                out += [whole, (own * full).min(), float(np.sqrt((weight * (own - whole) ** 2).sum()))]
            out += [(own * full).max(), float(weight[bad < good].sum())]
        return out


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibrator: Logistic


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from a bounded sample of the labelled documents outside the held-out fold.

    The whole texts of at most FIT_ROWS documents of each class build the dictionaries, those of
    at most CALIBRATION_ROWS others the calibration; null texts count as empty, rows that repeat a
    labelled id count once, and fitted texts stay within a budget of bytes (labelled.sample). Ids are
    integers. With no labels of both classes, or an empty table, the model is the smoothed share of good ones.
    """
    rows = sample(docs, labels, label, MODULUS, HELD, FIT_ROWS, CALIBRATION_ROWS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, y, c) for i, t, y in zip(b["id"], b["text"], b["y"]) for c in _chunks(t.encode("utf-8", "replace"), CHUNK)]
            yield pd.DataFrame(out, columns=["id", "y", "c"])

    pieces = rows.filter("part = 'fit'").mapInPandas(cut, "id long, y int, c binary").toPandas().sort_values(["id", "c"], kind="stable")
    good, bad = (_dictionary([bytes(c) for c in pieces["c"][pieces["y"] == y]]) for y in (1, 0))
    told = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features(*told.value)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [f(t) for t in b["text"]], "id": b["id"]})

    known = rows.filter("part = 'calibrate'").mapInPandas(measure, "y int, x array<double>, id long").toPandas()
    x, y = np.array(known["x"].tolist()).reshape(-1, FEATURES), known["y"].to_numpy(float)
    order = np.lexsort((*x.T, known["id"].to_numpy()))
    return Model(good, bad, Logistic.fit(x[order], y[order]))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null texts count as empty. Empty texts get the calibrated score of no content, rows with a null
    id are never held out, repeated rows get the same score. With no labels of both classes the
    score is the smoothed share of good ones. An empty table gives no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = told.value
        f = Features(m.good, m.bad)
        for t in texts:
            yield pd.Series(m.calibrator.predict(np.array([f(x or "") for x in t]).reshape(-1, FEATURES)))

    held = F.coalesce(id_remainder("doc_id", MODULUS) == HELD, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged.

    Null texts count as empty and are kept or rejected as empty ones are; rows with null ids and
    repeated rows are each judged by their text, equal texts alike. Extra columns pass through. An
    empty table gives no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = told.value
        f = Features(m.good, m.bad)
        for t in texts:
            yield pd.Series(m.calibrator.predict(np.array([f(x or "") for x in t]).reshape(-1, FEATURES)) >= threshold)

    return docs.filter(good("text"))
