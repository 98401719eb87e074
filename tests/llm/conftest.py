from __future__ import annotations

import pytest

#: Columns that clash with names that operators use inside.
EXTRA = "id string, fp string, blob string, spans string, h string, size string, score string, b string, w string, rank string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "word " * 30_000 + "password=abcdefgh12"


def rows():
    """Nulls in every column, empty and very long texts, ties, and repeated rows."""
    texts = [None, "", "   \n\t ", "one", "one two", "one two three four", "ONE two three four", "one two three four", LONG, "línea única\n\n\nmás ▁ x\u0000y 😀", "a b\u0085c"]
    out = [(i * 7, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [(3, "one two", None, None, None), (3, "one two", None, None, None), (None, "one two three four", "en", "s0", 18), (None, None, None, None, None), (2**60 + 1, "far away", "en", "s1", 8), (5, "idiot " * 40, "en", "", 240)]
    return [(*r, *["x"] * len(EXTRA.split(", "))) for r in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
