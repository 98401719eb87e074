"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, and empty tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm import forest, maxent, mixing, multiset, pieces, quality, queries, secrets, simhash, toxicity
from tests.llm.conftest import LONG, rows
from tests.llm.test_exact import _simhash

N = len(rows())


@pytest.fixture(scope="module")
def models(documents, labels):
    return quality.fit(documents, labels), toxicity.fit(documents, labels)


OPERATORS = {
    "pieces": pieces.encoded, "maxent": maxent.scores, "mixing": mixing.plan, "secrets": lambda d: secrets.secrets(d)[0], "multiset": multiset.edits, "fingerprints": multiset.fingerprints, "simhash": simhash.classes,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, empty, name):
    assert OPERATORS[name](odd).count() == N
    assert OPERATORS[name](empty).count() == 0


def test_classifiers(odd, empty, models):
    for m, (model, scores) in zip((quality, toxicity), ((models[0], quality.scores), (models[1], toxicity.scores))):
        got = scores(odd, model).collect()
        assert len(got) == N and all(0 <= r.score <= 1 and r.predicted == int(r.score >= m.THRESHOLD) for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
        assert scores(empty, model).count() == 0


def test_classifiers_without_labels(odd, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.scores(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.scores(odd, toxicity.fit(odd, none)).collect()} == {0.5}


def test_stages_keep_columns(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_near_duplicates_keep_one(odd):
    got = simhash.keep_one(odd).collect()
    same = [r.doc_id for r in got if (r.text or "").lower() == "one two three four"]
    assert same == [35]
    assert [r.doc_id for r in got if (r.text or "").strip() == ""] == [0]
    assert len([r for r in got if r.doc_id == 3]) == 1


def test_very_long_texts(odd):
    """What they get is what plain versions give, not only a row."""
    words = LONG.encode().lower().split()
    assert {r.fp % 2**64 for r in simhash.classes(odd).filter("id = 56").collect()} == {_simhash(LONG)}
    got = {r.id: r for r in multiset.edits(odd).filter("id = 56").collect()}
    assert got[56].n_chars == len(LONG) and got[56].fingerprint == multiset.fingerprint(LONG)
    counts, ends = Counter(), 0
    for r in rows():
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update((r[1] or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
    scored = maxent.scores(odd).filter("doc_id = 56").first()
    assert scored.base_score == pytest.approx(want, rel=1e-9) and scored.n_tokens == len(words) + 1 and scored.train_tokens == n
    f = quality.Features(b"some good words " * 50, b"%%% $$$ " * 90)
    assert f(LONG)[0] == pytest.approx(f(LONG[: 256 * 100])[0], abs=0.01)  # the same words all along
    net = toxicity.Network(5)
    assert toxicity.features(net, [LONG]) == pytest.approx(toxicity.features(net, [LONG], block=50), abs=1e-4)


def test_vectors(spark):
    v = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in v], "vec_id long, embedding array<double>, v string, id double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in forest.search(df).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 1.0)]
    # one vector of another length does not decide which take part, whatever its id
    odd = spark.createDataFrame([(-5, [1.0, 2.0, 3.0]), (0, [1.0, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in forest.search(odd).collect()] == [(0, 1, 1, 1.0)]
    assert forest.search(df.limit(0)).count() == 0


def test_every_query_gives_whole_tables(spark, sf_dir, documents):
    n = documents.count()
    for name in ("op1_toxicity", "op2_mixing", "op3_sentencepiece", "op4_lm_scoring", "op6_secrets", "op7_fingerprints", "op8_quality", "op10_simhash"):
        got = queries.queries()[name](spark, sf_dir)
        assert got.select("doc_id").distinct().count() == n == got.count(), name
