"""Hot, null and repeated ids, huge magnitudes, and a second quality scorer."""

from __future__ import annotations

import math

import numpy as np
import pytest
import zstandard

from quillon.llm import forest, labelled, mixing, quality


def test_one_labelled_id_on_many_rows(spark):
    """Every row of a hot id reaches no one: one text of each id does, within the bytes allowed."""
    rows = [(1, f"copy {i}", "x") for i in range(10_000)] + [(i, "w" * (100 * i), "x") for i in range(2, 60)] + [(None, "none", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string").repartition(6)
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1)], "doc_id long, good int")
    got = labelled.sample(docs, marks, "good", 5, 9, 100, 100).collect()
    assert sorted(r.id for r in got) == list(range(1, 60)) and {r.part for r in got} == {"fit", "calibrate"}
    few = labelled.sample(docs, marks, "good", 5, 9, 100, 100, fit_bytes=9000).collect()
    fit = [r for r in few if r.part == "fit"]
    assert 0 < sum(len(r.text) for r in fit) <= 9000 and len(fit) > 3
    assert {r.id for r in few if r.part == "calibrate"} == {r.id for r in got if r.part == "calibrate"}
    assert len(fit) < sum(r.part == "fit" for r in got)


def test_rows_without_ids_meet_their_target(spark):
    """A source of null ids, and one of a single id, are cut near their targets as others are."""
    rows = [(None, f"word{i} a b", "n") for i in range(1000)] + [(5, f"other{i} c d", "o") for i in range(1000)] + [(i + 10, "e f g", "p") for i in range(200)]
    taken, target = {}, {}
    for r in mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect():
        taken[r.source] = taken.get(r.source, 0) + r["size"] * len(r.draws)
        target[r.source] = r.target
        assert len(r.draws) <= 2
    assert all(abs(taken[s] - target[s]) <= 3 for s in taken) and len(taken) == 3
    assert any(target[s] % 3000 for s in "no")  # a cut falls inside one of them


@pytest.mark.parametrize("size", [1e200, 1.0, 1e-200])
def test_distances_of_any_magnitude(spark, size):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)) * size
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = forest.search(df, k=5, opened=1.0).collect()
    for q in (0, 100, 200):
        near = sorted((math.dist(v[q] / size, v[i] / size), i) for i in range(300) if i != q)[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in own] == [i for _, i in near]
        assert [s for _, _, s in own] == pytest.approx([d * size for d, _ in near], rel=1e-9)


def test_forests_stay_small():
    """However large the sample, a tree has twice LEAVES leaves or less, so a query's bits and the splits are bounded."""
    sample = np.random.default_rng(0).normal(size=(20_000, 4))
    tree = forest.fit_tree(sample, max(2, -(-len(sample) // forest.LEAVES)), 1)
    assert forest.LEAVES / 2 <= tree.leaves <= 2 * forest.LEAVES and tree.normals.dtype == np.float32
    leaves = forest.leaves_of(tree, sample)
    assert np.bincount(leaves).max() <= 22  # rounding moves a few


def plain_features(text, good, bad):
    """The sixteen numbers, chunk by chunk, with compressors made anew and sums written out."""
    data, out = text.encode(), []

    def packed(dictionary, chunk):
        made = zstandard.ZstdCompressionDict(dictionary)
        made.precompute_compress(level=3)
        return len(zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(chunk))

    for size in (256, 1024):
        chunks = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
        a, b = [packed(good, c) for c in chunks], [packed(bad, c) for c in chunks]
        bytes_ = [len(c) + 1e-9 for c in chunks]
        share = [n / sum(bytes_) for n in bytes_]
        full = [min(1, len(c) / size) for c in chunks] if len(chunks) > 1 else [1]
        for norm in ([x + y for x, y in zip(a, b)], [max(len(c), 32) for c in chunks]):
            each = [(y - x) / n for x, y, n in zip(a, b, norm)]
            whole = (sum(b) - sum(a)) / sum(norm)
            out += [whole, min(e * f for e, f in zip(each, full)), math.sqrt(sum(w * (e - whole) ** 2 for w, e in zip(share, each)))]
        out += [max(e * f for e, f in zip(each, full)), sum(w for w, x, y in zip(share, a, b) if y < x)]
    return out


def test_quality_equals_a_second_scorer(documents, labels):
    """All numbers of whole texts, and the score that the calibrator's own numbers give."""
    model = quality.fit(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    some = sorted(texts, key=lambda i: len(texts[i]))[:: len(texts) // 12]
    features, c = quality.Features(model.good, model.bad), model.calibrator
    got = {r.doc_id: r for r in quality.scores(documents, model).collect()}
    for i in some:
        x = plain_features(texts[i], model.good, model.bad)
        assert features(texts[i]) == pytest.approx(x, rel=1e-9, abs=1e-12)
        terms = x + [x[j] * x[k] for j in range(len(x)) for k in range(j, len(x))]
        z = c.weights[0] + sum(w * (t - m) / s for w, t, m, s in zip(c.weights[1:], terms, c.mean, c.scale))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-6)
        assert got[i].predicted == int(got[i].score >= 0.3)
