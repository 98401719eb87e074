"""The whole pipeline against plain versions of its stages, one after the other."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
from quillon.llm import quality, secrets
from tests.llm.test_exact import LIBRARY, _classes, _simhash, _targets


def _redacted(text):
    spans = []
    for r in secrets.RULES:
        spans += [m.span() for m in re.finditer(r.pattern, text, re.A) if len(m[r.group]) >= r.least]
    out, at = "", 0
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out, at = out + text[at:a] + "[SECRET]", b
    return out + text[at:]


def test_stages_in_order_and_whole(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(documents, labels)
    f = quality.Features(model.good, model.bad)
    docs = {r.doc_id: r for r in documents.collect()}
    good = [i for i, r in sorted(docs.items()) if model.calibrator.predict([f(r.text or "")])[0] >= quality.THRESHOLD]
    fps = {i: _simhash(docs[i].text) for i in good}
    label = _classes(set(fps.values()))
    first = {}
    for i in good:
        first.setdefault(label[fps[i]], i)
    kept = sorted(first.values())
    assert 0 < len(kept) < len(good) < len(docs)
    texts = {i: _redacted(docs[i].text) for i in kept}
    assert any(t != docs[i].text for i, t in texts.items())

    got = corpus_pipeline.run(spark, sf_dir).collect()
    drawn = Counter(r.doc_id for r in got)
    assert set(drawn) <= set(kept) and max(drawn.values()) <= 2
    for r in got:
        assert r.ids == LIBRARY.encode(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    names = sorted({docs[i].source for i in kept})
    targets = _targets([sum(size[i] for i in kept if docs[i].source == s) for s in names])
    for s, target in zip(names, targets):
        own = [i for i in kept if docs[i].source == s]
        assert abs(sum(drawn[i] * size[i] for i in own) - target) <= max(size[i] for i in own)


def test_nothing_is_left_behind(spark, sf_dir):
    """Each stage's table is deleted once the next one's is written."""
    from quillon.sources.tables import shared_dir

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = {str(s.getPath()) for s in system.listStatus(at)}
    made = corpus_pipeline.run(spark, sf_dir)
    assert made.count() > 0
    stages = [str(s.getPath()) for s in system.listStatus(at) if str(s.getPath()) not in before]
    with_text = [p for p in stages if {"text", "lang", "n_chars"} <= set(spark.read.parquet(p).columns)]
    assert not with_text
