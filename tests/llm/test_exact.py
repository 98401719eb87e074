"""Operators against brute force, or against a round trip."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat, components, forest, mixing, multiset, pieces, queries, secrets, simhash
from tests.compare import duck, same


# -- pieces

MODEL = pieces.load(Path(pieces.MODEL).read_bytes())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
PARTS = st.lists(st.sampled_from(["the", " ", "a", "e", "\n", "é", "ﬁ", "  ", "er", "ing", "Th", "\t", "0", "😀", ".", "</s>", "<0x0A>", "中", "in", "on", "²", "“", "…", "\r", "(", "_", "'", "’", "{{"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_pieces_equal_the_library(parts):
    t = "".join(parts)
    assert MODEL.encode(t) == LIBRARY.encode(t)
    assert MODEL.decode(MODEL.encode(t)) == t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "a", "e", "er", "in", "on", "ing", "s", "t", "1", "q", "²", "’"]), min_size=30, max_size=200), st.integers(18, 90))
def test_chunks_without_words_equal_the_library(parts, size):
    t = "".join(parts)
    assert MODEL.encode_normal(MODEL.normal(t), size) == LIBRARY.encode(t)


def test_matrices_combine_associatively():
    r = np.random.default_rng(0)
    a, b, c = (np.where(r.random(s) < 0.4, 0.0, -np.inf) for s in ((3, 4), (4, 5), (5, 2)))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


@settings(max_examples=150, deadline=None)
@given(PARTS, st.integers(1, 40))
def test_cuts_anywhere_equal_the_library(parts, size):
    """Chunks of any length, whose cuts fall inside words and pieces."""
    t = "".join(parts)
    assert MODEL.encode_normal(MODEL.normal(t), size) == LIBRARY.encode(t)


def test_the_scan_decides_every_text_of_several_chunks(monkeypatch, documents):
    """Cuts stand at fixed places; states at most of them are many, and choose() picks among them."""
    real, met = pieces.choose, []

    def watched(matrices):
        met.append((len(matrices), max(m.size for m in matrices)))
        return real(matrices)

    monkeypatch.setattr(pieces, "choose", watched)
    for r in documents.select("text").collect():
        before = len(met)
        ids = MODEL.encode(r.text)
        chunks = -(-(len(r.text) + 1) // pieces.CHUNK)
        assert ids == LIBRARY.encode(r.text)
        assert [n for n, _ in met[before:]][-1:] == ([chunks] if chunks > 1 else [])
    assert len(met) > 10 and sum(size > 1 for _, size in met) > len(met) * 0.8
    # another choice gives other ids
    long = max((r.text for r in documents.select("text").collect()), key=len)
    monkeypatch.setattr(pieces, "choose", lambda m: [0] * (len(m) + 1))
    try:
        assert MODEL.encode(long) != LIBRARY.encode(long)
    except KeyError:  # no path leads through those states
        pass


def test_documents_come_back(spark, documents):
    got = pieces.encoded(documents).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in got:
        assert r.ids == LIBRARY.encode(text[r.id]) and r.exact and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.id].encode()).hexdigest()


def test_giants_are_dealt_out(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["the", "er", " ", "\n", "ing ", "x1"]) for _ in range(4000)), "".join(rng.choice(["the", "er", "on", "q"]) for _ in range(3000)), "ab" * 4096, " " * 8192, "short", "中😀 " * 3000, "z" * 4097, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pieces.encoded(df, giant=4096, span=1024).collect():
        assert r.ids == LIBRARY.encode(texts[r.id] or "") and r.exact, r.id


# -- chat

@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "Tool", "", "a:b", "\\x"]), st.text(alphabet="a#\\ht</turn>: \n", max_size=30)), min_size=1, max_size=12), st.integers(5, 40), st.integers(0, 12))
def test_windows_read_back(turns, budget, history):
    state, made = chat._Conversation(budget, history), []
    for t in turns:
        if closed := state.push(*t):
            made.append(closed)
    made.append(state.flush())
    back, said = [], []
    for k, (n, text, loss, repeated) in enumerate(made):
        parsed = list(chat.parse(text))
        back += [(r, t) for r, t, _, _ in parsed[repeated:]]
        said += [chat.unescape(text[a:b]) for a, b in loss]
        short = turns[0][0] == "system" and chat.tokens(turns[0][1]) <= chat.SYSTEM * budget
        assert n == k and (k == 0 or not short or parsed[0][:2] == turns[0])
        if len(parsed) > repeated + 1:
            assert sum(chat.tokens(t) for _, t, _, _ in parsed) <= budget
    assert back == turns and said == [t for r, t in turns if r == "assistant"]


def test_conversations(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", queries.PROBE[1]), (-7, 1, "assistant", queries.PROBE[1])]
    got = {r.conv_id: r for r in queries.op5_chat_formatting(spark, sf_dir).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(t[1:] for t in turns if t[0] == conv)
        said = "".join(t for _, r, t in own if r == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.formatted_chars > 0
    assert not got


def test_long_system_turns_do_not_multiply(spark):
    rows = [(1, 0, "system", "rule " * 600)] + [(1, i, "user" if i % 2 else "assistant", "a few words") for i in range(1, 200)]
    own = [(2, *r[1:]) for r in rows[1:]]
    got = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows + own, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 200 and got[2].n_turns == 199
    assert got[1].formatted_chars < got[2].formatted_chars + 2 * len(rows[0][3])


def test_columns_of_other_names_do_not_matter(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y", 1), (1, 1, "assistant", "z", "y", 2)], "conv_id long, turn long, role string, text string, window string, loss int")
    assert [r.n_turns for r in chat.read_back(chat.windows(df)).collect()] == [2]
    rows = [(1, "token=abcdefgh", 14, "a", "b", "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __blob string, secret_blob string, Secret_Spans string, spans string")
    assert [tuple(r) for r in secrets.redact(df).collect()] == [(1, "[SECRET]", 8, "a", "b", "c", "d")]


def test_conversation_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[None].n_turns == 1
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


# -- secrets

TOUGH = ["secret=token:abcdefgh password = 'hunter22' ApiKey:short", "é AKIA" + "A1" * 9 + " 0123456789abcdef0123456789 token=abcdef0123456789abcdef0123456789", "passwd:\"x/y+z=.-_\" AKIAAKIA" + "B" * 20, "ſecret=abcdefg toKen=abcdefg", "password=abcdef" * 3, "ghp_" + "a" * 40 + " -----BEGIN RSA PRIVATE KEY-----", "none", "", None]


def _spans(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 6 and "ſ" not in m[1]]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_spans(spark):
    rows = [(i, t) for i, t in enumerate(TOUGH * 2)]
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s["rank"], s.kind, s.end) for s in r.spans if s["rank"] < secrets.BASE] == _spans(dict(rows)[r.id])


def test_ledger_scans_once(spark):
    df = spark.createDataFrame([(1, TOUGH[0]), (2, TOUGH[1])], "doc_id long, text string")
    _, ledger = secrets.secrets(df)
    forged = spark.createDataFrame([(r.blob, r.version, []) for r in ledger.collect()], ledger.schema)
    more = spark.createDataFrame([(1, TOUGH[0]), (3, TOUGH[2])], "doc_id long, text string")
    paths, whole = secrets.secrets(more, ledger=forged)
    got = {r.id: len(r.spans) for r in paths.collect()}
    assert got[1] == 0 and got[3] > 0  # what the ledger holds is believed, not scanned
    assert whole.count() == 3


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(TOUGH)], "doc_id long, text string, n_chars long")
    for r in secrets.redact(df).collect():
        want, at = "", 0
        merged = []
        spans = [s for s in next(x for x in secrets.secrets(df)[0].collect() if x.id == r.doc_id).spans]
        for s in sorted(spans, key=lambda s: s.start):
            if merged and s.start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.end)
            else:
                merged.append([s.start, s.end])
        t = TOUGH[r.doc_id]
        for a, b in merged:
            want, at = want + t[at:a] + "[SECRET]", b
        assert r.text == (want + t[at:] if merged else t) and r.n_chars == len(r.text or "")


def test_secret_oracle(spark, sf_dir):
    same(queries.op6_secrets(spark, sf_dir), duck(sf_dir), queries.oracle_sql()["op6_secrets"])


# -- fingerprints

def test_order_and_edits_of_multisets():
    a, b = multiset.fingerprint("one\ntwo\nthree"), multiset.fingerprint("three\none\ntwo")
    assert a == b != multiset.fingerprint("one\ntwo\nthree\nthree")
    # a text with a paragraph more is the sum, less the empty paragraph that neither has
    assert multiset.add(multiset.fingerprint("one\ntwo"), multiset.fingerprint("three")) == a
    assert multiset.subtract(a, multiset.fingerprint("two")) == multiset.fingerprint("one\nthree")


@pytest.mark.parametrize("text", ["x" * 40_000, "x" * 600_000, "word " * 40_000])
def test_lanes_hold_long_repetitive_texts(text):
    """More than 32,767 equal grams: three quarters stay, a quarter is replaced."""
    n = len(text) // 4
    whole, edited = multiset.fingerprint(text), multiset.fingerprint(text[:-n] + "y" * n)
    assert multiset.likeness(multiset.decode(whole), multiset.decode(edited)) > 0.7
    assert multiset.subtract(multiset.add(whole, edited), edited) == whole


def _grams(text):
    """Counts of the 16-byte grams of each paragraph, the last ones padded."""
    out = {}
    for p in text.encode().split(b"\n"):
        padded = p + b"\0" * 16
        for i in range(len(p)):
            out[padded[i : i + 16]] = out.get(padded[i : i + 16], 0) + 1
    return out


def test_likeness_estimates_the_grams_in_common(documents):
    """Against the exact normalised inner product of gram counts; 128 lanes err by about a tenth."""
    texts = sorted((r.text for r in documents.collect()), key=len)[20:-20:4]
    off = []
    for a, b in zip(texts, texts[1:]):
        for other in (b, a[: len(a) * 3 // 4] + b[: len(a) // 4], a + "\n" + a, a[len(a) // 2 :] + a[: len(a) // 2]):
            x, y = _grams(a), _grams(other)
            exact = 2 * sum(n * y.get(g, 0) for g, n in x.items()) / (sum(n * n for n in x.values()) + sum(n * n for n in y.values()))
            off.append(multiset.likeness(multiset.decode(multiset.fingerprint(a)), multiset.decode(multiset.fingerprint(other))) - exact)
    assert np.abs(off).max() < 0.4 and np.abs(off).mean() < 0.08


def test_pairs_are_judged_as_merging_does():
    model = pieces.load(Path(pieces.MODEL).read_bytes())
    rng, every = random.Random(7), sorted(model.id)
    pairs = [(rng.choice(every), rng.choice(every)) for _ in range(5000)]
    cut = rng.sample([p for p in every if len(p) > 2], 3000)
    pairs += [(p[:k], p[k:]) for p in cut for k in range(1, len(p)) if p[:k] in model.id and p[k:] in model.id]
    pairs += [("▁" * i, "▁" * j) for i in range(1, 17) for j in range(1, 17) if {"▁" * i, "▁" * j} <= set(every)]
    told = [model.merge(p + q) == [p, q] for p, q in pairs]
    assert [model.apart(p, q) for p, q in pairs] == told and 100 < sum(told) < len(told) - 100


def test_heads_tell_all_pieces():
    model = pieces.load(Path(pieces.MODEL).read_bytes())
    for p in model.id:
        told = next((model.fits[h] for h in (p[:n] for n in range(pieces.HEAD, 1, -1)) if h in model.fits), (1,))
        assert {n for n in range(1, len(p) + 1) if n == 1 or p[:n] in model.id} <= set(told)


def test_rows_of_one_id_are_parted(spark, monkeypatch):
    """Half of all rows share an id and some have none: ranges part them, and each row's successor is right."""
    monkeypatch.setattr(multiset, "RANGE", 400)
    rows = [(7, f"text number {i} of a hot id") for i in range(120)] + [(None, f"row {i} without an id") for i in range(90)] + [(i, f"row {i} " * 3) for i in range(100) if i != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spread = df.select("doc_id", multiset.F.xxhash64("text").alias("h"), "text").collect()
    order = sorted(spread, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text))
    after = {}
    for k, r in enumerate(order):
        nxt = order[(k + 1) % len(order)].text
        q = len(r.text) // 4
        after[r.doc_id, multiset.fingerprint(r.text)] = hashlib.sha256((r.text[: len(r.text) - q] + nxt[:q]).encode()).hexdigest()
    got = {(r.id, r.fingerprint): r.edited_sha256 for r in multiset.edits(df).collect()}
    assert got == after
    ranges = multiset.in_order_with_next(df, "doc_id", "text").filter("not lent").select("id", "b").distinct()
    assert ranges.filter("id = 7").count() > 3 and ranges.filter("id is null").count() > 3


def test_successors(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.id: r for r in multiset.edits(documents).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited, r = t[: len(t) - q] + after[:q], got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert r.fingerprint == multiset.fingerprint(t) and r.edited_fingerprint == multiset.fingerprint(edited)
        assert r.near_next == multiset.likeness(multiset.decode(r.fingerprint), multiset.decode(multiset.fingerprint(after)))
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.2 > np.mean([r.near_next for r in got.values()])


# -- simhash

def _simhash(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _classes(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash_classes(spark, documents):
    fps = {r.doc_id: _simhash(r.text) for r in documents.collect()}
    label = _classes(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(least.get(label[f], 1 << 62), i)
    got = simhash.classes(documents).collect()
    assert {r.id: (r.fp % 2**64, r.component) for r in got} == {i: (f, least[label[f]]) for i, f in fps.items()}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(40)}
    monkeypatch.setattr(simhash, "BUCKET", 8)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root for r in components.connected_components(simhash.links(df)).collect()}
    want = _classes(fps)
    groups = lambda m: {frozenset(f for f in fps if m.get(f, f) == k) for k in {m.get(f, f) for f in fps}}
    assert groups(roots) == groups(want)


def test_pivot_coordinates_bring_links_together(spark):
    """Every two fingerprints within three bits meet under a key; few of the others do."""
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(150)] + [0, 2**64 - 1]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in seeds for k in (1, 2, 3)]
    fps = sorted({*seeds, *near})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    met: dict[int, set] = {}
    for r in simhash.keyed(df).collect():
        met.setdefault(r.fp % 2**64, set()).add(r.k)
    assert all(len(k) == len(simhash.CHOICES) for k in met.values())
    rows = dict(zip(fps, simhash.table(np.array(fps, np.uint64)).astype(int)))
    far = 0
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert met[a] & met[b] and np.abs(rows[a] - rows[b]).max() <= 3
            else:
                far += bool(met[a] & met[b])
    assert far < len(fps) and simhash.PIVOTS.size >= 50


def test_an_id_on_texts_of_two_classes(spark):
    """Each class keeps exactly one row, whatever its ids are."""
    one, two = "alpha beta gamma delta epsilon", "some other words stand here instead"
    rows = [(1, one), (1, two), (2, one), (None, two), (None, "all by itself"), (None, "all by itself"), (3, one), (3, one)]
    got = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, "all by itself")], key=str)
    df = spark.createDataFrame([(5, one, "x", "y"), (4, one, "z", "w")], "doc_id long, text string, digest string, kept_id string")
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [(4, one, "z", "w")]


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(e.limit(0)).count() == 0


# -- mixing

def _targets(sizes):
    """Water filling by hand: sizes by source in order; returns each one's target in words."""
    total, left = 1.5 * sum(sizes), dict(enumerate(sizes))
    out = {}
    while left:
        share = {i: (total - sum(out.values())) * mixing.WEIGHTS[i % 3] / sum(mixing.WEIGHTS[j % 3] for j in left) for i in left}
        over = [i for i in left if share[i] > 2 * left[i]]
        if not over:
            out |= share
            break
        for i in over:
            out[i] = 2 * left.pop(i)
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100, 10], [5, 5, 5], [1000], [0, 7, 0, 3000, 12, 1, 1], [1, 10**6, 10, 10**4, 3, 3, 3]])
def test_water_level(spark, monkeypatch, sizes):
    monkeypatch.setattr(mixing, "CELLS", 3)  # several rounds of cutting
    df = spark.createDataFrame([(w, mixing.WEIGHTS[i % 3]) for i, w in enumerate(sizes)], "words long, weight long")
    level = mixing.level(df, mixing.SHARE * sum(sizes))
    assert [float(min(level * mixing.WEIGHTS[i % 3], 2 * w)) for i, w in enumerate(sizes)] == pytest.approx(_targets(sizes))


def test_quotas_split_exactly():
    q = np.array([1000, 7, 0, 333])
    leaves = list(mixing.split_quotas(q, 0, 13, 6))
    assert [n[:2] for n in leaves] == [(k, k + 1) for k in range(13)]
    s = np.array([n[3] for n in leaves])
    assert (s.sum(0) == q).all() and s.sum(1).max() - s.sum(1).min() <= 4
    assert (np.array([n[2] for n in leaves]) == np.cumsum(s, 0) - s).all()  # runs of places lie end to end
    # the same leaves if levels are split one task after the other
    deep = [(a, b, x + y, z) for lo, hi, x, held in mixing.split_quotas(q, 0, 13, 2) for a, b, y, z in mixing.split_quotas(held, lo, hi, 6)]
    assert all(a[:2] == b[:2] and (a[2] == b[2]).all() and (a[3] == b[3]).all() for a, b in zip(leaves, deep))


def _told(df):
    return sorted((str(r.id), r.source, r.size, r.source_size, r.target, sorted(map(tuple, r.draws))) for r in df.collect())


def test_mixture(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 2000)
    told = _told(mixing.plan(documents, shard_words=20_000))
    monkeypatch.setattr(mixing, "KNOWN", 0)  # shuffled joins and several ranges give the same
    monkeypatch.setattr(mixing, "RANGE", 6)
    assert told == _told(mixing.plan(documents.repartition(5), shard_words=20_000))
    own = {}
    for r in documents.collect():
        own.setdefault(r.source, []).append(len(r.text.encode().split()))
    names = sorted(own)
    targets = dict(zip(names, _targets([sum(own[n]) for n in names])))
    shards = set()
    for s in names:
        rows = [r for r in told if r[1] == s]
        taken = sum(size * len(draws) for _, _, size, _, _, draws in rows)
        assert {r[3] for r in rows} == {sum(own[s])} and rows[0][4] == pytest.approx(targets[s])
        assert abs(taken - targets[s]) <= max(own[s]) and all(len(r[5]) <= 2 for r in rows)
        shards |= {d[0] for r in rows for d in r[5]}
    assert shards == set(range(-(-int(np.ceil(sum(targets.values()))) // 20_000)))
    out = mixing.mix(documents, shard_words=20_000)
    assert out.columns == documents.columns
    drawn = {}
    for r in out.collect():
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + 1
    assert drawn == {int(i): len(d) for i, _, _, _, _, d in told if d}


def test_empty_texts_of_a_full_source(spark):
    """Source a reaches its limit by two whole passes: nothing of it is drawn a third time."""
    rows = [(float(i) / 2, "one two three" if i % 2 else "", "a") for i in range(300)] + [(1000.0 + i, "word " * 40, "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id double, text string, source string")
    told = _told(mixing.plan(df))
    mine = [r for r in told if r[1] == "a"]
    assert mine[0][4] == 2 * 450 and {len(r[5]) for r in mine} == {2}
    out = mixing.mix(df).groupBy("doc_id").count().collect()
    assert {str(r["doc_id"]): r["count"] for r in out} == {r[0]: len(r[5]) for r in told if r[5]}


def test_names_of_columns_do_not_matter(spark):
    rows = [(i, "some words here", "s", "x", "y", "z") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __d string, draw string, Place_Hash string")
    assert {tuple(r) for r in mixing.mix(df).collect()} <= set(rows)


# -- nearest neighbours

def test_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in e.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in forest.search(e).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
        hit, total = hit + len(best & {v for _, v, _ in own}), total + 10
    assert hit / total >= 0.9
