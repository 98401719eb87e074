"""Packing, the audit of filters and vector codes against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import audit, codes, packing, queries
from tests.compare import duck, same
from tests.llm.conftest import rows as odd_rows

LIBRARY = Tokenizer.from_file(packing.vocabulary())
WORDS = packing.Words(packing.vocabulary())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


# -- packing

PARTS = st.lists(st.sampled_from(["The", "word", " ", "é", "É", "J", "̌", "́", "'s", "'", ".", ",", "!?", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "42", "中", "İ", "ß", "÷", "×", "😀", "-", "…", "ﬁ", "\x00", "ing", "Σ", "ς"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_words_equal_the_library(parts):
    text = "".join(parts)
    assert np.frombuffer(WORDS.ids(text.encode()), "<u4").tolist() == ids_of(text)[:-1]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 4000)
    words = packing.Words(packing.vocabulary())
    for i in range(50):
        text = f"Some words, some {i} words' é{'x' * i}."
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == ids_of(text)[:-1]
    assert len(words) < 60


def test_new_words_are_solved_together():
    rng = random.Random(3)
    core = ["the", "ing", "é", "À", "ß", "tion", "Q", "zx", "7", "42", "***", "$$", ",", ".", "(", "st", "THE", "ü"]
    text = " ".join("".join(rng.choices(core, k=rng.randint(1, 9))) for _ in range(5000)) + " " + "Überlang" * 9
    words = packing.Words(packing.vocabulary())
    before = len(words)
    assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == ids_of(text)[:-1]
    assert len(words) == before  # none went through the tokenizer on its own


@pytest.mark.parametrize("text", [b"\x80a a\xc3 \xa9b \xc3\xc3\xa9 \xffx", b"\xc3", b"", b" \n ", b"a\x00b \xc3\xa9\xa9"])
def test_broken_letters(text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == [i for w in text.split() for i in ids_of(w.decode("utf-8", "replace"))[:-1]]


def test_long_texts_are_solved_in_parts(odd):
    want = Counter(packing.pieces(odd).drop("key").collect())
    assert Counter(packing.pieces(odd, slab=64).drop("key").collect()) == want


def checked(got, texts, capacity):
    """Pieces of every text, in order, whole; sequences gapless and within their capacity."""
    want = Counter()
    for i, t in texts:
        ids = ids_of(t)
        for p, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[i, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= capacity
    return len(held)


def test_whole_table(spark, sf_dir, documents):
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    n = checked(packing.pack(documents).collect(), texts, packing.CAPACITY)
    assert n == -(-sum(len(ids_of(t)) for _, t in texts) // packing.CAPACITY)


def test_odd_tables(odd, empty):
    texts = [r[:2] for r in odd_rows()]
    checked(packing.pack(odd).collect(), texts, packing.CAPACITY)
    checked(packing.pack(odd.withColumnRenamed("doc_id", "_").withColumnRenamed("fp", "doc_id"), capacity=7).collect(), [("x", t) for _, t in texts], 7)
    assert packing.pack(empty).count() == 0


def test_sequences_hold_their_documents(odd):
    packed = packing.pack(odd, capacity=64, ids=True)
    got = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    whole = {i: ids_of(t) for i, t, *_ in odd_rows() if i not in (3, None)}  # ids that stand on one row
    for r in packed.collect():
        own = got[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert len(own) == r.length and (r.id not in whole or own == whole[r.id][r.start : r.start + r.length])
    assert all(len(s.ids) == sum(s.lengths) <= 64 for s in got.values())


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.randoms(use_true_random=False))
def test_search_keeps_items_and_gains(lengths, rng):
    order = list(range(len(lengths)))
    rng.shuffle(order)
    bins, fill = [], 61
    for i in order:  # next fit, which leaves much to mend
        if fill + lengths[i] > 60:
            bins.append([])
            fill = 0
        bins[-1].append(i)
        fill += lengths[i]
    before, n = squares(bins, lengths), len(bins)
    search = packing.Search([list(b) for b in bins], lengths, 60)
    last = before
    while search.count > search.least and search.sweep():
        now = squares(search.bins, lengths)
        assert now > last
        last = now
    after = [b for b in search.bins if b]
    assert sorted(i for b in after for i in b) == list(range(len(lengths))) and len(after) == search.count <= n
    assert all(sum(lengths[i] for i in b) <= 60 for b in after)
    if search.count > search.least:  # no move, swap of one for one, of two for one or of one for two is left
        sums = [[0, *(lengths[i] for i in b)] for b in after]
        for x in range(len(after)):
            for y in range(len(after)):
                fx, fy = sum(sums[x]), sum(sums[y])
                if x == y or fx < fy:
                    continue
                given_ = {(0,), *((lengths[i],) for i in after[x]), *((lengths[i], lengths[j]) for k, i in enumerate(after[x]) for j in after[x][:k])}
                taken = {(lengths[i],) for i in after[y]} | {(lengths[i], lengths[j]) for k, i in enumerate(after[y]) for j in after[y][:k]}
                for g in given_:
                    for t in taken:
                        if len(g) + len(t) <= 3 and (len(t) == 1 or g != (0,)):
                            assert not 0 < sum(t) - sum(g) <= 60 - fx


def test_exchanges_empty_bins():
    """Best fit decreasing leaves bins that only exchanges can empty."""
    rng = random.Random(3)
    lengths = [rng.randint(600, 1100) for _ in range(2000)]
    bins = packing.best_fit(lengths, 2048)
    assert len(packing.Search(bins, lengths, 2048).run()) < len(packing.best_fit(lengths, 2048)) - 5
    kinds = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 30  # volumes 180 a time: three bins of sixty
    found = packing.Search(packing.best_fit(kinds, 60), kinds, 60).run()
    assert len(found) <= len(packing.best_fit(kinds, 60))


def test_blocks_share_their_open_bins(spark):
    """Many small blocks leave open bins; dealt out anew, they end near what one block reaches."""
    rng = random.Random(5)
    lengths = [rng.randint(1, 700) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    tables = packing.place(items, 2048, 300)
    got = [r for t in tables for r in t.collect()]
    assert sorted(r.key for r in got) == list(range(3000))
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += lengths[r.key]
    assert all(r.fill == fills[r.sequence_id] <= 2048 for r in got)
    assert len(fills) <= -(-sum(lengths) // 2048) + 1
    assert sum(t.count() for t in packing.place(items.limit(0))) == 0


# -- audit


def brute_audit(docs, labels):
    """Every order walked over every document."""
    good, toxic = ({i for i, *said in labels if i is not None and said[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = []
    for i, t, s in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        masks.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for k, f in enumerate(order):
            for part in {m[0] for m in masks}:
                own = [m for m in masks if m[0] == part]
                kept = [m for m in own if not m[1] & set(order[: k + 1])]
                gone = [m for m in own if f in m[1] and not m[1] & set(order[:k])]
                out[part, order, k + 1] = [len(kept), len(gone), sum(f in m[1] for m in own) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark, odd, empty):
    marks = [(0, 1, None), (7, 0, 1), (7, 1, 0), (28, 1, 1), (35, 1, 1), (3, 1, 0), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, mask string")
    extra = [(10_000 + i, "word " * 60, "en", "s1" if i % 3 else None, 0, *["x"] * 10) for i in range(40)] + [(50_000, "#%& A B C", "en", "s1", 0, *["x"] * 10)]
    docs = odd.union(spark.createDataFrame(extra, odd.schema))
    got = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in audit.audit(docs, labels).collect()}
    assert got == brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], marks)
    assert audit.audit(empty, labels).count() == 0 and audit.audit(odd, labels.limit(0)).filter("good_lost > 0").count() == 0


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])


# -- codes


def brute_codes(vectors, parts, entries, rounds):
    """Lloyd over every vector, in Python's integers."""
    kept = [(i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in vectors]
    size = len(kept[0][2]) // parts
    cut = lambda v, j: tuple(v[j * size : (j + 1) * size])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[cut(r[2], j) for r in first] for j in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for j, book in enumerate(books):
            held = defaultdict(list)
            for _, _, v in kept:
                held[near(cut(v, j), book)[1]].append(cut(v, j))
            books[j] = [tuple(sum(c) // len(held[e]) for c in zip(*held[e])) if held[e] else book[e] for e in range(len(book))]
    out = []
    for i, label, v in kept:
        best = [near(cut(v, j), books[j]) for j in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    total = Counter()
    for _, label, _, d in out:
        total[label] += d
    said = ",".join(str(x) for book in books for c in book for x in c)
    return sorted((str(i), c, d, total[label]) for i, label, c, d in out), hashlib.sha256(said.encode()).hexdigest()


def test_codes(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.choice([-0.3, 0.0, 0.1, rng.uniform(-2, 2)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(120)]
    vectors += [(500 + i, [0.5] * 8, 1) for i in range(60)] + [(500, [0.5] * 8, 2), (None, [0.25] * 8, None)]  # copies, a repeated and a null id
    junk = [(-9, None, 1), (-8, [None] + [0.0] * 7, 1), (-7, [float("nan")] * 8, 1), (-6, [float("inf")] + [0.0] * 7, 1), (-5, [], 1), (-4, [1.0], 1)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors + junk], "vec_id long, embedding array<double>, label int, part string, row int").repartition(3)
    got, books = codes.compress(df, parts=4, entries=16, rounds=3)
    want, told = brute_codes(vectors, 4, 16, 3)
    assert sorted((str(r.id), r.code, r.error, r.label_error) for r in got.collect()) == want and codes.digest(books) == told
    none, books = codes.compress(df.limit(0))
    assert none.count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_large_components_and_uneven_lengths(spark):
    df = spark.createDataFrame([(i, [1e300 * (i % 2), -1e200, float(i), 0.0, 3.0e5], None) for i in range(6)], "vec_id long, embedding array<double>, label int")
    got, books = codes.compress(df, entries=2)
    assert got.count() == 6 and all(r.error >= 0 for r in got.collect())
    assert [b.shape[1] for b in books] == [2, 1, 1, 1] and abs(books[0]).max() == codes.largest(5)


def test_exact_distances_of_large_integers():
    rng = np.random.default_rng(0)
    x, book = rng.integers(-(2**28), 2**28, (20, 16)), rng.integers(-(2**28), 2**28, (9, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in book] for p in x]
    assert codes.distances(x, book).tolist() == want
    assert codes.distances(x >> 12, book >> 12).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in book >> 12] for p in x >> 12]
