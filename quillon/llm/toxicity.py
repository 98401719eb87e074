"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a hashed word vector and the mean of its hashed character-pair
vectors. A window of words runs through a GRU either way; attention pools the states and a linear
layer scores the window. All overlapping windows of a text are scored, and a logistic calibrator
turns the highest score into the text's probability. Training, too, reads every window of its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_remainder
from quillon.llm.labelled import Logistic, sample

WINDOW, STRIDE = 32, 16
WORDS, PAIRS, DIM, HIDDEN = 1 << 15, 1 << 12, 16, 8
#: Bounds of the labelled sample: documents of each class whose whole texts are learnt from, and
#: documents for the calibration.
FIT_ROWS, CALIBRATION_ROWS = 1200, 6000
#: Numbers that features() gives for a text.
FEATURES = 1
#: Epochs over all windows, and in all; size and rate of a step; texts that a word must be in; seed.
WARM, EPOCHS, BATCH, RATE, COMMON, SEED = 1, 11, 128, 0.01, 6, 1
MODULUS, HELD = 4, 2
THRESHOLD = 0.3
#: ASCII punctuation parts words.
_GAPS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_GAPS).split()


def starts(n: int) -> range:
    """First words of all windows over n words; one window if there are few or none."""
    return range(0, max(n - WINDOW, 0) + STRIDE if n > WINDOW else 1, STRIDE)


@dataclass
class Lexicon:
    """Hashed inputs of distinct words; entry 0 pads."""

    word: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Lexicon:
        word = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
        spaced = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
        pairs = (spaced[:-1] * 251 + spaced[1:] * 17) % PAIRS
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return cls(word, pairs, np.concatenate([[0], np.cumsum(lengths)]), np.ones(len(words), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values; much faster than add.at."""
    if not len(rows):
        return rows, values
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Network:
    """Parameters, window scores, and gradients."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "word": np.zeros((WORDS, DIM), np.float32), "pair": normal(PAIRS, DIM), "in": normal(DIM, 6 * HIDDEN, k=0.25), "bias": np.zeros(6 * HIDDEN, np.float32),
            "fore": normal(HIDDEN, 3 * HIDDEN, k=0.3), "back": normal(HIDDEN, 3 * HIDDEN, k=0.3),
            "look": normal(2 * HIDDEN, k=0.3), "out": normal(2 * HIDDEN, k=0.3), "level": np.full(1, -1, np.float32),
        }

    def inputs(self, lex: Lexicon) -> np.ndarray:
        """The input vector of every word of a lexicon; row 0 is padding and zero."""
        x = np.zeros((len(lex.word) + 1, DIM), np.float32)
        for at in range(0, len(lex.word), 1024):  # arrays that stay in cache
            own = slice(at, at + 1024)
            first = lex.first[at : at + 1025]
            sums = np.add.reduceat(self.p["pair"][lex.pairs[first[0] : first[-1]]], first[:-1] - first[0], axis=0)
            x[at + 1 : at + 1025] = self.p["word"][lex.word[own]] * lex.known[own, None] + sums / np.diff(first)[:, None]
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["in"] + self.p["bias"]

    def _run(self, g: np.ndarray, ids: np.ndarray, side: int, keep: list | None) -> np.ndarray:
        h, out = np.zeros((len(ids), HIDDEN), np.float32), np.empty((*ids.shape, HIDDEN), np.float32)
        u, lo = self.p["back" if side else "fore"], 3 * HIDDEN * side
        table = np.ascontiguousarray(g[:, lo : lo + 3 * HIDDEN])
        for t in range(ids.shape[1] - 1, -1, -1) if side else range(ids.shape[1]):
            x, r = table[ids[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, reset, n, r[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[:, t] = h
        return out

    def windows(self, g: np.ndarray, ids: np.ndarray, block: int = 1024) -> np.ndarray:
        """What logits() gives, without anything kept for gradients.

        Windows go by blocks whose arrays stay in cache; a hidden unit's values lie together, and
        every array is used again at the next word.
        """
        tables = [np.ascontiguousarray(g[:, lo : lo + 3 * HIDDEN]) for lo in (0, 3 * HIDDEN)]
        turned = [np.ascontiguousarray(self.p[k].T) for k in ("fore", "back")]
        out, length = np.empty(len(ids), np.float32), ids.shape[1]
        for at in range(0, len(ids), block):
            words = np.ascontiguousarray(ids[at : at + block].T)
            n = words.shape[1]
            s = np.empty((length, 2 * HIDDEN, n), np.float32)
            rows, x, r, z, new = (np.empty(shape, np.float32) for shape in ((n, 3 * HIDDEN), (3 * HIDDEN, n), (3 * HIDDEN, n), (2 * HIDDEN, n), (HIDDEN, n)))
            for side, (table, u) in enumerate(zip(tables, turned)):
                h = np.zeros((HIDDEN, n), np.float32)
                for t in range(length - 1, -1, -1) if side else range(length):
                    table.take(words[t], axis=0, out=rows, mode="clip")
                    x[:] = rows.T
                    np.matmul(u, h, out=r)
                    np.add(x[: 2 * HIDDEN], r[: 2 * HIDDEN], out=z)
                    np.negative(z, out=z)
                    np.exp(z, out=z)
                    z += 1
                    np.reciprocal(z, out=z)
                    np.multiply(z[HIDDEN:], r[2 * HIDDEN :], out=new)
                    new += x[2 * HIDDEN :]
                    np.tanh(new, out=new)
                    own = s[t, HIDDEN * side : HIDDEN * (side + 1)]
                    np.subtract(h, new, out=own)
                    own *= z[:HIDDEN]
                    own += new
                    h = own
            a = np.matmul(self.p["look"], s)
            a[words == 0] = -30
            a -= a.max(0)
            np.exp(a, out=a)
            a /= a.sum(0)
            out[at : at + block] = (a * np.matmul(self.p["out"], s)).sum(0) + self.p["level"]
        return out

    def logits(self, g: np.ndarray, ids: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Scores of windows of word numbers (0 pads) under projected inputs."""
        runs: tuple[list, list] | None = ([], []) if kept is not None else None
        s = np.concatenate([self._run(g, ids, side, runs[side] if runs else None) for side in (0, 1)], axis=2)
        a = s @ self.p["look"]
        a = np.where(ids > 0, a, -30).astype(np.float32)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, s)
        if kept is not None:
            kept.update(runs=runs, s=s, a=a, pooled=pooled)
        return pooled @ self.p["out"] + self.p["level"]

    def gradients(self, lex: Lexicon, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy; word and pair rows come as (rows, values)."""
        x = self.inputs(lex)
        g, kept = self.project(x), {}
        d = ((_sigmoid(self.logits(g, ids, kept)) - y) * weight / weight.sum()).astype(np.float32)
        s, a, out = kept["s"], kept["a"], {}
        out["out"], out["level"] = d @ kept["pooled"], d.sum(keepdims=True)
        dp = d[:, None] * self.p["out"]
        da = np.einsum("nh,nth->nt", dp, s)
        da = a * (da - (a * da).sum(1, keepdims=True))
        ds = a[:, :, None] * dp[:, None] + da[:, :, None] * self.p["look"]
        out["look"] = np.einsum("nt,nth->h", da, s)
        dg = np.zeros_like(g)
        each = np.empty((ids.shape[1], len(ids), 6 * HIDDEN), g.dtype)
        for side, name in enumerate(("fore", "back")):
            u, lo = self.p[name], 3 * HIDDEN * side
            du, dh = np.zeros_like(u), np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, reset, n, rn in reversed(kept["runs"][side]):
                dh = dh + ds[:, t, HIDDEN * side : HIDDEN * (side + 1)]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * rn * reset * (1 - reset)
                pre = np.concatenate([dz, dr, dn * reset], axis=1)
                du += h.T @ pre
                each[t, :, lo : lo + 3 * HIDDEN] = np.concatenate([dz, dr, dn], axis=1)
                dh = dh * z + pre @ u.T
            out[name] = du
        rows, sums = _by_row(ids.T.ravel(), each.reshape(-1, 6 * HIDDEN))
        dg[rows] = sums
        out["in"], out["bias"] = x.T @ dg, dg.sum(0)
        dx = (dg @ self.p["in"].T)[1:]
        out["word"] = (lex.word, dx * lex.known[:, None])
        per = np.diff(lex.first)
        out["pair"] = (lex.pairs[: lex.first[-1]], np.repeat(dx / per[:, None], per, axis=0))
        return out


def number(texts: list[list[bytes]]) -> tuple[Lexicon, list[np.ndarray]]:
    """A lexicon of the texts' words, and each text as word numbers from 1."""
    seen: dict[bytes, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen) + 1) for w in t), np.int64, len(t)) for t in texts]
    return Lexicon.of(list(seen)), ids


def number_all(texts: list[str | None]) -> tuple[Lexicon, list[np.ndarray]]:
    """What number() gives for the words of texts, numbered in Arrow."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    spaced = b"".join(raw).lower().translate(_GAPS)
    upto = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    parts = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(upto), pa.py_buffer(spaced)]))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    at = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets]
    told = flat.filter(real).dictionary_encode()
    ids = told.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return Lexicon.of(told.dictionary.cast(pa.large_binary()).to_pylist()), [ids[a:b] for a, b in zip(at, at[1:])]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All windows of a text, (windows, WINDOW), padded with 0."""
    n = len(starts(len(ids)))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def train(texts: list[str], y: np.ndarray) -> Network:
    """Learns windows from document labels: first from all, then from each text's highest window.

    Of a toxic text only the window that scores highest counts, of a clean one the two highest and
    one other, so windows that hold nothing toxic are not learnt as such. Words in fewer than
    COMMON of the texts have no vector of their own, which keeps the network from learning texts
    by heart; vectors begin at zero, so such words are read by their characters ever after.
    """
    net, rng = Network(), np.random.default_rng(SEED)
    if len(set(y.tolist())) < 2:
        return net
    lex, ids = number([words_of(t) for t in texts])
    spread = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(lex.word) + 1)[1:]
    lex.known = (spread >= COMMON).astype(np.float32)
    doc, wins = [], []
    for i, x in enumerate(ids):
        wins.append(windows_of(x))
        doc += [i] * len(wins[-1])
    doc, wins = np.array(doc), np.concatenate(wins)
    label = y[doc].astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch < WARM:
            chosen = np.arange(len(wins))
        elif (epoch - WARM) % 2 == 0:  # the highest windows of this epoch and the next
            g = net.project(net.inputs(lex))
            s = net.windows(g, wins)
            order = np.lexsort((-s, doc))
            place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            top = order[(place == 0) | ((place == 1) & (label[order] == 0))]
            other = rng.choice(np.flatnonzero(label == 0), len(top) // 4)
            chosen = np.concatenate([top, other])
        chosen = rng.permutation(chosen)
        toxic = label[chosen] == 1
        share = 1 / np.bincount(doc)[doc] if epoch < WARM else np.ones(len(doc))
        balance = share * np.where(label == 1, 0.5 / max(toxic.mean(), 1e-3), 0.5 / max(1 - toxic.mean(), 1e-3)).astype(np.float32)
        for at in range(0, len(chosen), BATCH):
            pick = chosen[at : at + BATCH]
            used, inverse = np.unique(wins[pick], return_inverse=True)
            real = used[used > 0] - 1
            small = Lexicon(lex.word[real], np.concatenate([lex.pairs[lex.first[w] : lex.first[w + 1]] for w in real] or [np.empty(0, np.int64)]), np.concatenate([[0], np.cumsum(np.diff(lex.first)[real])]), lex.known[real])
            local = inverse.reshape(wins[pick].shape) + (0 if used[0] == 0 else 1)
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in net.gradients(small, local, label[pick], balance[pick].astype(np.float32)).items():
                if isinstance(d, tuple):
                    where, d = _by_row(*d)
                else:
                    where = slice(None)
                first[k][where] = 0.9 * first[k][where] + 0.1 * d
                second[k][where] = 0.999 * second[k][where] + 0.001 * d * d
                net.p[k][where] -= (rate * first[k][where] / (np.sqrt(second[k][where]) + 1e-7)).astype(np.float32)
    return net


def features(net: Network, texts: list[str | None], slab: int = 800_000, block: int = 4096) -> np.ndarray:
    """(highest window score,) over all windows of whole texts."""
    out = np.empty((len(texts), FEATURES))
    at = 0
    while at < len(texts):
        part, n = 0, 0
        while at + part < len(texts) and (n < slab or not part):
            n += len(texts[at + part] or "") // 6
            part += 1
        lex, ids = number_all(texts[at : at + part])
        g = net.project(net.inputs(lex))
        counts = [len(starts(len(x))) for x in ids]
        score, held, rows = [], [], 0
        for x in ids:
            w = windows_of(x)
            for k in range(0, len(w), block):
                held.append(w[k : k + block])
                rows += len(held[-1])
                if rows >= block:
                    score.append(net.windows(g, np.concatenate(held)))
                    held, rows = [], 0
        if held:
            score.append(net.windows(g, np.concatenate(held)))
        out[at : at + part, 0] = np.maximum.reduceat(np.concatenate(score), np.cumsum([0, *counts[:-1]]))
        at += part
    return out


@dataclass
class Model:
    network: Network
    calibrator: Logistic


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns from a bounded sample of the labelled documents outside the held-out fold.

    The network learns from the whole texts of at most FIT_ROWS documents of each class, the
    calibrator from at most CALIBRATION_ROWS others. Null texts count as empty, rows that repeat a
    labelled id count once, and fitted texts stay within a budget of bytes (labelled.sample). Ids are
    integers. With no labels of both classes, or an empty table, the model is the smoothed share of toxic ones.
    """
    rows = sample(docs, labels, label, MODULUS, HELD, FIT_ROWS, CALIBRATION_ROWS)
    known = rows.filter("part = 'fit'").select("id", "y", "text").toPandas().sort_values(["id", "text"])
    net = train(known["text"].tolist(), known["y"].to_numpy())
    told = docs.sparkSession.sparkContext.broadcast(net)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": list(features(told.value, b["text"].tolist()))})

    rest = rows.filter("part = 'calibrate'").mapInPandas(measure, "id long, y int, x array<double>").toPandas()
    x, y = np.array(rest["x"].tolist()).reshape(-1, FEATURES), rest["y"].to_numpy(float)
    order = np.lexsort((*x.T, rest["id"].to_numpy()))
    return Model(net, Logistic.fit(x[order], y[order]))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null texts count as empty; a text without words is one window of padding and gets its
    calibrated score. Rows with a null id are never held out, repeated rows score alike. With no
    labels of both classes the score is the smoothed share of toxic ones. An empty table gives no
    rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = told.value
        for t in texts:
            yield pd.Series(m.calibrator.predict(features(m.network, t.tolist())))

    held = F.coalesce(id_remainder("doc_id", MODULUS) == HELD, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
