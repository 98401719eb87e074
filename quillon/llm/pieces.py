"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The model at hand merges pairs (BPE). A piece sequence is its encoding exactly if each piece alone
and each two neighbours encode to themselves, and every text has one such sequence. So encoding is
a best path in a lattice of pieces whose edges weigh 0 between such neighbours and -inf elsewhere.

A text is cut into chunks of fixed length, wherever that falls. The states at a cut are the pieces
that may lie across it or end at it; a chunk's transfer matrix holds the best weight from each state
at its beginning to each at its end. Matrices combine associatively in max-plus algebra; once the
scan has fixed the state at every cut, each chunk is traced back on its own. No piece holds a word
mark behind another character, or punctuation beside a letter, so all paths meet where a word
begins: a matrix is the sum of what leads from its first cut to the next such place and from the
last such place to its second cut, and words in between are solved once and remembered.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: Where the piece model is found by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, how far from a cut a word's ends are looked for, and how many solved
#: words, cut words and judged pairs a worker remembers (it forgets all beyond that).
CHUNK, LOOK, WORDS, GATES, PAIRS = 4096, 256, 500_000, 100_000, 2_000_000
#: Fixed value: characters by which the pieces that may begin at a place are told, as _search() asks for them.
HEAD = 5
#: Characters beyond which a text's chunks go to several tasks, and characters of such a chunk.
GIANT, SPAN = 1 << 16, 1 << 14
MARK = "▁"
NEVER = -np.inf
#: A state: where a piece begins and ends; None where every piece must end.
State = tuple[int, int] | None


@dataclass
class Gate:
    """A word that a cut may divide: the cut's states, what leads to each from the word's beginning
    and from each to its end, and the ids on either side of a state (kept once asked for)."""

    word: str
    at: int
    states: list[State]
    left: np.ndarray
    right: np.ndarray
    ids: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)


class Model:
    """Pieces of a SentencePiece BPE model with byte fallback, a leading mark and no normalisation."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(map(len, self.id))
        for probe in (" a  b", "\n\txéﬁ "):
            if sp.normalize(probe) != self.normal(probe):
                raise ValueError("models that normalise texts are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id) or any("\n" in p for p in self.id):
            raise ValueError("a piece holds a word mark behind another character, or a line feed")
        self.marks = _separate({pair for p in self.id for pair in zip(p, p[1:])})
        kind = "".join(map(re.escape, sorted(self.marks)))
        rest = f"{MARK}*[^{MARK}\n{kind}]+|{MARK}*[{kind}]+|{MARK}+" if kind else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+"
        self.parts = re.compile(f"\n|{rest}")
        self.raw = [b""] * size
        for p, i in self.id.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            self.raw[i] = bytes([b])
        # a piece that merging does not give back is in no encoding
        halves = {p: self.last_two(p) for p in self.id if len(p) > 1}
        self.id = {p: i for p, i in self.id.items() if len(p) == 1 or halves[p]}
        # pieces whose merges come in the order of scores: none outranks what it is made of (runs of marks may)
        self.half: dict[str, tuple[str, str]] = {}
        for p in sorted(self.id, key=len):
            if len(p) > 1 and all(len(h) == 1 or (h in self.half and self.score[p] < self.score[h]) for h in halves[p]):
                self.half[p] = halves[p]
        # lengths of the pieces that may stand where a string of 2 to HEAD characters does, longest first
        heads: dict[str, set[int]] = {}
        for p in self.id:
            heads.setdefault(p[:HEAD], set()).add(len(p))
            for n in range(2, min(len(p), HEAD)):
                heads.setdefault(p[:n], set())
        self.fits = {h: tuple(sorted({1} | own | {n for n in range(2, len(h)) if h[:n] in self.id}, reverse=True)) for h, own in heads.items() if len(h) > 1}
        self.judged: dict[int, bool] = {}
        self.pair: dict[tuple[str, str], bool] = {}
        self.word: dict[str, tuple[int, ...]] = {}
        self.gates: dict[tuple[str, int], Gate] = {}

    @staticmethod
    def normal(text: str) -> str:
        return (MARK + text.replace(" ", MARK)) if text else ""

    # -- the lattice

    def merge(self, s: str, least: int = 1) -> list[str]:
        """Encoding of a short string by merging, which judges pieces and pairs; ends early at `least` parts."""
        parts, score = list(s), self.score
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_two(self, p: str) -> tuple[str, str] | None:
        """The two parts whose merging ends in a piece of more than one character; None if merging does not give it back."""
        parts = self.merge(p, 2)
        return (parts[0], parts[1]) if len(parts) == 2 and p in self.score else None

    def apart(self, p: str, q: str) -> bool:
        """Whether two pieces that encode to themselves do so side by side: merge(p + q) == [p, q].

        Takes back, the latest merge first, what made the two pieces beside the place where they
        meet. They part if at no time a merge across that place came before the one taken back; of
        equal ones the left one comes first.
        """
        score, half, bound, right = self.score.get, self.half, NEVER, False
        if (len(p) > 1 and p not in half) or (len(q) > 1 and q not in half):
            return self.merge(p + q) == [p, q]
        while True:
            v = score(p + q)
            if v is not None and (v > bound or (right and v == bound)):
                return False
            a, b = half.get(p), half.get(q)
            if a and (not b or score(p) < score(q)):
                bound, right, p = score(p), False, a[1]
            elif b:
                bound, right, q = score(q), True, b[0]
            else:
                return True

    def follows(self, p: str, q: str) -> bool:
        """Whether q may stand behind p."""
        if p[-1] != MARK and (q[0] == MARK or (p[-1] in self.marks) != (q[0] in self.marks)):
            return True
        known = self.pair.get((p, q))
        if known is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            known = self.pair[p, q] = self.merge(p + q) == [p, q]
        return known

    def path(self, x: str, first: State, at: int, stop: int, reach: int) -> dict[int, int]:
        """Beginnings of the last piece by where it ends, for all sequences from `at` on.

        Sequences continue behind the piece `first`; pieces begin before `stop` and end by `reach`.
        """
        begin = {at: first[0] if first else -1}
        for end in range(at + 1, reach + 1):
            for s in range(max(at, end - self.longest), min(end, stop)):
                b = begin.get(s)
                if b is None:
                    continue
                q = x[s:end]
                if end - s > 1 and q not in self.id:
                    continue
                if b < 0 or self.follows(x[b:s], q):
                    begin[end] = s
                    break
        return begin

    def clean(self, x: str, at: int) -> bool:
        """Whether no piece can lie across a place: a word, a line or punctuation begins or ends there."""
        a, b = x[at - 1], x[at]
        return a == "\n" or b == "\n" or (a != MARK and (b == MARK or (a in self.marks) != (b in self.marks)))

    def next_clean(self, x: str, lo: int, hi: int) -> int | None:
        return next((i for i in range(max(lo, 1), hi) if self.clean(x, i)), None)

    def last_clean(self, x: str, lo: int, hi: int) -> int | None:
        return next((i for i in range(hi - 1, max(lo, 1) - 1, -1) if self.clean(x, i)), None)

    def states(self, x: str, cut: int) -> list[State]:
        """What may lie across or end at a cut, longest first; [None] where a word or the text begins or ends."""
        if cut in (0, len(x)) or self.clean(x, cut):
            return [None]
        out = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(x), s + self.longest) + 1):
                if e - s == 1 or x[s:e] in self.id:
                    out.append((s, e))
        return out

    def _reached(self, x: str, lo: int, start: State, hi: int, ends: list[State]) -> list[float]:
        if start and start[1] > hi:
            return [0.0 if e == start else NEVER for e in ends]
        at = start[1] if start else lo
        far = hi if ends == [None] else min(len(x), hi + self.longest)
        begin = self.path(x, start, at, hi, far) if at < hi else {at: start[0] if start else -1}
        if ends == [None]:
            return [0.0 if hi in begin else NEVER]
        out = []
        for s, e in ends:
            b = begin.get(s)
            good = start == (s, e) or (s >= at and b is not None and (b < 0 or self.follows(x[b:s], x[s:e])))
            out.append(0.0 if good else NEVER)
        return out

    def gate(self, x: str, cut: int) -> tuple[int, int, Gate] | None:
        """(beginning, end, gate) of the word at a cut; None if it is longer than LOOK to either side."""
        if cut in (0, len(x)) or self.clean(x, cut):
            return cut, cut, _OPEN
        a = self.last_clean(x, cut - LOOK, cut)
        b = self.next_clean(x, cut + 1, min(cut + LOOK, len(x)))
        a = 0 if a is None and cut <= LOOK else a
        b = len(x) if b is None and len(x) - cut <= LOOK else b
        if a is None or b is None:
            return None
        w, k = x[a:b], cut - a
        known = self.gates.get((w, k))
        if known is None:
            if len(self.gates) >= GATES:
                self.gates.clear()
            states = self.states(w, k)
            right = np.array([self._reached(w, k, s, len(w), [None])[0] for s in states])
            known = self.gates[w, k] = Gate(w, k, states, np.array(self._reached(w, 0, None, k, states)), right)
        return a, b, known

    def halves(self, gate: Gate, state: int) -> tuple[list[int], list[int]]:
        """Ids of a cut word up to and with a state's piece, and behind it."""
        if state not in gate.ids:
            s, w = gate.states[state], gate.word
            gate.ids[state] = (self._back(w, None, 0, gate.at, s), self._back(w, s, s[1], len(w), None)) if s else ([], [])
        return gate.ids[state]

    def joint(self, x: str, lo: int, hi: int) -> tuple[int, Gate, int, Gate] | None:
        """Where the words at a chunk's two cuts end and begin, if all paths meet in between."""
        here, there = self.gate(x, lo), self.gate(x, hi)
        return (here[1], here[2], there[0], there[2]) if here and there and here[1] <= there[0] else None

    def matrix(self, x: str, lo: int, hi: int) -> np.ndarray:
        """The max-plus matrix of the chunk [lo, hi): best weights from states to states."""
        met = self.joint(x, lo, hi)
        if met:
            return met[1].right[:, None] + met[3].left[None, :]
        return self.transfer(x, lo, self.states(x, lo), hi, self.states(x, hi))

    def traced(self, x: str, lo: int, i: int, hi: int, j: int) -> list[int]:
        """Ids of a chunk between state i of its first cut and state j of its second."""
        met = self.joint(x, lo, hi)
        if met:
            return [*self.halves(met[1], i)[1], *self.words(x[met[0] : met[2]]), *self.halves(met[3], j)[0]]
        return self.trace(x, lo, self.states(x, lo)[i], hi, self.states(x, hi)[j])

    def transfer(self, x: str, lo: int, starts: list[State], hi: int, ends: list[State]) -> np.ndarray:
        """The matrix of a chunk whose words do not tell its two cuts apart."""
        head, tail = self.next_clean(x, lo + 1, hi), self.last_clean(x, lo + 1, hi)
        if head is None:
            return np.array([self._reached(x, lo, s, hi, ends) for s in starts])
        # a word begins inside: all paths meet there
        come = np.array([self._reached(x, lo, s, head, [None]) for s in starts])
        return come + np.array(self._reached(x, tail, None, hi, ends))[None, :]

    def trace(self, x: str, lo: int, start: State, hi: int, end: State) -> list[int]:
        """Ids of the pieces of a chunk, from behind `start` up to and with `end`."""
        if start is not None and start == end:
            return []
        at = start[1] if start else lo
        head, tail = self.next_clean(x, max(at, lo + 1), hi), self.last_clean(x, lo + 1, hi)
        if start is None and end is None:
            return self.words(x[lo:hi])
        if head is None:
            return self._back(x, start, at, hi, end)
        first = self._back(x, start, at, head, None) if start else self.words(x[lo:head])
        return [*first, *(self.words(x[head:tail])), *(self._back(x, None, tail, hi, end) if end else self.words(x[tail:hi]))]

    def _back(self, x: str, start: State, at: int, hi: int, end: State) -> list[int]:
        far = end[1] if end else hi
        if at >= far:
            return []
        out = []
        s, e = end if end else (None, hi)
        begin = self.path(x, start, at, hi, max(hi, e))
        if s is None:
            s = begin[hi]
        while True:
            out.append(x[s:e])
            if s == at:
                break
            s, e = begin[s], s
        return [i for p in reversed(out) for i in self.ids_of(p)]

    def ids_of(self, p: str) -> tuple[int, ...]:
        i = self.id.get(p)
        return (i,) if i is not None else tuple(self.byte[b] for b in p.encode("utf-8", "replace"))

    # -- words

    def solve(self, w: str) -> tuple[int, ...]:
        """Ids of one word, or of a stretch that begins and ends where words do."""
        if len(self.word) >= WORDS:
            self.word.clear()
        if len(w) > LOOK:
            return tuple(self.encode_normal(w, CHUNK // 4))
        out = self.word[w] = tuple(self._search(w))
        return out

    def _search(self, w: str) -> list[int]:
        """The lattice path of one word, longest pieces first.

        A place that a sequence reaches is reached by that sequence alone, so a place from which
        the end cannot be reached is never tried twice.
        """
        get, pairs, n, fits = self.id.get, self.judged, len(w), self.fits.get
        places, took, dead = [0], [], set()
        at, before = 0, -1
        while at < n:
            for size in fits(w[at : at + 5]) or fits(w[at : at + 4]) or fits(w[at : at + 3]) or fits(w[at : at + 2]) or _ONE:
                end = at + size
                if end > n or end in dead:
                    continue
                i = get(w[at:end])
                if i is None:
                    if size > 1:
                        continue
                    i = -2
                if before >= 0 and i >= 0:
                    key = before * 1_000_003 + i
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        good = pairs[key] = self.apart(w[places[-2] : at], w[at:end])
                    if not good:
                        continue
                took.append(i)
                places.append(end)
                at, before = end, i
                break
            else:
                dead.add(at)
                places.pop()
                took.pop()
                at, before = places[-1], took[-1] if took else -1
        if -2 not in took:
            return took
        return [j for k, i in enumerate(took) for j in ((i,) if i >= 0 else self.ids_of(w[places[k]]))]

    def words(self, x: str) -> list[int]:
        get, solve = self.word.get, self.solve
        return list(chain.from_iterable(get(w) or solve(w) for w in self.parts.findall(x)))

    # -- whole texts

    def encode_normal(self, x: str, size: int = CHUNK) -> list[int]:
        if not x:
            return []
        cuts = [*range(0, len(x), size), len(x)]
        if len(cuts) == 2:  # one chunk, from the one state of its beginning to that of its end
            return self._search(x) if self.parts.match(x).end() == len(x) else self.words(x)
        chosen = choose([self.matrix(x, a, b) for a, b in zip(cuts, cuts[1:])])
        return list(chain.from_iterable(self.traced(x, a, i, b, j) for a, b, i, j in zip(cuts, cuts[1:], chosen, chosen[1:])))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_normal(self.normal(text or ""))

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD; the leading mark goes."""
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _separate(beside: set[tuple[str, str]]) -> frozenset[str]:
    """Punctuation that no piece holds beside other characters, but for word marks.

    Grows from the ASCII marks by whatever stands beside one of them; if letters or digits come in,
    punctuation is nothing apart.
    """
    found, more = set(), set(string.punctuation)
    while more:
        found |= more
        more = {c for pair in beside for c, d in (pair, pair[::-1]) if d in found} - found - {MARK}
    return frozenset() if any(c.isascii() and c.isalnum() for c in found) else frozenset(found)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def choose(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut of the best path, by a tree of products: a range's halves meet in
    the state that maximises the sum, given the states at its ends."""
    tree = {}

    def product(lo: int, hi: int) -> np.ndarray:
        if (lo, hi) not in tree:
            mid = (lo + hi) // 2
            tree[lo, hi] = matrices[lo] if hi - lo == 1 else combine(product(lo, mid), product(mid, hi))
        return tree[lo, hi]

    product(0, len(matrices))
    out = [0] * (len(matrices) + 1)
    todo = [(0, len(matrices))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            out[mid] = int((tree[lo, mid][out[lo]] + tree[mid, hi][:, out[hi]]).argmax())
            todo += [(lo, mid), (mid, hi)]
    return out


_ONE = (1,)
_OPEN = Gate("", 0, [None], np.zeros(1), np.zeros(1))


@lru_cache(maxsize=2)
def load(proto: bytes) -> Model:
    return Model(proto)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The model file's bytes, read on the driver and sent to every worker (a few hundred kilobytes)."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _ends(x: str, at: int, k: int, last: int, span: int) -> tuple[int, int]:
    """A chunk's two cuts in a part x of its text that begins at `at`."""
    return k * span - at, len(x) if k == last else (k + 1) * span - at


def _giants(docs: DataFrame, model: Broadcast, span: int) -> DataFrame:
    """(row, id, t, ids) of texts that are worth several tasks, each chunk solved on its own.

    Chunks give their matrices, a text's matrices (a few numbers each) meet in one scan, and the
    chunks are traced back from the states that it fixes. A chunk carries so much of its neighbours
    that both sides of a cut see the same states.
    """
    held = materialise(docs.withColumn("row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model.value)
        side = LOOK + 2 * m.longest
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = m.normal(t)
                last = (len(x) - 1) // span
                for some in range(0, last + 1, 64):
                    ks = range(some, min(some + 64, last + 1))
                    at = [max(0, k * span - side) for k in ks]
                    parts = [x[a:] if k == last else x[a : (k + 1) * span + side] for k, a in zip(ks, at)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row] * len(ks), pa.int64()), pa.array([last] * len(ks), pa.int32()), pa.array(list(ks), pa.int32()), pa.array(at, pa.int64()), pa.array(parts, pa.string()),
                    ], names=["row", "last", "k", "at", "x"])

    chunks = materialise(held.select("row", "t").mapInArrow(split, "row long, last int, k int, at long, x string").repartition("row", "k"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(model.value)
        for b in batches:
            out = []
            for last, k, at, x in zip(*(b.column(n).to_pylist() for n in ("last", "k", "at", "x"))):
                m = known.matrix(x, *_ends(x, at, k, last, span))
                out.append((m.shape[0], (m == 0).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array([n for n, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], names=["row", "k", "n", "m"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, chosen = b.column("row").to_pylist(), []
            for parts in b.column("parts").to_pylist():
                chosen.append(choose([np.where(np.frombuffer(p["m"], np.uint8).reshape(p["n"], -1), 0.0, NEVER) for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(chosen, pa.list_(pa.int32()))], names=["row", "chosen"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(model.value)
        for b in batches:
            out = []
            for last, k, at, x, i, j in zip(*(b.column(n).to_pylist() for n in ("last", "k", "at", "x", "i", "j"))):
                lo, hi = _ends(x, at, k, last, span)
                out.append(known.traced(x, lo, i, hi, j))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(out, pa.list_(pa.int32()))], names=["row", "k", "ids"])

    told = chunks.mapInArrow(matrices, "row long, k int, n int, m binary").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "n", "m"))).alias("parts"))
    states = told.mapInArrow(scan, "row long, chosen array<int>").select("row", F.posexplode("chosen").alias("k", "i"))
    states = materialise(states)
    after = states.select("row", (F.col("k") - 1).alias("k"), F.col("i").alias("j"))
    placed = chunks.join(states, ["row", "k"]).join(after, ["row", "k"])
    traced = placed.mapInArrow(trace, "row long, k int, ids array<int>").groupBy("row")
    ids = traced.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"])).alias("ids"))
    return held.join(ids, "row").select("id", "t", "ids")


def encoded(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, span: int = SPAN) -> DataFrame:
    """(id, n_tokens, ids array<int>, n_chars, decoded_sha256, exact) of every row.

    Texts of more than `giant` characters are dealt out to tasks by chunks of `span`, others are a
    task's own; either way the scan over their chunks' matrices decides the ids.

    ids are those that the SentencePiece library gives; decoded_sha256 is of the text that they
    decode to, and exact tells whether it is the text (a U+2581 in a text comes back as a space).
    Null texts count as empty, which have no ids. Repeated rows and null ids keep their rows; an
    empty table gives no rows.
    """

    told = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(told.value)
        for batch in batches:
            texts, at = batch.column(1), 0
            solved = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            while at < len(texts):
                ids, counts, sizes, digests, exact, n = [], [], [], [], [], 0
                first = at
                while at < len(texts) and n < 1_000_000:
                    t = texts[at].as_py() or ""
                    own = solved[at] if solved else model.encode(t)
                    back = model.decode(own)
                    ids.append(np.array(own, np.int32))
                    counts.append(len(own))
                    sizes.append(len(t))
                    digests.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    exact.append(back == t)
                    n, at = n + len(own), at + 1
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, at - first), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array(sizes, pa.int64()), pa.array(digests), pa.array(exact),
                ], names=["id", "n_tokens", "ids", "n_chars", "decoded_sha256", "exact"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids array<int>, n_chars long, decoded_sha256 string, exact boolean"
    large = rows.filter(F.length("t") > giant)
    if large.isEmpty():
        return rows.mapInArrow(run, schema)
    return rows.filter(F.coalesce(F.length("t") <= giant, F.lit(True))).mapInArrow(run, schema).union(_giants(large, told, span).mapInArrow(run, schema))
