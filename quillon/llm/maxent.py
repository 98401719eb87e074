"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Both factors are log-linear in
hashed features of the history: the last word, the last two, and the second and third last (skips).
Either is taken in two steps, so that no softmax is wide: a group of classes, a class, a part of the
class, a word. Every step starts from exact counts, the logarithms of its children's shares in the
training text, and features move it from there.

Classes come from the corpus: frequent words, ordered by the kind of document that each stands in
most (named by the document's commonest word, the first of equals) and by frequency, are cut into
runs of bounded mass and number. All other words, seen or not, are one class in which a word's share
is its smoothed count; the end is another.

Word counts cover every training document. Weights are trained by distributed gradient updates:
documents are dealt to shards by hash, as many as the text is long; in each round, tasks run AdaGrad
over their shards and the updates are summed, weighted for each feature by how often it was seen.
Shards do not depend on how the table is partitioned, so neither do scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_remainder, materialise, mix64, partitions

MODULUS, HELD = 7, 2
#: Frequent words (a bound of what is broadcast), kinds of document, widths of the four steps, and
#: the most mass (as a share of the frequent words') and words of a class that has more than one.
FREQUENT, KINDS = 98_304, 8
WIDTHS = (21, 16, 16, 32)
MASS, MEMBERS = 1 / 64, WIDTHS[2] * WIDTHS[3]
#: Bits that number the rows of each step's hashed weight table (16 at most), rounds of training, and
#: tokens of a shard.
BITS, ROUNDS, SHARD = 15, 2, 4_000_000
ROWS = 1 << BITS
BLOCK, RATE, MINIBATCH = 128, 0.4, 65536
TAIL, END = 0, 1
#: History features that each step reads: the last word, the last two, the second last, the third last.
FEATURES = (4, 3, 2, 1)
#: Bytes of text that are laid out and that are counted at once, and tokens whose logits are summed
#: at once (arrays that stay in cache).
_SLAB, _COUNTED, _SUMMED = 1 << 21, 1 << 23, 2048
#: Fixed value: the logit of a child that does not exist.
_NONE = -60.0


def training(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold; a null id is inside the training part."""
    return docs.filter(F.coalesce(id_remainder("doc_id", MODULUS), F.lit(-1)) != HELD)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, as words_of() gives them, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(upto[offsets])


def _slabs(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Runs of whole texts of about `most` (_SLAB) bytes, one text at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (most or _SLAB))))
        yield texts.slice(at, to - at)
        at = to


def tally(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, kinds, counts): how often each word stands in texts of each kind."""
    words, lengths = split(texts)
    told = words.dictionary_encode()
    distinct, n = told.dictionary.cast(pa.binary()), len(words)
    if not n:
        return distinct, np.empty(0, np.int64), np.empty(0, np.int64)
    # a text's words sorted together, each occurrence by its place
    bits = [max(1, int(x).bit_length()) for x in (len(distinct), n)]
    keys = told.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    keys <<= np.uint64(bits[1])
    keys |= np.arange(n, dtype=np.uint64)
    if len(texts) > 1:
        keys |= np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(sum(bits)), lengths)
    keys.sort()
    place = (keys & np.uint64((1 << bits[1]) - 1)).astype(np.int64)
    keys >>= np.uint64(bits[1])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count, code, doc = np.diff(first, append=n), (keys[first] & np.uint64((1 << bits[0]) - 1)).astype(np.int64), (keys[first] >> np.uint64(bits[0])).astype(np.int64)
    # the commonest of a text, the first of equals
    order = np.lexsort((place[first], -count, doc))
    top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    kind = np.zeros(len(texts), np.int64)
    kind[doc[top]] = [zlib.crc32(w) % KINDS for w in distinct.take(pa.array(code[top])).to_pylist()]
    sums = np.bincount(kind[doc] * len(distinct) + code, count, KINDS * len(distinct)).astype(np.int64)
    some = np.flatnonzero(sums)
    return distinct.take(pa.array(some % len(distinct))), some // len(distinct), sums[some]


def count_words(docs: DataFrame) -> DataFrame:
    """(w binary, n, k0.. ) over all rows: each word's count, in all and by kind of document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in _slabs(b.column(0), _COUNTED):
                w, kind, n = tally(some)
                yield pa.RecordBatch.from_arrays([w, pa.array(kind, pa.int32()), pa.array(n)], names=["w", "k", "n"])

    rows = docs.select("text").mapInArrow(run, "w binary, k int, n long")
    by = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(KINDS)]
    return rows.groupBy("w").agg(F.sum("n").alias("n"), *by)


@dataclass
class Vocabulary:
    """The frequent words with their places in the tree, and sums over the whole vocabulary.

    `path` has a word's child at every step, -1 where its node has but one; `bias` has, by step, the
    log shares of every node's children, a column for each node. Words behind the frequent ones are the tail and the end.
    """

    words: pa.Array
    log_count: np.ndarray
    path: np.ndarray
    node: np.ndarray
    bias: list[np.ndarray]
    log_tail: float
    classes: int
    tokens: int
    distinct: int
    ends: int

    @classmethod
    def of(cls, words: list[bytes], n: np.ndarray, kind: np.ndarray, tail: float, tokens: int, distinct: int, ends: int) -> Vocabulary:
        """From frequent words, their counts and kinds, and the smoothed mass of the tail."""
        mass = n + 1.0
        order = np.lexsort((words, -n, kind))
        most, owner, member = MASS * mass.sum(), np.empty(len(words) + 2, np.int64), np.zeros(len(words) + 2, np.int64)
        owner[len(words) :] = TAIL, END
        at, held, size, before = END, 0.0, 0, -1
        for i in order.tolist():
            if kind[i] != before or size == MEMBERS or held + mass[i] > most:
                at, held, size, before = at + 1, 0.0, 0, kind[i]
            owner[i], member[i] = at, size
            held, size = held + mass[i], size + 1
        every = np.concatenate([mass, [max(tail, 1e-9), ends + 1.0]])
        path = np.stack([owner // WIDTHS[1], owner % WIDTHS[1], member // WIDTHS[3], member % WIDTHS[3]], axis=1)
        node = np.stack([owner * 0, path[:, 0], owner, owner * WIDTHS[2] + path[:, 2]], axis=1)
        nodes = (1, WIDTHS[0], WIDTHS[0] * WIDTHS[1], WIDTHS[0] * WIDTHS[1] * WIDTHS[2])
        bias = []
        for k, (count, width) in enumerate(zip(nodes, WIDTHS)):
            sums = np.bincount(node[:, k] * width + path[:, k], every, count * width).reshape(count, width)
            whole = np.maximum(sums.sum(1, keepdims=True), 1e-30)
            bias.append(np.ascontiguousarray(np.where(sums > 0, np.log(np.maximum(sums, 1e-30) / whole), _NONE).T, np.float32))
            path[(sums > 0).sum(1)[node[:, k]] == 1, k] = -1
        return cls(pa.array(words, pa.binary()), np.log10(n + 1.0), path.astype(np.int8), node.astype(np.int32), bias, float(np.log10(max(tail, 1e-9))), at + 1, tokens, distinct, ends)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the least count that at most FREQUENT words reach, from a histogram of fixed size
    step = F.floor(F.log2("n") * 16).cast("int")
    spread = sorted(((r["s"], r["c"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    held, least = 0, 1 << 30
    for s, c in spread:
        if held + c > FREQUENT:
            break
        held, least = held + c, s
    top = counts.filter(step >= least).toArrow().to_pandas().sort_values(["n", "w"], ascending=[False, True]).reset_index(drop=True)
    n = top["n"].to_numpy(np.int64)
    kind = top[[f"k{k}" for k in range(KINDS)]].to_numpy(np.int64).argmax(1) if len(top) else np.empty(0, int)
    tail = float(total["n"] - n.sum() + total["v"] - len(top) + 1)
    return Vocabulary.of([bytes(w) for w in top["w"]], n, kind, tail, int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends)


@dataclass
class Batch:
    """Documents laid end to end: keys of every token's history features (a row for each), its place
    (a frequent word's number, then the tail and the end), where each document begins and how many
    tokens it has, and the rare words with their documents."""

    keys: np.ndarray
    place: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    rare: pa.Array
    rare_in: np.ndarray


def lay_out(voc: Vocabulary, texts: pa.Array) -> Batch:
    size = len(voc.words)
    pad, end = size + (1 << 16), size + (1 << 16) + 1
    words, lengths = split(texts)
    told = words.dictionary_encode()
    codes, distinct = told.indices.to_numpy(zero_copy_only=False), told.dictionary.cast(pa.binary())
    known = pc.fill_null(pc.index_in(distinct, value_set=voc.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = known < 0
    known[missing] = [size + (zlib.crc32(w) & 0xFFFF) for w in distinct.filter(pa.array(missing)).to_pylist()]
    ids, is_rare = known[codes], missing[codes]
    # every document: three pads, its words, its end
    doc = np.repeat(np.arange(len(texts)), lengths)
    wide = np.full(len(words) + 4 * len(texts), pad, np.uint64)
    wide[np.arange(len(words)) + 4 * doc + 3] = ids
    ends = np.cumsum(lengths + 4) - 1
    wide[ends] = end
    here = np.flatnonzero(wide != pad)
    a, b, c = wide[here - 1], wide[here - 2], wide[here - 3]
    with np.errstate(over="ignore"):
        salts = [np.uint64(s) for s in (0x51ED270B, 0xA3C59AC3, 0x1B873593, 0xC2B2AE35)]
        big = np.uint64(0x9E3779B97F4A7C15)
        keys = [a * big + salts[0], (a * big + b) * big + salts[1], b * big + salts[2], c * big + salts[3]]
    now = wide[here].astype(np.int64)
    place = np.where(now < size, now, np.where(now == end, size + END, size + TAIL))
    keys = np.stack([(mix64(k) >> np.uint64(32)).astype(np.uint32) for k in keys])
    return Batch(keys, place, np.concatenate([[0], np.cumsum(lengths + 1)])[:-1], lengths + 1, words.filter(pa.array(is_rare)).cast(pa.binary()), doc[is_rare])


def steps(voc: Vocabulary, keys: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(step, tokens, rows, nodes, children) of the steps that have a choice; rows number the hashed features, each with its node."""
    for k in range(len(WIDTHS)):
        child = voc.path[place, k]
        some = np.flatnonzero(child >= 0)
        if not len(some):
            continue
        node = voc.node[place[some], k]
        with np.errstate(over="ignore"):
            salt = (node.astype(np.uint32) + np.uint32((k << 20) + 1)) * np.uint32(0x9E3779B1)
            rows = [(((own[some] ^ salt) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.intp) for own in keys[: FEATURES[k]]]
        yield k, some, rows, node, child[some].astype(np.intp)


class Room:
    """Arrays that are used again and again: memory that is asked for anew each time costs more than what is computed in it."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, *shape: int, dtype: type = np.float32) -> np.ndarray:
        """An array of any content, good until the name is asked for again."""
        n = math.prod(shape)
        if name not in self.held or self.held[name].size < n:
            self.held[name] = np.empty(n, dtype)
        return self.held[name][:n].reshape(shape)


def _logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], node: np.ndarray, room: Room) -> np.ndarray:
    """(children, tokens) logits, less their maximum, from (rows, children) weights and (nodes, children) log shares.

    What a token looks up lies together; sums are turned over once they are made.
    """
    width = bias.shape[1]
    z = room.of("z", width, len(node))
    for lo in range(0, len(node), _SUMMED):
        at = slice(lo, lo + _SUMMED)
        n = len(node[at])
        own, more = room.of("own", n, width), room.of("more", n, width)
        bias.take(node[at], axis=0, out=own, mode="clip")  # all are in range, and only so is `out` written directly
        for r in rows:
            weights.take(r[at], axis=0, out=more, mode="clip")
            own += more
        z[:, at] = own.T
        z[:, at] -= z[:, at].max(0)
    return z


def log_shares(voc: Vocabulary, weights: list[np.ndarray], keys: np.ndarray, place: np.ndarray, slab: int = 16384) -> np.ndarray:
    """The natural logarithm of every token's probability given its history, up to a rare word's share of the tail."""
    out, room = np.zeros(len(place)), Room()
    weights, bias = [np.ascontiguousarray(w.T) for w in weights], [np.ascontiguousarray(b.T) for b in voc.bias]
    for at in range(0, len(place), slab):
        own = out[at : at + slab]
        for k, some, rows, node, child in steps(voc, keys[:, at : at + slab], place[at : at + slab]):
            z = _logits(weights[k], bias[k], rows, node, room)
            picked = z[child, np.arange(len(some))]
            own[some] += picked - np.log(np.exp(z, out=z).sum(0))
    return out


class Learner:
    """AdaGrad over the rows of the weight tables, a minibatch at a time."""

    def __init__(self, voc: Vocabulary, weights: list[np.ndarray]) -> None:
        self.voc, self.w = voc, [w.copy() for w in weights]
        self.power = [np.full(ROWS, 1e-8, np.float32) for _ in weights]
        self.seen = [np.zeros(ROWS, np.float64) for _ in weights]
        self.bias, self.room = [np.ascontiguousarray(b.T) for b in voc.bias], Room()

    def learn(self, keys: np.ndarray, place: np.ndarray) -> None:
        parts = max(1, -(-len(place) // MINIBATCH))
        for lo, hi in zip(len(place) * np.arange(parts) // parts, len(place) * np.arange(1, parts + 1) // parts):
            for k, some, rows, node, child in steps(self.voc, keys[:, lo:hi], place[lo:hi]):
                turned = self.room.of("turned", *self.w[k].T.shape)
                turned[:] = self.w[k].T
                g = _logits(turned, self.bias[k], rows, node, self.room)
                np.exp(g, out=g)
                g /= g.sum(0)
                g[child, np.arange(len(some))] -= 1
                flat, sums = np.concatenate(rows), self.room.of("sums", len(g), ROWS)
                each = self.room.of("each", len(rows), len(node), dtype=np.float64)
                for j, own in enumerate(g):
                    each[:] = own
                    sums[j] = np.bincount(flat, each.ravel(), ROWS)
                self.seen[k] += np.bincount(flat, minlength=ROWS)
                self.power[k] += np.einsum("ij,ij->j", sums, sums)
                sums *= RATE / np.sqrt(self.power[k])
                self.w[k] -= sums


def train(docs: DataFrame, voc: Vocabulary) -> list[np.ndarray]:
    """Weights after all rounds. Documents go to shards by a hash of id and text, and shards to rounds."""
    spark = docs.sparkSession
    weights = [np.zeros((w, ROWS), np.float32) for w in WIDTHS]
    per_round = max(1, -(-voc.tokens // (ROUNDS * SHARD)))
    known = spark.sparkContext.broadcast(voc)
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", "text").alias("h"))
    blocks = ROWS // BLOCK
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def update(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            def moved(shard: int, learner: Learner) -> Iterator[pa.RecordBatch]:
                for k, (w, old, seen) in enumerate(zip(learner.w, start.value, learner.seen)):
                    hit = [at for at in range(0, ROWS, BLOCK) if seen[at : at + BLOCK].any()]
                    changes = [((w[:, at : at + BLOCK] - old[:, at : at + BLOCK]) * seen[at : at + BLOCK]).astype(np.float32).tobytes() for at in hit]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k * blocks + at // BLOCK for at in hit], pa.int32()), pa.array([shard] * len(hit), pa.int32()), pa.array(changes, pa.binary()), pa.array([seen[at : at + BLOCK].tobytes() for at in hit], pa.binary()),
                    ], names=["b", "s", "w", "n"])

            learner, now = None, None
            for b in batches:
                shards, texts = b.column(0).to_numpy(), b.column(1)
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    if shards[lo] != now:
                        if learner:
                            yield from moved(now, learner)
                        learner, now = Learner(known.value, start.value), int(shards[lo])
                    for some in _slabs(texts.slice(lo, hi - lo)):
                        own = lay_out(learner.voc, some)
                        learner.learn(own.keys, own.place)
            if learner:
                yield from moved(now, learner)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, w_sum, n_sum = None, None, None
            for b in batches:
                for i, w, n in zip(b["b"].tolist(), b["w"], b["n"]):
                    w, n = np.frombuffer(w, np.float32).astype(float), np.frombuffer(n, float)
                    if i == now:
                        w_sum, n_sum = w_sum + w, n_sum + n
                        continue
                    if now is not None:
                        yield _mean(now, w_sum, n_sum)
                    now, w_sum, n_sum = i, w, n
            if now is not None:
                yield _mean(now, w_sum, n_sum)

        mine = rows.withColumn("s", F.pmod("h", F.lit(ROUNDS * per_round)).cast("int")).filter(F.col("s") % ROUNDS == turn).withColumn("s", F.floor(F.col("s") / ROUNDS).cast("int"))
        tasks = min(per_round, 50_000)
        shards = mine.repartitionById(tasks, F.col("s") % tasks).sortWithinPartitions("s", "h", "doc_id").select("s", "text")
        # sums go in the order of shards, so that they come out the same whoever adds them
        parts = shards.mapInArrow(update, "b int, s int, w binary, n binary").repartition(partitions(spark), "b").sortWithinPartitions("b", "s")
        for i, w in parts.mapInPandas(add, "b int, w binary").toPandas().itertuples(index=False):
            k, at = divmod(i, blocks)
            weights[k][:, at * BLOCK : (at + 1) * BLOCK] += np.frombuffer(w, np.float32).reshape(WIDTHS[k], -1)
    return weights


def _mean(block: int, w: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"b": [block], "w": [(w.reshape(-1, len(n)) / np.maximum(n, 1)).astype(np.float32).tobytes()]})


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts count as empty; an empty text is its end alone. Rows with a null id are trained on
    and never held out; repeated rows each keep a row. With nothing to train on every count is 0.
    An empty table gives no rows. Counts of rare words come by a join; those of the FREQUENT
    commonest, which is a fixed bound, by broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    learnt = training(rows)
    counts = materialise(count_words(learnt))
    voc = vocabulary(counts, learnt.count())
    told = spark.sparkContext.broadcast((voc, train(learnt, voc)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, weights = told.value
        row, size = TaskContext.get().partitionId() << 33, len(voc.words)
        gained = np.concatenate([voc.log_count, [0.0, np.log10(voc.ends + 1.0)]])
        counts = np.concatenate([np.ones(size, int), [0, int(voc.ends > 0)]])
        for batch in batches:
            ids, at = batch.column(0), 0
            for some in _slabs(batch.column(1)):
                b = lay_out(voc, some)
                own = log_shares(voc, weights, b.keys, b.place) / np.log(10)
                own[b.place == size + TAIL] -= voc.log_tail
                bounds = pa.array(np.searchsorted(b.rare_in, np.arange(len(some) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(some))), ids.slice(at, len(some)), pa.array(b.lengths),
                    pa.array(np.add.reduceat(counts[b.place], b.first)),
                    pa.array(np.add.reduceat(gained[b.place], b.first)), pa.array(np.add.reduceat(own, b.first)),
                    pa.ListArray.from_arrays(bounds, b.rare),
                ], names=["row", "doc_id", "n_tokens", "known", "gained", "own", "rare"])
                at, row = at + len(some), row + len(some)

    done = materialise(rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, gained double, own double, rare array<binary>"))
    tail = done.select("row", F.explode("rare").alias("w")).join(counts.select("w", "n"), "w")
    tail = tail.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("rest"))
    both = done.select("row", "doc_id", "n_tokens", "known", "gained", "own").join(tail, "row", "left")
    gained = F.col("gained") + F.coalesce("rest", F.lit(0.0))
    flat = float(np.log10(voc.tokens + voc.distinct + 1))
    return both.select(
        "doc_id", F.coalesce(id_remainder("doc_id", MODULUS) == HELD, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (gained - F.col("n_tokens") * F.lit(flat)).alias("base_score"), (F.col("own") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
