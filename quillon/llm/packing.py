"""Best-fit packing of documents into sequences of bounded length, mended by swaps.

Documents become token ids and pieces; full pieces are sequences as they are. The others are dealt
out to blocks by hash. Inside a block best-fit decreasing makes bins, and a local search exchanges
documents between those that are not full: it moves one, swaps one for one, two for one or one for
two, each time towards the fuller bin, so that the sum of squared fills grows and bins run empty.
Bins that stay open are dealt out anew and searched again among those of other blocks.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import files_for, materialise

#: Tokens of a sequence, pieces of a block, bytes of solved words that a worker remembers (it forgets
#: all beyond that), and bytes of text that are solved at once.
CAPACITY, BLOCK, WORDS, SLAB = 2048, 32_768, 160 << 20, 8 << 20
#: Open bins are dealt out anew until a round saves less than this share of them.
WORTH = 0.001
#: Bytes of the longest run that is merged beside others of its length, and how many are.
RUN, RUNS = 32, 8192


# -- tokens


#: How a byte-level vocabulary writes the bytes that no printable character stands for,
#: in order; the kinds of bytes (1: a letter of Latin-1, 2: a digit, 3: a mark) in words whose pieces
#: part where the kind changes and beside digits; and their lower case.
_BYTES = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = 1
_KIND[48:58] = 2
_KIND[[b for b in b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0x80, 0x9F)]] += 32
_GAP = re.compile(rb"[ \t-\r]").search
_PROBE = "Der Müller's <|endoftext|>, sagt: \"ÇA VA?!\" 1024 x\u0301 J\u030c \u4e2d\u6587\u00a0\U0001f600..., o'clock. (No. 42b) antidisestablishmentarianism, ÀÉÞß× 99%%"
#: No pair, the rank of what does not merge, bits that number the places of pairs.
_EMPTY, _NEVER, _PLACES = np.uint32(0xFFFFFFFF), np.int32(1 << 30), 18


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs, given by where they start and their sizes, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Merges:
    """Merging of many byte-level runs at once: in each, the pair of least rank, the first of equals,
    until none is left."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        known, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        chars = bytes(range(256)).decode("latin-1").translate(_BYTES)
        try:
            self.inner = np.array([known[c] for c in chars], np.int32)
            self.last = np.array([known[c + "</w>"] for c in chars], np.int32)
            self.made = np.array([known[a + b] for a, b in pairs], np.int32)
            keys = [known[a] << 16 | known[b] for a, b in pairs]
        except KeyError as e:
            raise ValueError("a vocabulary of another kind than lower-cased byte-level pieces with word ends") from e
        self.key, self.rank = np.full(1 << _PLACES, _EMPTY), np.full(1 << _PLACES, _NEVER)
        for r, (key, at) in enumerate(zip(keys, self._place(np.array(keys, np.uint32)).tolist())):
            while self.key[at] != _EMPTY:
                at = (at + 1) & ((1 << _PLACES) - 1)
            self.key[at], self.rank[at] = key, r

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - _PLACES)).astype(np.intp)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of pieces."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = self._place(key)
        found = self.key[at]
        out = np.where(found == key, self.rank[at], _NEVER)
        left = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << _PLACES) - 1)
            found = self.key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.rank[at[left[hit]]]
            left = left[~hit & (found != _EMPTY)]
        return out

    def merged(self, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, their pieces) of runs of one length, which are columns of bytes."""
        piece = self.inner[runs]
        piece[-1] = self.last[runs[-1]]
        rank = self.ranks(piece[:-1].ravel(), piece[1:].ravel()).reshape(len(runs) - 1, runs.shape[1])
        here = np.arange(runs.shape[1])
        while len(rank) and len(here):
            least = rank.min(0)
            if (over := least == _NEVER).any():
                yield here[over], piece[:, over]
                here, piece, rank, least = here[~over], piece[:, ~over], rank[:, ~over], least[~over]
            upto = np.logical_or.accumulate(rank == least, axis=0)  # from the pair's column on
            at, n = len(rank) - upto.sum(0), np.arange(len(here))
            piece = np.where(np.concatenate([np.zeros((1, len(here)), bool), upto[:-1]]), piece[1:], piece[:-1])
            piece[at, n] = self.made[least]
            rank = np.where(upto[:-1], rank[1:], rank[:-1])
            some = np.flatnonzero(at > 0)
            rank[at[some] - 1, some] = self.ranks(piece[at[some] - 1, some], piece[at[some], some])
            some = np.flatnonzero(at < len(rank))
            rank[at[some], some] = self.ranks(piece[at[some], some], piece[at[some] + 1, some])
        if len(here):
            yield here, piece


class Words(dict):
    """Ids of texts, word by word: pieces of this vocabulary never reach over ASCII white space, nor
    does its normaliser, so a text's ids are its words' ids in a row. Distinct words of many texts are
    solved at once; those that only the whole tokenizer can tell are remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.held = 0
        if self.ids(_PROBE.encode()) != self._library(_PROBE.encode()):
            raise ValueError("a vocabulary of another kind than lower-cased byte-level pieces with word ends")

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of one text."""
        return self.laid_out(pa.array([text], pa.binary()))[0][:-1].tobytes()

    def laid_out(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of binary texts end to end, 0 behind each, and how many each text has with that."""
        parts = pc.ascii_split_whitespace(texts.view(pa.string()))
        flat, offsets = parts.flatten(), parts.offsets.to_numpy()
        real = pc.greater(pc.binary_length(flat), 0)
        upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
        told = flat.filter(real).dictionary_encode()
        ids, sizes = self.solve(told.dictionary.cast(pa.binary()))
        ends = upto[1:] + np.arange(len(texts))
        code = np.full(upto[-1] + len(texts), len(sizes), np.int64)
        code[np.delete(np.arange(len(code)), ends)] = told.indices.to_numpy(zero_copy_only=False)
        ids, sizes = np.append(ids, np.uint32(0)), np.append(sizes, 1)
        own = sizes[code]
        out = ids[_spread((np.cumsum(sizes) - sizes)[code], own)]
        return out, np.diff(np.cumsum(own)[ends], prepend=0)

    def solve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and how many each word has."""
        raw, starts, lengths = _bytes(words)
        kind, first = _KIND[raw], np.zeros(len(raw), bool)
        first[starts] = True
        lead, tail = raw == 0xC3, (raw >= 0x80) & (raw < 0xC0)
        # a letter of two bytes is whole and begins in its word
        odd = (kind == 0) | (tail != np.concatenate([[False], lead[:-1]])) | (tail & first)
        odd[starts + lengths - 1] |= lead[starts + lengths - 1]
        upto = np.concatenate([[0], np.cumsum(odd)])
        plain = upto[starts + lengths] == upto[starts]
        kept = np.repeat(plain, lengths)
        raw, kind, first = _LOWER[raw[kept]], kind[kept], first[kept]
        cut = first | (kind == 2)
        cut[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(cut)
        runs = _binary(raw, np.append(at, len(raw))).dictionary_encode()
        run_ids, run_sizes = self._runs(runs.dictionary)
        code = runs.indices.to_numpy(zero_copy_only=False)
        own = run_sizes[code]
        sizes = np.zeros(len(words), np.int64)
        if len(at):
            sizes[plain] = np.add.reduceat(own, np.flatnonzero(first[at]))
        others = [self[w] for w in words.filter(pa.array(~plain)).to_pylist()]
        sizes[~plain] = [len(o) // 4 for o in others]
        out = np.empty(sizes.sum(), np.uint32)
        told = np.repeat(plain, sizes)
        out[told] = run_ids[_spread((np.cumsum(run_sizes) - run_sizes)[code], own)]
        out[~told] = np.frombuffer(b"".join(others), "<u4")
        return out, sizes

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs of letters, marks or a digit end to end, and how many each has."""
        raw, starts, lengths = _bytes(runs)
        sizes, found = np.zeros(len(runs), np.int64), []
        for n in range(1, min(RUN, int(lengths.max(initial=0))) + 1):
            own = np.flatnonzero(lengths == n)
            for k in range(0, len(own), RUNS):
                some = own[k : k + RUNS]
                for here, piece in self.merges.merged(raw[starts[some] + np.arange(n)[:, None]]):
                    sizes[some[here]] = len(piece)
                    found.append((some[here], piece))
        for i in np.flatnonzero(lengths > RUN).tolist():
            told = raw[starts[i] : starts[i] + lengths[i]].tobytes().decode("latin-1").translate(_BYTES)
            piece = np.array([t.id for t in self.tokenizer.model.tokenize(told)])
            sizes[i] = len(piece)
            found.append((np.array([i]), piece[:, None]))
        out, before = np.empty(sizes.sum(), np.uint32), np.cumsum(sizes) - sizes
        for here, piece in found:
            out[before[here] + np.arange(len(piece))[:, None]] = piece
        return out, sizes

    def __missing__(self, word: bytes) -> bytes:
        if self.held > WORDS:
            self.clear()
            self.held = 0
        ids = self[word] = self._library(word)
        self.held += len(word) + len(ids) + 200
        return ids

    def _library(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a dictionary of words end to end, where each starts, and its length."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(words) else np.empty(0, np.uint8)
    return raw, ends[:-1] - ends[0], np.diff(ends)


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _slabs(texts: pa.Array, most: int) -> Iterator[tuple[pa.Array, bool]]:
    """Binary texts in runs of some `most` bytes; longer ones in parts of their own, cut at gaps.

    With each run comes whether its last text ends there.
    """
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(upto, upto[at] + most, "right")) - 1
        if to > at:
            yield texts.slice(at, to - at), True
        else:
            text, lo, to = texts[at].as_py(), 0, at + 1
            while lo < len(text):
                gap = _GAP(text, lo + most)
                hi = gap.end() if gap else len(text)
                yield pa.array([text[lo:hi]], pa.binary()), hi == len(text)
                lo = hi
        at = to


def vocabulary() -> str:
    """Where the vocabulary is found by default, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _solver(path: str) -> Words:
    """One for each worker process, which keeps its words from task to task."""
    return Words(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, ids: bool = False, slab: int = SLAB) -> DataFrame:
    """(key, id, piece, start, length, ids_crc32) of the pieces of every row's text, on request with `ids`.

    A text's ids are followed by id 0; only longer ones are cut, every `capacity` ids. Null and empty
    texts are one piece of one id, repeated rows and null ids have pieces of their own, and an empty
    table has none. `key` is unique as long as the plan runs once: write the table before use.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType)))])
    out = out.add("ids", T.BinaryType()) if ids else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, base = _solver(path or vocabulary()), 0, TaskContext.get().partitionId() << 33
        for b in batches:
            rows, made, i, begun = [], [], 0, []
            for some, whole in _slabs(b.column("text"), slab):
                flat, sizes = words.laid_out(some)
                if begun or not whole:
                    begun.append(flat if whole else flat[:-1])
                    if not whole:
                        continue
                    flat, begun = np.concatenate(begun), []
                    sizes = np.array([len(flat)])
                told, lo = memoryview(flat).cast("B"), 0
                for size in sizes.tolist():
                    for p, at in enumerate(range(0, size, capacity)):
                        own = told[4 * (lo + at) : 4 * (lo + min(at + capacity, size))]
                        rows.append(i)
                        made.append((base + n, p, at, len(own) // 4, zlib.crc32(own), *([own.tobytes()] if ids else [])))
                        n += 1
                    lo, i = lo + size, i + 1
            key, *rest = zip(*made) if made else [()] * (len(out) - 1)
            own_ids = b.column("id").take(pa.array(rows, pa.int64()))
            arrays = [pa.array(key, pa.int64()), own_ids, *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return rows.mapInArrow(run, out)


# -- one block


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # a bit for each free space that some bin has
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            j = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[j].append(i)
        else:
            room, j = capacity, len(bins)
            bins.append([i])
        if room > n:
            with_room[room - n].append(j)
            rooms |= 1 << (room - n)
    return bins


class _Offers:
    """Which open bins hold a length, and a bit for each length that some bin holds."""

    def __init__(self) -> None:
        self.bits, self.holders = 0, defaultdict(set)

    def add(self, j: int, lengths: set[int]) -> None:
        for n in lengths:
            self.holders[n].add(j)
            self.bits |= 1 << n

    def drop(self, j: int, lengths: set[int]) -> None:
        for n in lengths:
            held = self.holders[n]
            held.discard(j)
            if not held:
                self.bits ^= 1 << n

    def best(self, given: int, gap: int) -> int:
        """By how much the longest length exceeds `given`, `gap` at most; 0 if none does."""
        return ((self.bits >> (given + 1)) & ((1 << gap) - 1)).bit_length()


class Search:
    """Local search over bins of item numbers, in place."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.count = len(bins)
        self.least = -(-sum(self.fill) // capacity)

    def run(self) -> list[list[int]]:
        """Sweeps until the bins are as few as their tokens allow or nothing can be exchanged."""
        while self.count > self.least and self.sweep():
            pass
        return [b for b in self.bins if b]

    def _sets(self, j: int) -> tuple[set[int], set[int]]:
        n = [self.lengths[i] for i in self.bins[j]]
        return set(n), {a + b for k, a in enumerate(n) for b in n[:k]}

    def _list(self, j: int, listed: bool) -> None:
        one, two = self._sets(j)
        (self.one.add if listed else self.one.drop)(j, one)
        (self.two.add if listed else self.two.drop)(j, two)

    def sweep(self) -> bool:
        """Every open bin in turn, fullest first, takes from emptier ones what fills it best."""
        self.one, self.two, moved = _Offers(), _Offers(), False
        queue = [(-f, j) for j, f in enumerate(self.fill) if 0 < f < self.capacity]
        for _, j in queue:
            self._list(j, True)
        heapq.heapify(queue)
        done = set()
        while queue and self.count > self.least:
            f, j = heapq.heappop(queue)
            if j in done or -f != self.fill[j]:
                continue  # it has given since; its later entry counts
            done.add(j)
            self._list(j, False)
            while self.fill[j] < self.capacity and (swap := self._swap(j)):
                moved = True
                donor = self._exchange(j, *swap)
                if self.fill[donor]:
                    heapq.heappush(queue, (-self.fill[donor], donor))
                else:
                    self.count -= 1
        return moved

    def _swap(self, j: int) -> tuple[tuple[int, ...], _Offers, int] | None:
        """(given lengths, offers, taken length) that bring a bin closest to its capacity: fewest items first."""
        gap = self.capacity - self.fill[j]
        one, two = self.one, self.two
        most, best = one.best(0, gap), ((), one)
        own = sorted({self.lengths[i] for i in self.bins[j]})
        if most < gap:
            for a in own:
                if (d := one.best(a, gap)) > most:
                    most, best = d, ((a,), one)
                if (d := two.best(a, gap)) > most:
                    most, best = d, ((a,), two)
                if most == gap:
                    break
        if most < gap:
            n = [self.lengths[i] for i in self.bins[j]]
            for pair in {(a, b) for k, a in enumerate(n) for b in n[:k]}:
                if (d := one.best(sum(pair), gap)) > most:
                    most, best = d, (pair, one)
        return (*best, sum(best[0]) + most) if most else None

    def _exchange(self, j: int, given: tuple[int, ...], offers: _Offers, taken: int) -> int:
        """The emptiest bin that offers the length gives it and gets the given ones."""
        donor = min(offers.holders[taken], key=lambda k: (self.fill[k], k))
        self._list(donor, False)
        if offers is self.one:
            out = [self._item(donor, taken)]
        else:
            held = {self.lengths[i] for i in self.bins[donor]}
            a = next(a for a in sorted(held) if taken - a in held and (2 * a != taken or sum(self.lengths[i] == a for i in self.bins[donor]) > 1))
            out = [self._item(donor, a), self._item(donor, taken - a)]
        back = [self._item(j, n) for n in given]
        self.bins[j] += out
        self.bins[donor] += back
        more = taken - sum(given)
        self.fill[j] += more
        self.fill[donor] -= more
        if self.bins[donor]:
            self._list(donor, True)
        return donor

    def _item(self, j: int, length: int) -> int:
        """Takes an item of a length out of a bin."""
        return self.bins[j].pop(next(k for k, i in enumerate(self.bins[j]) if self.lengths[i] == length))


# -- all blocks

_PLACED = "key long, length long, sequence_id long, offset long, fill long"


def _placed(bins: list[list[int]], keys: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    """Places of items, a bin named by the least key in it, its items in the order of their keys."""
    bin_of = np.empty(len(keys), np.int64)
    for j, b in enumerate(bins):
        bin_of[b] = j
    order = np.lexsort((keys, bin_of))
    keys, lengths, bin_of = keys[order], lengths[order], bin_of[order]
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(keys)])
    before = np.cumsum(lengths) - lengths
    offset = before - np.repeat(before[first], sizes)
    fill = np.repeat(np.add.reduceat(lengths, first) if len(first) else first, sizes)
    return pd.DataFrame({"key": keys, "length": lengths, "sequence_id": np.repeat(keys[first], sizes), "offset": offset, "fill": fill})


def _packed(capacity: int):  # noqa: ANN202
    def pack(block: pd.DataFrame) -> pd.DataFrame:
        """A block searched from best fit and, if it has open bins (sequence_id), from these: the fewer bins count."""
        block = block.sort_values(["sequence_id", "key"], ignore_index=True)
        lengths = block["length"].tolist()
        bins = Search(best_fit(lengths, capacity), lengths, capacity).run()
        if block["sequence_id"].notna().all():
            own = Search([g.tolist() for g in block.groupby("sequence_id").indices.values()], lengths, capacity).run()
            bins = min(own, bins, key=len)
        return _placed(bins, block["key"].to_numpy(), block["length"].to_numpy())

    return pack


def place(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> list[DataFrame]:
    """Tables (key, length, sequence_id, offset, fill) that together place every item (key, length).

    Lengths are 1 to `capacity`, keys unique. Items and later open bins go to blocks by hash, some
    `block` items each; a sequence is named by the least key in it. When the open bins fit into one
    block, full ones of the round before fill it up, which gives the search more to exchange. Rounds
    end when the open bins are as few as their tokens allow, when one block has held them all, or
    when a round saves less than WORTH of them. An empty table gives empty tables.
    """
    spark, done = items.sparkSession, []
    count, blocks, before, turn = items.count(), 0, None, 0
    todo = items.select("key", "length", F.lit(None).cast("long").alias("sequence_id"))
    is_open = F.col("fill") < capacity
    while True:
        blocks = -(-count // block) or 1
        by = F.pmod(F.xxhash64(F.coalesce("sequence_id", "key"), F.lit(turn)), F.lit(blocks))
        placed = materialise(todo.withColumn("block", by).groupBy("block").applyInPandas(_packed(capacity), _PLACED), files_for(spark, count))
        tokens = F.coalesce(F.sum(F.when(is_open, F.col("length"))), F.lit(0))
        bins, tokens, opened, count = placed.agg(F.count_if(is_open & (F.col("offset") == 0)), tokens, F.count_if(is_open), F.count("*")).first()
        saved = None if before is None else before - bins
        if blocks == 1 or bins <= -(-tokens // capacity) or (saved is not None and saved <= WORTH * before):
            return [*done, placed]
        if opened < block and count > opened:
            lent = F.pmod(F.xxhash64("sequence_id"), F.lit(-(-(count - opened) // (block - opened)))) == 0
            again = is_open | lent
        else:
            again = is_open
        done.append(placed.filter(~again))
        todo, before, turn = placed.filter(again).select("key", "length", "sequence_id"), bins, turn + 1
        count = opened if again is is_open else min(block, count)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, on request with `ids`.

    Every row's text (null: empty) is packed, repeated rows and rows with null ids each on their own;
    texts of more than `capacity` ids alone are cut. Other columns do not matter, whatever their
    names. An empty table gives no rows.
    """
    whole = materialise(pieces(docs, id_col, text_col, capacity, path, ids))
    short = F.col("length") < capacity
    placed = place(whole.filter(short).select("key", "length"), capacity)
    places = placed[0]
    for p in placed[1:]:
        places = places.union(p)
    rest = [c for c in whole.columns if c != "key"]
    some = whole.filter(short).join(places.select("key", "sequence_id", "offset"), "key").select(*rest, "sequence_id", "offset")
    full = whole.filter(~short).select(*rest, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(some)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>, lengths array<long>) of pieces packed with their ids, in order of offset.

    `lengths` tells where documents begin. A sequence is one group, which its capacity bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(ids, pa.list_(pa.int64())), b.column("lengths")], ["sequence_id", "ids", "lengths"])

    own = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("own"))
    joined = F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    rows = rows.select("sequence_id", joined.alias("ids"), F.transform("own", lambda x: x["length"]).alias("lengths"))
    return rows.mapInArrow(run, "sequence_id long, ids array<long>, lengths array<long>")
