"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A fingerprint is a sum of one wide vector for each paragraph (line): four 64-bit lanes of its
BLAKE2b digest, summed modulo 2**64, and 128 lanes in which every 16-byte gram of the paragraph
counts +1 or -1 in one lane, summed modulo 2**32 (no text Spark holds has 2**31 grams). Sums do not
depend on order; a paragraph is put in or taken out by adding or subtracting its vector. The first
lanes decide equality; the second are a count sketch, whose normalised inner product estimates how
much two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, mix64, partitions

LANES = 128
GRAM = 16
_SLAB = 1 << 20
#: Characters of a range of documents, most ranges, tasks that read them, and sampled keys for each.
RANGE, MOST, WRITERS, EACH = 1 << 24, 200_000, 50_000, 32


def _sketch(data: bytes) -> np.ndarray:
    padded = np.frombuffer(data.replace(b"\n", b"\0" * (GRAM - 1) + b"\n") + b"\0" * GRAM, np.uint8)
    out, n = np.zeros(LANES, np.int64), len(padded) - GRAM
    for at in range(0, n, _SLAB):
        part = padded[at : min(at + _SLAB, n) + GRAM]
        grams = np.lib.stride_tricks.sliding_window_view(part, 8)
        eight = np.ascontiguousarray(grams).view("<u8").ravel()
        m = min(at + _SLAB, n) - at
        starts = np.flatnonzero((part[:m] != 0) & (part[:m] != 10))
        with np.errstate(over="ignore"):
            h = mix64(eight[starts] * np.uint64(0x9E3779B97F4A7C15) + eight[starts + 8])
        lane = (h >> np.uint64(57)).astype(np.intp)
        out += np.bincount(lane, np.where(h & np.uint64(1), 1.0, -1.0), LANES).astype(np.int64)
    return out


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The vector sum of a text's paragraphs: (4 lanes modulo 2**64, LANES modulo 2**32)."""
    data = text.encode("utf-8", "replace")
    digests = b"".join(hashlib.blake2b(p, digest_size=32).digest() for p in data.split(b"\n"))
    return np.frombuffer(digests, "<u8").reshape(-1, 4).sum(0, dtype=np.uint64), _sketch(data).astype("<u4")


def encode(v: tuple[np.ndarray, np.ndarray]) -> str:
    return v[0].astype("<u8").tobytes().hex() + v[1].astype("<u4").tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[:32], "<u8"), np.frombuffer(raw[32:], "<u4")


def add(a: str, b: str) -> str:
    """The fingerprint of the paragraphs of both."""
    (x, y), (p, q) = decode(a), decode(b)
    with np.errstate(over="ignore"):
        return encode((x + p, y + q))


def subtract(a: str, b: str) -> str:
    """The fingerprint of a's paragraphs without b's."""
    (x, y), (p, q) = decode(a), decode(b)
    with np.errstate(over="ignore"):
        return encode((x - p, y - q))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal multisets, else the share of grams in common as the sketches estimate it."""
    if (a[0] == b[0]).all():
        return 1.0
    x, y = a[1].view(np.int32).astype(float), b[1].view(np.int32).astype(float)
    whole = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / whole))) if whole else 0.0


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; null counts as empty, which is one empty paragraph."""
    return encode(vector(text or ""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row.

    Null texts count as empty, which is one empty paragraph. Null ids and repeated rows keep their
    rows, extra columns do not matter, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fingerprint string")


def _bounds(rows: DataFrame, ranges: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, hashes of null ids) that part rows (id, h) into about so many ranges, from a sample by hash of EACH rows for each range."""
    share = min(1.0, EACH * ranges / max(count, 1))
    held = rows.filter(F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) < share * (1 << 30)).toArrow()
    every = EACH if share < 1 else max(1, held.num_rows // ranges)
    h, missing = held["h"].to_numpy(), held["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    ids = held["id"].drop_null().cast(pa.int64()).to_numpy()
    order = np.lexsort((h[~missing], ids))[every - 1 :: every]
    return ids[order], h[~missing][order], np.sort(h[missing])[every - 1 :: every]


def _places(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pa.Array, h: np.ndarray) -> np.ndarray:
    """The range of each row: null ids first, by hash; then by id and, where bounds share the id, by hash."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    own = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    lo, hi = np.searchsorted(bounds[0], own, "left"), np.searchsorted(bounds[0], own, "right")
    for i in np.flatnonzero((hi > lo) & ~missing):
        lo[i] += np.searchsorted(bounds[1][lo[i] : hi[i]], h[i], "right")
    return np.where(missing, np.searchsorted(bounds[2], h, "right"), len(bounds[2]) + 1 + lo).astype(np.int64)


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (b, id, t, lent), sorted by (id, a hash of the text, text) within ranges b of these.

    A range's last row, marked lent, is a copy of the first row of the next range (the last range's:
    of the first), so that every row's successor stands behind it without a global sort. Ranges grow
    in number with the characters of the table and part the rows of one id, too. A few keys for each
    range reach the driver, and no text. Rows with null ids come first, in ranges of their own. Ids
    are integers. A table without rows has none here.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t").cast("long")), F.lit(0))).first()
    ranges = max(2 * partitions(spark), min(MOST, -(-size // RANGE)))
    keys = materialise(rows.select("id", "h"))
    bounds = spark.sparkContext.broadcast(_bounds(keys, ranges, count))
    kind = dict(docs.dtypes)[id_col]

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = pa.table({"b": _places(bounds.value, b.column(0), b.column(1).to_numpy()), "id": b.column(0), "h": b.column(1)})
            least = held.sort_by([("b", "ascending"), ("id", "ascending"), ("h", "ascending")]).group_by("b", use_threads=False).aggregate([("id", "first"), ("h", "first")])
            yield from least.rename_columns(["b", "id", "h"]).combine_chunks().to_batches()

    heads = keys.mapInArrow(first_keys, f"b long, id {kind}, h long").groupBy("b").agg(F.min(F.struct("id", "h")).alias("k")).collect()
    heads = sorted((r["b"], r["k"]["id"], r["k"]["h"]) for r in heads)
    lent = {(i, h): heads[n - 1][0] for n, (_, i, h) in enumerate(heads)}
    first_hash = spark.sparkContext.broadcast((lent, np.array(sorted({h for _, h in lent}), np.int64)))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lent, hashes = first_hash.value
        for b in batches:
            ids, h, n = b.column(0), b.column(2).to_numpy(), b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_places(bounds.value, ids, h)), ids, b.column(1), b.column(2), pa.array(np.zeros(n, bool))], names=names)
            maybe = np.flatnonzero(np.isin(h, hashes)).tolist()
            again = [k for k in maybe if (ids[k].as_py(), int(h[k])) in lent]
            if again:
                some = b.take(pa.array(again))
                to = pa.array([lent[i, int(x)] for i, x in zip(some.column(0).to_pylist(), some.column(2).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([to, some.column(0), some.column(1), some.column(2), pa.array(np.ones(len(again), bool))], names=names)

    names = ["b", "id", "t", "h", "lent"]
    placed = rows.select("id", "t", "h").mapInArrow(copy, f"b long, id {kind}, t string, h long, lent boolean")
    tasks = min(ranges + 1, WRITERS)
    task = F.floor(F.col("b") * tasks / (ranges + 2)).cast("int") if tasks < ranges + 1 else F.least(F.col("b"), F.lit(tasks - 1)).cast("int")
    return placed.repartitionById(tasks, task).sortWithinPartitions("b", "lent", "id", "h", "t").select("b", "id", "t", "lent")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text is the text with its last quarter (rounded down, code points) replaced by as
    much of the beginning of the next text by id, or by all of that if it is shorter. Ties in the
    id go by a hash of the text, so that rows of one id are parted like others; null ids come first.
    A table of one row is its own successor; an empty one gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, id, text, vector
        took = False
        for batch in batches:
            out = []
            for b, i, t, lent in zip(*(batch.column(k).to_pylist() for k in range(4))):
                same = held is not None and held[0] == b
                if lent and not (same and not took):
                    continue
                v = vector(t)
                if same:
                    _, hid, text, own = held
                    k = len(text) // 4
                    edited = text[: len(text) - k] + t[:k]
                    e = vector(edited) if k else own
                    out.append((hid, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(own), encode(e), likeness(own, e), likeness(own, v)))
                took = bool(lent)
                held = (b, i, t, v)
            if out:
                columns = [list(c) for c in zip(*out)]
                kinds = [batch.schema.field(1).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_EDITS)

    kind = dict(docs.dtypes)[id_col]
    types = (kind, "long", "string", "string", "string", "double", "double")
    return in_order_with_next(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_EDITS, types)))


_EDITS = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
