"""Vector codes: integer parts, equal ones together, under small codebooks made by weighted Lloyd rounds.

A vector's components become integers and are cut into parts. Equal parts of a position are one
weighted row; only these take part in the rounds. Codes and errors are joined back to the vectors.
All arithmetic is in integers, so that results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: Integer steps of 1.0, parts of a vector, entries of a codebook, Lloyd rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances are held at once.
_ROWS = 2048
_EXACT = 1 << 53


def largest(dim: int) -> int:
    """The largest component for which a vector's squared error cannot outgrow 63 bits."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(row, id, label, parts array<binary>): vectors that take part, each part as little-endian 64-bit integers.

    Null and empty vectors and those with null or non-finite components are dropped; so are those
    that are not of the commonest length, the lesser one of equals. Components are floor(SCALE * x),
    held at largest() of either sign, beyond which errors would not fit their type. Where a length is
    no multiple of `parts` the first ones are longer by one. Rows with null or repeated ids stay.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).filter("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))")
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common.dim if common else 0
    size, rest = divmod(dim, parts)
    begins = [sum(size + (j < rest) for j in range(k)) for k in range(parts + 1)]
    most = largest(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
            ints = np.clip(np.floor(np.clip(flat, -1e300, 1e300) * SCALE), -most, most).astype("<i8")
            own = [[ints[i, a:z].tobytes() for a, z in zip(begins, begins[1:])] for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(own, pa.list_(pa.binary()))], ["id", "label", "parts"])

    kinds = dict(vectors.dtypes)
    kept = rows.filter(F.size("v") == dim).mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, parts array<binary>")
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", "parts")


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers to entries, exact; by matrix product where doubles hold them."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * top * top < _EXACT:
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - book[None, :, k]
        out += d * d
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties go to the lower entry."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), _ROWS):
        d = distances(x[at : at + _ROWS], book)
        best = d.argmin(1)
        code[at : at + _ROWS], error[at : at + _ROWS] = best, d[np.arange(len(d)), best]
    return code, error


def _matrix(values: pa.Array) -> np.ndarray:
    own = values.to_pylist()
    return np.frombuffer(b"".join(own), "<i8").reshape(len(own), -1)


def first_books(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """Every position's codebook: that part of the vectors of least id, ties by their parts, null ids last."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "parts").select("parts").limit(entries).collect()
    return [np.stack([np.frombuffer(r.parts[j], "<i8") for r in rows]) if rows else np.empty((0, 0), np.int64) for j in range(parts)]


def step(weighted: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after a round: floors of weighted means; entries that nothing is nearest to stay.

    Each task sums what it holds of an entry; sums of a fixed number of entries reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            position, weight = b.column("position").to_numpy(), b.column("weight").to_numpy()
            for j in np.unique(position).tolist():
                at = np.flatnonzero(position == j)
                x, w = _matrix(b.column("part").take(pa.array(at))), weight[at]
                code, _ = nearest(x, books[j])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                total, n = np.add.reduceat(x[order] * w[order, None], first), np.add.reduceat(w[order], first)
                for c, t, k in zip(code[order][first].tolist(), total, n.tolist()):
                    held = sums.setdefault((j, c), [0, 0])
                    held[0], held[1] = held[0] + t.astype(object), held[1] + k
        rows = [(j, c, i, str(v), n) for (j, c), (t, n) in sums.items() for i, v in enumerate(t)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["position", "entry", "component", "total", "n"])

    told = weighted.mapInArrow(run, "position int, entry int, component int, total string, n long")
    told = told.groupBy("position", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    books = [b.copy() for b in books]
    for r in told.collect():
        books[r.position][r.entry, r.component] = int(r.total) // r.n
    return books


def assigned(weighted: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(position, part, code, error) of every distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            position = b.column("position").to_numpy()
            code, error = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for j in np.unique(position).tolist():
                at = np.flatnonzero(position == j)
                code[at], error[at] = nearest(_matrix(b.column("part").take(pa.array(at))), books[j])
            yield pa.RecordBatch.from_arrays([b.column("position"), b.column("part"), pa.array(code), pa.array(error)], ["position", "part", "code", "error"])

    return weighted.select("position", "part").mapInArrow(run, "position int, part binary, code long, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error, label_error), codebooks) of the vectors that integers() keeps.

    `code` has two hex digits for each part, `error` sums the parts' squared distances, `label_error`
    the errors of rows with an equal label, nulls together. An empty table gives no rows and empty
    codebooks. Parts are counted where they are read and joined back between plain exchanges, so
    one vector on a third of all rows is one row of each round and a join that can be split.
    """
    kept = materialise(integers(vectors, id_col, vector_col, label_col, parts))
    books = first_books(kept, entries, parts)
    each = kept.select("row", F.posexplode("parts").alias("position", "part"))
    weighted = materialise(each.groupBy("position", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        books = step(weighted, books)
    coded = materialise(assigned(weighted, books))
    digits = F.collect_list(F.struct("position", F.lower(F.lpad(F.hex("code"), 2, "0")).alias("d")))
    code = F.array_join(F.transform(F.sort_array(digits), lambda x: x["d"]), "")
    rows = each.join(coded.hint("merge"), ["position", "part"]).groupBy("row").agg(code.alias("code"), F.sum("error").alias("error"))
    told = materialise(kept.select("row", "id", "label").join(rows.hint("merge"), "row").drop("row"))
    by_label = told.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = told.join(by_label, told["label"].eqNullSafe(by_label["of"])).select("id", "label", "code", "error", "label_error")
    return out, books
