"""SimHash near-duplicates by pivot distance tables.

Every fingerprint has a row of Hamming distances to many reference fingerprints. References come in
families: one at random, and its copies with one of six bit blocks turned over. What a member of a
family is nearer or farther than its first reference is a coordinate of one block alone, so two
fingerprints within three bits agree in all coordinates of at least three blocks: candidates are
those that meet in one of the twenty choices of three. Of these, pairs whose rows differ anywhere by
more than three are discarded by the triangle inequality, and the survivors are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import files_for, fresh, materialise, mix64, need, seeded, words_of
from quillon.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Widths of the six blocks, low bits first; a coordinate on a block goes from 0 to its width.
BLOCKS = (11, 11, 11, 11, 10, 10)
_EDGES = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
_MASKS = np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:])], np.uint64)
FAMILIES = seeded(8, 10)
#: The references: row f has the first of family f, then its copies with a block turned over.
PIVOTS = FAMILIES[:, None] ^ np.concatenate([np.zeros(1, np.uint64), _MASKS])[None, :]
CHOICES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
#: Fingerprints of one bucket that a task compares at once; larger buckets go in block pairs.
#: Buckets are counted beforehand on one fingerprint in SAMPLE; at most KNOWN counts are broadcast.
BUCKET, SAMPLE, KNOWN = 4096, 64, 100_000


def fingerprint(text: str | None, slab: int = 65536) -> int:
    """The 64-bit SimHash of a whole text; 0 if it has no words."""
    words = words_of(text)
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, slab):
        part = words[at : at + slab + width - 1]
        h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(width)))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row.

    Null and empty texts, and texts of blanks alone, have fingerprint zero. Null ids and repeated
    rows keep their rows, extra columns do not matter, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return need(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("t")]).mapInArrow(run, f"id {kind}, fp long")


def table(fps: np.ndarray) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS.ravel()).astype(np.int8)


def keys(fps: np.ndarray) -> np.ndarray:
    """(choices, fingerprints) keys from the distances to the references.

    A block's coordinates under all families, 0 to its width each, are packed to four bits apiece;
    the key of a choice of three blocks is a hash of their codes.
    """
    far = table(fps).reshape(len(fps), *PIVOTS.shape).astype(np.int64)
    near = (far[:, :, :1] - far[:, :, 1:] + np.array(BLOCKS)) // 2
    codes = (near << (4 * np.arange(len(FAMILIES)))[None, :, None]).sum(1).astype(np.uint64)
    out = np.empty((len(CHOICES), len(fps)), np.uint64)
    for c, some in enumerate(CHOICES):
        k = np.full(len(fps), c, np.uint64)
        for b in some:
            k = mix64(k ^ codes[:, b])
        out[c] = k
    return out


def keyed(fps: DataFrame) -> DataFrame:
    """(k, fp): each fingerprint under its twenty keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            k = keys(fp.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.tile(fp, len(k)))], names=["k", "fp"])

    return fps.select("fp").mapInArrow(run, "k long, fp long")


def spanning_edges(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one bucket."""
    rows, out, alive = table(fps), [], np.arange(len(fps))
    while len(alive):
        root, alive = alive[0], alive[1:]
        stack = [root]
        while stack and len(alive):
            u = stack.pop()
            near = (np.abs(rows[alive] - rows[u]) <= RADIUS).all(1)
            near[near] = np.bitwise_count(fps[alive[near]] ^ fps[u]) <= RADIUS
            hit = alive[near]
            if len(hit):
                out += [(int(fps[v]), int(fps[root])) for v in hit]
                stack += hit.tolist()
                alive = alive[~near]
    return out


def _link(limit: int | None):
    """Reads rows sorted by bucket (k) and pair of its parts (p); gives edges (kind 0) and, of uncut buckets (p = 0) beyond the limit, the rows (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_key, spilling = np.empty(0, np.int64), None, False

        def close(fps: np.ndarray) -> list[tuple[int, int]]:
            return spanning_edges(np.unique(fps).view(np.uint64)) if len(fps) > 1 else []

        def frame(edges: list, k: int, rows: np.ndarray) -> pd.DataFrame:
            a = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({
                "kind": np.repeat([0, 1], [len(a), len(rows)]).astype(np.int32), "k": np.int64(k), "u": np.concatenate([a[:, 0], rows]), "v": np.concatenate([a[:, 1], rows]),
            })

        for b in batches:
            at, fps = b[["k", "p"]].to_numpy(np.int64), b["fp"].to_numpy(np.int64)
            if not len(fps):
                continue
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            edges: list[tuple[int, int]] = []
            # buckets of one row that neither begin nor end the batch need no look
            wide = (ends - starts) > 1
            wide[0] = wide[-1] = True
            for s, e in zip(starts[wide], ends[wide]):
                key = tuple(at[s])
                if key != held_key:
                    edges += close(held)
                    held, held_key, spilling = np.empty(0, np.int64), key, False
                held = np.concatenate([held, fps[s:e]])
                if limit and key[1] == 0 and (spilling or len(held) > limit):
                    yield frame([], key[0], held)
                    held, spilling = np.empty(0, np.int64), True
                elif not limit or key[1]:
                    held = np.unique(held)
            if edges:
                yield frame(edges, 0, np.empty(0, np.int64))
        if len(held) > 1:
            yield frame(close(held), 0, np.empty(0, np.int64))

    return run


def _dealt(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.repartition("k", "p").sortWithinPartitions("k", "p").mapInPandas(_link(limit), "kind int, k long, u long, v long")


def _pairs(n: Column) -> Column:
    """The pairs of a bucket's n parts (by hash) that a fingerprint's own part is in, from 1 on."""
    mine = F.pmod(F.xxhash64("fp"), n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: 1 + F.least(mine, b) * n + F.greatest(mine, b))


def _parts(count: Column) -> Column:
    return F.ceil(count / (BUCKET // 2)).cast("long").alias("n")


def links(fps: DataFrame, files: int | None = None) -> DataFrame:
    """Edges (u, v) that connect exactly the classes of the link relation over distinct `fp`.

    Emits a forest for each bucket, not its pairs. Buckets are counted on one fingerprint in SAMPLE
    before any is dealt out; a large one is cut into parts by hash, and every pair of its parts is a
    task of bounded size. A large bucket that the sample did not show is found while it is read, and
    is then cut in the same way, so no link is lost.
    """
    some = keyed(fps.filter(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(SAMPLE)) == 0)).groupBy("k").agg((F.count("*") * SAMPLE).alias("m"))
    large = materialise(some.filter(F.col("m") >= BUCKET // 2).select("k", _parts(F.col("m"))), 1)
    rows, found = keyed(fps), large.count()
    if found:
        met = rows.join(F.broadcast(large) if found <= KNOWN else large.hint("merge"), "k", "left")
        alone = F.array(F.lit(0).cast("long"))
        dealt = met.select("k", "fp", F.explode(F.when(F.col("n").isNull(), alone).otherwise(_pairs(F.col("n")))).alias("p"))
    else:
        dealt = rows.withColumn("p", F.lit(0).cast("long"))
    first = materialise(_dealt(dealt, BUCKET), files)
    over = first.filter("kind = 1").select("k", F.col("u").alias("fp"))
    if over.isEmpty():
        return first.select("u", "v")
    parts = materialise(over.groupBy("k").agg(_parts(F.count("*"))), files)
    again = over.join(parts, "k").select("k", "fp", F.explode(_pairs(F.col("n"))).alias("p"))
    return first.filter("kind = 0").select("u", "v").union(_dealt(again, None).select("u", "v"))


def _rooted(rows: DataFrame) -> DataFrame:
    """(fp, root, component) of distinct fingerprints of rows (id, fp); root names the class."""
    spark, count = rows.sparkSession, rows.count()
    files, wide = files_for(spark, count), files_for(spark, count * len(CHOICES), 500_000)
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("rep")), files)
    roots = materialise(connected_components(links(distinct.select("fp"), wide), files), files)
    rooted = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), files)
    least = materialise(rooted.groupBy("root").agg(F.min("rep").alias("component")), files)
    return materialise(rooted.join(least, "root").select("fp", "root", "component"), files)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): every row with its fingerprint and the least id of its class.

    Fingerprints link at RADIUS or fewer differing bits; a class is what links reach. Copies share
    a fingerprint and are linked once, through it. Texts without words have fingerprint zero and
    link like any other. Rows with a null id keep a row; a class of null ids only has a null
    component. Empty tables give no rows.
    """
    rows = materialise(fingerprints(docs, id_col, text_col))
    return rows.join(_rooted(rows), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """documents without near-duplicates: exactly one row of each class stays, columns unchanged.

    That is the row of least doc_id, null ids last, then of least text digest. Rows of one id whose
    texts are in different classes are judged apart; rows that repeat id and text stay once. Null
    texts count as empty. An empty table gives no rows.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    key, told = fresh(docs, "digest"), fresh(docs, "kept_id")
    # the digest rides along as part of the id, so that texts need not be read again
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", digest.alias("digest")).alias("id"), "text")
    rows = materialise(fingerprints(named, "id"))
    kept = materialise(rows.join(_rooted(rows), "fp").groupBy("root").agg(F.min("id").alias("id")).select(F.col("id.doc_id").alias(told), F.col("id.digest").alias(key)))
    # kept ids grow with the documents, so the join is a shuffled one at every size
    marked = docs.withColumn(f"{key}_", digest)
    left = marked.join(kept.hint("merge"), marked["doc_id"].eqNullSafe(kept[told]) & (marked[f"{key}_"] == kept[key]), "left_semi")
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return left.select(*docs.columns)
    return left.dropDuplicates(["doc_id", f"{key}_"]).select(*docs.columns)
