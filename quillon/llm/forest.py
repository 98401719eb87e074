"""Approximate nearest neighbours: a forest of random-projection trees with one shared queue.

Trees are fitted on a bounded sample; every vector is then indexed in every tree. A query walks
all trees through one priority queue of splits, nearest margin first, until it has opened its
number of leaves; members of these leaves are ranked by exact distance.

Vectors are dealt to blocks, each vector once, with the leaves that hold it. Queries visit the
blocks with the leaves that they have opened, as bits, and take from each block its nearest members
of these leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: Production parameters. SAMPLE bounds what the trees are fitted on (a share of the rows by id hash); a query
#: opens the share OPEN of all leaves, LEAST at least, which nearly isotropic vectors need for a recall of 0.9.
#: LEAF is a leaf's size in the table; the sample's leaves are smaller by its share, so trees deepen with the table.
TREES, LEAF, OPEN, LEAST, SAMPLE, SEED = 10, 128, 0.1, 64, 65536, 9
#: Leaves of a tree (twice as many at most) and numbers of the sample, at most: a query carries a bit for each leaf and every task
#: holds all splits, so neither may grow with the table. Recall rests on the share of leaves, not on their size.
LEAVES, SAMPLE_NUMBERS = 1024, 8_000_000
#: Numbers (rows times width) and rows of a block, at most, and queries that a task compares with it at once.
BLOCK, BLOCK_ROWS, CHUNK = 8_000_000, 131_072, 64


@dataclass
class Tree:
    """Node i splits by normals[i] . x >= offsets[i]; children below 0 are leaves, -1 - leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int


def fit_tree(sample: np.ndarray, leaf: int, seed: int) -> Tree:
    """Splits at medians, along lines through two random rows, until a node has at most `leaf` rows."""
    rng = np.random.default_rng(seed)
    normals, offsets, left, right, leaves = [], [], [], [], 0
    todo: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(sample)), -1, False)]
    while todo:
        rows, parent, is_right = todo.pop()
        me = None
        if len(rows) > leaf:
            one, two = rng.choice(len(rows), 2, replace=False)
            normal = sample[rows[one]] - sample[rows[two]]
            normal /= np.linalg.norm(normal) or 1.0
            along = sample[rows] @ normal
            offset = float(np.median(along))
            side = along >= offset
            if side.any() and not side.all():
                me = len(normals)
                normals.append(normal)
                offsets.append(offset)
                left.append(0)
                right.append(0)
                todo += [(rows[~side], me, False), (rows[side], me, True)]
        if me is None:
            me, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            (right if is_right else left)[parent] = me
    dim = sample.shape[1] if sample.size else 1
    return Tree(np.array(normals, np.float32).reshape(-1, dim), np.array(offsets), np.array(left, int), np.array(right, int), leaves)


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector."""
    at = np.zeros(len(vectors), int) if len(tree.normals) else np.full(len(vectors), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        up = np.einsum("ij,ij->i", vectors[inner], tree.normals[node]) >= tree.offsets[node]
        at[inner] = np.where(up, tree.right[node], tree.left[node])
    return -1 - at


def probes(forest: list[Tree], v: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The first `count` (tree, leaf) that one shared queue opens, least margin first."""
    out: list[tuple[int, int]] = []
    margins = [t.normals @ v - t.offsets for t in forest]
    queue = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    while queue and len(out) < count:
        far, k, node = heapq.heappop(queue)
        t = forest[k]
        while node >= 0:
            m = margins[k][node]
            near, other = (t.right[node], t.left[node]) if m >= 0 else (t.left[node], t.right[node])
            heapq.heappush(queue, (max(far, abs(m)), k, int(other)))
            node = int(near)
        out.append((k, -1 - node))
    return out


def scale_of(*groups: np.ndarray) -> float:
    """A power of two that brings the largest component near 1 where squares could overflow or vanish, else 1."""
    top = max((float(np.abs(g).max(initial=0)) for g in groups), default=0.0)
    return 1.0 if top == 0 or 1e-140 < top < 1e140 else float(2.0 ** -np.frexp(top)[1].clip(-1000, 1000))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that can take part: finite, not null, not zero."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    good = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    return rows.filter(good)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64).reshape(len(col), -1)


def _common_length(rows: DataFrame) -> int | None:
    """The length that most vectors have, the least of equals; None for an empty table."""
    best = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return None if best is None else best["d"]


def search(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, leaf: int = LEAF, opened: float = OPEN, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id `every` divides.

    score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that
    are null, zero, or hold null or non-finite components take no part; neither do those of another
    length than the commonest (the least of equally common ones). Copies of a vector are indexed
    once, with their k + 1 least ids: no query can return more of them. Repeated rows are each a
    candidate, but not for their own id, which is asked once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vector_col))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = _common_length(rows)
    if width is None:
        return empty
    rows = rows.filter(F.size("v") == width)
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    held = materialise(few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    count = held.count()
    share = min(1.0, 0.95 * min(SAMPLE, SAMPLE_NUMBERS // width) / count)
    picked = held.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("id", "v").toArrow().sort_by("id")
    sample = picked["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(picked.num_rows, -1)
    scale = scale_of(sample)
    forest = [fit_tree(sample * scale, max(2, int(leaf * share), -(-len(sample) // LEAVES)), SEED * 1000 + i) for i in range(trees)]
    known = spark.sparkContext.broadcast(forest)
    ends = np.concatenate([[0], np.cumsum([t.leaves for t in forest])])
    opening = max(LEAST, int(np.ceil(opened * ends[-1])))
    each = max(1, min(BLOCK_ROWS, BLOCK // width))
    blocks = max(-(-count // each), min(spark.sparkContext.defaultParallelism, -(-count // 1024)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            leaves = np.stack([ends[t] + leaves_of(tree, x * scale) for t, tree in enumerate(known.value)], axis=1) if len(b) else []
            yield pd.DataFrame({"block": b["block"], "id": b["id"], "v": b["v"], "leaves": [r.astype(np.int32).tobytes() for r in leaves], "q": False})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["v"]:
                bits = np.zeros(ends[-1], bool)
                bits[[ends[t] + n for t, n in probes(known.value, np.asarray(v, float) * scale, opening)]] = True
                out.append(np.packbits(bits).tobytes())
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "leaves": out})

    vector = dict(held.dtypes)["v"]
    members = held.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v").mapInPandas(index, f"block int, id long, v {vector}, leaves binary, q boolean")
    # queries with equal vectors are searched once, by the least id
    asks = materialise(rows.filter(F.col("id") % every == 0).groupBy("v").agg(F.min("id").alias("id")))
    questions = materialise(asks.select("id", "v").mapInPandas(probe, f"id long, v {vector}, leaves binary"))
    visits = questions.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", "leaves", F.lit(True).alias("q"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, own = None, [], None
        for b in batches:
            for block, part in b.groupby("block", sort=False):
                if block != now:
                    now, parts, own = block, [], None
                mine, asked = part[~part["q"]], part[part["q"]]
                if len(mine):
                    parts.append((mine["id"].to_numpy(), _matrix(mine["v"]), np.frombuffer(b"".join(mine["leaves"]), np.int32).reshape(len(mine), -1)))
                if len(asked) and (parts or own):
                    if own is None:
                        own, parts = [np.concatenate(c) for c in zip(*parts)], []
                    yield _nearest(asked["id"].to_numpy(), _matrix(asked["v"]), asked["leaves"].tolist(), *own, k + 1)

    dealt = members.unionByName(visits).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "q", "id")
    found = dealt.mapInPandas(compare, "ask long, rep long, score double")
    # a query's best k + 1 vectors, then their ids, then every query id that shares its vector
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy("score", "rep"))).filter(F.col("r") <= k + 1)
    best = best.join(held.select(F.col("id").alias("rep"), "ids"), "rep").select("ask", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    same = asks.select(F.col("id").alias("ask"), "v").join(rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").distinct(), "v").select("ask", "query_id")
    pairs = same.join(best, "ask").filter("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(asks: np.ndarray, q: np.ndarray, opened: list[bytes], ids: np.ndarray, x: np.ndarray, leaves: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest members of each query's leaves; a rough matrix product picks those measured exactly.

    Huge or tiny components are brought near 1 by a power of two first, which changes no distance.
    """
    out, scale = [], scale_of(q, x)
    q, x = q * scale, x * scale
    norms = np.einsum("ij,ij->i", x, x)
    for at in range(0, len(q), CHUNK):
        some = q[at : at + CHUNK]
        rough = norms - 2 * some @ x.T + np.einsum("ij,ij->i", some, some)[:, None]
        slack = 1e-9 * (1 + norms.max())
        for i in range(len(some)):
            bits = np.unpackbits(np.frombuffer(opened[at + i], np.uint8)).view(bool)
            member = np.flatnonzero(bits[leaves].any(1))
            if not len(member):
                continue
            own = rough[i, member]
            edge = np.partition(own, min(k, len(own)) - 1)[min(k, len(own)) - 1] + slack
            near = member[own <= edge]
            exact = np.sqrt(((some[i] - x[near]) ** 2).sum(1)) / scale
            first = np.lexsort((ids[near], exact))[:k]
            out.append(pd.DataFrame({"ask": asks[at + i], "rep": ids[near[first]], "score": exact[first]}))
    return pd.concat(out) if out else pd.DataFrame({"ask": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)})
