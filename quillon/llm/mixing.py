"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents lie in hash blocks of some ten thousand words. A source's target, in words,
becomes an exact quota of block draws: whole passes over its blocks, then blocks in a permuted order
until the target is reached, the last one in part. A tree splits the quotas of all sources among the
output shards: every node deals its draws to its two halves as if drawn without replacement from one
urn. A shard then owns disjoint runs of each source's permuted blocks and shuffles its rows locally.

Blocks grow in number with the words of their source. All tables of blocks, quotas and shards are
distributed; the driver sees histograms of fixed size and a few sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import fresh, materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = Fraction(3, 2), 2
#: Words and documents that a block holds on average, at most.
BLOCK_WORDS, BLOCK_DOCS = 32_768, 4_096
#: Levels of the tree that one task splits, cells of a histogram, tasks that write shards, rows of a
#: table up to which it is broadcast, and rows of a range that one task numbers.
LEVELS, CELLS, WRITERS, KNOWN, RANGE = 6, 4096, 100_000, 100_000, 100_000
SEED = 20


def split_quotas(quotas: np.ndarray, lo: int, hi: int, levels: int, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, start, quota) of the nodes `levels` below the node of shards [lo, hi), or of its leaves.

    Every node deals its draws to its halves by a multivariate hypergeometric draw. start counts
    what earlier shards have of each source, so a node's draws are places [start, start + quota).
    """
    stack = [(lo, hi, levels, np.zeros(len(quotas), np.int64), np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, left, start, held = stack.pop()
        if hi - lo == 1 or not left:
            yield lo, hi, start, held
            continue
        mid, total = (lo + hi) // 2, int(held.sum())
        sample = round(Fraction(total * (mid - lo), hi - lo))
        dealt = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, sample, method="marginals") if total else held * 0
        stack += [(mid, hi, left - 1, start + dealt, held - dealt), (lo, mid, left - 1, start, dealt)]


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, h): words of each text and a hash of id and text that fixes the document's place.

    A row for each row; null and empty texts have size 0, null ids are told apart by their texts, and
    an empty table has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in b.column(3)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), b.column(2)], names=["id", "source", "size", "h"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), place_hash(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, source string, size long, h long")


def place_hash(document: Column, text: Column) -> Column:
    """Rows of one id, or of none, are cut apart by their texts; only copies of a row share a place."""
    return F.xxhash64(F.lit(SEED), document, text)


def known(df: DataFrame, rows: int) -> DataFrame:
    """A table for the small side of a join: broadcast if its rows, which are counted, are few, else shuffled."""
    return F.broadcast(df) if rows <= KNOWN else df.hint("merge")


def numbered(df: DataFrame, count: int, *order: Column) -> DataFrame:
    """The rows with their number s from 0 in an order that has no ties: a range for every RANGE rows,
    a place in each, and the rows of the ranges before."""
    spark, parts = df.sparkSession, -(-count // RANGE)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long") - 1
    if parts == 1:
        return df.withColumn("part", F.lit(0)).select(*df.columns, place.alias("s"))
    ranges = materialise(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))  # a row for each range
    return ranges.join(offsets, "part").select(*df.columns, (F.col("before") + place).alias("s"))


def level(sources: DataFrame, total: Fraction) -> Fraction:
    """The water level: the sum of min(level * weight, LIMIT * words) over sources (words, weight) is `total`.

    Sources fill up in order of r = LIMIT * words / weight. Where there are more than CELLS of them,
    a histogram of r finds the cell in which the level lies, and the sources of that cell are cut
    again; what is left is solved one by one.
    """
    rows = sources.filter("words > 0").select(F.col("words"), F.col("weight"), (F.col("words") * LIMIT / F.col("weight")).alias("r"))
    count, lo, hi, above = rows.agg(F.count("*"), F.min("r"), F.max("r"), F.sum("weight")).first()
    full = 0
    while count > CELLS and lo < hi:
        cell = F.floor((F.col("r") - lo) / (hi - lo) * CELLS)
        cells = sorted(tuple(r) for r in rows.groupBy(cell.alias("c")).agg(F.min("r"), F.max("r"), F.sum("words"), F.sum("weight"), F.count("*")).collect())
        for k, (_, lo, hi, words, weight, count) in enumerate(cells):
            if full + LIMIT * words + Fraction(hi) * (above - weight) >= total or k == len(cells) - 1:
                break
            full, above = full + LIMIT * words, above - weight
        rows = materialise(rows.filter((F.col("r") >= lo) & (F.col("r") <= hi)), 1)
    left = rows.select("r", "words", "weight") if lo != hi else rows.groupBy("r").agg(F.sum("words"), F.sum("weight"))
    for r, words, weight in sorted(map(tuple, left.collect())):
        if (total - full) <= Fraction(r) * above or above == weight:
            break
        full, above = full + LIMIT * words, above - weight
    return (total - full) / above if above else Fraction(0)


@dataclass
class Mixture:
    """What decides every draw: `sources` (source, words, target, bits, passes, cut_h), `blocks`
    (source, b, draws of (c, shard, part)), their numbers of rows, and the number of shards."""

    sources: DataFrame
    blocks: DataFrame
    rows: tuple[int, int]
    shards: int
    seed: int

    def drawn(self, rows: DataFrame, source: str, h: str, out: str) -> DataFrame:
        """Rows with (source_size, target, draws) as the struct `out`; draws has (shard, place) for each time a row is taken."""
        b, d = fresh(rows, "block"), fresh(rows, "mixture")
        s = self.sources.select(F.struct("source", "words", "target", "bits", "cut_h").alias(d))
        with_source = rows.join(known(s, self.rows[0]), rows[source].eqNullSafe(F.col(f"{d}.source"))).withColumn(b, _block(F.col(h), F.col(f"{d}.bits")))
        t = f"{d}_"
        blocks = self.blocks.select(F.struct("source", "b", "draws").alias(t))
        both = with_source.join(known(blocks, self.rows[1]), rows[source].eqNullSafe(F.col(f"{t}.source")) & (F.col(b) == F.col(f"{t}.b")), "left")
        mine = F.filter(F.coalesce(F.col(f"{t}.draws"), F.array().cast("array<struct<c:int,shard:int,part:boolean>>")), lambda x: ~x["part"] | (F.col(h) <= F.col(f"{d}.cut_h")))
        place = lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.lit(self.seed), F.col(h), x["c"]).alias("place"))
        told = F.struct(F.col(f"{d}.words").alias("source_size"), F.col(f"{d}.target").alias("target"), F.transform(mine, place).alias("draws"))
        return both.withColumn(out, told).select(*rows.columns, out)


def _block(h: Column, bits: Column) -> Column:
    """The first bits of a hash; Java shifts by 64 as by 0."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (64 - bits).cast("int")))


def mixture(rows: DataFrame, shard_words: int, seed: int) -> Mixture | None:
    """Decides a mix from sizes(); None for an empty table."""
    per = materialise(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    count, words = per.agg(F.count("*"), F.sum("words")).first()
    if not count:
        return None
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int")).cast("long")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("words") / BLOCK_WORDS, F.col("docs") / BLOCK_DOCS))))
    sources = materialise(numbered(per, count, F.asc_nulls_last("source")).withColumn("weight", weight).withColumn("bits", bits.cast("int")))
    depth = float(level(sources, SHARE * words))
    target = F.least(F.lit(depth) * F.col("weight"), (F.col("words") * LIMIT).cast("double"))
    passes = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(LIMIT).cast("long"))).otherwise(0)
    sources = sources.withColumn("target", target).withColumn("passes", passes.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("words")))

    # blocks in permuted order, with the words before each: sums by the order's first bits, then inside these
    of = rows["source"].eqNullSafe(F.col("o.source"))
    placed = rows.join(known(sources.select(F.struct("source", "s", "bits", "rest", "passes").alias("o")), count), of).select("o.s", "o.passes", "o.rest", "source", "h", "size", _block(F.col("h"), F.col("o.bits")).alias("b"))
    blocks = placed.groupBy("s", "b").agg(F.first("source").alias("source"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.sum("size").alias("w"))
    blocks = materialise(blocks.withColumn("p", F.xxhash64(F.lit(seed), "s", "b")).withColumn("q", F.shiftrightunsigned("p", 52)))
    cells = blocks.groupBy("s", "q").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    earlier = Window.partitionBy("s").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("s")
    cells = cells.select("s", "q", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.sum("n").over(whole).alias("n"))
    inside = Window.partitionBy("s", "q").orderBy("p", "b")
    rank = F.col("n0") + F.row_number().over(inside) - 1
    before = F.col("w0") + F.coalesce(F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(cells, ["s", "q"]).withColumn("rank", rank).withColumn("before", before)
    # past the rest nothing is taken, not even blocks without words
    begun, all_of = F.col("before") < F.col("rest"), F.col("before") + F.col("w") <= F.col("rest")
    blocks = materialise(blocks.withColumn("full", begun & all_of).withColumn("cut", begun & ~all_of))

    # of the block in which a target falls, documents in order of their hash, to the nearest one
    ends = blocks.filter("cut").select("s", "b", (F.col("rest") - F.col("before")).alias("need"))
    near = placed.select("s", "b", "h", "size").join(known(ends, count), ["s", "b"]).groupBy("s", "h").agg(F.sum("size").alias("w"), F.first("need").alias("need"))
    upto = F.sum("w").over(Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto).filter((F.col("upto") <= F.col("need")) | (F.col("upto") - F.col("need") < F.col("need") - (F.col("upto") - F.col("w"))))
    cut_h = materialise(near.groupBy("s").agg(F.max("h").alias("cut_h")))
    sources = materialise(sources.join(known(cut_h, count), "s", "left").select("s", "source", "words", "target", "bits", "passes", "cut_h"))

    # every draw of a block is a place in its source's sequence
    parts = blocks.join(known(cut_h, count), "s", "left")
    extra = F.when(F.col("full") | (F.col("cut") & F.col("cut_h").isNotNull()), F.col("passes") + 1).otherwise(F.col("passes"))
    draws = parts.withColumn("times", extra).filter("times > 0").select("s", "b", "source", "n", "rank", "passes", "cut", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("c"))
    draws = materialise(draws.select("s", "b", "source", "c", (F.col("cut") & (F.col("c") == F.col("passes"))).alias("part"), (F.col("c") * F.col("n") + F.col("rank")).alias("at")))
    shards = max(1, int(-(-SHARE * words // shard_words)))  # the targets' sum is that share of all words
    leaves = _tree(draws.groupBy("s").agg(F.count("*").alias("quota")), shards, seed)
    owned = leaves.select("s", F.col("lo").alias("shard"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("at"))
    dealt = draws.join(owned, ["s", "at"]).groupBy("s", "b").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("c", "shard", "part"))).alias("draws"))
    dealt = materialise(dealt.select("source", "b", "draws"))
    return Mixture(sources, dealt, (count, dealt.count()), shards, seed)


def _tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(lo, hi, s, start, quota) of the leaves, one row for each shard and source that meet.

    A task splits LEVELS levels of one node, which has at most one row for each source.
    """

    def split(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("s")
        s, base = node["s"].to_numpy(), node["start"].to_numpy()
        out = []
        for lo, hi, start, quota in split_quotas(node["quota"].to_numpy(), int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), LEVELS, seed):
            has = np.flatnonzero(quota)
            out.append(pd.DataFrame({"lo": np.int32(lo), "hi": np.int32(hi), "s": s[has], "start": (base + start)[has], "quota": quota[has]}))
        return pd.concat(out)

    schema = "lo int, hi int, s long, start long, quota long"
    nodes = materialise(quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "s", F.lit(0).cast("long").alias("start"), "quota"))
    width = shards
    while width > 1:
        nodes = materialise(nodes.filter("hi - lo = 1").union(nodes.filter("hi - lo > 1").groupBy("lo", "hi").applyInPandas(split, schema)))
        width = -(-width // (1 << LEVELS))
    return nodes


def plan(docs: DataFrame, shard_words: int = 1_000_000, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, draws) of every row; draws holds a (shard, place) for each time it is taken.

    Null sources are a source, last in order; null and empty texts have size 0. Rows that share
    id and text share a place and are taken together, null ids too. A source of no words has
    target 0, and a source whose target whole passes fill has no further draw, not even of texts
    without words. Extra columns do not matter. An empty table gives no rows.
    """
    rows = materialise(sizes(docs, id_col, source_col, text_col))
    made = mixture(rows, shard_words, seed)
    if made is None:
        return rows.selectExpr("id", "source", "size", "size as source_size", "cast(0 as double) as target", "cast(array() as array<struct<shard:int,place:bigint>>) as draws")
    return made.drawn(rows, "source", "h", "d").select("id", "source", "size", "d.source_size", "d.target", "d.draws")


def mix(docs: DataFrame, shard_words: int = 1_000_000, seed: int = SEED) -> DataFrame:
    """The mixed documents: a row for each time one is taken, dealt to shards and shuffled in each.

    Documents that the mix does not take are gone; those taken twice stand there twice. Columns are
    those of the input, whatever their names. Nulls, empty texts, repeated ids and the empty table
    are as in plan(). Each shard is one task's, or, beyond WRITERS shards, so is a run of them.
    """
    made = mixture(materialise(sizes(docs)), shard_words, seed)
    if made is None:
        return docs
    h, d = fresh(docs, "place_hash"), fresh(docs, "draw")
    source = fresh(docs, "source_name")
    rows = made.drawn(docs.withColumn(h, place_hash(F.col("doc_id"), F.col("text"))).withColumn(source, F.col("source").cast("string")), source, h, d)
    taken = rows.select(*docs.columns, F.explode(f"{d}.draws").alias(d))
    tasks = min(made.shards, WRITERS)
    task = F.floor(F.col(f"{d}.shard").cast("long") * tasks / made.shards).cast("int")
    return taken.repartitionById(tasks, task).sortWithinPartitions(f"{d}.shard", f"{d}.place").select(*docs.columns)
