"""Connected components over an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, files_for, materialise


def _lowest(pairs: DataFrame, files: int) -> DataFrame:
    return materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), files)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node that an edge (u, v) touches; root is the least node reachable.

    Alternates two star contractions until the edges stop changing, which takes a number of
    rounds logarithmic in the longest path. Minima are aggregated map-side, written, and joined
    back, so that the join over a hub's edges is one that AQE can split. Loops, repeated and
    reversed edges are allowed; an empty table gives an empty table. `files` bounds those of the
    first table, as for materialise().
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), files)
    before = _signature(e)
    while before[0]:
        files = files_for(edges.sparkSession, before[0])
        both = materialise(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), files)
        low = _lowest(both, files)
        large = materialise(
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), files
        )
        least = _lowest(large, files)
        small = materialise(
            large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), files
        )
        for x in (both, low, large, least, e):
            discard(x)
        e, after = small, _signature(small)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
