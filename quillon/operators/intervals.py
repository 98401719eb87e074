"""Intervals of lines and the dependency closure of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outermost(spans: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """Spans that no earlier span of their key contains; longer ones come earlier, then lesser starts.

    Containment is transitive, so the greedy choice keeps exactly the spans without any container
    before them in this order. A span is contained exactly if, of the spans that are before it and
    begin no later, one ends no earlier; ordered by start that is a running maximum of ends.
    """
    w = Window.partitionBy(*keys).orderBy("start_line", F.desc("end_line"), seq).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_line").over(w)
    return spans.withColumn("__m", reach).filter("__m is null or __m < end_line").drop("__m")


def uncovered(inner: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """Declarations that no kept block of two lines or more contains.

    One is contained exactly if, of the blocks that begin no later, one ends no earlier: a running
    maximum over both tables in order of their beginnings, without pairs.
    """
    wide = kept.filter("end_line > start_line").select(*keys, "start_line", "end_line", F.lit(0).alias("__own"))
    rows = inner.withColumn("__own", F.lit(1)).unionByName(wide, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("start_line", "__own").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("__own") == 0, F.col("end_line"))).over(w)
    return rows.withColumn("__m", reach).filter("__own = 1 and (__m is null or end_line is null or __m < end_line)").select(*inner.columns)


def closure(needed: DataFrame, depends: DataFrame) -> DataFrame:
    """(fn, var): what is needed (fn, var) and, over `depends` (fn, var, dep), all that it leads to.

    Semi-naive: each round joins only what the last one found. A round is planned from tables of
    names, which are a few for each function, and the loop ends when nothing is new.
    """
    from quillon.sources.tables import written

    found = written(needed.select("fn", "var").distinct())
    fresh = found
    edges = written(depends.select("fn", "var", "dep").distinct())
    while True:
        step = fresh.join(edges, ["fn", "var"]).select("fn", F.col("dep").alias("var")).distinct()
        fresh = written(step.join(found, ["fn", "var"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = written(found.union(fresh))
