"""Joins on ranges of integers by equality alone, over hierarchical bins.

Bins of level n hold 8**n coordinates. A range is cut into the largest bins that fit it, a dozen for
each level at most and none twice; a point lies in one bin of each level. So a point lies in a range
exactly if one of its bins is one of the range's, and in no more than one: bins are join keys, no
pair needs another look, and none comes twice. Keys with many ranges fall apart into their bins,
which is what lets a hot key be dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS, _LEVELS = 3, 20


def cover(spans: DataFrame, low: str, high: str) -> DataFrame:
    """`spans` with (bin_level, bin): a row for each bin of [low, high]; empty and null ranges have none.

    At a level, bins from the first whole one to the last are taken but for those that the next
    level's whole ones hold. Ends are clipped so that 2**60 coordinates are addressed.
    """
    shift = lambda x, n: f"shiftright({x}, {_BITS} * ({n}))"
    first = lambda n: f"-{shift('-__lo', n)}"  # noqa: E731  (the ceiling of a division)
    last = lambda n: shift("__hi", n)
    whole = f"({first('n + 1')}) < {last('n + 1')}"
    run = lambda a, b: f"if({a} < {b}, sequence({a}, {b} - 1), cast(array() as array<bigint>))"
    bins = f"if({whole}, concat({run(first('n'), f'8 * ({first("n + 1")})')}, {run(f'8 * {last("n + 1")}', last('n'))}), {run(first('n'), last('n'))})"
    # a level's whole bins are none once the range is shorter than they are
    levels = f"filter(sequence(0, {_LEVELS - 1}), n -> n = 0 or shiftleft(1L, {_BITS} * n) <= __hi - __lo)"
    edge = 1 << 59
    rows = spans.withColumn("__lo", F.greatest(F.col(low).cast("long"), F.lit(-edge))).withColumn("__hi", F.least(F.col(high).cast("long"), F.lit(edge)) + 1)
    rows = rows.filter(F.col(low).isNotNull() & F.col(high).isNotNull()).filter("__lo < __hi")
    each = F.explode(F.expr(f"flatten(transform({levels}, n -> transform({bins}, b -> struct(n as level, b as bin))))"))
    return rows.withColumn("__b", each).select(*spans.columns, F.col("__b.level").alias("bin_level"), F.col("__b.bin").alias("bin"))


def stab(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """All columns of points and of the spans of equal keys with low <= at <= high; columns must not clash but for the keys.

    Points are looked up at the levels that a span as long as the longest may use, at most twenty and
    seldom more than four: that list is one row, and costs no look at the bins. Give narrow tables: a span has a row for each of its bins. Rows with null
    keys or bounds match nothing; repeated rows match each on their own.
    """
    binned = cover(spans, low, high)
    edge = 1 << 59
    length = F.least(F.col(high).cast("long"), F.lit(edge)) - F.greatest(F.col(low).cast("long"), F.lit(-edge)) + 1
    levels = f"filter(sequence(0, {_LEVELS - 1}), n -> __l > 0 and (n = 0 or shiftleft(1L, {_BITS} * n) <= __l))"
    used = spans.agg(F.max(length).alias("__l")).select(F.coalesce(F.expr(levels), F.array().cast("array<int>")).alias("__levels"))
    rows = points.filter(F.col(at).between(-(1 << 59), 1 << 59)).crossJoin(F.broadcast(used)).withColumn("bin_level", F.explode("__levels")).drop("__levels")
    rows = rows.withColumn("bin", F.expr(f"shiftright(cast({at} as bigint), {_BITS} * bin_level)"))
    # neither side has a bound, and a small file may hold many rows: never a broadcast
    return rows.join(binned.hint("merge"), [*keys, "bin_level", "bin"]).drop("bin_level", "bin")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of rows of equal keys whose ranges [a] of left and [b] of right share a coordinate.

    Either the left one begins in the right one, or the right one begins in the left one behind its
    beginning: two lookups of points that no pair answers twice. Ranges whose end lies before their
    beginning are empty.
    """
    left, right = left.filter(F.col(a[0]) <= F.col(a[1])), right.filter(F.col(b[0]) <= F.col(b[1]))
    begins = stab(left, right, keys, a[0], *b)
    behind = left.withColumn("__from", F.col(a[0]) + 1)
    later = stab(right, behind, keys, b[0], "__from", a[1]).drop("__from")
    return begins.unionByName(later)


def containing(inner: DataFrame, outer: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of rows of equal keys of which the range [a] of inner lies in [b] of outer.

    Those that hold both ends: the first one is looked up, the last one compared.
    """
    return stab(inner.filter(F.col(a[0]) <= F.col(a[1])), outer, keys, a[0], *b).filter(F.col(a[1]) <= F.col(b[1]))
