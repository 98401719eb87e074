"""Frames by value and by rank: what happened within a time, and where a duration stands among others.

Windows are on keys that domain data bound, as everywhere in these operators: a run, a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within(rows: DataFrame, keys: list[str], time: str, value: str, span: int, out: str = "recent") -> DataFrame:
    """Rows with what their key's rows of the last `span` (in the time's unit, ends included) add up to, later rows of the same time included."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-span, Window.currentRow)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))).withColumn(f"{out}_rows", F.count("*").over(w))


def near_groups(rows: DataFrame, keys: list[str], order: str, groups: int, out: str = "near") -> DataFrame:
    """Rows with the number of rows in the `groups` groups of equal `order` on either side and their own: a GROUPS frame, by dense ranks."""
    ranked = rows.withColumn("__group", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.withColumn(out, F.count("*").over(Window.partitionBy(*keys).orderBy("__group").rangeBetween(-groups, groups))).drop("__group")


def standing(rows: DataFrame, keys: list[str], value: str, tie: str, tiles: int = 4) -> DataFrame:
    """Rows with dense_rank, percent_rank and cume_dist of a value in its key, the tile it falls in (ties by `tie`), and the key's second least."""
    w, strict = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys).orderBy(value, tie)
    whole = strict.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "*", F.dense_rank().over(w).alias("dense_rank"), F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"), F.ntile(tiles).over(strict).alias("tile"), F.nth_value(value, 2).over(whole).alias("second")
    )
