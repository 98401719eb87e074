"""How filters interact: what each removes at each step of every order, from mask cells.

A document's failures are bits of a mask. Documents are counted into cells of equal mask, part and
labels; cells are unpivoted against the steps of all orders; a running bit-or window tells which
failures an earlier step met, and sums over windows of one filter total what it removes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters' letters, the first one's bit is 1; the last is about copies.
FILTERS = "ABCDE"
COPY = 1 << (len(FILTERS) - 1)
_KEYS = ("digest", "part", "mask", "good", "toxic")


def failures(text: Column, words: Column) -> list[Column]:
    """Conditions of the filters that look at one text and its words."""
    return [
        F.size(words) < 50,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * F.size(words),
        F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(5).cast("long") * F.length(text),
        F.regexp_like(text, F.lit("[#$%&*|]")),
    ]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, and how many of them are labelled so.

    A null part is the empty string, a null text is empty. A text is a copy if a smaller id has the
    same; null ids are neither smaller nor larger than others, and rows that repeat an id are no
    copies of one another. A document labelled twice has what any of its labels says; labels that are
    null or stand on a null id do not count. An empty table has no cells. Texts are hashed where they
    are read; rows of one digest combine by part and labels before they meet, so the window over a
    digest holds four rows for each part at most, however often its text stands in the table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("t"), F.col("w")))), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(said, "id", "left").fillna(False, ["good", "toxic"])
    unnamed = F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0))
    some = rows.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("firsts"), unnamed.alias("unnamed"))
    whole = F.min("least").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("least") == F.col("whole"), F.col("firsts")).otherwise(0)
    some = some.withColumn("whole", whole).withColumn("originals", originals)
    each = F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    both = some.select("part", "good", "toxic", each.alias("c")).select("part", "c.*", "good", "toxic").filter("n > 0")
    kept = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), kept("good"), kept("toxic"))


def evaluate(counted: DataFrame) -> DataFrame:
    """Metrics of every part, order and step from cells (part, mask, n, good, toxic), one row for each.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley), zeros included; no cells give no rows. Cells are dealt out by part once, which serves
    all windows and sums: a part has 32 cells at most, 19,200 rows with the steps of all orders.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = counted.repartition("part").withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("step", "filter")).withColumn("step", F.col("step") + 1)
    bit = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i))), F.col("filter"))
    rows = rows.withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, met = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    said = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~fails & ~met).alias("kept"), total("n", fails & ~met).alias("removed"), total("n", fails & met).alias("redundant"), total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~met).alias("good_lost"), total("toxic", fails & ~met).alias("toxic_lost"),
    )
    return said.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Metrics of five filters in all their orders, for each part of the documents; see cells() and evaluate()."""
    return evaluate(cells(docs, labels, id_col, text_col, part_col))
