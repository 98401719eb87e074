"""Unified diffs as tables: files, hunks, numbered lines, overlap with functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import ranges

from quillon.operators.linescan import lines_of, split_lines
from quillon.sources.tables import written


def _path(part: Column, side: str) -> Column:
    return F.when(F.startswith(part, F.lit(side)), F.substring(part, 3, 1_000_000)).otherwise("")


def _parts(rows: DataFrame, opens: Callable[[Column], Column], order: str, head: bool = False) -> DataFrame:
    """One row for each part of `__lines`, which begins with a line that `opens` it: its lines, its place `__at` and `order` from 0.

    What stands before the first such line is a part with `head` and goes without it.
    """
    found = F.filter(F.transform("__lines", lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__from", F.concat(F.array(F.lit(0)), found) if head else found)
    end = lambda k: F.coalesce(F.try_element_at("__from", k + 2), F.size("__lines"))
    parts = F.transform("__from", lambda i, k: F.struct((F.col("__at") + i).alias("at"), F.slice("__lines", i + 1, end(k) - i).alias("lines")))
    rows = rows.select(*(c for c in rows.columns if c not in ("__lines", "__at", "__from")), F.posexplode(parts).alias(order, "__part"))
    return rows.withColumn("__at", F.col("__part.at")).withColumn("__lines", F.col("__part.lines")).drop("__part")


def blocks(diffs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Diff lines with file_ord and hunk_ord (from 1; hunk 0 is a file's head), old_path and new_path.

    `diff --git` opens a file, `@@ ` a hunk; lines before the first file go. `header` is a hunk's
    first line, and `is_header` marks it. A diff is taken apart within its row, so nothing is
    shuffled or sorted.
    """
    opens = lambda line: F.startswith(line, F.lit("diff --git "))
    heads = lambda line: F.startswith(line, F.lit("@@ "))
    rows = diffs.select(*keys, split_lines(text).alias("__lines"), F.lit(0).alias("__at"))
    rows = _parts(rows, opens, "file_ord").withColumn("file_ord", F.col("file_ord").cast("long") + 1)
    rows = rows.withColumn("__p", F.split(F.trim(F.col("__lines")[0]), "\\s+"))
    enough = F.size("__p") >= 4
    rows = rows.withColumn("old_path", F.when(enough, _path(F.col("__p")[2], "a/")).otherwise("")).withColumn("new_path", F.when(enough, _path(F.col("__p")[3], "b/")).otherwise("")).drop("__p")
    path = F.when(F.col("new_path") != "/dev/null", F.col("new_path")).otherwise(F.col("old_path"))
    rows = _parts(rows.withColumn("path", path), heads, "hunk_ord", head=True).withColumn("hunk_ord", F.col("hunk_ord").cast("long"))
    rows = rows.withColumn("header", F.when(F.col("hunk_ord") > 0, F.col("__lines")[0]))
    columns = [*keys, "file_ord", "hunk_ord", "old_path", "new_path", "header", "path"]
    rows = rows.select(*columns, "__at", F.posexplode("__lines").alias("__n", "line")).withColumn("line_no", F.col("__at") + F.col("__n") + 1)
    return rows.select(*columns, "line", "line_no", (opens(F.col("line")) | heads(F.col("line"))).alias("is_header"))


def hunk_context(header: Column) -> Column:
    """What stands behind the second `@@` of a hunk's header."""
    return F.trim(F.regexp_extract(header, "^@@ .*?@@(.*)$", 1))


def files(diffs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, path) of every file that a diff names by its b/ path, in order of first mention."""
    rows = lines_of(diffs, text, *keys).filter(F.startswith("line", F.lit("diff --git ")))
    fourth = F.coalesce(F.try_element_at(F.split("line", " "), F.lit(4)), F.lit(""))
    rows = rows.filter(F.startswith(fourth, F.lit("b/"))).withColumn("path", F.substring(fourth, 3, 1_000_000))
    return rows.groupBy(*keys, "path").agg(F.min("line_no").alias("ord"))


def _starts(header: Column, sign: str, first: bool) -> Column:
    """Start line of a side: the first or the last token of the header with that sign; null if it is no number."""
    tokens = F.filter(F.split(header, " "), lambda t: F.startswith(t, F.lit(sign)))
    token = F.try_element_at(tokens, F.lit(1 if first else -1))
    return F.split(F.substring(token, 2, 100), ",")[0].try_cast("int")


def numbered(diff_blocks: DataFrame, *keys: str) -> DataFrame:
    """Lines of hunks with sign, old_ln, new_ln and content.

    Counters start at the last token of either sign in the header; a header without both drops its
    hunk. Lines that look like file heads (`+++`, `---`) and blank lines have no sign and advance
    nothing.
    """
    rows = diff_blocks.filter("hunk_ord > 0").withColumn("__o", _starts(F.col("header"), "-", False)).withColumn("__n", _starts(F.col("header"), "+", False)).filter("__o is not null and __n is not null")
    line = F.col("line")
    plus = F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))
    minus = F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---"))
    sign = F.when(F.col("is_header"), None).when(plus, "+").when(minus, "-").when(F.startswith(line, F.lit(" ")), " ")
    rows = rows.withColumn("sign", sign)
    before = Window.partitionBy(*keys, "file_ord", "hunk_ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda signs: F.coalesce(F.sum(F.col("sign").isin(*signs).cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("old_ln", F.col("__o") + moved(("-", " "))).withColumn("new_ln", F.col("__n") + moved(("+", " ")))
    rows = rows.filter("sign is not null").withColumn("content", F.substring("line", 2, 1_000_000_000))
    return rows.select(*keys, "path", "new_path", "file_ord", "hunk_ord", "line_no", "sign", "old_ln", "new_ln", "content")


def changed_in(lines: DataFrame, functions: DataFrame, *keys: str) -> DataFrame:
    """(keys, function, side, ln, content): changed lines inside a function's range, last of a number wins.

    Both sides are compared with the range after the patch.
    """
    rows = lines.filter("sign in ('+', '-')").withColumn("side", F.when(F.col("sign") == "+", "new").otherwise("old"))
    rows = rows.withColumn("ln", F.when(F.col("sign") == "+", F.col("new_ln")).otherwise(F.col("old_ln")))
    joined = rows.join(functions, [*keys, "new_path"]).filter("start_line <= ln and ln <= end_line")
    return joined.groupBy(*keys, "function", "side", "ln").agg(F.max_by("content", "line_no").alias("content"))


def split_hunks(diff_blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, file_ord, hunk_ord, header, old_lines, new_lines): each hunk's removed and added lines."""
    line = F.col("line")
    body = ~F.col("is_header")
    new = F.when(body & F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++")), F.struct("line_no", F.substring(line, 2, 1_000_000_000).alias("t")))
    old = F.when(body & F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---")), F.struct("line_no", F.substring(line, 2, 1_000_000_000).alias("t")))
    texts = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"])
    return diff_blocks.filter("hunk_ord > 0").groupBy(*keys, "path", "file_ord", "hunk_ord", "header").agg(texts(old).alias("old_lines"), texts(new).alias("new_lines"))


def new_range(header: Column) -> tuple[Column, Column]:
    """First and last new-side line of a hunk by the first `+` token; a count of 0 still spans one line."""
    token = F.try_element_at(F.filter(F.split(header, " "), lambda t: F.startswith(t, F.lit("+"))), F.lit(1))
    parts = F.split(F.substring(token, 2, 100), ",")
    start = parts[0].try_cast("int")
    count = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)).try_cast("int")).otherwise(1)
    return start, start + F.greatest(count, F.lit(1)) - 1


def overlapping(hunks: DataFrame, functions: DataFrame, *keys: str) -> DataFrame:
    """Hunks on a function's range [start_line, end_line]; all of its hunks where none overlaps.

    `functions` has the keys and `function`. Headers and ranges meet over bins, and whole rows are
    joined to what has met by equality.
    """
    first, last = new_range(F.col("header"))
    spots = hunks.select(*keys, "header", first.alias("__s"), last.alias("__e")).distinct()
    spans = functions.select(*keys, "function", "start_line", "end_line").distinct()
    hits = ranges.overlaps(spots, spans, list(keys), ("__s", "__e"), ("start_line", "end_line")).drop("__s", "__e")
    hits = written(hits)  # read twice
    columns = [*keys, *(c for c in hunks.columns if c not in keys), *(c for c in functions.columns if c not in keys)]
    # no table here has a bound, so none is broadcast
    met = hunks.join(hits.hint("merge"), [*keys, "header"]).join(functions.hint("merge"), [*keys, "function", "start_line", "end_line"])
    bare = functions.join(hits.select(*keys, "function").distinct().hint("merge"), [*keys, "function"], "left_anti")
    return met.select(*columns).unionByName(hunks.join(bare.hint("merge"), list(keys)).select(*columns))
