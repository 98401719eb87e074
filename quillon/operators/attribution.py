"""Which file of a diff a patched function is in, and which diff belongs to a CVE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import call_pattern, declaration_pattern, identifier_pattern, is_code_path
from quillon.operators.diff import hunk_context

#: Scores of a mention, a call, a hunk's context and a definition, and what a code
#: path adds; labels by the least score.
MENTION, CALL, CONTEXT, DEFINITION, CODE = 10, 35, 50, 100, 5
LABELS = ((100, "function_definition_hunk_match"), (50, "function_header_hunk_match"), (1, "function_reference_hunk_match"))
FALLBACK = "single_code_file_fallback"
PREFIXES = (12, 10, 8, 7)
#: declaration_pattern() and call_pattern() with any word for the name; the first `(` parts a declared name from the rest.
DECLARED = "^\\s*[A-Za-z_][A-Za-z0-9_*\\s]*\\s([A-Za-z0-9_]++)\\s*+\\("
CALLED = "(?<![A-Za-z0-9_])([A-Za-z0-9_]++)\\s*+\\("


def _content(line: Column) -> Column:
    """A hunk's line without its sign."""
    return F.when(F.substring(line, 1, 1).isin(" ", "+", "-"), F.substring(line, 2, 1_000_000_000)).otherwise(line)


def _words(text: Column) -> Column:
    """Runs of letters, digits and underscores of ASCII; as a negated class the same costs tenfold."""
    return F.split(text, "\\W+")


def line_score(line: Column, header: Column, name: Column) -> Column:
    """What a hunk's line says about a function; a hunk's score is the greatest of its lines'."""
    content = _content(line)
    signed = F.substring(line, 1, 1).isin("+", "-")
    # a search for the bare name spares most lines the patterns
    inside, named = F.contains(content, name), F.contains(header, name)
    return (
        F.when(inside & signed & F.regexp_like(content, declaration_pattern(name)), DEFINITION)
        .when(named & F.regexp_like(hunk_context(header), identifier_pattern(name)), CONTEXT)
        .when(inside & F.regexp_like(content, call_pattern(name)), CALL)
        .when(inside & F.regexp_like(content, identifier_pattern(name)), MENTION)
        .otherwise(0)
    )


def named_in(line: Column, header: Column, is_header: Column, plain: Column, odd: Column) -> Column:
    """Array of (function, score): what a hunk's line, or its header, says about functions; those it does not name may lack.

    `plain` names are words alone, so a line is read once for its words, however many functions
    there are; `odd` ones are searched one by one with line_score().
    """
    content, signed = _content(line), F.substring(line, 1, 1).isin("+", "-")
    called = F.contains(line, F.lit("("))  # spares most lines two patterns
    defined = F.when(called & signed, F.array(F.regexp_extract(content, DECLARED, 1)))
    scored = lambda names, score: F.transform(names, lambda n: F.struct(n.alias("function"), score(n).alias("score")))
    said = lambda words, score: scored(F.array_intersect(F.coalesce(words, F.array().cast("array<string>")), plain), lambda _: F.lit(score))
    bare = F.when(is_header, F.lit("")).otherwise(line)
    return F.concat(
        F.when(is_header, said(_words(hunk_context(header)), CONTEXT)).otherwise(
            F.concat(said(defined, DEFINITION), said(F.when(called, F.regexp_extract_all(content, F.lit(CALLED), 1)), CALL), said(_words(content), MENTION))
        ),
        scored(odd, lambda n: line_score(bare, header, n)),
    )


def block_scores(diff_blocks: DataFrame, functions: DataFrame, key: str = "cve") -> DataFrame:
    """(key, function, file_ord, path, score) of every function against every file of its diff.

    A key's functions come to a line as one row, and only those that the line names leave it; the
    line that opens a file stands for all others.
    """
    plain = F.regexp_like("function", F.lit("^[A-Za-z0-9_]+\\z"))
    names = functions.groupBy(key).agg(F.collect_set(F.struct("function")).alias("__all"), F.collect_set(F.when(plain, F.col("function"))).alias("__plain"), F.collect_set(F.when(~plain, F.col("function"))).alias("__odd"))
    named = named_in(F.col("line"), F.col("header"), F.col("is_header"), F.col("__plain"), F.col("__odd"))
    none = F.transform("__all", lambda f: F.struct(f["function"].alias("function"), F.lit(0).alias("score")))
    said = F.when(F.col("hunk_ord") > 0, named).when(F.col("is_header"), none)
    rows = diff_blocks.select(key, "file_ord", "hunk_ord", "path", "header", "is_header", "line").join(names, key)
    # a file's path is one, and as a key it keeps the sums hashed
    seen = rows.select(key, "file_ord", "path", F.inline(said)).groupBy(key, "function", "file_ord", "path").agg(F.max("score").alias("score"))
    code = (F.col("score") > 0) & is_code_path(F.col("path"))
    return seen.withColumn("score", F.when(code, F.col("score") + CODE).otherwise(F.col("score")))


def inferred_files(scores: DataFrame, key: str = "cve") -> DataFrame:
    """(key, function, file, inferred_by, score): the best file of each function, first of equals.

    With no score and one code file, that file; with no score otherwise still the first file, with
    an empty label.
    """
    w = Window.partitionBy(key, "function")
    rows = scores.withColumn("__code", F.sum(F.coalesce(is_code_path(F.col("path")), F.lit(False)).cast("int")).over(w)).withColumn("__best", F.max("score").over(w))
    lone = (F.col("__best") <= 0) & (F.col("__code") == 1)
    order = [F.when(lone & is_code_path(F.col("path")), 0).otherwise(1), F.desc("score"), F.col("file_ord")]
    first = rows.withColumn("__r", F.row_number().over(w.orderBy(*order))).filter("__r = 1")
    label = F.when(lone, FALLBACK)
    for least, name in LABELS:
        label = label.when(F.col("__best") >= least, name)
    return first.select(key, "function", F.col("path").alias("file"), label.otherwise("").alias("inferred_by"), "score")


def match_diff_files(cves: DataFrame, paths: DataFrame, project: str, exact: bool = False) -> DataFrame:
    """(cve, path) of the diff file of each CVE (cve, commit); null where there is none.

    Names that begin with the project and the id precede names that hold the id anywhere, which also
    finds longer ids unless `exact`. Of these, the longest commit prefix in the name decides, then
    the path. The ids that a name may mean are cut from it, so the join is on equal ids; ids that
    only a longer one holds come by its prefixes.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    whole = F.regexp_extract_all(name, F.lit("CVE-[0-9]+-[0-9]+"), 0)
    ids = whole if exact else F.flatten(F.transform(whole, lambda c: F.transform(F.sequence(F.lit(1), F.length(F.regexp_extract(c, "([0-9]+)$", 1))), lambda n: F.substring(c, F.lit(1), F.length(c) - F.length(F.regexp_extract(c, "([0-9]+)$", 1)) + n))))
    files = paths.select("path", F.lower(name).alias("__name"), name.alias("__own"), F.explode(F.array_distinct(ids)).alias("cve"))
    both = cves.join(files, "cve", "left")
    tier = F.when(F.startswith("__own", F.concat(F.lit(f"{project}_"), "cve", F.lit("_"))) & F.endswith("__own", F.lit(".diff")), 0).otherwise(1)
    best = both.withColumn("__tier", tier).withColumn("__least", F.min("__tier").over(Window.partitionBy("cve"))).filter("__tier = __least or path is null")
    rank = F.lit(len(PREFIXES))
    for k, width in reversed(list(enumerate(PREFIXES))):
        rank = F.when((F.coalesce("commit", F.lit("")) != "") & F.contains("__name", F.lower(F.substring("commit", 1, width))), k).otherwise(rank)
    return best.groupBy("cve").agg(F.min_by("path", F.struct(rank.alias("r"), F.col("path").alias("p"))).alias("path"))


def pick_candidate(candidates: DataFrame, key: str = "cve") -> DataFrame:
    """(key, file): of listed diff files (ord, file, exists) that with the commit in its name, else the first that exists."""
    base = F.regexp_extract("file", "([^/]*)$", 1)
    score = F.when((F.coalesce("commit", F.lit("")) != "") & F.contains(base, F.col("commit")), 10).otherwise(0) + F.coalesce(F.col("exists").cast("int"), F.lit(0))
    return candidates.filter("coalesce(file, '') <> ''").groupBy(key).agg(F.max_by("file", F.struct(score.alias("s"), (-F.col("ord")).alias("o"))).alias("file"))


def with_info(diffs: DataFrame, info: DataFrame) -> DataFrame:
    """Source-diff records with summary and cwe; `no_info` marks those that have none."""
    joined = diffs.join(info.withColumn("__has", F.lit(True)), "cve", "left")
    return joined.withColumn("no_info", F.col("__has").isNull()).withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("cwe", F.coalesce("cwe", F.array().cast("array<string>"))).drop("__has")


def build_statistics(source: DataFrame, cves: DataFrame, attributed: DataFrame) -> DataFrame:
    """One row of the ten counters of a build.

    `source` has the records of the source diff, `cves` the selected ones (cve, no_info, path of the
    diff file or null), `attributed` their functions (cve, function, file). A CVE listed twice is
    emitted once. See build_histograms() for change types and inference methods.
    """
    n = lambda cond, name: F.count_if(cond).alias(name)
    has_file = F.coalesce("file", F.lit("")) != ""
    given = source.agg(F.count("*").alias("input_source_diff_cves"))
    per_cve = cves.agg(
        F.count("*").alias("selected_cves"), F.count_distinct("cve").alias("emitted_cves"), n(F.col("path").isNotNull(), "diff_files_found"), n(F.col("path").isNull(), "diff_files_missing"),
        n(~F.col("no_info"), "cveinfo_found"), n(F.col("no_info"), "cveinfo_missing"),
    )
    per_function = attributed.agg(F.count("*").alias("total_functions"), n(has_file, "functions_with_file"), n(~has_file, "functions_without_file"))
    return given.crossJoin(per_cve).crossJoin(per_function)  # one row each


def build_histograms(attributed: DataFrame) -> DataFrame:
    """(kind, value, n) of functions by change type and by inference method."""
    return histogram(attributed, "change_type").withColumn("kind", F.lit("change_type")).union(histogram(attributed, "inferred_by").withColumn("kind", F.lit("inferred_by"))).select("kind", "value", "n")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n); empty and missing values are `unknown`."""
    return df.groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
