"""Analysis of patched functions from blobs, diffs and names, with a status for each."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import dataflow, diff, macros, syntax
from quillon.sources.tables import written


#: Errors and warnings of an analysis.
NO_REPO, NO_FILE, NO_DIFF = "repo_path is required for AST source analysis", "target source file is missing", "diff file is missing"
NO_NODE, NO_POST = "unable to locate function AST node", "post-patch source unavailable"
FROM_DIFF = "function file missing in input; inferred from diff"
POST_AS_PRE = "pre-patch source unavailable; reused post-patch source"
POST_TREE = "pre-patch function AST unavailable; reused post-patch function AST"
WHOLE_FILE = "no changed lines inside AST function range; fell back to whole-file diff lines"


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def with_versions(functions: DataFrame, blobs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Functions (fn, function, repo, commit, file) with post- and pre-patch text, errors and warnings.

    A missing file is the first that the diff (fn, text) names. Without a repository, a file or a
    diff a function has failed; the text before the patch falls back to that after it.
    """
    first = diff.files(diffs, "fn").groupBy("fn").agg(F.min_by("path", "ord").alias("__first"))
    rows = functions.join(diffs.select("fn", F.col("text").alias("__diff")), "fn", "left").join(first, "fn", "left")
    given = ~_empty("file")
    rows = rows.withColumn("__given", given | F.col("__diff").isNull()).withColumn("file", F.when(given, F.col("file")).otherwise(F.coalesce("__first", F.lit(""))))
    post = blobs.select("repo", F.col("rev").alias("commit"), F.col("path").alias("file"), F.col("text").alias("post"))
    pre = blobs.filter(F.endswith("rev", F.lit("^"))).select("repo", F.expr("left(rev, length(rev) - 1)").alias("commit"), F.col("path").alias("file"), F.col("text").alias("pre"))
    rows = rows.join(post, ["repo", "commit", "file"], "left").join(pre, ["repo", "commit", "file"], "left")
    errors = F.array_compact(F.array(F.when(_empty("repo"), NO_REPO), F.when(_empty("file"), NO_FILE), F.when(F.col("__diff").isNull(), NO_DIFF)))
    good = F.size("errors") == 0
    rows = rows.withColumn("errors", errors)
    warnings = F.array_compact(F.array(F.when(~F.col("__given"), FROM_DIFF), F.when(good & _empty("post"), NO_POST)))
    no_pre = good & ~_empty("post") & _empty("pre")
    return rows.withColumn("warnings", warnings).withColumn("no_pre", no_pre).withColumn("pre", F.when(_empty("pre"), F.col("post")).otherwise(F.col("pre"))).drop("__diff", "__first", "__given")


def _inside(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found.select("fn_id", F.col("node_id").alias("__a"), F.col("last_id").alias("__b")).hint("merge"), "fn_id").filter("__a <= node_id and node_id <= __b").drop("__a", "__b")


def _symbols(inside: DataFrame, texts: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fn, name) of parameters and locals, and (fn, name, body) of macros up to a function's end."""
    own = lambda df: df.withColumnRenamed("fn_id", "fn")
    return own(syntax.parameters(inside)), own(syntax.local_names(inside)), macros.definitions(texts.join(ends, "fn"), "fn", until="end_line")


class Analysis(Mapping):
    """The tables of analysed(): each is made when it is asked for, from steps that are written once."""

    TABLES = ("status", "entities", "events", "pre_events", "edges", "flow", "blocks", "code", "hunks")

    def __init__(self, functions: DataFrame, blobs: DataFrame, diffs: DataFrame) -> None:
        self._functions, self._blobs, self._diffs = functions, blobs, diffs

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)

    # -- trees

    @cached_property
    def _rows(self) -> DataFrame:
        return written(with_versions(self._functions, self._blobs, self._diffs))

    @cached_property
    def _good(self) -> DataFrame:
        return self._rows.filter("size(errors) = 0 and coalesce(post, '') <> ''")

    @cached_property
    def _wanted(self) -> DataFrame:
        return self._good.select(F.col("fn").alias("fn_id"), F.col("function").alias("name"))

    def _texts(self, c: str) -> DataFrame:
        return self._good.select(F.col("fn").alias("fn_id"), F.col(c).alias("text"))

    @cached_property
    def _nodes(self) -> DataFrame:
        return written(syntax.parse(self._texts("post"), "fn_id"))

    @cached_property
    def _found(self) -> DataFrame:
        return written(syntax.function_by_name(self._nodes, self._wanted))

    @cached_property
    def _inside(self) -> DataFrame:
        return written(_inside(self._nodes, self._found))

    @cached_property
    def _pre_nodes(self) -> DataFrame:
        return written(syntax.parse(self._texts("pre"), "fn_id"))

    @cached_property
    def _pre_found(self) -> DataFrame:
        return written(syntax.function_by_name(self._pre_nodes, self._wanted))

    @cached_property
    def _lost(self) -> DataFrame:
        """Functions that are found after the patch alone; their tree after it stands in for that before it."""
        return self._found.join(self._pre_found.select("fn_id").hint("merge"), "fn_id", "left_anti").select("fn_id")

    @cached_property
    def _pre_inside(self) -> DataFrame:
        own = _inside(self._pre_nodes, self._pre_found)
        return written(own.union(self._inside.join(self._lost.hint("merge"), "fn_id", "left_semi").select(*self._pre_nodes.columns)))

    # -- changed lines

    @cached_property
    def _ranges(self) -> DataFrame:
        own = self._good.select(F.col("fn").alias("fn_id"), "file", "function")
        return self._found.join(own.hint("merge"), "fn_id").select(F.col("fn_id").alias("fn"), "function", F.col("file").alias("new_path"), "start_line", "end_line")

    @cached_property
    def _lines(self) -> DataFrame:
        return written(diff.numbered(diff.blocks(self._diffs, "fn"), "fn"))

    @cached_property
    def _own(self) -> DataFrame:
        return written(diff.changed_in(self._lines, self._ranges, "fn"))

    @cached_property
    def _changed(self) -> DataFrame:
        wide = diff.changed_in(self._lines, self._ranges.withColumn("start_line", F.lit(0)).withColumn("end_line", F.lit(1_000_000_000)), "fn")
        return written(self._own.union(wide.join(self._own.select("fn").distinct().hint("merge"), "fn", "left_anti")))

    @cached_property
    def _old(self) -> DataFrame:
        return self._changed.filter("side = 'old'")

    @cached_property
    def _old_names(self) -> DataFrame:
        return written(syntax.loose_entities(self._old.withColumn("ord", F.col("ln")), "fn", "content"))

    # -- names and events

    def _symbols(self, inside: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return _symbols(inside, self._good.select("fn", F.col(text).alias("text")), self._found.select(F.col("fn_id").alias("fn"), "end_line"))

    @cached_property
    def _post_symbols(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._symbols(self._inside, "post")

    @cached_property
    def _kinds(self) -> DataFrame:
        params, local, named = self._post_symbols
        new_lines = self._changed.filter("side = 'new'").select("fn", F.col("ln").alias("line"))
        on_new = written(syntax.entities(self._inside, new_lines.withColumnRenamed("fn", "fn_id")).withColumnRenamed("fn_id", "fn"))
        calls = on_new.filter("is_call").select("fn", "line", "name")
        return dataflow.classified(on_new.select("fn", "line", "name"), calls, named.select("fn", "name"), params.union(local))

    @cached_property
    def _key(self) -> DataFrame:
        return written(dataflow.line_variables(self._kinds).select("fn", "name").distinct())

    @cached_property
    def _sink(self) -> DataFrame:
        return written(dataflow.sinks(self._old_names.filter("not is_call"), self._old, self.pre_events))

    # -- results

    @cached_property
    def status(self) -> DataFrame:
        found = self._found.select(F.col("fn_id").alias("fn"), F.lit(True).alias("__f"))
        lost = self._lost.select(F.col("fn_id").alias("fn"), F.lit(True).alias("__l"))
        broad = self._found.select(F.col("fn_id").alias("fn")).join(self._own.select("fn").distinct().hint("merge"), "fn", "left_anti").withColumn("__wide", F.lit(True))
        status = self._rows.join(found.hint("merge"), "fn", "left").join(lost.hint("merge"), "fn", "left").join(broad.hint("merge"), "fn", "left")
        here, tried = F.coalesce("__f", F.lit(False)), F.size("errors") == 0
        absent = tried & ~here & ~_empty("post")
        said = F.array_compact(F.array(
            F.when(absent, F.concat(F.lit("function not found in post-patch source: "), "function")), F.when(here & F.col("no_pre"), POST_AS_PRE), F.when(here & F.col("__l"), POST_TREE), F.when(here & F.col("__wide"), WHOLE_FILE),
        ))
        errors = F.when(tried & ~here, F.array(F.lit(NO_NODE))).otherwise(F.col("errors"))
        return status.select("fn", F.when(here, "ok").otherwise("failed").alias("status"), errors.alias("errors"), F.concat("warnings", said).alias("warnings"))

    @cached_property
    def entities(self) -> DataFrame:
        values = macros.resolved(self._post_symbols[2], "fn").withColumn("kind", F.lit("macro"))
        return self._kinds.join(values, ["fn", "name", "kind"], "left").select("fn", "line", "name", "kind", F.col("value").alias("resolved_value"))

    @cached_property
    def events(self) -> DataFrame:
        return written(dataflow.events(syntax.def_use(self._inside, self._texts("post"), self._key)))

    @cached_property
    def pre_events(self) -> DataFrame:
        tracked = self._key.union(self._old_names.filter("not is_call").select("fn", "name")).distinct()
        return written(dataflow.events(syntax.def_use(self._pre_inside, self._texts("pre"), tracked)))

    @cached_property
    def edges(self) -> DataFrame:
        params, local, named = self._symbols(self._pre_inside, "pre")
        symbols = params.withColumn("role", F.lit("param")).union(named.select("fn", "name", F.lit("macro"))).union(local.withColumn("role", F.lit("local")))
        return written(dataflow.edges(self.pre_events, self._sink, symbols))

    @cached_property
    def flow(self) -> DataFrame:
        return dataflow.source_sink(self._sink, self.edges, self._old, self._old_names)

    @cached_property
    def blocks(self) -> DataFrame:
        return dataflow.focused_blocks(self._changed.filter("side = 'new'"), self.events)

    @cached_property
    def code(self) -> DataFrame:
        params, local, _ = self._post_symbols
        own = lambda df: df.withColumnRenamed("fn_id", "fn")
        return dataflow.reduced_code(own(syntax.headers(self._inside)), self.blocks, own(syntax.declarations(self._inside)), local, params)

    @cached_property
    def hunks(self) -> DataFrame:
        in_file = diff.split_hunks(diff.blocks(self._diffs, "fn"), "fn").join(self._ranges.select("fn", F.col("new_path").alias("path")).hint("merge"), ["fn", "path"], "left_semi")
        return diff.overlapping(in_file, self._ranges, "fn")


def analysed(functions: DataFrame, blobs: DataFrame, diffs: DataFrame) -> Analysis:
    """Tables of an analysis of functions (fn, function, repo, commit, file) under diffs (fn, text).

    `status` has (fn, status, errors, warnings). For functions whose definition is found there are
    `entities` (names on added lines with their kinds and macro values), `events` of the key
    variables after the patch, `pre_events` of these and of names on removed lines before it,
    `edges` and `flow` from sources to sinks before the patch, `blocks`, reduced `code` and `hunks`.
    Where no changed line is in a function's range, all changed lines of its file count.
    """
    return Analysis(functions, blobs, diffs)
