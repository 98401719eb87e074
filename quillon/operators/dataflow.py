"""Def/use events of functions: grouping, source-to-sink edges, focused blocks, reduced code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import compact_code
from quillon.operators.intervals import closure, outermost, uncovered

DEFINES = ("def", "def_decl", "param_def")


def events(found: DataFrame) -> DataFrame:
    """Events without repeats of (line, var, op, node_type, callee), the first by line, var, op and seq."""
    w = Window.partitionBy("fn", "line", "var", "op", "node_type", "callee").orderBy("seq")
    return found.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def of_variables(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events of wanted variables (fn, var)."""
    return found.join(wanted, ["fn", "var"], "left_semi")


def by_variable(tracked: DataFrame, found: DataFrame) -> DataFrame:
    """(fn, var, defs, uses, all_events) of every tracked variable; counts and lines in order.

    Variables without events stay, with empty lists.
    """
    rows = tracked.join(found, ["fn", "var"], "left")
    item = F.struct("line", "op", "seq")
    pick = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, item))), lambda x: x["line"])
    return rows.groupBy("fn", "var").agg(
        pick(F.col("op").isin(*DEFINES)).alias("defs"), pick(F.startswith("op", F.lit("use"))).alias("uses"), pick(F.col("op").isNotNull()).alias("all_events")
    )


def classified(names: DataFrame, apis: DataFrame, macros: DataFrame, own: DataFrame) -> DataFrame:
    """(fn, line, name, kind): api over macro over local_or_param over global_or_external.

    `names` is (fn, line, name); apis are calls on a line (fn, line, name), macros (fn, name), own
    parameters and locals (fn, name).
    """
    mark = lambda df, keys, c: df.select(*keys).distinct().withColumn(c, F.lit(True))
    rows = names.distinct().join(mark(apis, ("fn", "line", "name"), "__a"), ["fn", "line", "name"], "left")
    rows = rows.join(mark(macros, ("fn", "name"), "__m"), ["fn", "name"], "left").join(mark(own, ("fn", "name"), "__o"), ["fn", "name"], "left")
    kind = F.when(F.col("__a"), "api").when(F.col("__m"), "macro").when(F.col("__o"), "local_or_param").otherwise("global_or_external")
    return rows.select("fn", "line", "name", kind.alias("kind"))


def line_variables(classes: DataFrame) -> DataFrame:
    """(fn, line, name) of names on a line that are no calls there."""
    return classes.filter("kind <> 'api'").select("fn", "line", "name")


def sinks(old_names: DataFrame, old_lines: DataFrame, found: DataFrame) -> DataFrame:
    """(fn, var): variables near the removed lines.

    Names on removed lines that have events; where a function has none of these, variables of
    events on removed lines; else variables whose statement stands in the removed text.
    """
    names = old_names.groupBy("fn").agg(F.collect_set("name").alias("__names"))
    lines = old_lines.groupBy("fn").agg(
        F.collect_set(F.col("ln").cast("long")).alias("__lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "content"))), lambda x: x["content"]), " ").alias("__t")
    )
    # what a function's removed lines say is one row, so events are dealt out once, by function, and never broadcast
    said = names.join(lines.hint("merge"), "fn", "full_outer").withColumn("__t", F.trim(F.regexp_replace("__t", "\\s+", " ")))
    inside = (F.coalesce("stmt_code", F.lit("")) != "") & F.contains("__t", F.col("stmt_code"))
    tier = F.when(F.array_contains("__names", F.col("var")), 0).when(F.array_contains("__lines", F.col("line").cast("long")), 1).when(inside, 2)
    rows = found.select("fn", "var", "line", "stmt_code").join(said.hint("merge"), "fn").withColumn("tier", tier).filter("tier is not null")
    every = rows.groupBy("fn", "var").agg(F.min("tier").alias("tier")).groupBy("fn").agg(F.min("tier").alias("__m"), F.collect_list(F.struct("tier", "var")).alias("__v"))
    return every.select("fn", F.explode(F.filter("__v", lambda v: v["tier"] == F.col("__m"))).alias("v")).select("fn", "v.var")


def edges(found: DataFrame, sink: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fn, source, to, line, kind, seq, pos): where a sink's definitions come from; repeats stay.

    `symbols` has (fn, name, role) with role param, macro or local; the first of these in this
    order names a right-hand side, others are global_or_external.
    """
    rank = F.when(F.col("role") == "param", 0).when(F.col("role") == "macro", 1).otherwise(2)
    roles = symbols.groupBy("fn", "name").agg(F.min_by("role", rank).alias("role"))
    mine = found.join(sink, ["fn", "var"], "left_semi")
    param = mine.filter("op = 'param_def'").select("fn", F.concat(F.lit("param:"), "var").alias("source"), F.col("var").alias("to"), "line", F.lit("param_def").alias("kind"), "seq", F.lit(0).alias("pos"))
    used = mine.filter("op in ('def', 'def_decl')").select("fn", F.col("var").alias("to"), "line", "seq", F.posexplode("rhs_vars").alias("pos", "name"))
    said = F.concat(F.coalesce("role", F.lit("global_or_external")), F.lit(":"), "name")
    return param.union(used.join(roles, ["fn", "name"], "left").select("fn", said.alias("source"), "to", "line", F.lit("rhs_dep").alias("kind"), "seq", "pos"))


def source_sink(sink: DataFrame, flow: DataFrame, old_lines: DataFrame, old_names: DataFrame) -> DataFrame:
    """(fn, sink_vars, sink_calls, sources, text) of functions with removed lines.

    `old_names` are (fn, name, is_call) on the removed lines (fn, ln, content). The text names the
    lines, what stands on them, and each sink with its sources and the reasons, in event order.
    """
    none = F.array().cast("array<string>")
    why = F.when(F.col("kind") == "param_def", F.concat("to", F.lit(" defined from function parameter at line "), F.col("line").cast("string"))).otherwise(
        F.concat("to", F.lit(" depends on "), F.regexp_replace("source", "^[a-z_]+:", ""), F.lit(" at line "), F.col("line").cast("string"))
    )
    per = flow.groupBy("fn", F.col("to").alias("var")).agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "pos", why.alias("w")))), lambda x: x["w"]).alias("why")
    )
    rows = sink.distinct().join(per, ["fn", "var"], "left")
    item = F.concat(F.lit("- Sink var `"), "var", F.lit("`"), F.when(F.size("sources") > 0, F.concat(F.lit("\n  Sources: "), F.array_join("sources", ", "))).otherwise(""), F.coalesce(F.array_join(F.transform("why", lambda w: F.concat(F.lit("\n  - "), w)), ""), F.lit("")))
    body = rows.groupBy("fn").agg(
        F.sort_array(F.collect_list("var")).alias("sink_vars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("var", item.alias("i")))), lambda x: x["i"]), "\n").alias("items"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", none))))).alias("sources"),
    )
    names = old_names.groupBy("fn").agg(F.sort_array(F.collect_set(F.when(~F.col("is_call"), F.col("name")))).alias("idents"), F.sort_array(F.collect_set(F.when(F.col("is_call"), F.col("name")))).alias("sink_calls"))
    lines = old_lines.groupBy("fn").agg(F.array_join(F.transform(F.sort_array(F.collect_set("ln")), lambda n: n.cast("string")), ", ").alias("old"))
    both = lines.join(names, "fn", "left").join(body, "fn", "left")
    listed = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    text = F.concat_ws(
        "\n", F.lit("[Pre-patch Source-Sink Flow]"), F.concat(F.lit("Old patch lines (treated as sink region): ["), "old", F.lit("]")), listed("Old-line idents: ", "idents"),
        listed("Sink calls in old region: ", "sink_calls"), F.coalesce(listed("Sink-adjacent variables: ", "sink_vars"), F.lit("Sink-adjacent variables: (none)")), "items",
    )
    return both.select("fn", *(F.coalesce(c, none).alias(c) for c in ("sink_vars", "sink_calls", "sources")), text.alias("text"))


def focused_blocks(changed: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks of changed lines and of statements with events: (fn, start_line, end_line, kind, code, raw_code, vars, all_ids).

    Statements of one span and code are one block with the first raw code and sorted names.
    """
    raw = F.trim(F.regexp_replace("content", "^\\s+|\\s+$", ""))
    none = F.array().cast("array<string>")
    patch = changed.select("fn", F.col("ln").alias("start_line"), F.col("ln").alias("end_line"), F.lit("patch_line").alias("kind"), compact_code(raw).alias("code"), raw.alias("raw_code"), none.alias("vars"), none.alias("all_ids"))
    code = F.trim(F.coalesce(F.nullif(F.col("stmt_code"), F.lit("")), F.col("code"), F.lit("")))
    whole = F.trim(F.coalesce(F.nullif(F.col("stmt_code_raw"), F.lit("")), F.nullif(F.col("stmt_code"), F.lit("")), F.col("code"), F.lit("")))
    rows = found.withColumn("__c", code).withColumn("__w", whole).groupBy("fn", F.col("line").alias("start_line"), "end_line", F.col("__c").alias("code"))
    stmt = rows.agg(F.min_by("__w", "seq").alias("raw_code"), F.sort_array(F.collect_set("var")).alias("vars"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("stmt_all_ids")))).alias("all_ids"))
    return patch.unionByName(stmt.withColumn("kind", F.lit("stmt")).select(*patch.columns))


def reduced_code(headers: DataFrame, blocks: DataFrame, declarations: DataFrame, local_names: DataFrame, params: DataFrame) -> DataFrame:
    """(fn, code): header, the declarations that the kept statements need, the statements, a brace.

    `headers` is (fn, header), `declarations` (fn, var, start_line, end_line, code, ids), names are
    (fn, name). Declarations inside kept statements of several lines go, and so do statements on
    lines that a declaration has already given.
    """
    kept = outermost(blocks.filter("kind = 'stmt'").withColumn("seq", F.row_number().over(Window.partitionBy("fn").orderBy("start_line", "end_line", "code"))), "fn")
    own = local_names.select("fn", F.col("name").alias("var")).distinct()
    needed = kept.select("fn", F.explode("all_ids").alias("var")).join(own, ["fn", "var"], "left_semi").join(params.select("fn", F.col("name").alias("var")), ["fn", "var"], "left_anti")
    depends = declarations.select("fn", "var", F.explode("ids").alias("dep")).join(own.withColumnRenamed("var", "dep"), ["fn", "dep"], "left_semi")
    chosen = declarations.join(closure(needed, depends), ["fn", "var"], "left_semi").select("fn", "start_line", "end_line", "code").distinct()
    chosen = uncovered(chosen, kept.select("fn", "start_line", "end_line"), "fn")
    lines = chosen.select("fn", F.explode(F.sequence("start_line", "end_line")).alias("ln")).distinct()
    given = lambda c, name: lines.select("fn", F.col("ln").alias(c), F.lit(True).alias(name))
    rest = kept.join(given("start_line", "__a"), ["fn", "start_line"], "left").join(given("end_line", "__b"), ["fn", "end_line"], "left").filter("not (coalesce(__a, false) and coalesce(__b, false))")

    def text(df: DataFrame, column: Column, name: str) -> DataFrame:
        item = F.struct("start_line", "end_line", column.alias("c"))
        return df.groupBy("fn").agg(F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["c"]), lambda c: c != ""), "\n").alias(name))

    both = headers.join(text(chosen, F.rtrim("code"), "d"), "fn", "left").join(text(rest, F.trim("raw_code"), "s"), "fn", "left").join(kept.groupBy("fn").agg(F.lit(True).alias("k")), "fn", "left")
    parts = F.concat_ws("\n", "header", F.nullif(F.col("d"), F.lit("")), F.when(F.col("d").isNotNull() & F.col("k"), ""), F.nullif(F.col("s"), F.lit("")), F.lit("}"))
    return both.select("fn", parts.alias("code"))
