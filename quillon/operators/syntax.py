"""Syntax trees as tables, and what is read from them by joins on preorder ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import cparse
from quillon.functions.text import compact_code, is_symbol
from quillon.operators import ranges
from quillon.operators.sweep import nearest_around
from quillon.sources.schemas import AST_NODE

CONTROL = ("if_statement", "switch_statement", "while_statement", "for_statement", "return_statement")
ANCHORS = (*CONTROL, "expression_statement", "declaration", "do_statement")
_OF_PARENT = {"init_declarator": ("declaration", "expression_statement"), "assignment_expression": ("expression_statement", "declaration"), "update_expression": ("expression_statement", "declaration"), "call_expression": ("expression_statement", "declaration", "return_statement"), "parameter_declaration": ("parameter_declaration",), "declaration": ANCHORS, **{c: CONTROL for c in CONTROL}}


#: Nodes that a worker holds before it hands them on; one source's stay together.
SLICE = 8192


def parse(sources: DataFrame, key: str = "fn_id", text: str = "text") -> DataFrame:
    """ast_node rows of C sources; tables of nodes from a fuller parser may be used in its place."""

    columns = ["fn_id", "node_id", "parent_id", "last_id", "type", "field", "start_line", "end_line", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                out += [(k, *r) for r in cparse.rows(t or "")]
                if len(out) >= SLICE:
                    yield pd.DataFrame(out, columns=columns)[AST_NODE.names]
                    out = []
            yield pd.DataFrame(out, columns=columns)[AST_NODE.names]

    rows = sources.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    # a fixed number of parts: sources are small and costly, so parts by size would leave them to one task
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").mapInPandas(run, AST_NODE)


def identifiers(nodes: DataFrame, within: DataFrame) -> DataFrame:
    """`within` rows (fn_id, lo, hi, ...) joined with the symbols (name, ident) in their preorder range."""
    ids = nodes.filter("type = 'identifier'").filter(is_symbol(F.col("text"))).select("fn_id", F.col("node_id").alias("ident"), F.col("text").alias("name"))
    return within.join(ids, "fn_id").filter("lo <= ident and ident <= hi")


def _function_part(nodes: DataFrame, kind: str) -> DataFrame:
    fn = nodes.filter("type = 'function_definition'").select("fn_id", F.col("node_id").alias("__f"))
    part = nodes.filter(F.col("type") == kind).join(fn, "fn_id")
    return part.filter("parent_id = __f or type = 'function_declarator'").select("fn_id", F.col("node_id").alias("__lo"), F.col("last_id").alias("__hi"))


def parameters(nodes: DataFrame) -> DataFrame:
    """(fn_id, name) of every identifier in parameter declarations."""
    decl = nodes.filter("type = 'parameter_declaration'").select("fn_id", F.col("node_id").alias("lo"), F.col("last_id").alias("hi"))
    return identifiers(nodes, decl).select("fn_id", "name").distinct()


def local_names(nodes: DataFrame) -> DataFrame:
    """(fn_id, name) of every identifier in declarations of the body, those of initialisers included."""
    body = _function_part(nodes, "compound_statement")
    decl = nodes.filter("type = 'declaration'").join(body, "fn_id").filter("__lo <= node_id and node_id <= __hi").select("fn_id", F.col("node_id").alias("lo"), F.col("last_id").alias("hi"))
    return identifiers(nodes, decl).select("fn_id", "name").distinct()


def declarations(nodes: DataFrame) -> DataFrame:
    """(fn_id, var, start_line, end_line, code, ids): each local's last declaration.

    A declarator declares its last identifier.
    """
    decl = nodes.filter("type = 'declaration'").select("fn_id", F.col("node_id").alias("decl"), F.col("last_id").alias("hi"), "start_line", "end_line", F.trim("text").alias("code"))
    kinds = ("init_declarator", "pointer_declarator", "array_declarator", "function_declarator", "identifier")
    kids = nodes.filter(F.col("type").isin(*kinds)).select("fn_id", F.col("parent_id").alias("decl"), F.col("node_id").alias("kid"), "type", "last_id")
    inner = nodes.filter("field = 'declarator'").select("fn_id", F.col("parent_id").alias("kid"), F.col("node_id").alias("__a"), F.col("last_id").alias("__b"))
    kids = kids.join(inner, ["fn_id", "kid"], "left")
    init = F.col("type") == "init_declarator"
    spans = kids.select("fn_id", "decl", "kid", F.when(init, F.col("__a")).otherwise(F.col("kid")).alias("lo"), F.when(init, F.col("__b")).otherwise(F.col("last_id")).alias("hi"))
    named = identifiers(nodes, spans).groupBy("fn_id", "decl", "kid").agg(F.max_by("name", "ident").alias("var"))
    ids = identifiers(nodes, decl.select("fn_id", "decl", F.col("decl").alias("lo"), "hi")).groupBy("fn_id", "decl").agg(F.sort_array(F.collect_set("name")).alias("ids"))
    rows = named.join(decl, ["fn_id", "decl"]).join(ids, ["fn_id", "decl"])
    return rows.groupBy("fn_id", "var").agg(F.max_by(F.struct("start_line", "end_line", "code", "ids"), "decl").alias("d")).select("fn_id", "var", "d.*")


def named_spans(nodes: DataFrame) -> DataFrame:
    """(fn_id, name, is_call, start_line, end_line): symbols with the lines that give them.

    A symbol is given by its own lines; a call gives its function's names and its arguments' names by
    every line that it spans.
    """
    calls = nodes.filter("type = 'call_expression'").select("fn_id", F.col("node_id").alias("call"), "start_line", "end_line")
    parts = nodes.filter("field in ('function', 'arguments')").select("fn_id", F.col("parent_id").alias("call"), "field", F.col("node_id").alias("lo"), F.col("last_id").alias("hi"))
    spans = calls.join(parts, ["fn_id", "call"])
    of_calls = identifiers(nodes, spans).select("fn_id", "name", (F.col("field") == "function").alias("is_call"), "start_line", "end_line")
    own = nodes.filter("type = 'identifier'").filter(is_symbol(F.col("text"))).select("fn_id", F.col("text").alias("name"), F.lit(False).alias("is_call"), "start_line", "end_line")
    return of_calls.union(own).distinct()


def entities(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(fn_id, line, name, is_call): symbols of the lines asked for (fn_id, line), looked up in the lines' ranges that give them."""
    asked = lines.select("fn_id", "line").distinct()
    return ranges.stab(asked, named_spans(nodes), ["fn_id"], "line", "start_line", "end_line").select("fn_id", "line", "name", "is_call").distinct()


def loose_entities(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, name, is_call) of loose statement lines, parsed inside a function of their own."""
    wrapped = F.concat(F.lit("void quillon_loose(void) {\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(line).alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n}\n"))
    nodes = parse(lines.groupBy(key).agg(wrapped.alias("text")), key)
    return named_spans(nodes).filter("name <> 'quillon_loose'").select(F.col("fn_id").alias(key), "name", "is_call").distinct()


def anchored(nodes: DataFrame) -> DataFrame:
    """Nodes that give events, with the statement that each belongs to: itself or its nearest ancestor of the kinds that count."""
    own = nodes.filter(F.col("type").isin(*_OF_PARENT)).join(nearest_around(nodes, _OF_PARENT).withColumnRenamed("around", "a"), ["fn_id", "node_id"])
    over = nodes.filter(F.col("type").isin(*{*ANCHORS, *_OF_PARENT})).select("fn_id", F.col("node_id").alias("a"), F.col("last_id").alias("a_last"), F.col("start_line").alias("line"), F.col("end_line").alias("a_end"), F.col("text").alias("a_text"))
    return own.join(over, ["fn_id", "a"]).select("fn_id", "node_id", "last_id", "type", "text", F.struct("a", "a_last", "line", "a_end", "a_text").alias("s"))


def def_use(nodes: DataFrame, sources: DataFrame, tracked: DataFrame) -> DataFrame:
    """Def/use events of tracked variables (fn, name), before events() drops repeats.

    Parameters, declarations, initialisers, assignments, updates, calls and control statements give
    events; only assignments carry right-hand names, `do` loops give none.
    """
    anchors = anchored(nodes)
    fields = nodes.filter("field is not null").select("fn_id", F.col("parent_id").alias("node_id"), "field", F.col("node_id").alias("lo"), F.col("last_id").alias("hi"), F.col("text").alias("f_text"))
    parts = anchors.join(fields, ["fn_id", "node_id"])
    whole = anchors.withColumn("lo", F.col("node_id")).withColumn("hi", F.col("last_id")).withColumn("field", F.lit("")).withColumn("f_text", F.lit(None).cast("string"))
    conditions = fields.filter("field = 'condition'").select("fn_id", "node_id", F.lit(True).alias("__c"))
    bare = whole.join(conditions, ["fn_id", "node_id"], "left").filter((F.col("type").isin("parameter_declaration", "declaration")) | (F.col("type").isin(*CONTROL) & F.col("__c").isNull())).drop("__c")
    rules = (
        ("parameter_declaration", "", "param_def"), ("declaration", "", "def_decl"), ("init_declarator", "declarator", "def"), ("init_declarator", "value", "use"),
        ("assignment_expression", "left", "def"), ("assignment_expression", "right", "use"), ("update_expression", "argument", "def"), ("update_expression", "argument", "use"),
        ("call_expression", "arguments", "use_call"), *((c, "condition", "use_control") for c in CONTROL), *((c, "", "use_control") for c in CONTROL),
    )
    ops = F.array(*(F.when((F.col("type") == t) & (F.col("field") == f), F.lit(op)) for t, f, op in rules))
    spans = parts.unionByName(bare.select(*parts.columns)).withColumn("ops", F.filter(ops, lambda o: o.isNotNull())).filter("size(ops) > 0")
    seen = identifiers(nodes, spans).join(tracked.select(F.col("fn").alias("fn_id"), "name").distinct(), ["fn_id", "name"], "left_semi")
    rows = seen.withColumn("op", F.explode("ops"))
    right = identifiers(nodes, parts.filter("type = 'assignment_expression' and field = 'right'").select("fn_id", "node_id", "lo", "hi")).groupBy("fn_id", "node_id").agg(F.sort_array(F.collect_set("name")).alias("rhs"))
    callee = identifiers(nodes, parts.filter("type = 'call_expression' and field = 'function'").select("fn_id", "node_id", "lo", "hi")).groupBy("fn_id", "node_id").agg(F.min_by("name", "ident").alias("callee"))
    every = identifiers(nodes, anchors.select("fn_id", F.col("s.a").alias("a"), F.col("s.a").alias("lo"), F.col("s.a_last").alias("hi")).distinct()).groupBy("fn_id", "a").agg(F.sort_array(F.collect_set("name")).alias("stmt_all_ids"))
    rows = rows.withColumn("a", F.col("s.a")).join(right, ["fn_id", "node_id"], "left").join(callee, ["fn_id", "node_id"], "left").join(every, ["fn_id", "a"], "left")
    lines = sources.select(F.col("fn_id").cast("string").alias("fn_id"), F.split("text", "\n").alias("__lines"))
    rows = rows.join(lines, "fn_id")
    control = F.col("op") == "use_control"
    said: Column = F.when(F.col("field") == "condition", F.concat("type", F.lit(": ("), "f_text", F.lit(")"))).when(F.col("type") == "return_statement", F.concat(F.lit("return_statement: "), "text")).otherwise(F.col("text"))
    order = F.row_number().over(Window.partitionBy("fn_id").orderBy("line", "name", "op", "node_id", "ident"))
    return rows.withColumn("line", F.col("s.line")).select(
        F.col("fn_id").alias("fn"), "line", F.col("s.a_end").alias("end_line"), F.trim(F.coalesce(F.try_element_at("__lines", F.col("line")), F.lit(""))).alias("code"),
        compact_code(F.when(control, said).otherwise(F.col("s.a_text"))).alias("stmt_code"), F.trim(F.when(control, F.col("text")).otherwise(F.col("s.a_text"))).alias("stmt_code_raw"),
        "stmt_all_ids", F.col("name").alias("var"), "op", F.col("type").alias("node_type"),
        F.when((F.col("op") == "def") & (F.col("type") == "assignment_expression"), F.coalesce("rhs", F.array().cast("array<string>"))).alias("rhs_vars"),
        F.when(F.col("op") == "use_call", F.col("callee")).alias("callee"), order.alias("seq"),
    )


def headers(nodes: DataFrame) -> DataFrame:
    """(fn_id, header): a function's text before its body, and the opening brace."""
    fn = nodes.filter("type = 'function_definition'").groupBy("fn_id").agg(F.min_by(F.struct("node_id", "text"), "node_id").alias("f"))
    body = nodes.filter("type = 'compound_statement' and field = 'body'").select("fn_id", F.col("parent_id").alias("p"), F.col("text").alias("b"))
    joined = fn.join(body, "fn_id").filter("p = f.node_id")
    head = F.expr("substring(f.text, 1, length(f.text) - length(b))")
    return joined.select("fn_id", F.concat(F.rtrim(F.regexp_replace(head, "\\s+$", "")), F.lit("\n{")).alias("header"))


def function_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(fn_id, name, node_id, last_id, start_line, end_line): the first definition of each wanted name (fn_id, name)."""
    fn = nodes.filter("type = 'function_definition'").select("fn_id", "node_id", "last_id", "start_line", "end_line")
    heads = nodes.filter("type = 'function_declarator'").select("fn_id", F.col("node_id").alias("lo"), F.col("last_id").alias("hi"))
    first = identifiers(nodes, heads).groupBy("fn_id", "lo").agg(F.min_by("name", "ident").alias("name"))
    both = fn.join(first, "fn_id").filter("node_id <= lo and lo <= last_id").join(names, ["fn_id", "name"], "left_semi")
    return both.groupBy("fn_id", "name").agg(F.min_by(F.struct("node_id", "last_id", "start_line", "end_line"), "node_id").alias("d")).select("fn_id", "name", "d.*")
