"""Bounded queries over ordered line streams: symbol ranges, context, byte caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import clamp


def split_lines(text: Column | str) -> Column:
    """The lines of a text; a line feed at the end opens no line."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no from 1, line) of texts; a line feed at the end opens no line."""
    return df.select(*keys, F.posexplode(split_lines(text)).alias("__n", "line")).withColumn("line_no", F.col("__n") + 1).drop("__n")


def symbol_ranges(symbols: DataFrame, window: Column | int, *keys: str) -> DataFrame:
    """Symbols with [addr, stop): up to the next symbol, `window` at most, one byte at least.

    Symbols at one address end one byte on, except the last of them.
    """
    size = window if isinstance(window, Column) else F.lit(window)
    order = Window.partitionBy(*keys).orderBy("addr", "seq")
    far = F.col("addr") + size
    return symbols.withColumn("stop", F.greatest(F.col("addr") + 1, F.least(F.coalesce(F.lead("addr").over(order), far), far)))


def symbol_range(ranges: DataFrame, name: str, *keys: str) -> DataFrame:
    """The first symbol of a name by address; no row where there is none."""
    hits = ranges.filter(F.col("name") == name)
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("addr", "seq"))).filter("__r = 1").drop("__r")


def parse_symbols(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(addr, kind, name, seq) of symbol-table lines: three fields, code symbols only."""
    parts = F.split(F.regexp_replace(line, "^\\s+|\\s+$", ""), "\\s+", 3)
    rows = lines.withColumn("__p", parts).filter((F.size("__p") == 3) & F.regexp_like(F.col("__p")[0], F.lit("^[0-9A-Fa-f]+$")))
    rows = rows.filter(F.lower(F.col("__p")[1]).isin("t", "w"))
    return rows.select(F.conv(F.col("__p")[0], 16, 10).cast("decimal(20,0)").cast("long").alias("addr"), F.col("__p")[1].alias("kind"), F.col("__p")[2].alias("name"), F.col(order).cast("long").alias("seq"))


def has_debug_lines(lines: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    return lines.groupBy(*keys).agg(F.coalesce(F.bool_or(F.contains(line, F.lit(".debug_line"))), F.lit(False)).alias("has_debug_line"))


def address_window(addr: Column, window: Column) -> tuple[Column, Column]:
    """The half-open range of half a window on either side of an address."""
    half = F.greatest(F.lit(1), F.floor(window / 2)).cast("long")
    return F.greatest(F.lit(0), addr - half), addr + half


def in_range(lines: DataFrame, start: Column, stop: Column) -> DataFrame:
    return lines.filter((F.col("addr") >= start) & (F.col("addr") < stop))


def clamped_limits(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Requests with window, context and max_output inside the configured bounds, a table of one row.

    Any other number of rows fails the query.
    """
    one = config.agg(F.count("*").alias("__n"), F.first(F.struct(*config.columns)).alias("__c"))
    one = one.select(F.when(F.col("__n") == 1, F.col("__c")).otherwise(F.raise_error(F.lit("the view configuration is not one row")).cast(one.schema["__c"].dataType)).alias("__c"))
    both = requests.crossJoin(F.broadcast(one.select("__c.*")))
    out = both.withColumn("window", clamp(F.coalesce("window", "default_window"), 1, F.col("max_window")))
    out = out.withColumn("context", clamp(F.coalesce("context", "default_context"), 0, F.col("max_context")))
    out = out.withColumn("max_output", clamp(F.coalesce("max_output", "default_max_output"), F.col("min_max_output"), F.col("max_max_output")))
    return out.select(*requests.columns)


#: Lines of a chunk: what one task sorts of a stream, however long that is.
CHUNK = 4096


def _column(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def grep(lines: DataFrame, pattern: Column | str, context: Column | int, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """Lines within `context` of a hit, with `hit`, `separator` (a `--` line goes before it) and
    `group`, the line of the hit that emits them.

    Each line comes once. A separator stands before the first line of every hit but the first, also
    between neighbouring hits, unless the line emitted before ends in `--`. Streams are cut into
    chunks; a hit is told to the chunks that its context reaches, and the last line that a chunk
    emits to the next one that emits any, so no task sorts a whole stream.
    """
    number = lambda c: F.floor(c / chunk).cast("long")
    rows = lines.withColumn("hit", F.regexp_like("line", _column(pattern))).withColumn("__near", _column(context).cast("long")).withColumn("__chunk", number(F.col("line_no")))
    reach = F.sequence(number(F.col("line_no") - F.col("__near")), number(F.col("line_no") + F.col("__near")))
    marks = rows.filter("hit").withColumn("__own", F.col("__chunk")).withColumn("__chunk", F.explode(reach)).filter("__chunk <> __own")
    both = rows.withColumn("__mark", F.lit(False)).unionByName(marks.select(*keys, "line_no", "__chunk", "hit", F.lit(True).alias("__mark")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__chunk").orderBy("line_no")
    at = F.when(F.col("hit"), F.col("line_no"))
    both = both.withColumn("__last", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # from behind, since a frame that shrinks is summed anew for every row
    back = Window.partitionBy(*keys, "__chunk").orderBy(F.desc("line_no"))
    both = both.withColumn("__next", F.last(at, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    after, before = F.coalesce(F.col("line_no") - F.col("__last") <= F.col("__near"), F.lit(False)), F.coalesce(F.col("__next") - F.col("line_no") <= F.col("__near"), F.lit(False))
    # a hit's group begins with the lines before it that no earlier hit has emitted
    group = F.when(F.col("hit"), F.col("line_no")).when(after, F.col("__last")).otherwise(F.col("__next"))
    kept = both.filter(~F.col("__mark") & (after | before)).withColumn("__g", group)
    said = F.struct(F.col("__g").alias("g"), F.endswith("line", F.lit("--")).alias("dashes"))
    ends = kept.groupBy(*keys, "__chunk").agg(F.max_by(said, "line_no").alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__chunk")))
    kept = kept.withColumn("__prior", F.lag(said).over(w)).join(ends, [*keys, "__chunk"])
    prior = F.coalesce("__prior", "__end")
    separator = F.coalesce((prior["g"] != F.col("__g")) & ~prior["dashes"], F.lit(False))
    return kept.select(*lines.columns, "hit", separator.alias("separator"), F.col("__g").alias("group"))


def under_cap(lines: DataFrame, size: Column, cap: Column | int, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """Lines of the chunks that begin at or before the cap, with __before (bytes of the stream in front), __size and __total.

    Sizes are summed by chunk where they are read, these sums are added up along each stream, and
    only lines of chunks that a scan reaches before it stops are sorted, each chunk on its own.
    """
    rows = lines.withColumn("__size", size.cast("long")).withColumn("__cap", _column(cap).cast("long")).withColumn("__chunk", F.floor(F.col("line_no") / chunk).cast("long"))
    sums = rows.groupBy(*keys, "__chunk").agg(F.sum("__size").alias("__sum"), F.max("__cap").alias("__limit"))
    along = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__from", F.coalesce(F.sum("__sum").over(along), F.lit(0))).withColumn("__total", F.sum("__sum").over(Window.partitionBy(*keys)))
    reached = sums.filter("__from <= __limit").select(*keys, "__chunk", "__from", "__total")
    inside = Window.partitionBy(*keys, "__chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(reached, [*keys, "__chunk"]).withColumn("__before", F.col("__from") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return rows.drop("__chunk", "__from")


def capped(lines: DataFrame, cap: Column | int, *keys: str, separator: Column | None = None, whole: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Emitted lines under a byte cap: `out` is what of a line (and its separator) is emitted.

    The line at which the cap is reached is cut at that byte, a character cut in two is replaced.
    `truncated` tells for each line whether its stream is longer than the cap. Streams whose lines
    are numbered from 1 without gaps may be given as `whole`: every line has a byte at least, so no
    line beyond the cap's number is shuffled.
    """
    emitted = F.concat(F.when(separator, F.lit("--\n")).otherwise(F.lit("")) if separator is not None else F.lit(""), "line", F.lit("\n"))
    rows = lines.withColumn("__chunk_text", emitted)
    size = F.octet_length("__chunk_text").cast("long")
    if whole:
        total = rows.groupBy(*keys).agg(F.sum(size).alias("__whole"))
        rows = rows.filter(F.col("line_no") <= _column(cap)).join(total, list(keys))
    rows = under_cap(rows, size, cap, *keys, chunk=chunk).filter("__before < __cap")
    rows = rows.withColumn("bytes_before", F.col("__before")).withColumn("bytes_to", F.col("__before") + F.col("__size")).withColumn("truncated", F.col("__whole" if whole else "__total") > F.col("__cap"))
    cut = F.make_valid_utf8(F.substring(F.col("__chunk_text").cast("binary"), F.lit(1), (F.col("__cap") - F.col("bytes_before")).cast("int")).cast("string"))
    out = F.when(F.col("bytes_to") <= F.col("__cap"), F.col("__chunk_text")).otherwise(cut)
    return rows.select(*lines.columns, "bytes_to", "truncated", "bytes_before", out.alias("out"))


def output(lines: DataFrame, cap: Column | int, *keys: str, separator: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, text, truncated) of each stream."""
    rows = capped(lines, cap, *keys, separator=separator, chunk=chunk)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "out"))), lambda x: x["out"]), "")
    return rows.groupBy(*keys).agg(text.alias("text"), F.bool_or("truncated").alias("truncated"))


def hits_before_cap(found: DataFrame, cap: Column | int, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """(keys, matched): hits that a scan under a byte cap sees before it stops."""
    size = F.octet_length("line").cast("long") + 1 + F.when(F.col("separator"), 3).otherwise(0)
    # a hit counts once its first line is reached; that is its group's first line
    rows = under_cap(found, size, cap, *keys, chunk=chunk)
    first = rows.groupBy(*keys, "group").agg(F.min("__before").alias("__b"), F.first("__cap").alias("__cap"))
    return first.groupBy(*keys).agg(F.count_if(F.col("__b") <= F.col("__cap")).alias("matched"))


#: What a bounded view says, and how many symbols a miss names.
NO_DEBUG = "# note: --line-numbers ignored because binary has no .debug_line section\n"
ADVICE = {"grep": "narrow --grep, reduce --context, or use --addr/--symbol.", "both": "use a smaller --window/--context or a more specific --grep.", "range": "use a smaller --window or add --grep."}
NAMED = 20


def located(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Requests (id, binary, symbol, addr, window) with start and stop of what they ask for, or `error`.

    A symbol reaches up to the next one, by its first occurrence by address; a miss names the first
    NAMED symbols of the binary. An address gets half a window to either side; with neither, both
    ends are null, which is the whole binary.
    """
    order = Window.partitionBy("binary").orderBy("addr", "seq")
    known = symbols.select("binary", F.col("name").alias("symbol"), F.col("addr").alias("__at"), F.lead("addr").over(order).alias("__next"), F.row_number().over(order).alias("__r"))
    first = known.groupBy("binary", "symbol").agg(F.min_by(F.struct("__at", "__next"), "__r").alias("__s"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("__r", "symbol"))), lambda x: x["symbol"])
    sample = known.filter(F.col("__r") <= NAMED).groupBy("binary").agg(F.array_join(named, ", ").alias("__sample"))
    rows = requests.join(first, ["binary", "symbol"], "left").join(sample, "binary", "left")
    by_symbol, far = F.col("symbol").isNotNull(), F.col("__s.__at") + F.col("window")
    stop = F.greatest(F.col("__s.__at") + 1, F.least(F.coalesce("__s.__next", far), far))
    low, high = address_window(F.col("addr"), F.col("window"))
    missing = F.concat(F.lit("symbol not found: "), "symbol", F.lit("; first symbols: "), F.coalesce("__sample", F.lit("")))
    error = F.when(by_symbol & F.col("addr").isNotNull(), "use only one of --symbol or --addr").when(by_symbol & F.col("__s").isNull(), missing)
    error = error.when(~by_symbol & F.col("addr").isNull() & F.col("pattern").isNull(), "provide --symbol, --addr, or --grep") if "pattern" in requests.columns else error
    return rows.select(*requests.columns, F.when(by_symbol, F.col("__s.__at")).when(F.col("addr").isNotNull(), low).alias("start"), F.when(by_symbol, stop).when(F.col("addr").isNotNull(), high).alias("stop"), error.alias("error"))


def view(requests: DataFrame, config: DataFrame, symbols: DataFrame, lines: DataFrame, debug: DataFrame, tool: str = "view") -> DataFrame:
    """(id, text, error): the bounded view that each request asks for, as one text.

    Requests have id, binary, symbol, addr, pattern, window, context, max_output and line_numbers;
    `symbols` are (binary, addr, name, seq), `lines` the disassembly (binary, addr, line_no, line),
    `debug` (binary, has_debug_line). Limits are clamped to the configuration. A request is for a
    symbol's range, for that around an address, or, with a pattern alone, for the whole binary;
    a pattern keeps hits and their context. The first line names the `tool`.
    """
    asked = located(clamped_limits(requests, config), symbols).join(debug, "binary", "left")
    good = asked.filter("error is null")
    mine = good.select("id", "binary", "start", "stop", "pattern", "context", "max_output").join(lines, "binary").filter("start is null or (start <= addr and addr < stop)")
    mine = mine.select("id", "line_no", "line", "pattern", "context", "max_output")
    found = grep(mine.filter("pattern is not null"), F.col("pattern"), F.col("context"), "id")
    hits = hits_before_cap(found, F.col("max_output"), "id")
    said = output(found, F.col("max_output"), "id", separator=F.col("separator")).union(output(mine.filter("pattern is null"), F.col("max_output"), "id"))
    rows = asked.join(hits, "id", "left").join(said, "id", "left")
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    reach = F.concat(F.lit(" range="), hexed("start"), F.lit(":"), hexed("stop"), F.lit(" window="), F.col("window").cast("string"), F.lit("\n"))
    shown = F.concat(F.lit("'"), F.replace(F.replace(F.col("pattern"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    head = (
        F.when(F.col("symbol").isNotNull(), F.concat(F.lit(f"# {tool} symbol="), "symbol", reach))
        .when(F.col("addr").isNotNull(), F.concat(F.lit(f"# {tool} addr="), hexed("addr"), reach))
        .otherwise(F.concat(F.lit(f"# {tool} grep="), shown, F.lit(" full-disassembly-scan context="), F.col("context").cast("string"), F.lit("\n")))
    )
    note = F.when(F.coalesce("line_numbers", F.lit(False)) & ~F.coalesce("has_debug_line", F.lit(False)), NO_DEBUG).otherwise("")
    matches = F.when(F.col("pattern").isNotNull(), F.concat(F.lit("# matches="), F.coalesce("matched", F.lit(0)).cast("string"), F.lit(" max_output_bytes="), F.col("max_output").cast("string"), F.lit("\n"))).otherwise("")
    kind = F.when(F.col("start").isNull(), "grep").when(F.col("pattern").isNotNull(), "both").otherwise("range")
    advice = F.element_at(F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair)), kind)
    cut = F.when(F.coalesce("truncated", F.lit(False)), F.concat(F.lit("\n# TRUNCATED: "), advice, F.lit("\n"))).otherwise("")
    text = F.concat(head, note, matches, F.coalesce("text", F.lit("")), cut)
    return rows.select("id", F.when(F.col("error").isNull(), text).alias("text"), "error")
