"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of source files.
CODE_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def quoted(name: Column) -> Column:
    r"""A name as a literal inside a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def identifier_pattern(name: Column) -> Column:
    return F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted(name), F.lit("(?![A-Za-z0-9_])"))


def call_pattern(name: Column) -> Column:
    return F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted(name), F.lit("\\s*\\("))


def declaration_pattern(name: Column) -> Column:
    """One type word or more before the name; words are parted by one class, so nothing backtracks twice."""
    return F.concat(F.lit("^\\s*[A-Za-z_][A-Za-z0-9_*\\s]*\\s"), quoted(name), F.lit("\\s*\\("))


def mentions(text: Column, pattern: Column) -> Column:
    return F.regexp_like(text, pattern)


def run_id_of(text: Column) -> Column:
    """Runs of characters other than letters, digits, dot, line and hyphen become one underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\p{L}\\p{N}._-]", "_")


def optimisation_level(level: Column) -> Column:
    """`o0` as `O0`; other spellings stay."""
    return F.when(F.regexp_like(level, F.lit("^[oO][0-9]$")), F.concat(F.lit("O"), F.substring(level, 2, 1))).otherwise(level)


def is_code_path(path: Column) -> Column:
    """Whether the last suffix is one of a source file; a name that only begins with a dot has none."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, "(?s)^.+(\\.[^.]+)$", 1)).isin(*CODE_SUFFIXES)


def is_symbol(name: Column) -> Column:
    return F.regexp_like(name, F.lit("^[\\p{L}_]"))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders replaced one after the other; later keys also act inside earlier values."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value, F.lit("")))
    return template


def compact_code(text: Column, most: int = 8) -> Column:
    """At most `most` lines, then three dots; white space collapsed."""
    lines = F.split(text, "\n")
    cut = F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n..."))).otherwise(text)
    return F.trim(F.regexp_replace(cut, "\\s+", " "))


def capped(text: Column, most: int = 1200) -> Column:
    """At most `most` characters, then three dots on a line of their own."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), "\\s+$", ""), F.lit("\n...")))


def is_inside(path: Column, root: Column) -> Column:
    """Whether a resolved path is a folder or lies below it."""
    top = F.regexp_replace(root, "/+$", "")
    return (F.regexp_replace(path, "/+$", "") == top) | F.startswith(path, F.concat(top, F.lit("/")))


def project_name(path: Column, own: str) -> Column:
    """The folder that an input lies in, unless that is the checkout itself (`own`); else the file's stem."""
    parent = F.regexp_extract(path, "([^/]+)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    return F.when(~parent.isin("", own), parent).when(stem != "", stem).otherwise("unknown")


def project_of_diff(path: Column, names: tuple[str, ...]) -> Column:
    """The first of the names that is a folder of the path or begins a part of it; null if none is."""
    low = F.lower(path)
    return F.coalesce(*(F.when(F.contains(low, F.lit(f"/{n}/")) | F.contains(low, F.lit(f"{n}_")), F.lit(n)) for n in names))


def line_at(text: Column, n: Column) -> Column:
    """The n-th line from 1; empty outside."""
    return F.coalesce(F.try_element_at(F.split(text, "\n"), F.when(n > 0, n)), F.lit(""))


def parse_int(text: Column) -> Column:
    """Decimal, or 0x, 0o, 0b with digits of that base; null for anything else.

    One underscore may stand between digits and behind a prefix; a decimal has no leading zero.
    """
    said = F.lower(strip(text))
    shaped = F.regexp_like(said, F.lit("^[+-]?(0x(_?[0-9a-f])+|0o(_?[0-7])+|0b(_?[01])+|0(_?0)*|[1-9](_?[0-9])*)$"))
    t = F.when(shaped, F.regexp_replace(said, "_", ""))
    body = F.regexp_replace(t, "^[+-]?0[xob]", "")
    sign = F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
    value = F.when(F.regexp_like(t, F.lit("^[+-]?0x[0-9a-f]+$")), F.conv(body, 16, 10))
    value = value.when(F.regexp_like(t, F.lit("^[+-]?0o[0-7]+$")), F.conv(body, 8, 10)).when(F.regexp_like(t, F.lit("^[+-]?0b[01]+$")), F.conv(body, 2, 10))
    value = value.when(F.regexp_like(t, F.lit("^[+-]?(0+|[1-9][0-9]*)$")), F.regexp_replace(t, "^[+-]", ""))
    return sign * value.try_cast("decimal(20,0)")


def clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(value, lit(high)))


def escape_cell(text: Column) -> Column:
    """A command inside a Markdown table cell."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def shell_quote(word: Column) -> Column:
    plain = F.regexp_like(word, F.lit("^[A-Za-z0-9_@%+=:,./-]+$"))
    return F.when(plain, word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def remap_names(text: Column, names: Column, folder: Column | None = None) -> Column:
    """Anonymous names back to original ones; names is array<struct<anonymous, original>>.

    Greater names go first, so no name is replaced inside a longer one; the form with the folder
    goes before the bare one.
    """
    ordered = F.reverse(F.array_sort(names))

    def step(acc: Column, x: Column) -> Column:
        if folder is not None:
            acc = F.replace(acc, F.concat(folder, F.lit("/"), x["anonymous"]), x["original"])
        return F.replace(acc, x["anonymous"], x["original"])

    return F.aggregate(ordered, text, step)
