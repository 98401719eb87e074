"""Macro definitions and their values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.operators.linescan import lines_of

DEPTH, LONGEST = 8, 1 << 20
_TOKEN = re.compile(r"\s*(0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+|\*\*|//|<<|>>|[-+*/%<>&|^~()])")
#: Operators by how loosely they bind; comparisons have their own level.
_LEVELS = (("<", ">"), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "//", "%"))
_LARGEST = 4096  # bits


class TooLarge(ValueError):
    """An integer of more than _LARGEST bits."""


class _Expression:
    """Integer expressions by precedence climbing; raises on anything else and on huge results."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        t = self.peek()
        if t is None:
            raise ValueError("end")
        self.at += 1
        return t

    def level(self, k: int) -> int:
        if k == len(_LEVELS):
            return self.unary()
        left, chained = self.level(k + 1), True
        while self.peek() in _LEVELS[k]:
            op, right = self.take(), self.level(k + 1)
            if k == 0:  # a < b < c means a < b and b < c
                chained = chained and (left < right if op == "<" else left > right)
                left = right
                if self.peek() not in _LEVELS[0]:
                    return chained
            else:
                left = self.apply(op, left, right)
        return left

    def unary(self) -> int:
        if self.peek() in ("+", "-", "~"):
            op, v = self.take(), self.unary()
            return v if op == "+" else -v if op == "-" else ~v
        v = self.atom()
        if self.peek() == "**":
            self.take()
            return self.apply("**", v, self.unary())
        return v

    def atom(self) -> int:
        t = self.take()
        if t == "(":
            v = self.level(0)
            if self.take() != ")":
                raise ValueError("parenthesis")
            return v
        if t[0].isdigit():
            if t[:2].lower() == "0x":
                return int(t, 16)
            if t[:2].lower() == "0b":
                return int(t, 2)
            if len(t) > 1 and t[0] == "0" and t.strip("0"):
                raise ValueError(t)
            return int(t)
        raise ValueError(t)

    @staticmethod
    def apply(op: str, a: int, b: int) -> int:
        if op in ("<<", ">>", "**") and b < 0:
            raise ValueError("negative")
        if op in ("<<", "**") and b * max(a.bit_length() if op == "**" else 1, 1) > _LARGEST:
            raise TooLarge
        if op in ("//", "%") and b == 0:
            raise ValueError("zero")
        return {"|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b, "<<": lambda: a << b, ">>": lambda: a >> b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "//": lambda: a // b, "%": lambda: a % b, "**": lambda: a**b}[op]()


def eval_int(text: str) -> int | None:
    """The value of an integer expression, or null; a quotient with one slash is no integer.

    A comparison is a truth value, and these count as integers. Raises TooLarge for huge results.
    """
    if re.search(r"[^0-9a-fA-FxX()+\-*/%<>&|^~ ]", text):
        return None
    try:
        e = _Expression(text)
        v = e.level(0)
        return v if e.peek() is None else None
    except TooLarge:
        raise
    except (ValueError, OverflowError, RecursionError):
        return None


def values(macros: dict[str, str]) -> dict[str, tuple[str, bool]]:
    """Every macro's (value, capped): bodies put in for names DEPTH deep, integers where they are such.

    Works from the deepest level up, so names that refer to one another in a circle end there. A
    value that would outgrow LONGEST characters keeps the names of its body, and an integer of more
    than _LARGEST bits stays an expression; `capped` marks both, and what is made of them.
    """
    words = {n: re.sub(r"([()])", r" \1 ", body).split() for n, body in macros.items()}
    below = {n: (body, False) for n, body in macros.items()}
    for _ in range(DEPTH + 1):
        level = {}
        for n, own in words.items():
            parts = [(t, False) if t == n else below.get(t, (t, False)) for t in own]
            capped = any(c for _, c in parts)
            text = " ".join(t for t, _ in parts)
            if len(text) >= LONGEST:
                text, capped = " ".join(own), True
            try:
                value = eval_int(text)
            except TooLarge:
                value, capped = None, True
            level[n] = (text if value is None else str(value), capped)
        below = level
    return below


def resolve(name: str, macros: dict[str, str]) -> str | None:
    return values(macros).get(name, (None, False))[0]


def definitions(sources: DataFrame, *keys: str, text: str = "text", until: str | None = None) -> DataFrame:
    """(keys, name, body) of `#define` lines, up to line `until`; the last of a name wins.

    A missing body is 1. Names that end in `)` go; a parameter list with a space is cut at it.
    """
    rows = lines_of(sources, text, *keys, *([until] if until else []))
    if until:
        rows = rows.filter(F.col("line_no") <= F.col(until))
    line = F.regexp_replace("line", "^\\s+|\\s+$", "")
    rows = rows.withColumn("__l", line).filter(F.startswith("__l", F.lit("#define ")))
    rest = F.regexp_replace(F.substring("__l", 9, 1_000_000), "^\\s+", "")
    parts = F.split(rest, "\\s+", 2)
    rows = rows.withColumn("name", parts[0]).withColumn("body", F.coalesce(F.nullif(F.trim(F.try_element_at(parts, F.lit(2))), F.lit("")), F.lit("1")))
    rows = rows.filter("name <> '' and not (contains(name, '(') and endswith(name, ')'))")
    return rows.groupBy(*keys, "name").agg(F.max_by("body", "line_no").alias("body"))


def resolved(macros: DataFrame, key: str) -> DataFrame:
    """(key, name, value, capped) of macros (key, name, body); see values().

    A file's definitions go to one call of an Arrow function as one row, since values depend on one
    another; tokens with cyclic references end DEPTH deep.
    """
    value = "array<struct<name:string,value:string,capped:boolean>>"

    @F.udf(value, useArrow=True)
    def solve(pairs):  # noqa: ANN001, ANN202
        return [{"name": n, "value": v, "capped": c} for n, (v, c) in values({p["name"]: p["body"] for p in pairs}).items()]

    files = macros.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", "body"))).alias("m"))
    return files.select(key, F.explode(solve("m")).alias("x")).select(key, F.col("x.name").cast(StringType()).alias("name"), F.col("x.value").alias("value"), "x.capped")
