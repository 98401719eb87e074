"""A parser for the subset of C that functions of patches use, giving preorder node rows.

Covered are declarations, assignments, calls, updates, and if, switch, for, while, do, return, goto
and labelled statements. Text outside the subset becomes `ERROR` nodes whose identifiers stay.
"""

from __future__ import annotations

import dataclasses
import re

_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*#(?:[^\n\\]|\\.)*)"
    r"|(?P<id>[A-Za-z_]\w*)|(?P<num>\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<str>L?\"(?:[^\"\\\n]|\\.)*\"|L?'(?:[^'\\\n]|\\.)*')"
    r"|(?P<op><<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|.)",
    re.S | re.M,
)
#: Keywords that open a type, and those that qualify one.
TYPES = frozenset("void char short int long float double signed unsigned _Bool bool size_t ssize_t struct union enum".split())
QUALIFIERS = frozenset("const volatile static extern register inline auto typedef restrict".split())
WORDS = frozenset("if else switch case default for while do return break continue goto sizeof".split())
_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="))
#: Binary operators by how tightly they bind.
_BINARY = {op: level for level, ops in enumerate((("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))) for op in ops}


@dataclasses.dataclass
class Node:
    type: str
    start: int
    end: int = 0
    field: str | None = None
    kids: list[Node] = dataclasses.field(default_factory=list)

    def add(self, kid: Node | None, name: str | None = None) -> Node | None:
        if kid is not None:
            kid.field = name
            self.kids.append(kid)
        return kid


@dataclasses.dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


class Parser:
    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0
        self.tokens = [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(source) if m.lastgroup != "skip"]

    # -- tokens

    def text(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].kind if i < len(self.tokens) else ""

    def here(self) -> int:
        return self.tokens[self.at].start if self.at < len(self.tokens) else len(self.source)

    def behind(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def take(self, *wanted: str) -> bool:
        if self.at < len(self.tokens) and (not wanted or self.text() in wanted):
            self.at += 1
            return True
        return False

    def close(self, node: Node) -> Node:
        node.end = max(self.behind(), node.start)
        return node

    def leaf(self, kind: str) -> Node:
        t = self.tokens[self.at]
        self.at += 1
        return Node(kind, t.start, t.end)

    # -- declarations

    def name(self, ahead: int = 0) -> bool:
        return self.kind(ahead) == "id" and self.text(ahead) not in WORDS

    def opens_declaration(self) -> bool:
        if self.text() in TYPES or self.text() in QUALIFIERS:
            return True
        if not self.name():
            return False
        # a type's name, stars and a declared name; `T * f(x)` is a product with a call
        k = 1
        while self.text(k) in ("*", "const"):
            k += 1
        return self.name(k) and self.text(k + 1) in ("=", ";", ",", "[", ")", *(("(",) if k == 1 else ()))

    def specifiers(self, parent: Node) -> None:
        seen = False
        while self.kind() == "id":
            if self.text() in QUALIFIERS:
                parent.add(self.leaf("type_qualifier"))
            elif self.text() in ("struct", "union", "enum"):
                kind = self.text() + "_specifier"
                n = Node(kind, self.here())
                self.take()
                if self.name():
                    n.add(self.leaf("type_identifier"), "name")
                if self.text() == "{":
                    self.skip("{", "}")
                parent.add(self.close(n), "type")
                seen = True
            elif self.text() in TYPES:
                parent.add(self.leaf("primitive_type"), "type")
                seen = True
            elif not seen and self.name() and (self.name(1) or self.text(1) in ("*", ")", ",")):
                parent.add(self.leaf("type_identifier"), "type")
                seen = True
            else:
                return

    def skip(self, left: str, right: str) -> None:
        depth = 0
        while self.at < len(self.tokens):
            depth += (self.text() == left) - (self.text() == right)
            self.at += 1
            if depth == 0:
                return

    def declarator(self) -> Node | None:
        start = self.here()
        if self.text() in ("*", "const", "restrict"):
            if not self.take("*"):
                self.take()
                return self.declarator()
            n = Node("pointer_declarator", start)
            n.add(self.declarator(), "declarator")
            return self.close(n)
        if self.text() == "(":
            inner = Node("parenthesized_declarator", start)
            self.take()
            inner.add(self.declarator())
            self.take(")")
            d = self.close(inner)
        elif self.name():
            d = self.leaf("identifier")
        else:
            return None
        while self.text() in ("[", "("):
            if self.text() == "[":
                n = Node("array_declarator", start)
                n.add(d, "declarator")
                self.take()
                if self.text() != "]":
                    n.add(self.expression(), "size")
                self.take("]")
            else:
                n = Node("function_declarator", start)
                n.add(d, "declarator")
                n.add(self.parameters(), "parameters")
            d = self.close(n)
        return d

    def parameters(self) -> Node:
        n = Node("parameter_list", self.here())
        self.take("(")
        while self.at < len(self.tokens) and self.text() != ")":
            before, p = self.at, Node("parameter_declaration", self.here())
            self.specifiers(p)
            p.add(self.declarator(), "declarator")
            n.add(self.close(p))
            self.take(",")
            if self.at == before:
                self.take()
        self.take(")")
        return self.close(n)

    def declaration(self) -> Node:
        n = Node("declaration", self.here())
        self.specifiers(n)
        while self.at < len(self.tokens) and self.text() not in (";", "}"):
            before = self.at
            d = self.declarator()
            if self.text() == "=":
                i = Node("init_declarator", d.start if d else self.here())
                i.add(d, "declarator")
                self.take("=")
                i.add(self.assignment(), "value")
                n.add(self.close(i), "declarator")
            else:
                n.add(d, "declarator")
            self.take(",")
            if self.at == before:
                self.take()
        self.take(";")
        return self.close(n)

    # -- statements

    def block(self) -> Node:
        n = Node("compound_statement", self.here())
        self.take("{")
        while self.at < len(self.tokens) and self.text() != "}":
            before = self.at
            n.add(self.statement())
            if self.at == before:
                n.add(self.leaf("ERROR"))
        self.take("}")
        return self.close(n)

    def condition(self) -> Node:
        n = Node("parenthesized_expression", self.here())
        self.take("(")
        if self.text() != ")":
            n.add(self.expression())
        self.take(")")
        return self.close(n)

    def statement(self) -> Node:
        word, start = self.text(), self.here()
        if word == "{":
            return self.block()
        if word in ("if", "switch", "while"):
            n = Node(f"{word}_statement", start)
            self.take()
            n.add(self.condition(), "condition")
            n.add(self.statement(), "consequence" if word == "if" else "body")
            if word == "if" and self.take("else"):
                n.add(self.statement(), "alternative")
            return self.close(n)
        if word == "do":
            n = Node("do_statement", start)
            self.take()
            n.add(self.statement(), "body")
            if self.take("while"):
                n.add(self.condition(), "condition")
            self.take(";")
            return self.close(n)
        if word == "for":
            n = Node("for_statement", start)
            self.take()
            self.take("(")
            if self.opens_declaration():
                n.add(self.declaration(), "initializer")
            else:
                if self.text() != ";":
                    n.add(self.expression(), "initializer")
                self.take(";")
            if self.text() != ";":
                n.add(self.expression(), "condition")
            self.take(";")
            if self.text() != ")":
                n.add(self.expression(), "update")
            self.take(")")
            n.add(self.statement(), "body")
            return self.close(n)
        if word in ("return", "goto", "break", "continue"):
            n = Node(f"{word}_statement", start)
            self.take()
            if word == "goto" and self.name():
                n.add(self.leaf("statement_identifier"), "label")
            elif self.text() != ";":
                n.add(self.expression())
            self.take(";")
            return self.close(n)
        if word in ("case", "default"):
            n = Node("case_statement", start)
            self.take()
            if word == "case":
                n.add(self.expression(), "value")
            self.take(":")
            while self.at < len(self.tokens) and self.text() not in ("case", "default", "}"):
                n.add(self.statement())
            return self.close(n)
        if self.name() and self.text(1) == ":" and self.text(2) != ":":
            n = Node("labeled_statement", start)
            n.add(self.leaf("statement_identifier"), "label")
            self.take(":")
            if self.text() != "}":
                n.add(self.statement())
            return self.close(n)
        if self.opens_declaration():
            return self.declaration()
        n = Node("expression_statement", start)
        if self.text() != ";":
            n.add(self.expression())
        while self.at < len(self.tokens) and self.text() not in (";", "}"):
            n.add(self.leaf("identifier" if self.name() else "ERROR"))
        self.take(";")
        return self.close(n)

    # -- expressions

    def expression(self) -> Node:
        first = self.assignment()
        if self.text() != ",":
            return first
        n = Node("comma_expression", first.start)
        n.add(first, "left")
        while self.take(","):
            n.add(self.assignment(), "right")
        return self.close(n)

    def assignment(self) -> Node:
        left = self.conditional()
        if self.text() not in _ASSIGN:
            return left
        n = Node("assignment_expression", left.start)
        n.add(left, "left")
        self.take()
        n.add(self.assignment(), "right")
        return self.close(n)

    def conditional(self) -> Node:
        test = self.binary(0)
        if self.text() != "?":
            return test
        n = Node("conditional_expression", test.start)
        n.add(test, "condition")
        self.take()
        n.add(self.expression(), "consequence")
        self.take(":")
        n.add(self.conditional(), "alternative")
        return self.close(n)

    def binary(self, least: int) -> Node:
        left = self.unary()
        while (level := _BINARY.get(self.text(), -1)) >= least:
            n = Node("binary_expression", left.start)
            n.add(left, "left")
            self.take()
            n.add(self.binary(level + 1), "right")
            left = self.close(n)
        return left

    def opens_cast(self) -> bool:
        k = 1
        while self.text(k) in QUALIFIERS:
            k += 1
        if self.text(k) in TYPES:
            return True
        if self.kind(k) != "id" or self.text(k) in WORDS:
            return False
        k += 1
        stars = 0
        while self.text(k) == "*":
            k, stars = k + 1, stars + 1
        return self.text(k) == ")" and stars > 0

    def unary(self) -> Node:
        word, start = self.text(), self.here()
        if word in ("++", "--"):
            n = Node("update_expression", start)
            self.take()
            n.add(self.unary(), "argument")
            return self.close(n)
        if word in ("*", "&"):
            n = Node("pointer_expression", start)
            self.take()
            n.add(self.unary(), "argument")
            return self.close(n)
        if word in ("!", "-", "+", "~"):
            n = Node("unary_expression", start)
            self.take()
            n.add(self.unary(), "argument")
            return self.close(n)
        if word == "sizeof":
            n = Node("sizeof_expression", start)
            self.take()
            if self.text() == "(" and self.opens_cast():
                self.skip("(", ")")
            else:
                n.add(self.unary(), "value")
            return self.close(n)
        if word == "(" and self.opens_cast():
            n = Node("cast_expression", start)
            self.skip("(", ")")
            n.add(self.unary(), "value")
            return self.close(n)
        return self.postfix()

    def postfix(self) -> Node:
        e = self.primary()
        while True:
            word = self.text()
            if word == "(":
                n = Node("call_expression", e.start)
                n.add(e, "function")
                a = Node("argument_list", self.here())
                self.take()
                while self.at < len(self.tokens) and self.text() not in (")", ";"):
                    before = self.at
                    a.add(self.assignment())
                    self.take(",")
                    if self.at == before:
                        self.take()
                self.take(")")
                n.add(self.close(a), "arguments")
            elif word == "[":
                n = Node("subscript_expression", e.start)
                n.add(e, "argument")
                self.take()
                n.add(self.expression(), "index")
                self.take("]")
            elif word in (".", "->"):
                n = Node("field_expression", e.start)
                n.add(e, "argument")
                self.take()
                if self.kind() == "id":
                    n.add(self.leaf("field_identifier"), "field")
            elif word in ("++", "--"):
                n = Node("update_expression", e.start)
                n.add(e, "argument")
                self.take()
            else:
                return e
            e = self.close(n)

    def primary(self) -> Node:
        if self.text() == "(":
            return self.condition()
        if self.text() == "{":
            n = Node("initializer_list", self.here())
            self.take()
            while self.at < len(self.tokens) and self.text() != "}":
                before = self.at
                n.add(self.assignment())
                self.take(",")
                if self.at == before:
                    self.take()
            self.take("}")
            return self.close(n)
        kind = self.kind()
        if kind == "id":
            return self.leaf("identifier")
        if kind in ("num", "str"):
            return self.leaf("number_literal" if kind == "num" else "string_literal")
        n = Node("ERROR", self.here())
        if self.text() not in ("", ";", ")", "}", "]", ",", ":"):
            self.take()
        return self.close(n)

    # -- top level

    def unit(self) -> Node:
        root = Node("translation_unit", 0)
        while self.at < len(self.tokens):
            before, n = self.at, Node("function_definition", self.here())
            self.specifiers(n)
            d = self.declarator()
            n.add(d, "declarator")
            if d is not None and self.text() == "{":
                n.add(self.block(), "body")
                root.add(self.close(n))
            else:
                self.at = before
                depth = 0
                e = Node("declaration", self.here())
                while self.at < len(self.tokens):
                    depth += (self.text() == "{") - (self.text() == "}")
                    stop = self.text() in (";", "}") and depth <= 0
                    self.at += 1
                    if stop:
                        break
                root.add(self.close(e))
        root.end = len(self.source)
        return root


def rows(source: str) -> list[tuple]:
    """(node_id, parent_id, last_id, type, field, start_line, end_line, text) in preorder."""
    breaks = [m.start() for m in re.finditer("\n", source)]
    from bisect import bisect_left

    out: list[list] = []
    todo = [(Parser(source).unit(), -1)]
    while todo:
        node, parent = todo.pop()
        me = len(out)
        out.append([me, parent, me, node.type, node.field, bisect_left(breaks, node.start) + 1, bisect_left(breaks, max(node.end - 1, node.start)) + 1, source[node.start : node.end]])
        todo += [(k, me) for k in reversed(node.kids)]
    for r in reversed(out):
        if r[1] >= 0:
            out[r[1]][2] = max(out[r[1]][2], r[2])
    return [tuple(r) for r in out]
