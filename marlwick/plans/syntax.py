"""Lexer and recursive-descent parser of the SQL dialect.

Expressions become tuples whose first item names the node; statements become
``Select``, ``Compound`` or dictionaries with a ``kind``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.scalar import DialectError

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<blob>[xX]'[0-9a-fA-F]*')
    |(?P<string>'(?:[^']|'')*')
    |(?P<real>(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)
    |(?P<int>[0-9]+)
    |(?P<param>\?[0-9]*|[:@$][A-Za-z_]\w*)
    |(?P<name>[A-Za-z_]\w*|"(?:[^"]|"")*"|`[^`]*`)
    |(?P<op>\|\||<<|>>|<>|!=|<=|>=|==|[-+*/%&|~=<>(),.;])""",
    re.VERBOSE | re.DOTALL,
)
STOP = set(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT ON JOIN INNER LEFT CROSS OUTER AS AND OR NOT IS IN LIKE GLOB BETWEEN "
    "THEN WHEN ELSE END CASE SET VALUES RETURNING WITH COLLATE USING DESC ASC NULLS BY DISTINCT ALL EXISTS MATCH".split()
)


@dataclass
class Select:
    items: list[tuple[Any, str | None]]
    source: Any = None
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    distinct: bool = False
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass
class Compound:
    first: Select
    rest: list[tuple[str, Select]]
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass
class With:
    name: str
    recursive: bool
    body: Any
    query: Any


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, sql: str):
        self.toks, self.at, self.params = tokens(sql), 0, 0

    # -- tools
    def peek(self, k: int = 0) -> str:
        kind, text = self.toks[min(self.at + k, len(self.toks) - 1)]
        return text.upper() if kind in ("name", "op") and text[:1] not in '"`' else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise DialectError(f"expected {w}, found {self.toks[self.at][1]!r}")

    def name(self) -> str:
        kind, text = self.toks[self.at]
        if kind != "name":
            raise DialectError(f"expected a name, found {text!r}")
        self.at += 1
        return text[1:-1].replace('""', '"') if text[0] in '"`' else text

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def integer(self) -> int:
        kind, text = self.toks[self.at]
        if kind != "int":
            raise DialectError(f"expected an integer, found {text!r}")
        self.at += 1
        return int(text)

    def some(self, parse) -> list:
        out = [parse()]
        while self.take(","):
            out.append(parse())
        return out

    # -- queries
    def query(self):
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            name = self.name()
            self.need("AS", "(")
            body = self.query()
            self.need(")")
            return With(name, recursive, body, self.query())
        first = self.core()
        rest = []
        while self.peek() in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.peek()
            self.at += 1
            if op == "UNION" and self.take("ALL"):
                op = "UNION ALL"
            rest.append((op, self.core()))
        out = Compound(first, rest) if rest else first
        if self.take("ORDER"):
            self.need("BY")
            out.order = self.some(self.order_key)
        if self.take("LIMIT"):
            out.limit = self.integer()
            if self.take("OFFSET"):
                out.offset = self.integer()
        return out

    def core(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT") or (self.take("ALL") and False)
        out = Select(self.some(self.item), distinct=distinct)
        if self.take("FROM"):
            out.source = self.source()
        if self.take("WHERE"):
            out.where = self.expr()
        if self.take("GROUP"):
            self.need("BY")
            out.group = self.some(self.expr)
            if any(g[0] != "col" for g in out.group):
                raise DialectError("GROUP BY takes columns only")
        if self.take("HAVING"):
            out.having = self.expr()
        return out

    def item(self):
        if self.take("*"):
            return ("star",), None
        e = self.expr()
        if self.take("AS"):
            return e, self.name()
        if self.toks[self.at][0] == "name" and self.peek() not in STOP:
            return e, self.name()
        return e, None

    def order_key(self):
        e = self.expr()
        desc = self.take("DESC") or (self.take("ASC") and False)
        nulls = None
        if self.take("NULLS"):
            nulls = "FIRST" if self.take("FIRST") else (self.need("LAST") or "LAST")
        return e, desc, nulls

    def source(self):
        out = self.table()
        while True:
            if self.take(",") or self.take("CROSS", "JOIN"):
                out = ("join", "CROSS", out, self.table(), None)
            elif self.peek() in ("JOIN", "INNER", "LEFT"):
                kind = "LEFT" if self.take("LEFT") else "INNER"
                self.take("OUTER") if kind == "LEFT" else self.take("INNER")
                self.need("JOIN")
                right = self.table()
                self.need("ON")
                out = ("join", kind, out, right, self.expr())
            elif self.peek() in ("RIGHT", "FULL", "NATURAL"):
                raise DialectError(f"{self.peek()} JOIN isn't part of the dialect")
            else:
                return out

    def table(self):
        if self.take("("):
            body = self.query()
            self.need(")")
            return "derived", body, self.alias()
        name = self.name()
        return "table", name, self.alias() or name

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        if self.toks[self.at][0] == "name" and self.peek() not in STOP | {"RIGHT", "FULL", "NATURAL"}:
            return self.name()
        return None

    # -- expressions, weakest first
    def expr(self):
        e = self.conjunction()
        while self.take("OR"):
            e = ("bin", "OR", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.negation()
        while self.take("AND"):
            e = ("bin", "AND", e, self.negation())
        return e

    def negation(self):
        if self.peek() == "NOT" and self.peek(1) != "EXISTS":
            self.at += 1
            return "not", self.negation()
        return self.comparison()

    def comparison(self):
        e = self.bits()
        while True:
            op = self.peek()
            if op in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                self.at += 1
                e = ("cmp", {"==": "=", "!=": "<>"}.get(op, op), e, self.bits())
            elif self.take("IS"):
                negated = self.take("NOT")
                self.need("NULL")
                e = ("isnull", e, negated)
            else:
                negated = self.peek() == "NOT" and self.peek(1) in ("LIKE", "GLOB", "BETWEEN", "IN")
                if negated:
                    self.at += 1
                if self.peek() in ("LIKE", "GLOB"):
                    kind = self.peek()
                    self.at += 1
                    e = ("like", kind, e, self.bits(), negated)
                elif self.take("MATCH"):
                    e = ("match", e, self.bits())
                elif self.take("BETWEEN"):
                    low = self.bits()
                    self.need("AND")
                    e = ("between", e, low, self.bits(), negated)
                elif self.take("IN"):
                    self.need("(")
                    if self.peek() in ("SELECT", "WITH"):
                        e = ("insel", e, self.query(), negated)
                    else:
                        e = ("in", e, self.some(self.expr), negated)
                    self.need(")")
                else:
                    return e

    def _left(self, ops: tuple[str, ...], below):
        e = below()
        while self.peek() in ops:
            op = self.peek()
            self.at += 1
            e = ("bin", op, e, below())
        return e

    def bits(self):
        return self._left(("&", "|", "<<", ">>"), self.sums)

    def sums(self):
        return self._left(("+", "-"), self.products)

    def products(self):
        return self._left(("*", "/", "%"), self.joins)

    def joins(self):
        return self._left(("||",), self.unary)

    def unary(self):
        if self.take("-"):
            return "neg", self.unary()
        if self.take("+"):
            return self.unary()
        if self.take("~"):
            return "inv", self.unary()
        e = self.primary()
        while self.take("COLLATE"):
            e = ("collate", e, self.name().upper())
        return e

    def primary(self):
        kind, text = self.toks[self.at]
        if kind in ("int", "real", "string", "blob"):
            self.at += 1
            return kind, text
        if kind == "param":
            self.at += 1
            if text == "?":
                self.params += 1
                return "param", self.params
            return "param", int(text[1:]) if text[0] == "?" else text[1:]
        if self.take("("):
            if self.peek() in ("SELECT", "WITH"):
                e = ("sub", self.query())
            else:
                e = self.expr()
            self.need(")")
            return e
        word = self.peek()
        if word in ("EXISTS", "NOT"):
            negated = self.take("NOT")
            self.need("EXISTS", "(")
            e = ("exists", self.query(), negated)
            self.need(")")
            return e
        if self.take("CASE"):
            return self.case()
        if word == "CAST" and self.peek(1) == "(":
            self.at += 2
            e = self.expr()
            self.need("AS")
            to = self.name().upper()
            self.need(")")
            return "cast", e, to
        if self.take("NULL"):
            return ("null",)
        if kind != "name":
            raise DialectError(f"unexpected {text!r}")
        name = self.name()
        if self.peek() == "(":
            return self.function(name)
        if self.take("."):
            return "col", name, self.name()
        return "col", None, name

    def case(self):
        operand = None if self.peek() == "WHEN" else self.expr()
        arms = []
        while self.take("WHEN"):
            test = self.expr()
            self.need("THEN")
            arms.append((test, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        return "case", operand, arms, other

    def function(self, name: str):
        self.need("(")
        star = self.take("*")
        distinct = not star and self.take("DISTINCT")
        args = [] if star or self.peek() == ")" else self.some(self.expr)
        self.need(")")
        over = self.window() if self.take("OVER") else None
        return "fn", name.upper(), args, distinct, star, over

    def window(self):
        self.need("(")
        parts, order, frame = [], [], None
        if self.take("PARTITION"):
            self.need("BY")
            parts = self.some(self.expr)
        if self.take("ORDER"):
            self.need("BY")
            order = self.some(self.order_key)
        if self.peek() in ("ROWS", "RANGE"):
            self.at += 1
            self.need("BETWEEN")
            low = self.bound()
            self.need("AND")
            frame = (low, self.bound())
        self.need(")")
        return parts, order, frame

    def bound(self) -> str:
        if self.take("UNBOUNDED"):
            side = self.name().upper()
            return f"UNBOUNDED {side}"
        if self.take("CURRENT"):
            self.need("ROW")
            return "CURRENT ROW"
        n = self.integer()
        return f"{n} {self.name().upper()}"
