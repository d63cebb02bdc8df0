"""From the dialect's syntax to Spark SQL text.

Types of expressions are known from the schemas of the tables in scope, so what
differs from Spark is settled here: integer division, comparisons across
classes, LIKE, casts, window frames, null order, set operations from left to right.
Catalyst does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..functions import scalar
from ..functions.scalar import SQL_TYPE, DialectError, Typed, as_number, as_real, as_text, fold, quote
from .syntax import Compound, Parser, Select, With

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "STRING_AGG"}
RANKS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "PERCENT_RANK", "CUME_DIST", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"}
CAST_NAMES = {"INTEGER": "int", "INT": "int", "REAL": "real", "FLOAT": "real", "DOUBLE": "real", "TEXT": "text", "VARCHAR": "text", "BLOB": "blob"}
#: Classes in the order of values: numbers before text before blobs.
CLASS = {"int": 0, "real": 0, "bool": 0, "text": 1, "ts": 1, "blob": 2}
#: Integers up to this are the same as reals.
EXACT = 1 << 53

#: A recursion ends when it brings no new rows, whatever level the session's settings stop at.
NO_LEVEL_LIMIT = f"MAX RECURSION LEVEL {(1 << 31) - 1}"
#: The version of the dialect.
VERSION = "3.45.1"
#: Functions that tell what the session's last statements did.
SESSION = ("CHANGES", "TOTAL_CHANGES", "LAST_INSERT_ROWID")

Schema = dict[str, str]


def spark_type(name: str) -> str:
    if name in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if name in ("double", "float") or name.startswith("decimal"):
        return "real"
    return {"binary": "blob", "boolean": "bool"}.get(name, "ts" if name.startswith(("timestamp", "date")) else "text")


@dataclass
class Scope:
    """Names in reach: alias to columns and their types, then the scope around."""

    tables: dict[str, Schema]
    outer: Scope | None = None
    named: Schema | None = None

    def find(self, table: str | None, column: str) -> Typed | None:
        for alias, columns in self.tables.items():
            if table is None or alias.lower() == table.lower():
                for c, ty in columns.items():
                    if c.lower() == column.lower():
                        return f"`{alias}`.`{c}`", ty
        return self.outer.find(table, column) if self.outer else None


#: So many tasks share the pairs of one key.
DEALS = 16


def pairs(left: Any, right: Any, on: Any) -> list[str]:
    """Where a table is joined with itself on equal keys and a comparison that is no equality, the left's columns in the test; else none.

    Such a join gives rows in number of the square of a key's, which one task for each key doesn't shorten.
    """
    if (left[0], right[0]) != ("table", "table") or left[1].lower() != right[1].lower():
        return []
    parts, tests = [on], []
    while parts:
        e = parts.pop()
        if e[:2] == ("bin", "AND"):
            parts += e[2:]
        else:
            tests.append(e)
    sides = [(e[1], *sorted((e[2], e[3]), key=lambda c: c[1].lower() != left[2].lower())) for e in tests if e[0] == "cmp" and e[2][0] == e[3][0] == "col" and e[2][1] and e[3][1]]
    across = [(op, a[2]) for op, a, b in sides if (a[1].lower(), b[1].lower()) == (left[2].lower(), right[2].lower())]
    ops = {op for op, _ in across}
    return list(dict.fromkeys(c for _, c in across)) if "=" in ops and ops - {"=", "==", "IS"} else []


def contains_aggregate(e: Any) -> bool:
    if isinstance(e, tuple) and e[:1] == ("fn",):
        return (e[1] in AGGREGATES and e[5] is None) or any(map(contains_aggregate, e[2])) or contains_aggregate(e[5])
    return isinstance(e, (tuple, list)) and any(map(contains_aggregate, e))


class Translator:
    """``lookup`` gives the schema (column to type) of a table or view; ``params`` are values by place or name."""

    #: Values of the functions in SESSION; an engine sets its own.
    session: dict[str, int] = {}

    def __init__(self, lookup, params: dict | None = None):
        self.lookup, self.params, self.ctes = lookup, params or {}, {}
        self.dealt: set[str] = set()  # aliases of tables whose join is dealt out, see pairs()

    def translate(self, sql: str) -> str:
        parser = Parser(sql)
        query = parser.query()
        parser.take(";")
        if parser.toks[parser.at][0] != "end":
            raise DialectError(f"unexpected {parser.toks[parser.at][1]!r}")
        return self.query(query, None)[0]

    # -- queries
    def query(self, q, outer: Scope | None) -> tuple[str, Schema]:
        if isinstance(q, With):
            return self.with_query(q, outer)
        if isinstance(q, Compound):
            return self.compound(q, outer)
        return self.select(q, outer)

    def with_query(self, q: With, outer: Scope | None) -> tuple[str, Schema]:
        saved = dict(self.ctes)
        if q.recursive and isinstance(q.body, Compound):
            if [op for op, _ in q.body.rest] != ["UNION ALL"]:
                raise DialectError("a recursive query is a base and a step joined by UNION ALL")
            base, columns = self.select(q.body.first, outer)
            self.ctes[q.name.lower()] = columns
            step, _ = self.select(q.body.rest[0][1], outer)
            body, word = f"({base}) UNION ALL ({step})", "WITH RECURSIVE"
            head = f"{q.name}({', '.join(f'`{c}`' for c in columns)}) {NO_LEVEL_LIMIT}"
        else:
            body, columns = self.query(q.body, outer)
            self.ctes[q.name.lower()] = columns
            word, head = "WITH", q.name
        sql, schema = self.query(q.query, outer)
        self.ctes = saved
        return f"{word} {head} AS ({body}) {sql}", schema

    def compound(self, q: Compound, outer: Scope | None) -> tuple[str, Schema]:
        sql, columns = self.select(q.first, outer)
        for op, arm in q.rest:
            right, other = self.select(arm, outer)
            if len(other) != len(columns):
                raise DialectError("the arms of a compound query differ in their number of columns")
            sql = f"({sql}) {op} ({right})"
            columns = {c: ty if ty == o or o == "null" else o if ty == "null" else "real" if {ty, o} <= {"int", "real", "bool"} else "text" for (c, ty), o in zip(columns.items(), other.values(), strict=True)}
        if q.order or q.limit is not None or q.offset is not None:
            scope = Scope({"_u": columns}, outer)
            sql = f"SELECT * FROM ({sql}) AS `_u`" + self.tail(q, scope, columns, [])
        return sql, columns

    def source(self, s, outer: Scope | None, tables: dict[str, Schema]) -> str:
        if s[0] == "table":
            columns = self.ctes.get(s[1].lower()) or self.lookup(s[1])
            if columns is None:
                raise DialectError(f"no such table: {s[1]}")
            tables[s[2]] = columns
            return f"`{s[1]}` AS `{s[2]}`"
        if s[0] == "derived":
            body, columns = self.query(s[1], outer)
            alias = s[2] or f"_t{len(tables)}"
            tables[alias] = columns
            return f"({body}) AS `{alias}`"
        _, kind, left, right, on = s
        a = self.source(left, outer, tables)
        b = self.source(right, outer, tables)
        test = f" ON {self.test(on, Scope(tables, outer))}" if on is not None else ""
        if kind == "INNER" and (keys := pairs(left, right, on)):
            # Every row of the left goes to one deal, and every row of the right to all.
            x, y = left[2], right[2]
            keyed = ", ".join(f"`{c}`" for c in keys)
            a = f"(SELECT *, pmod(xxhash64({keyed}), {DEALS}) AS `_deal` FROM {a}) AS `{x}`"
            b = f"(SELECT *, explode(sequence(0L, {DEALS - 1}L)) AS `_deal` FROM {b}) AS `{y}`"
            test += f" AND `{x}`.`_deal` = `{y}`.`_deal`"
            self.dealt.add(x)
        return f"{a} {kind} JOIN {b}{test}"

    def select(self, q: Select, outer: Scope | None) -> tuple[str, Schema]:
        tables: dict[str, Schema] = {}
        source = f" FROM {self.source(q.source, outer, tables)}" if q.source else ""
        scope = Scope(tables, outer)
        columns: Schema = {}
        items: list[str] = []
        written: list[tuple[Any, str]] = []

        def add(name: str, e: Typed, node: Any) -> None:
            base, k = name, 1
            while name.lower() in (c.lower() for c in columns):
                name, k = f"{base}_{k}", k + 1
            sql = f"CAST({e[0]} AS BIGINT)" if e[1] == "bool" else e[0]
            columns[name] = "int" if e[1] == "bool" else e[1]
            items.append(f"{sql} AS `{name}`")
            written.append((node, name))

        for node, alias in q.items:
            if node == ("star",):
                for t, cols in tables.items():
                    for c, ty in cols.items():
                        add(c, (f"`{t}`.`{c}`", ty), ("col", t, c))
            else:
                name = alias or (node[2] if node[0] == "col" else f"_c{len(columns)}")
                add(name, self.expr(node, scope), node)
        where = f" WHERE {self.test(q.where, scope)}" if q.where is not None else ""
        group = f" GROUP BY {', '.join(self.expr(g, scope)[0] for g in q.group)}" if q.group else ""
        grouped = bool(q.group) or any(contains_aggregate(n) for n, _ in q.items) or contains_aggregate(q.having)
        if grouped:
            self.check_grouped(q)
        having = f" HAVING {self.test(q.having, scope)}" if q.having is not None else ""
        scope.named = columns
        # Without the hint a small side is broadcast, and the other one's files, perhaps a single one, set the number of tasks.
        dealt = "".join(f"/*+ MERGE(`{t}`) */ " for t in tables if t in self.dealt)
        sql = f"SELECT {dealt}{'DISTINCT ' if q.distinct else ''}{', '.join(items)}{source}{where}{group}{having}"
        return sql + self.tail(q, scope, columns, written), columns

    def check_grouped(self, q: Select) -> None:
        keys = {g[2].lower() for g in q.group}

        def walk(e: Any) -> None:
            if not isinstance(e, tuple):
                return
            if e[0] == "col" and e[2].lower() not in keys:
                raise DialectError(f"{e[2]} is neither grouped nor aggregated")
            if e[0] in ("sub", "exists", "insel") or e[0] == "fn" and e[1] in AGGREGATES and e[5] is None:
                return
            for x in e[1:]:
                for y in x if isinstance(x, (list, tuple)) and not (isinstance(x, tuple) and x and isinstance(x[0], str)) else [x]:
                    walk(y)

        for node, _ in q.items:
            walk(node)
        walk(q.having)

    def tail(self, q, scope: Scope, columns: Schema, written: list[tuple[Any, str]]) -> str:
        out, keys = "", []
        for e, desc, nulls in q.order:
            keys += self.order(e, desc, nulls, scope, columns, written)
        if keys:
            out += f" ORDER BY {', '.join(keys)}"
        if q.limit is not None:
            out += f" LIMIT {q.limit}"
        if q.offset is not None:
            out += f" OFFSET {q.offset}"
        return out

    def order(self, e, desc: bool, nulls: str | None, scope: Scope, columns: Schema, written: list) -> list[str]:
        """A bare integer is a place, a bare name first an output name; reals sort NaN before all numbers."""
        if e[0] == "int":
            place = int(e[1])
            if not 1 <= place <= len(columns):
                raise DialectError(f"there is no output column {place}")
            name, ty = list(columns.items())[place - 1]
            sql = f"`{name}`"
        elif e[0] == "col" and e[1] is None and (name := next((c for c in columns if c.lower() == e[2].lower()), None)):
            sql, ty = f"`{name}`", columns[name]
        elif name := next((n for node, n in written if node == e), None):
            sql, ty = f"`{name}`", columns[name]
        else:
            sql, ty = self.expr(e, scope)
        way = f"{'DESC' if desc else 'ASC'} NULLS {nulls or ('LAST' if desc else 'FIRST')}"
        if ty == "real":
            return [f"CASE WHEN {sql} IS NOT NULL THEN NOT isnan({sql}) END {way}", f"{sql} {way}"]
        return [f"{sql} {way}"]

    # -- expressions
    def test(self, e, scope: Scope) -> str:
        sql, ty = self.expr(e, scope)
        if ty == "bool":
            return sql
        if ty in ("int", "real", "null"):
            return f"({sql} <> 0)"
        return f"({scalar.cast((sql, ty), 'real')[0]} <> 0)"

    def expr(self, e, scope: Scope) -> Typed:
        return getattr(self, f"_{e[0]}")(e, scope)

    def _int(self, e, scope):
        n = int(e[1])
        return (f"{n}L", "int") if n < 1 << 63 else (f"{n}.0D", "real")

    def _real(self, e, scope):
        return f"{float(e[1])!r}D", "real"

    def _string(self, e, scope):
        return quote(e[1][1:-1].replace("''", "'")), "text"

    def _blob(self, e, scope):
        return f"X{e[1][1:]}", "blob"

    def _null(self, e, scope):
        return "NULL", "null"

    def _param(self, e, scope):
        if e[1] not in self.params:
            raise DialectError(f"parameter {e[1]} has no value")
        v = self.params[e[1]]
        if v is None:
            return "NULL", "null"
        if isinstance(v, (bool, int)):
            return f"{int(v)}L", "int"
        if isinstance(v, float):
            return f"{v!r}D" if v == v and abs(v) != float("inf") else f"double('{v}')", "real"
        return (f"X'{bytes(v).hex()}'", "blob") if isinstance(v, (bytes, bytearray)) else (quote(v), "text")

    def _col(self, e, scope):
        found = scope.find(e[1], e[2])
        if found:
            return found
        if e[1] is None and scope.named:
            for c, ty in scope.named.items():
                if c.lower() == e[2].lower():
                    return f"`{c}`", ty
        if e[1] is None and e[2].upper() in ("TRUE", "FALSE"):
            return ("1L" if e[2].upper() == "TRUE" else "0L"), "int"
        now = {"CURRENT_TIMESTAMP": "yyyy-MM-dd HH:mm:ss", "CURRENT_DATE": "yyyy-MM-dd", "CURRENT_TIME": "HH:mm:ss"}
        if e[1] is None and e[2].upper() in now:
            return f"date_format(current_timestamp(), '{now[e[2].upper()]}')", "text"
        raise DialectError(f"no such column: {e[2]}")

    def _not(self, e, scope):
        return f"(NOT {self.test(e[1], scope)})", "bool"

    def _neg(self, e, scope):
        if e[1][0] == "int" and int(e[1][1]) == 1 << 63:
            return "(-9223372036854775807L - 1L)", "int"
        sql, ty = as_number(self.expr(e[1], scope))
        return f"(- {sql})", ty

    def _inv(self, e, scope):
        return f"(~ {as_number(self.expr(e[1], scope))[0]})", "int"

    def _collate(self, e, scope):
        sql, ty = self.expr(e[1], scope)
        return sql, ty

    def _bin(self, e, scope):
        _, op, left, right = e
        if op in ("AND", "OR"):
            return f"({self.test(left, scope)} {op} {self.test(right, scope)})", "bool"
        a, b = self.expr(left, scope), self.expr(right, scope)
        if op == "||":
            return f"concat({as_text(a)}, {as_text(b)})", "text"
        a, b = as_number(a), as_number(b)
        if {a[1], b[1]} - {"int", "real"}:
            raise DialectError(f"{op} takes numbers")
        if op in ("&", "|"):
            return f"({a[0]} {op} {b[0]})", "int"
        if op in ("<<", ">>"):
            word = "shiftleft" if op == "<<" else "shiftright"
            n = f"CAST(least({b[0]}, 63L) AS INT)"
            return f"CASE WHEN {b[0]} >= 64 THEN 0L ELSE {word}({a[0]}, {n}) END", "int"
        if op == "%":
            return (f"try_mod({a[0]}, {b[0]})", "int") if a[1] == b[1] == "int" else (f"try_mod({as_real(a)}, {as_real(b)})", "real")
        if a[1] == b[1] == "int":
            return f"({a[0]} {'div' if op == '/' else op} {b[0]})", "int"
        return f"({as_real(a)} {op} {as_real(b)})", "real"

    def collation(self, *nodes) -> str | None:
        """The leftmost COLLATE of the operands."""
        return next((n[2] for n in nodes if n[0] == "collate"), None)

    def compare(self, op: str, a: Typed, b: Typed, collation: str | None = None) -> Typed:
        if "null" in (a[1], b[1]):
            return "CAST(NULL AS BOOLEAN)", "bool"
        if a[1] == "json" and CLASS.get(b[1]) == 0:
            a = as_number(a)
        if b[1] == "json" and CLASS.get(a[1]) == 0:
            b = as_number(b)
        if "ts" in (a[1], b[1]) and a[1] != b[1]:
            a, b = ((x[0] if x[1] == "ts" else f"try_cast({as_text(x)} AS TIMESTAMP_NTZ)", "ts") for x in (a, b))
        ca, cb = CLASS.get(a[1], 1), CLASS.get(b[1], 1)
        if ca != cb:
            true = {"=": False, "<>": True}.get(op, (ca < cb) == (op[0] == "<"))
            return f"CASE WHEN {a[0]} IS NOT NULL AND {b[0]} IS NOT NULL THEN {str(true).lower()} END", "bool"
        if ca == 0:
            a, b = as_number(a), as_number(b)
            if a[1] != b[1]:
                literal = next((x for x in (a, b) if x[1] == "int" and x[0].strip("()- L").isdigit()), None)
                if literal and int(literal[0].strip("()- L")) <= EXACT:
                    a, b = (f"{x[0][:-1]}.0D" if x is literal and x[0][-1] == "L" else as_real(x) for x in (a, b))
                    return f"({a} {op} {b})", "bool"
                real = a if a[1] == "real" else b
                exact = " ".join((f"CAST({a[0]} AS DECIMAL(38,15))", op, f"CAST({b[0]} AS DECIMAL(38,15))"))
                return f"(CASE WHEN isnan({real[0]}) OR abs({real[0]}) >= 9.3e18D OR abs({real[0]}) < {EXACT}.0D THEN {as_real(a)} {op} {as_real(b)} ELSE {exact} END)", "bool"
        if ca == 1 and a[1] != "ts":
            a, b = as_text(a), as_text(b)
            if collation == "NOCASE":
                a, b = fold(a), fold(b)
            elif collation == "RTRIM":
                a, b = f"rtrim({a})", f"rtrim({b})"
            return f"({a} {op} {b})", "bool"
        return f"({a[0]} {op} {b[0]})", "bool"

    def _cmp(self, e, scope):
        _, op, left, right = e
        return self.compare(op, self.expr(left, scope), self.expr(right, scope), self.collation(left, right))

    def _isnull(self, e, scope):
        return f"({self.expr(e[1], scope)[0]} IS {'NOT ' if e[2] else ''}NULL)", "bool"

    def _between(self, e, scope):
        _, x, low, high, negated = e
        v, c = self.expr(x, scope), self.collation(x, low, high)
        both = f"({self.compare('>=', v, self.expr(low, scope), c)[0]} AND {self.compare('<=', v, self.expr(high, scope), c)[0]})"
        return f"(NOT {both})" if negated else both, "bool"

    def _in(self, e, scope):
        _, x, values, negated = e
        v = self.expr(x, scope)
        sides = [self.expr(y, scope) for y in values]
        if all(s[1] == v[1] for s in sides) and not self.collation(x):
            sql = f"({v[0]} IN ({', '.join(s[0] for s in sides)}))"
        else:
            sql = "(" + " OR ".join(self.compare("=", v, s, self.collation(x))[0] for s in sides) + ")"
        return f"(NOT {sql})" if negated else sql, "bool"

    def _insel(self, e, scope):
        body, columns = self.query(e[2], scope)
        if len(columns) != 1:
            raise DialectError("IN takes a query of one column")
        v, ty = self.expr(e[1], scope), next(iter(columns.values()))
        left = as_real(v) if {v[1], ty} == {"int", "real"} and ty == "real" else v[0]
        return f"({left} {'NOT ' if e[3] else ''}IN ({body}))", "bool"

    def _exists(self, e, scope):
        return f"({'NOT ' if e[2] else ''}EXISTS ({self.query(e[1], scope)[0]}))", "bool"

    def _sub(self, e, scope):
        body, columns = self.query(e[1], scope)
        if len(columns) != 1:
            raise DialectError("a scalar subquery has one column")
        q = e[1]
        single = isinstance(q, Select) and not q.group and any(contains_aggregate(n) for n, _ in q.items)
        if not single and getattr(q, "limit", 0) is None:
            body += " LIMIT 1"
        return f"({body})", next(iter(columns.values()))

    def _like(self, e, scope):
        _, kind, x, pattern, negated = e
        a, p = self.expr(x, scope), self.expr(pattern, scope)
        if a[1] not in ("text", "json", "ts") or p[1] not in ("text", "json"):
            return "CAST(NULL AS BOOLEAN)", "bool"
        a, p = as_text(a), p[0]
        if kind == "GLOB":
            if pattern[0] == "string":
                sql = f"({a} RLIKE {quote(scalar.glob_regex(pattern[1][1:-1].replace(chr(39) * 2, chr(39))))})"
            else:
                safe = f"regexp_replace({p}, {quote(r'([\\.^$|()\[\]{}+])')}, {quote(r'\\$1')})"
                sql = f"({a} RLIKE concat('^(?s:', replace(replace({safe}, '*', '.*'), '?', '.'), ')$'))"
        else:
            sql = f"({fold(a)} LIKE {fold(p)} ESCAPE '\\u0001')"
        return f"(NOT {sql})" if negated else sql, "bool"

    def _case(self, e, scope):
        _, operand, arms, other = e
        results = [self.expr(r, scope) for _, r in arms] + ([self.expr(other, scope)] if other is not None else [])
        kinds = {ty for _, ty in results if ty != "null"}
        ty = "null" if not kinds else "int" if kinds <= {"int", "bool"} else "real" if kinds <= {"int", "bool", "real"} else kinds.pop() if len(kinds) == 1 else "text"
        form = {"int": lambda r: as_number(r)[0], "real": as_real, "text": as_text}.get(ty, lambda r: r[0])
        if operand is None:
            tests = [self.test(t, scope) for t, _ in arms]
        else:
            v = self.expr(operand, scope)
            tests = [self.compare("=", v, self.expr(t, scope), self.collation(operand, t))[0] for t, _ in arms]
        body = " ".join(f"WHEN {t} THEN {form(r)}" for t, r in zip(tests, results, strict=False))
        tail = f" ELSE {form(results[-1])}" if other is not None else ""
        return f"CASE {body}{tail} END", ty

    def _cast(self, e, scope):
        if e[2] not in CAST_NAMES:
            raise DialectError(f"no such type: {e[2]}")
        return scalar.cast(self.expr(e[1], scope), CAST_NAMES[e[2]])

    def _match(self, e, scope):
        raise DialectError("MATCH stands alone in the WHERE of a query on a full-text table")

    def _fn(self, e, scope):
        _, name, args, distinct, star, over = e
        if name in RANKS or name in AGGREGATES and over is not None:
            return self.window(name, args, distinct, star, over, scope)
        if name in AGGREGATES:
            return self.aggregate(name, args, distinct, star, scope)
        if distinct:
            raise DialectError("DISTINCT is for aggregates")
        if name == "SQLITE_VERSION" and not args:
            return f"'{VERSION}'", "text"
        if name in SESSION and not args:
            return f"{self.session.get(name, 0)}L", "int"
        if name == "NULLIF":
            a, b = (self.expr(x, scope) for x in args)
            return f"CASE WHEN {self.compare('=', a, b)[0]} THEN NULL ELSE {a[0]} END", a[1]
        if name == "IIF":
            return self._case(("case", None, [(args[0], args[1])], args[2]), scope)
        if name not in scalar.FUNCTIONS:
            raise DialectError(f"no such function: {name}")
        return scalar.call(name, [self.expr(x, scope) for x in args])

    def aggregate(self, name, args, distinct, star, scope, over: str = "") -> Typed:
        some = "DISTINCT " if distinct else ""
        if star:
            return f"count(1){over}", "int"
        v = self.expr(args[0], scope)
        sql, ty = (f"CAST({v[0]} AS BIGINT)", "int") if v[1] == "bool" else v
        if name == "COUNT":
            return f"count({some}{sql}){over}", "int"
        if name in ("GROUP_CONCAT", "STRING_AGG"):
            if over:
                raise DialectError(f"{name}() isn't a window function")
            sep = args[1] if len(args) > 1 else ("string", "','")
            if sep[0] != "string":
                raise DialectError("the separator is a literal")
            # Its order is open in the dialect; sorting makes the result the same for every run.
            gather = "collect_set" if distinct else "collect_list"
            return f"CASE WHEN count({sql}) > 0 THEN array_join(array_sort({gather}({as_text(v)})), {self._string(sep, scope)[0]}) END", "text"
        if name in ("SUM", "AVG"):
            if ty in ("text", "blob", "ts"):
                raise DialectError(f"{name}() takes numbers")
            sql, ty = as_number((sql, ty))
            return f"{name.lower()}({some}{sql}){over}", "real" if name == "AVG" else ty
        if ty == "real":
            if name == "MAX":
                return f"coalesce(max(CASE WHEN NOT isnan({sql}) THEN {sql} END){over}, max({sql}){over})", "real"
            return f"CASE WHEN max(isnan({sql})){over} THEN double('NaN') ELSE min({sql}){over} END", "real"
        return f"{name.lower()}({sql}){over}", ty

    def window(self, name, args, distinct, star, over, scope) -> Typed:
        parts, order, frame = over
        if distinct:
            raise DialectError("a window function takes no DISTINCT")
        if frame and name not in AGGREGATES:
            raise DialectError("a frame is for aggregates")
        by = "PARTITION BY " + ", ".join(self.expr(p, scope)[0] for p in parts) if parts else ""

        def spec(keys: list[str], low: str | None = None, high: str | None = None) -> str:
            sorting = "ORDER BY " + ", ".join(keys) if keys else ""
            return f" OVER ({' '.join(x for x in (by, sorting, f'ROWS BETWEEN {low} AND {high}' if low else '') if x)})"

        def bound(at: int) -> str:
            return f"{abs(at)} {'FOLLOWING' if at > 0 else 'PRECEDING'}" if at else "CURRENT ROW"

        keys = [k for e, desc, nulls in order for k in self.order(e, desc, nulls, scope, {}, [])]
        positional = name in AGGREGATES or name in ("FIRST_VALUE", "LAST_VALUE", "NTH_VALUE")
        low, high = frame or ("UNBOUNDED PRECEDING", "CURRENT ROW") if positional and (order or frame) else (None, None)
        around = spec(keys, low, high)
        if name in AGGREGATES:
            if high == "UNBOUNDED FOLLOWING" and not low.startswith("UNBOUNDED") and keys:
                # Spark adds such a frame up anew for every row, but one that begins at the first row only once.
                n, side = low.split()
                at = 0 if n == "CURRENT" else int(n) if side == "FOLLOWING" else -int(n)
                if name == "COUNT":
                    counts = [self.aggregate(name, args, False, star, scope, spec(keys, "UNBOUNDED PRECEDING", end))[0] for end in (high, bound(at - 1))]
                    return f"({counts[0]} - {counts[1]})", "int"
                turned = [k for e, desc, nulls in order for k in self.order(e, not desc, "FIRST" if (nulls or ("LAST" if desc else "FIRST")) == "LAST" else "LAST", scope, {}, [])]
                around = spec(turned, "UNBOUNDED PRECEDING", bound(-at))
            return self.aggregate(name, args, False, star, scope, around)
        values = [self.expr(a, scope) for a in args]
        if name in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
            return f"CAST({name.lower()}(){around} AS BIGINT)", "int"
        if name in ("PERCENT_RANK", "CUME_DIST"):
            return f"{name.lower()}(){around}", "real"
        if name == "NTILE":
            return f"CAST(ntile({values[0][0].rstrip('L')}){around} AS BIGINT)", "int"
        v, ty = values[0]
        if name in ("LAG", "LEAD"):
            rest = [values[1][0].rstrip("L")] if len(values) > 1 else []
            if len(values) > 2:
                rest.append(f"CAST({values[2][0]} AS {SQL_TYPE[ty]})")
            return f"{name.lower()}({', '.join([v, *rest])}){around}", ty
        extra = f", {values[1][0].rstrip('L')}" if name == "NTH_VALUE" else ""
        return f"{name.lower()}({v}{extra}){around}", ty
