"""Parser of statements other than queries."""

from __future__ import annotations

from ..functions.scalar import DialectError
from .syntax import Parser
from .translate import CAST_NAMES

ACTIONS = {"CASCADE": "CASCADE", "RESTRICT": "RESTRICT"}


class StatementParser(Parser):
    def __init__(self, sql: str):
        super().__init__(sql)
        self.sql = sql
        # Character places of the tokens, for the text of views, checks and bodies.
        from .syntax import TOKEN

        self.places, at = [], 0
        while at < len(sql):
            m = TOKEN.match(sql, at)
            if m.lastgroup != "space":
                self.places.append((at, m.end()))
            at = m.end()
        self.places.append((len(sql), len(sql)))

    def text(self, begin: int, end: int) -> str:
        return self.sql[self.places[begin][0]:self.places[end - 1][1]]

    def span(self, parse) -> str:
        begin = self.at
        parse()
        return self.text(begin, self.at)

    def if_exists(self, *words: str) -> bool:
        return self.take("IF", *words, "EXISTS")

    def done(self, out: dict) -> dict:
        self.take(";")
        if self.toks[self.at][0] != "end":
            raise DialectError(f"unexpected {self.toks[self.at][1]!r}")
        return out

    def statement(self) -> dict:
        return self.done(self.any())

    def any(self) -> dict:
        word = self.peek()
        if word in ("SELECT", "WITH"):
            begin = self.at
            if word == "WITH" and self._with_insert():
                return self.insert(self.with_text)
            self.at = begin
            return {"kind": "query", "sql": self.span(self.query)}
        simple = {"INSERT": self.insert, "REPLACE": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop,
                  "ALTER": self.alter, "PRAGMA": self.pragma, "EXPLAIN": self.explain, "SAVEPOINT": self.savepoint, "RELEASE": self.savepoint}
        if word in simple:
            return simple[word]()
        if self.take("BEGIN"):
            self.take("TRANSACTION")
            return {"kind": "begin"}
        if self.take("COMMIT") or self.take("END"):
            self.take("TRANSACTION")
            return {"kind": "commit"}
        if self.take("ROLLBACK"):
            self.take("TRANSACTION")
            if self.take("TO"):
                self.take("SAVEPOINT")
                return {"kind": "rollback_to", "name": self.name()}
            return {"kind": "rollback"}
        if self.take("VACUUM"):
            return {"kind": "vacuum"}
        if self.take("ATTACH"):
            self.take("DATABASE")
            path = self.toks[self.at][1]
            self.at += 1
            self.need("AS")
            return {"kind": "attach", "path": path[1:-1], "name": self.name()}
        if self.take("DETACH"):
            self.take("DATABASE")
            return {"kind": "detach", "name": self.name()}
        raise DialectError(f"unknown statement: {self.toks[self.at][1]!r}")

    def _with_insert(self) -> bool:
        """Past ``WITH name AS (...)``, if INSERT follows."""
        begin = self.at
        self.take("WITH")
        self.take("RECURSIVE")
        self.name()
        self.need("AS", "(")
        self.query()
        self.need(")")
        self.with_text = self.text(begin, self.at)
        return self.peek() in ("INSERT", "REPLACE")

    def savepoint(self) -> dict:
        word = self.peek()
        self.at += 1
        if word == "RELEASE":
            self.take("SAVEPOINT")
        return {"kind": word.lower(), "name": self.name()}

    def explain(self) -> dict:
        self.need("EXPLAIN")
        analyze = self.take("ANALYZE")
        self.take("QUERY", "PLAN")
        return {"kind": "explain", "analyze": analyze, "sql": self.span(self.query if self.peek() in ("SELECT", "WITH", "VALUES") else self.statement)}

    def pragma(self) -> dict:
        self.need("PRAGMA")
        name, value = self.name().lower(), None
        if self.take("("):
            value = self.toks[self.at][1].strip("'\"")
            self.at += 1
            self.need(")")
            return {"kind": "pragma", "name": name, "arg": value}
        if self.take("="):
            value = self.toks[self.at][1].strip("'\"")
            self.at += 1
        return {"kind": "pragma", "name": name, "value": value}

    # -- data
    def insert(self, prefix: str = "") -> dict:
        how = "ABORT"
        if self.take("REPLACE"):
            how = "REPLACE"
        else:
            self.need("INSERT")
            if self.take("OR"):
                how = self.name().upper()
        self.need("INTO")
        out = {"kind": "insert", "how": how, "table": self.name(), "columns": None, "upsert": None, "returning": None}
        if self.peek() == "(":
            out["columns"] = self.names()
        if self.take("VALUES"):
            def row():
                self.need("(")
                values = self.some(self.expr)
                self.need(")")
                return values
            out["values"] = self.some(row)
        else:
            out["select"] = f"{prefix} {self.span(self.query)}"
        if self.take("ON"):
            self.need("CONFLICT")
            keys = self.names()
            self.need("DO", "UPDATE", "SET")
            out["upsert"] = keys, self.some(self.assignment)
        out["returning"] = self.returning()
        return out

    def returning(self):
        return self.some(self.item) if self.take("RETURNING") else None

    def assignment(self):
        name = self.name()
        self.need("=")
        return name, self.expr()

    def tail(self, out: dict) -> dict:
        out |= {"where": self.expr() if self.take("WHERE") else None, "order": [], "limit": None}
        if self.take("ORDER"):
            self.need("BY")
            out["order"] = self.some(self.order_key)
        if self.take("LIMIT"):
            out["limit"] = self.integer()
        return out | {"returning": self.returning()}

    def update(self) -> dict:
        self.need("UPDATE")
        name = self.name()
        self.need("SET")
        return self.tail({"kind": "update", "table": name, "set": self.some(self.assignment)})

    def delete(self) -> dict:
        self.need("DELETE", "FROM")
        return self.tail({"kind": "delete", "table": self.name()})

    # -- definitions
    def create(self) -> dict:
        self.need("CREATE")
        if self.take("VIRTUAL", "TABLE"):
            name = self.name()
            self.need("USING")
            if self.name().upper() != "FTS5":
                raise DialectError("only fts5 tables are virtual")
            return {"kind": "create_fts", "name": name, "columns": self.names()}
        if self.take("REACTIVE", "VIEW"):
            name = self.name()
            self.need("AS")
            sql, mode = self.span(self.query), None
            if self.take("REFRESH"):
                mode = self.name().upper()
            return {"kind": "create_reactive", "name": name, "sql": sql, "mode": mode}
        if self.take("VIEW"):
            missing = self.if_exists("NOT")
            name = self.name()
            columns = self.names() if self.peek() == "(" else None
            self.need("AS")
            return {"kind": "create_view", "name": name, "missing": missing, "columns": columns, "sql": self.span(self.query)}
        if self.take("TRIGGER"):
            return self.trigger()
        if self.take("TABLE"):
            return self.create_table()
        unique = self.take("UNIQUE")
        self.need("INDEX")
        missing = self.if_exists("NOT")
        name = self.name()
        self.need("ON")
        table = self.name()
        self.need("(")
        exprs = self.some(lambda: (self.span(self.expr), self.take("DESC") or self.take("ASC"))[0])
        self.need(")")
        where = self.span(self.expr) if self.take("WHERE") else None
        return {"kind": "create_index", "name": name, "missing": missing, "table": table, "unique": unique, "exprs": exprs, "where": where}

    def trigger(self) -> dict:
        name = self.name()
        timing = "INSTEAD" if self.take("INSTEAD", "OF") else self.name().upper()
        event = self.name().upper()
        self.need("ON")
        table = self.name()
        self.take("FOR", "EACH", "ROW")
        when = self.span(self.expr) if self.take("WHEN") else None
        self.need("BEGIN")
        body = []
        while not self.take("END"):
            body.append(self.span(self.any))
            self.need(";")
        return {"kind": "create_trigger", "name": name, "timing": timing, "event": event, "table": table, "when": when, "body": body}

    def create_table(self) -> dict:
        missing = self.if_exists("NOT")
        out = {"kind": "create_table", "name": self.name(), "missing": missing, "columns": [], "keys": [], "checks": []}
        self.need("(")
        while True:
            word = self.peek()
            if word in ("PRIMARY", "UNIQUE"):
                self.at += 1
                self.take("KEY")
                names = self.key_names()
                out["keys"].insert(0, names) if word == "PRIMARY" else out["keys"].append(names)
                out["columns"] = [c | {"not_null": True, "key": True} if word == "PRIMARY" and c["name"] in names else c for c in out["columns"]]
            elif self.take("CHECK"):
                self.need("(")
                out["checks"].append(self.span(self.expr))
                self.need(")")
            elif self.take("FOREIGN", "KEY"):
                (own,) = self.names()
                ref = self.references()
                out["columns"] = [c | {"references": ref} if c["name"] == own else c for c in out["columns"]]
            else:
                out["columns"].append(self.column(out["keys"]))
            if not self.take(","):
                break
        self.need(")")
        out["columnar"] = False
        while True:
            if self.take("USING", "COLUMNSTORE"):
                out["columnar"] = True
            elif not self.take("WITHOUT", "ROWID"):
                return out

    def key_names(self) -> list[str]:
        """The columns of a key; their directions don't matter to it."""
        self.need("(")
        names = self.some(lambda: (self.name(), self.take("DESC") or self.take("ASC"))[0])
        self.need(")")
        return names

    def references(self) -> list:
        self.need("REFERENCES")
        table = self.name()
        column = self.names()[0] if self.peek() == "(" else None
        rules = {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}
        while self.take("ON"):
            event = self.name().upper()
            rule = self.name().upper()
            if rule in ("SET", "NO"):
                rule += " " + self.name().upper()
            rules[event] = rule
        if self.take("DEFERRABLE"):
            self.take("INITIALLY", "DEFERRED")
        return [table, column, rules["DELETE"], rules["UPDATE"]]

    def column(self, keys: list) -> dict:
        name, kind = self.name(), self.name().upper()
        if kind not in CAST_NAMES:
            raise DialectError(f"no such type: {kind}")
        out = {"name": name, "type": CAST_NAMES[kind]}
        while True:
            if self.take("NOT", "NULL"):
                out["not_null"] = True
            elif self.take("PRIMARY", "KEY"):
                self.take("DESC") or self.take("ASC")
                out |= {"key": True, "not_null": True, "auto": self.take("AUTOINCREMENT")}
                keys.insert(0, [name])
            elif self.take("UNIQUE"):
                out["unique"] = True
                keys.append([name])
            elif self.take("DEFAULT"):
                out["default"] = self.span(self.unary)
            elif self.take("CHECK"):
                self.need("(")
                out["check"] = self.span(self.expr)
                self.need(")")
            elif self.take("GENERATED", "ALWAYS", "AS") or self.take("AS"):
                self.need("(")
                out["generated"] = self.span(self.expr)
                self.need(")")
                self.take("STORED") or self.take("VIRTUAL")
            elif self.peek() == "REFERENCES":
                out["references"] = self.references()
            else:
                return out

    def drop(self) -> dict:
        self.need("DROP")
        what = "reactive" if self.take("REACTIVE", "VIEW") else self.name().lower()
        return {"kind": "drop", "what": what, "missing": self.if_exists(), "name": self.name()}

    def alter(self) -> dict:
        self.need("ALTER", "TABLE")
        out = {"kind": "alter", "table": self.name()}
        if self.take("ADD"):
            self.take("COLUMN")
            return out | {"add": self.column([])}
        if self.take("DROP"):
            self.take("COLUMN")
            return out | {"drop": self.name()}
        self.need("RENAME")
        if self.take("TO"):
            return out | {"to": self.name()}
        self.take("COLUMN")
        old = self.name()
        self.need("TO")
        return out | {"rename": (old, self.name())}
