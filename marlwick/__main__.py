"""A shell: ``python -m marlwick [path]`` reads statements that end in ``;`` and commands that begin with a dot.

Commands: .tables, .schema, .databases, .open PATH, .dump, .import FILE TABLE (Parquet, or CSV with a header), .quit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from .engine import Engine
from .functions.scalar import DialectError
from .plans.statements import StatementParser
from .session import session
from .sources import tables


class Shell:
    def __init__(self, spark, path: str | None = None):
        self.spark, self.db = spark, Engine(spark, path)

    def command(self, line: str) -> Iterator[str]:
        word, *args = line.split()
        state = self.db.store.state
        if word == ".tables":
            yield from sorted([*state.tables, *state.views])
        elif word == ".schema":
            yield from self.db.dump(schema_only=True)
        elif word == ".dump":
            yield from self.db.dump()
        elif word == ".databases":
            yield from (r.name for r in self.db.query("PRAGMA database_list").collect())
        elif word == ".open" and len(args) == 1:
            self.db = Engine(self.spark, args[0])
        elif word == ".import" and len(args) == 2:
            kind = "csv" if args[0].endswith(".csv") else "parquet"
            options = {"header": "true", "inferSchema": "true"} if kind == "csv" else {}
            name = f"_import_{args[1]}"
            self.db.register(name, tables.read(self.spark, args[0], kind, **options))
            try:
                yield f"{self.db.execute(f'INSERT INTO {args[1]} SELECT * FROM {name}').count} rows"
            finally:
                del self.db.external[name.lower()]
        else:
            yield f"unknown command: {line.strip()}"

    def statement(self, sql: str) -> Iterator[str]:
        if StatementParser(sql).statement()["kind"] in ("query", "pragma", "explain"):
            df = self.db.query(sql)
            yield "|".join(df.columns)
            for row in df.toLocalIterator():
                yield "|".join("" if v is None else str(v) for v in row)
        else:
            done = self.db.execute(sql)
            for row in done.returned.toLocalIterator() if done.returned is not None else ():
                yield "|".join("" if v is None else str(v) for v in row)

    def answers(self, lines: Iterable[str]) -> Iterator[str]:
        """Output lines for input lines; an error is a line, and the next statement goes on."""
        held = ""
        for line in lines:
            try:
                if not held and line.strip() == ".quit":
                    return
                if not held and line.startswith("."):
                    yield from self.command(line)
                    continue
                held += line
                if held.strip().endswith(";"):
                    sql, held = held, ""
                    yield from self.statement(sql)
            except Exception as e:
                kind = "" if isinstance(e, DialectError) else f"{type(e).__name__}: "
                yield f"error: {kind}{str(e).splitlines()[0] if str(e) else ''}"
                held = ""


def main() -> None:
    shell = Shell(session(), sys.argv[1] if len(sys.argv) > 1 else None)
    for out in shell.answers(sys.stdin):
        print(out, flush=True)


if __name__ == "__main__":
    main()
