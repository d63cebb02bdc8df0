"""The database handle: dialect text in, DataFrames out.

``query`` translates to Spark SQL over temporary views. ``execute`` runs
definitions and data changes; changes are computed as DataFrames over whole
tables (one join or filter each), never row by row on the driver.
"""

from __future__ import annotations

import copy
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar
from .functions.scalar import SQL_TYPE, DialectError
from .operators import fts
from .plans import measure
from .plans.statements import StatementParser
from .plans.syntax import Parser, Select, tokens
from .plans.translate import Scope, Translator, spark_type
from .session import workspace
from .sources.store import ROWID, Column, State, Store, Table
from .streaming import ivm

#: Triggers that may be nested in each other.
TRIGGER_DEPTH = 32
#: Changes that a trigger's UPDATE applies to one row at a time.
TRIGGER_FOLD = 4096
#: Words for the values of switches.
SWITCH = {"on": 1, "true": 1, "off": 0, "false": 0}
#: Settings with a default: numbers and switches, and fixed words for what the file system does.
PRAGMAS = {"user_version": 0, "foreign_keys": 1, "recursive_triggers": 0, "defer_foreign_keys": 0, "journal_mode": "none", "synchronous": "full"}


@dataclass
class Change:
    """What a statement did: a count, the returned rows, and the change feed (_op, _rowid, old_*, new_*)."""

    count: int = 0
    returned: DataFrame | None = None
    feed: DataFrame | None = None
    table: str | None = None


class Prepared:
    """A parsed statement. Parameters are given by place, or by name; those that a name doesn't give are null in ``params_of_named``."""

    def __init__(self, engine: Engine, sql: str):
        self.engine, self.sql = engine, sql
        self.kind = StatementParser(sql).statement()["kind"]
        marks = [t for kind, t in tokens(sql) if kind == "param"]
        self.slots = list(dict.fromkeys(f"?{i}" if t == "?" else t for i, t in enumerate(marks)))

    def __call__(self, *args, **named) -> DataFrame | Change:
        return (self.engine.query if self.kind == "query" else self.engine.execute)(self.sql, *args, **named)

    def run(self, *args, **named) -> int:
        """Carry out a data change; the number of rows it changed."""
        return self.engine.execute(self.sql, *args, **named).count

    def iter(self, *args, **named) -> Iterator[Row]:
        """Pull a query's rows one partition at a time."""
        return self.engine.rows(self.sql, *args, **named)

    def iter_with_stats(self, *args, **named) -> tuple[Iterator[Row], measure.Stats]:
        """Rows, and what the query costs, from a run of its own."""
        return self.iter(*args, **named), self.engine.stats(self.sql, *args, **named)

    def param_slot(self, name: str) -> int | None:
        """The place, from 0, of a named parameter."""
        return next((i for i, s in enumerate(self.slots) if s[1:] == name.lstrip(":@$") and s[0] != "?"), None)

    def params_of_named(self, values: dict) -> dict:
        """A value for every named parameter, null where none is given."""
        return {s[1:]: values.get(s[1:]) for s in self.slots if s[0] != "?"}


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, clock: Callable[[], float] = time.time):
        self.spark = spark
        scalar.register(spark)
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # which a query's own text can't lift, as it does the level limit
        self.store = Store(spark, root or workspace(spark, "marlwick-db"), clock)
        self.prefix = f"db_{uuid.uuid4().hex[:8]}_"
        self.external: dict[str, DataFrame] = {}
        self.attached: dict[str, Engine] = {}
        self.active = "main"  # the database that statements go to
        self.hooks: list[tuple[str, str, str, Callable[[DataFrame], None]]] = []
        self.callbacks: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.generations: dict[str, int] = {}  # of each reactive view that this handle made, a number that only grows
        self.made = 0
        self.counters = {"changes": 0, "total_changes": 0, "last_insert_rowid": 0}
        self.firing: list[str] = []  # the triggers that run now, the outermost first

    # -- queries
    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A DataFrame, such as a Parquet scan, or a function that gives one, as a read-only table."""
        self.external[name.lower()] = df

    def _external(self, name: str) -> DataFrame | None:
        found = self.external.get(name)
        if callable(found):
            found = self.external[name] = found()
        return found

    def _frame(self, name: str, state: State) -> DataFrame | None:
        low = name.lower()
        if low in ("sqlite_master", "sqlite_schema"):
            return self.master(state)
        if low == "sqlite_sequence":
            rows = [(n, t.next_rowid - 1) for n, t in state.tables.items() if any(c.auto for c in t.columns) and t.next_rowid > 1]
            return self.spark.createDataFrame(rows, "name string, seq long")
        for known in state.tables:
            if known.lower() == low:
                return self.store.rows(known, state).drop(ROWID)
        for known, sql in state.views.items():
            if known.lower() == low:
                return self._run(sql, state, {})
        return self._external(low)

    def _run(self, sql: str, state: State, params: dict, beside: tuple[DataFrame, dict] | None = None) -> DataFrame:
        """The rows of a query; ``beside`` are rows, and their scope, that it is evaluated for each of."""
        views: dict[str, str] = {}

        def lookup(name: str):
            df = self._frame(name, state)
            if df is None:
                return None
            view = views.setdefault(name.lower(), f"{self.prefix}{uuid.uuid4().hex[:6]}_{name}")
            df.createOrReplaceTempView(view)
            return {c: spark_type(t) for c, t in df.dtypes}

        made = Views(lookup, params, views)
        made.session = {k.upper(): v for k, v in self.counters.items()}
        try:
            if beside is None:
                return self.spark.sql(made.translate(sql))
            rows, scope = beside
            views[""] = f"{self.prefix}{uuid.uuid4().hex[:6]}"
            rows.createOrReplaceTempView(views[""])
            inner = made.query(Parser(sql).query(), Scope(scope))[0]
            return self.spark.sql(f"SELECT `_inner`.* FROM `{views['']}` AS `_beside`, LATERAL ({inner}) AS `_inner`")
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def query(self, sql: str, *args, **named) -> DataFrame:
        """The rows of a SELECT or WITH, an EXPLAIN or a PRAGMA, as a lazy DataFrame."""
        st = StatementParser(sql).statement()
        if other := self._elsewhere(st):
            return other.query(sql, *args, **named)
        if st["kind"] == "pragma":
            return self.pragma(st)
        if st["kind"] == "explain":
            return self.explain(st)
        if st["kind"] != "query":
            raise DialectError("query() takes SELECT, WITH, EXPLAIN or PRAGMA")
        params = {i + 1: v for i, v in enumerate(args)} | named
        found = fts.matched(self, st["sql"], params)
        return found if found is not None else self._run(st["sql"], self.store.state, params)

    def _elsewhere(self, st: dict) -> Engine | None:
        """The attached database that a statement goes to; what is about databases as such stays here."""
        about = st["kind"] in ("attach", "detach") or st["kind"] == "pragma" and st["name"] in ("active_database", "database_list")
        return None if about else self.attached.get(self.active)

    def rows(self, sql: str, *args, **named) -> Iterator[Row]:
        """Pull rows one partition at a time."""
        return self.query(sql, *args, **named).toLocalIterator()

    def query_as_of(self, sql: str, txn: int | None = None, ts: float | None = None, params: dict | None = None) -> DataFrame:
        """A query over the last version at or before a commit number or a time."""
        return self._run(StatementParser(sql).statement()["sql"], self.store.as_of(txn, ts), params or {})

    def prepare(self, sql: str) -> Prepared:
        """A statement to run with different parameters; Spark plans each run anew from current sizes."""
        return Prepared(self, sql)

    def stats(self, sql: str, *args, **named) -> measure.Stats:
        """What a query costs, from running it once."""
        return measure.stats(self.query(sql, *args, **named))

    def explain(self, st: dict) -> DataFrame:
        """One row per operator: id, parent (the root's is -1), detail, and with ANALYZE rows and ms.

        A data change is one operator over the plan of the query that it takes its rows from; ANALYZE carries it out.
        """
        inner = StatementParser(st["sql"]).statement()
        top = []
        if inner["kind"] != "query":
            began, count, ms = time.time(), None, None
            if st["analyze"]:
                count = self.execute(st["sql"]).count
                ms = 1000 * (time.time() - began)
            top = [measure.Operator(0, -1, inner["kind"], f"{inner['kind'].capitalize()} {inner['table']}", count, ms)]
        source = st["sql"] if inner["kind"] == "query" else inner.get("select")
        nodes = []
        if source:
            found = fts.matched(self, source, {})
            df = found if found is not None else self._run(source, self.store.state, {})
            nodes = measure.operators(df, st["analyze"] and not top)
        rows = [(n.id, n.parent, n.detail, n.rows, n.ms) for n in top]
        rows += [(n.id + len(top), n.parent + len(top), n.detail[:200], n.rows, n.ms) for n in nodes]
        return self.spark.createDataFrame(rows, "id int, parent int, detail string, rows long, ms double")

    def master(self, state: State) -> DataFrame:
        rows = [("table", n, n, ", ".join(f"{c.name} {c.type}" for c in t.columns)) for n, t in state.tables.items()]
        rows += [("index", i, n, ", ".join(x["exprs"])) for n, t in state.tables.items() for i, x in t.indexes.items()]
        rows += [("view", n, n, sql) for n, sql in state.views.items()] + [("trigger", n, t["table"], "; ".join(t["body"])) for n, t in state.triggers.items()]
        rows += [("table", n, n, ", ".join(f"{c} {t}" for c, t in self._external(n).dtypes)) for n in self.external]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def pragma(self, st: dict) -> DataFrame:
        state, name, arg = self.store.state, st["name"], st.get("arg")
        make = self.spark.createDataFrame
        if name == "table_info":
            t = state.tables.get(arg)
            kinds = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}
            rows = [(i, c.name, kinds[c.type], int(c.not_null), c.default, int(c.key)) for i, c in enumerate(t.columns)] if t else []
            return make(rows, "cid int, name string, type string, `notnull` int, dflt_value string, pk int")
        if name == "index_list":
            return make([(i, n, int(x["unique"])) for i, (n, x) in enumerate(state.tables[arg].indexes.items())], "seq int, name string, `unique` int")
        if name == "foreign_key_list":
            rows = [(i, c.references[0], c.name, c.references[1], c.references[3], c.references[2]) for i, c in enumerate(state.tables[arg].columns) if c.references]
            return make(rows, "id int, `table` string, `from` string, `to` string, on_update string, on_delete string")
        if name == "database_list":
            return make([(i, n) for i, n in enumerate(["main", *self.attached])], "seq int, name string")
        if name in ("integrity_check", "not_null_check"):
            bad = [f"{n}: {m}" for n in state.tables for m in self.violations(n, self.store.rows(n))]
            return make([(x,) for x in bad or ["ok"]], f"{name} string")
        if name == "active_database":
            if wanted := st.get("value") or st.get("arg"):
                if wanted != "main" and wanted not in self.attached:
                    raise DialectError(f"no such database: {wanted}")
                self.active = wanted
            return make([(self.active,)], "active_database string")
        if name == "not_null_repair":
            return make([(n,) for n in self.repair_nulls()], "removed long")
        value, default = st.get("value"), PRAGMAS.get(name)
        if isinstance(default, int):
            if value is not None:
                word = value.lower()
                if word not in SWITCH and not word.lstrip("-").isdigit():
                    raise DialectError(f"PRAGMA {name} takes a number or a switch, not {value}")
                state.pragmas[name] = str(SWITCH.get(word, word))
                self.store.changed()
            return make([(int(SWITCH.get(state.pragmas.get(name, ""), state.pragmas.get(name, default))),)], f"{name} long")
        if value is not None and default is None:  # an unknown one is kept, and changes nothing
            state.pragmas[name] = value
            self.store.changed()
        return make([(state.pragmas.get(name, default),)], f"{name} string")

    def repair_nulls(self) -> list[int]:
        """Delete the rows that break a NOT NULL; the number of them in each table that had any."""
        out = []
        for name, t in self.store.state.tables.items():
            must = [c.name for c in t.columns if c.not_null]
            rows = self.store.rows(name)
            whole = rows.dropna(subset=must) if must else rows
            if must and (gone := rows.count() - whole.count()):
                self.store.put(name, whole, replace=True)
                out.append(gone)
        if out:
            self.store.changed()
        return out

    # -- statements
    def execute(self, sql: str, *args, **named) -> Change:
        st = StatementParser(sql).statement()
        if other := self._elsewhere(st):
            return other.execute(sql, *args, **named)
        params = {i + 1: v for i, v in enumerate(args)} | named
        run = getattr(self, f"_do_{st['kind']}", None)
        if run is None:
            raise DialectError(f"execute() doesn't take {st['kind']}; use query()")
        before = kept = None
        if st["kind"] in ("insert", "update", "delete"):
            if self.store.saved:  # a statement that fails inside a transaction is undone alone
                kept = copy.deepcopy(self.store.state)
            else:
                self.store.begin()
                before = True
        try:
            out = run(st, params) or Change()
            if before:
                self.store.end(keep=True)
        except Exception:
            if before:
                self.store.end(keep=False)
            elif kept is not None:
                self.store.state = kept
            raise
        self.counters["changes"] = out.count
        self.counters["total_changes"] += out.count
        return out

    @contextmanager
    def transaction(self):
        """Everything inside is committed at the end, or undone if it raises."""
        self.store.begin()
        try:
            yield self
        except BaseException:
            self.store.end(keep=False)
            raise
        self.store.end(keep=True)

    def _do_begin(self, st, params):
        self.store.begin()

    def _do_commit(self, st, params):
        self.store.end(keep=True)

    def _do_rollback(self, st, params):
        self.store.end(keep=False)

    def _do_savepoint(self, st, params):
        self.store.savepoint(st["name"])

    def _do_release(self, st, params):
        self.store.release(st["name"])

    def _do_rollback_to(self, st, params):
        self.store.rollback_to(st["name"])

    def _do_vacuum(self, st, params):
        """One part for each table; what earlier statements staged goes, and with it the rows they returned."""
        self.store.compact()
        self.store.fs.delete(self.store.fs_path(f"{self.store.root}/_staged"), True)

    def _do_attach(self, st, params):
        if st["name"] == "main" or st["name"] in self.attached:
            raise DialectError(f"{st['name']} is there already")
        self.attached[st["name"]] = Engine(self.spark, st["path"])

    def _do_detach(self, st, params):
        if self.attached.pop(st["name"], None) is None:
            raise DialectError(f"no such database: {st['name']}")
        if self.active == st["name"]:
            self.active = "main"

    def _do_pragma(self, st, params):
        self.pragma(st)

    # -- definitions
    def _new(self, name: str, missing: bool) -> bool:
        s = self.store.state
        there = name.lower() in {x.lower() for x in (*s.tables, *s.views, *s.reactive, *self.external)}
        if there and not missing:
            raise DialectError(f"{name} exists")
        return not there

    def _do_create_table(self, st, params):
        if self._new(st["name"], st["missing"]):
            self.store.state.tables[st["name"]] = Table([Column(**c) for c in st["columns"]], keys=st["keys"], checks=st["checks"], columnar=st["columnar"])
            if st["columnar"] and any(c.get("generated") for c in st["columns"]):
                del self.store.state.tables[st["name"]]
                raise DialectError("a columnstore table has no generated columns")
            self.store.changed()

    def _do_create_fts(self, st, params):
        if self._new(st["name"], False):
            self.store.state.tables[st["name"]] = Table([Column(c, "text") for c in st["columns"]], fts=True)
            self.store.changed()

    def _do_create_view(self, st, params):
        if self._new(st["name"], st["missing"]):
            sql = st["sql"]
            if st["columns"]:
                own = self._run(sql, self.store.state, {}).columns
                pairs = ", ".join(f'"{a}" AS "{b}"' for a, b in zip(own, st["columns"], strict=True))
                sql = f"SELECT {pairs} FROM ({sql})"
            self._run(sql, self.store.state, {})
            self.store.state.views[st["name"]] = sql
            self.store.changed()

    def _do_create_index(self, st, params):
        t = self.store.state.tables[st["table"]]
        if t.columnar:
            raise DialectError("a columnstore table has no index")
        if st["name"] in t.indexes:
            if st["missing"]:
                return
            raise DialectError(f"{st['name']} exists")
        t.indexes[st["name"]] = {"exprs": st["exprs"], "unique": st["unique"], "where": st["where"]}
        if bad := self.violations(st["table"], self.store.rows(st["table"])):
            del t.indexes[st["name"]]
            raise DialectError(bad[0])
        self.store.changed()

    def _do_create_trigger(self, st, params):
        for sql in st["body"]:
            if StatementParser(sql).statement()["kind"] not in ("insert", "update", "delete"):
                raise DialectError("the body of a trigger is INSERT, UPDATE and DELETE statements")
        if (st["timing"] == "INSTEAD") != (st["table"] in self.store.state.views):
            raise DialectError("INSTEAD OF is for views, BEFORE and AFTER are for tables")
        self.store.state.triggers[st["name"]] = {k: st[k] for k in ("timing", "event", "table", "when", "body")}
        self.store.changed()

    def _do_create_reactive(self, st, params):
        if self._new(st["name"], False):
            ivm.create(self, st["name"], st["sql"], st["mode"])
            self.made += 1
            self.generations[st["name"]] = self.made
            self.store.changed()

    def _do_drop(self, st, params):
        s = self.store.state
        pool = {"table": s.tables, "view": s.views, "trigger": s.triggers, "reactive": s.reactive}.get(st["what"])
        if st["what"] == "index":
            pool = next((t.indexes for t in s.tables.values() if st["name"] in t.indexes), {})
        if st["name"] not in pool:
            if st["missing"]:
                return
            raise DialectError(f"no such {st['what']}: {st['name']}")
        del pool[st["name"]]
        if st["what"] == "reactive":
            s.tables.pop(f"_rv_{st['name']}", None)
            s.views.pop(st["name"], None)
            self.callbacks.pop(st["name"], None)
            self.generations.pop(st["name"], None)
        self.store.changed()

    def _do_alter(self, st, params):
        s, name = self.store.state, st["table"]
        t, rows = s.tables[name], self.store.rows(name)
        if t.columnar:
            raise DialectError("a columnstore table can't be altered")
        if "to" in st:
            self._new(st["to"], False)
            s.tables[st["to"]] = s.tables.pop(name)
        elif "add" in st:
            c = Column(**st["add"])
            value = self._value(c.default, {}) if c.default else F.lit(None)
            if c.not_null and not c.default:
                raise DialectError("a NOT NULL column that is added wants a default")
            t.columns.append(c)
            self.store.put(name, rows.withColumn(c.name, value.cast(SQL_TYPE[c.type])), replace=True)
        elif "drop" in st:
            if any(st["drop"] in k for k in t.keys):
                raise DialectError("a key column can't be dropped")
            t.columns = [c for c in t.columns if c.name != st["drop"]]
            self.store.put(name, rows, replace=True)
        else:
            old, new = st["rename"]
            for c in t.columns:
                c.name = new if c.name == old else c.name
            t.keys = [[new if k == old else k for k in key] for key in t.keys]
            self.store.put(name, rows.withColumnRenamed(old, new), replace=True)
        self.store.changed()

    # -- constraints
    def _types(self, t: Table) -> dict[str, str]:
        return {c.name: c.type for c in t.columns}

    def _value(self, text, params: dict, tables: dict | None = None):
        """A Column from dialect text or syntax."""
        node = Parser(text).expr() if isinstance(text, str) else text
        sql, ty = Translator(lambda n: None, params).expr(node, Scope(tables or {}))
        return F.expr(sql).cast("bigint") if ty == "bool" else F.expr(sql)

    def _test(self, text, t: Table, params: dict, alias: str = "t"):
        node = Parser(text).expr() if isinstance(text, str) else text
        return F.expr(Translator(lambda n: None, params).test(node, Scope({alias: self._types(t)})))

    def _uniques(self, t: Table) -> list[tuple[Column, str]]:
        """For each unique key and index the value that is unique, of a row aliased t, and its name.

        The value is null in rows that are like no other: with a null in the key, or not in a partial index.
        """
        types = {"t": self._types(t)}
        keys = [([F.col(f"t.`{k}`") for k in key], None, ", ".join(key)) for key in t.keys]
        keys += [([self._value(e, {}, types) for e in x["exprs"]], x["where"], ", ".join(x["exprs"])) for x in t.indexes.values() if x["unique"]]
        out = []
        for exprs, where, what in keys:
            fits = F.coalesce(self._test(where, t, {}), F.lit(False)) if where else F.lit(True)
            for e in exprs:
                fits = fits & e.isNotNull()
            value = exprs[0] if len(exprs) == 1 else F.struct(*(e.alias(f"k{i}") for i, e in enumerate(exprs)))
            out.append((F.when(fits, value), what))
        return out

    def violations(self, name: str, rows: DataFrame, rest: DataFrame | None = None) -> list[str]:
        """Broken constraints among ``rows`` of a table, and of keys between them and the ``rest`` of it.

        The rest is only joined with the rows' keys, which Spark broadcasts while they are small.
        """
        t, out = self.store.state.tables[name], []
        rows = rows.alias("t")
        tests = [(F.col(f"t.`{c.name}`").isNull(), f"{c.name} is null") for c in t.columns if c.not_null and not (c.key and c.type == "int" and len(t.keys[0]) == 1)]
        # A CHECK that comes out null holds.
        tests += [(~self._test(x, t, {}), f"CHECK {x}") for x in [*t.checks, *(c.check for c in t.columns if c.check)]]
        if tests:
            broken = rows.agg(*(F.max(F.coalesce(x, F.lit(False))).alias(f"b{i}") for i, (x, _) in enumerate(tests))).first()
            out += [what for b, (_, what) in zip(broken, tests, strict=True) if b]
        for value, what in self._uniques(t):
            keys = rows.select(value.alias("_k")).where("_k IS NOT NULL")
            twice = keys.groupBy("_k").count().where("count > 1").select("_k")
            if rest is not None:
                twice = twice.unionAll(rest.alias("t").select(value.alias("_k")).join(keys, "_k", "left_semi"))
            if not twice.isEmpty():
                out.append(f"UNIQUE {what}")
        if self.store.state.pragmas.get("foreign_keys", "1").lower() not in ("0", "off"):
            for c in t.columns:
                if c.references:
                    parent = self.store.rows(c.references[0])
                    if c.references[0] == name and rest is not None:
                        parent = rest.unionByName(rows.select("t.*"))
                    key = c.references[1] or self.store.state.tables[c.references[0]].keys[0][0]
                    if not rows.where(F.col(f"t.`{c.name}`").isNotNull()).join(parent.alias("p"), F.col(f"t.`{c.name}`") == F.col(f"p.`{key}`"), "left_anti").isEmpty():
                        out.append(f"FOREIGN KEY {c.name}")
        return out

    # -- data changes
    def _incoming(self, st: dict, t: Table, params: dict) -> DataFrame:
        names = st["columns"] or [c.name for c in t.columns if not c.generated]
        if unknown := set(names) - set(t.names()):
            raise DialectError(f"no such column: {sorted(unknown)[0]}")
        tr = Translator(lambda n: None, params)
        if "values" in st:
            if any(len(r) != len(names) for r in st["values"]):
                raise DialectError("the number of values isn't that of the columns")
            typed = [[tr.expr(v, Scope({})) for v in r] for r in st["values"]]
            for row in typed:
                for n, (_, ty) in zip(names, row, strict=True):
                    want = next(c.type for c in t.columns if c.name == n)
                    if ty not in (want, "null", "json") and not (want == "real" and ty == "int"):
                        raise DialectError(f"{n} takes {want}, not {ty}")
            kinds = [SQL_TYPE[next(c.type for c in t.columns if c.name == n)] for n in names]
            rows = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({s} AS {k}) AS `{n}`" for (s, _), k, n in zip(r, kinds, names, strict=True)) for r in typed)
            df = self.spark.sql(rows)
        else:
            df = self._run(st["select"], self.store.state, params)
            if len(df.columns) != len(names):
                raise DialectError("the number of values isn't that of the columns")
            df = df.toDF(*names)
        for c in t.columns:
            if c.name not in names and not c.generated:
                df = df.withColumn(c.name, (self._value(c.default, params) if c.default else F.lit(None)).cast(SQL_TYPE[c.type]))
        return df

    def _finish(self, df: DataFrame, t: Table) -> DataFrame:
        """Generated columns, from the others of the same row."""
        for c in t.columns:
            if c.generated:
                types = {x.name: x.type for x in t.columns if x.name != c.name}
                df = df.drop(c.name).alias("t").withColumn(c.name, self._value(c.generated, {}, {"t": types}).cast(SQL_TYPE[c.type]))
        return df

    def _fixed(self, df: DataFrame) -> DataFrame:
        """The rows as a table of their own, so that row ids and random values stay what they are."""
        path = f"{self.store.root}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _do_insert(self, st, params):
        name = st["table"]
        if name in self.store.state.views:
            t, _ = self._view(name)
            new = self._numbered(self._incoming(st, t, params), 1)
            return self._instead(name, t, "INSERT", self._feed(t, None, new))
        t = self.store.state.tables.get(name)
        if t is None:
            raise DialectError(f"no such table: {name}")
        if t.columnar and st["upsert"]:
            raise DialectError("a columnstore table takes no upsert")
        return self._insert(name, t, self._incoming(st, t, params), st, params)

    def _numbered(self, df: DataFrame, first: int) -> DataFrame:
        """``df`` as a table, with row ids from ``first`` without gaps.

        A place is a partition and a number in it; the counts of the partitions, one
        row for each task, give every partition its first id.
        """
        places = self._fixed(df.withColumn(ROWID, F.monotonically_increasing_id()))
        part, at = F.shiftright(ROWID, 33), F.col(ROWID).bitwiseAND((1 << 33) - 1)
        counts = sorted(places.groupBy(part.alias("part")).count().collect())
        starts, total = [], first
        for p, n in counts:
            starts.append((p, total))
            total += n
        offsets = self.spark.createDataFrame(starts, "_part long, _start long")
        return places.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(ROWID, F.col("_start") + at).drop("_part", "_start")

    def _insert(self, name: str, t: Table, df: DataFrame, st: dict, params: dict) -> Change:
        df = self._numbered(self._finish(df, t), t.next_rowid).withColumn("_place", F.col(ROWID))
        own = next((c.name for c in t.columns if c.key and c.type == "int" and t.keys[:1] == [[c.name]]), None)
        if own:  # an integer key that isn't given is the row id
            df = df.withColumn(own, F.coalesce(F.col(own), F.col(ROWID))).withColumn(ROWID, F.col(own))
        rest, gone = self.store.rows(name), None
        if st["how"] == "IGNORE":
            df = self._first_come(name, t, df.dropna(subset=[c.name for c in t.columns if c.not_null]) if any(c.not_null for c in t.columns) else df)
        elif st["how"] == "REPLACE":
            df, gone = self._last_come(name, t, df)
            rest = rest.join(gone.select(ROWID), ROWID, "left_anti")
        elif st["upsert"]:
            return self._upsert(name, t, df, *st["upsert"], st["returning"], params)
        new_rows = df.select(ROWID, *t.names())
        if bad := self.violations(name, new_rows, rest):
            raise DialectError(bad[0])
        self._fire(name, "BEFORE", "INSERT", self._feed(t, None, new_rows))
        if gone is None or gone.isEmpty():
            self.store.put(name, new_rows)
        else:
            beside, rest = self.store.without(name, gone)
            self.store.put(name, rest.unionByName(new_rows), beside=beside)
        last = df.agg(F.max(ROWID).alias("m"), F.max_by(ROWID, "_place").alias("l"), F.count(F.lit(1)).alias("n")).first()
        count = last.n
        if count:
            t.next_rowid = max(t.next_rowid, last.m + 1)
            self.counters["last_insert_rowid"] = last.l
        displaced = None if gone is None else self._feed(t, gone, None)
        return self._settle(name, t, count, self._feed(t, None, new_rows), st["returning"], new_rows, params, displaced)

    def _keyed(self, t: Table, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """``rows`` with the value of every unique key, in columns of their own."""
        values = {f"_k{i}": v for i, (v, _) in enumerate(self._uniques(t))}
        return rows.alias("t").select("t.*", *(v.alias(k) for k, v in values.items())), list(values)

    def _first_come(self, name: str, t: Table, df: DataFrame) -> DataFrame:
        """Of the rows ``df`` those that OR IGNORE keeps: each that meets no row of the table and none kept before it, by _place.

        With one key these are the first rows of its values. With several, rows
        that are the first of all their keys are kept and what meets them goes,
        until none is left; a round settles the first row of every tie at least.
        """
        df, keys = self._keyed(t, df)
        old, _ = self._keyed(t, self.store.rows(name))
        for k in keys:
            met = old.select(k).join(df.select(k), k, "left_semi")  # few, while the new rows are
            df = df.join(met, k, "left_anti")
        if not keys:
            return df
        left, kept = self._fixed(df), None
        while True:
            ahead = left
            for k in keys:
                first = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("_place").alias(f"{k}_first"))
                ahead = ahead.join(first, k, "left").where(F.coalesce(f"{k}_first", "_place") == F.col("_place")).drop(f"{k}_first")
            ahead = ahead.select(*left.columns)
            if len(keys) == 1:
                return self._fixed(ahead)
            ahead = self._fixed(ahead)
            kept = ahead if kept is None else kept.unionByName(ahead)
            left = left.join(ahead.select("_place"), "_place", "left_anti")
            for k in keys:
                left = left.join(ahead.select(k), k, "left_anti")
            left = self._fixed(left)
            if left.isEmpty():
                return kept

    def _last_come(self, name: str, t: Table, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the rows ``df`` those that OR REPLACE leaves, and the table's rows that go.

        A row goes when a later one, by _place, has one of its keys, even if that one goes itself.
        """
        df, keys = self._keyed(t, df)
        old, _ = self._keyed(t, self.store.rows(name))
        met = None
        left = df
        for k in keys:
            hit = old.join(df.select(k), k, "left_semi").select(ROWID, *t.names())
            met = hit if met is None else met.unionAll(hit)
            last = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.max("_place").alias(f"{k}_last"))
            left = left.join(last, k, "left").where(F.coalesce(f"{k}_last", "_place") == F.col("_place")).drop(f"{k}_last")
        met = old.limit(0).select(ROWID, *t.names()) if met is None else met.dropDuplicates([ROWID])
        return self._fixed(left.select(*df.columns)), self._fixed(met)

    def _upsert(self, name, t, df, keys, sets, returning, params):
        """Rows that meet one by ``keys`` change it, in their order; the others are added.

        Of rows with a new key the first is added and the others change it. The
        changes of a key are folded by TRIGGER_FOLD at a time, so no task holds
        more of them at once. Rows with a null in the key are added.
        """
        known = [{k.lower() for k in key} for key in t.keys]
        known += [{e.strip('"').lower() for e in x["exprs"]} for x in t.indexes.values() if x["unique"] and not x["where"]]
        if {k.lower() for k in keys} not in known:
            raise DialectError("ON CONFLICT names no primary key or unique columns")
        own = self._types(t)
        rest = self.store.rows(name)
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        alone, df = df.where(~whole), df.where(whole)
        chosen = self._fixed(rest.join(df.select(*keys), keys, "left_semi").select(ROWID, *t.names()))
        by_key = Window.partitionBy(*keys).orderBy("_place")
        added = df.join(chosen.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(by_key)).where("_n = 1")
        added = self._fixed(added.select(ROWID, "_place", *t.names()))
        base = chosen.unionByName(added.select(ROWID, *t.names()))
        change = F.struct("_place", *(F.col(f"`{c}`").alias(f"c_{c}") for c in own))
        pairs = df.join(added.select("_place"), "_place", "left_anti").select(*keys, "_place", change.alias("_change"))
        pairs = pairs.withColumn("_round", F.floor((F.row_number().over(by_key) - 1) / TRIGGER_FOLD).cast("int"))
        pairs = self._fixed(pairs.join(base.select(F.col(ROWID).alias("_base"), *keys), keys).select("_base", "_round", "_change"))
        scope = Scope({"_row": own, "_change": {f"c_{c}": ty for c, ty in own.items()}})
        exprs = {c: Translator(lambda n: None, params).expr(_excluded(_renamed(e, name, "_row")), scope)[0] for c, e in sets}
        fields = ", ".join(f"CAST({exprs.get(c, f'`_row`.`{c}`')} AS {SQL_TYPE[ty]}) AS `{c}`" for c, ty in own.items())
        start = ", ".join(f"CAST(`{c}` AS {SQL_TYPE[ty]}) AS `{c}`" for c, ty in own.items())
        new = base
        for n in range((pairs.agg(F.max("_round")).first()[0] or 0) + 1):
            held = pairs.where(F.col("_round") == n).groupBy(F.col("_base").alias(ROWID)).agg(F.sort_array(F.collect_list("_change")).alias("_changes"))
            folded = new.join(held, ROWID, "left").withColumn(
                "_out", F.expr(f"aggregate(coalesce(_changes, array()), struct({start}), (_row, _change) -> struct({fields}))")
            )
            new = self._fixed(folded.select(ROWID, *(F.col(f"_out.`{c}`").alias(c) for c in t.names())))
        updated = new.join(chosen.select(ROWID), ROWID, "left_semi")
        fresh = new.join(chosen.select(ROWID), ROWID, "left_anti").unionByName(alone.select(ROWID, *t.names()))
        touched = self._fixed(self._finish(updated.unionByName(fresh), t).select(ROWID, *t.names()))
        beside, kept = self.store.without(name, chosen)
        if bad := self.violations(name, touched, rest.join(chosen.select(ROWID), ROWID, "left_anti")):
            raise DialectError(bad[0])
        self.store.put(name, kept.unionByName(touched), beside=beside)
        updated = touched.join(chosen.select(ROWID), ROWID, "left_semi")
        fresh = touched.join(chosen.select(ROWID), ROWID, "left_anti")
        t.next_rowid = max(t.next_rowid, (fresh.agg(F.max(ROWID)).first()[0] or 0) + 1)
        feed = self._feed(t, chosen, updated).unionByName(self._feed(t, None, fresh))
        return self._settle(name, t, touched.count(), feed, returning, touched, params)

    def _view(self, name: str) -> tuple[Table, DataFrame]:
        """A view as a table without parts, and its rows with numbers for row ids."""
        df = self._run(self.store.state.views[name], self.store.state, {})
        return Table([Column(c, {"ts": "text", "bool": "int"}.get(ty := spark_type(d), ty)) for c, d in df.dtypes]), df

    def _instead(self, name: str, t: Table, event: str, feed: DataFrame) -> Change:
        if not any((x["table"], x["timing"], x["event"]) == (name, "INSTEAD", event) for x in self.store.state.triggers.values()):
            raise DialectError(f"{name} is a view without an INSTEAD OF {event} trigger")
        feed = self._fixed(feed)
        self._fire(name, "INSTEAD", event, feed, t)
        return Change(feed.count(), None, feed, name)

    def _chosen(self, st, t: Table, params: dict, rows: DataFrame | None = None) -> DataFrame:
        rows = (self.store.rows(st["table"]) if rows is None else rows).alias("t")
        if st["where"] is not None:
            rows = rows.where(self._test(st["where"], t, params))
        if st["limit"] is not None:
            types = {"t": self._types(t)}
            keys = [(self._value(e, params, types).desc_nulls_last() if desc else self._value(e, params, types).asc_nulls_first()) for e, desc, _ in st["order"]]
            rows = rows.orderBy(*keys, F.col(ROWID)).limit(st["limit"])
        return rows.select("t.*")

    def _do_update(self, st, params):
        name = st["table"]
        view = self._view(name) if name in self.store.state.views else None
        t = view[0] if view else self.store.state.tables[name]
        types = self._types(t)
        chosen = self._fixed(self._chosen(st, t, params, self._numbered(view[1], 1) if view else None))
        sets = {c: self._value(e, params, {"t": types}).cast(SQL_TYPE[types[c]]) for c, e in st["set"]}
        new = chosen.alias("t").select(F.col(f"t.{ROWID}").alias(ROWID), *(sets.get(c, F.col(f"t.`{c}`")).alias(c) for c in t.names()))
        if view:
            return self._instead(name, t, "UPDATE", self._feed(t, chosen, new))
        return self._update(name, t, chosen, new, st["returning"], params)

    def _update(self, name: str, t: Table, chosen: DataFrame, new: DataFrame, returning, params: dict) -> Change:
        new = self._fixed(self._finish(new, t).select(ROWID, *t.names()))
        self._fire(name, "BEFORE", "UPDATE", self._feed(t, chosen, new))
        beside, kept = self.store.without(name, chosen)
        if bad := self.violations(name, new, self.store.rows(name).join(chosen.select(ROWID), ROWID, "left_anti")):
            raise DialectError(bad[0])
        self.store.put(name, kept.unionByName(new), beside=beside)
        feed = self._feed(t, chosen, new)
        self._cascade(name, "UPDATE", feed)
        return self._settle(name, t, new.count(), feed, returning, new, params)

    def _do_delete(self, st, params):
        name = st["table"]
        view = self._view(name) if name in self.store.state.views else None
        t = view[0] if view else self.store.state.tables[name]
        chosen = self._fixed(self._chosen(st, t, params, self._numbered(view[1], 1) if view else None))
        if view:
            return self._instead(name, t, "DELETE", self._feed(t, chosen, None))
        return self._delete(name, t, chosen, st["returning"], params)

    def _delete(self, name: str, t: Table, chosen: DataFrame, returning, params: dict) -> Change:
        feed = self._feed(t, chosen, None)
        self._fire(name, "BEFORE", "DELETE", feed)
        beside, kept = self.store.without(name, chosen)
        self.store.put(name, kept, beside=beside)
        self._cascade(name, "DELETE", feed)
        return self._settle(name, t, chosen.count(), feed, returning, chosen, params)

    def _cascade(self, parent: str, event: str, feed: DataFrame) -> None:
        """Follow foreign keys to the children: one join for each key, however many rows."""
        for child, t in list(self.store.state.tables.items()):
            for c in t.columns:
                if not c.references or c.references[0] != parent:
                    continue
                key = c.references[1] or self.store.state.tables[parent].keys[0][0]
                gone = feed.select(F.col(f"old_{key}").alias("_key"), *([F.col(f"new_{key}").alias("_new")] if event == "UPDATE" else []))
                if event == "UPDATE":
                    gone = gone.where(~F.col("_key").eqNullSafe(F.col("_new")))
                gone = self._fixed(gone.where("_key IS NOT NULL").dropDuplicates(["_key"]))
                rows = self.store.rows(child)
                hit = self._fixed(rows.join(gone, F.col(c.name) == F.col("_key")))
                if hit.isEmpty():
                    continue
                rule = c.references[2 if event == "DELETE" else 3]
                beside, kept = self.store.without(child, hit)
                old = hit.select(ROWID, *t.names())
                if rule in ("RESTRICT", "NO ACTION"):
                    raise DialectError(f"FOREIGN KEY {child}.{c.name}")
                if rule == "CASCADE" and event == "DELETE":
                    self.store.put(child, kept, beside=beside)
                    further = self._feed(t, old, None)
                else:
                    value = F.col("_new") if rule == "CASCADE" else self._value(c.default, {}) if rule == "SET DEFAULT" and c.default else F.lit(None)
                    new = self._fixed(hit.withColumn(c.name, value.cast(SQL_TYPE[c.type])).select(ROWID, *t.names()))
                    others = rows.join(hit.select(ROWID), ROWID, "left_anti")
                    self.store.put(child, kept.unionByName(new), beside=beside)
                    if bad := self.violations(child, new, others):
                        raise DialectError(bad[0])
                    further = self._feed(t, old, new)
                self._cascade(child, event, further)

    def _feed(self, t: Table, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
        """_op, _rowid, and old_ and new_ values of every changed row."""
        op = "insert" if old is None else "delete" if new is None else "update"
        sides = []
        for side, df in (("old", old), ("new", new)):
            if df is not None:
                sides.append(df.select(ROWID, *(F.col(f"`{c}`").alias(f"{side}_{c}") for c in t.names())))
        joined = sides[0] if len(sides) == 1 else sides[0].join(sides[1], ROWID)
        for side, df in (("old", old), ("new", new)):
            if df is None:
                joined = joined.withColumns({f"{side}_{c.name}": F.lit(None).cast(SQL_TYPE[c.type]) for c in t.columns})
        return joined.select(F.lit(op).alias("_op"), ROWID, *(f"{s}_{c}" for s in ("old", "new") for c in t.names()))

    def _settle(self, name, t, count, feed, returning, rows, params, displaced: DataFrame | None = None) -> Change:
        """After a change: triggers and hooks, reactive views, returned rows.

        ``displaced`` is the feed of rows that OR REPLACE removed, which no trigger sees.
        """
        event = {"insert": "INSERT", "update": "UPDATE", "delete": "DELETE"}
        for op in ("insert", "update", "delete"):
            self._fire(name, "AFTER", event[op], feed.where(F.col("_op") == op))
        feed = feed if displaced is None else displaced.unionByName(feed)
        ivm.flush(self, name, feed)
        returned = None
        if returning:
            view = Translator(lambda n: self._types(t), params)
            changed = f"{self.prefix}changed"
            rows.drop(ROWID).createOrReplaceTempView(changed)
            returned = self.spark.sql(view.query(Select(returning, ("table", changed, name)), None)[0])
            self.spark.catalog.dropTempView(changed)
        return Change(count, returned, feed, name)

    def hook(self, table: str, timing: str, event: str, f: Callable[[DataFrame], None]) -> None:
        """``f`` gets the change feed of each statement on the table; a BEFORE hook may raise to refuse it."""
        self.hooks.append((table, timing.upper(), event.upper(), f))

    def _fire(self, table: str, timing: str, event: str, feed: DataFrame, t: Table | None = None) -> None:
        hooks = [f for n, w, e, f in self.hooks if (n, w, e) == (table, timing, event)]
        again = SWITCH.get(self.store.state.pragmas.get("recursive_triggers", "0"), self.store.state.pragmas.get("recursive_triggers", "0")) in (1, "1")
        triggers = [
            (n, x) for n, x in self.store.state.triggers.items()
            if (x["table"], x["timing"], x["event"]) == (table, timing, event) and (again or n not in self.firing)
        ]
        if not hooks and not triggers or feed.isEmpty():
            return
        for f in hooks:
            f(feed)
        t = t or self.store.state.tables[table]
        types = self._types(t)
        last = self.counters["last_insert_rowid"]
        for name, x in triggers:
            if len(self.firing) >= TRIGGER_DEPTH:
                raise DialectError(f"triggers are nested more than {TRIGGER_DEPTH} deep")
            sided = feed.select(F.col(ROWID).alias("_seq"), *(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in t.names())).alias(s) for s in ("old", "new")))
            if x["when"]:
                sided = sided.where(F.expr(Translator(lambda n: None).test(Parser(x["when"]).expr(), Scope({"old": types, "new": types}))))
            sided = self._fixed(sided)
            if sided.isEmpty():
                continue
            self.firing.append(name)
            try:
                for sql in x["body"]:
                    st = StatementParser(sql).statement()
                    getattr(self, f"_trigger_{st['kind']}")(st, sided, types)
            finally:
                self.firing.pop()
                self.counters["last_insert_rowid"] = last

    def _target(self, name: str) -> Table:
        if name not in self.store.state.tables:
            raise DialectError(f"no such table: {name}")
        return self.store.state.tables[name]

    def _trigger_insert(self, st: dict, sided: DataFrame, types: dict) -> None:
        """One INSERT for all changed rows; a SELECT is joined with them laterally."""
        target = self._target(st["table"])
        columns = st["columns"] or [c.name for c in target.columns if not c.generated]
        kinds = {c.name: SQL_TYPE[c.type] for c in target.columns}
        if "values" in st:
            frames = [
                sided.select(*(self._value(v, {}, {"old": types, "new": types}).cast(kinds[n]).alias(n) for n, v in zip(columns, row, strict=True)))
                for row in st["values"]
            ]
        else:
            frames = [self._run(st["select"], self.store.state, {}, (sided, {"old": types, "new": types})).toDF(*columns)]
        for df in frames:
            for c in target.columns:
                if c.name not in columns and not c.generated:
                    df = df.withColumn(c.name, (self._value(c.default, {}) if c.default else F.lit(None)).cast(kinds[c.name]))
            self._insert(st["table"], target, df, st | {"returning": None}, {})

    def _trigger_delete(self, st: dict, sided: DataFrame, types: dict) -> None:
        name, t = st["table"], self._target(st["table"])
        rows = self.store.rows(name).alias("t")
        chosen = rows.join(sided, self._met(st, t, types), "left_semi").select("t.*")
        self._delete(name, t, self._fixed(chosen), None, {})

    def _met(self, st: dict, t: Table, types: dict) -> Column:
        """Whether a row of a trigger's target goes with a changed row."""
        if st["limit"] is not None:
            raise DialectError("a trigger's UPDATE or DELETE has no LIMIT")
        if st["where"] is None:
            return F.lit(True)
        scope = Scope({"t": self._types(t), "old": types, "new": types})
        return F.expr(Translator(lambda n: None).test(_renamed(st["where"], st["table"], "t"), scope))

    def _trigger_update(self, st: dict, sided: DataFrame, types: dict) -> None:
        """UPDATE by all changed rows, in their order where several go with one row.

        Which rows go together is settled first. Each row's changes are then folded
        by TRIGGER_FOLD at a time, so no task holds more of them at once.
        """
        name, t = st["table"], self._target(st["table"])
        own = self._types(t)
        pairs = self.store.rows(name).alias("t").join(sided, self._met(st, t, types)).select(F.col(f"t.{ROWID}").alias(ROWID), "_seq", "old", "new")
        place = F.row_number().over(Window.partitionBy(ROWID).orderBy("_seq")) - 1
        pairs = self._fixed(pairs.withColumn("_round", F.floor(place / TRIGGER_FOLD).cast("int")))
        rounds = pairs.agg(F.max("_round")).first()[0]
        if rounds is None:
            return
        chosen = self._fixed(self.store.rows(name).join(pairs.select(ROWID).distinct(), ROWID, "left_semi"))
        sided_types = {f"{s}_{c}": ty for s in ("old", "new") for c, ty in types.items()}
        scope = Scope({"_row": own, "_change": sided_types})
        sets = {c: Translator(lambda n: None).expr(_flat(_renamed(e, name, "_row")), scope)[0] for c, e in st["set"]}
        fields = ", ".join(f"CAST({sets.get(c, f'`_row`.`{c}`')} AS {SQL_TYPE[ty]}) AS `{c}`" for c, ty in own.items())
        flat = F.struct("_seq", *(F.col(f"{s}.`{c}`").alias(f"{s}_{c}") for s in ("old", "new") for c in types))
        start = ", ".join(f"CAST(`{c}` AS {SQL_TYPE[ty]}) AS `{c}`" for c, ty in own.items())
        new = chosen
        for n in range(rounds + 1):
            held = pairs.where(F.col("_round") == n).groupBy(ROWID).agg(F.sort_array(F.collect_list(flat)).alias("_changes"))
            folded = new.join(held, ROWID, "left").withColumn(
                "_out", F.expr(f"aggregate(coalesce(_changes, array()), struct({start}), (_row, _change) -> struct({fields}))")
            )
            new = self._fixed(folded.select(ROWID, *(F.col(f"_out.`{c}`").alias(c) for c in t.names())))
        self._update(name, t, chosen, new, None, {})

    # -- sinks
    def dump(self, schema_only: bool = False, data_only: bool = False) -> Iterator[str]:
        """Statements that make the database again, rows pulled one partition at a time; indexes, views and triggers follow the rows."""
        name = lambda n: '"' + n.replace('"', '""') + '"'

        def literal(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, (bytes, bytearray)):
                return f"X'{bytes(v).hex().upper()}'"
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

        state = self.store.state
        tables = {n: t for n, t in state.tables.items() if not (n.startswith("_rv_") and n[4:] in state.reactive)}
        for n in self._parents_first(tables):
            t = tables[n]
            if not data_only:
                yield self._definition(n, t)
            if not schema_only:
                own = [c.name for c in t.columns if not c.generated]
                into = name(n) + (f" ({', '.join(map(name, own))})" if len(own) < len(t.columns) else "")
                for row in self.store.rows(n).orderBy(ROWID).select(*(F.col(f"`{c}`") for c in own)).toLocalIterator():
                    yield f"INSERT INTO {into} VALUES ({', '.join(map(literal, row))});"
        if data_only:
            return
        for n, t in tables.items():
            for i, x in t.indexes.items():
                yield f"CREATE {'UNIQUE ' * x['unique']}INDEX {name(i)} ON {name(n)} ({', '.join(x['exprs'])})" + (f" WHERE {x['where']}" if x["where"] else "") + ";"
        for n, sql in state.views.items():
            if n not in state.reactive:
                yield f"CREATE VIEW {name(n)} AS {sql};"
        for n, x in state.reactive.items():
            yield f"CREATE REACTIVE VIEW {name(n)} AS {x['sql']} REFRESH {x['mode']};"
        for n, x in state.triggers.items():
            timing = "INSTEAD OF" if x["timing"] == "INSTEAD" else x["timing"]
            when = f"WHEN {x['when']} " if x["when"] else ""
            yield f"CREATE TRIGGER {name(n)} {timing} {x['event']} ON {name(x['table'])} {when}BEGIN {' '.join(f'{b};' for b in x['body'])} END;"

    def _parents_first(self, tables: dict[str, Table]) -> list[str]:
        """Names of tables, each after those that its foreign keys name; a cycle is cut where it is met."""
        out: dict[str, None] = {}

        def visit(n: str, above: tuple[str, ...]) -> None:
            for c in tables[n].columns:
                if c.references and c.references[0] in tables and c.references[0] not in (*above, n):
                    visit(c.references[0], (*above, n))
            out.setdefault(n)

        for n in tables:
            visit(n, ())
        return list(out)

    def _definition(self, n: str, t: Table) -> str:
        name = lambda x: '"' + x.replace('"', '""') + '"'
        if t.fts:
            return f"CREATE VIRTUAL TABLE {name(n)} USING fts5({', '.join(map(name, t.names()))});"
        kinds = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}
        parts, keys = [], list(t.keys)
        for c in t.columns:
            part = f"{name(c.name)} {kinds[c.type]}"
            if c.auto:
                part += " PRIMARY KEY AUTOINCREMENT"
                keys.remove([c.name])
            else:
                part += " NOT NULL" * c.not_null
            part += (f" DEFAULT {c.default}" if c.default else "") + (f" CHECK ({c.check})" if c.check else "")
            part += f" GENERATED ALWAYS AS ({c.generated})" if c.generated else ""
            if c.references:
                table, column, delete, update = c.references
                part += f" REFERENCES {name(table)}" + (f" ({name(column)})" if column else "") + f" ON DELETE {delete} ON UPDATE {update}"
            parts.append(part)
        primary = any(c.key and not c.auto for c in t.columns)
        parts += [("PRIMARY KEY (" if i == 0 and primary else "UNIQUE (") + ", ".join(map(name, k)) + ")" for i, k in enumerate(keys)]
        parts += [f"CHECK ({x})" for x in t.checks]
        return f"CREATE TABLE {name(n)} ({', '.join(parts)})" + " USING COLUMNSTORE" * t.columnar + ";"


def _excluded(node):
    """Syntax in which excluded.x is the column c_x of _change, and a bare column is that of _row."""
    if isinstance(node, tuple) and node[:1] == ("col",):
        if node[1] and node[1].lower() == "excluded":
            return ("col", "_change", f"c_{node[2]}")
        return ("col", node[1] or "_row", node[2])
    if isinstance(node, (tuple, list)):
        return type(node)(_excluded(x) for x in node)
    return node


def _flat(node):
    """Syntax in which OLD.x and NEW.x are the columns old_x and new_x of _change."""
    if isinstance(node, tuple) and node[:1] == ("col",) and node[1] and node[1].lower() in ("old", "new"):
        return ("col", "_change", f"{node[1].lower()}_{node[2]}")
    if isinstance(node, (tuple, list)):
        return type(node)(_flat(x) for x in node)
    return node


def _renamed(node, old: str, new: str):
    """Syntax with columns of the table ``old`` named by the alias ``new``."""
    if isinstance(node, tuple) and node[:1] == ("col",) and node[1] and node[1].lower() == old.lower():
        return ("col", new, node[2])
    if isinstance(node, (tuple, list)):
        return type(node)(_renamed(x, old, new) for x in node)
    return node


class Views(Translator):
    """A translator whose tables stand for temporary views."""

    def __init__(self, lookup, params: dict, views: dict[str, str]):
        super().__init__(lookup, params)
        self.views = views

    def source(self, s, outer, tables):
        if s[0] == "table" and s[1].lower() not in self.ctes:
            columns = self.lookup(s[1])
            if columns is None:
                raise DialectError(f"no such table: {s[1]}")
            tables[s[2]] = columns
            return f"`{self.views[s[1].lower()]}` AS `{s[2]}`"
        return super().source(s, outer, tables)


def open_tables(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    """An engine over the Parquet tables of a folder."""
    from .sources.tables import TABLES, table

    engine = Engine(spark, root)
    for name in TABLES:
        engine.register(name, lambda name=name: table(spark, sf_dir, name))
    return engine
