"""Versioned tables: immutable Parquet parts, and a commit log that names the parts of every version.

A commit is one small JSON file, written beside its place and renamed into it, so
a reader sees a version whole or not at all, and of two writers one fails. Any
earlier version can be read as of a commit number or a time. Appends add a part;
updates and deletes write what is left of the parts they touch as a new part. Only
part names and schemas pass through the driver.
"""

from __future__ import annotations

import bisect
import copy
import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import SQL_TYPE, DialectError
from ..operators import fts

ROWID = "_rowid"
#: Rows of a full-text table's index.
TERMS = f"term STRING, {ROWID} BIGINT, len INT, places ARRAY<INT>"


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    key: bool = False
    unique: bool = False
    default: str | None = None
    check: str | None = None
    generated: str | None = None
    references: list | None = None  # [table, column, on delete, on update]
    auto: bool = False


@dataclass
class Table:
    columns: list[Column]
    parts: list[str] = field(default_factory=list)
    next_rowid: int = 1
    keys: list[list[str]] = field(default_factory=list)  # unique column sets, the primary key first
    checks: list[str] = field(default_factory=list)
    fts: bool = False
    words: dict[str, list[int]] = field(default_factory=dict)  # of each part of a full-text table: documents, and words in all
    columnar: bool = False
    indexes: dict[str, dict] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def schema(self) -> str:
        return ", ".join([f"{ROWID} BIGINT", *(f"`{c.name}` {SQL_TYPE[c.type]}" for c in self.columns)])


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, dict] = field(default_factory=dict)
    reactive: dict[str, dict] = field(default_factory=dict)
    pragmas: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(raw: dict) -> State:
        tables = {k: Table(**(v | {"columns": [Column(**c) for c in v["columns"]]})) for k, v in raw["tables"].items()}
        return State(tables, raw["views"], raw["triggers"], raw["reactive"], raw["pragmas"])


class Store:
    """One database. ``clock`` gives seconds; it can be set for tests."""

    def __init__(self, spark: SparkSession, root: str, clock=time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.log = self._load()  # commit files, in order
        self.state = State.of(self.entry(len(self.log))["state"]) if self.log else State()
        self.saved: list[tuple[str | None, State]] = []  # the transaction (None) and its savepoints

    # -- the log
    def _load(self) -> list[str]:
        at = self.fs_path(f"{self.root}/_commits")
        if not self.fs.exists(at):
            return []
        names = sorted(str(s.getPath()) for s in self.fs.listStatus(at))
        return [n for n in names if re.search(r"/\d{12}\.json$", n)]  # not what a writer left that was killed

    def entry(self, txn: int) -> dict:
        """A commit: txn, ts and state."""
        return json.loads(self._read(self.log[txn - 1]))

    def _read(self, path: str) -> str:
        stream = self.fs.open(self.fs_path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self) -> int:
        """Write the state as the next version and return its number."""
        entry = {"txn": len(self.log) + 1, "ts": self.clock(), "state": asdict(self.state)}
        target = f"{self.root}/_commits/{entry['txn']:012d}.json"
        beside = f"{self.root}/_commits/_{uuid.uuid4().hex}"
        stream = self.fs.create(self.fs_path(beside), False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # fails if another writer was first
            files.rename(self.fs_path(beside), self.fs_path(target), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception:
            self.fs.delete(self.fs_path(beside), False)
            raise
        self.log.append(target)
        return entry["txn"]

    def changed(self) -> None:
        """Commit now unless a transaction is open."""
        if not self.saved:
            self.commit()

    def as_of(self, txn: int | None = None, ts: float | None = None) -> State:
        """The state of the last commit at or before a number or a time."""
        last = len(self.log) if txn is None else min(txn, len(self.log))
        if ts is not None:  # times don't fall from commit to commit
            last = bisect.bisect_right(range(1, last + 1), ts, key=lambda n: self.entry(n)["ts"])
        if last < 1:
            raise DialectError("there is no commit that early")
        return State.of(self.entry(last)["state"])

    # -- transactions
    def begin(self) -> None:
        if self.saved:
            raise DialectError("a transaction is open")
        self.saved.append((None, copy.deepcopy(self.state)))

    def end(self, keep: bool) -> None:
        if not self.saved:
            raise DialectError("no transaction is open")
        first = self.saved[0][1]
        self.saved.clear()
        if keep:
            self.commit()
        else:
            self.state = first

    def savepoint(self, name: str) -> None:
        self.saved.append((name, copy.deepcopy(self.state)))

    def _place(self, name: str) -> int:
        for i in range(len(self.saved) - 1, -1, -1):
            if self.saved[i][0] == name:
                return i
        raise DialectError(f"no such savepoint: {name}")

    def release(self, name: str) -> None:
        del self.saved[self._place(name):]
        if not self.saved:
            self.commit()

    def rollback_to(self, name: str) -> None:
        i = self._place(name)
        self.state = copy.deepcopy(self.saved[i][1])
        del self.saved[i + 1:]

    # -- data
    def rows(self, name: str, state: State | None = None) -> DataFrame:
        """All columns and the row ids of a table."""
        t = (state or self.state).tables[name]
        if not t.parts:
            return self.spark.createDataFrame([], t.schema())
        return self.spark.read.schema(t.schema()).parquet(*t.parts)

    def without(self, name: str, ids: DataFrame) -> tuple[list[str], DataFrame]:
        """The parts that hold none of the row ids, and of the others the rows that aren't among them."""
        t = self.state.tables[name]
        ids = ids.select(ROWID)
        untouched: list[str] = []
        if len(t.parts) > 1:
            place = self.rows(name).select(ROWID, F.input_file_name().alias("_file")).join(ids, ROWID, "left_semi")
            folders = place.select(F.element_at(F.split("_file", "/"), -2).alias("f")).distinct().collect()
            hit = {r.f for r in folders}
            untouched = [p for p in t.parts if p.rsplit("/", 1)[1] not in hit]
        touched = [p for p in t.parts if p not in untouched]
        rows = self.spark.read.schema(t.schema()).parquet(*touched) if touched else self.spark.createDataFrame([], t.schema())
        return untouched, rows.join(ids, ROWID, "left_anti")

    def put(self, name: str, rows: DataFrame, replace: bool = False, beside: list[str] | None = None) -> None:
        """Add a part, or make it the only one or the one beside some others. Fewer, larger parts come from ``compact``."""
        t = self.state.tables[name]
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.select(ROWID, *(F.col(f"`{c.name}`").cast(SQL_TYPE[c.type]).alias(c.name) for c in t.columns)).write.parquet(path)
        t.parts = [*beside, path] if beside is not None else [path] if replace else [*t.parts, path]
        if t.fts:
            t.words = {p: t.words[p] for p in t.parts if p in t.words} | {path: self._index(path, t)}

    def _index(self, path: str, t: Table) -> list[int]:
        """Write a full-text part's postings; its documents, and their words in all."""
        rows = self.spark.read.schema(t.schema()).parquet(path)
        fts.index(rows, ROWID, t.names()).write.parquet(f"{path}_terms")
        made = self.spark.read.schema(TERMS).parquet(f"{path}_terms")
        n = made.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("n")).first().n
        return [rows.count(), n]

    def terms(self, name: str) -> DataFrame:
        """The postings of a full-text table."""
        t = self.state.tables[name]
        if not t.parts:
            return self.spark.createDataFrame([], TERMS)
        return self.spark.read.schema(TERMS).parquet(*(f"{p}_terms" for p in t.parts))

    def words(self, name: str) -> tuple[int, int]:
        """The number of a full-text table's documents, and of all their words."""
        held = self.state.tables[name].words.values()
        return sum(d for d, _ in held), sum(w for _, w in held)

    def compact(self) -> None:
        """Rewrite every table of several parts as one, clustered by row id."""
        for name, t in self.state.tables.items():
            if len(t.parts) > 1:
                self.put(name, self.rows(name).repartitionByRange(F.col(ROWID)).sortWithinPartitions(ROWID), replace=True)
        self.changed()
