"""Incremental maintenance: weighted tables, delta rules, reactive views, and their streaming form.

A weighted table has a column ``_w``: how often a row is there. Changes are
weighted tables too, so a view is kept by adding the change of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DialectError
from ..plans.syntax import Compound, Parser, Select
from ..plans.translate import spark_type

W = "_w"


# -- weighted tables
def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return consolidate(df.withColumn(W, F.lit(weight).cast("long")))


def consolidate(z: DataFrame) -> DataFrame:
    """One row per value, without those of weight zero."""
    keys = [f"`{c}`" for c in z.columns if c != W]
    return z.groupBy(*keys).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(a.unionByName(b))


def scale(z: DataFrame, n: int) -> DataFrame:
    return z.withColumn(W, F.col(W) * n).where(F.col(W) != 0)


def negate(z: DataFrame) -> DataFrame:
    return scale(z, -1)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, negate(b))


def mapped(z: DataFrame, *columns: Column) -> DataFrame:
    return consolidate(z.select(*columns, W))


def filtered(z: DataFrame, test: Column | str) -> DataFrame:
    return z.where(test)


def distinct(z: DataFrame) -> DataFrame:
    """Rows of positive weight, once each."""
    return z.where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def weight(z: DataFrame, test: Column) -> int:
    return z.where(test).agg(F.sum(W)).first()[0] or 0


# -- delta rules
def lift(feed: DataFrame, columns: list[str]) -> DataFrame:
    """A change feed as weights: an insert is +1, a delete -1, an update both."""
    old = feed.where("_op IN ('delete', 'update')").select(*(F.col(f"old_{c}").alias(c) for c in columns), F.lit(-1).cast("long").alias(W))
    new = feed.where("_op IN ('insert', 'update')").select(*(F.col(f"new_{c}").alias(c) for c in columns), F.lit(1).cast("long").alias(W))
    return consolidate(old.unionByName(new))


def step_aggregate(state: DataFrame, delta: DataFrame, group: str, measure: str | None) -> DataFrame:
    """New state (group, _n, _s, _m) of COUNT(*) and SUM(measure); _m counts the measures that aren't null.

    A group stays while any of its numbers isn't zero, so one that nets to no
    rows but holds a sum is not lost.
    """
    value = F.col(measure) if measure else F.lit(0).cast("long")
    change = delta.select(F.col(group), F.col(W).alias("_n"), F.coalesce(value * F.col(W), F.lit(0)).alias("_s"), F.when(value.isNotNull(), F.col(W)).otherwise(0).cast("long").alias("_m"))
    both = state.select(group, "_n", "_s", "_m").unionByName(change)
    return both.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("_n", "_s", "_m"))).where("_n <> 0 OR _s <> 0 OR _m <> 0")


def step_join(left: DataFrame, right: DataFrame, d_left: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """The change of an equi-join: dL*R + L*dR + dL*dR, with L and R as they were before."""
    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumnRenamed(W, "_wa").join(b.withColumnRenamed(W, "_wb"), on).withColumn(W, F.col("_wa") * F.col("_wb")).drop("_wa", "_wb")

    return consolidate(product(d_left, right).unionByName(product(left, d_right)).unionByName(product(d_left, d_right)))


# -- reactive views
def delta_class(q) -> tuple[str, str, str | None, str, str] | None:
    """(table, group, measure or None, output names) for SELECT g, COUNT(*) | SUM(c) FROM t GROUP BY g, and for nothing else."""
    if not isinstance(q, Select) or len(q.items) != 2 or len(q.group) != 1 or q.where or q.having or q.order or q.distinct or q.limit is not None:
        return None
    if not q.source or q.source[0] != "table" or q.items[0][0][0] != "col" or q.items[0][0][2] != q.group[0][2]:
        return None
    (key, key_name), (f, f_name) = q.items
    if f[0] != "fn" or f[3] or f[5] is not None:
        return None
    if f[1] == "COUNT" and f[4]:
        return q.source[1], key[2], None, key_name or key[2], f_name or "_c1"
    if f[1] == "SUM" and f[2][0][0] == "col":
        return q.source[1], key[2], f[2][0][2], key_name or key[2], f_name or "_c1"
    return None


def _sources(s, out: set[str]) -> set[str]:
    if s and s[0] == "table":
        out.add(s[1])
    elif s and s[0] == "join":
        _sources(s[2], out)
        _sources(s[3], out)
    elif s and s[0] == "derived":
        raise DialectError("a reactive view has no derived table")
    return out


def create(engine, name: str, sql: str, mode: str | None) -> None:
    from ..sources.store import Column as Stored
    from ..sources.store import Table

    q = Parser(sql).query()
    if isinstance(q, Compound) or not isinstance(q, Select):
        raise DialectError("a reactive view is a plain SELECT")
    if any(node == ("star",) for node, _ in q.items):
        raise DialectError("a reactive view names its columns")
    state, found = engine.store.state, delta_class(q)
    if mode == "DELTA" and not found:
        raise DialectError("this view can't be kept by deltas")
    tables = sorted(_sources(q.source, set()))
    if found and mode != "FULL":
        table, group, measure, key_name, out_name = found
        base = state.tables[table]
        kinds = {c.name: c.type for c in base.columns}
        kind = kinds[measure] if measure else "int"
        state.tables[f"_rv_{name}"] = Table([Stored(group, kinds[group]), Stored("_n", "int"), Stored("_s", kind), Stored("_m", "int")])
        result = "_n" if measure is None else "CASE WHEN _m <> 0 THEN _s END"
        state.views[name] = f'SELECT {group} AS "{key_name}", {result} AS "{out_name}" FROM _rv_{name} WHERE _n <> 0'
        state.reactive[name] = {"mode": "DELTA", "sql": sql, "tables": tables, "group": group, "measure": measure}
        whole = weighted(engine.store.rows(table).drop("_rowid"))
        _store(engine, name, step_aggregate(engine.store.rows(f"_rv_{name}"), whole, group, measure))
    else:
        df = engine._run(sql, state, {})
        state.tables[f"_rv_{name}"] = Table([Stored(c, spark_type(t)) for c, t in df.dtypes])
        names = ", ".join(f'"{c}"' for c in df.columns)
        state.views[name] = f"SELECT {names} FROM _rv_{name}"
        state.reactive[name] = {"mode": "FULL", "sql": sql, "tables": tables}
        _store(engine, name, df)


def _store(engine, name: str, rows: DataFrame) -> None:
    engine.store.put(f"_rv_{name}", engine._fixed(rows.withColumn("_rowid", F.monotonically_increasing_id())), replace=True)


def generation(engine, view: str) -> int:
    """A number that tells this handle's incarnations of a view's name apart; 0 for one that was there when it was opened."""
    if view not in engine.store.state.reactive:
        raise DialectError(f"no such reactive view: {view}")
    return engine.generations.get(view, 0)


def on_change(engine, view: str, f: Callable[[DataFrame], None], expected: int | None = None) -> Callable[[], str]:
    """Call ``f`` with each weighted change of the view's rows; the function returned ends that.

    With ``expected`` it fails if the view was made anew since. The function
    returned says what it met: ``removed``, ``not registered``, ``stale
    generation`` (another view has the name now) or ``unknown view``. Who is
    called is settled when a statement's changes begin to be told.
    """
    made = generation(engine, view)
    if expected is not None and expected != made:
        raise DialectError(f"{view} is of generation {made}")
    held = lambda z: f(z)  # noqa: E731  # the same function may be registered twice
    engine.callbacks.setdefault(view, []).append(held)

    def end() -> str:
        if view not in engine.store.state.reactive:
            return "unknown view"
        if generation(engine, view) != made:
            return "stale generation"
        if held not in engine.callbacks.get(view, []):
            return "not registered"
        engine.callbacks[view].remove(held)
        return "removed"

    return end


def flush(engine, table: str, feed: DataFrame) -> None:
    """Bring the reactive views on ``table`` up to date after a statement."""
    for name, x in engine.store.state.reactive.items():
        if table not in x["tables"]:
            continue
        listeners = list(engine.callbacks.get(name, []))
        before = engine._fixed(engine._run(f"SELECT * FROM {name}", engine.store.state, {})) if listeners else None
        if x["mode"] == "DELTA":
            columns = list(dict.fromkeys(c for c in (x["group"], x["measure"]) if c))
            _store(engine, name, step_aggregate(engine.store.rows(f"_rv_{name}"), lift(feed, columns), x["group"], x["measure"]))
        else:
            _store(engine, name, engine._run(x["sql"], engine.store.state, {}))
        if listeners:
            after = engine._run(f"SELECT * FROM {name}", engine.store.state, {})
            change = subtract(weighted(after), weighted(before))
            for f in listeners:
                f(change)


# -- streaming
def stream_aggregate(stream: DataFrame, group: str, measure: str, path: str, checkpoint: str):
    """Keep COUNT and SUM per group of a stream of weighted rows in versioned folders under ``path``.

    Each batch merges its change with the last version and writes the next, named
    after the batch, so a batch that runs again overwrites its own version.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        kind = dict(batch.dtypes)
        schema = f"{group} {kind[group]}, _n long, _s {kind[measure]}, _m long"
        state = spark.read.schema(schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], schema)
        step_aggregate(state, consolidate(batch.select(group, measure, W)), group, measure).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per tumbling event-time window, with a watermark. An extension: the dialect has no event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


