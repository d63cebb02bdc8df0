"""What a plan's operators did: rows and time from Spark's own metrics, after the plan has run once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Nodes that stand for the plan inside them.
WRAPPERS = {"WholeStageCodegenExec", "InputAdapter", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec", "AdaptiveSparkPlanExec"}
#: Nodes that give every row they get, and don't count them.
THROUGH = {"ProjectExec", "SortExec", "ShuffleExchangeExec", "AQEShuffleReadExec", "ColumnarToRowExec", "WindowExec", "CoalesceExec", "UnionExec"}
#: A scan of a full-text table's index.
POSTINGS = re.compile(r"\[term#\d+,_rowid#\d+L,len#")


@dataclass
class Operator:
    """One node; ``parent`` is the id of the one it feeds, -1 at the root."""

    id: int
    parent: int
    kind: str
    detail: str
    rows: int | None = None
    ms: float | None = None
    leaf: bool = False


@dataclass
class Stats:
    """Rows that scans read, rows given, postings read, and whether a scan was narrowed by filters or postings."""

    rows_examined: int = 0
    rows_returned: int = 0
    index_entries: int = 0
    used_index: bool = False


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _metrics(node) -> tuple[int | None, float]:
    """Rows given, if they are counted, and milliseconds."""
    rows, ms, it = None, 0.0, node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metric = pair._2()
        if pair._1() == "numOutputRows":
            rows = max(0, metric.value())
        elif metric.metricType() == "timing":
            ms += max(0, metric.value())
        elif metric.metricType() == "nsTiming":
            ms += max(0, metric.value()) / 1e6
    return rows, ms


def operators(df: DataFrame, run: bool) -> list[Operator]:
    """The operators of a query's plan, each after the one it feeds; with ``run`` the query is run, once, and they have figures.

    A sort over several partitions samples its input first, so what stands below it counts those rows twice.
    """
    execution = df._jdf.queryExecution()
    count = execution.toRdd().count() if run else None
    out: list[Operator] = []

    def walk(node, parent: int, spent: float) -> int | None:
        kind = node.getClass().getSimpleName()
        if kind in WRAPPERS:
            inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("StageExec") else node.child()
            return walk(inner, parent, spent + (_metrics(node)[1] if run and kind == "WholeStageCodegenExec" else 0))
        me = Operator(len(out), parent, kind, node.simpleString(25))
        out.append(me)
        children = _items(node.children())
        me.leaf = not children
        rows, ms = _metrics(node) if run else (None, 0.0)
        below = [walk(c, me.id, 0.0) for c in children]
        if rows is None and kind in THROUGH and below and None not in below:
            rows = sum(below)
        if run:
            me.rows, me.ms = rows, round(spent + ms, 3)
        return rows

    walk(execution.executedPlan(), -1, 0.0)
    if run:
        out[0].rows = count
    return out


def stats(df: DataFrame) -> Stats:
    """Run a query once and say what it cost."""
    nodes = operators(df, run=True)
    scans = [n for n in nodes if n.leaf and n.kind != "ReusedExchangeExec"]
    postings = [n for n in scans if POSTINGS.search(n.detail)]
    narrowed = any("PushedFilters: [" in n.detail and "PushedFilters: []" not in n.detail for n in scans)
    return Stats(sum(n.rows or 0 for n in scans), nodes[0].rows or 0, sum(n.rows or 0 for n in postings), bool(postings) or narrowed)
