"""Recursive queries as a driver loop over written frontiers, for UNION (distinct), which Spark's own form lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Keep = Callable[[DataFrame], DataFrame]


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], keep: Keep, rounds: int = 1000) -> DataFrame:
    """All rows reachable from ``base``; each round sees the rows that were new in the last.

    ``keep`` writes a DataFrame and reads it again, which cuts its lineage. The
    loop ends when a round brings nothing new.
    """
    frontier = found = keep(base.distinct())
    for _ in range(rounds):
        frontier = keep(step(frontier).distinct().subtract(found))
        if frontier.isEmpty():
            return found
        found = keep(found.unionAll(frontier))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
