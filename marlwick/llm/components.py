"""Connected components by minimum labels and pointer jumping.

Each round takes the least label among a node's neighbours, then the label of
that label; the number of rounds grows with the logarithm of a component's
diameter. Every round is a written table, and both joins split hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node of its component."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both.withColumnRenamed("b", "node"), "edges")
    degrees = written(both.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "degrees")
    labels = degrees.select("node", F.col("node").alias("root"), "n")
    while True:
        near = attach(both, labels, ["node"], "n", ["a"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = written(
            labels.join(near.withColumnRenamed("a", "node"), "node").select(
                "node", "n", F.col("root").alias("old"), F.least("root", "near").alias("root")
            ),
            "labels",
        )
        if hooked.where("root <> old").isEmpty():
            return hooked.select("node", "root")
        heads = hooked.groupBy("root").agg(F.count(F.lit(1)).alias("held")).join(
            hooked.select(F.col("node").alias("root"), F.col("root").alias("further")), "root"
        )
        jumped = attach(hooked.select("node", "root", "n"), written(heads, "heads"), ["root"], "held", ["node"])
        labels = written(jumped.select("node", F.col("further").alias("root"), "n"), "labels")
