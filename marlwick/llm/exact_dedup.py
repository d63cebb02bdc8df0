"""Exact dedup with a heavy-hitter split.

Texts become SHA-256 digests in one pass. Misra-Gries summaries of each
partition, added up and pruned, name every digest with more than one part in
``counters + 1`` of the rows; their exact counts and winners are then read from
the digests (the verification), broadcast (at most ``counters`` rows) and
resolved on the map side. All other digests are shuffled as usual; none of them
can hold more than that part of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def prune(counters: dict[bytes, int], size: int) -> dict[bytes, int]:
    """The Misra-Gries step: subtract the (size+1)-th largest counter and drop what isn't positive."""
    if len(counters) <= size:
        return counters
    cut = sorted(counters.values(), reverse=True)[size]
    return {k: v - cut for k, v in counters.items() if v > cut}


def misra_gries(size: int):
    """Partition function: at most ``size`` (digest, lower bound of its count) rows."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                counters[x["values"]] = counters.get(x["values"], 0) + x["counts"]
            counters = prune(counters, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())],
            names=["digest", "least"],
        )

    return summary


def heavy_candidates(digests: DataFrame, size: int) -> list[bytes]:
    """Every digest that holds more than 1/(size+1) of the rows is among these ``size`` at most."""
    partial = digests.select("digest").mapInArrow(misra_gries(size), "digest binary, least long")
    top = partial.groupBy("digest").agg(F.sum("least").alias("least")).orderBy(F.desc("least")).limit(size + 1).collect()
    return [bytes(k) for k in prune({r.digest: r.least for r in top}, size)]


def exact_dedup(documents: DataFrame, counters: int = 1024) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; a null text counts as empty. The largest
    doc_id of equal texts stays; a null doc_id ranks below all others. Rows that
    repeat the kept doc_id with the same text all are the kept document. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    digests = written(
        documents.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "digests"
    )
    rows = digests.count()
    found = heavy_candidates(digests, counters)
    sums = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    candidates = spark.createDataFrame([(bytearray(x),) for x in found], "digest binary")
    winners = written(
        digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*sums)
        .where(F.col("group_size") * (counters + 1) > rows),
        "winners",
    )
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*sums).where("group_size > 1")
    light = rest.join(groups, "digest", "left")
    single = F.col("group_size").isNull()
    light = light.select(
        "digest", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
    return heavy.select(*light.columns).unionByName(light).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
