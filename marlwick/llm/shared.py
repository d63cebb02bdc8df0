"""What the operators share: written tables, joins that split hot keys, and partition functions that give memory back.

Lineage is cut only with Parquet tables in the folder that ``spark.checkpoint.dir``
names, so any executor can be lost at any time. A machine-local folder is used
only where that setting is absent, as in tests.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one part in HOT_PARTS of the counted rows,
#: so there are fewer than HOT_PARTS hot keys whatever the input's size.
HOT_PARTS = 1024
#: Bytes of an Arrow batch at most, about; a worker holds a few such batches however long the texts of a table are.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of fixed-size columns (up to four longs) that ``met`` broadcasts at most: some 30 MB in an executor's hash table.
BROADCAST_IDS = 500_000

Batches = Iterable[pa.RecordBatch]

#: What this Python worker keeps from task to task, all of it one operator's.
_kept: dict[Hashable, Any] = {}


def release() -> None:
    """Give free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, once for this worker; it goes as soon as a task of ``frugal`` with another owner (``key[0]``) runs here."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def frugal(owner: str, partition: Callable[[Batches], Iterator[pa.RecordBatch]]):
    """``partition``, a function for mapInArrow, in a worker that holds nothing of other owners and ends with its memory freed."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _kept if k[0] != owner]:
            del _kept[key]
        try:
            yield from partition(batches)
        finally:
            release()

    return run


def workspace(spark: SparkSession) -> str:
    """The shared folder, or a temporary one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_marlwick_workspace", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="marlwick-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._marlwick_workspace = own
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for what is run inside; the session's setting comes back afterwards."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again with its schema."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (unique by ``keys``), hot keys apart.

    ``count`` is the number of rows of each group. Groups above one part in
    HOT_PARTS of all counted rows (fewer than HOT_PARTS of them) are broadcast;
    their rows get a salt from the columns ``spread`` and so are dealt evenly
    over the shuffle of the other rows. ``groups`` should be a written table, as
    it is read twice.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(count) * HOT_PARTS > F.lit(total)).select(
        *keys, *(F.col(c).alias(f"_hot_{c}") for c in values), F.lit(True).alias("_hot")
    )
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long"))
    )
    cool = groups.where(F.col(count) * HOT_PARTS <= F.lit(total)).withColumn("_salt", F.lit(0).cast("long"))
    joined = salted.join(cool, [*keys, "_salt"], "left")
    return joined.select(
        *rows.columns, *(F.coalesce(f"_hot_{c}", c).alias(c) for c in values)
    )


def met(rows: DataFrame, ids: DataFrame, keys: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``ids`` (a written table of fixed-size columns), on the map side where the ids are few enough."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, keys, how)


def heavy_keys(keys: DataFrame, size: int = HOT_PARTS) -> DataFrame:
    """(key): at most ``size`` longs, among them each that makes up more than one part in size + 1 of all.

    ``keys`` has one column of arrays of longs. Misra-Gries summaries of the
    partitions, merged; only they leave the map side.
    """

    def pruned(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, where = np.unique(k, return_inverse=True)
        n = np.bincount(where, n, len(own)).astype(np.int64)
        if len(own) > size:
            n -= np.partition(n, -size - 1)[-size - 1]
        return own[n > 0], n[n > 0]

    def summary(batches: Batches) -> Iterator[pa.RecordBatch]:
        k, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = batch.column(0).flatten().to_numpy()
            k, n = pruned(np.concatenate([k, more]), np.concatenate([n, np.ones(len(more), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    made = keys.mapInArrow(frugal("heavy", summary), "key long, n long")
    found = made.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size + 1).collect()
    least = found[size].n if len(found) > size else 0
    return keys.sparkSession.createDataFrame([(r.key,) for r in found[:size] if r.n > least], "key long")
