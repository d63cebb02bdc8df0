"""Session factory with the settings that the dialect's semantics rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: ANSI mode makes overflow and division by zero raise; UTC makes timestamps plain. A recursion ends when it brings no new rows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def workspace(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, deleted when the JVM ends; local only where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"{tag}-")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` use underscores for dots. On a cluster leave ``master`` out."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
