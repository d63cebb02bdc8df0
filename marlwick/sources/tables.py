"""Readers of the star schema's Parquet tables and generic file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; int columns become bigint, which keeps filters on them in the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = [f.name for f in df.schema if f.dataType.simpleString() in ("int", "smallint", "tinyint")]
    return df.withColumns({c: F.col(c).cast("bigint") for c in small}) if small else df


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any built-in file source; text formats want a schema, as inferring one reads the data twice."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
