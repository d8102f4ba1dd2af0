"""Parquet scans (S2, S3) and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Derived table if its path exists, else an empty frame with its schema (S3).
    A table that exists and can't be read is an error."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def read_standardized(spark: SparkSession, standardized: str, raw: str, taxonomy) -> DataFrame:
    """The standardized table if it was written, else the raw one with the taxonomy applied."""
    from upswell.operators.taxonomy import apply_taxonomy

    if path_exists(spark, standardized):
        return spark.read.parquet(standardized)
    return apply_taxonomy(spark.read.parquet(raw), taxonomy)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet sink (S4). With ``partition_by`` a directory for each value: rows are
    dealt out by it first, large values over several tasks, so that a task
    writes few directories."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def spread(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Deal rows out over ``num_partitions`` tasks before costly work on each row (regexes
    over whole texts, encoders); None leaves the scan's own tasks."""
    return df.repartition(num_partitions) if num_partitions else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's checkpoint folder and read it back.

    For a derived table that several operators read (the topic assignment
    table): the upstream work runs once and the lineage is cut, so a lost
    executor does not replay it.
    """
    from upswell.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
