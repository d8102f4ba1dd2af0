"""Versioned tables: readers never see a half-written refresh.

A table's folder holds a folder per version and a pointer file that names the
current one. A version is written in full before the pointer is replaced in one
rename, so a write that ends half way changes nothing for readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from upswell.sources.tables import path_exists, write_table

POINTER = "CURRENT"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, None before the first one was published."""
    pointer = f"{path}/{POINTER}"
    return f"{path}/{spark.read.text(pointer, wholetext=True).first()[0].strip()}" if path_exists(spark, pointer) else None


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The current version, read as it is from now on: later versions go to other folders."""
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(f"no version was published at {path}")
    return spark.read.parquet(at)


def write_version(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write a new version, then point to it; its folder. It may be made from the current version."""
    name = f"v-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{name}", partition_by, mode="errorifexists")
    publish(df.sparkSession, path, name)
    return f"{path}/{name}"


def publish(spark: SparkSession, path: str, name: str) -> None:
    """Let the pointer name this version, in one step."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (POINTER, f"{POINTER}-{uuid.uuid4().hex}"))
    out = target.getFileSystem(conf).create(fresh)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, target, options)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the current version and the ``keep`` newest others; how many went. Only when no reader holds an older one."""
    current = current_version(spark, path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    others = [s for s in fs.listStatus(root) if s.getPath().getName().startswith("v-") and not (current or "").endswith(s.getPath().getName())]
    old = sorted(others, key=lambda s: -s.getModificationTime())[keep:]
    for s in old:
        fs.delete(s.getPath(), True)
    return len(old)
