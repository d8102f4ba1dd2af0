"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.session import ensure_checkpoint_dir
from upswell.sources.tables import materialize, read_table

HEAVY_ROWS, MAX_HEAVY = 1024, 4096
"""A lookup key with more than HEAVY_ROWS rows, and more than 1/MAX_HEAVY of all (so at most MAX_HEAVY keys), is salted."""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def row_place(docs: DataFrame) -> list[Column]:
    """Columns that sort rows of a scan as the table holds them: the file, the place in it; none if ``docs`` is no such scan."""
    try:
        place = docs.metadataColumn("_metadata")
        columns = [place["file_path"], place["row_index"]]
        docs.select(*columns)
    except AnalysisException:
        return []
    return columns


def _row_number(docs: DataFrame) -> Column | None:
    """A number for each row by the file it is in and its place there, the same in every scan; None if ``docs`` is no such scan."""
    place = row_place(docs)
    return F.xxhash64(*place) if place else None


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` such that rows have the same numbers each time it is read: a scan of row files as it is, else a checkpoint."""
    return docs if _row_number(docs) is not None else checkpointed(docs)


def with_row_id(docs: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """The named columns and ``_rid``, which tells rows with the same id apart.

    In a scan it depends on the file and the place in it alone, not on how
    files are split over tasks. Elsewhere it counts rows per task; use ``stable`` if
    rows are to be found again by it. Different ids may share a number.
    """
    number = _row_number(docs)
    number = F.monotonically_increasing_id() if number is None else number
    return docs.select(number.alias("_rid"), *[c.alias(n) for n, c in cols.items()])


def text_bytes(docs: DataFrame, text_col: str = "text") -> Column:
    """UTF-8 bytes of the text; null counts as empty."""
    return F.coalesce(docs[text_col], F.lit("")).cast("binary")


def map_rows(df: DataFrame, per_batch: Callable[[dict[str, list]], dict[str, list]], schema: str,
             arrow_schema: pa.Schema) -> DataFrame:
    """Run ``per_batch`` over bounded Arrow batches: columns as Python lists in, the same out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = per_batch({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique on ``keys``; column ``_n`` counts the rows that have the key).

    The heaviest keys, of which there can be no more than ``MAX_HEAVY``, are
    broadcast with the number of shares that their rows are dealt into, and
    ``lookup`` holds a copy of the key for each share; other keys go by an
    ordinary shuffle. ``total`` is the number of rows, ``lookup`` should be cheap
    to read twice (a checkpoint). ``_n`` is kept.
    """
    limit = max(HEAVY_ROWS, total // MAX_HEAVY)
    shares = F.ceil(F.col("_n") / limit).cast("int")
    heavy = lookup.where(F.col("_n") > limit).select(*keys, shares.alias("_shares"))
    if heavy.isEmpty():
        return rows.join(lookup, keys, how)
    rows = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64("_rid"), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    salts = F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)
    return rows.join(lookup.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back; cuts the lineage."""
    return materialize(df)


def _quoted(docs: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def keep_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (see ``stable``) without the rows of ``dropped`` (_rid, doc_id; see ``with_row_id``), columns as they were."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = with_row_id(docs, {n: docs[c] for n, c in zip(names, _quoted(docs))} | {"_id": docs[id_col].cast("long")})
    gone = dropped.select(F.col("_rid").alias("_gone"), F.col("doc_id").alias("_gone_id"))
    kept = rows.join(gone, (F.col("_rid") == F.col("_gone")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left_anti")
    return kept.select(*names).toDF(*docs.columns)


def filter_texts(docs: DataFrame, keep: Callable[[], Callable[[bytes], bool]], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text (UTF-8; null counts as empty) ``keep()`` turns down, columns as they were.
    ``keep`` is called once a task; the rows pass through whole, without a join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keep()
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([wanted(t or b"") for t in texts], pa.bool_()))

    plain = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(_quoted(docs))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
