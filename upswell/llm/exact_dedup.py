"""Exact de-duplication by distributed MSD radix partitioning.

All documents start in one group. Each level splits every group by the next
bytes of the text (a radix of 128 bytes first, then eight times as many a
level, up to 1 MiB); a group of one row is finished, and so is a group whose
texts end inside the level's bytes, as its texts are then the same from first
to last byte. Only the other rows go on to the next level. Equality rests on
the bytes alone; the SHA-256 is a result column and decides nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, keep_rows, lookup_join, map_rows, stable, text_bytes, with_row_id

FIRST_WIDTH, GROWTH, MAX_WIDTH = 128, 8, 1 << 20

_PREPARED = "_rid long, doc_id long, text_sha256 string, _rest binary"
_PREPARED_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("_rest", pa.binary())])


def _normalise(batch: dict[str, list]) -> dict[str, list]:
    texts = [t.lower() for t in batch["text"]]  # bytes.lower() changes A-Z only
    return {"_rid": batch["_rid"], "doc_id": batch["doc_id"], "_rest": texts,
            "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}


def equal_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _rid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty. Of equal texts the row with the largest id stays; a null id is below
    all others, and of rows with the same id one stays, always the same. An empty
    table gives an empty result; other columns of ``docs`` are not looked at.
    """
    docs = stable(docs)
    source = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)})
    active = map_rows(source, _normalise, _PREPARED, _PREPARED_ARROW).withColumn("_gid", F.lit(0).cast("long"))
    total, width, done = docs.count(), FIRST_WIDTH, []
    first = True
    while first or total:
        first = False
        keyed = active.select("_gid", F.substring("_rest", 1, width).alias("_part"), "_rid", "doc_id", "text_sha256",
                              F.expr(f"substring(_rest, {width + 1})").alias("_rest"))
        groups = keyed.groupBy("_gid", "_part").agg(
            F.count(F.lit(1)).alias("_n"), F.max(F.struct("doc_id", "_rid", "text_sha256")).alias("_top"))
        groups = checkpointed(groups.select(
            F.when(F.col("_n") > 1, F.col("_gid")).alias("_gid"), F.when(F.col("_n") > 1, F.col("_part")).alias("_part"), "_n", "_top",
            F.monotonically_increasing_id().alias("_next")))
        done.append(groups.where("_n = 1").select(
            "_top._rid", "_top.doc_id", F.col("_top.doc_id").alias("keep_id"), F.col("_n").alias("group_size"),
            F.lit(True).alias("kept"), "_top.text_sha256"))
        shared = groups.where("_n > 1").select("_gid", "_part", "_n", "_next", F.col("_top.doc_id").alias("_keep_id"),
                                               F.col("_top._rid").alias("_keep_rid"))
        split = checkpointed(lookup_join(keyed, shared, ["_gid", "_part"], total).select(
            "_rid", "doc_id", "text_sha256", "_rest", "_next", "_n", "_keep_id", "_keep_rid",
            (F.length("_part") < width).alias("_ended")))
        done.append(split.where("_ended").select(
            "_rid", "doc_id", F.col("_keep_id").alias("keep_id"), F.col("_n").alias("group_size"),
            ((F.col("_rid") == F.col("_keep_rid")) & F.col("doc_id").eqNullSafe(F.col("_keep_id"))).alias("kept"), "text_sha256"))
        active = split.where(~F.col("_ended")).select("_rid", "doc_id", "text_sha256", "_rest", F.col("_next").alias("_gid"))
        total, width = active.count(), min(width * GROWTH, MAX_WIDTH)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def drop_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they were."""
    docs = stable(docs)
    return keep_rows(docs, equal_text_groups(docs, id_col, text_col).where(~F.col("kept")), id_col)
