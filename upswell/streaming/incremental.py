"""Incremental jobs on Structured Streaming (ST1, ST2).

New files are picked up by a file stream. ST1 cleans each batch as the batch
ingest does and adds the complaints whose key the target table lacks; ST2
keeps daily counts per key, from which the 30/30/90-day windows are sums over
days. Both accept rows of any age, in any order: there is no watermark, so
nothing late is lost, and a batch that runs again changes nothing.
``daily_counts`` is the batch twin of ST2.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from upswell.config import IngestConfig
from upswell.functions.dates import Windows, parse_date_column
from upswell.functions.growth import VOLUMES, emerging_flag, with_growth, with_ranks
from upswell.operators.ingest import company_filter, dedupe_keep_first, missing_columns, normalize_columns
from upswell.operators.taxonomy import Taxonomy, apply_taxonomy
from upswell.sources.tables import materialize, read_or_empty, write_table


def daily_counts(df: DataFrame, keys: list[str], date: str = "date_received") -> DataFrame:
    """Rows per (day, keys): the batch twin of the streaming job."""
    return (df.filter(F.col(date).isNotNull())
            .groupBy(F.to_date(F.col(date)).alias("day"), *keys)
            .agg(F.count(F.lit(1)).alias("complaints")))


def _run(stream: DataFrame, batch, checkpoint: str) -> StreamingQuery:
    """Process everything there is in micro-batches, then stop."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest_stream(stream: DataFrame, out_path: str, checkpoint: str, cfg: IngestConfig = IngestConfig(),
                  key: str = "complaint_id", taxonomy: Taxonomy | DataFrame | None = None,
                  order_by: list[str] | None = None) -> StreamingQuery:
    """ST1: headers, company filter, lenient dates, taxonomy, one row per key, into a table by month.

    A key that the table holds already is not added again, however long ago it
    came: keys are held in ``<out_path>_keys`` by hash bucket, and a batch reads only
    the buckets that its own keys are in. Rows without a key are kept. Batches are
    named by the stream and their number, so a stream with a new checkpoint adds
    to what others wrote.
    """
    s = normalize_columns(stream)
    absent = missing_columns(s)
    if absent:
        raise ValueError(f"stream lacks the columns {', '.join(absent)}")

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = company_filter(df, cfg.company_filter_pattern) if cfg.company_filter_pattern else df
        rows = parse_date_column(rows, "date_received")
        keyed = dedupe_keep_first(rows.filter(F.col(key).isNotNull()), [key], order_by)
        name = _batch_name(df.sparkSession, checkpoint, batch_id)
        keyed = materialize(keyed.withColumn("_bucket", _bucket(key)))
        keys = keyed.select(key, "_bucket")
        keyed = materialize(keyed.join(held_keys(df.sparkSession, out_path, keys, key, name).select(key), key, "left_anti").drop("_bucket"))
        out = keyed.unionByName(rows.filter(F.col(key).isNull()))
        if taxonomy is not None:
            out = apply_taxonomy(out, taxonomy)
        out = out.withColumn("month", F.date_format("date_received", "yyyy-MM")).withColumn("_batch", F.lit(name))
        _overwrite_batch(out, out_path, ["_batch", "month"])
        added = keyed.select(key).withColumn("_batch", F.lit(name)).withColumn("_bucket", _bucket(key))
        _overwrite_batch(added, f"{out_path}_keys", ["_bucket", "_batch"])

    return _run(s, batch, checkpoint)


def daily_counts_stream(stream: DataFrame, out_path: str, checkpoint: str, keys: list[str],
                        date: str = "date_received") -> StreamingQuery:
    """ST2: the counts that each batch adds, in a directory of its own; ``read_daily`` sums them."""
    def batch(df: DataFrame, batch_id: int) -> None:
        counts = daily_counts(parse_date_column(df, date), keys, date)
        name = _batch_name(df.sparkSession, checkpoint, batch_id)
        _overwrite_batch(counts.withColumn("_batch", F.lit(name)), out_path, ["_batch"])

    return _run(stream, batch, checkpoint)


KEY_BUCKETS = 256


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(KEY_BUCKETS)).cast("int")


def held_keys(spark: SparkSession, out_path: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """The table's keys in the buckets (at most ``KEY_BUCKETS``) of ``keys``, without those that batch ``name`` wrote."""
    schema = T.StructType([keys.schema[key], T.StructField("_bucket", T.IntegerType()), T.StructField("_batch", T.StringType())])
    wanted = [r[0] for r in keys.select("_bucket").distinct().collect()]
    return read_or_empty(spark, f"{out_path}_keys", schema).filter(F.col("_bucket").isin(wanted) & (F.col("_batch") != name))


def _batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Tells batches of all streams apart: the id that the checkpoint keeps for its stream, and the batch's number."""
    stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    return f"{stream}-{batch_id}"


def _overwrite_batch(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write a batch's directories anew, so that a batch that is run again replaces what it wrote."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_daily(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The daily counts over all batches so far."""
    return spark.read.parquet(path).groupBy("day", *keys).agg(F.sum("complaints").cast("long").alias("complaints"))


def compact_daily(spark: SparkSession, path: str, keys: list[str], out_path: str) -> None:
    """Write the sums over all batches as one table (no batch may run meanwhile)."""
    write_table(read_daily(spark, path, keys), out_path)


def daily_rollup(df: DataFrame, date: str = "date_received", product: str = "product",
                 issue: str = "issue", state: str | None = "state") -> DataFrame:
    """The (day, product, issue, state) counts that the incremental job keeps."""
    keys = [product, issue] + ([state] if state and state in df.columns else [])
    return daily_counts(df.dropna(subset=[date, product, issue]), keys, date)


def emerging_summary_from_daily(daily: DataFrame, cfg, reference_date=None, product: str = "product",
                                state: str | None = "state") -> DataFrame:
    """E1 summary from the daily rollup instead of the raw rows.

    Exact when the window bounds fall on day boundaries (complaint dates are
    days): counts are sums of daily counts and distinct states are the states
    with a non-zero current-window day. The rollup is the small table the
    streaming job maintains, so daily runs never rescan history. An empty rollup
    gives an empty result.
    """
    from upswell.operators.emerging import SUMMARY_SCHEMA

    d = daily.withColumn("_ts", F.col("day").cast("timestamp"))
    if reference_date is None:
        newest = d.agg(F.date_format(F.max("_ts"), "yyyy-MM-dd").alias("m")).first()["m"]
        if newest is None:
            return daily.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
        reference_date = _dt.datetime.fromisoformat(newest)
    w = Windows.from_config(reference_date, cfg)
    like = d.schema["_ts"].dataType
    cur, prior, base = w.flags(F.col("_ts"), like)
    n = F.col("complaints")
    aggs = [F.sum(F.when(cur, n).otherwise(0)).cast("long").alias("current_volume"),
            F.sum(F.when(prior, n).otherwise(0)).cast("long").alias("prior_volume"),
            F.sum(F.when(base, n).otherwise(0)).cast("long").alias("baseline_volume")]
    if state and state in daily.columns:
        aggs.append(F.count_distinct(F.when(cur, F.col(state))).alias("distinct_states"))
    else:
        aggs.append(F.lit(0).cast("long").alias("distinct_states"))
    vol = d.filter(w.span(F.col("_ts"), like)).groupBy(F.col(product).cast("string").alias("product")).agg(*aggs)
    s = with_growth(with_ranks(vol, method="ranges", counted=VOLUMES))
    s = s.withColumn("emerging", emerging_flag(cfg.growth_threshold, cfg.min_prior_volume, cfg.top_n_rank))
    s = s.withColumn("meets_min_volume", F.col("current_volume") >= F.lit(cfg.min_current_volume))
    return s.select(*[f.name for f in SUMMARY_SCHEMA.fields])
