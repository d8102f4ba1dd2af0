"""Lineage and run status."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.config import IngestConfig
from upswell.functions.dates import parse_date_column
from upswell.functions.text import has_text, icontains
from upswell.operators.ingest import dedup_columns, normalize_columns

STATUS_SCHEMA = T.StructType([
    T.StructField("last_run", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("stage", T.StringType()),
])


def manifest_frame(raw: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """One-row lineage manifest: rows read, rows that ``clean`` keeps, warning flag.

    One scan: rows are counted by dedup key, and a key is kept if some row of
    it passes the company filter.
    """
    df = normalize_columns(raw)
    df = parse_date_column(df, "date_received")
    match = icontains(F.col("company"), cfg.company_filter_pattern) if cfg.company_filter_pattern else F.lit(True)
    keys = dedup_columns(df, cfg)
    if keys:
        by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(match).alias("_m"))
        counts = by_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("row_count_full"),
                            F.count_if(F.col("_m") > 0).alias("row_count_filtered"))
    else:
        counts = df.agg(F.count(F.lit(1)).alias("row_count_full"), F.count_if(match).alias("row_count_filtered"))
    return counts.select(F.lit(cfg.source_url).alias("source_url"), "row_count_full", "row_count_filtered",
                         (F.col("row_count_filtered") >= F.lit(cfg.min_filtered_rows)).alias("meets_min_filtered_rows"))


def append_status(spark: SparkSession, path: str, stage: str, status: str, duration_seconds: float) -> None:
    """Append one run record to the ``pipeline_status`` table."""
    row = (_dt.datetime.now(_dt.timezone.utc).isoformat(), status, round(float(duration_seconds), 2), stage)
    spark.createDataFrame([row], STATUS_SCHEMA).write.mode("append").parquet(path)


def staleness(complaints: DataFrame, topics: DataFrame, date: str = "date_received",
              narrative: str = "consumer_complaint_narrative") -> DataFrame:
    """Is the topic table behind its source? Target = newest complaint that
    has a narrative (else the newest complaint) (E14, A11)."""
    has = has_text(F.col(narrative)) if narrative in complaints.columns else F.lit(False)
    topics_max = topics.select(F.max(F.col(date))).scalar()
    c = complaints.agg(F.max(F.col(date)).alias("complaints_max_date"),
                       F.max(F.when(has, F.col(date))).alias("narrative_max_date"))
    target = F.coalesce(F.col("narrative_max_date"), F.col("complaints_max_date"))
    return c.select(
        F.to_date("complaints_max_date").alias("complaints_max_date"),
        F.to_date("narrative_max_date").alias("narrative_max_date"),
        F.to_date(topics_max).alias("topics_max_date"),
        (target.isNotNull() & (topics_max.isNull() | (F.to_date(topics_max) < F.to_date(target)))).alias("stale"))
