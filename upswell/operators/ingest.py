"""Ingest (H1): normalise headers, validate, parse dates, filter, dedupe, count.

P1 P2 P3 F1 F15 W3 S8 S9. Every step is a lazy projection or filter except
the dedupe, which is one partial + final aggregate on the dedup key.
"""

from __future__ import annotations

import datetime as _dt
import logging
import re
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.config import IngestConfig
from upswell.functions.dates import lenient_timestamp, parse_date_column
from upswell.functions.text import icontains
from upswell.sources.tables import write_table

log = logging.getLogger(__name__)

REQUIRED_COLUMNS = ("date_received", "company", "product", "issue")

def normalize_name(name: str) -> str:
    """Snake-case header: blanks at the ends dropped, each blank or hyphen inside an underscore."""
    return re.sub(r"[ -]", "_", str(name).strip()).lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    """Snake-case headers (P1); a trailing '?' survives ('timely_response?')."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def missing_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def validate(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    """Raise on absent required columns or an empty input."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"input lacks the columns {', '.join(absent)}; it has {', '.join(df.columns)}")
    if df.isEmpty():
        raise ValueError("input has no rows")


def company_filter(df: DataFrame, pattern: str, column: str = "company", literal: bool = False) -> DataFrame:
    """Case-insensitive regex *search* on the company; NULL never matches (F1)."""
    return df.filter(icontains(F.col(column), pattern, literal=literal))


def dedupe_keep_first(df: DataFrame, keys: list[str], order_by: list[str] | None = None,
                      digest: tuple[str, ...] = ("consumer_complaint_narrative",)) -> DataFrame:
    """Keep one row per key, the first by ``order_by`` (default: all other
    columns, which makes the choice total). NULL keys compare equal.

    Implemented as ``min(struct(order..., row...))`` per key: a partial +
    final aggregate, so a key holding a third of all rows is reduced on the
    map side instead of being sorted inside one task (as a ``row_number()``
    window would). Long key texts (``digest``) are compared by SHA-256, so that
    sorting and shuffling don't handle the text as a key.
    """
    keys = list(keys)
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    order_by = list(order_by) if order_by else rest
    texts = [c for c in keys if c in digest]
    row = dict.fromkeys([*order_by, *rest, *texts])
    group = [F.sha2(F.col(c).cast("string"), 256).alias(f"_k{i}") if c in texts else F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    # An order column of its own: struct() of nothing has no minimum.
    first = F.min(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in row])).alias("_first")
    picked = df.groupBy(*group).agg(first)
    return picked.select(*[F.col("_first")[c].alias(c) if c in row else F.col(f"_k{keys.index(c)}").alias(c) for c in df.columns])


def dedup_columns(df: DataFrame, cfg: IngestConfig) -> list[str]:
    return [c for c in cfg.dedup_subset if c in df.columns]


def clean(df: DataFrame, cfg: IngestConfig = IngestConfig(), order_by: list[str] | None = None,
          validate_input: bool = True) -> DataFrame:
    """normalise -> validate -> parse dates -> company filter -> dedupe."""
    df = normalize_columns(df)
    if validate_input:
        validate(df)
    df = parse_date_column(df, "date_received")
    if cfg.company_filter_pattern:
        df = company_filter(df, cfg.company_filter_pattern)
    keys = dedup_columns(df, cfg)
    if keys:
        df = dedupe_keep_first(df, keys, order_by)
    return df


def unparsed_dates(df: DataFrame, name: str = "date_received") -> Column:
    """Count of rows whose date text isn't empty but can't be parsed."""
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(0).cast("long")
    text = F.btrim(F.col(name))
    return F.count_if((text != "") & lenient_timestamp(text).isNull())


def ingest(raw: DataFrame, out_path: str, cfg: IngestConfig = IngestConfig(),
           order_by: list[str] | None = None, partition_by_month: bool = True) -> dict:
    """Clean ``raw`` and write it as Parquet; return the lineage manifest.

    Row counts, the newest date and the number of unparsed dates come from
    ``Observation``s on the plan that writes, so no extra scan is made for them.
    """
    t0 = time.time()
    read, kept = Observation("read"), Observation("kept")
    raw = normalize_columns(raw)
    validate(raw)  # before observing: its look at a first row is a job too
    raw = raw.observe(read, F.count(F.lit(1)).alias("n"), unparsed_dates(raw).alias("unparsed"))
    out = clean(raw, cfg, order_by, validate_input=False)
    dated = "date_received" in out.columns
    newest = F.max("date_received").cast("string") if dated else F.lit(None).cast("string")
    out = out.observe(kept, F.count(F.lit(1)).alias("n"), newest.alias("newest"))
    if partition_by_month and dated:
        write_table(out.withColumn("month", F.date_format("date_received", "yyyy-MM")), out_path, "month")
    else:
        write_table(out, out_path)
    n = int(kept.get.get("n", 0))
    if cfg.min_filtered_rows and n < cfg.min_filtered_rows:
        log.warning("only %d rows kept; at least %d were expected", n, cfg.min_filtered_rows)
    return {
        "source_url": cfg.source_url,
        "last_refresh": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "row_count_full": int(read.get.get("n", 0)),
        "row_count_filtered": n,
        "unparsed_dates": int(read.get.get("unparsed", 0)),
        "newest_date": kept.get.get("newest"),
        "duration_seconds": round(time.time() - t0, 2),
    }
