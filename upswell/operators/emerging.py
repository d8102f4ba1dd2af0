"""Emerging products."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.config import EmergenceConfig
from upswell.functions.dates import Windows, max_timestamp, months_between, parse_date_column
from upswell.functions.growth import (VOLUMES, emergence_order, emerging_flag, product_takeaway,
                                      with_growth, with_ranks)
from upswell.operators.windows import issue_col, product_col, window_volumes

SUMMARY_SCHEMA = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("current_volume", T.LongType()),
    T.StructField("prior_volume", T.LongType()),
    T.StructField("baseline_volume", T.LongType()),
    T.StructField("distinct_states", T.LongType()),
    T.StructField("growth_ratio", T.DoubleType()),
    T.StructField("growth_pct", T.DoubleType()),
    T.StructField("is_new", T.BooleanType()),
    T.StructField("lift_vs_baseline", T.DoubleType()),
    T.StructField("rank_current", T.LongType()),
    T.StructField("rank_prior", T.LongType()),
    T.StructField("rank_improved", T.LongType()),
    T.StructField("emerging", T.BooleanType()),
    T.StructField("meets_min_volume", T.BooleanType()),
])

ISSUE_STRUCT = T.StructType([T.StructField("issue", T.StringType()),
                             T.StructField("current_volume", T.LongType())])

RECORD_SCHEMA = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("rank_current", T.LongType()),
    T.StructField("rank_prior", T.LongType()),
    T.StructField("current_volume", T.LongType()),
    T.StructField("prior_volume", T.LongType()),
    T.StructField("baseline_volume", T.LongType()),
    T.StructField("lift_vs_baseline", T.DoubleType()),
    T.StructField("distinct_states", T.LongType()),
    T.StructField("growth_ratio", T.DoubleType()),
    T.StructField("growth_pct", T.DoubleType()),
    T.StructField("top_issues", T.ArrayType(ISSUE_STRUCT)),
    T.StructField("top_issues_text", T.StringType()),
    T.StructField("takeaway", T.StringType()),
    T.StructField("persistent", T.BooleanType()),
])


def _empty(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _prepare(df: DataFrame, date: str) -> tuple[DataFrame | None, str, str]:
    pc, ic = product_col(df), issue_col(df)
    if date not in df.columns or pc not in df.columns or ic not in df.columns:
        return None, pc, ic
    df = parse_date_column(df, date).dropna(subset=[date, pc, ic])
    return df, pc, ic


def resolve_windows(df: DataFrame, cfg: EmergenceConfig, reference_date: _dt.datetime | None,
                    date: str = "date_received") -> Windows | None:
    """Windows ending at ``reference_date`` (default: newest date, E4)."""
    ref = reference_date if reference_date is not None else max_timestamp(df, date, cfg.partition_column)
    if ref is None:
        return None
    if isinstance(ref, _dt.date) and not isinstance(ref, _dt.datetime):
        ref = _dt.datetime.combine(ref, _dt.time())
    return Windows.from_config(ref.replace(tzinfo=None), cfg)


def emerging_summary(df: DataFrame, cfg: EmergenceConfig = EmergenceConfig(),
                     reference_date: _dt.datetime | None = None, date: str = "date_received",
                     windows: Windows | None = None) -> DataFrame:
    """One row per product with volumes, growth, ranks and the emergence flags."""
    prepared, pc, ic = _prepare(df, date)
    if prepared is None:
        return _empty(df, SUMMARY_SCHEMA)
    w = windows or resolve_windows(parse_date_column(df, date), cfg, reference_date, date)
    if w is None:
        return _empty(df, SUMMARY_SCHEMA)
    state = "state" if "state" in prepared.columns else None
    vol = window_volumes(prepared, [pc], w, state=state, date=date, partition=cfg.partition_column,
                         rsd=cfg.distinct_states_rsd)
    # Ranked by ranges of volume, so that no task sorts all products; one shuffle of the counts feeds all branches.
    s = with_growth(with_ranks(vol, method="ranges", counted=VOLUMES))
    s = s.withColumn("emerging", emerging_flag(cfg.growth_threshold, cfg.min_prior_volume, cfg.top_n_rank))
    s = s.withColumn("meets_min_volume", F.col("current_volume") >= F.lit(cfg.min_current_volume))
    return s.select(F.col(pc).cast("string").alias("product"), *[f.name for f in SUMMARY_SCHEMA.fields[1:]])


def issue_volumes(df: DataFrame, windows: Windows, pc: str, ic: str, date: str = "date_received",
                  partition: str | None = None) -> DataFrame:
    """Current-window count per (product, issue)."""
    like = df.schema[date].dataType
    cur, _, _ = windows.flags(F.col(date), like)
    recent = months_between(df, windows.current_start, windows.end, partition)
    return (recent.filter(cur).groupBy(F.col(pc).cast("string").alias("product"),
                                   F.col(ic).cast("string").alias("issue"))
            .agg(F.count(F.lit(1)).alias("current_volume")))


def top_issues(issue_counts: DataFrame, k: int) -> DataFrame:
    """Top-k issues per product, ties by issue ascending (W2, WindowGroupLimit)."""
    w = Window.partitionBy("product").orderBy(F.col("current_volume").desc(), F.col("issue").asc())
    return (issue_counts.withColumn("issue_rank", F.row_number().over(w).cast("long"))
            .filter(F.col("issue_rank") <= F.lit(k)))


def nest_issues(ranked: DataFrame) -> DataFrame:
    """(product, issue, current_volume, issue_rank) -> product, array<struct>, text."""
    g = ranked.groupBy("product").agg(
        F.sort_array(F.collect_list(F.struct("issue_rank", "issue", "current_volume"))).alias("_l"))
    arr = F.transform(F.col("_l"), lambda x: F.struct(x["issue"].alias("issue"),
                                                      x["current_volume"].alias("current_volume")))
    text = F.array_join(F.transform(F.col("_l"), lambda x: F.concat(
        x["issue"], F.lit(" ("), x["current_volume"].cast("string"), F.lit(")"))), "; ")
    return g.select("product", arr.alias("top_issues"), text.alias("top_issues_text"))


def with_persistence(emerging: DataFrame, cfg: EmergenceConfig, previous: DataFrame | None) -> DataFrame:
    """Flag products that were emerging in the immediately previous run."""
    if cfg.persistence_min_runs <= 1:
        return emerging.withColumn("persistent", F.lit(True))
    if previous is None:
        out = emerging.withColumn("persistent", F.lit(False))
    else:
        prev = previous.select(F.col("product").cast("string").alias("product")).distinct() \
            .withColumn("_prev", F.lit(True))
        out = emerging.join(prev, "product", "left").withColumn(
            "persistent", F.coalesce(F.col("_prev"), F.lit(False))).drop("_prev")
    if cfg.hide_new_until_persistent:
        out = out.filter(F.col("persistent"))
    return out


def emerging_products(df: DataFrame, cfg: EmergenceConfig = EmergenceConfig(),
                      reference_date: _dt.datetime | None = None, previous: DataFrame | None = None,
                      date: str = "date_received") -> DataFrame:
    """The emerging-product records: top-n by growth with top issues and takeaway."""
    prepared, pc, ic = _prepare(df, date)
    if prepared is None:
        return _empty(df, RECORD_SCHEMA)
    w = resolve_windows(parse_date_column(df, date), cfg, reference_date, date)
    if w is None:
        return _empty(df, RECORD_SCHEMA)
    summary = emerging_summary(prepared, cfg, date=date, windows=w)
    em = summary.filter(F.col("emerging") & F.col("meets_min_volume"))
    em = with_persistence(em, cfg, previous)
    top = em.orderBy(*emergence_order("product")).limit(cfg.top_n_emerging)
    # Top issues for every product from one (product, issue) aggregate, then
    # joined to the <= top_n records: referencing ``top`` only once keeps the
    # summary from being planned (and the fact table scanned) a second time.
    nested = nest_issues(top_issues(issue_volumes(prepared, w, pc, ic, date, cfg.partition_column), cfg.top_issues_per_product))
    out = top.join(nested, "product", "left")
    out = out.withColumn("top_issues", F.coalesce(F.col("top_issues"), F.array().cast(T.ArrayType(ISSUE_STRUCT))))
    out = out.withColumn("top_issues_text", F.coalesce(F.col("top_issues_text"), F.lit("")))
    out = out.withColumn("takeaway", product_takeaway(F.col("product")))
    out = out.withColumn("growth_pct", F.when(F.col("prior_volume") > 0, F.bround(F.col("growth_pct"), 1)))
    # Records are a ranked list: re-sort the <= top_n rows after the joins.
    return out.select(*[f.name for f in RECORD_SCHEMA.fields]).orderBy(*emergence_order("product"))


def flatten_records(records: DataFrame) -> DataFrame:
    """CSV-friendly records: nested top issues as 'issue (n); ...' (X16)."""
    return records.drop("top_issues").withColumnRenamed("top_issues_text", "top_issues")


def emerging_for_slice(df: DataFrame, spec, cfg: EmergenceConfig = EmergenceConfig(),
                       date: str = "date_received") -> DataFrame:
    """Emerging products for a slice (E12): windows as long as the range, ending
    at the end date (exclusive), baseline max(3 x range, 90) days, computed on
    the whole history (not pre-filtered to the range)."""
    ref = _dt.datetime.combine(spec.end, _dt.time())
    return emerging_products(df, spec.emergence_config(cfg), reference_date=ref, date=date)
