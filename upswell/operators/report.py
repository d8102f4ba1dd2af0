"""Slice reports (E6-E11, E13, E16; A8-A10, A14, P10, P12, T2, T3, X6, X9).

A slice is an inclusive date range plus an optional line of business. Every
breakdown aggregates first; shares are computed on the aggregated rows only
(a handful of groups), never with a window over raw rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.config import SliceSpec
from upswell.functions.dates import min_max_dates, months_between, week_label, week_start
from upswell.operators.windows import issue_col, product_col
from upswell.sources.tables import materialize

ALL_LOBS = "All lines of business"

# Stable export column order.
EXPORT_BASE_COLS = (
    "complaint_idx", "complaint_id", "date_received", "company", "state", "zip_code",
    "submitted_via", "timely_response?", "consumer_disputed?", "company_response_to_consumer",
    "company_public_response", "product", "sub_product", "issue", "sub_issue",
    "canonical_product", "product_line", "canonical_issue", "risk_type",
    "consumer_complaint_narrative",
)

COVERAGE_NOTE = "Prior window partially outside data range; comparison may be understated."


def default_slice(df: DataFrame, days_back: int = 14, lob: str | None = None,
                  date: str = "date_received", newest: _dt.date | None = None) -> SliceSpec:
    """Last ``days_back`` days before the newest date, both ends included. Pass
    ``newest`` where it is known (the manifest, the bare fact table)."""
    hi = newest or min_max_dates(df, date)[1]
    if hi is None:  # no dated rows: an empty slice ending today
        hi = _dt.date.today()
    return SliceSpec(hi - _dt.timedelta(days=days_back), hi, lob)


def lob_filter(df: DataFrame, lob: str | None) -> DataFrame:
    if lob is None or lob == ALL_LOBS:
        return df
    return df.filter(F.col(product_col(df)).cast("string") == F.lit(lob))


def slice_rows(df: DataFrame, spec: SliceSpec, date: str = "date_received", partition: str | None = None) -> DataFrame:
    """Rows of the slice: ``to_date(date)`` in [start, end] and the LOB (F4, F5). ``partition``
    names the month column of a table written by month, whose directories are then pruned."""
    d = F.col(date)
    lo = F.lit(spec.start.isoformat()).cast("date")
    hi_excl = F.lit((spec.end + _dt.timedelta(days=1)).isoformat()).cast("date")
    like = df.schema[date].dataType.simpleString()
    # Compare on the raw column (not to_date(col)) so the range reaches the scan.
    rows = months_between(df, spec.start, spec.end, partition).filter((d >= lo.cast(like)) & (d < hi_excl.cast(like)))
    return lob_filter(rows, spec.lob)


def slice_kpis(df: DataFrame, spec: SliceSpec, date: str = "date_received", oldest: _dt.date | None = None,
               partition: str | None = None) -> DataFrame:
    """KPI row (E6, E7, A10): complaints, raw products, states, issues + window info. Pass
    the oldest date where it is known; else it is one job over the date column."""
    lo = oldest or min_max_dates(df, date)[0]
    rows = slice_rows(df, spec, date, partition)

    def nunique(c):
        return (F.count_distinct(F.col(c)) if c in df.columns else F.lit(0)).cast("long")

    note = COVERAGE_NOTE if (lo is not None and spec.prior_start < lo) else ""
    return rows.agg(
        F.count(F.lit(1)).alias("complaints"),
        nunique("product").alias("lines_of_business"),
        nunique("state").alias("regions"),
        nunique("issue").alias("distinct_issues"),
    ).select("*", F.lit(spec.window_days).cast("long").alias("window_days"),
             F.lit(spec.prior_start.isoformat()).cast("date").alias("prior_start"),
             F.lit(note).alias("coverage_note"))


def share(n: Column, total: Column) -> Column:
    """n / total * 100, rounded half-even to 1 decimal."""
    return F.bround(n.cast("double") / total.cast("double") * F.lit(100.0), 1)


def with_share(groups: DataFrame, n_col: str, out: str) -> DataFrame:
    """Add each group's share of all groups. The aggregate is written once and read for the total and the groups, so that
    the rows below it are scanned once."""
    groups = materialize(groups)
    return groups.withColumn(out, share(F.col(n_col), groups.agg(F.sum(n_col)).scalar()))


def value_counts(df: DataFrame, keys: list[str], n_col: str = "complaints",
                 share_col: str = "share_pct", dropna: bool = False) -> DataFrame:
    """Counts per key with the share of the counted rows (A8, A9). ``dropna``
    drops NULL keys first (pandas ``value_counts``); group-bys keep them (A3)."""
    if dropna:
        df = df.dropna(subset=keys)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_col))
    return with_share(g, n_col, share_col)


def top_values(df: DataFrame, key: str, n: int = 20, n_col: str = "complaints",
               sort_by: str | None = None, descending: bool | None = None) -> DataFrame:
    """Value counts (NULL dropped) sorted (default: count desc, value asc), first
    ``n`` (E9, T2, T3)."""
    vc = value_counts(df, [key], n_col, dropna=True)
    sort_by = sort_by or n_col
    if descending is None:
        descending = sort_by in (n_col, "share_pct")
    first = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return vc.orderBy(first, F.col(key).asc()).limit(n)


def lob_breakdown(df: DataFrame) -> DataFrame:
    pc = product_col(df)
    return value_counts(df, [pc], dropna=True).withColumnRenamed(pc, "line_of_business")


def line_breakdown(df: DataFrame) -> DataFrame:
    pc = product_col(df)
    return value_counts(df, [pc, "product_line"]).withColumnRenamed(pc, "line_of_business")


def issue_top(df: DataFrame, n: int = 20) -> DataFrame:
    ic = issue_col(df)
    return top_values(df, ic, n).withColumnRenamed(ic, "issue_label")


def region_top(df: DataFrame, n: int = 20) -> DataFrame:
    """Top states (NULL -> 'Unknown'); share of the rows shown (Q16) and of all."""
    st = df.select(F.coalesce(F.col("state").cast("string"), F.lit("Unknown")).alias("state"))
    top = top_values(st, "state", n).withColumnRenamed("share_pct", "share_of_total")
    return with_share(top, "complaints", "share_of_shown")


def weekly_volume(df: DataFrame, date: str = "date_received") -> DataFrame:
    """Monday-to-Sunday weekly counts."""
    return (df.filter(F.col(date).isNotNull())
            .groupBy(week_start(F.col(date)).alias("week_start"), week_label(F.col(date)).alias("week"))
            .agg(F.count(F.lit(1)).alias("complaints")))


def export_columns(columns: list[str], leading: list[str] | tuple = ()) -> list[str]:
    """The frame's columns, each once: leading ones, then the stable order, then the others as they come."""
    wanted = dict.fromkeys((*leading, *EXPORT_BASE_COLS, *columns))
    return [c for c in wanted if c in set(columns)]


def prepare_export(df: DataFrame, leading: list[str] | tuple = (), date: str = "date_received") -> DataFrame:
    """Stable column order, date as yyyy-MM-dd."""
    out = df
    if date in df.columns:
        out = out.withColumn(date, F.date_format(F.col(date), "yyyy-MM-dd"))
    return out.select(*[F.col(f"`{c}`") for c in export_columns(out.columns, leading)])


def drill(df: DataFrame, product: str | None = None, issue: str | None = None) -> DataFrame:
    """Rows behind an aggregate cell: product [and issue] equality."""
    out = df
    if product is not None:
        out = out.filter(F.col(product_col(df)).cast("string") == F.lit(product))
    if issue is not None:
        out = out.filter(F.col(issue_col(df)).cast("string") == F.lit(issue))
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export (S7); nested columns must be flattened first."""
    df.write.mode("overwrite").option("header", True).csv(path)
