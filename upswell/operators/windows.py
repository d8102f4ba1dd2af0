"""Windowed volumes (A1): current / prior / baseline counts in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.functions.dates import Windows


def product_col(df: DataFrame) -> str:
    """Column-role fallback: the canonical product (LOB) when present."""
    return "canonical_product" if "canonical_product" in df.columns else "product"


def issue_col(df: DataFrame) -> str:
    return "canonical_issue" if "canonical_issue" in df.columns else "issue"


def window_volumes(df: DataFrame, keys: list[str], windows: Windows, state: str | None = None,
                   date: str = "date_received", partition: str | None = None, rsd: float | None = None) -> DataFrame:
    """Counts per key in the three half-open windows, plus distinct states
    (non-NULL, current window). One range filter (pushed to the scan), one
    partial + final hash aggregate; keys with no row in any window do not
    appear. States are counted exactly; ``rsd`` asks for an estimate of that
    relative error instead, which needs no shuffle by state.
    """
    like = df.schema[date].dataType
    cur, prior, base = windows.flags(F.col(date), like)
    rows = windows.rows(df, date, partition)
    aggs = [
        F.count_if(cur).alias("current_volume"),
        F.count_if(prior).alias("prior_volume"),
        F.count_if(base).alias("baseline_volume"),
    ]
    if state is not None and state in df.columns:
        states = F.when(cur, F.col(state))
        aggs.append((F.count_distinct(states) if rsd is None else F.approx_count_distinct(states, rsd)).alias("distinct_states"))
    else:
        aggs.append(F.lit(0).cast("long").alias("distinct_states"))
    return rows.groupBy(*keys).agg(*aggs)


def daily_sketches(df: DataFrame, keys: list[str], item: str, date: str = "date_received", lg_k: int = 14) -> DataFrame:
    """Counts per day and key, with a sketch of the distinct ``item`` values.

    Sketches merge, so a rollup of days answers for any window without the rows
    (counts of distinct values alone don't add up). A sketch has at most
    2**lg_k bytes and an error of about 0.8 % at 14. NULL items aren't counted;
    rows without a date are left out; NULL keys are a group.
    """
    rows = df.where(F.col(date).isNotNull())
    return rows.groupBy(F.to_date(date).alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("complaints"), F.hll_sketch_agg(F.col(item).cast("string"), lg_k).alias("sketch"))


def volumes_from_sketches(daily: DataFrame, keys: list[str], windows: Windows) -> DataFrame:
    """Counts and estimated distinct items per key in the three windows, from ``daily_sketches``.

    Exact in its counts, and of the sketches' error in the others, if the
    windows begin and end with days. Keys with no day in any window do not appear.
    """
    day = F.col("day").cast("timestamp")
    names = ("current", "prior", "baseline")
    aggs = []
    for name, flag in zip(names, windows.flags(day)):
        merged = F.hll_union_agg(F.when(flag, F.col("sketch")))
        aggs += [F.coalesce(F.sum(F.when(flag, F.col("complaints"))), F.lit(0)).cast("long").alias(f"{name}_volume"),
                 F.coalesce(F.hll_sketch_estimate(merged), F.lit(0)).cast("long").alias(f"{name}_distinct")]
    return daily.where(windows.span(day)).groupBy(*keys).agg(*aggs)
