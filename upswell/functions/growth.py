"""Growth ratios, ranks and takeaway sentences as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Closing sentences of the takeaway texts; the phrases inside the two takeaway functions are fixed too.
TAKEAWAY_TAIL = "— consider reviewing process and customer communications."
TOPIC_TAKEAWAY_TAIL = " Consider reviewing process and customer communications."

VOLUMES = ("current_volume", "prior_volume", "baseline_volume", "distinct_states")
"""The counts of a product."""


def ratio(num: Column, den: Column) -> Column:
    """num/den; NULL when den = 0 and num > 0 ("new", infinite); 1.0 when both 0.

    Guarded so ANSI division never sees a zero.
    """
    n, d = num.cast("double"), den.cast("double")
    return (F.when(d > 0, n / F.when(d > 0, d))
            .when(n > 0, F.lit(None).cast("double"))
            .otherwise(F.lit(1.0)))


def growth_pct(ratio_col: Column) -> Column:
    """(ratio - 1) * 100, NULL when the ratio is infinite (NULL)."""
    return (ratio_col - F.lit(1.0)) * F.lit(100.0)


def with_growth(df: DataFrame, cur: str = "current_volume", prior: str = "prior_volume",
                base: str | None = "baseline_volume") -> DataFrame:
    out = df.withColumn("growth_ratio", ratio(F.col(cur), F.col(prior)))
    out = out.withColumn("growth_pct", growth_pct(F.col("growth_ratio")))
    out = out.withColumn("is_new", (F.col(prior) == 0) & (F.col(cur) > 0))
    if base is not None:
        out = out.withColumn("lift_vs_baseline", ratio(F.col(cur), F.col(base)))
    return out


def value_range(value: Column) -> Column:
    """A number that grows with ``value``: its highest eleven binary places and how many follow.

    There are at most 2^10 ranges to a power of two, so some 65 000 for all
    whole volumes, whatever the data; a range holds values within 0.1 % of each other.
    """
    whole = F.greatest(value.cast("long"), F.lit(0).cast("long"))
    size = F.greatest(F.length(F.bin(whole)) - 11, F.lit(0))
    return size.cast("long") * 2048 + F.call_function("shiftright", whole, size)


def with_global_rank(df: DataFrame, value: str, out: str, by: list[str] | tuple = (),
                     method: str = "window", counted: list[str] | tuple = ()) -> DataFrame:
    """``rank(method='min', descending)`` of ``value`` over all rows (per ``by``).

    ``df`` is an aggregate (one row per group), so the default window sorts
    the groups, not the underlying rows, in one task per ``by`` value. The
    other methods are for whole volumes of 0 or more: rank = 1 + number of
    groups with a larger value, from a histogram of the values that is joined back.

    * ``histogram``: prefix sums over the distinct values in one task per ``by``
      value; volumes that sum to N have at most sqrt(2N) distinct values.
    * ``ranges``: prefix sums over ranges of values (see ``value_range``) and
      then over the values of each range, for values without such a bound: no
      task sees more than the ranges or the distinct values of one range.

    These read ``df`` twice: write it first, or let it be an aggregate whose
    counts are all ``counted``, so that both branches need the same columns and
    Spark shuffles (and scans) for them once. NULL and negative volumes have no rank in them.
    """
    by = list(by)
    if method == "window":
        w = Window.partitionBy(*by).orderBy(F.col(value).desc())
        return df.withColumn(out, F.rank().over(w).cast("long"))
    return _with_rank_of(df, _ranks_by_value(df, value, out, by, method, counted), value, by)


def _ranks_by_value(df: DataFrame, value: str, out: str, by: list[str] | tuple, method: str, counted: list[str] | tuple) -> DataFrame:
    """(by, value, rank)."""
    valid = [F.col(c) >= 0 for c in dict.fromkeys([value, *counted])]
    hist = df.where(reduce(and_, valid)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if method == "ranges":
        hist = hist.withColumn("_range", value_range(F.col(value)))
        ranges = hist.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
        ranges = ranges.select(*by, "_range", _sum_above("_in", by, "_range").alias("_above"))
        hist = hist.withColumn("_before", _sum_above("_n", [*by, "_range"], value)).join(ranges, [*by, "_range"])
    else:
        hist = hist.withColumn("_before", _sum_above("_n", by, value)).withColumn("_above", F.lit(0))
    return hist.select(*by, value, (F.lit(1) + F.col("_above") + F.col("_before")).cast("long").alias(out))


def _sum_above(count: str, by: list[str] | tuple, order: str) -> Column:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def _with_rank_of(df: DataFrame, ranks: DataFrame, value: str, by: list[str] | tuple) -> DataFrame:
    return df.join(ranks, on=[*by, value], how="left")


def with_ranks(df: DataFrame, by: list[str] | tuple = (), method: str = "window", counted: list[str] | tuple = ()) -> DataFrame:
    """Ranks by current and by prior volume, and how many places a row rose."""
    if method == "window":
        out = with_global_rank(df, "current_volume", "rank_current", by, method)
        out = with_global_rank(out, "prior_volume", "rank_prior", by, method)
    else:
        out = _with_rank_of(df, _ranks_by_value(df, "current_volume", "rank_current", by, method, counted), "current_volume", by)
        out = _with_rank_of(out, _ranks_by_value(df, "prior_volume", "rank_prior", by, method, counted), "prior_volume", by)
    return out.withColumn("rank_improved", F.col("rank_prior") - F.col("rank_current"))


def fmt_pct0(x: Column) -> Column:
    """Python ``f'{x:.0f}'``.

    Java's ``%.0f`` rounds the exact value half-up and keeps the sign of a
    negative value rounding to zero ("-0"), like Python, except on exact .5
    ties, where Python rounds half to even: those are formatted from
    ``bround(|x|)`` with the sign put back.
    """
    tie = x == (F.floor(x) + F.lit(0.5))
    tie_txt = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                       F.format_string("%.0f", F.bround(F.abs(x), 0)))
    return F.when(tie, tie_txt).otherwise(F.format_string("%.0f", x))


def product_takeaway(key: Column) -> Column:
    """One-line takeaway for an emerging product (needs the summary columns)."""
    cur, prior = F.col("current_volume"), F.col("prior_volume")
    growth = F.when(
        (prior > 0) & F.col("growth_ratio").isNotNull(),
        F.format_string("complaints up %s%% vs prior period (%d in current window)",
                        fmt_pct0(F.col("growth_pct")), cur),
    ).when((cur > 0) & (prior == 0),
           F.format_string("new spike in complaints this period (%d in current window)", cur))
    rank = F.when(F.col("rank_improved") > 0,
                  F.format_string("now #%d (was #%d)", F.col("rank_current"), F.col("rank_prior")))
    return F.concat_ws(" ", key.cast("string"), growth, rank, F.lit(TAKEAWAY_TAIL))


def topic_takeaway(label: Column) -> Column:
    prior, g = F.col("prior_volume"), F.col("growth_ratio")
    head = F.when(
        (prior > 0) & g.isNotNull(),
        F.concat(label, F.lit(" — complaints up "), fmt_pct0((g - F.lit(1.0)) * F.lit(100.0)),
                 F.lit("% vs prior period")),
    ).otherwise(F.concat(label, F.lit(" — new spike in narrative volume.")))
    return F.concat(head, F.lit(TOPIC_TAKEAWAY_TAIL))


def emerging_flag(growth_threshold: float, min_prior: int, top_n_rank: int) -> Column:
    """(growth >= t and prior >= min_prior) or (rank improved and rank <= n).

    A NULL ratio means "infinite" and passes the growth threshold.
    """
    g = F.col("growth_ratio")
    by_growth = (g.isNull() | (g >= F.lit(growth_threshold))) & (F.col("prior_volume") >= F.lit(min_prior))
    by_rank = (F.col("rank_improved") > 0) & (F.col("rank_current") <= F.lit(top_n_rank))
    return by_growth | by_rank


def emergence_order(key: str) -> list[Column]:
    """Growth desc (new first), volume desc, key asc."""
    return [F.col("growth_ratio").desc_nulls_first(), F.col("current_volume").desc(), F.col(key).asc()]
