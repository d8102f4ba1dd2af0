"""Hierarchy summary (E3, A4, P13): LOB -> product line -> issue in one pass.

One leaf aggregate plus a ``GROUPING SETS`` roll-up replace three group-bys
and two outer joins per level; ``grouping_id()`` tells the level, never
``IS NULL``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.config import EmergenceConfig
from upswell.functions.dates import Windows, parse_date_column
from upswell.functions.growth import with_ranks
from upswell.functions.growth import ratio, growth_pct
from upswell.operators.emerging import resolve_windows
from upswell.operators.windows import issue_col, product_col
from upswell.sources.tables import materialize

UNSPECIFIED = "Unspecified"


def hierarchy_summary(df: DataFrame, cfg: EmergenceConfig = EmergenceConfig(),
                      reference_date: _dt.datetime | None = None, date: str = "date_received",
                      windows: Windows | None = None) -> DataFrame:
    pc, ic = product_col(df), issue_col(df)
    line = "product_line" if "product_line" in df.columns else None
    if date not in df.columns or pc not in df.columns or ic not in df.columns:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("level", T.StringType())]))
    df = parse_date_column(df, date)
    w = windows or resolve_windows(df, cfg, reference_date, date)
    keys = [pc] + ([line] if line else []) + [ic]
    if w is None:  # no dated rows: empty result with the output columns
        w = Windows.from_config(_dt.datetime(1970, 1, 1), cfg)
        df = df.limit(0)
    like = df.schema[date].dataType
    cur, prior, base = w.flags(F.col(date), like)
    # NULL keys are a real group, shown as 'Unspecified'.
    rows = w.rows(df, date, cfg.partition_column).select(
        cur.alias("_c"), prior.alias("_p"), base.alias("_b"),
        *[F.coalesce(F.col(k).cast("string"), F.lit(UNSPECIFIED)).alias(k) for k in keys])
    sets = [keys[:i] for i in range(1, len(keys) + 1)]
    # Aggregate at the leaf grain first (one pass over the rows, map-side
    # combined), then roll the leaf counts up: the grouping-set expansion
    # runs over leaf groups, not over raw rows. Counts are additive, so the
    # roll-up is exact.
    leaf = rows.groupBy(*keys).agg(
        F.count_if(F.col("_c")).alias("_cv"),
        F.count_if(F.col("_p")).alias("_pv"),
        F.count_if(F.col("_b")).alias("_bv"))
    g = leaf.groupingSets(sets, *keys).agg(
        F.sum("_cv").cast("long").alias("current_volume"),
        F.sum("_pv").cast("long").alias("prior_volume"),
        F.sum("_bv").cast("long").alias("baseline_volume"),
        F.grouping_id().alias("_gid"))
    n = len(keys)
    # grouping_id bit i (from the left) is 1 when key i is rolled up.
    level_of = {(1 << (n - 1 - i)) - 1: i for i in range(n)}  # depth index -> gid
    names = ["lob", "product_line", "issue"] if line else ["lob", "issue"]
    level = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    parent = F.lit(None).cast("string")
    for gid, depth in sorted(level_of.items()):
        cond = F.col("_gid") == F.lit(gid)
        level = F.when(cond, F.lit(names[depth])).otherwise(level)
        name = F.when(cond, F.col(keys[depth])).otherwise(name)
        parent = F.when(cond, F.lit("root") if depth == 0 else F.col(keys[depth - 1])).otherwise(parent)
    g = g.withColumn("level", level).withColumn("name", name).withColumn("parent", parent)
    g = g.withColumn("growth_ratio", ratio(F.col("current_volume"), F.col("prior_volume")))
    g = g.withColumn("growth_pct", growth_pct(F.col("growth_ratio")))
    # The roll-up is small but has a row for every issue: it is written once, and ranks come
    # from ranges of its volumes instead of a sort of a whole level in one task.
    g = with_ranks(materialize(g), by=["level"], method="ranges")
    return g.select("level", "name", "parent", *keys, "current_volume", "prior_volume",
                    "baseline_volume", "growth_ratio", "growth_pct", "rank_current", "rank_prior",
                    "rank_improved")


def hierarchy_for_slice(df: DataFrame, spec, cfg: EmergenceConfig = EmergenceConfig(),
                        respect_lob: bool = True, date: str = "date_received") -> DataFrame:
    """Hierarchy for a slice (E11), optionally restricted to the slice's LOB."""
    from upswell.operators.report import lob_filter

    rows = lob_filter(df, spec.lob) if respect_lob else df
    ref = _dt.datetime.combine(spec.end, _dt.time())
    return hierarchy_summary(rows, spec.emergence_config(cfg), reference_date=ref, date=date)
