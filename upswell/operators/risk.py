"""Systemic-vs-individual risk per product x issue (H5: N1, N2, X13, X14, X18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.functions.phrases import INDIVIDUAL_PHRASES, SYSTEMIC_PHRASES, narrative_signals, score_from_diff
from upswell.operators.taxonomy import (COMPLAINT_TAXONOMY, DEFAULT_RISK_WEIGHT, RISK_TYPE_WEIGHTS,
                                        Taxonomy, apply_taxonomy)
from upswell.operators.windows import product_col
from upswell.sources.tables import materialize

NARRATIVE = "consumer_complaint_narrative"

RISK_SCHEMA = T.StructType([
    T.StructField("canonical_product", T.StringType()),
    T.StructField("canonical_issue", T.StringType()),
    T.StructField("volume", T.LongType()),
    T.StructField("distinct_states", T.LongType()),
    T.StructField("mean_narrative_systemic", T.DoubleType()),
    T.StructField("risk_type", T.StringType()),
    T.StructField("risk_type_weight", T.DoubleType()),
    T.StructField("systemic_risk_score", T.DoubleType()),
    T.StructField("risk_tier", T.StringType()),
])


def narrative_scores(df: DataFrame, text: str = NARRATIVE, systemic=SYSTEMIC_PHRASES,
                     individual=INDIVIDUAL_PHRASES) -> DataFrame:
    """Add narrative_score, systemic_hits, individual_hits."""
    if text not in df.columns:
        return df.select("*", F.lit(0.0).alias("narrative_score"), F.lit(0).cast("long").alias("systemic_hits"),
                         F.lit(0).cast("long").alias("individual_hits"))
    from upswell.functions.phrases import needs_stripped_text
    from upswell.functions.text import py_strip
    searched = F.col(text)
    staged = df
    if needs_stripped_text(tuple(systemic) + tuple(individual)):
        staged = df.withColumn("_stripped", py_strip(F.col(text)))  # projected once
        searched = F.col("_stripped")
    s, i = narrative_signals(searched, systemic, individual)
    empty = F.col(text).isNull() | (F.col(text) == F.lit(""))
    zero = F.lit(0).cast("long")
    # Hits are projected first, so each phrase search runs once per row.
    hits = staged.select(*[F.col(f"`{c}`") for c in df.columns],
                         F.when(empty, zero).otherwise(s).alias("systemic_hits"),
                         F.when(empty, zero).otherwise(i).alias("individual_hits"))
    score = F.when(empty, F.lit(0.0)).otherwise(
        score_from_diff(F.col("systemic_hits") - F.col("individual_hits")))
    return hits.select(*[F.col(f"`{c}`") for c in df.columns], score.alias("narrative_score"),
                       "systemic_hits", "individual_hits")


def risk_weight(risk_type):
    m = F.create_map(*[x for k, v in RISK_TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, risk_type), F.lit(DEFAULT_RISK_WEIGHT))


def risk_tier(score):
    return (F.when(score >= F.lit(0.5), F.lit("systemic"))
            .when(score >= F.lit(0.35), F.lit("elevated")).otherwise(F.lit("individual")))


def risk_signals(df: DataFrame, taxonomy: Taxonomy = COMPLAINT_TAXONOMY, systemic=SYSTEMIC_PHRASES,
                 individual=INDIVIDUAL_PHRASES, order_col: str = "complaint_id",
                 text: str = NARRATIVE) -> DataFrame:
    """Score every (canonical_product, canonical_issue) bucket of ``df`` (all rows
    given; slicing is the caller's job).

    score = clip(0.35 mean narrative score + 0.35 risk-type weight
                 + 0.2 min(states/50, 1) + 0.1 ln(1+v)/max(ln(1+v_max), 1), 0, 1)
    rounded half-even to 3 decimals; tiers at 0.5 and 0.35.
    """
    if not {"product", "issue"} <= set(df.columns):
        return df.sparkSession.createDataFrame([], RISK_SCHEMA)
    if not {"risk_type", product_col(df)} <= set(df.columns) or product_col(df) == "product":
        df = apply_taxonomy(df, taxonomy)
    scored = narrative_scores(df, text, systemic, individual)
    # Scores are multiples of 1/6 rounded to 3 decimals: sum them as integers
    # (thousandths) so the mean does not depend on summation order.
    milli = F.round(F.col("narrative_score") * F.lit(1000.0)).cast("long")
    bucket = ["canonical_product", "canonical_issue"]
    state = F.col("state").cast("string") if "state" in df.columns else F.lit(None).cast("string")
    first = F.col(order_col) if order_col in df.columns else F.lit(0)
    # One scan and one hash aggregate of fixed-width values; the rest rolls up its few groups.
    fine = scored.select(*bucket, F.col("risk_type"), state.alias("_state"), milli.alias("_m"), first.alias("_id")) \
        .groupBy(*bucket, "risk_type", "_state").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_m"), F.min("_id").alias("_id"))
    # The first row's risk type among rows that have one; NULL only where none has.
    known = F.when(F.col("risk_type").isNotNull(), F.struct("_id", "risk_type"))
    agg = materialize(fine.groupBy(*bucket).agg(
        F.sum("_n").alias("volume"), F.count_distinct("_state").alias("distinct_states"),
        F.sum("_m").alias("_milli"), F.min(known)["risk_type"].alias("risk_type")))  # a row for each bucket
    mean = F.col("_milli").cast("double") / (F.col("volume").cast("double") * F.lit(1000.0))
    vmax = agg.agg(F.max("volume")).scalar()
    vol_norm = F.log(F.lit(1.0) + F.col("volume").cast("double")) / \
        F.greatest(F.log(F.lit(1.0) + vmax.cast("double")), F.lit(1.0))
    state_norm = F.least(F.col("distinct_states").cast("double") / F.lit(50.0), F.lit(1.0))
    w = risk_weight(F.col("risk_type"))
    raw = (F.lit(0.35) * F.col("mean_narrative_systemic") + F.lit(0.35) * F.col("risk_type_weight")
           + F.lit(0.2) * state_norm + F.lit(0.1) * vol_norm)
    out = (agg.withColumn("mean_narrative_systemic", mean)
           .withColumn("risk_type_weight", w)
           .withColumn("systemic_risk_score", F.bround(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 3)))
    out = out.withColumn("risk_tier", risk_tier(F.col("systemic_risk_score")))
    return out.select(*[f.name for f in RISK_SCHEMA.fields])


def risk_tier_counts(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("buckets"),
                                         F.sum("volume").cast("long").alias("volume"))


def risk_options(risk: DataFrame) -> DataFrame:
    """Drill options: 'product — issue (tier t, score s)' (P16, U2)."""
    return risk.select("canonical_product", "canonical_issue", "risk_tier", "systemic_risk_score").distinct() \
        .withColumn("label", F.concat(F.col("canonical_product"), F.lit(" — "), F.col("canonical_issue"),
                                      F.lit(" (tier "), F.col("risk_tier"), F.lit(", score "),
                                      F.bround("systemic_risk_score", 2).cast("string"), F.lit(")")))


def filter_tier(risk: DataFrame, tier: str | None) -> DataFrame:
    """Rows of one risk tier; None or 'All' keeps every tier."""
    if tier is None or tier == "All":
        return risk
    return risk.filter(F.col("risk_tier").cast("string") == F.lit(tier))
