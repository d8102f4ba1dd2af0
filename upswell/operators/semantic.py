"""Semantic text per complaint (H6: P7, P8, X2-X4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.functions.dates import parse_date_column
from upswell.functions.text import clean_text

NARRATIVE = "consumer_complaint_narrative"

# Structured fields used, in order, when there is no narrative.
SEMANTIC_FALLBACK_FIELDS = (
    "canonical_product",
    "product",
    "product_line",
    "canonical_issue",
    "issue",
    "sub_product",
    "sub_issue",
    "company_response_to_consumer",
)
# Fixed value: text for a complaint with neither narrative nor fields.
SPARSE_TEXT = "Complaint with sparse structured details and no narrative text provided."


def semantic_text(df: DataFrame, narrative: str = NARRATIVE, date: str = "date_received") -> DataFrame:
    """Add has_narrative and semantic_text; rows without a date are dropped.

    semantic_text = the whitespace-collapsed narrative, else the non-empty
    fallback fields joined with ' | ', else a fixed sentence.
    """
    if date in df.columns:
        df = parse_date_column(df, date).filter(F.col(date).isNotNull())
    # Staged projections: the cleaned narrative is computed once and reused
    # (Spark does not share a sub-expression across CASE branches).
    narr = clean_text(F.col(narrative)) if narrative in df.columns else F.lit("")
    staged = df.withColumn("_narr", narr)
    has = F.col("_narr") != F.lit("")
    parts = [F.nullif(clean_text(F.col(c)), F.lit("")) for c in SEMANTIC_FALLBACK_FIELDS if c in df.columns]
    fallback = F.btrim(F.concat_ws(" | ", *parts), F.lit(" |")) if parts else F.lit("")
    # Both branches are already free of outer whitespace, so no final strip.
    staged = staged.withColumn("has_narrative", has).withColumn(
        "_t", F.when(F.col("has_narrative"), F.col("_narr")).otherwise(fallback))
    text = F.when(F.col("_t") == F.lit(""), F.lit(SPARSE_TEXT)).otherwise(F.col("_t"))
    return staged.withColumn("semantic_text", text).drop("_narr", "_t")


def corpus_counts(df: DataFrame, narrative: str = NARRATIVE, date: str = "date_received") -> DataFrame:
    """One row: dated complaints and how many carry a narrative."""
    from upswell.functions.text import has_text

    rows = parse_date_column(df, date).filter(F.col(date).isNotNull()) if date in df.columns else df
    has = has_text(F.col(narrative)) if narrative in df.columns else F.lit(False)
    return rows.agg(F.count(F.lit(1)).alias("complaints"), F.count_if(has).alias("with_narrative"))
