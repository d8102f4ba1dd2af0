"""Driver tables bound to complaint roles (the test inputs contain no complaints).

Each view is a lazy DataFrame with the complaint column names the operators
expect. Only ``nation`` (25 rows by definition) is hinted for broadcast; the
``part`` / ``supplier`` joins are left to Catalyst and AQE, which broadcast a
side only when its measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.functions.dates import max_timestamp, min_max_dates
from upswell.functions.text import has_text
from upswell.operators.taxonomy import Taxonomy, apply_taxonomy
from upswell.sources.tables import materialize, read_table, spread

# Taxonomy for the part-type view (V3); STANDARD stays unmapped.
PART_TAXONOMY = Taxonomy(
    canonical_products={"ECONOMY": "Value", "PROMO": "Value", "LARGE": "Bulk",
                        "MEDIUM": "Core", "SMALL": "Core"},
    product_line={"ECONOMY": "Economy line", "PROMO": "Promotions", "LARGE": "Large format",
                  "MEDIUM": "Mid format", "SMALL": "Small format"},
    issue_risk_type={"Brand#1": "operational", "Brand#2": "operational", "Brand#3": "operational",
                     "Brand#4": "operational", "Brand#5": "operational", "Brand#6": "pricing_dispute",
                     "Brand#7": "pricing_dispute", "Brand#8": "pricing_dispute", "Brand#9": "service",
                     "Brand#10": "service", "Brand#11": "fraud"},
    canonical_issues={"Brand#1": "Brand one", "Brand#2": "Brand two", "Brand#3": "Brand three",
                      "Brand#11": "Brand eleven"},
    default_line="General",
    default_risk="other",
)

# Taxonomy for the document view (V4); other sources -> 'Other'.
DOCUMENT_TAXONOMY = Taxonomy(
    canonical_products={"src0": "Alpha", "src1": "Alpha", "src2": "Alpha", "src3": "Alpha",
                        "src4": "Alpha", "src5": "Beta", "src6": "Beta", "src7": "Beta",
                        "src8": "Beta", "src9": "Beta", "src10": "Gamma", "src11": "Gamma",
                        "src12": "Gamma", "src13": "Gamma", "src14": "Gamma"},
    product_line={"src0": "Line A", "src1": "Line A", "src2": "Line B", "src5": "Line C",
                  "src6": "Line C", "src10": "Line D"},
    issue_risk_type={"bucket_0": "operational", "bucket_1": "operational", "bucket_2": "fraud",
                     "bucket_3": "service", "bucket_4": "pricing_dispute"},
    canonical_issues={"bucket_0": "Access", "bucket_1": "Billing", "bucket_2": "Fraud",
                      "bucket_3": "Service"},
    default_line="General",
    default_risk="other",
)

DOC_EPOCH = "2024-01-01"
DOC_DAYS = 150
OUTLIER_LABEL = 9


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part ⋈ supplier ⋈ nation, one row per line item."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    sup = read_table(spark, sf_dir, "supplier")
    nat = read_table(spark, sf_dir, "nation")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(sup, li.l_suppkey == sup.s_suppkey)
            .join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey))


def v1_emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: date=l_shipdate, product=p_name, issue=p_brand, state=n_name, company=s_name."""
    return lineitem_rows(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("date_received"),
        F.col("p_name").alias("product"),
        F.col("p_brand").alias("issue"),
        F.col("n_name").alias("state"),
        F.col("s_name").alias("company"),
    )


def v2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: lob=p_type, line=p_brand, issue=p_name."""
    return lineitem_rows(spark, sf_dir).select(
        F.col("l_shipdate").alias("date_received"),
        F.col("p_type").alias("canonical_product"),
        F.col("p_brand").alias("product_line"),
        F.col("p_name").alias("canonical_issue"),
    )


def v3_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: product=p_type, issue=p_brand, with the part taxonomy applied."""
    raw = lineitem_rows(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").alias("date_received"),
        F.col("p_type").alias("product"),
        F.col("p_brand").alias("issue"),
        F.col("p_name").alias("sub_product"),
        F.col("n_name").alias("state"),
        F.col("s_name").alias("company"),
    )
    return apply_taxonomy(raw, PART_TAXONOMY)


def doc_date(doc_id_col):
    return F.date_add(F.lit(DOC_EPOCH).cast("date"), (doc_id_col % F.lit(DOC_DAYS)).cast("int")) \
        .cast("timestamp_ntz")


def v4_documents_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: documents as narratives. Roles derived from doc_id (no row is dropped).

    ``upswell.text.partitions`` (a session setting, unset by default) deals the
    texts out over so many tasks, for files with fewer row groups than cores.
    """
    tasks = spark.conf.get("upswell.text.partitions", None)
    d = spread(read_table(spark, sf_dir, "documents"), int(tasks) if tasks else None)
    return d.select(
        F.col("doc_id").alias("complaint_id"),
        doc_date(F.col("doc_id")).alias("date_received"),
        F.col("source").alias("product"),
        F.concat(F.lit("bucket_"), (F.col("doc_id") % 7).cast("string")).alias("issue"),
        F.concat(F.lit("S"), F.lpad((F.col("doc_id") % 25).cast("string"), 2, "0")).alias("state"),
        F.col("lang").alias("sub_product"),
        F.col("text").alias("consumer_complaint_narrative"),
    )


def v4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_taxonomy(v4_documents_raw(spark, sf_dir), DOCUMENT_TAXONOMY)


def v5_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: topic assignments = embeddings.label on narrative rows (label 9 = outlier -1)."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("complaint_id"),
        F.when(F.col("label") == OUTLIER_LABEL, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("topic_id"))
    docs = v4_documents(spark, sf_dir).filter(has_text(F.col("consumer_complaint_narrative")))
    return emb.join(docs, "complaint_id").select(
        "complaint_id", "topic_id", "date_received", "canonical_product", "canonical_issue",
        "product", "issue", "product_line", "state", "consumer_complaint_narrative")


def v6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("complaint_id"), "embedding")


def v7_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("date_received"), F.col("event_type").alias("product"),
        F.col("user_id").cast("string").alias("state"), "value")


def v5_topics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 without the texts, written once (as the pipeline writes its topic
    table) for queries that read it several times."""
    return materialize(v5_topics(spark, sf_dir).drop("consumer_complaint_narrative"))


def newest_shipdate(spark: SparkSession, sf_dir: str):
    """Reference date of V1 to V3, from the bare fact table: one narrow scan before any join."""
    return max_timestamp(read_table(spark, sf_dir, "lineitem"), "l_shipdate")


def shipdate_bounds(spark: SparkSession, sf_dir: str):
    """Oldest and newest day of V1 to V3, from the bare fact table."""
    return min_max_dates(read_table(spark, sf_dir, "lineitem"), "l_shipdate")
