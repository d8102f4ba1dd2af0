"""End-to-end batch pipeline on a complaint-shaped view of the documents table."""

import os
from dataclasses import replace

from pyspark.sql import functions as F

from upswell.config import IngestConfig
from upswell.plans.pipeline import PipelineConfig, run_pipeline, with_min_volumes
from upswell.sources.bindings import DOCUMENT_TAXONOMY, v4_documents_raw

SF = "/root/testdata/sf0.001"


def _raw(spark):
    d = v4_documents_raw(spark, SF)
    return d.select(
        "complaint_id",
        F.col("date_received").cast("string").alias("Date received"),
        F.concat(F.lit("Bank "), F.col("product")).alias("Company"),
        F.col("product").alias("Product"), F.col("issue").alias("Issue"),
        F.col("state").alias("State"),
        F.col("consumer_complaint_narrative").alias("Consumer complaint narrative"))


def test_pipeline_two_runs(spark, tmp_path):
    out = str(tmp_path / "out")
    base = PipelineConfig(ingest=IngestConfig(company_filter_pattern="bank src1", min_filtered_rows=0),
                          taxonomy=DOCUMENT_TAXONOMY, topics_k=4)
    cfg = with_min_volumes(base, 2, 1)
    cfg = replace(cfg, emergence=replace(cfg.emergence, persistence_min_runs=2))
    r1 = run_pipeline(spark, _raw(spark), out, cfg, run_id="1")
    assert r1["previous_run"] is None
    m = r1["manifest"]
    assert m["row_count_full"] == _raw(spark).count()
    kept = _raw(spark).filter(F.lower("Company").contains("bank src1")).count()
    assert m["row_count_filtered"] == kept
    p = r1["paths"]
    std = spark.read.parquet(p["complaints_standardized"])
    assert std.count() == kept and "canonical_product" in std.columns
    assert spark.read.parquet(p["narrative_topics"]).count() > 0
    assert spark.read.parquet(p["emerging_hierarchy"]).filter("level = 'lob'").count() >= 1
    hj = spark.read.json(os.path.join(p["emerging_hierarchy_json"], "run=1"))
    assert hj.count() == spark.read.parquet(p["emerging_hierarchy"]).count() and "computed_at" in hj.columns
    r2 = run_pipeline(spark, _raw(spark), out, cfg, run_id="2")
    assert r2["previous_run"].endswith("run=1")
    rec1 = spark.read.json(os.path.join(p["emerging"], "run=1"))
    rec2 = spark.read.json(os.path.join(p["emerging"], "run=2"))
    if rec2.count():
        prev = {r.product for r in rec1.select("product").collect()}
        assert all(r.persistent == (r.product in prev) for r in rec2.collect())
    status = spark.read.parquet(p["pipeline_status"])
    assert status.filter("stage = 'narratives'").count() == 2
