"""The batch pipeline as stage functions on one session (3.1, 3.2).

ingest -> standardize -> risk -> emergence (records, summary, hierarchy) ->
narratives (embeddings, topics, topic emergence). Each stage writes a table
that the next one reads back, so lineage is cut at every stage boundary and
a lost executor only replays its own stage. Emerging records go to a
run-dated folder; the newest earlier run is the "previous run" for
persistence (never read and overwrite the same path).
"""

from __future__ import annotations

import datetime as _dt
import os
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.config import EmergenceConfig, IngestConfig
from upswell.operators import emerging as E
from upswell.operators.embed import assign_topics, embed_corpus
from upswell.operators.hierarchy import hierarchy_summary
from upswell.operators.ingest import ingest
from upswell.operators.lineage import append_status
from upswell.operators.risk import risk_signals
from upswell.operators.taxonomy import COMPLAINT_TAXONOMY, Taxonomy, apply_taxonomy
from upswell.operators.topics import topic_emergence, topic_term_labels, topic_terms
from upswell.sources.files import read_previous_records, write_records_json
from upswell.sources.tables import write_table


@dataclass(frozen=True)
class PipelineConfig:
    ingest: IngestConfig = field(default_factory=IngestConfig)
    emergence: EmergenceConfig = field(default_factory=EmergenceConfig)
    taxonomy: Taxonomy = COMPLAINT_TAXONOMY
    narratives: bool = True
    topics_k: int = 10


def _paths(out: str) -> dict[str, str]:
    names = ("complaints", "complaints_standardized", "risk_signals", "emerging_summary", "emerging",
             "emerging_hierarchy", "emerging_hierarchy_json", "narrative_embeddings", "narrative_topics", "narrative_emerging",
             "pipeline_status", "manifest")
    return {n: os.path.join(out, n) for n in names}


def _list_runs(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(st.getPath().toString() for st in fs.listStatus(p)
                  if st.isDirectory() and st.getPath().getName().startswith("run="))


def run_pipeline(spark: SparkSession, raw: DataFrame, out: str, cfg: PipelineConfig = PipelineConfig(),
                 run_id: str | None = None, order_by: list[str] | None = None) -> dict:
    p = _paths(out)
    run_id = run_id or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    result: dict = {"run_id": run_id}

    t0 = time.time()
    manifest = ingest(raw, p["complaints"], cfg.ingest, order_by=order_by)
    spark.createDataFrame([manifest]).write.mode("append").json(p["manifest"])
    append_status(spark, p["pipeline_status"], "download", "success", time.time() - t0)
    result["manifest"] = manifest

    t0 = time.time()
    complaints = spark.read.parquet(p["complaints"])
    std = apply_taxonomy(complaints, cfg.taxonomy)
    write_table(std, p["complaints_standardized"], "month")
    std = spark.read.parquet(p["complaints_standardized"])
    append_status(spark, p["pipeline_status"], "standardize", "success", time.time() - t0)

    t0 = time.time()
    risk_signals(std, cfg.taxonomy).write.mode("overwrite").parquet(p["risk_signals"])
    append_status(spark, p["pipeline_status"], "risk", "success", time.time() - t0)

    t0 = time.time()
    cfg = replace(cfg, emergence=replace(cfg.emergence, partition_column="month"))
    newest = E.resolve_windows(std, cfg.emergence, None)
    ref = newest.end if newest else None
    previous_runs = [r for r in _list_runs(spark, p["emerging"]) if not r.rstrip("/").endswith(f"run={run_id}")]
    previous = read_previous_records(spark, previous_runs[-1]) if previous_runs else None
    records = E.emerging_products(std, cfg.emergence, reference_date=ref, previous=previous)
    write_records_json(records, os.path.join(p["emerging"], f"run={run_id}"))
    E.emerging_summary(std, cfg.emergence, reference_date=ref).write.mode("overwrite").parquet(p["emerging_summary"])
    hierarchy_summary(std, cfg.emergence, reference_date=ref).write.mode("overwrite").parquet(p["emerging_hierarchy"])
    write_records_json(spark.read.parquet(p["emerging_hierarchy"]),
                       os.path.join(p["emerging_hierarchy_json"], f"run={run_id}"))
    append_status(spark, p["pipeline_status"], "analysis", "success", time.time() - t0)
    result["previous_run"] = previous_runs[-1] if previous_runs else None

    if cfg.narratives and "consumer_complaint_narrative" in std.columns:
        t0 = time.time()
        embed_corpus(std).write.mode("overwrite").parquet(p["narrative_embeddings"])
        emb = spark.read.parquet(p["narrative_embeddings"])
        assigned = assign_topics(emb.filter(F.col("has_narrative")), k=cfg.topics_k)
        topics = assigned.join(std, "complaint_id").select(
            "complaint_id", "topic_id", "date_received",
            *[c for c in ("canonical_product", "canonical_issue", "product", "issue", "product_line",
                          "state", "consumer_complaint_narrative") if c in std.columns])
        topics.write.mode("overwrite").parquet(p["narrative_topics"])
        topics = spark.read.parquet(p["narrative_topics"])
        labels = topic_term_labels(topic_terms(topics))
        write_records_json(topic_emergence(topics, cfg.emergence, labels),
                           os.path.join(p["narrative_emerging"], f"run={run_id}"))
        append_status(spark, p["pipeline_status"], "narratives", "success", time.time() - t0)
    result["paths"] = p
    return result


def with_min_volumes(cfg: PipelineConfig, current: int, prior: int) -> PipelineConfig:
    return replace(cfg, emergence=replace(cfg.emergence, min_current_volume=current, min_prior_volume=prior))
