"""Pruned search, versioned tables, and streams that start anew."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from upswell.config import IngestConfig, SearchConfig
from upswell.operators.pruned_search import build_cells, pruned_semantic_search
from upswell.operators.search import batch_semantic_search
from upswell.sources.versions import POINTER, current_version, drop_old_versions, publish, read_version, write_version
from upswell.streaming.incremental import KEY_BUCKETS, daily_counts_stream, held_keys, ingest_stream, read_daily


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around a few directions, of two sizes, with repeats, ties, an empty and a null one."""
    rng, rows = random.Random(4), []
    for i in range(600):
        base = [8.0 * (j == i % 5) for j in range(6)]
        rows.append((i, [b + rng.gauss(0, 0.3) for b in base]))
    rows += [(700 + i, [0.1 * i, 1.0]) for i in range(30)] + [(800 + i, [1.0] + [0.0] * 5) for i in range(40)] + [(900, []), (901, None)]
    return spark.createDataFrame(rows, "complaint_id long, embedding array<double>")


@pytest.mark.parametrize("n_cells, part", [(1, 10_000), (20, 10_000), (20, 15)])
def test_pruned_search_equals_scoring_all(spark, clustered, n_cells, part):
    cfg = SearchConfig(candidates_per_part=part, queries_per_block=7)
    docs = clustered.select("complaint_id").where("complaint_id % 9 <> 0")
    queries = clustered.where("complaint_id % 20 = 0 or complaint_id in (900, 901, 801)").select(F.col("complaint_id").alias("query_id"), "embedding")

    def rows(df):
        return sorted((r["query_id"], r["rank"], r["complaint_id"], r["similarity_score"]) for r in df.collect())

    found = rows(pruned_semantic_search(docs, clustered, queries, 7, n_cells=n_cells, cfg=cfg))
    assert found == rows(batch_semantic_search(docs, clustered, queries, 7)) and found
    share = pruned_semantic_search(docs, clustered, queries, 7, n_cells=n_cells, cfg=cfg, report=True).first()
    assert 0 < share["share"] <= 1 and (n_cells == 1 or share["share"] < 0.5)


def test_pruned_search_without_rows(spark, clustered):
    queries = clustered.select(F.col("complaint_id").alias("query_id"), "embedding")
    docs = clustered.select("complaint_id")
    assert pruned_semantic_search(docs, clustered, queries.limit(0)).count() == 0
    assert pruned_semantic_search(docs.limit(0), clustered, queries.where("query_id < 5")).count() == 0


def test_cells_hold_all_their_vectors(clustered):
    index = build_cells(clustered, n_cells=10)
    assert index.members.count() == 670 and index.cells.agg(F.sum("n")).first()[0] == 670
    bad = index.members.join(index.cells, F.col("_cell") == F.col("cell")).where("_distance > radius")
    assert bad.isEmpty()


def test_a_write_that_ends_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert current_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    write_version(spark.range(3).toDF("x"), path)
    held = read_version(spark, path)

    def fail(batches):
        yield from batches
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        write_version(spark.range(50).toDF("x").mapInPandas(fail, "x long"), path)
    assert sorted(r.x for r in read_version(spark, path).collect()) == [0, 1, 2]
    first = current_version(spark, path)
    write_version(read_version(spark, path).withColumn("month", F.lit("2024-01")), path, "month")  # made from itself
    assert read_version(spark, path).columns == ["x", "month"] and held.count() == 3
    assert drop_old_versions(spark, path, keep=0) == 2 and read_version(spark, path).count() == 3
    assert first != current_version(spark, path) and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(POINTER + "-")]
    write_version(spark.range(9).toDF("x"), path)
    assert read_version(spark, path).count() == 9
    publish(spark, path, current_version(spark, path).rsplit("/", 1)[1])
    assert read_version(spark, path).count() == 9


RAW = "complaint_id string, date_received string, product string, issue string, company string, state string"


def feed(spark, folder, ids):
    rows = [(str(i), f"2024-01-{1 + i % 28:02d}", f"P{i % 3}", "I", "Acme", "NY") for i in ids]
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(RAW).json(folder)


def test_streams_with_new_checkpoints_add_to_each_other(spark, tmp_path):
    out, keys = str(tmp_path / "out"), str(tmp_path / "daily")
    for n, ids in enumerate((range(5), range(5, 10), range(3, 12))):
        stream = feed(spark, str(tmp_path / f"in{n}"), ids)
        ingest_stream(stream, out, str(tmp_path / f"ck{n}"), IngestConfig(company_filter_pattern="Acme"))
        if n < 2:
            daily_counts_stream(stream, keys, str(tmp_path / f"dk{n}"), ["product"])
    assert sorted(int(r[0]) for r in spark.read.parquet(out).select("complaint_id").collect()) == list(range(12))
    assert read_daily(spark, keys, ["product"]).agg(F.sum("complaints")).first()[0] == 10


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    """The offsets of the first batch are kept but its commit is lost: it runs again, with the same rows."""
    out, ck = str(tmp_path / "out"), tmp_path / "ck"
    stream = feed(spark, str(tmp_path / "in"), range(6))
    ingest_stream(stream, out, str(ck), IngestConfig(company_filter_pattern="Acme"))
    for commit in (ck / "commits").iterdir():
        commit.unlink()
    ingest_stream(stream, out, str(ck), IngestConfig(company_filter_pattern="Acme"))
    assert sorted(int(r[0]) for r in spark.read.parquet(out).select("complaint_id").collect()) == list(range(6))
    assert json.loads((ck / "metadata").read_text())["id"] in str(list((tmp_path / "out").iterdir()))


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest_stream(feed(spark, str(tmp_path / "in"), range(400)), out, str(tmp_path / "ck"), IngestConfig(company_filter_pattern="Acme"))
    written = spark.read.parquet(f"{out}_keys")
    one = written.where("complaint_id = '7'").select("complaint_id", "_bucket")
    held = held_keys(spark, out, one, "complaint_id", "another")
    scan = held._jdf.queryExecution().executedPlan()
    assert held.where("complaint_id = '7'").count() == 1 and held.count() < 20
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", scan.toString()) and KEY_BUCKETS == 256
    assert held_keys(spark, out, one, "complaint_id", written.first()["_batch"]).isEmpty()
