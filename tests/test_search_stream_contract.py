"""Search, streaming and the driver contract (oracle parity on sf0.001)."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from upswell.operators.search import (batch_semantic_search, keyword_search, semantic_search,
                                      structured_search)
from upswell.streaming.incremental import daily_counts, daily_counts_stream, read_daily

SF = "/root/testdata/sf0.001"


def test_embedding_validity(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A")], "complaint_id long, canonical_product string")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.6, 0.8])],
                                "complaint_id long, embedding array<float>")
    got = semantic_search(docs, emb, [1.0, 0.0], 10).collect()
    assert [(r.complaint_id, r.similarity_score) for r in got] == [(1, 1.0), (3, 0.6)]
    assert [r.complaint_id for r in structured_search(docs, emb, 10, canonical_product="A").collect()] == [1, 2, 3]


def test_keyword_search_regex_any_column(spark):
    docs = spark.createDataFrame([(2, "Late FEE", "x"), (1, None, "fee waived"), (3, "ok", "ok")],
                                 "complaint_id long, consumer_complaint_narrative string, issue string")
    assert [r.complaint_id for r in keyword_search(docs, "fee", 10).collect()] == [1, 2]


def test_batch_search_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i,) for i in range(300)], "complaint_id long").repartition(5)
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)],
                                "complaint_id long, embedding array<float>")
    q = spark.createDataFrame([(100 + j, [float(x) for x in vecs[j * 7]]) for j in range(6)],
                              "query_id long, embedding array<float>")
    got = batch_semantic_search(docs, emb, q, top_k=5)
    v32 = vecs.astype(np.float32).astype(np.float64)
    for j in range(6):
        s = np.round(v32 @ v32[j * 7], 6)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        rows = got.filter(F.col("query_id") == 100 + j).orderBy("rank").collect()
        assert [r.complaint_id for r in rows] == want


def test_batch_search_deals_queries_and_candidates_out(spark):
    """Several blocks and parts, vectors of two sizes, a key with two vectors: the same as one block."""
    from upswell.config import SearchConfig

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i,) for i in range(120)], "complaint_id long")
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 3 else 5)]) for i in range(120)] + [(7, [9.0, 9.0, 9.0, 9.0])]
    emb = spark.createDataFrame(rows, "complaint_id long, embedding array<float>")
    q = spark.createDataFrame([(i, v) for i, v in rows[:30]], "query_id long, embedding array<float>")
    one = sorted(map(tuple, batch_semantic_search(docs, emb, q, 4).collect()))
    many = sorted(map(tuple, batch_semantic_search(docs, emb, q, 4, cfg=SearchConfig(queries_per_block=7, candidates_per_part=25)).collect()))
    assert one == many and len(one) == 120
    assert all(sum(r[0] == i and r[1] == 7 for r in one) <= 1 for i in range(30))


def test_stream_daily_counts_equal_batch(spark, tmp_path):
    from upswell.sources.bindings import v7_events

    ev = v7_events(spark, SF)
    batch = {(r.day, r.product): r.complaints for r in daily_counts(ev, ["product"]).collect()}
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    cut = ev.agg(F.expr("percentile_approx(unix_millis(cast(date_received as timestamp)), 0.5)")).first()[0]
    late = F.unix_millis(F.col("date_received").cast("timestamp")) < cut
    for part in (ev.where(~late), ev.where(late)):  # the older half comes last
        part.write.mode("append").parquet(src)
        daily_counts_stream(spark.readStream.schema(ev.schema).parquet(src), out, ck, ["product"])
    assert {(r.day, r.product): r.complaints for r in read_daily(spark, out, ["product"]).collect()} == batch


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _entry():
    import __spark_entry__ as e
    return e


@pytest.mark.parametrize("name", sorted(__import__("upswell.plans.contract", fromlist=["ORACLE"]).ORACLE))
def test_query_matches_oracle(spark, duck, name):
    e = _entry()
    sdf = e.queries()[name](spark, SF)
    rel = duck.execute(e.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    s_rows = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    d_rows = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in order) for r in rel.fetchall()), key=repr)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = _entry().entry(spark)
    assert df.count() >= 0 and "takeaway" in df.columns


def test_rows_only_queries_run(spark):
    e = _entry()
    from upswell.plans.contract import QUERIES

    for name in set(QUERIES) - set(e.oracle_sql()):
        assert e.queries()[name](spark, SF).count() > 0


def test_batch_search_asks_for_every_twentieth_vector(spark):
    import __spark_entry__ as e

    found = e.queries()["search_batch_topk_twentieth"](spark, SF).groupBy("query_id").count().collect()
    ids = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()
    assert sorted(map(tuple, found)) == sorted((r[0], 10) for r in ids) and len(ids) > 5


def test_python_worker_code_runs_outside_the_repo(tmp_path):
    """mapInPandas code must not need this package on the workers' path."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['search_batch_topk'](s, %r).count())\n" % (repo, SF))
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 50" in out.stdout, out.stderr[-2000:]
