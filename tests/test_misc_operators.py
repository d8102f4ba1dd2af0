"""Smaller operators: sinks/sources, status, encoder hook, stream dedupe, helpers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from upswell.config import IngestConfig
from upswell.functions.text import has_text, safe_token
from upswell.operators.embed import embed_queries, embed_with
from upswell.operators.lineage import append_status
from upswell.operators.risk import risk_options
from upswell.operators.search import hybrid_search, valid_embeddings
from upswell.sources.files import read_previous_records, write_records_json
from upswell.streaming.incremental import ingest_stream


def test_text_helpers(spark):
    df = spark.createDataFrame([("Fees / interest!",), ("",), (None,), (" \t ",)], "s string")
    got = [tuple(r) for r in df.select(safe_token(F.col("s")), has_text(F.col("s"))).collect()]
    assert got == [("Fees___interest", True), ("issue", False), ("issue", False), ("issue", False)]


def test_records_json_roundtrip(spark, tmp_path):
    recs = spark.createDataFrame([("A", 1.5)], "product string, growth_ratio double")
    path = str(tmp_path / "run=1")
    write_records_json(recs, path)
    back = read_previous_records(spark, path)
    assert back is not None and {"product", "computed_at"} <= set(back.columns)
    assert read_previous_records(spark, str(tmp_path / "missing")) is None


def test_status_append(spark, tmp_path):
    path = str(tmp_path / "status")
    append_status(spark, path, "analysis", "success", 1.234)
    append_status(spark, path, "analysis", "failure", 2.0)
    rows = spark.read.parquet(path).orderBy("duration_seconds").collect()
    assert [(r.status, r.duration_seconds) for r in rows] == [("success", 1.23), ("failure", 2.0)]


def test_risk_options_label(spark):
    risk = spark.createDataFrame([("Card", "Fees", "elevated", 0.456)] * 2,
                                 "canonical_product string, canonical_issue string, risk_tier string, "
                                 "systemic_risk_score double")
    rows = risk_options(risk).collect()
    assert len(rows) == 1 and rows[0].label == "Card — Fees (tier elevated, score 0.46)"


def test_embeddings_keep_last_by_order(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [], 1)],
                                "complaint_id long, embedding array<float>, written int")
    got = {r.complaint_id: list(r.embedding) for r in valid_embeddings(emb, order_col="written").collect()}
    assert got == {1: [0.0, 1.0]}


def test_hybrid_dispatch(spark):
    docs = spark.createDataFrame([(1, "A", "late fee"), (2, "A", "other"), (3, "B", "fee")],
                                 "complaint_id long, canonical_product string, consumer_complaint_narrative string")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "complaint_id long, embedding array<float>")
    sem = hybrid_search(docs, emb, query_vector=[0.0, 1.0], top_k=1, canonical_product="A").collect()
    assert [r.complaint_id for r in sem] == [2]
    kw = hybrid_search(docs, emb, query_text="fee", canonical_product="A").collect()
    assert [r.complaint_id for r in kw] == [1]
    st = hybrid_search(docs, emb, canonical_product="A").collect()
    assert [r.complaint_id for r in st] == [1, 2]


def test_python_encoder_hook(spark):
    def load():  # defined here so it is shipped by value to the Python workers
        import zlib

        import numpy as np

        def encode(texts):
            out = np.zeros((len(texts), 8))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i, zlib.crc32(w.encode()) % 8] += 1.0
            return out
        return encode

    df = spark.createDataFrame([(1, "late fee late"), (2, ""), (3, "fee")], "complaint_id long, semantic_text string")
    rows = {r.complaint_id: np.array(r.embedding) for r in embed_with(df, load, 8).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and np.linalg.norm(rows[2]) == 0
    q = spark.createDataFrame([(9, " fee ")], "query_id long, query_text string")
    qv = embed_queries(q, load, 8).first()
    assert qv.query_id == 9 and np.allclose(np.array(qv.embedding), rows[3])


def test_taxonomy_lookup_of_any_size(spark):
    """One join path: many entries, columns that are there already, a raw value entered twice."""
    from upswell.operators.taxonomy import apply_taxonomy

    big = spark.range(60_000).select(F.lit("canonical_products").alias("map_name"), F.concat(F.lit("p"), "id").alias("raw"),
                                     F.concat(F.lit("c"), "id").alias("value"))
    df = spark.createDataFrame([(" p59999 ", "i", "old"), ("q", None, "old")], "product string, issue string, canonical_product string")
    got = {r.product: (r.canonical_product, r.product_line, r.canonical_issue) for r in apply_taxonomy(df, big).collect()}
    assert got == {" p59999 ": ("c59999", "Other", "i"), "q": ("Other", "Other", "")}
    with pytest.raises(Exception, match="several entries"):
        apply_taxonomy(df, big.union(big.limit(1))).collect()


def test_taxonomy_from_a_path(spark, tmp_path):
    from upswell.operators.taxonomy import Taxonomy, apply_taxonomy, read_taxonomy

    rows = "map_name,raw,value\ncanonical_products,Mortgage,Mortgage\nissue_risk_type,Fees or interest,pricing_dispute\nproduct_line,_default,Misc\n"
    (tmp_path / "t.csv").write_text(rows)
    df = spark.createDataFrame([("Mortgage", "Fees or interest")], "product string, issue string")
    want = ("Mortgage", "Misc", "pricing_dispute", "Fees or interest")
    assert tuple(apply_taxonomy(df, read_taxonomy(spark, str(tmp_path / "t.csv"))).first())[2:] == want
    Taxonomy(canonical_products={"Mortgage": "Mortgage"}).to_table(spark).write.parquet(str(tmp_path / "t.parquet"))
    assert apply_taxonomy(df, read_taxonomy(spark, str(tmp_path / "t.parquet"))).first().canonical_product == "Mortgage"


STREAM = "complaint_id long, `Date received` string, Company string, Product string, Issue string"


def _drop(spark, src, out, ck, rows, **kw):
    spark.createDataFrame(rows, STREAM).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.createDataFrame([], STREAM).schema).parquet(src)
    ingest_stream(stream, out, ck, IngestConfig(company_filter_pattern="Acme Trust"), **kw)


def test_stream_ingest_keeps_late_rows_and_drops_redelivered(spark, tmp_path):
    from upswell.operators.taxonomy import Taxonomy

    src, out, ck = (str(tmp_path / n) for n in ("drop", "clean", "ck"))
    june = [(i, f"2024-06-0{i}T10:00:00Z", "Acme Trust", "Mortgage", "I") for i in range(1, 6)]
    january = [(i, f"1/{i}/2024", "ACME TRUST NA", "Card", "J") for i in range(6, 11)]
    tax = Taxonomy(canonical_products={"Mortgage": "Home"})
    _drop(spark, src, out, ck, june + june[:2] + [(11, "2024-06-01", "Other Bank", "Card", "J")], taxonomy=tax)
    _drop(spark, src, out, ck, january + june[3:] + [(12, "no date", "Acme Trust", "Card", "J")], taxonomy=tax)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.complaint_id for r in rows) == [*range(1, 11), 12]
    assert {r.complaint_id for r in rows if r.date_received is None} == {12}
    assert {r.canonical_product for r in rows} == {"Home", "Other"}


def test_stream_ingest_needs_the_columns(spark, tmp_path):
    spark.createDataFrame([(1,)], "complaint_id long").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="lacks the columns"):
        ingest_stream(spark.readStream.schema("complaint_id long").parquet(str(tmp_path / "s")), str(tmp_path / "o"), str(tmp_path / "c"))


def test_empty_rollup_gives_an_empty_summary(spark):
    from upswell.config import EmergenceConfig
    from upswell.streaming.incremental import emerging_summary_from_daily

    empty = spark.createDataFrame([], "day date, product string, issue string, state string, complaints long")
    assert emerging_summary_from_daily(empty, EmergenceConfig()).count() == 0


def _by_month(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 5), "2024-01", "P", "I"), (dt.datetime(2024, 3, 9, 12), "2024-03", "P", "I"),
            (dt.datetime(2024, 3, 2), "2024-03", "Q", "I")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "date_received timestamp, month string, product string, issue string").write.partitionBy("month").parquet(path)
    return spark.read.parquet(path)


def test_max_timestamp_reads_newest_partition(spark, tmp_path):
    from upswell.functions.dates import max_timestamp

    t = _by_month(spark, tmp_path)
    assert max_timestamp(t, partition="month") == max_timestamp(t) == dt.datetime(2024, 3, 9, 12)
    other = spark.createDataFrame([(dt.datetime(2024, 3, 31), 3), (dt.datetime(2023, 12, 31), 12)], "date_received timestamp, month int")
    assert max_timestamp(other) == dt.datetime(2024, 3, 31)  # a column that happens to be called month


def test_windows_and_slices_prune_months(spark, tmp_path):
    from upswell.config import EmergenceConfig, SliceSpec
    from upswell.operators.emerging import emerging_summary
    from upswell.operators.report import slice_rows

    t = _by_month(spark, tmp_path)
    cfg = EmergenceConfig(partition_column="month", seasonality_window_days=5, time_window_days=5, prior_window_days=5)
    s = emerging_summary(t, cfg)
    assert "PartitionFilters: [isnotnull(month" in s._jdf.queryExecution().toString()
    assert {r.product for r in s.collect()} == {"P", "Q"} - {"P"}
    rows = slice_rows(t, SliceSpec(dt.date(2024, 3, 1), dt.date(2024, 3, 9)), partition="month")
    assert "PartitionFilters: [isnotnull(month" in rows._jdf.queryExecution().toString() and rows.count() == 2


DATES = {
    "2024-01-05T12:00:00-05:00": "2024-01-05 17:00:00", "2024-01-05T12:00:00Z": "2024-01-05 12:00:00",
    "2024-01-05T12:00:00.123456Z": "2024-01-05 12:00:00.123456", "2024-01-05 12:00": "2024-01-05 12:00:00", "1/5/2024": "2024-01-05 00:00:00",
    "20240105": "2024-01-05 00:00:00", "2024/01/05": "2024-01-05 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "5 January 2024": "2024-01-05 00:00:00",
    "01/05/24 13:01": "2024-01-05 13:01:00", "1/5/70": "1970-01-05 00:00:00", "1/5/2024 1:02:03": "2024-01-05 01:02:03",
    "01/05/2024 3:04 PM": "2024-01-05 15:04:00", "2024-01-05 3:04:05 PM": "2024-01-05 15:04:05", "2024-01-05 12:30 AM": "2024-01-05 00:30:00",
    "Mar. 3, 2024 12 PM": "2024-03-03 12:00:00", "5-Jan-2024 1:02:03.5 a.m.": "2024-01-05 01:02:03.5", "2024-01-05 13:00 PM": None,
    "05.01.2024": "2024-05-01 00:00:00", "25.01.2024": "2024-01-25 00:00:00", "Friday, January 5, 2024": "2024-01-05 00:00:00",
    "Fri 01/05/24 11pm": "2024-01-05 23:00:00", "2024-01-05T10:00:00 Europe/Amsterdam": "2024-01-05 09:00:00", "2024-01-05x": None,
    "01-05-2024": None, "Sunday": None,
    "2024-1-5": "2024-01-05 00:00:00", "13/13/2024": None, "junk": None, "": None, "T12:00": None, "2024-02-30": None, "Foo 5, 2024": None,
}


def test_lenient_dates(spark):
    from upswell.functions.dates import lenient_timestamp

    df = spark.createDataFrame([(k,) for k in DATES] + [(None,)], "s string")
    got = {r.s: r.t for r in df.select("s", lenient_timestamp(F.col("s")).cast("string").alias("t")).collect()}
    assert got == {**DATES, None: None}


def test_ingest_rejects_empty_input_and_counts_unparsed_dates(spark, tmp_path):
    from upswell.operators.ingest import ingest

    rows = [(1, "2024-01-01", "A", "P", "I"), (2, "when?", "A", "P", "I"), (3, "", "A", "P", "I")]
    m = ingest(spark.createDataFrame(rows, STREAM), str(tmp_path / "o"), IngestConfig(min_filtered_rows=0))
    assert (m["row_count_full"], m["unparsed_dates"], m["newest_date"][:10]) == (3, 1, "2024-01-01")
    with pytest.raises(ValueError, match="no rows"):
        ingest(spark.createDataFrame([], STREAM), str(tmp_path / "p"))


def test_literal_search_text_finds_itself(spark):
    from upswell.functions.text import icontains

    texts = ["C:\\source", "a.b*[c]", "100% (sure)", "x\\bY"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t in texts:
        assert [r.t for r in df.where(icontains(F.col("t"), t.upper(), literal=True)).collect()] == [t]


def test_risk_type_is_the_first_that_is_known(spark):
    from upswell.operators.risk import risk_signals

    rows = [(1, "P", "I", "A", "X", None), (2, "P", "I", "A", "X", "fraud"), (3, "P", "I", "A", "X", "service"), (4, "P", "J", "A", "Y", None)]
    df = spark.createDataFrame(rows, "complaint_id long, product string, issue string, canonical_product string, canonical_issue string, risk_type string")
    got = {r.canonical_issue: (r.risk_type, r.volume) for r in risk_signals(df).collect()}
    assert got == {"X": ("fraud", 3), "Y": (None, 1)}


def test_unreadable_tables_are_errors(spark, tmp_path):
    from upswell.sources.files import read_previous_records
    from upswell.sources.tables import read_or_empty, read_standardized, write_table
    from upswell.operators.taxonomy import Taxonomy

    schema = spark.createDataFrame([], "a long").schema
    assert read_or_empty(spark, str(tmp_path / "none"), schema).count() == 0 and read_previous_records(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad.parquet").write_text("this is not parquet")
    with pytest.raises(Exception):
        read_or_empty(spark, str(tmp_path / "bad.parquet"), schema).collect()
    write_table(spark.createDataFrame([("Mortgage", "I")], "product string, issue string"), str(tmp_path / "raw"))
    got = read_standardized(spark, str(tmp_path / "std"), str(tmp_path / "raw"), Taxonomy(canonical_products={"Mortgage": "Home"})).first()
    assert got.canonical_product == "Home"


def test_csv_export(spark, tmp_path):
    from upswell.operators.report import write_csv

    write_csv(spark.createDataFrame([(1, "a,b")], "i long, t string"), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).first().t == "a,b"


def test_tier_filter_and_corpus_counts(spark):
    from upswell.operators.risk import filter_tier
    from upswell.operators.semantic import corpus_counts

    risk = spark.createDataFrame([("a", "systemic"), ("b", "elevated")], "canonical_product string, risk_tier string")
    assert [r.canonical_product for r in filter_tier(risk, "elevated").collect()] == ["b"]
    assert filter_tier(risk, "All").count() == 2
    docs = spark.createDataFrame([(dt.datetime(2024, 1, 1), "text"), (dt.datetime(2024, 1, 2), "  "),
                                  (None, "x"), (dt.datetime(2024, 1, 3), None)],
                                 "date_received timestamp, consumer_complaint_narrative string")
    r = corpus_counts(docs).first()
    assert (r.complaints, r.with_narrative) == (3, 1)


def test_operators_accept_empty_input(spark):
    from upswell.operators import hierarchy, report, risk, semantic, topics

    schema = ("complaint_id long, date_received timestamp, product string, issue string, state string, "
              "canonical_product string, product_line string, canonical_issue string, risk_type string, "
              "consumer_complaint_narrative string, topic_id int")
    empty = spark.createDataFrame([], schema)
    assert hierarchy.hierarchy_summary(empty).count() == 0
    assert risk.risk_signals(empty).count() == 0
    assert semantic.semantic_text(empty).count() == 0
    spec = report.default_slice(empty)
    assert report.slice_kpis(empty, spec).first().complaints == 0
    assert report.issue_top(report.slice_rows(empty, spec)).count() == 0
    assert topics.topic_emergence(empty).count() == 0
    assert topics.topic_label_map(empty).count() == 0


def test_text_query_search_in_corpus_space(spark):
    from upswell.operators.embed import embed_query_texts, fit_corpus
    from upswell.operators.search import batch_semantic_search

    docs = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 1), "overdraft fee charged twice on my checking account"),
        (2, dt.datetime(2024, 1, 2), "mortgage escrow payment was misapplied"),
        (3, dt.datetime(2024, 1, 3), "credit report shows an account that is not mine")],
        "complaint_id long, date_received timestamp, consumer_complaint_narrative string")
    emb, enc = fit_corpus(docs, dim=64)
    q = spark.createDataFrame([(7, "escrow payment mortgage")], "query_id long, query_text string")
    qv = embed_query_texts(q, enc)
    top = batch_semantic_search(docs, emb, qv, top_k=1).collect()
    assert [(r.query_id, r.complaint_id) for r in top] == [(7, 2)]


def test_report_sort_column_and_drill(spark):
    from upswell.operators.report import drill, export_columns, top_values

    rows = [("P", "a"), ("P", "b"), ("P", "b"), ("Q", "c"), (None, "c"), ("Q", None)]
    df = spark.createDataFrame(rows, "product string, issue string")
    assert [r.issue for r in top_values(df, "issue", 2).collect()] == ["b", "c"]
    assert [r.issue for r in top_values(df, "issue", 2, sort_by="issue").collect()] == ["a", "b"]
    assert [r.issue for r in top_values(df, "issue", 2, sort_by="issue", descending=True).collect()] == ["c", "b"]
    assert sum(r.share_pct for r in top_values(df, "issue").collect()) == pytest.approx(100, abs=0.2)
    assert drill(df, "P", "b").count() == 2 and drill(df, "P").count() == 3 and drill(df).count() == 6
    assert export_columns(["z", "issue", "x", "state"], ["x", "y", "x"]) == ["x", "state", "issue", "z"]
