"""Ingest (H1) and taxonomy (H2) fixtures."""

import os

from upswell.config import IngestConfig
from upswell.operators.ingest import (REQUIRED_COLUMNS, clean, company_filter, dedupe_keep_first,
                                      ingest, missing_columns, normalize_columns)
from upswell.operators.taxonomy import (COMPLAINT_TAXONOMY, Taxonomy, apply_taxonomy)
from upswell.sources.files import read_complaints_csv


def test_normalize_headers(spark):
    df = spark.createDataFrame([("2024-01-01", "X", "P", "I")], ["Date received", "Company", "Product", "Issue"])
    assert normalize_columns(df).columns == ["date_received", "company", "product", "issue"]
    odd = spark.createDataFrame([(1, 2, 3)], ["Sub-product", " Timely response? ", "Consumer complaint narrative"])
    assert normalize_columns(odd).columns == ["sub_product", "timely_response?", "consumer_complaint_narrative"]


def test_required_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "X", "P", "I")], ["Date received", "Company", "Product", "Issue"])
    assert missing_columns(normalize_columns(df)) == []
    assert set(REQUIRED_COLUMNS) == {"date_received", "company", "product", "issue"}
    assert missing_columns(df.drop("Issue").toDF("date_received", "company", "product")) == ["issue"]


def test_company_filter_case_insensitive(spark):
    rows = [("Acme Trust Bank", "A", "X"), ("ACME TRUST COMPANY", "B", "Y"), ("Other Bank", "C", "Z"),
            ("Acme Trust", "D", "W"), (None, "E", "V")]
    df = spark.createDataFrame(rows, "company string, product string, issue string")
    assert sorted(r.product for r in company_filter(df, "Acme Trust").collect()) == ["A", "B", "D"]


def test_csv_integration(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "complaints.csv")
    with open(p, "w") as f:
        f.write("Date received,Company,Product,Issue,Consumer complaint narrative,State\n")
        f.write('2024-01-01,Acme Trust Bank,Mortgage,Loan mod,"Line one\nline two",N/A\n')
        f.write("2024-01-02,Other Bank,Checking,Fee,,CA\n")
    raw = read_complaints_csv(spark, p)
    assert raw.count() == 2
    out = clean(raw, IngestConfig(company_filter_pattern="Acme Trust")).collect()
    assert len(out) == 1 and out[0].product == "Mortgage" and out[0].state is None
    assert out[0].consumer_complaint_narrative == "Line one\nline two"


def test_missing_tokens_become_null(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d,e,f\nN/A,NA,None,null,nan,ok\n")
    r = read_complaints_csv(spark, p, normalize=False).first()
    assert list(r) == [None, None, None, None, None, "ok"]


def test_dedupe_keeps_first_nulls_equal(spark):
    rows = [(2, "2024-01-01", "P", None, "x"), (1, "2024-01-01", "P", None, "x"), (3, "2024-01-02", "P", "I", "y")]
    df = spark.createDataFrame(rows, "rid long, date_received string, product string, issue string, n string")
    out = dedupe_keep_first(df, ["date_received", "product", "issue", "n"], order_by=["rid"]).collect()
    assert sorted(r.rid for r in out) == [1, 3]
    assert out[0].__fields__ == df.columns


def test_ingest_writes_and_counts(spark, tmpdir_path):
    rows = [("2024-01-01", "Acme Trust", "Mortgage", "I", 1), ("2024-01-01", "Acme Trust", "Mortgage", "I", 1),
            ("2024-02-01", "Other", "Card", "J", 2)]
    raw = spark.createDataFrame(rows, "`Date received` string, Company string, Product string, Issue string, "
                                      "complaint_id long")
    m = ingest(raw, os.path.join(tmpdir_path, "out"), IngestConfig(company_filter_pattern="Acme Trust", min_filtered_rows=0))
    assert (m["row_count_full"], m["row_count_filtered"]) == (3, 1)
    back = spark.read.parquet(os.path.join(tmpdir_path, "out"))
    assert back.count() == 1 and "month" in back.columns


def test_taxonomy_rules(spark):
    rows = [("Foo", None), ("Mortgage", "Foo"), (" Mortgage ", "Fees or interest"),
            ("Credit card", "Managing an account")]
    df = spark.createDataFrame(rows, "product string, issue string")
    got = [(r.canonical_product, r.product_line, r.risk_type, r.canonical_issue)
           for r in apply_taxonomy(df, COMPLAINT_TAXONOMY).collect()]
    assert got == [("Other", "Other", "other", ""), ("Mortgage", "Mortgage", "other", "Foo"),
                   ("Mortgage", "Mortgage", "pricing_dispute", "Fees or interest"),
                   ("Credit Card", "Card lending", "operational", "Account management")]


def test_taxonomy_from_mapping(spark):
    tax = Taxonomy.from_mapping({
        "canonical_products": {"Mortgage": "Mortgage"},
        "product_line": {"Mortgage": "Home", "_default": "Misc"},
        "issue_risk_type": {"Fees or interest": "pricing_dispute", "_default": "other"},
        "canonical_issues": {"_default": None},
    })
    df = spark.createDataFrame([("Mortgage", "Fees or interest"), ("X", None)], "product string, issue string")
    a = sorted(map(str, apply_taxonomy(df, tax).collect()))
    assert a == sorted(map(str, apply_taxonomy(df, tax.to_table(spark)).collect()))
    assert {r.product_line for r in apply_taxonomy(df, tax).collect()} == {"Home", "Misc"}
