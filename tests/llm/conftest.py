import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rid string, part int, fp string, spans string, `a.b` string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) or (doc_id, text, lang) rows as documents, with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x", 1, None, "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def query(spark):
    """Rows of a registered query over sf0.01, by doc_id."""

    def run(name, *columns):
        import __spark_entry__

        rows = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").collect()
        return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}

    return run
