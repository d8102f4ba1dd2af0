"""Registered queries over all of sf0.01 against plain single-process versions."""

import brute
import pytest


def test_exact_dedup(query, sf_docs):
    assert query("op6_exact_dedup", "keep_id", "group_size", "kept", "text_sha256") == brute.equal_groups(sf_docs)


def test_simhash(query, sf_docs):
    assert query("op4_simhash", "fingerprint", "component_id") == brute.near_groups(sf_docs)


def test_decontamination(query, sf_docs, spark):
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute.contamination(sf_docs, items)
    assert any(x[4] for x in expected.values())
    assert query("op1_decontaminate", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


def test_byte_bpe(query, sf_docs):
    assert query("op7_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe_digests(sf_docs)


def test_id_files(query, sf_docs):
    assert query("op8_id_files", "start", "n_tokens", "ids_crc32") == brute.id_files(sf_docs)


def test_secrets(query, sf_docs):
    expected = {d: brute.secrets(t)[:4] for d, t in sf_docs}
    assert sum(x[0] + x[1] + x[2] for x in expected.values()) > 10
    assert query("op9_secrets", "n_assign", "n_access", "n_hex", "base_sha256") == expected


def test_personal_data(query, sf_docs):
    expected = {d: brute.personal(t) for d, t in sf_docs}
    assert all(sum(x[i] for x in expected.values()) > 0 for i in range(4))
    found = query("op10_personal_data", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert {d: x[:5] for d, x in found.items()} == {d: x[:5] for d, x in expected.items()}
    for d, x in found.items():  # base spans stay among all spans
        assert set(filter(None, expected[d][5].split(","))) <= set(x[5].split(","))


def test_language_id(query, spark):
    lang = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    found = query("op5_language_id", "held_out", "lang_pred", "score")
    import zlib

    assert {d: x[0] for d, x in found.items()} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in lang}
    held = [x[1] == lang[d] for d, x in found.items() if x[0]]
    assert sum(held) / len(held) > 0.98
    assert all(0 <= x[2] <= 1 for x in found.values())


def test_toxicity(query, spark):
    found = query("op3_toxicity", "toxic", "p_toxic")
    marks = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic").collect()}
    right = sum(found[d][0] == bool(y) for d, y in marks.items() if d in found)
    assert len(found) == 1000 and right / len(marks) > 0.93


def test_licenses(query, sf_docs):
    found = query("op2_licenses", "licenses")
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    for d, t in sf_docs:
        for line, name in lines.items():
            assert (line in t) == (name in found[d][0].split(",")), (d, line)


@pytest.fixture(scope="module")
def stage_rows(spark):
    """Every stage's input and output over sf0.01."""
    import corpus_pipeline
    from upswell.llm.common import shared_folder

    docs, out = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, f"test-{name}")
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline_stages(stage_rows, spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert [n for n, *_ in stage_rows] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    for name, before, after in stage_rows:
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        kept = sorted(r["doc_id"] for r in after.collect())
        if name == "language_id":
            assert kept == sorted(d for d, t in rows if any(c.isalpha() for c in t or ""))
        elif name == "exact_dedup":
            assert kept == sorted(d for d, x in brute.equal_groups(rows).items() if x[2])
        elif name == "near_dedup":
            assert kept == sorted(d for d, x in brute.near_groups(rows).items() if x[1] == d)
        elif name == "decontaminate":
            assert kept == sorted(d for d, x in brute.contamination(rows, items).items() if not x[4])
        else:
            found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()}
            assert found == brute.bpe_digests(rows)
        if name != "byte_bpe":
            assert after.schema == whole.schema


def test_pipeline_run_is_its_stages(stage_rows, spark):
    import corpus_pipeline

    rows = sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()))
    assert rows == sorted(map(tuple, stage_rows[-1][2].collect()))
