"""Every repeated group of the native operators' patterns over 100 000 rounds: no stack, right results."""

from pyspark.sql import functions as F

from upswell.llm import licenses, pii

N = 100_000
MAILS = ["a@b" + ".c" * N, "a@" + "b." * N + "com", "jo [at] x" + " [dot] yy" * N, "jo [at] " + "yy . " * N + "com", "é@" + "b." * N + "com"]


def test_personal_data(make_docs):
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(make_docs(list(enumerate(MAILS)))).collect()}
    assert found[0] == [("email", 0, len(MAILS[0]))] and found[1] == [("email", 0, len(MAILS[1]))]
    assert [s[0] for s in found[3]] == ["spelled_mail"] and ("mail_like", 0, len(MAILS[4])) in found[4]


NUMBERS = ["0" + " 12" * N, "+1" + " 2" * N, "DE12" + " ABCD" * N, "1" + ".1" * N, "1" + ",111" * N, "(0123) " + "45 " * N]


def test_numbers(make_docs):
    docs = make_docs(list(enumerate(NUMBERS)))
    found = docs.select("doc_id", F.size(pii.base_spans(F.col("text"), F.lit(True))), F.size(pii.proposals(F.col("text"), F.lit(True)))).collect()
    assert {r[0]: r[1] for r in found} == {0: 0, 1: 0, 2: 0, 3: (N + 1) // 4, 4: 0, 5: 0} and all(r[2] > 0 for r in found if r[0] != 4)


def test_evidence_patterns(spark):
    texts = spark.createDataFrame([(t,) for t in [*MAILS, NUMBERS[0], NUMBERS[4]]], "t string")
    patterns = (pii._SPELLED, pii._FOREIGN_MAIL, pii._NATIONAL, pii._CALLS, pii._DATE, pii._COUNTED, pii._QUAD, pii._AMOUNT)
    assert len(texts.select(*[F.col("t").rlike(p) for p in patterns]).collect()) == len(MAILS) + 2


def test_licenses(make_docs):
    texts = ["SPDX-License-Identifier: MIT" + " OR MIT" * N, "SPDX-License-Identifier: (MIT" + " OR MIT" * N + ")", "Licensed under CC BY" + "-NC" * N,
             "neither the name of " + "x " * N + "may be used to endorse or promote products", "GNU general public license " + "x " * N + "version 2",
             "* All rights reserved.\n" * 2000, "licensed under " * N]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    assert len(found) == len(texts)
    assert found[0]["sentence_ids"][0].startswith("spdx:mit-or-mit") and len(found[0]["licenses"]) == 1 and found[1]["licenses"] == found[0]["licenses"]
    assert found[2]["licenses"][0].startswith("CC-BY-NC-NC") and found[5]["licenses"] == ["all-rights-reserved"]
