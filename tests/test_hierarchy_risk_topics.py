"""Hierarchy (E3), risk (N1/N2), topics (N5-N8, N12) fixtures and properties."""

import datetime as dt

from pyspark.sql import functions as F

from upswell.config import EmergenceConfig, SliceSpec
from upswell.operators.hierarchy import hierarchy_summary
from upswell.operators.risk import narrative_scores, risk_signals
from upswell.operators.taxonomy import Taxonomy
from upswell.operators.topics import (topic_drill, topic_emergence, topic_label_map, topic_terms)

REF = dt.datetime(2024, 6, 1)


def test_hierarchy_levels_and_null_keys(spark):
    rows = [(dt.datetime(2024, 5, 10), "Bank", "Deposits", "Fee"), (dt.datetime(2024, 5, 11), "Bank", None, "Fee"),
            (dt.datetime(2024, 4, 11), "Bank", "Deposits", "ATM"), (dt.datetime(2024, 5, 12), "Card", "Lending", None)]
    df = spark.createDataFrame(rows, "date_received timestamp, canonical_product string, product_line string, "
                                     "canonical_issue string")
    h = hierarchy_summary(df, reference_date=REF)
    got = {(r.level, r.name, r.parent): (r.current_volume, r.prior_volume) for r in h.collect()}
    assert got[("lob", "Bank", "root")] == (2, 1)
    assert got[("product_line", "Unspecified", "Bank")] == (1, 0)
    assert got[("issue", "Unspecified", "Lending")] == (1, 0)
    # every level sums to the same total
    tot = h.groupBy("level").agg(F.sum("current_volume").alias("c"), F.sum("prior_volume").alias("p")).collect()
    assert {(r.c, r.p) for r in tot} == {(3, 1)}
    ranks = {r.name: r.rank_current for r in h.filter(F.col("level") == "lob").collect()}
    assert ranks == {"Bank": 1, "Card": 2}


def test_hierarchy_equals_union_of_group_bys(spark):
    from upswell.sources.bindings import v2_hierarchy

    df = v2_hierarchy(spark, "/root/testdata/sf0.001")
    h = hierarchy_summary(df, EmergenceConfig())
    for level, keys in (("lob", ["canonical_product"]), ("product_line", ["canonical_product", "product_line"]),
                        ("issue", ["canonical_product", "product_line", "canonical_issue"])):
        sub = h.filter(F.col("level") == level)
        assert sub.count() == sub.select(*keys).distinct().count()
    lob_total = h.filter("level = 'lob'").agg(F.sum("current_volume")).first()[0]
    issue_total = h.filter("level = 'issue'").agg(F.sum("current_volume")).first()[0]
    assert lob_total == issue_total


def test_narrative_score_cases(spark):
    rows = [(1, None), (2, "   "), (3, "nothing to see"), (4, "This happened again and again."),
            (5, "I think my card was declined. I feel bad")]
    df = spark.createDataFrame(rows, "complaint_id long, consumer_complaint_narrative string")
    got = {r.complaint_id: (r.narrative_score, r.systemic_hits, r.individual_hits)
           for r in narrative_scores(df).collect()}
    assert got == {1: (0.0, 0, 0), 2: (0.5, 0, 0), 3: (0.5, 0, 0), 4: (0.667, 1, 0), 5: (0.167, 0, 2)}


def test_word_boundary_is_unicode_aware(spark):
    df = spark.createDataFrame([(1, "émany times"), (2, "many times"), (3, "MANY"), (4, "x_many")],
                               "complaint_id long, consumer_complaint_narrative string")
    got = {r.complaint_id: r.systemic_hits for r in narrative_scores(df).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_risk_composite(spark):
    tax = Taxonomy(canonical_products={"P": "LOB"}, issue_risk_type={"I": "operational"})
    rows = [(i, "P", "I", f"S{i % 3}", "again and again" if i < 2 else "fine") for i in range(4)]
    df = spark.createDataFrame(rows, "complaint_id long, product string, issue string, state string, "
                                     "consumer_complaint_narrative string")
    r = risk_signals(df, tax).first()
    mean = (0.667 * 2 + 0.5 * 2) / 4
    import math
    expected = round(0.35 * mean + 0.35 * 0.5 + 0.2 * (3 / 50) + 0.1 * (math.log(5) / max(math.log(5), 1)), 3)
    assert (r.volume, r.distinct_states, r.risk_type, r.risk_type_weight) == (4, 3, "operational", 0.5)
    assert abs(r.mean_narrative_systemic - mean) < 1e-12
    assert r.systemic_risk_score == expected and r.risk_tier == "elevated"


def _topics(spark):
    rows = []
    cid = 0
    for tid, cur, prior in ((0, 20, 0), (1, 12, 10), (2, 11, 4), (-1, 30, 1)):
        for n, day in ((cur, dt.datetime(2024, 5, 15)), (prior, dt.datetime(2024, 4, 15))):
            for _ in range(n):
                rows.append((cid, tid, day, "Fees", "Card", f"fee charge text {tid}"))
                cid += 1
    rows.append((cid, 0, dt.datetime(2024, 6, 1), "Fees", "Card", "newest"))
    return spark.createDataFrame(rows, "complaint_id long, topic_id int, date_received timestamp, "
                                       "canonical_issue string, canonical_product string, "
                                       "consumer_complaint_narrative string")


def test_topic_emergence_new_topic_first(spark):
    rec = topic_emergence(_topics(spark), EmergenceConfig()).collect()
    assert [r.topic_id for r in rec] == [0, 2]
    assert rec[0].growth_ratio is None and rec[0].topic_label == "Topic 0"
    assert rec[0].takeaway == "Topic 0 — new spike in narrative volume. Consider reviewing process and customer communications."
    assert rec[1].takeaway.startswith("Topic 2 — complaints up 175% vs prior period")


def test_topic_label_map_disambiguates(spark):
    labels = {r.topic_id: r.topic_label for r in topic_label_map(_topics(spark)).collect()}
    assert labels == {0: "Fees — Card (Topic 0)", 1: "Fees — Card (Topic 1)", 2: "Fees — Card (Topic 2)"}
    given = spark.createDataFrame([(1, "overdraft, fees")], "topic_id int, topic_label string")
    labels = {r.topic_id: r.topic_label for r in topic_label_map(_topics(spark), given).collect()}
    assert labels[1] == "overdraft, fees" and labels[0] == "Fees — Card (Topic 0)"


def test_topic_terms_prefers_distinctive_words(spark):
    t = topic_terms(_topics(spark))
    top = {r.topic_id: r.term for r in t.filter("term_rank = 1").collect()}
    assert top[0] == "0" or top[0] in ("newest", "fee", "charge", "text")
    assert set(top) == {0, 1, 2}


def test_topic_drill_falls_back_to_whole_topic(spark):
    t = _topics(spark)
    complaints = t.drop("topic_id")
    rec = topic_emergence(t, EmergenceConfig())
    spec = SliceSpec(dt.date(2024, 5, 1), dt.date(2024, 5, 31), lob="Nothing")
    out = topic_drill(t, complaints, rec, spec)
    counts = {r.narrative_topic_id: r.n for r in out.groupBy("narrative_topic_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 21, 2: 15}
    first = out.columns[:6]
    assert first == ["narrative_topic_id", "narrative_topic_label", "narrative_current_volume",
                     "narrative_prior_volume", "narrative_growth_ratio", "topic_issue_volume"]


def test_hierarchy_for_slice_respects_lob(spark):
    from upswell.operators.hierarchy import hierarchy_for_slice

    rows = [(dt.datetime(2024, 5, 20), "Bank", "Deposits", "Fee"), (dt.datetime(2024, 5, 21), "Card", "Lending", "APR")]
    df = spark.createDataFrame(rows, "date_received timestamp, canonical_product string, product_line string, "
                                     "canonical_issue string")
    spec = SliceSpec(dt.date(2024, 5, 17), dt.date(2024, 5, 31), lob="Card")
    lobs = {r.name for r in hierarchy_for_slice(df, spec).filter("level = 'lob'").collect()}
    assert lobs == {"Card"}
    lobs = {r.name for r in hierarchy_for_slice(df, spec, respect_lob=False).filter("level = 'lob'").collect()}
    assert lobs == {"Bank", "Card"}
