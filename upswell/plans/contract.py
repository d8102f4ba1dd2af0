"""Contract queries: each operator of the inventory bound to the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the same parquet tables) are filled by the ``@query`` decorator.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.config import EmergenceConfig
from upswell.functions.dates import parse_date_column
from upswell.operators import emerging as E
from upswell.operators.windows import window_volumes
from upswell.functions import phrases as PH
from upswell.plans import sqlparts as S
from upswell.sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CFG = EmergenceConfig()


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- E1 family

@query("window_volumes", f"""
WITH {S.V1}, {S.summary_ctes('s', 'v1')}
SELECT * FROM s_v""")
def window_volumes_q(spark: SparkSession, sf: str) -> DataFrame:
    df = parse_date_column(B.v1_emergence(spark, sf))
    w = E.resolve_windows(df, CFG, B.newest_shipdate(spark, sf))
    rows = df.dropna(subset=["date_received", "product", "issue"])
    return window_volumes(rows, ["product"], w, state="state")


@query("emerging_summary", f"""
WITH {S.V1}, {S.summary_ctes('s', 'v1')}
SELECT * FROM s""")
def emerging_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return E.emerging_summary(B.v1_emergence(spark, sf), CFG, B.newest_shipdate(spark, sf))


@query("emerging_products", f"""
WITH {S.V1}, {S.summary_ctes('s', 'v1')}, {S.records_ctes('r', 's', 'v1')}
SELECT * FROM r""")
def emerging_products_q(spark: SparkSession, sf: str) -> DataFrame:
    return E.flatten_records(E.emerging_products(B.v1_emergence(spark, sf), CFG, B.newest_shipdate(spark, sf)))


@query("emerging_top_issues", f"""
WITH {S.V1}, {S.windows_cte('w', 'v1', 30, 30, 90)},
iss AS (
  SELECT product, issue, count(*) AS current_volume FROM v1, w
  WHERE date_received >= cs AND date_received < e AND product IS NOT NULL AND issue IS NOT NULL
  GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY current_volume DESC, issue ASC) AS issue_rank FROM iss)
SELECT product, issue, current_volume, issue_rank FROM rk WHERE issue_rank <= 5""")
def emerging_top_issues_q(spark: SparkSession, sf: str) -> DataFrame:
    df = parse_date_column(B.v1_emergence(spark, sf))
    w = E.resolve_windows(df, CFG, B.newest_shipdate(spark, sf))
    rows = df.dropna(subset=["date_received", "product", "issue"])
    return E.top_issues(E.issue_volumes(rows, w, "product", "issue"), CFG.top_issues_per_product)


@query("emerging_takeaway", f"""
WITH {S.V1}, {S.summary_ctes('s', 'v1')}
SELECT product, {S.takeaway_sql('product')} AS takeaway FROM s""")
def emerging_takeaway_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.functions.growth import product_takeaway

    s = E.emerging_summary(B.v1_emergence(spark, sf), CFG, B.newest_shipdate(spark, sf))
    return s.select("product", product_takeaway(F.col("product")).alias("takeaway"))


@query("emerging_persistence", f"""
WITH {S.V1}, {S.summary_ctes('p', 'v1', shift_days=30)}, {S.records_ctes('pr', 'p', 'v1')},
{S.summary_ctes('s', 'v1')}, {S.records_ctes('r', 's', 'v1', persistent='m.product IN (SELECT product FROM pr)')}
SELECT product, growth_ratio, current_volume, persistent FROM r""")
def emerging_persistence_q(spark: SparkSession, sf: str) -> DataFrame:
    """This run against the run one current window earlier."""
    from dataclasses import replace

    df = parse_date_column(B.v1_emergence(spark, sf))
    ref = B.newest_shipdate(spark, sf)
    previous = E.emerging_products(df, CFG, reference_date=ref - _dt.timedelta(days=CFG.time_window_days))
    cfg = replace(CFG, persistence_min_runs=2)
    rec = E.emerging_products(df, cfg, reference_date=ref, previous=previous)
    return rec.select("product", "growth_ratio", "current_volume", "persistent")


# ---------------------------------------------------------------- E3 hierarchy

def _hier_level_sql(level: str, keys: list[str], all_keys: list[str], name: str, parent: str) -> str:
    sel = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in all_keys)
    return (f"SELECT '{level}' AS level, {name} AS name, {parent} AS parent, {sel}, "
            "count(*) FILTER (WHERE date_received >= cs) AS current_volume, "
            "count(*) FILTER (WHERE date_received >= ps AND date_received < cs) AS prior_volume, "
            "count(*) FILTER (WHERE date_received < ps) AS baseline_volume "
            f"FROM hb, w GROUP BY {', '.join(keys)}")


def hierarchy_sql(src_cte: str, src: str, cur: int = 30, prior: int = 30, base: int = 90,
                  end_expr: str | None = None, extra_where: str = "") -> str:
    ks = ["canonical_product", "product_line", "canonical_issue"]
    levels = [
        _hier_level_sql("lob", ks[:1], ks, "canonical_product", "'root'"),
        _hier_level_sql("product_line", ks[:2], ks, "product_line", "canonical_product"),
        _hier_level_sql("issue", ks, ks, "canonical_issue", "product_line"),
    ]
    union = "\nUNION ALL\n".join(levels)
    return f"""
WITH {src_cte}, {S.windows_cte('w', src, cur, prior, base, end_expr=end_expr)},
hb AS (SELECT date_received, {', '.join(f"coalesce(CAST({k} AS VARCHAR), 'Unspecified') AS {k}" for k in ks)}
       FROM {src}, w WHERE date_received >= bs AND date_received < e {extra_where}),
u AS ({union}),
g AS (SELECT *, {S.ratio('current_volume', 'prior_volume')} AS growth_ratio,
             rank() OVER (PARTITION BY level ORDER BY current_volume DESC) AS rank_current,
             rank() OVER (PARTITION BY level ORDER BY prior_volume DESC) AS rank_prior FROM u)
SELECT level, name, parent, {', '.join(ks)}, current_volume, prior_volume, baseline_volume, growth_ratio,
       (growth_ratio - 1.0) * 100.0 AS growth_pct, rank_current, rank_prior,
       rank_prior - rank_current AS rank_improved
FROM g"""


@query("hierarchy_summary", hierarchy_sql(S.V2, "v2"))
def hierarchy_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.hierarchy import hierarchy_summary

    return hierarchy_summary(B.v2_hierarchy(spark, sf), CFG, B.newest_shipdate(spark, sf))


# ---------------------------------------------------------------- H2 taxonomy

TAX_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "product", "issue",
            "canonical_product", "product_line", "risk_type", "canonical_issue"]


@query("standardize_taxonomy", f"""
WITH {S.v3(B.PART_TAXONOMY)}
SELECT {', '.join(TAX_COLS)} FROM v3""")
def standardize_taxonomy_q(spark: SparkSession, sf: str) -> DataFrame:
    return B.v3_standardized(spark, sf).select(*TAX_COLS)


def share_sql(n: str = "complaints") -> str:
    return (f"round_even(CAST({n} AS DOUBLE) / CAST(sum({n}) OVER () AS DOUBLE) * CAST(100.0 AS DOUBLE), 1)")


@query("taxonomy_coverage", f"""
WITH {S.v3(B.PART_TAXONOMY)},
c AS (SELECT canonical_product, product_line, count(*) AS complaints FROM v3 GROUP BY 1, 2)
SELECT canonical_product, product_line, complaints, {share_sql()} AS share_pct FROM c""")
def taxonomy_coverage_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import value_counts

    return value_counts(B.v3_standardized(spark, sf), ["canonical_product", "product_line"])


# ---------------------------------------------------------------- H1 ingest

COMPANY_PATTERN = "supplier#0+[1-3]"
LINEITEM_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("company_regex_filter", f"""
WITH {S.V1}
SELECT l_orderkey, l_linenumber, company FROM v1
WHERE regexp_matches(company, '(?i){COMPANY_PATTERN}')""")
def company_regex_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.ingest import company_filter

    return company_filter(B.v1_emergence(spark, sf), COMPANY_PATTERN).select(
        "l_orderkey", "l_linenumber", "company")


@query("dedupe_keep_first", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY {', '.join(c + ' ASC NULLS FIRST' for c in LINEITEM_ORDER)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.ingest import dedupe_keep_first
    from upswell.sources.tables import read_table

    return dedupe_keep_first(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINEITEM_ORDER)


INGEST_ORDER = ["date_received", "product", "issue", "state", "company"]
INGEST_SQL_BODY = f"""{S.V1},
clean AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY {', '.join(c + ' ASC NULLS FIRST' for c in INGEST_ORDER)}) AS rn
    FROM v1 WHERE regexp_matches(company, '(?i){COMPANY_PATTERN}')) WHERE rn = 1)"""


def _raw_ingest_view(spark: SparkSession, sf: str) -> DataFrame:
    """V1 with CSV-style headers, as a download would deliver them."""
    v = B.v1_emergence(spark, sf)
    return v.select(F.col("l_orderkey"), F.col("l_linenumber"),
                    F.col("date_received").alias("Date Received"), F.col("company").alias("Company"),
                    F.col("product").alias("Product"), F.col("issue").alias("Issue"),
                    F.col("state").alias("State"))


def _ingest_cfg():
    from upswell.config import IngestConfig

    return IngestConfig(company_filter_pattern=COMPANY_PATTERN, dedup_subset=("l_orderkey", "l_linenumber"),
                        source_url="lineitem.parquet")


@query("ingest_clean", f"""
WITH {INGEST_SQL_BODY}
SELECT l_orderkey, l_linenumber, date_received, company, product, issue, state FROM clean""")
def ingest_clean_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.ingest import clean

    return clean(_raw_ingest_view(spark, sf), _ingest_cfg(), order_by=INGEST_ORDER)


@query("run_manifest", f"""
WITH {INGEST_SQL_BODY}
SELECT 'lineitem.parquet' AS source_url,
       (SELECT count(*) FROM v1) AS row_count_full, (SELECT count(*) FROM clean) AS row_count_filtered,
       (SELECT count(*) FROM clean) >= 100 AS meets_min_filtered_rows""")
def run_manifest_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.lineage import manifest_frame

    return manifest_frame(_raw_ingest_view(spark, sf), _ingest_cfg())


# ---------------------------------------------------------------- H5 risk / H6 text

# Phrase lists for the document binding: the default complaint phrases never
# occur in the invented prose, so the contract passes these (parameters).
DOC_SYSTEMIC = (r"\b(that|this)\b", r"\b(of\s+the|on\s+the|in\s+the)\b", r"\b(is|was)\s+the\b")
DOC_INDIVIDUAL = (r"\b(for\s+the|to\s+the)\b", r"\b(and|by)\s+that\b", r"\bare\s+of\b")

V4 = S.v4(B.DOCUMENT_TAXONOMY)


@query("narrative_score", f"""
WITH {V4}
SELECT complaint_id, {S.narrative_score_sql('consumer_complaint_narrative', DOC_SYSTEMIC, DOC_INDIVIDUAL)} FROM v4""")
def narrative_score_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.risk import narrative_scores

    d = B.v4_documents(spark, sf)
    return narrative_scores(d, systemic=DOC_SYSTEMIC, individual=DOC_INDIVIDUAL).select(
        "complaint_id", "narrative_score", "systemic_hits", "individual_hits")


@query("narrative_score_default_phrases", f"""
WITH {V4}
SELECT complaint_id, {S.narrative_score_sql('consumer_complaint_narrative', PH.SYSTEMIC_PHRASES, PH.INDIVIDUAL_PHRASES)} FROM v4""")
def narrative_score_default_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.risk import narrative_scores

    return narrative_scores(B.v4_documents(spark, sf)).select(
        "complaint_id", "narrative_score", "systemic_hits", "individual_hits")


def risk_sql(src: str) -> str:
    return f"""
sc AS (SELECT *, {S.narrative_score_sql('consumer_complaint_narrative', DOC_SYSTEMIC, DOC_INDIVIDUAL)} FROM {src}),
ag AS (SELECT canonical_product, canonical_issue, count(*) AS volume, count(DISTINCT state) AS distinct_states,
              CAST(sum(CAST(round(narrative_score * 1000.0) AS BIGINT)) AS DOUBLE) AS milli,
              arg_min(risk_type, complaint_id) AS risk_type
       FROM sc GROUP BY 1, 2),
ag2 AS (SELECT *, milli / (CAST(volume AS DOUBLE) * CAST(1000.0 AS DOUBLE)) AS mean_narrative_systemic,
               CASE risk_type WHEN 'operational' THEN 0.5 WHEN 'service' THEN 0.2 WHEN 'fraud' THEN 0.3
                    WHEN 'pricing_dispute' THEN 0.0 ELSE 0.1 END::DOUBLE AS risk_type_weight,
               max(volume) OVER () AS vmax FROM ag),
ag3 AS (SELECT *, round_even(greatest(least(
          CAST(0.35 AS DOUBLE) * mean_narrative_systemic + CAST(0.35 AS DOUBLE) * risk_type_weight
          + CAST(0.2 AS DOUBLE) * least(CAST(distinct_states AS DOUBLE) / CAST(50.0 AS DOUBLE), CAST(1.0 AS DOUBLE))
          + CAST(0.1 AS DOUBLE) * (ln(CAST(1.0 AS DOUBLE) + CAST(volume AS DOUBLE))
                                   / greatest(ln(CAST(1.0 AS DOUBLE) + CAST(vmax AS DOUBLE)), CAST(1.0 AS DOUBLE))),
          CAST(1.0 AS DOUBLE)), CAST(0.0 AS DOUBLE)), 3) AS systemic_risk_score FROM ag2),
risk AS (SELECT canonical_product, canonical_issue, volume, distinct_states, mean_narrative_systemic, risk_type,
                risk_type_weight, systemic_risk_score,
                CASE WHEN systemic_risk_score >= 0.5 THEN 'systemic' WHEN systemic_risk_score >= 0.35 THEN 'elevated'
                     ELSE 'individual' END AS risk_tier FROM ag3)"""


@query("risk_signals", f"""
WITH {V4}, {risk_sql('v4')}
SELECT * FROM risk""")
def risk_signals_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.risk import risk_signals

    return risk_signals(B.v4_documents(spark, sf), systemic=DOC_SYSTEMIC, individual=DOC_INDIVIDUAL)


@query("risk_tier_counts", f"""
WITH {V4}, {risk_sql('v4')}
SELECT risk_tier, count(*) AS buckets, CAST(sum(volume) AS BIGINT) AS volume FROM risk GROUP BY 1""")
def risk_tier_counts_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.risk import risk_signals, risk_tier_counts

    return risk_tier_counts(risk_signals(B.v4_documents(spark, sf), systemic=DOC_SYSTEMIC,
                                         individual=DOC_INDIVIDUAL))


def semantic_sql(src: str) -> str:
    fields = ["canonical_product", "product", "product_line", "canonical_issue", "issue", "sub_product"]
    parts = ", ".join(f"nullif({S.clean(f)}, '')" for f in fields)
    return f"""
st AS (SELECT *, {S.clean('consumer_complaint_narrative')} AS _narr,
              trim(concat_ws(' | ', {parts}), ' |') AS _fb FROM {src} WHERE date_received IS NOT NULL),
st2 AS (SELECT *, _narr <> '' AS has_narrative,
               {S.py_strip("CASE WHEN _narr <> '' THEN _narr ELSE _fb END")} AS _t FROM st),
sem AS (SELECT * EXCLUDE (_narr, _fb, _t),
               CASE WHEN _t = '' THEN 'Complaint with sparse structured details and no narrative text provided.'
                    ELSE _t END AS semantic_text FROM st2)"""


@query("semantic_text", f"""
WITH {V4}, {semantic_sql('v4')}
SELECT complaint_id, has_narrative, semantic_text FROM sem""")
def semantic_text_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.semantic import semantic_text

    return semantic_text(B.v4_documents(spark, sf)).select("complaint_id", "has_narrative", "semantic_text")


# ---------------------------------------------------------------- H7/H8 topics

TERMS_SQL = r"""
tok AS (SELECT topic_id, unnest(regexp_extract_all(lower(consumer_complaint_narrative), '[\pL\pN_]{2,}')) AS term FROM v5),
tf AS (SELECT topic_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
tot AS (SELECT topic_id, sum(tf) AS class_words FROM tf GROUP BY 1),
tot2 AS (SELECT *, floor(avg(class_words) OVER ()) AS avg_words FROM tot),
fr AS (SELECT term, sum(tf) AS term_freq FROM tf GROUP BY 1),
tsc AS (SELECT tf.topic_id, tf.term,
               (CAST(tf.tf AS DOUBLE) / CAST(tot2.class_words AS DOUBLE))
               * ln(CAST(1.0 AS DOUBLE) + CAST(tot2.avg_words AS DOUBLE) / CAST(fr.term_freq AS DOUBLE)) AS weight
        FROM tf JOIN tot2 ON tf.topic_id = tot2.topic_id JOIN fr ON tf.term = fr.term),
trk AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term ASC) AS term_rank
        FROM tsc WHERE topic_id >= 0),
terms AS (SELECT topic_id, term, weight, term_rank FROM trk WHERE term_rank <= 3),
tlab AS (SELECT topic_id, string_agg(term, ', ' ORDER BY term_rank) AS topic_label FROM terms GROUP BY 1)"""


def topic_emerging_sql(src: str, end_expr: str, days: int, name: str = "rec") -> str:
    take = ("CASE WHEN prior_volume > 0 AND growth_ratio IS NOT NULL THEN topic_label || ' — complaints up ' || "
            "printf('%.0f', (growth_ratio - 1.0) * 100.0) || '% vs prior period' "
            "ELSE topic_label || ' — new spike in narrative volume.' END || "
            "' Consider reviewing process and customer communications.'")
    return f"""
{name}_w AS (SELECT e, e - INTERVAL {days} DAY AS cs, e - INTERVAL {2 * days} DAY AS ps FROM (SELECT {end_expr} AS e)),
{name}_v AS (SELECT topic_id, count(*) FILTER (WHERE date_received >= cs) AS current_volume,
                    count(*) FILTER (WHERE date_received < cs) AS prior_volume
             FROM {src}, {name}_w WHERE topic_id >= 0 AND date_received >= ps AND date_received < e GROUP BY 1),
{name}_g AS (SELECT *, {S.ratio('current_volume', 'prior_volume')} AS growth_ratio,
                    rank() OVER (ORDER BY current_volume DESC) AS rank_current,
                    rank() OVER (ORDER BY prior_volume DESC) AS rank_prior FROM {name}_v),
{name}_e AS (SELECT * FROM {name}_g
             WHERE (growth_ratio IS NULL OR growth_ratio >= 1.5 OR (rank_prior - rank_current > 0 AND rank_current <= 5))
               AND current_volume >= 10
             ORDER BY growth_ratio DESC NULLS FIRST, current_volume DESC, topic_id ASC LIMIT 10),
{name}_l AS (SELECT m.*, coalesce(l.topic_label, 'Topic ' || CAST(m.topic_id AS VARCHAR)) AS topic_label
             FROM {name}_e m LEFT JOIN tlab l ON m.topic_id = l.topic_id),
{name} AS (SELECT topic_id, topic_label, current_volume, prior_volume, growth_ratio, {take} AS takeaway FROM {name}_l)"""


TOPIC_BASE = f"{V4}, {S.V5}, {TERMS_SQL}"
DOC_MAX_DAY = "(SELECT CAST(max(date_received) AS DATE) FROM v4)"
SLICE_DAYS = 45


def _topics_and_labels(spark: SparkSession, sf: str):
    from upswell.operators.topics import topic_term_labels, topic_terms

    return B.v5_topics_table(spark, sf), topic_term_labels(topic_terms(B.v5_topics(spark, sf)))


def _doc_slice(spark: SparkSession, sf: str, lob: str | None = None):
    from upswell.config import SliceSpec
    from upswell.functions.dates import min_max_dates

    _, hi = min_max_dates(B.v4_documents(spark, sf))
    return SliceSpec(hi - _dt.timedelta(days=SLICE_DAYS - 1), hi, lob)


@query("topic_terms", f"""
WITH {TOPIC_BASE}
SELECT topic_id, term, round_even(weight, 9) AS weight, term_rank FROM terms""")
def topic_terms_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.topics import topic_terms

    t = topic_terms(B.v5_topics(spark, sf))
    return t.withColumn("weight", F.bround("weight", 9))


@query("topic_emerging", f"""
WITH {TOPIC_BASE}, {topic_emerging_sql('v5', '(SELECT max(date_received) FROM v5)', 30)}
SELECT * FROM rec""")
def topic_emerging_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.topics import topic_emergence

    topics, labels = _topics_and_labels(spark, sf)
    return topic_emergence(topics, CFG, labels)


@query("topic_emerging_slice", f"""
WITH {TOPIC_BASE},
j AS (SELECT t.topic_id, c.complaint_id, c.date_received FROM v5 t JOIN v4 c ON t.complaint_id = c.complaint_id),
{topic_emerging_sql('j', f"CAST({DOC_MAX_DAY} + 1 AS TIMESTAMP)", SLICE_DAYS)}
SELECT * FROM rec""")
def topic_emerging_slice_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.topics import topic_emergence_slice

    topics, labels = _topics_and_labels(spark, sf)
    return topic_emergence_slice(topics, B.v4_documents(spark, sf), _doc_slice(spark, sf), CFG, labels)


def _mode_sql(col: str, out: str) -> str:
    v = S.py_strip(f"coalesce(CAST({col} AS VARCHAR), '')")
    return f"""{out} AS (SELECT topic_id, v AS {out} FROM (
    SELECT topic_id, v, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, v ASC) AS r
    FROM (SELECT topic_id, {v} AS v, count(*) AS n FROM v5 WHERE topic_id >= 0 GROUP BY 1, 2) WHERE v <> '')
  WHERE r = 1)"""


@query("topic_label_map", f"""
WITH {TOPIC_BASE}, {topic_emerging_sql('v5', '(SELECT max(date_received) FROM v5)', 30)},
{_mode_sql('canonical_issue', 'mi')}, {_mode_sql('canonical_product', 'mp')},
ids AS (SELECT DISTINCT topic_id FROM v5 WHERE topic_id >= 0),
giv AS (SELECT topic_id, max(""" + S.py_strip("topic_label") + """) AS topic_label FROM rec
        WHERE """ + S.py_strip("topic_label") + """ <> '' GROUP BY 1),
disp AS (SELECT ids.topic_id,
           coalesce((SELECT value FROM tax4 WHERE map_name = 'canonical_issues' AND raw = coalesce(mi.mi, '')), coalesce(mi.mi, '')) AS iv,
           coalesce((SELECT value FROM tax4 WHERE map_name = 'canonical_products' AND raw = coalesce(mp.mp, '')), coalesce(mp.mp, '')) AS pv
         FROM ids LEFT JOIN mi ON ids.topic_id = mi.topic_id LEFT JOIN mp ON ids.topic_id = mp.topic_id
         WHERE ids.topic_id NOT IN (SELECT topic_id FROM giv)),
inf AS (SELECT topic_id, CASE WHEN iv <> '' AND pv <> '' THEN iv || ' — ' || pv WHEN iv <> '' THEN iv
                              WHEN pv <> '' THEN pv END AS lab FROM disp),
inf2 AS (SELECT topic_id, lab, count(*) OVER (PARTITION BY lab) AS dup FROM inf WHERE lab IS NOT NULL)
SELECT topic_id, topic_label, 'given' AS label_source FROM giv
UNION ALL
SELECT topic_id, CASE WHEN dup > 1 THEN lab || ' (Topic ' || CAST(topic_id AS VARCHAR) || ')' ELSE lab END, 'inferred' FROM inf2""")
def topic_label_map_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.topics import topic_emergence, topic_label_map

    topics, labels = _topics_and_labels(spark, sf)
    given = topic_emergence(topics, CFG, labels)
    return topic_label_map(topics, given, B.DOCUMENT_TAXONOMY)


DRILL_LOB = "Alpha"
V4_COLS = ["complaint_id", "product", "issue", "state", "sub_product", "consumer_complaint_narrative",
           "canonical_product", "product_line", "risk_type", "canonical_issue"]


@query("topic_drill", f"""
WITH {TOPIC_BASE}, {topic_emerging_sql('v5', '(SELECT max(date_received) FROM v5)', 30)},
rws AS (SELECT t.topic_id, r.topic_label AS narrative_topic_label, r.current_volume AS narrative_current_volume,
               r.prior_volume AS narrative_prior_volume, c.*
        FROM v5 t JOIN rec r ON t.topic_id = r.topic_id JOIN v4 c ON t.complaint_id = c.complaint_id),
rws2 AS (SELECT *, coalesce(date_received >= CAST({DOC_MAX_DAY} - {SLICE_DAYS - 1} AS TIMESTAMP)
                           AND date_received < CAST({DOC_MAX_DAY} + 1 AS TIMESTAMP)
                           AND canonical_product = '{DRILL_LOB}', false) AS _in FROM rws),
pt AS (SELECT topic_id, count(*) FILTER (WHERE _in) AS n_in FROM rws2 GROUP BY 1),
kept AS (SELECT r.* EXCLUDE (_in) FROM rws2 r JOIN pt ON r.topic_id = pt.topic_id WHERE _in OR n_in = 0),
kv AS (SELECT topic_id, canonical_issue, count(*) AS topic_issue_volume FROM kept GROUP BY 1, 2)
SELECT k.topic_id AS narrative_topic_id, k.narrative_topic_label, k.narrative_current_volume,
       k.narrative_prior_volume,
       CASE WHEN k.narrative_prior_volume > 0 THEN CAST(k.narrative_current_volume AS DOUBLE) / CAST(k.narrative_prior_volume AS DOUBLE) END AS narrative_growth_ratio,
       kv.topic_issue_volume, k.topic_id, strftime(k.date_received, '%Y-%m-%d') AS date_received,
       {', '.join('k.' + c for c in V4_COLS)}
FROM kept k JOIN kv ON k.topic_id = kv.topic_id AND k.canonical_issue IS NOT DISTINCT FROM kv.canonical_issue""")
def topic_drill_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.topics import topic_drill, topic_emergence

    topics, labels = _topics_and_labels(spark, sf)
    rec = topic_emergence(topics, CFG, labels)
    return topic_drill(topics, B.v4_documents(spark, sf), rec, _doc_slice(spark, sf, DRILL_LOB))


# ---------------------------------------------------------------- H9 search

QUERY_VEC_IDS = (3, 17, 42, 99, 123)
SINGLE_QUERY_ID = 17
KEYWORD = "worthless"
SEARCH_OUT = ["complaint_id", "product", "issue", "canonical_product", "canonical_issue"]


@query("search_keyword", f"""
WITH {V4}
SELECT {', '.join(SEARCH_OUT)} FROM v4
WHERE {' OR '.join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '(?i){KEYWORD}'), false)" for c in ['consumer_complaint_narrative', 'issue', 'product', 'canonical_issue', 'canonical_product', 'sub_product'])}
ORDER BY complaint_id LIMIT 20""")
def search_keyword_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.search import keyword_search

    return keyword_search(B.v4_documents(spark, sf), KEYWORD, 20).select(*SEARCH_OUT)


@query("search_structured", f"""
WITH {V4}
SELECT complaint_id, canonical_product, canonical_issue FROM v4
WHERE canonical_product = 'Beta' AND canonical_issue = 'Billing'
  AND complaint_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)
ORDER BY complaint_id LIMIT 20""")
def search_structured_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.search import structured_search

    return structured_search(B.v4_documents(spark, sf), B.v6_embeddings(spark, sf), 20,
                             canonical_product="Beta", canonical_issue="Billing").select(
        "complaint_id", "canonical_product", "canonical_issue")


def _query_vector(spark: SparkSession, sf: str, vec_id: int):
    row = B.v6_embeddings(spark, sf).filter(F.col("complaint_id") == vec_id).select("embedding").first()
    return row[0]


@query("search_semantic_topk", f"""
WITH {V4}, q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {SINGLE_QUERY_ID})
SELECT c.complaint_id, c.canonical_product,
       round_even(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.qv AS DOUBLE[])), 6) AS similarity_score
FROM v4 c JOIN embeddings e ON c.complaint_id = e.vec_id, q
WHERE c.canonical_product = 'Alpha' AND len(e.embedding) = len(q.qv)
ORDER BY similarity_score DESC, c.complaint_id ASC LIMIT 20""")
def search_semantic_topk_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.search import semantic_search

    qv = _query_vector(spark, sf, SINGLE_QUERY_ID)
    return semantic_search(B.v4_documents(spark, sf), B.v6_embeddings(spark, sf), qv, 20,
                           canonical_product="Alpha").select("complaint_id", "canonical_product", "similarity_score")


@query("search_batch_topk", f"""
WITH {V4}, q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN {QUERY_VEC_IDS}),
s AS (SELECT q.query_id, c.complaint_id,
             round_even(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.qv AS DOUBLE[])), 6) AS similarity_score
      FROM v4 c JOIN embeddings e ON c.complaint_id = e.vec_id, q WHERE len(e.embedding) = len(q.qv)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, complaint_id ASC) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""")
def search_batch_topk_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.search import batch_semantic_search

    emb = B.v6_embeddings(spark, sf)
    queries = emb.filter(F.col("complaint_id").isin(*QUERY_VEC_IDS)).select(
        F.col("complaint_id").alias("query_id"), "embedding")
    return batch_semantic_search(B.v4_documents(spark, sf), emb, queries, 10)


@query("search_batch_topk_twentieth", f"""
WITH {V4}, q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, c.complaint_id,
             round_even(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.qv AS DOUBLE[])), 6) AS similarity_score
      FROM v4 c JOIN embeddings e ON c.complaint_id = e.vec_id, q WHERE len(e.embedding) = len(q.qv)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, complaint_id ASC) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""")
def search_batch_topk_twentieth_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.search import batch_semantic_search

    emb = B.v6_embeddings(spark, sf)
    queries = emb.filter(F.col("complaint_id") % 20 == 0).select(F.col("complaint_id").alias("query_id"), "embedding")
    return batch_semantic_search(B.v4_documents(spark, sf), emb, queries, 10)


@query("search_pruned_topk", ORACLE["search_batch_topk_twentieth"])
def search_pruned_topk_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.pruned_search import pruned_semantic_search

    emb = B.v6_embeddings(spark, sf)
    queries = emb.filter(F.col("complaint_id") % 20 == 0).select(F.col("complaint_id").alias("query_id"), "embedding")
    return pruned_semantic_search(B.v4_documents(spark, sf), emb, queries, 10)


@query("search_options", f"""
WITH {V4}
SELECT DISTINCT 'product' AS option_kind, canonical_product AS option_value FROM v4 WHERE canonical_product IS NOT NULL
UNION ALL
SELECT DISTINCT 'issue', canonical_issue FROM v4 WHERE canonical_issue IS NOT NULL""")
def search_options_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.search import search_options

    return search_options(B.v4_documents(spark, sf))


# ---------------------------------------------------------------- reports (default slice)

V3 = S.v3(B.PART_TAXONOMY)
V3_HI = "(SELECT CAST(max(date_received) AS DATE) FROM v3)"
SL = f"""sl AS (SELECT * FROM v3 WHERE date_received >= CAST({V3_HI} - 14 AS TIMESTAMP)
                                   AND date_received < CAST({V3_HI} + 1 AS TIMESTAMP))"""


def _v3_slice(spark: SparkSession, sf: str, days_back: int = 14, lob: str | None = None):
    from upswell.operators.report import default_slice, slice_rows

    v3 = B.v3_standardized(spark, sf)
    spec = default_slice(v3, days_back, lob, newest=B.shipdate_bounds(spark, sf)[1])
    return v3, spec, slice_rows(v3, spec)


@query("slice_kpis", f"""
WITH {V3}, {SL}
SELECT count(*) AS complaints, count(DISTINCT product) AS lines_of_business, count(DISTINCT state) AS regions,
       count(DISTINCT issue) AS distinct_issues, CAST(15 AS BIGINT) AS window_days,
       CAST({V3_HI} - 29 AS DATE) AS prior_start,
       CASE WHEN CAST({V3_HI} - 29 AS DATE) < (SELECT CAST(min(date_received) AS DATE) FROM v3)
            THEN 'Prior window partially outside data range; comparison may be understated.' ELSE '' END AS coverage_note
FROM sl""")
def slice_kpis_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import slice_kpis

    v3, spec, _ = _v3_slice(spark, sf)
    return slice_kpis(v3, spec, oldest=B.shipdate_bounds(spark, sf)[0])


@query("lob_breakdown", f"""
WITH {V3}, {SL}, c AS (SELECT canonical_product AS line_of_business, count(*) AS complaints FROM sl
                       WHERE canonical_product IS NOT NULL GROUP BY 1)
SELECT *, {share_sql()} AS share_pct FROM c""")
def lob_breakdown_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import lob_breakdown

    return lob_breakdown(_v3_slice(spark, sf)[2])


@query("line_breakdown", f"""
WITH {V3}, {SL}, c AS (SELECT canonical_product AS line_of_business, product_line, count(*) AS complaints FROM sl GROUP BY 1, 2)
SELECT *, {share_sql()} AS share_pct FROM c""")
def line_breakdown_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import line_breakdown

    return line_breakdown(_v3_slice(spark, sf)[2])


@query("issue_top20", f"""
WITH {V3}, {SL}, c AS (SELECT canonical_issue AS issue_label, count(*) AS complaints FROM sl
                       WHERE canonical_issue IS NOT NULL GROUP BY 1)
SELECT *, {share_sql()} AS share_pct FROM c ORDER BY complaints DESC, issue_label ASC LIMIT 20""")
def issue_top20_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import issue_top

    return issue_top(_v3_slice(spark, sf)[2], 20)


@query("region_top20", f"""
WITH {V3}, {SL},
c AS (SELECT coalesce(state, 'Unknown') AS state, count(*) AS complaints FROM sl GROUP BY 1),
t AS (SELECT *, {share_sql()} AS share_of_total FROM c ORDER BY complaints DESC, state ASC LIMIT 20)
SELECT *, {share_sql()} AS share_of_shown FROM t""")
def region_top20_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import region_top

    return region_top(_v3_slice(spark, sf)[2], 20)


@query("drill_export", f"""
WITH {V3}, {SL},
top AS (SELECT canonical_issue FROM sl GROUP BY 1 ORDER BY count(*) DESC, canonical_issue ASC LIMIT 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(date_received, '%Y-%m-%d') AS date_received,
       product, issue, sub_product, state, company, canonical_product, product_line, risk_type, canonical_issue
FROM sl WHERE canonical_issue IN (SELECT canonical_issue FROM top)""")
def drill_export_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import issue_top, prepare_export

    rows = _v3_slice(spark, sf)[2]
    top = issue_top(rows, 1).select(F.col("issue_label").alias("canonical_issue"))
    return prepare_export(rows.join(top, "canonical_issue", "left_semi"))


@query("weekly_volume", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS complaints,
       strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week
FROM events WHERE ts IS NOT NULL GROUP BY 1, 3""")
def weekly_volume_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import weekly_volume

    return weekly_volume(B.v7_events(spark, sf))


@query("daily_counts", """
SELECT CAST(ts AS DATE) AS day, event_type AS product, count(*) AS complaints
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def daily_counts_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.streaming.incremental import daily_counts

    return daily_counts(B.v7_events(spark, sf), ["product"])


@query("staleness", f"""
WITH {V4}, {S.V5}
SELECT CAST((SELECT max(date_received) FROM v4) AS DATE) AS complaints_max_date,
       CAST((SELECT max(date_received) FROM v4 WHERE {S.clean('consumer_complaint_narrative')} <> '') AS DATE) AS narrative_max_date,
       CAST((SELECT max(date_received) FROM v5) AS DATE) AS topics_max_date,
       coalesce(CAST((SELECT max(date_received) FROM v5) AS DATE) <
                CAST(coalesce((SELECT max(date_received) FROM v4 WHERE {S.clean('consumer_complaint_narrative')} <> ''),
                              (SELECT max(date_received) FROM v4)) AS DATE), true) AS stale""")
def staleness_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.lineage import staleness

    return staleness(B.v4_documents(spark, sf), B.v5_topics(spark, sf))


# ---------------------------------------------------------------- slice variants

E_SLICE_DAYS = 60
V1_HI = "(SELECT CAST(max(date_received) AS DATE) FROM v1)"
V2_HI = "(SELECT CAST(max(date_received) AS DATE) FROM v2)"


def _slice_spec(spark: SparkSession, sf: str, days: int, lob: str | None = None):
    from upswell.config import SliceSpec

    hi = B.shipdate_bounds(spark, sf)[1]
    return SliceSpec(hi - _dt.timedelta(days=days - 1), hi, lob)


@query("emerging_slice", f"""
WITH {S.V1}, {S.summary_ctes('s', 'v1', cur=E_SLICE_DAYS, prior=E_SLICE_DAYS, base=3 * E_SLICE_DAYS,
                               end_expr=f'CAST({V1_HI} AS TIMESTAMP)')}, {S.records_ctes('r', 's', 'v1')}
SELECT * FROM r""")
def emerging_slice_q(spark: SparkSession, sf: str) -> DataFrame:
    df = parse_date_column(B.v1_emergence(spark, sf))
    return E.flatten_records(E.emerging_for_slice(df, _slice_spec(spark, sf, E_SLICE_DAYS), CFG))


@query("hierarchy_slice", hierarchy_sql(S.V2, "v2", E_SLICE_DAYS, E_SLICE_DAYS, 3 * E_SLICE_DAYS,
                                        end_expr=f"CAST({V2_HI} AS TIMESTAMP)"))
def hierarchy_slice_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.hierarchy import hierarchy_for_slice

    df = parse_date_column(B.v2_hierarchy(spark, sf))
    return hierarchy_for_slice(df, _slice_spec(spark, sf, E_SLICE_DAYS), CFG)


RISK_LOB = "Beta"


@query("risk_slice", f"""
WITH {V4},
rs AS (SELECT * FROM v4 WHERE date_received >= CAST({DOC_MAX_DAY} - {SLICE_DAYS - 1} AS TIMESTAMP)
                          AND date_received < CAST({DOC_MAX_DAY} + 1 AS TIMESTAMP) AND canonical_product = '{RISK_LOB}'),
{risk_sql('rs')}
SELECT * FROM risk""")
def risk_slice_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.report import slice_rows
    from upswell.operators.risk import risk_signals

    docs = B.v4_documents(spark, sf)
    rows = slice_rows(docs, _doc_slice(spark, sf, RISK_LOB))
    return risk_signals(rows, systemic=DOC_SYSTEMIC, individual=DOC_INDIVIDUAL)


# ---------------------------------------------------------------- H6/H7 unsupervised (rows-only checks)

@query("embed_corpus")
def embed_corpus_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.embed import embed_corpus

    return embed_corpus(B.v4_documents(spark, sf))


@query("assign_topics")
def assign_topics_q(spark: SparkSession, sf: str) -> DataFrame:
    from upswell.operators.embed import assign_topics

    return assign_topics(B.v6_embeddings(spark, sf), k=9)


TOPIC_SIMILARITY, TOPIC_SIZE = 0.4, 3


@query("similarity_topics", f"""
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON list_dot_product(a.e, b.e) >= {TOPIC_SIMILARITY} - 1e-9
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), grouped AS (SELECT a AS complaint_id, min(b) AS g, count(*) AS topic_size FROM reach GROUP BY a)
SELECT complaint_id, CASE WHEN topic_size >= {TOPIC_SIZE} THEN g ELSE -1 END AS topic_id, topic_size FROM grouped""")
def similarity_topics_q(spark: SparkSession, sf: str) -> DataFrame:
    """Topics whose number is found from the vectors (N4): connected groups of cosine 0.4 or more, three rows or more."""
    from upswell.operators.topic_graph import similarity_topics

    return similarity_topics(B.v6_embeddings(spark, sf), TOPIC_SIMILARITY, TOPIC_SIZE, n_cells=32)


@query("emerging_summary_from_daily", ORACLE["emerging_summary"])
def emerging_summary_from_daily_q(spark: SparkSession, sf: str) -> DataFrame:
    """E1 from the (day, product, issue, state) rollup the incremental job keeps (ST2)."""
    from upswell.streaming.incremental import daily_rollup, emerging_summary_from_daily

    from upswell.sources.tables import materialize

    # The rollup is written once, as the incremental job keeps it, and only it is read after that.
    return emerging_summary_from_daily(materialize(daily_rollup(B.v1_emergence(spark, sf))), CFG)


@query("search_text_topk")
def search_text_topk_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage as a query text (N10) against all documents (N9, exact top-5)."""
    from upswell.operators.embed import embed_query_texts, fit_corpus
    from upswell.operators.search import batch_semantic_search
    from upswell.sources.tables import read_table

    docs = B.v4_documents(spark, sf)
    emb, encoder = fit_corpus(docs)
    queries = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                                       F.col("text").alias("query_text"))
    return batch_semantic_search(docs, emb, embed_query_texts(queries, encoder), top_k=5)


# ---------------------------------------------------------------- cases the plain bindings don't hold

DATE_TEXTS = ("%Y-%m-%d", "%m/%d/%Y", "%-m/%-d/%Y", "%Y%m%d", "%Y/%m/%d", "%b %-d, %Y", "%Y-%m-%d 12:00", "%Y-%m-%dT23:30:00-05:00",
              "%Y-%m-%dT12:00:00Z", "%Y-%m-%dT12:00:00.123456Z", "%m/%d/%y", "not a date %Y",
              "%-m/%-d/%Y 3:04 PM", "%A, %B %-d, %Y", "%m.%d.%Y")
_JAVA_DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "yyyy/MM/dd", "MMM d, yyyy", "yyyy-MM-dd' 12:00'", "yyyy-MM-dd'T23:30:00-05:00'",
               "yyyy-MM-dd'T12:00:00Z'", "yyyy-MM-dd'T12:00:00.123456Z'", "MM/dd/yy", "'not a date 'yyyy",
               "M/d/yyyy' 3:04 PM'", "EEEE, MMMM d, yyyy", "MM.dd.yyyy")


@query("parse_dates", f"""
SELECT CAST(l_orderkey % {len(DATE_TEXTS)} AS INTEGER) AS form,
       CASE l_orderkey % {len(DATE_TEXTS)} WHEN 7 THEN CAST(l_shipdate AS DATE) + 1 WHEN 11 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day,
       count(*) AS n_rows
FROM lineitem GROUP BY 1, 2""")
def parse_dates_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every ship date written in one of the accepted forms (one with an offset that passes midnight, one that is no date)."""
    from upswell.functions.dates import lenient_timestamp
    from upswell.sources.tables import read_table

    form = (F.col("l_orderkey") % len(_JAVA_DATES)).cast("int")
    texts = F.lit(None).cast("string")
    for i, fmt in enumerate(_JAVA_DATES):
        texts = F.when(form == i, F.date_format("l_shipdate", fmt)).otherwise(texts)
    li = read_table(spark, sf, "lineitem").select(form.alias("form"), texts.alias("text"))
    return li.groupBy("form", F.to_date(lenient_timestamp(F.col("text"))).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("standardize_taxonomy_lookup", f"""
WITH {S.V1},
types AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_type AS product, p.p_name AS issue
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT product, issue, 'Group ' || upper(product[1:1]) AS canonical_product,
       CASE WHEN product LIKE '%O%' THEN lower(product) || ' line' ELSE 'Rest' END AS product_line,
       'other' AS risk_type, trim(issue) AS canonical_issue, count(*) AS complaints
FROM types GROUP BY 1, 2, 3, 4, 5, 6""")
def standardize_taxonomy_lookup_q(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup table with an entry for every part type, applied to rows that have a canonical product already."""
    from upswell.operators.taxonomy import apply_taxonomy
    from upswell.sources.tables import read_table

    part = read_table(spark, sf, "part")
    types = part.select(F.col("p_type").alias("raw")).distinct()
    lookup = types.select(F.lit("canonical_products").alias("map_name"), "raw", F.concat(F.lit("Group "), F.upper(F.left("raw", F.lit(1)))).alias("value"))
    lookup = lookup.union(types.where(F.col("raw").contains("O")).select(F.lit("product_line"), "raw", F.concat(F.lower("raw"), F.lit(" line"))))
    lookup = lookup.union(spark.range(1).select(F.lit("product_line"), F.lit("_default"), F.lit("Rest")))
    rows = read_table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("product"), F.col("p_name").alias("issue"), F.lit("stale").alias("canonical_product"))
    cols = ["product", "issue", "canonical_product", "product_line", "risk_type", "canonical_issue"]
    return apply_taxonomy(rows, lookup).groupBy(*cols).agg(F.count(F.lit(1)).alias("complaints"))


# Phrases that the default lists look for, one for each document in turn; blank, tab-only and NULL narratives among them.
CASE_PHRASES = ("", " many customers were affected", " I think it was my fault", " multiple times, incorrectly", " i believe several people")


def _case_documents(spark: SparkSession, sf: str) -> DataFrame:
    n, i = len(CASE_PHRASES), F.col("complaint_id")
    phrase = F.element_at(F.array(*map(F.lit, CASE_PHRASES)), (i % n + 1).cast("int"))
    text = F.when(i % 13 == 0, None).when(i % 13 == 1, F.lit("")).when(i % 13 == 2, F.lit("\t \n")).otherwise(
        F.concat("consumer_complaint_narrative", phrase))
    blank = i % 26 == 13
    d = B.v4_documents(spark, sf).withColumn("consumer_complaint_narrative", text)
    for c in ("canonical_product", "product", "product_line", "canonical_issue", "issue", "sub_product"):
        d = d.withColumn(c, F.when(~blank, F.col(c)))
    return d.withColumn("risk_type", F.when(i % 3 != 0, F.col("risk_type")))


_CASE_TEXT = "CASE complaint_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(9) || ' ' || chr(10) ELSE consumer_complaint_narrative || " \
    f"[{', '.join(S.sql_str(x) for x in CASE_PHRASES)}][complaint_id % {len(CASE_PHRASES)} + 1] END"
_CASE_COLS = ", ".join(f"CASE WHEN complaint_id % 26 <> 13 THEN {c} END AS {c}" for c in
                       ("canonical_product", "product", "product_line", "canonical_issue", "issue", "sub_product"))
V4C = f"""{V4},
v4c AS (SELECT complaint_id, date_received, state, {_CASE_COLS}, CASE WHEN complaint_id % 3 <> 0 THEN risk_type END AS risk_type,
               {_CASE_TEXT} AS consumer_complaint_narrative FROM v4)"""


@query("narrative_score_cases", f"""
WITH {V4C}
SELECT complaint_id, {S.narrative_score_sql('consumer_complaint_narrative', PH.SYSTEMIC_PHRASES, PH.INDIVIDUAL_PHRASES)} FROM v4c""")
def narrative_score_cases_q(spark: SparkSession, sf: str) -> DataFrame:
    """Default phrase lists over narratives that hold their phrases, and over blank and absent ones."""
    from upswell.operators.risk import narrative_scores

    return narrative_scores(_case_documents(spark, sf)).select("complaint_id", "narrative_score", "systemic_hits", "individual_hits")


@query("semantic_text_cases", f"""
WITH {V4C}, {semantic_sql('v4c')}
SELECT complaint_id, has_narrative, semantic_text FROM sem""")
def semantic_text_cases_q(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a narrative fall back to their fields, and to the fixed sentence where these are absent too."""
    from upswell.operators.semantic import semantic_text

    return semantic_text(_case_documents(spark, sf)).select("complaint_id", "has_narrative", "semantic_text")


@query("risk_signals_cases", f"""
WITH {V4C}, {risk_sql('v4c').replace('arg_min(risk_type, complaint_id)', 'arg_min(risk_type, complaint_id) FILTER (WHERE risk_type IS NOT NULL)')}
SELECT * FROM risk""")
def risk_signals_cases_q(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets whose first rows have no risk type, buckets without product and issue, texts with no hit."""
    from upswell.operators.risk import risk_signals

    return risk_signals(_case_documents(spark, sf), systemic=DOC_SYSTEMIC, individual=DOC_INDIVIDUAL)


# Products that start inside the current window, and products, issues and states that are absent.
_CASE_V1 = f"""{S.V1},
v1c AS (SELECT l_orderkey, date_received,
          CASE WHEN l_orderkey % 11 = 0 THEN NULL
               WHEN product < 'c' AND date_received >= (SELECT max(date_received) FROM v1) - INTERVAL 30 DAY THEN 'new ' || product
               ELSE product END AS product,
          CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE issue END AS issue, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE state END AS state FROM v1)"""


def _case_emergence(spark: SparkSession, sf: str) -> DataFrame:
    start = B.newest_shipdate(spark, sf) - _dt.timedelta(days=CFG.time_window_days)
    v, key = parse_date_column(B.v1_emergence(spark, sf)), F.col("l_orderkey")
    fresh = (F.col("product") < "c") & (F.col("date_received") >= F.lit(start).cast(v.schema["date_received"].dataType))
    return v.withColumns({
        "product": F.when(key % 11 == 0, None).when(fresh, F.concat(F.lit("new "), F.col("product"))).otherwise(F.col("product")),
        "issue": F.when(key % 17 != 0, F.col("issue")), "state": F.when(key % 5 != 0, F.col("state"))})


@query("emerging_summary_cases", f"""
WITH {_CASE_V1}, {S.summary_ctes('s', 'v1c')}
SELECT s.*, {S.takeaway_sql('product')} AS takeaway FROM s""")
def emerging_summary_cases_q(spark: SparkSession, sf: str) -> DataFrame:
    """New products (no ratio, "new spike"), products that vanished, absent keys."""
    from upswell.functions.growth import product_takeaway

    s = E.emerging_summary(_case_emergence(spark, sf), CFG, B.newest_shipdate(spark, sf))
    return s.select("*", product_takeaway(F.col("product")).alias("takeaway"))


@query("hierarchy_summary_cases", hierarchy_sql(_CASE_V1 + """,
v2c AS (SELECT date_received, product AS canonical_product, issue AS product_line, state AS canonical_issue FROM v1c)""", "v2c"))
def hierarchy_summary_cases_q(spark: SparkSession, sf: str) -> DataFrame:
    """Absent keys on every level are shown as Unspecified."""
    from upswell.operators.hierarchy import hierarchy_summary

    rows = _case_emergence(spark, sf).select("date_received", F.col("product").alias("canonical_product"), F.col("issue").alias("product_line"),
                                             F.col("state").alias("canonical_issue"))
    return hierarchy_summary(rows, CFG, B.newest_shipdate(spark, sf))


@query("emerging_persistence_weekly", f"""
WITH {S.V1}, {S.summary_ctes('p', 'v1', shift_days=7)}, {S.records_ctes('pr', 'p', 'v1')},
{S.summary_ctes('s', 'v1')}, {S.records_ctes('r', 's', 'v1', persistent='m.product IN (SELECT product FROM pr)')}
SELECT product, growth_ratio, current_volume, persistent FROM r""")
def emerging_persistence_weekly_q(spark: SparkSession, sf: str) -> DataFrame:
    """This run against the run a week earlier, most of whose windows are the same."""
    from dataclasses import replace

    df, ref = parse_date_column(B.v1_emergence(spark, sf)), B.newest_shipdate(spark, sf)
    previous = E.emerging_products(df, CFG, reference_date=ref - _dt.timedelta(days=7))
    rec = E.emerging_products(df, replace(CFG, persistence_min_runs=2), reference_date=ref, previous=previous)
    return rec.select("product", "growth_ratio", "current_volume", "persistent")


@query("hybrid_search", f"""
WITH {V4},
kw AS (SELECT complaint_id, row_number() OVER (ORDER BY complaint_id) AS r FROM v4
       WHERE canonical_product = 'Alpha' AND ({' OR '.join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '(?i){KEYWORD}'), false)" for c in
                                             ['consumer_complaint_narrative', 'issue', 'product', 'canonical_issue', 'canonical_product', 'sub_product'])})),
head AS (SELECT complaint_id, row_number() OVER (ORDER BY complaint_id) AS r FROM v4 WHERE canonical_product = 'Alpha'),
emb AS (SELECT vec_id, max(embedding) AS embedding FROM embeddings GROUP BY 1),
held AS (SELECT complaint_id, row_number() OVER (ORDER BY complaint_id) AS r FROM v4 JOIN emb ON complaint_id = vec_id WHERE canonical_product = 'Alpha'),
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {SINGLE_QUERY_ID}),
sem AS (SELECT complaint_id, row_number() OVER (ORDER BY s DESC, complaint_id) AS r FROM (
  SELECT complaint_id, round_even(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS s
  FROM v4 JOIN emb ON complaint_id = vec_id, q WHERE canonical_product = 'Alpha'))
SELECT 'keyword, no vector' AS branch, complaint_id FROM kw WHERE r <= 10
UNION ALL SELECT 'keyword, vector of another size', complaint_id FROM kw WHERE r <= 10
UNION ALL SELECT 'keyword, no row has a vector', complaint_id FROM kw WHERE r <= 10
UNION ALL SELECT 'first rows, no row has a vector', complaint_id FROM head WHERE r <= 10
UNION ALL SELECT 'first rows, no vectors', complaint_id FROM head WHERE r <= 10
UNION ALL SELECT 'first rows with a vector', complaint_id FROM held WHERE r <= 10
UNION ALL SELECT 'by similarity', complaint_id FROM sem WHERE r <= 10""")
def hybrid_search_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every branch of the hybrid search: which rows answer, by what the caller and the table of vectors have."""
    from upswell.operators.search import hybrid_search

    docs, emb = B.v4_documents(spark, sf), B.v6_embeddings(spark, sf)
    qv = _query_vector(spark, sf, SINGLE_QUERY_ID)
    other = emb.where(F.col("complaint_id") < 0)  # vectors of no row
    cases = {
        "keyword, no vector": (emb, KEYWORD, None), "keyword, vector of another size": (emb, KEYWORD, qv[:3]),
        "keyword, no row has a vector": (other, KEYWORD, qv), "first rows, no row has a vector": (other, None, None),
        "first rows, no vectors": (None, None, None), "first rows with a vector": (emb, None, None), "by similarity": (emb, KEYWORD, qv),
    }
    found = [hybrid_search(docs, e, text, v, 10, canonical_product="Alpha").select(F.lit(name).alias("branch"), "complaint_id")
             for name, (e, text, v) in cases.items()]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query("assign_to_centres", """
WITH c AS (SELECT CAST(vec_id AS INTEGER) AS topic_id, embedding AS centre FROM embeddings WHERE vec_id < 8),
s AS (SELECT e.vec_id AS complaint_id, c.topic_id, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(c.centre AS DOUBLE[])) AS s FROM embeddings e, c),
b AS (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY s DESC, topic_id) AS r FROM s)
SELECT complaint_id, CASE WHEN s >= 0.2 THEN topic_id ELSE -1 END AS topic_id, round_even(s, 6) AS similarity FROM b WHERE r = 1""")
def assign_to_centres_q(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment step of the topics, with given centres: every vector to the nearest of the first eight."""
    from upswell.operators.embed import assign_to_centres

    emb = B.v6_embeddings(spark, sf)
    centres = emb.where(F.col("complaint_id") < 8).select(F.col("complaint_id").cast("int").alias("topic_id"), F.col("embedding").alias("centre"))
    return assign_to_centres(emb, centres)


# ---------------------------------------------------------------- rollups that merge, typed CSV

def _event_windows_sql(start: int, end: int, name: str) -> str:
    return f"""count(*) FILTER (WHERE back >= {start} AND back < {end}) AS {name}_volume,
       count(DISTINCT user_id) FILTER (WHERE back >= {start} AND back < {end}) AS {name}_distinct,
       count(DISTINCT user_id) FILTER (WHERE back >= {start} AND back < {end}) AS {name}_exact,
       TRUE AS {name}_within_3_pct"""


@query("event_users_sketch", f"""
WITH newest AS (SELECT max(CAST(ts AS DATE)) AS day FROM events),
e AS (SELECT event_type, user_id, date_diff('day', CAST(ts AS DATE), newest.day) AS back FROM events, newest WHERE ts IS NOT NULL)
SELECT event_type, {_event_windows_sql(0, 7, 'current')},
       {_event_windows_sql(7, 14, 'prior')},
       {_event_windows_sql(14, 28, 'baseline')}
FROM e WHERE back < 28 GROUP BY 1""")
def event_users_sketch_q(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users of each event type and window, merged from a rollup of daily sketches, beside the exact counts (A2)."""
    from upswell.functions.dates import Windows
    from upswell.operators.windows import daily_sketches, volumes_from_sketches
    from upswell.sources.tables import materialize, read_table

    events = read_table(spark, sf, "events")
    daily = materialize(daily_sketches(events, ["event_type"], "user_id", "ts"))
    newest = daily.agg(F.max("day")).first()[0]
    names = ("current", "prior", "baseline")
    if newest is None:
        newest = _dt.date(1970, 1, 1)
    w = Windows.ending_at(_dt.datetime.combine(newest, _dt.time()) + _dt.timedelta(days=1), 7, 7, 14)
    like = events.schema["ts"].dataType
    exact = w.rows(events, "ts").groupBy("event_type").agg(
        *[F.count_distinct(F.when(flag, F.col("user_id"))).alias(f"{n}_exact") for n, flag in zip(names, w.flags(F.col("ts"), like))])
    out = volumes_from_sketches(daily, ["event_type"], w).join(exact.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type")))
    near = [(F.abs(F.col(f"{n}_distinct") - F.col(f"{n}_exact")) * 100 <= F.col(f"{n}_exact") * 3).alias(f"{n}_within_3_pct") for n in names]
    return out.select("event_type", *[f"{n}_{c}" for n in names for c in ("volume", "distinct", "exact")], *near)


@query("csv_types", """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM lineitem""")
def csv_types_q(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` written as CSV and read again with the types found from all its texts."""
    import uuid

    from upswell.session import ensure_checkpoint_dir
    from upswell.sources.files import read_complaints_csv
    from upswell.sources.tables import read_table

    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4()}"
    read_table(spark, sf, "lineitem").write.option("header", True).csv(path)
    return read_complaints_csv(spark, path, types=True, multi_line=False)


# ---------------------------------------------------------------- records and exports that are written and read again

@query("records_round_trip", f"""
WITH {S.V1}, {S.summary_ctes('s', 'v1')}, {S.records_ctes('r', 's', 'v1')}
SELECT * FROM r""")
def records_round_trip_q(spark: SparkSession, sf: str) -> DataFrame:
    """The emerging products written as JSON records and read again, as the next run does."""
    import uuid

    from upswell.session import ensure_checkpoint_dir
    from upswell.sources.files import read_previous_records, write_records_json

    path = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4()}"
    write_records_json(E.emerging_products(B.v1_emergence(spark, sf), CFG, B.newest_shipdate(spark, sf)), path)
    return E.flatten_records(read_previous_records(spark, path, E.RECORD_SCHEMA))


@query("drill_export_file", f"""
WITH {V3}, {SL},
top AS (SELECT canonical_product, canonical_issue FROM sl GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)
SELECT 'complaints_' || regexp_replace(canonical_issue, '[^\\pL\\pN]', '_', 'g') AS file, CAST(l_orderkey AS BIGINT) AS l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(date_received AS DATE) AS date_received, product, issue, state, company
FROM sl JOIN top USING (canonical_product, canonical_issue)""")
def drill_export_file_q(spark: SparkSession, sf: str) -> DataFrame:
    """Rows behind the largest cell, exported as a CSV file named by its issue and read again."""
    import uuid

    from upswell.functions.text import safe_token
    from upswell.operators.report import drill, prepare_export, write_csv
    from upswell.session import ensure_checkpoint_dir
    from upswell.sources.files import read_complaints_csv

    rows = _v3_slice(spark, sf)[2]
    cells = rows.groupBy("canonical_product", "canonical_issue").agg(F.count(F.lit(1)).alias("n"))
    top = cells.orderBy(F.desc("n"), "canonical_product", "canonical_issue").select(
        "canonical_product", "canonical_issue", safe_token(F.col("canonical_issue")).alias("token")).first()
    if top is None:
        cell, name = rows.limit(0), "complaints_none"
    else:
        cell, name = drill(rows, top["canonical_product"], top["canonical_issue"]), f"complaints_{top['token']}"
    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4()}/{name}"
    columns = ["l_orderkey", "l_linenumber", "date_received", "product", "issue", "state", "company"]
    write_csv(prepare_export(cell).select(*columns), path)
    back = read_complaints_csv(spark, path, types=True, multi_line=False)
    return back.select(F.lit(name).alias("file"), *columns)
