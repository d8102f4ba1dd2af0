"""DuckDB SQL fragments for the oracle queries (same bindings as sources.bindings).

Each helper returns CTE text; the oracle queries are assembled from them.
"""

from __future__ import annotations

from upswell.operators.taxonomy import Taxonomy

V1 = """v1 AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate AS date_received, p.p_name AS product,
         p.p_brand AS issue, n.n_name AS state, s.s_name AS company
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

V2 = """v2 AS (
  SELECT l.l_shipdate AS date_received, p.p_type AS canonical_product, p.p_brand AS product_line,
         p.p_name AS canonical_issue
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

# Python-str.isspace() code points, RE2 syntax (same list as functions.text).
WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NW = r"[^\pL\pN_]"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def clean(expr: str) -> str:
    """NULL -> '', whitespace runs -> ' ', trimmed."""
    return f"trim(regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), '{WS}+', ' ', 'g'))"


def tax_key(expr: str) -> str:
    return f"coalesce({py_strip(f'CAST({expr} AS VARCHAR)')}, '')"


def taxonomy_ctes(tax: Taxonomy, name: str = "tax") -> str:
    rows = [f"({sql_str(m)}, {sql_str(r)}, {sql_str(v)})" for m, r, v in tax.rows() if r != "_default"]
    return f"{name}(map_name, raw, value) AS (VALUES {', '.join(rows)})"


def taxonomy_select(src: str, tax: Taxonomy, name: str = "tax") -> str:
    """SELECT adding canonical_product, product_line, risk_type, canonical_issue."""
    pk, ik = tax_key("s.product"), tax_key("s.issue")

    def look(m, key):
        return f"(SELECT value FROM {name} WHERE map_name = '{m}' AND raw = {key})"

    return f"""SELECT s.*,
      coalesce({look('canonical_products', pk)}, 'Other') AS canonical_product,
      coalesce({look('product_line', pk)}, {sql_str(tax.default_line)}) AS product_line,
      coalesce({look('issue_risk_type', ik)}, {sql_str(tax.default_risk)}) AS risk_type,
      coalesce({look('canonical_issues', ik)}, {ik}) AS canonical_issue
    FROM {src} s"""


def v3(tax: Taxonomy) -> str:
    return f"""{taxonomy_ctes(tax, 'tax3')},
v3raw AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate AS date_received,
         p.p_type AS product, p.p_brand AS issue, p.p_name AS sub_product, n.n_name AS state,
         s.s_name AS company
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
v3 AS ({taxonomy_select('v3raw', tax, 'tax3')})"""


def v4(tax: Taxonomy) -> str:
    return f"""{taxonomy_ctes(tax, 'tax4')},
v4raw AS (
  SELECT doc_id AS complaint_id,
         CAST(DATE '2024-01-01' + CAST(doc_id % 150 AS INTEGER) AS TIMESTAMP) AS date_received,
         source AS product, 'bucket_' || CAST(doc_id % 7 AS VARCHAR) AS issue,
         'S' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') AS state, lang AS sub_product,
         text AS consumer_complaint_narrative
  FROM documents),
v4 AS ({taxonomy_select('v4raw', tax, 'tax4')})"""


V5 = """v5 AS (
  SELECT e.vec_id AS complaint_id, CAST(CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS INTEGER) AS topic_id,
         d.date_received, d.canonical_product, d.canonical_issue, d.product, d.issue, d.product_line,
         d.state, d.consumer_complaint_narrative
  FROM embeddings e JOIN v4 d ON e.vec_id = d.complaint_id
  WHERE """ + clean("d.consumer_complaint_narrative") + """ <> '')"""


def ratio(num: str, den: str) -> str:
    return (f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) "
            f"WHEN {num} > 0 THEN NULL ELSE CAST(1.0 AS DOUBLE) END")


def windows_cte(name: str, src: str, cur: int, prior: int, base: int, shift_days: int = 0,
                end_expr: str | None = None) -> str:
    e = end_expr or f"(SELECT max(date_received) FROM {src}) - INTERVAL {shift_days} DAY"
    return (f"{name} AS (SELECT e, e - INTERVAL {cur} DAY AS cs, e - INTERVAL {cur + prior} DAY AS ps, "
            f"e - INTERVAL {cur + prior + base} DAY AS bs FROM (SELECT {e} AS e))")


def summary_ctes(name: str, src: str, key: str = "product", issue: str = "issue",
                 state: str | None = "state", cur: int = 30, prior: int = 30, base: int = 90,
                 growth: float = 1.5, min_prior: int = 5, rank_n: int = 5, min_cur: int = 10,
                 shift_days: int = 0, end_expr: str | None = None) -> str:
    """E1 summary over ``src``: CTE ``{name}`` with the summary columns."""
    st = f"count(DISTINCT CASE WHEN date_received >= cs THEN {state} END)" if state else "CAST(0 AS BIGINT)"
    return f"""{windows_cte(name + '_w', src, cur, prior, base, shift_days, end_expr)},
{name}_v AS (
  SELECT CAST({key} AS VARCHAR) AS product,
         count(*) FILTER (WHERE date_received >= cs) AS current_volume,
         count(*) FILTER (WHERE date_received >= ps AND date_received < cs) AS prior_volume,
         count(*) FILTER (WHERE date_received < ps) AS baseline_volume,
         {st} AS distinct_states
  FROM {src}, {name}_w
  WHERE date_received >= bs AND date_received < e AND {key} IS NOT NULL AND {issue} IS NOT NULL
  GROUP BY {key}),
{name}_g AS (
  SELECT *, {ratio('current_volume', 'prior_volume')} AS growth_ratio,
         {ratio('current_volume', 'baseline_volume')} AS lift_vs_baseline,
         rank() OVER (ORDER BY current_volume DESC) AS rank_current,
         rank() OVER (ORDER BY prior_volume DESC) AS rank_prior
  FROM {name}_v),
{name} AS (
  SELECT product, current_volume, prior_volume, baseline_volume, distinct_states, growth_ratio,
         (growth_ratio - 1.0) * 100.0 AS growth_pct,
         (prior_volume = 0 AND current_volume > 0) AS is_new, lift_vs_baseline,
         rank_current, rank_prior, rank_prior - rank_current AS rank_improved,
         (((growth_ratio IS NULL OR growth_ratio >= {growth}) AND prior_volume >= {min_prior})
           OR (rank_prior - rank_current > 0 AND rank_current <= {rank_n})) AS emerging,
         current_volume >= {min_cur} AS meets_min_volume
  FROM {name}_g)"""


def takeaway_sql(key: str = "product", p: str = "") -> str:
    return (f"concat_ws(' ', {key}, "
            f"CASE WHEN {p}prior_volume > 0 AND {p}growth_ratio IS NOT NULL THEN "
            f"printf('complaints up %s%% vs prior period (%d in current window)', printf('%.0f', {p}growth_pct), {p}current_volume) "
            f"WHEN {p}current_volume > 0 AND {p}prior_volume = 0 THEN "
            f"printf('new spike in complaints this period (%d in current window)', {p}current_volume) END, "
            f"CASE WHEN {p}rank_improved > 0 THEN printf('now #%d (was #%d)', {p}rank_current, {p}rank_prior) END, "
            "'— consider reviewing process and customer communications.')")


def records_ctes(name: str, summary: str, src: str, key: str = "product", issue: str = "issue",
                 top_n: int = 10, top_issues: int = 5, persistent: str = "true",
                 extra_filter: str = "") -> str:
    """E1 records (top-n emerging with flattened top issues): CTE ``{name}``."""
    w = summary + "_w"
    return f"""{name}_em AS (
  SELECT * FROM {summary} WHERE emerging AND meets_min_volume {extra_filter}
  ORDER BY growth_ratio DESC NULLS FIRST, current_volume DESC, product ASC LIMIT {top_n}),
{name}_iss AS (
  SELECT CAST({key} AS VARCHAR) AS product, CAST({issue} AS VARCHAR) AS issue, count(*) AS current_volume
  FROM {src}, {w}
  WHERE date_received >= cs AND date_received < e AND {key} IS NOT NULL AND {issue} IS NOT NULL
  GROUP BY 1, 2),
{name}_top AS (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY current_volume DESC, issue ASC) AS rn
  FROM {name}_iss WHERE product IN (SELECT product FROM {name}_em)),
{name}_txt AS (
  SELECT product, string_agg(issue || ' (' || CAST(current_volume AS VARCHAR) || ')', '; ' ORDER BY rn) AS top_issues
  FROM {name}_top WHERE rn <= {top_issues} GROUP BY product),
{name} AS (
  SELECT m.product, rank_current, rank_prior, current_volume, prior_volume, baseline_volume,
         lift_vs_baseline, distinct_states, growth_ratio,
         CASE WHEN prior_volume > 0 THEN round_even(growth_pct, 1) END AS growth_pct,
         coalesce(t.top_issues, '') AS top_issues, {takeaway_sql('m.product', 'm.')} AS takeaway,
         {persistent} AS persistent
  FROM {name}_em m LEFT JOIN {name}_txt t ON m.product = t.product)"""


def duck_phrase(p: str) -> str:
    """A Python-style phrase regex for RE2: \\b at either end becomes an explicit
    non-word-or-edge match (searching, so consuming one character is fine)."""
    core, lead, trail = p, p.startswith(r"\b"), p.endswith(r"\b")
    core = core[2:] if lead else core
    core = core[:-2] if trail else core
    if r"\b" in core:
        raise ValueError("interior word boundary not supported in oracle form")
    core = core.replace(r"\s", WS).replace(r"\w", r"[\pL\pN_]")
    return ("(?i)" + (f"(?:^|{NW})" if lead else "") + "(?:" + core + ")"
            + (f"(?:{NW}|$)" if trail else ""))


def hits_sql(text: str, phrases) -> str:
    if not phrases:
        return "0"
    return " + ".join(f"(CASE WHEN regexp_matches({text}, {sql_str(duck_phrase(p))}) THEN 1 ELSE 0 END)"
                      for p in phrases)


def narrative_score_sql(text: str, systemic, individual) -> str:
    """SELECT-list fragment: narrative_score, systemic_hits, individual_hits."""
    t = py_strip(text)
    empty = f"({text} IS NULL OR {text} = '')"
    s = f"CAST(CASE WHEN {empty} THEN 0 ELSE {hits_sql(t, systemic)} END AS BIGINT)"
    i = f"CAST(CASE WHEN {empty} THEN 0 ELSE {hits_sql(t, individual)} END AS BIGINT)"
    d = f"greatest(least({s} - {i}, 3), -3)"
    score = (f"CASE WHEN {empty} THEN CAST(0.0 AS DOUBLE) ELSE CAST(CASE {d} WHEN -3 THEN 0.0 WHEN -2 THEN 0.167 "
             f"WHEN -1 THEN 0.333 WHEN 0 THEN 0.5 WHEN 1 THEN 0.667 WHEN 2 THEN 0.833 ELSE 1.0 END AS DOUBLE) END")
    return f"{score} AS narrative_score, {s} AS systemic_hits, {i} AS individual_hits"
