"""The registered queries of this package, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.llm import bpe, decontam, exact_dedup, fim, idcoder, langid, licenses, pii, pq, secrets, setjoin, simhash, toxicity
from upswell.llm.common import documents, shared_folder
from upswell.sources.tables import read_table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
                        "n_unknown")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"))).drop("_rid")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.equal_text_groups(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "ids")
    idcoder.write_ids(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), path)
    found = idcoder.document_digests(spark.read.parquet(path))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    return found.select("doc_id", *[_count("spans", r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.KINDS))
    return found.select("doc_id", *[_count("spans", k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restore(fim.fill_in_middle(documents(spark, sf_dir)))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2("restored", 256).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq.compress(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_id_files": op8_id_files,
    "op9_secrets": op9_secrets,
    "op10_personal_data": op10_personal_data,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS g
               FROM (SELECT item, w, least(13, len(w)) AS s, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT s FROM bw),
        dw AS (SELECT r, i, s, array_to_string(w[i:i + s - 1], ' ') AS g
               FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, sizes WHERE len(w) >= s)),
        met AS (SELECT r, i, s, item FROM dw JOIN bw USING (s, g)),
        hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + s)) AS p FROM met) GROUP BY r),
        items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""",
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}


def _secrets_sql() -> str:
    """Matches and the texts between them give the offsets; the rules' own patterns, with what else a match must have."""
    found, valid = [], {"assign": "length(regexp_extract(s, {p}, 2)) >= 8", "access": "length(s) >= 16"}
    for rank, rule in enumerate(secrets.BASE_RULES + secrets.ADDED_RULES):
        pattern = "'" + ("(?i)" if rule.flags & re.IGNORECASE else "") + rule.pattern.replace("'", "''") + "'"
        found.append(f"""
        SELECT r, {rank} AS rank, '{rule.kind}' AS kind, start, start + length(s) AS stop FROM (
          SELECT r, ms[i] AS s, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
          FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS gs FROM d WHERE regexp_matches(t, {pattern}))))
        WHERE {valid.get(rule.kind, 'true').format(p=pattern)}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){where}, '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({" UNION ALL ".join(found)})
        SELECT any_value(doc_id) AS doc_id, {counts},
               sha256({listed.format(where=f" FILTER (WHERE rank < {len(secrets.BASE_RULES)})")}) AS base_sha256,
               {listed.format(where=" FILTER (WHERE rank IS NOT NULL)")} AS spans
        FROM d LEFT JOIN f USING (r) GROUP BY r"""


def _codes_sql() -> str:
    """Four rounds as four pairs of tables: each part's nearest entry, then the entries' new components."""
    steps = """
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
                                       list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, pos, v[pos * (len(v) // 4) + 1:(pos + 1) * (len(v) // 4)] AS part FROM v, range(4) AS t(pos)),
        b0 AS MATERIALIZED (SELECT pos, r - 1 AS entry, part FROM p WHERE r <= 256)"""
    for k in range(5):
        steps += f""",
        n{k} AS MATERIALIZED (SELECT r, p.pos, any_value(p.part) AS part, min(struct_pack(d := list_sum(list_transform(
                 list_zip(p.part, b.part), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), entry := b.entry)) AS best
                 FROM p JOIN b{k} b ON p.pos = b.pos GROUP BY r, p.pos)"""
        if k < 4:
            steps += f""",
        m{k} AS (SELECT pos, entry, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (
                 SELECT pos, best.entry AS entry, unnest(range(len(part))) AS i, unnest(part) AS x FROM n{k}) GROUP BY pos, entry, i),
        l{k} AS (SELECT pos, entry, list(x ORDER BY i) AS part FROM m{k} GROUP BY pos, entry),
        b{k + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(l.part, b.part) AS part FROM b{k} b LEFT JOIN l{k} l ON b.pos = l.pos AND b.entry = l.entry)"""
    return steps + """,
        c AS (SELECT r, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error
              FROM n4 GROUP BY r),
        t AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (r) GROUP BY label),
        h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b4)
        SELECT vec_id, code, error, label_error, codebooks_sha256
        FROM c JOIN v USING (r) JOIN t ON v.label IS NOT DISTINCT FROM t.label, h"""


ORACLE["op9_secrets"] = _secrets_sql()
ORACLE["op11_fill_in_middle"] = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                          sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                               OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                          WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        s AS (SELECT *, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
                     array_to_string(u[greatest(k1, k2) + 1:], '') AS x FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                                ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM s"""
ORACLE["op12_vector_codes"] = _codes_sql()
ORACLE["op13_jaccard_join"] = r"""
        WITH RECURSIVE d AS MATERIALIZED (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s
              FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
        e AS MATERIALIZED (SELECT c.a, c.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS both FROM g x JOIN g y USING (s) WHERE x.r <> y.r GROUP BY 1, 2) c
              JOIN n na ON na.r = c.a JOIN n nb ON nb.r = c.b WHERE 100 * c.both >= 85 * (na.n + nb.n - c.both)),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
        FROM d JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id"""
