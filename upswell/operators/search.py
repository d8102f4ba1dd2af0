"""Hybrid search (H9: F6, F7, F14, J5, W4, X15, T4, T5, N9-N11).

Structured filters and keyword search are plain filters. Vector search is
exact: a single query is a column expression plus TakeOrderedAndProject; a
batch of queries is scored block by part with NumPy matrix products, each
task keeps only its top-k per query, and a per-query ``row_number() <= k``
(WindowGroupLimit) merges them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upswell.config import SearchConfig
from upswell.functions.text import icontains
from upswell.functions.vectors import dot, literal_vector

SCORE_DECIMALS = 6


def ensure_key(df: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Numeric key; rows whose key does not parse are dropped."""
    return df.withColumn(key, F.col(key).cast("string").try_cast("bigint")).filter(F.col(key).isNotNull())


def structured_filter(df: DataFrame, canonical_product: str | None = None, canonical_issue: str | None = None,
                      product_raw: str | None = None, issue_raw: str | None = None,
                      use_canonical: bool = True) -> DataFrame:
    """Equality on product and issue (F6): the canonical column decides if it is there and
    a value is wanted of it, else the raw one."""
    conditions = []
    for raw, wanted, wanted_raw in (("product", canonical_product, product_raw), ("issue", canonical_issue, issue_raw)):
        choices = [(f"canonical_{raw}", wanted)] if use_canonical and f"canonical_{raw}" in df.columns else []
        column, value = next(((c, v) for c, v in [*choices, (raw, wanted_raw)] if v), (None, None))
        if column:
            conditions.append(F.col(column).cast("string") == F.lit(value))
    return df.filter(reduce(and_, conditions)) if conditions else df


def keyword_mask(df: DataFrame, query: str, columns=SearchConfig().text_columns, literal: bool = False) -> Column:
    """Whether a text column of the frame matches, case-insensitively."""
    present = [F.col(c).cast("string") for c in columns if c in df.columns]
    return reduce(or_, (icontains(c, query, literal) for c in present), F.lit(False))


def keyword_search(df: DataFrame, query: str, top_k: int = 20, key: str = "complaint_id",
                   cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """First ``top_k`` matching rows in key order (T5)."""
    return ensure_key(df, key).filter(keyword_mask(df, query.strip(), cfg.text_columns)) \
        .orderBy(F.col(key).asc()).limit(top_k)


def valid_embeddings(emb: DataFrame, dim: int | None = None, key: str = "complaint_id",
                     order_col: str | None = None, unique: bool = False) -> DataFrame:
    """One embedding per key (W4), then only non-empty ones of dimension ``dim``.

    The last by ``order_col`` stays (default ``date_received`` if it is there; ties and
    no order: the greatest vector). ``unique`` skips the shuffle for a table
    known to hold one vector per key, as ``embed_corpus`` writes it.
    """
    order = [c for c in (order_col or "date_received",) if c in emb.columns]
    e = ensure_key(emb.select(key, "embedding", *order), key)
    if not unique:
        e = e.groupBy(key).agg(F.max(F.struct(*order, F.col("embedding"))).alias("_last")).select(key, "_last.embedding")
    size = F.size(F.col("embedding"))
    return e.select(key, "embedding").filter(F.col("embedding").isNotNull() & ((size > 0) if dim is None else (size == F.lit(dim))))


def structured_search(df: DataFrame, emb: DataFrame | None, top_k: int = 20, key: str = "complaint_id",
                      **filters) -> DataFrame:
    """No query: filtered rows (with a valid embedding when embeddings exist), key order."""
    rows = structured_filter(ensure_key(df, key), **filters)
    if emb is not None:
        rows = rows.join(valid_embeddings(emb, key=key).select(key), key, "left_semi")
    return rows.orderBy(F.col(key).asc()).limit(top_k)


def semantic_search(df: DataFrame, emb: DataFrame, query_vector, top_k: int = 20,
                    key: str = "complaint_id", **filters) -> DataFrame:
    """Top-k rows by cosine similarity to one unit query vector."""
    qv = [float(x) for x in query_vector]
    rows = structured_filter(ensure_key(df, key), **filters)
    cand = rows.join(valid_embeddings(emb, len(qv), key), key)  # J5
    score = F.bround(dot(F.col("embedding"), literal_vector(qv)), SCORE_DECIMALS)
    return cand.withColumn("similarity_score", score).drop("embedding") \
        .orderBy(F.col("similarity_score").desc(), F.col(key).asc()).limit(top_k)


def by_size(key: str, vector: str, rows: int):
    """A function that cuts an Arrow table into (size, keys, vectors as a matrix of doubles): at most ``rows`` vectors, all of that size."""
    # Everything the Python workers run is defined here, so it is shipped by
    # value: workers need numpy and pyarrow, not this package.
    def cut(table):
        import numpy as np
        import pyarrow.compute as pc

        for at in range(0, len(table), rows):
            some = table.select([key, vector]).slice(at, rows).combine_chunks()
            sizes = pc.list_value_length(some[vector]).to_numpy()
            for size in np.unique(sizes):
                own = some if (sizes == size).all() else some.filter(pc.equal(pc.list_value_length(some[vector]), int(size)))
                flat = pc.list_flatten(own[vector]).to_numpy().astype(np.float64)
                yield int(size), own[key].to_numpy().astype(np.int64), flat.reshape(len(own), int(size))

    return cut


def block_scorer(key: str, k: int, decimals: int, rows: int = 4096, queries: int = 512):
    """Scores of a block of queries (query_id, _q) against some candidates (key, embedding), Arrow tables: each query's first k among them.

    Scores are held of ``queries`` times ``rows`` pairs at a time, and of each query's first k so far.
    """
    asked, held = by_size("query_id", "_q", queries), by_size(key, "embedding", rows)

    def score(qs, cs):
        import numpy as np
        import pyarrow as pa

        none = np.iinfo(np.int64).max
        best = [(size, ids, q, np.full((len(ids), k), -np.inf), np.full((len(ids), k), none)) for size, ids, q in asked(qs)]
        for size, ids, m in held(cs):
            for of, _, q, scores, keys in best:
                if of != size:
                    continue
                s = q @ m.T
                np.round(s, decimals, out=s)
                s[np.isnan(s)] = -np.inf  # no score
                least = scores[:, -1]
                if len(ids) > k:
                    least = np.maximum(least, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                i = np.concatenate([np.repeat(np.arange(len(q)), k), i])
                line, found = np.concatenate([scores.ravel(), s[i[len(q) * k:], j]]), np.concatenate([keys.ravel(), ids[j]])
                order = np.lexsort((found, -line, i))
                # where each query begins in that order; at least k rows are its own
                first = order[np.searchsorted(i[order], np.arange(len(q)))[:, None] + np.arange(k)]
                scores[:], keys[:] = line[first], found[first]
        out = [(np.repeat(ids, k), keys.ravel(), scores.ravel()) for _, ids, _, scores, keys in best]
        q, c, s = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        real = s > -np.inf
        return pa.table({"query_id": q[real], key: c[real], "similarity_score": s[real]})

    return score


def batch_semantic_search(df: DataFrame, emb: DataFrame, queries: DataFrame, top_k: int = 10,
                          key: str = "complaint_id", cfg: SearchConfig = SearchConfig(),
                          **filters) -> DataFrame:
    """Exact top-k per query for a DataFrame of queries (query_id, embedding).

    Queries are dealt into blocks and candidates into parts, both of bounded
    size; each task scores one block against one part (vectors of the same
    size) and keeps the top-k of each query, which a ranking per query merges.
    Nothing passes the driver but the two counts.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("_q")) \
        .filter(F.col("_q").isNotNull() & (F.size("_q") > 0))
    rows = structured_filter(ensure_key(df, key), **filters).select(key)
    cand = rows.join(valid_embeddings(emb, None, key), key)
    blocks = max(1, -(-q.count() // cfg.queries_per_block))
    parts = max(1, -(-emb.count() // cfg.candidates_per_part))
    q = q.select("query_id", "_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_b"),
                 F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    cand = cand.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_p"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))

    out = q.groupBy("_p", "_b").cogroup(cand.groupBy("_p", "_b")).applyInArrow(
        block_scorer(key, top_k, SCORE_DECIMALS), f"query_id long, {key} long, similarity_score double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col(key).asc())
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= F.lit(top_k))


def hybrid_search(df: DataFrame, emb: DataFrame | None, query_text: str | None = None,
                  query_vector=None, top_k: int = 20, key: str = "complaint_id", **filters) -> DataFrame:
    """Semantic, keyword or structured search, by what there is.

    Without a query, or without embeddings, rows are searched by structure and
    keyword alone. With a query, and filtered rows of which none has an
    embedding: keyword search, or the first rows without a query text. None of
    these embeddings valid: no row. A query vector of another size than theirs:
    keyword search. Only existence is looked up before, by small jobs.
    """
    text = str(query_text or "").strip()
    rows = structured_filter(ensure_key(df, key), **filters)

    def plain() -> DataFrame:
        return keyword_search(rows, text, top_k, key) if text else rows.orderBy(F.col(key).asc()).limit(top_k)

    if emb is None:
        return plain()
    own = ensure_key(emb.select(key, "embedding"), key).join(rows.select(key), key, "left_semi")
    if own.isEmpty():
        return plain()
    vector = list(query_vector) if query_vector is not None else []
    if not vector:
        return keyword_search(rows, text, top_k, key) if text else structured_search(rows, emb, top_k, key)
    usable = own.where(F.size("embedding") > 0)
    if not usable.isEmpty() and usable.where(F.size("embedding") == len(vector)).isEmpty() and text:
        return keyword_search(rows, text, top_k, key)
    return semantic_search(rows, emb, vector, top_k, key)


def search_options(df: DataFrame) -> DataFrame:
    """Sorted distinct canonical products and issues for pickers (N11, T7); one scan."""
    pairs = [F.struct(F.lit(kind).alias("option_kind"), F.col(col).cast("string").alias("option_value"))
             for kind, col in (("product", "canonical_product"), ("issue", "canonical_issue"))
             if col in df.columns]
    out = df.select(F.explode(F.array(*pairs)).alias("o")).select("o.option_kind", "o.option_value")
    return out.filter(F.col("option_value").isNotNull()).distinct().orderBy("option_kind", "option_value")
