"""Exact vector search that scores only cells of vectors which can still win.

Candidates are dealt to cells around centres taken from them. No candidate x of
a cell with centre c and radius r has a larger product with a query q than
q.c + |q| r. A first round scores each query's most promising cells, enough to
hold ``top_k`` candidates, which gives its k-th score so far; a second one scores
the cells whose bound reaches that score. The others can't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upswell.config import SearchConfig
from upswell.operators.search import SCORE_DECIMALS, block_scorer, ensure_key, structured_filter, valid_embeddings
from upswell.sources.tables import materialize

SLACK = 1e-6
"""Scores are rounded to six decimals: a bound that much below may still tie."""
PAIRS_HELD = 16_384
"""A task hands on its pairs of queries and cells, each with the query's vector, when it has so many (and one query's more)."""


@dataclass(frozen=True)
class CellIndex:
    """Candidates with their cells, and the cells (cell, dim, centre, radius, n): as many as centres were asked for, and one for each further size."""

    members: DataFrame
    cells: DataFrame
    centres: list


def build_cells(emb: DataFrame, key: str = "complaint_id", n_cells: int = 256, order_col: str | None = None,
                unique: bool = False) -> CellIndex:
    """Cells over the valid embeddings.

    The centres are ``n_cells`` embeddings chosen by a hash of their key: the only
    rows that pass the driver, besides one row per cell. Vectors of a size that
    no centre has go to a cell around zero of their own size. ``unique``: see ``valid_embeddings``.
    """
    vectors = valid_embeddings(emb, None, key, order_col, unique)
    chosen = [r["embedding"] for r in vectors.orderBy(F.xxhash64(key), key).limit(n_cells).collect()]
    shared = emb.sparkSession.sparkContext.broadcast([[float(x) for x in c] for c in chosen])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        centres = shared.value
        sizes = np.array([len(c) for c in centres], int)
        for b in batches:
            cell, distance = np.zeros(len(b), np.int64), np.zeros(len(b))
            of = b["embedding"].map(len).to_numpy(int)
            for dim, start in ((d, i) for d in np.unique(of) for i in range(0, len(b), 1024)):
                at, own = start + np.flatnonzero(of[start:start + 1024] == dim), np.flatnonzero(sizes == dim)
                if not len(at):
                    continue
                m = np.vstack(b["embedding"].to_numpy()[at]).astype(np.float64)
                if len(own):
                    c = np.array([centres[i] for i in own])
                    d = (m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)
                    best = d.argmin(1)
                    cell[at], distance[at] = own[best], np.sqrt(((m - c[best]) ** 2).sum(1))
                else:
                    cell[at], distance[at] = -dim, np.sqrt((m * m).sum(1))
            yield b.assign(_cell=cell, _distance=distance)

    members = materialize(vectors.select(key, "embedding").mapInPandas(
        assign, f"{key} long, embedding {vectors.schema['embedding'].dataType.simpleString()}, _cell long, _distance double"))
    cells = members.groupBy("_cell").agg(F.max("_distance").alias("radius"), F.count(F.lit(1)).alias("n"), F.first(F.size("embedding")).alias("dim"))
    return CellIndex(members, materialize(cells.select(F.col("_cell").alias("cell"), "dim", "radius", "n")), chosen)


def cell_table(index: CellIndex) -> list[tuple]:
    """(cell, centre, radius, n): one row per cell."""
    return [(r["cell"], [float(x) for x in index.centres[r["cell"]]] if r["cell"] >= 0 else [0.0] * r["dim"], r["radius"], r["n"])
            for r in index.cells.collect()]


def pruned_semantic_search(df: DataFrame, emb: DataFrame, queries: DataFrame, top_k: int = 10, key: str = "complaint_id", n_cells: int = 256,
                           cfg: SearchConfig = SearchConfig(), report: bool = False, **filters) -> DataFrame:
    """The rows of ``batch_semantic_search`` (query_id, key, similarity_score, rank), with fewer pairs scored.

    With ``report``: one row with queries, candidates, scored pairs and their share
    of all pairs instead. Rows of ``df`` with the same key count once. Cells with very many candidates, or queries, are cut into
    parts of bounded size. Ties go to the smaller key.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("_q")).filter(F.col("_q").isNotNull() & (F.size("_q") > 0))
    rows = structured_filter(ensure_key(df, key), **filters).select(key)
    wanted = ensure_key(emb, key).join(rows.distinct(), key, "left_semi")
    index = build_cells(wanted, key, n_cells)
    spark = emb.sparkSession
    table = spark.sparkContext.broadcast(cell_table(index))

    most = PAIRS_HELD

    def cells_of(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import pyarrow as pa

            groups = {}
            for cell, centre, radius, n in table.value:
                groups.setdefault(len(centre), []).append((cell, centre, radius, n))
            groups = {d: (np.array([x[0] for x in g]), np.array([x[1] for x in g]), np.array([x[2] for x in g]), np.array([x[3] for x in g]))
                      for d, g in groups.items()}

            def pairs(b: pa.RecordBatch, rows: list, cells: list) -> pa.RecordBatch:
                at = pa.array(np.concatenate(rows))
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(cells))], names=["query_id", "_q", "_cell"])

            for b in batches:
                rows, cells, held = [], [], 0
                for i, least in enumerate(b.column(2).to_numpy(zero_copy_only=False)):  # null: NaN
                    v = b.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if len(v) not in groups:
                        continue
                    cell, centre, radius, n = groups[len(v)]
                    near = centre @ v
                    bound = near + np.sqrt(v @ v) * radius
                    order = np.argsort(-near, kind="stable")
                    probed = order[:np.searchsorted(np.cumsum(n[order]), top_k) + 1]
                    rest = np.setdiff1d(np.arange(len(cell)), probed)
                    take = probed if first else rest[(bound[rest] + SLACK * (1 + abs(bound[rest])) >= least) | np.isnan(least)]
                    rows.append(np.full(len(take), i))
                    cells.append(cell[take].astype(np.int64))
                    held += len(take)
                    if held >= most:
                        yield pairs(b, rows, cells)
                        rows, cells, held = [], [], 0
                if held:
                    yield pairs(b, rows, cells)

        return run

    parts = F.ceil(F.col("n") / cfg.candidates_per_part).cast("int")
    members = index.members.join(index.cells.select(F.col("cell").alias("_cell"), "n"), "_cell").withColumn(
        "_p", F.pmod(F.xxhash64(key), parts).cast("int")).select("_cell", "_p", key, "embedding")
    schema = f"query_id long, _q {q.schema['_q'].dataType.simpleString()}, _cell long"
    scorer = block_scorer(key, top_k, SCORE_DECIMALS)

    def score(pairs: DataFrame) -> DataFrame:
        load = pairs.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / cfg.queries_per_block).cast("int").alias("_blocks"))
        asked = pairs.join(load, "_cell").join(index.cells.select(F.col("cell").alias("_cell"), parts.alias("_parts")), "_cell").select(
            "query_id", "_q", "_cell", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int").alias("_b"),
            F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"))
        held = members.join(load, "_cell").select("_cell", "_p", key, "embedding", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
        by = ["_cell", "_p", "_b"]
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(scorer, f"query_id long, {key} long, similarity_score double")

    w = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col(key).asc())

    def best(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= F.lit(top_k))

    first_cells = materialize(q.withColumn("_least", F.lit(None).cast("double")).mapInArrow(cells_of(True), schema))
    first = materialize(best(score(first_cells)))
    least = first.filter(F.col("rank") == F.lit(top_k)).select("query_id", F.col("similarity_score").alias("_least"))
    more_cells = materialize(q.join(least, "query_id", "left").select("query_id", "_q", "_least").mapInArrow(cells_of(False), schema))
    if report:
        scored = first_cells.select("_cell").unionByName(more_cells.select("_cell")).join(
            index.cells.select(F.col("cell").alias("_cell"), "n"), "_cell").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scored_pairs"))
        n_queries, n_candidates = q.count(), index.members.count()
        return scored.select(F.lit(n_queries).alias("queries"), F.lit(n_candidates).alias("candidates"), "scored_pairs",
                             (F.col("scored_pairs") / max(n_queries * n_candidates, 1)).alias("share"))
    return best(first.drop("rank").unionByName(score(more_cells)))
