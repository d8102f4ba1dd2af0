"""Topics whose number nobody gives (N4): connected groups of similar vectors.

Vectors are linked when their cosine is ``min_similarity`` or more; a topic is a
connected group of ``min_size`` rows or more, all other rows are outliers (-1).

The links are found without comparing all pairs. Equal directions are one class.
Classes are dealt to cells around centres; a class can only be linked into a cell
whose ball it comes near enough to, so it visits these cells alone, and the vectors of
a cell that is narrower than the allowed distance are linked without being
compared. Where vectors do meet, in parts of bounded size, only a spanning set of
links leaves the task: at most one for each vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.config import SearchConfig
from upswell.functions.vectors import as_double_array, dot
from upswell.operators.pruned_search import CellIndex, build_cells, cell_table
from upswell.operators.search import by_size, valid_embeddings
from upswell.sources.tables import materialize

COSINE_SLACK, SLACK = 1e-9, 1e-6
"""Cosines count to nine decimals; distances are compared with a margin for what floating point loses."""


def connected_groups(links: DataFrame) -> DataFrame:
    """(node, group) of every node of ``links`` (a, b): the smallest node that can be reached.

    Rounds of large and small stars: each node's neighbours move to the smallest
    of them until every group is a star around its smallest node. Each round is written to
    the checkpoint folder; only two counts reach the driver.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(roots.withColumn("group", F.col("node")))


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or one smaller and one greater."""
    counts = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes")).first()
    return counts["n"] == counts["nodes"] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def similarity_links(units: DataFrame, min_similarity: float, key: str = "complaint_id", n_cells: int = 256,
                     cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Links (a, b) that connect the same ``units`` as all pairs of cosine ``min_similarity`` or more would.

    ``units``: (key, embedding), unit vectors of type double, unlike each other, one for each key.
    Vectors of different sizes are never linked.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * (min_similarity - COSINE_SLACK)))  # the distance of unit vectors with that cosine
    index = build_cells(units, key, n_cells, unique=True)
    narrow = 2 * F.col("radius") + SLACK <= F.lit(reach)
    cells = index.cells.withColumn("_narrow", narrow)
    home = index.members.join(cells.select(F.col("cell").alias("_cell"), "_narrow"), "_cell")
    roots = home.where("_narrow").groupBy("_cell").agg(F.min(key).alias("b"))
    within = home.where("_narrow").join(roots, "_cell").select(F.col(key).alias("a"), "b")
    meetings = _meetings(_visits(index, key, reach), home, cells, key, cfg)
    found = meetings[0].cogroup(meetings[1]).applyInArrow(_meet(key, min_similarity - COSINE_SLACK), "a long, b long")
    return within.unionByName(found).where(F.col("a") != F.col("b"))


def _visits(index: CellIndex, key: str, reach: float) -> DataFrame:
    """(key, embedding, _cell, _own) for each vector and cell that may hold a vector within ``reach`` of it; of two cells the lower is visited."""
    shared = index.members.sparkSession.sparkContext.broadcast(cell_table(index))  # one row for each cell
    margin = SLACK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        by_size: dict[int, list] = {}
        for cell, centre, radius, _ in shared.value:
            by_size.setdefault(len(centre), []).append((cell, centre, radius))
        tables = {d: tuple(np.array(x) for x in zip(*g)) for d, g in by_size.items()}
        for batch in batches:
            for start in range(0, len(batch), 256):
                b = batch.iloc[start:start + 256]
                size = b["embedding"].map(len).to_numpy(int)
                for d in np.unique(size):
                    part = b[size == d]
                    cell, centre, radius = tables[d]
                    m, own = np.vstack(part["embedding"].to_numpy()), part["_cell"].to_numpy()
                    away = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] - 2 * m @ centre.T + (centre * centre).sum(1)))
                    near = (away <= radius + reach + margin) & (away <= part["_distance"].to_numpy()[:, None] + 2 * reach + margin)
                    same = own[:, None] == cell
                    i, j = np.nonzero((near & (cell < own[:, None])) | same)
                    yield pd.DataFrame({key: part[key].to_numpy()[i], "embedding": part["embedding"].to_numpy()[i],
                                        "_cell": cell[j], "_own": same[i, j]})

    return index.members.mapInPandas(run, f"{key} long, embedding array<double>, _cell long, _own boolean")


def _meetings(visits: DataFrame, home: DataFrame, cells: DataFrame, key: str, cfg: SearchConfig):
    """Visitors and cell members, both cut into parts of bounded size; each part of one meets each of the other."""
    parts = F.ceil(F.col("n") / cfg.candidates_per_part).cast("int")
    size = cells.select(F.col("cell").alias("_cell"), "_narrow", parts.alias("_parts"))
    guests = materialize(visits.join(size, "_cell").where(~(F.col("_own") & F.col("_narrow"))))  # a narrow cell's own are linked already
    load = guests.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / cfg.queries_per_block).cast("int").alias("_blocks"))
    asked = guests.join(load, "_cell").select(key, "embedding", "_cell", F.pmod(F.xxhash64(key), "_blocks").cast("int").alias("_b"),
                                              F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"))
    held = home.join(load, "_cell").join(size.select("_cell", "_parts"), "_cell").select(
        key, "embedding", "_cell", F.pmod(F.xxhash64(key), "_parts").cast("int").alias("_p"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
    by = ["_cell", "_p", "_b"]
    return asked.groupBy(*by), held.groupBy(*by)


def _meet(key: str, least: float):
    """A spanning set of the links between some visitors and some members, Arrow tables: each with the smallest key that it is connected to.

    Which pairs are linked is held as bits; cosines are held of a few visitors and all members at a time.
    """
    guests_of, members_of = by_size(key, "embedding", 64), by_size(key, "embedding", 4096)

    def run(guests, members):
        import numpy as np
        import pyarrow as pa

        found, none = [], np.iinfo(np.int64).max
        of_size: dict[int, list] = {}
        for size, ids, m in members_of(members):
            of_size.setdefault(size, []).append((ids, m))
        for size, parts in of_size.items():
            others = np.concatenate([x for x, _ in parts])
            blocks = [(ids, np.packbits(np.concatenate([q @ m.T >= least for _, m in parts], axis=1), axis=1))
                      for own, ids, q in guests_of(guests) if own == size]
            if not blocks:
                continue
            g, m = [ids for ids, _ in blocks], others
            while True:
                g2, m2 = [], m.copy()
                for old, (_, bits) in zip(g, blocks):
                    near = np.unpackbits(bits, axis=1, count=len(others)).view(bool)
                    g2.append(np.minimum(old, np.where(near, m2, none).min(1)))
                    np.minimum(m2, np.where(near, g2[-1][:, None], none).min(0), out=m2)
                if (m2 == m).all() and all((x == y).all() for x, y in zip(g2, g)):
                    break
                g, m = g2, m2
            a, b = np.concatenate([*(ids for ids, _ in blocks), others]), np.concatenate([*g, m])
            found.append(np.unique(np.stack([a, b])[:, a != b], axis=1))
        links = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": links[0], "b": links[1]})

    return run


def similarity_topics(emb: DataFrame, min_similarity: float = 0.8, min_size: int = 10, key: str = "complaint_id", n_cells: int = 256,
                      order_col: str | None = None, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(key, topic_id, topic_size) for every key with a vector; no number of topics is given.

    ``topic_id`` is the smallest key of the connected group, -1 if the group has
    fewer than ``min_size`` rows; ``topic_size`` counts the group's rows. Vectors without a direction (all zero,
    a component that is null or not finite) are groups of their own. Null and
    empty vectors give no row; one vector counts for each key (W4).
    """
    vectors = valid_embeddings(emb, None, key, order_col).select(F.col(key).cast("long").alias(key), as_double_array(F.col("embedding")).alias("_v"))
    norm = F.sqrt(dot(F.col("_v"), F.col("_v")))
    sound = (norm > 0) & (norm < F.lit(float("inf"))) & ~F.exists("_v", lambda x: x.isNull())
    rows = materialize(vectors.withColumn("_n", F.when(sound, norm)).select(key, F.when(F.col("_n").isNotNull(), F.transform(
        "_v", lambda x: x / F.col("_n"))).alias("embedding")))
    directed = rows.where(F.col("embedding").isNotNull())
    classes = materialize(directed.groupBy("embedding").agg(F.min(key).alias("_class")))
    links = similarity_links(classes.select(F.col("_class").alias(key), "embedding"), min_similarity, key, n_cells, cfg)
    groups = connected_groups(links).select(F.col("node").alias("_class"), F.col("group").alias("_group"))
    placed = directed.join(classes, "embedding").select(key, "_class").join(groups, "_class", "left")
    placed = placed.select(key, F.coalesce("_group", "_class").alias("_group")).unionByName(
        rows.where(F.col("embedding").isNull()).select(key, F.col(key).alias("_group")))
    placed = materialize(placed)
    size = placed.groupBy("_group").agg(F.count(F.lit(1)).alias("topic_size"))
    topic = F.when(F.col("topic_size") >= F.lit(min_size), F.col("_group")).otherwise(F.lit(-1)).cast("long")
    return placed.join(size, "_group").select(key, topic.alias("topic_id"), "topic_size")
