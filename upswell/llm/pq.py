"""Vector codes by product quantisation, assigned over a lexicographic trie.

Vectors become integers and are cut into consecutive parts. For each part
position the distinct parts, with the number of vectors that have them, are
sorted and walked as a trie, depth first: a node holds the distances of its
prefix to all codebook entries, its children add one dimension to them, so
parts with a common prefix share that work, and a leaf takes the nearest entry
and adds its weighted components to the entry's sums. A subtree (or a run of
neighbouring ones) with at most ``RUN`` leaves is walked with its nodes side by
side, which bounds what is held at once.

Distinct parts are counted by Spark and sorted over the cluster once; each
round maps over them and brings back one row of sums per entry.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, lookup_join, with_row_id

RUN = 512
BOUND = 1 << 26
"""Components beyond this many steps are taken as this many, so that all sums fit 64 bits."""


def walk(parts: np.ndarray, entries: np.ndarray, leaf: Callable[[int, int, np.ndarray], None]) -> None:
    """Call ``leaf(a, b, distances)`` for runs a:b of the sorted distinct parts, with the distances to all entries as rows.

    A stack holds (a, b, depth, distances of the components before depth), so no
    more than one path through the trie and its open siblings is in memory.
    """
    width = parts.shape[1]
    todo = [(0, len(parts), 0, np.zeros(len(entries), np.int64))] if len(parts) else []
    while todo:
        a, b, depth, shared = todo.pop()
        if b - a <= RUN:
            leaf(a, b, _subtree(parts[a:b], entries, depth, shared))
            continue
        if depth == width:  # only parts that repeat come here
            todo += [(i, min(i + RUN, b), depth, shared) for i in range(a, b, RUN)]
            continue
        column = parts[a:b, depth]
        edges = [a, *(np.flatnonzero(column[1:] != column[:-1]) + 1 + a).tolist(), b]
        children, low = [], a
        for start, end in itertools.pairwise(edges):
            if end - start > RUN:
                if start > low:
                    children.append((low, start, depth, shared))
                children.append((start, end, depth + 1, shared + (parts[start, depth] - entries[:, depth]) ** 2))
                low = end
            elif end - low > RUN:
                children.append((low, start, depth, shared))
                low = start
        if b > low:
            children.append((low, b, depth, shared))
        todo += children[::-1]


def _subtree(parts: np.ndarray, entries: np.ndarray, depth: int, shared: np.ndarray) -> np.ndarray:
    """Distances of neighbouring leaves that share the components before ``depth``: one row per trie node, level by level."""
    changed = np.zeros(len(parts), bool)
    changed[0] = True
    distances, node = shared[None, :], np.zeros(len(parts), np.int64)
    for k in range(depth, parts.shape[1]):
        changed[1:] |= parts[1:, k] != parts[:-1, k]
        first = np.flatnonzero(changed)
        distances = distances[node[first]] + (parts[first, k][:, None] - entries[None, :, k]) ** 2
        node = np.cumsum(changed) - 1
    return distances[node]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals) and its squared distance for each sorted part."""
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)

    def leaf(a: int, b: int, distances: np.ndarray) -> None:
        code[a:b] = distances.argmin(axis=1)
        error[a:b] = distances[np.arange(b - a), code[a:b]]

    walk(parts, entries, leaf)
    return code, error


def _sorted_distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and which of them each row is."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[:len(rows)]
    of = np.empty(len(parts), np.int64)
    of[order] = np.cumsum(new) - 1
    return rows[new], of


def _cuts(width: int, n_parts: int) -> list[int]:
    return [width * i // n_parts for i in range(n_parts + 1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


_SUMS = "pos int, entry int, dim int, n long, total long"
_SUMS_ARROW = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def _round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries moved to the means of the parts nearest to them; entries without parts stay."""
    shared = parts.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        sums = [np.zeros(t.shape, np.int64) for t in tables]
        counts = [np.zeros(len(t), np.int64) for t in tables]
        for b in batches:
            position, weight = b.column(0).to_numpy(), b.column(2).to_numpy()
            for pos in np.unique(position).tolist():
                at = np.flatnonzero(position == pos)
                rows = _matrix(b.column(1).take(pa.array(at)), tables[pos].shape[1])

                def leaf(low: int, high: int, distances: np.ndarray, rows=rows, w=weight[at], pos=pos) -> None:
                    code, times = distances.argmin(axis=1), w[low:high]
                    np.add.at(counts[pos], code, times)
                    np.add.at(sums[pos], code, rows[low:high] * times[:, None])

                walk(rows, tables[pos], leaf)
        for pos, (total, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            entry, dim = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
                (np.full(len(entry), pos), entry, dim, n[entry], total[entry, dim]), _SUMS_ARROW)], schema=_SUMS_ARROW)

    moved = parts.mapInArrow(run, _SUMS).groupBy("pos", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [t.copy() for t in books]
    for r in moved.collect():  # one row per entry and dimension at most
        out[r["pos"]][r["entry"], r["dim"]] = r["total"] // r["n"]
    shared.unpersist()
    return out


def _integers(vectors: DataFrame, vec_col: str, scale: int) -> Column:
    steps = F.transform(vectors[vec_col], lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-BOUND)), F.lit(BOUND)).cast("long"))
    bad = F.exists(vectors[vec_col], lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vectors[vec_col]) > 0) & ~bad, steps)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                 scale: int = 1024) -> DataFrame:
    """_rid, vec_id, label, v (integers: floor(scale * x)): the rows whose vector has components, all of them finite."""
    return with_row_id(vectors, {"vec_id": vectors[id_col].cast("long"), "label": vectors[label_col], "v": _integers(vectors, vec_col, scale)}
                       ).where(F.col("v").isNotNull())


def fit(kept: DataFrame, n_parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray] | None:
    """A codebook for each part position (entries x components), None without vectors.

    Codebooks start as the parts of the ``entries`` smallest ids (nulls last;
    equal ids by their vectors), fewer if there are fewer vectors, and are moved
    ``rounds`` times. The length of the first of them is that of the table; rows
    of another length aren't used. Ties go to the lower entry.
    """
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v")
    head = [r["v"] for r in start.limit(entries).collect()]
    if not head:
        return None
    width = len(head[0])
    if any(len(v) != width for v in head):
        head = [r["v"] for r in start.where(F.size("v") == width).limit(entries).collect()]
    cuts = _cuts(width, n_parts)
    books = [np.array([v[a:b] for v in head], np.int64).reshape(len(head), b - a) for a, b in itertools.pairwise(cuts)]
    pieces = F.array(*[F.slice("v", a + 1, b - a) for a, b in itertools.pairwise(cuts)])
    parts = kept.where(F.size("v") == width).select(F.posexplode(pieces).alias("pos", "part")).groupBy("pos", "part").agg(
        F.count(F.lit(1)).alias("weight"))
    parts = checkpointed(parts.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"))
    for _ in range(rounds):
        books = _round(parts, books)
    return books


_CODES = "_rid long, vec_id long, label {label}, code string, error long"


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """_rid, vec_id, label, code (two hex digits per part), error (squared distances of all parts): a row for each vector of the books' length."""
    width = sum(t.shape[1] for t in books)
    cuts = _cuts(width, len(books))
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column(3), width)
            error, codes = np.zeros(len(rows), np.int64), np.zeros((len(rows), len(cuts) - 1), np.uint8)
            for pos, (a, z) in enumerate(itertools.pairwise(cuts)):
                parts, of = _sorted_distinct(rows[:, a:z])
                code, distance = nearest(parts, shared.value[pos])
                codes[:, pos] = code[of]
                error += distance[of]
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                                             names=["_rid", "vec_id", "label", "code", "error"])

    return kept.where(F.size("v") == width).mapInArrow(run, _CODES.format(label=kept.schema["label"].dataType.simpleString()))


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for t in books for x in t.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 1024,
             n_parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per kept vector: _rid, vec_id, label, code, error, label_error, codebooks_sha256.

    Rows without a vector, with an empty one, or with null, NaN or infinite
    components are left out, as are vectors of another length than the table's
    (see ``fit``). A component beyond 2**26 steps counts as that bound.
    Vectors whose length ``n_parts`` does not divide are cut as evenly as can
    be. Repeated rows and ids stay rows of their own. label_error adds up the
    errors of equal labels, null labels together. Other columns are not looked
    at; a table without kept vectors gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = kept_vectors(vectors, id_col, label_col, vec_col, scale)
    books = fit(kept, n_parts, entries, rounds)
    if books is None:
        return kept.select("_rid", "vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")],
                           F.lit("").alias("codebooks_sha256"))
    coded = checkpointed(encode(kept, books).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    totals = checkpointed(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    out = lookup_join(coded, totals, ["_label"], coded.count())
    return out.select("_rid", "vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
