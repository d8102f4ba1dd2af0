"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

Fingerprints are cut into bands; two that differ in r bits or fewer agree in
one of r + 1 bands, so those that share a band's value form a shard, and every
link lies inside some shard. A shard with too many fingerprints is cut again by
the bits that are left, which loses no link and always ends, as distinct
fingerprints that agree in all but b bits number 2**b at most. Each shard gets a
BK-tree: a child hangs on its parent by their Hamming distance, and a search
follows only the edges within the radius. The trees grow with the corpus, so
they are shared out by shuffle, not broadcast from the driver. A shard gives
only the links that join its fingerprints, at most one per fingerprint;
connected components then come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, keep_rows, lookup_join, map_rows, stable, text_bytes, with_row_id

SHARD_LIMIT = 2048
"""A shard with more fingerprints than this is cut by further bits."""


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as an unsigned number.

    A-Z are lower-cased, words are split at ASCII white space; every shingle
    (all words if there are fewer) counts as often as it occurs. A bit is one
    when more than half of the shingles' XXH64 have it; no word gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        digest = xxhash.xxh64_intdigest
        starts = [0, *[e + 1 for e in ends]]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i:i + 8192], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes))))


class BKTree:
    """Distinct fingerprints; children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the fingerprints at the radius or nearer."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:
                if len(edges) <= 2 * radius + 1:
                    todo += [c for k, c in edges.items() if d - radius <= k <= d + radius]
                else:
                    todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, first fingerprint of its group), for the groups that links within the radius join."""
    tree, root = BKTree(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        near = tree.within(v, radius)
        tree.add(v)
        root.append(i)
        for j in near:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _band_value(bits: list[int]) -> Column:
    """The named bits of ``fp`` (a run of neighbours, or several runs) as hex."""
    mask = sum(1 << b for b in bits)
    return F.hex(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """(shard, fp) rows: each fingerprint in each of its shards, no shard over the limit."""
    level = prints.select("fp", F.lit("").alias("shard"), F.lit("").alias("left"))
    todo, finished = [("", list(range(64)))], None
    # each path names the bands that were cut; "left" tells which bits a hot shard has still to be cut by
    while todo:
        rows, following = None, []
        for path, bits in todo:
            mine = level.where(F.col("left") == path)
            parts = _bands(bits, radius + 1)
            keys = [F.struct(F.concat("shard", F.lit(f"/{i}:"), _band_value(p)).alias("shard"), F.lit(f"{path}{i}").alias("left"))
                    for i, p in enumerate(parts)]
            mine = mine.select("fp", F.explode(F.array(*keys)).alias("_k")).select("fp", "_k.shard", "_k.left")
            rows = mine if rows is None else rows.union(mine)
            following += [(f"{path}{i}", [b for b in bits if b not in p]) for i, p in enumerate(parts)]
        rows = checkpointed(rows)
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHARD_LIMIT)
        sizes = checkpointed(sizes)
        if sizes.isEmpty():
            return rows.select("shard", "fp") if finished is None else finished.union(rows.select("shard", "fp"))
        marked = lookup_join(rows.withColumn("_rid", F.col("fp")), sizes, ["shard"], rows.count(), "left")
        marked = checkpointed(marked.drop("_rid"))
        small = marked.where(F.col("_n").isNull()).select("shard", "fp")
        finished = small if finished is None else finished.union(small)
        level = marked.where(F.col("_n").isNotNull()).select("fp", "shard", "left")
        held = {r["left"] for r in level.select("left").distinct().collect()}  # at most (radius + 1) names for each level
        todo = [(p, b) for p, b in following if p in held]
    return finished


def _search(radius: int):
    """Worker over rows sorted by shard: a shard's links as soon as its last row was read."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members = None, []
        for b in batches:
            links = []
            for shard, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != name:
                    if len(members) > 1:
                        links += shard_links(members, radius)
                    name, members = shard, []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], schema=out)
        links = shard_links(members, radius) if len(members) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], schema=out)

    return run


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that join all distinct fingerprints (column fp) within the radius of each other."""
    shards = _shards(prints, radius)
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(radius), "u long, v long")


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(fp, root) for every end of a link; root is the smallest number of its component. ``keep`` writes what a round has found and reads it back."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
            edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = keep(both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select(
            "u", F.least("u", "_m").alias("_m"), "_n"))
        n = low.agg(F.sum("_n")).first()[0] or 0
        met = lookup_join(both.withColumn("_rid", F.col("v")), low, ["u"], n).drop("_rid", "_n")
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")) if large else \
            met.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(low.select("u", F.col("_m").alias("v")))
        return keep(out.where("u <> v").distinct())

    edges = keep(links.where("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen, edges = state, star(star(edges, True), False)
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


_PRINTS = "_rid long, doc_id long, fp long"
_PRINTS_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: _rid, doc_id, fp, component_id, first (the row that stands for its component).

    A null text counts as empty; texts without words have fingerprint zero and
    are linked like others. component_id is the smallest id that links within
    ``radius`` differing bits reach; null ids count only where a component has
    no other. ``first`` is the row with that id, of several one of them.
    Copies share a fingerprint and are never paired. Other columns of ``docs``
    are not looked at; an empty table gives an empty result.
    """

    def prints_of(batch: dict[str, list]) -> dict[str, list]:
        prints = [fingerprint(t, shingle, seed) for t in batch["text"]]
        return {"_rid": batch["_rid"], "doc_id": batch["doc_id"], "fp": [p - (1 << 64) if p >> 63 else p for p in prints]}

    source = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)})
    rows = checkpointed(map_rows(source, prints_of, _PRINTS, _PRINTS_ARROW))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_rid")).alias("_low")
    prints = checkpointed(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("_n"), low))
    roots = checkpointed(components(fingerprint_links(prints.select("fp"), radius)))
    linked = checkpointed(prints.join(roots, "fp").select("fp", "root", "_n", "_low"))
    tops = checkpointed(linked.groupBy("root").agg(F.min("_low").alias("_top"), F.count(F.lit(1)).alias("_n")))
    linked_n = linked.count()
    in_component = lookup_join(linked.select("fp", "root", F.col("_n").alias("_docs"), F.col("fp").alias("_rid")), tops, ["root"], linked_n)
    copies = prints.where("_n > 1").join(roots, "fp", "left_anti").select("fp", "_n", F.col("_low").alias("_top"))
    lookup = checkpointed(in_component.select("fp", F.col("_docs").alias("_n"), "_top").union(copies))
    out = lookup_join(rows, lookup, ["fp"], rows.count(), "left")
    return out.select("_rid", "doc_id", "fp",
                      F.when(F.col("_top").isNotNull(), F.col("_top.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(F.col("_top").isNotNull(), (F.col("_top._rid") == F.col("_rid")) & F.col("_top.doc_id").eqNullSafe(F.col("doc_id"))
                             ).otherwise(True).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component, columns as they were."""
    docs = stable(docs)
    found = simhash_components(docs, id_col, text_col, shingle, radius)
    return keep_rows(docs, found.where(~F.col("first")), id_col)
