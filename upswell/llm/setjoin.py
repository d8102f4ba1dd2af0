"""Documents whose shingle sets have a high Jaccard similarity, by filters under several global token orders.

Every document is the set of its word shingles; equal sets form one class, and
only classes are joined. A global order of all shingles gives each set a prefix:
two sets that are similar enough share a shingle of their prefixes, under any
order. So a pair has to pass one such filter per order before its sets are
compared. Each order puts shingles that the corpus holds often last and deals
out the others by a permutation of its own; how often is read from counts over
all documents in a table of fixed size.

Rows of the first order's prefixes meet by shingle. First every class is
compared with one class of its group only, the one of the most frequent shingles
(of near copies that is the least changed one), which joins large groups of near
copies without pairing all of them. What matters after that are pairs that
these links haven't joined: they are listed in full. In a large group only the
classes outside its largest component are held against all, cell by cell. A
huge group is split before by length and by the prefixes of the other orders,
which loses no link, as a pair has to share a shingle of those too. Pairs then
pass bounds on how many shingles differ, from 256 parity bits and from some bits a
shingle, before texts are moved for them; then come the filters of the other
orders, and the sets of those left are compared shingle by shingle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, lookup_join, shared_folder, stable, text_bytes, with_row_id
from upswell.llm.simhash import components

GROUP, SPLIT, SPLIT_BLOCK = 512, 65_536, 8_192
"""Groups of at most ``GROUP`` classes are paired at once, those of at most ``SPLIT`` in cells, and larger ones are split before."""
STAR = 256
"""So many pairs of one class are compared in one task."""
SKETCH_BITS = 22
NEEDED_BITS = 24
"""A table of so many bits (2**NEEDED_BITS) tells which classes are in no pair, whose texts then needn't be shuffled."""
BLOCK = 1 << 14
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
"""Multipliers (odd, of high weight) that mix the words of a shingle and permute the orders."""
N_ORDERS = 3
FREQUENT = 9
"""Classes of rarity above this hold the shingles that occur more than some 2**FREQUENT times oftener than chance gives."""


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(text: bytes, size: int) -> set[bytes]:
    """Distinct shingles; all words as one if there are fewer, none without words."""
    words = _words(text)
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    return {line[a:b] for a, b in zip([0, *[e + 1 for e in ends]], ends[size - 1:])}


def shingle_tokens(text: bytes, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Distinct shingles as ascending 64-bit numbers, which stand for them until sets are compared."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i:len(h) - size + 1 + i]) * _ODD[0]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _places(tokens: np.ndarray) -> np.ndarray:
    """Where shingles are counted in the table."""
    return (tokens >> np.uint64(64 - SKETCH_BITS)).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Two sets, one of n shingles, that are similar enough share one of that many first shingles, under any order."""
    return n - -(-percent * n // 100) + 1


def prefixes(tokens: np.ndarray, classes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The prefix under each order: rare shingles first, equally rare ones by a permutation of the order's own."""
    if not len(tokens):
        return [tokens] * N_ORDERS
    rarity = classes[_places(tokens)].astype(np.uint64) << np.uint64(56)
    last, out = prefix_length(len(tokens), percent) - 1, []
    for k in range(N_ORDERS):
        permuted = tokens * _ODD[k + 1]
        rank = rarity | ((permuted ^ (permuted >> np.uint64(31))) >> np.uint64(8))
        first = np.flatnonzero(rank <= np.partition(rank, last)[last])  # all that tie with the last one too
        out.append(tokens[first[np.argsort(rank[first], kind="stable")] if k == 0 else first])
    return out


_SETS = "_rid long, doc_id long, n long, digest binary, block int, counts binary"
_SETS_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()),
                         ("counts", pa.binary())])


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _read_sets(source: DataFrame, size: int) -> DataFrame:
    """A row per document, and per task its blocks of shingle counts (``block`` not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _WordHashes(), np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            sizes, digests = [], []
            for t in b.column(2):
                tokens = shingle_tokens(t.as_py(), size, hashes)
                np.add.at(counts, _places(tokens), 1)
                sizes.append(len(tokens))
                digests.append(_digest(tokens))
            nulls = [pa.nulls(len(sizes), f.type) for f in list(_SETS_ARROW)[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *nulls],
                                             schema=_SETS_ARROW)
        for i, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(_SETS_ARROW)[:4]] + [
                    pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=_SETS_ARROW)

    return source.mapInArrow(run, _SETS)


def _rarity(blocks: DataFrame, total: int) -> np.ndarray:
    """How often the shingles of each place of the table occur, as a class: 0 for no more than chance gives, else by powers of two."""
    usual = 2 * total // (1 << SKETCH_BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            over = np.maximum(sums - usual, 0)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.frexp(over)[1].astype(np.uint8).tobytes()], pa.binary())],
                                              names=["block", "classes"])

        at, sums = None, None
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != at:
                    if at is not None:
                        yield done()
                    at, sums = block, np.zeros(BLOCK, np.int64)
                sums += np.frombuffer(zlib.decompress(packed), np.int32)
        if at is not None:
            yield done()

    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    summed = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, classes binary")
    for r in summed.collect():  # the table of fixed size, a byte a place
        classes[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["classes"], np.uint8)
    return classes


_ODDS = ["o0", "o1", "o2", "o3"]
_REPS = ("cid long, n long, hot long, ord long, o0 long, o1 long, o2 long, o3 long, sketch binary, p1 array<long>, p2 array<int>, p3 array<int>, "
         "text binary")
_REPS_ARROW = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("hot", pa.int64()), ("ord", pa.int64()), *[(o, pa.int64()) for o in _ODDS],
                         ("sketch", pa.binary()), ("p1", pa.list_(pa.int64())), ("p2", pa.list_(pa.int32())),
                         ("p3", pa.list_(pa.int32())), ("text", pa.binary())])


def odd_sketch(tokens: np.ndarray, bits: int = 256) -> np.ndarray:
    """Bits (a power of two of them), each telling whether an odd number of shingles falls on it: two sets differ in at least as many shingles
    as their bits do."""
    odd = (np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def long_sketch(tokens: np.ndarray) -> np.ndarray:
    """An odd sketch of two to four bits a shingle, which tells sets apart that differ in little more than links allow."""
    return odd_sketch(tokens, max(64, 1 << (2 * len(tokens) - 1).bit_length()))


def sketches_differ(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits; the longer sketch is folded to what it would be with as few bits as the other."""
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(_bits_set(x ^ y).sum())


def _bits_set(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).astype(np.int64)  # of signed words numpy counts the bits of their absolute values


def _may_link(n: np.ndarray, m: np.ndarray, most: np.ndarray, odds: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether sets of n and m shingles, ``most`` of them in common, may be similar enough; their sketches bound the common ones too."""
    least = -(-percent * (n + m) // (100 + percent))  # so many common ones make a link
    take = most >= least
    if take.any():
        differ = sum(_bits_set(x ^ y) for x, y in zip(odds, others))
        take &= differ <= n + m - 2 * least
    return take


def _representatives(texts: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """From (cid, digest, text): cid, n, how many shingles of the first prefix aren't frequent, an order in which
    sets of frequent shingles come first, the odd sketch, prefixes under each order, text."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def lists(values: list[np.ndarray], kind) -> pa.Array:
        flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
        flat = flat.view(np.int64) if kind == np.int64 else flat.astype(np.uint32).view(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = _WordHashes(), shared.value
        for b in batches:
            sizes, cut, kept, cold, order, odds, sketches = [], ([], [], []), [], [], [], [], []
            for digest, t in zip(b.column(1).to_pylist(), b.column(2)):
                tokens = shingle_tokens(t.as_py(), size, hashes)
                if _digest(tokens) == digest:  # not another row with the same number
                    kept.append(len(sizes))
                    for held, p in zip(cut, prefixes(tokens, table, percent)):
                        held.append(p)
                    order.append(round(256 * (64 - table[_places(tokens)].mean())))
                    odds.append(odd_sketch(tokens))
                    sketches.append(long_sketch(tokens).tobytes())
                    cold.append(int((table[_places(cut[0][-1])] <= FREQUENT).sum()))
                sizes.append(len(tokens))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(sizes, pa.int64()).take(at), pa.array(cold, pa.int64()), pa.array(order, pa.int64()),
                                              *[pa.array(np.array([o[i] for o in odds], np.int64)) for i in range(4)], pa.array(sketches, pa.binary()),
                                              lists(cut[0], np.int64), lists(cut[1], np.int32), lists(cut[2], np.int32), b.column(2).take(at)], schema=_REPS_ARROW)

    return texts.mapInArrow(run, _REPS)


def _stored(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, for pairs, links and counts that several jobs read: a table, whose small files a task reads together.

    It also drops what the planner has inferred, which a checkpoint keeps and
    which doubles by the round of ``components``. Its files stay until the folder is cleared.
    """
    folder = shared_folder(df.sparkSession, "pairs")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _long_enough(n: str, other: str, percent: int) -> Column:
    return (F.least(n, other) * 100 >= F.greatest(n, other) * percent)


def _needed(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """``data`` (cid) without most classes that are in none of the pairs (a, b); none that is in one is lost.

    The table of bits has a fixed size and is broadcast, so that what is left out
    isn't shuffled. ``pairs`` should be cheap to read twice.
    """
    def placed(rows: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("cid"), F.lit(1 << NEEDED_BITS))
        return rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_at", F.bitmap_bit_position(at))

    ends = placed(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))).select("_bucket", "_at")
    bits = ends.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1
    return placed(data).join(F.broadcast(bits), "_bucket").where(there).select(*data.columns)


def _meet(pairs: DataFrame, data: DataFrame, columns: list[str], check: Callable[[], Callable]) -> DataFrame:
    """The pairs (a, b) that pass. ``check()`` gives a function for one class's columns in ``data`` (cid, ...), which gives one for another's.

    A class's columns go once to a task for up to ``STAR`` of its pairs, so a
    class with very many pairs is dealt over as many tasks as it needs.
    """
    counts = _stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    shares = F.ceil(F.col("_n") / STAR).cast("int")
    data = data.select("cid", F.struct(*columns).alias("_d"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share")).join(data, F.col("a") == F.col("cid")).select(
        "a", "_share", F.lit(None).cast("long").alias("b"), "_d")
    dealt = lookup_join(pairs.withColumn("_rid", F.col("b")), counts, ["a"], total).select(
        "a", F.pmod(F.xxhash64("b"), shares).cast("int").alias("_share"), "b")
    members = dealt.join(data, F.col("b") == F.col("cid")).select("a", "_share", "b", "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, test, group = check(), None, None
        for batch in batches:
            found = []
            for a, share, b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b is None:
                    group, test = (a, share), start(d.as_py())
                elif group == (a, share) and test(d.as_py()):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = heads.unionByName(members).repartition("a", "_share").sortWithinPartitions("a", "_share", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def _close(percent: int):
    """Pairs whose long sketches don't tell that their sets differ in too many shingles."""

    def check():
        def start(x: dict):
            n, held = x["n"], np.frombuffer(x["sketch"], np.int64)

            def test(y: dict) -> bool:
                least = -(-percent * (n + y["n"]) // (100 + percent))  # so many common ones make a link
                return sketches_differ(held, np.frombuffer(y["sketch"], np.int64)) <= n + y["n"] - 2 * least

            return test

        return start

    return check


def _similar(size: int, percent: int):
    """Pairs that share a shingle of their prefixes under every other order and whose sets, compared shingle by shingle, are similar enough."""

    def check():
        def start(x: dict):
            second, third, held = set(x["p2"]), set(x["p3"]), shingle_set(x["text"], size)

            def test(y: dict) -> bool:
                if second.isdisjoint(y["p2"]) or third.isdisjoint(y["p3"]):
                    return False
                other = shingle_set(y["text"], size)
                common = len(held & other)
                return 100 * common >= percent * (len(held) + len(other) - common)

            return test

        return start

    return check


def _verified(pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links, once each. Texts are moved only for pairs that pass a bound from their long sketches."""
    close = _stored(_meet(_stored(pairs.distinct()), reps, ["n", "sketch"], _close(percent)))
    return _stored(_meet(close, _needed(reps, close), ["p2", "p3", "text"], _similar(size, percent)))


def _open_groups(rows: DataFrame) -> DataFrame:
    """(key, _n) of the groups that hold more than one component."""
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    return _stored(stats.where("_low < _high").select("key", "_n"))


def _of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` of the listed groups, with the groups' columns."""
    total = groups.agg(F.sum("_n")).first()[0] or 0
    return lookup_join(rows.withColumn("_rid", F.col("cid")), groups, ["key"], total).drop("_rid")


def _joined(links: DataFrame) -> DataFrame:
    """(cid, comp): every class that the links (u, v) join to another one, and the smallest one that they reach from it."""
    return _stored(components(links, _stored).toDF("cid", "comp"))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, put together so that no group is cut."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        columns = [b.column(i).to_numpy() for i in range(b.num_columns)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and (last or held[-1][0][-1] != columns[0][0]):
            held.append([c[:last] for c in columns])
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        elif last:
            yield [c[:last] for c in columns]
        held.append([c[last:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _list_pairs(percent: int):
    """Worker over rows sorted by key and n (key, cid, comp, n, pos, sketch): pairs of a group that may be links and that no link has joined."""

    def pairs_of(keys: np.ndarray, cid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray,
                 *odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        end = np.repeat(edges[1:], np.diff(edges))  # of each row's group
        i, left, right = np.arange(len(keys)), [], []
        for step in range(1, len(keys)):
            i = i[i + step < end[i]]
            i = i[n[i + step] * percent <= n[i] * 100]  # rows of a group come in order of n
            if not len(i):
                break
            j = i + step
            # pos is the shingle's place in the prefix: at the first common one, this many may be common at most
            most = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j])
            take = (comp[j] != comp[i]) & _may_link(n[i], n[j], most, [o[i] for o in odds], [o[j] for o in odds], percent)
            left.append(cid[i[take]])
            right.append(cid[j[take]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            yield _pair_batch(*pairs_of(*columns))

    return run


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _listed(rows: DataFrame, percent: int) -> DataFrame:
    return rows.select("key", "cid", "comp", "n", "pos", *_ODDS).repartition("key").sortWithinPartitions("key", "n").mapInArrow(
        _list_pairs(percent), "a long, b long")


def _meet_strays(percent: int):
    """Worker over rows sorted by cell, a cell's strays first (cell, other, cid, comp, n, pos, stray, sketch): pairs of a stray and another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            cells, others, *columns = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (others[1:] != others[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cells)] if len(cells) else []):
                if cells[low] != cell:
                    cell, held = cells[low], []
                part = [c[low:high] for c in columns]
                if not others[low]:
                    held.append(part)
                    continue
                found = []
                for cid, comp, n, pos, _, *odds in zip(*(np.concatenate(x) for x in zip(*held))) if held else ():
                    most = 1 + np.minimum(n - pos, part[2] - part[3])
                    take = (part[1] != comp) & (~part[4] | (part[0] > cid)) & _may_link(n, part[2], most, odds, part[5:], percent)
                    met = part[0][take]
                    found.append((np.minimum(met, cid), np.maximum(met, cid)))
                if found:
                    yield _pair_batch(*(np.concatenate(x) for x in zip(*found)))

    return run


def _strays_with_all(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of large groups: one end outside its group's largest component, so that a group that is nearly joined costs little.

    A group is cut into cells of some strays and some of all rows; a task holds
    a cell's strays and reads the others past them.
    """
    sizes = checkpointed(rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_c")))
    groups = _stored(sizes.groupBy("key").agg(F.sum("_c").alias("_n"), F.max_by("comp", "_c").alias("_main"), F.max("_c").alias("_most")))
    rows = checkpointed(_of_groups(rows, groups).withColumn("stray", F.col("comp") != F.col("_main")))
    stray_blocks = F.ceil((F.col("_n") - F.col("_most")) / GROUP).cast("int")
    row_blocks = F.ceil(F.col("_n") / SPLIT_BLOCK).cast("int")
    mine = F.xxhash64("cid")
    strays = rows.where("stray").withColumn("_s", F.pmod(mine, stray_blocks).cast("int")).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), row_blocks - 1))).withColumn("other", F.lit(False))
    others = rows.withColumn("_r", F.pmod(mine, row_blocks).cast("int")).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), stray_blocks - 1))).withColumn("other", F.lit(True))
    cells = strays.unionByName(others).select(
        F.xxhash64("key", "_s", "_r").alias("cell"), "other", "cid", "comp", "n", "pos", "stray", *_ODDS)
    return cells.repartition("cell").sortWithinPartitions("cell", "other").mapInArrow(_meet_strays(percent), "a long, b long")


def _remaining_pairs(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All pairs of one group (key) but different components that may be links; huge groups are split first."""
    found, levels = [], ["n", "p2", "p3"]
    while True:
        rows = checkpointed(rows)
        rows = _of_groups(rows, _open_groups(rows))
        if len(levels) == 3:
            rows = rows.join(reps.select("cid", *_ODDS), "cid")
        rows = checkpointed(rows)
        found.append(_listed(rows.where(F.col("_n") <= GROUP), percent))
        large = rows.where((F.col("_n") > GROUP) & (F.col("_n") <= SPLIT)) if levels else rows.where(F.col("_n") > GROUP)
        if not large.isEmpty():
            found.append(_strays_with_all(large.drop("_n"), percent))
        huge = rows.where(F.col("_n") > SPLIT).drop("_n")
        if not levels or huge.isEmpty():
            break
        split = levels.pop(0)
        if split == "n":
            band = F.floor(F.log(F.col("n")) / (1.001 * math.log(100 / percent)))  # two sets of similar length are in one band or in neighbours
            rows = huge.withColumn("_part", F.explode(F.array(band, band + 1)))
        else:
            rows = huge.join(reps.select("cid", split), "cid").withColumn("_part", F.explode(split)).drop(split)
        rows = rows.withColumn("key", F.xxhash64("key", "_part")).drop("_part")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


_ROWS = "key long, cid long, n long, pos long, a long, m long"



def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker over rows sorted by key, ord and cid (key, cid, n, pos): those of keys with several rows, with cid and n of the key's first."""
    for key, cid, n, pos, *_ in whole_groups(batches):
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.diff(edges)
        first = np.repeat(edges[:-1], size)
        at = np.flatnonzero(np.repeat(size, size) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (key, cid, n, pos, cid[first], n[first])],
                                         names=["key", "cid", "n", "pos", "a", "m"])


def _shared_rows(reps: DataFrame) -> DataFrame:
    """Rows (key, cid, n, pos) of the first order's prefixes whose shingle another prefix has too, with the first class (a, m; see ord) that has it.

    Shingles that the corpus holds often may be in a great many prefixes: they
    are counted before they are shuffled, and the heavy ones are salted.
    """
    rows = reps.select("cid", "n", "hot", "ord", F.posexplode("p1").alias("pos", "key")).select(
        "key", "cid", "n", (F.col("pos").cast("long") + 1).alias("pos"), "ord", "hot")
    cold = rows.where(F.col("pos") <= F.col("hot")).drop("hot").repartition("key").sortWithinPartitions("key", "ord", "cid").mapInArrow(_repeated, _ROWS)
    often = rows.where(F.col("pos") > F.col("hot")).drop("hot")
    groups = checkpointed(often.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min_by("cid", "ord").alias("a"), F.min_by("n", "ord").alias("m")
                                                   ).where("_n > 1"))
    return checkpointed(cold.unionByName(_of_groups(often, groups).drop("_n", "ord")))


def _links(reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links that join all classes whose sets are similar enough."""
    rows = _shared_rows(reps)
    star = rows.where((F.col("cid") != F.col("a")) & _long_enough("n", "m", percent)).select("a", F.col("cid").alias("b"))
    links = _verified(star, reps, size, percent).toDF("u", "v")
    joined = _joined(links)
    rows = rows.select("key", "cid", "n", "pos").join(joined, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    return joined.toDF("u", "v").unionByName(_verified(_remaining_pairs(rows, reps, percent), reps, size, percent).toDF("u", "v"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: _rid, doc_id, n_shingles, component_id.

    Words are split at ASCII white space after lower-casing A-Z. Sets are
    linked when 100 * intersection >= percent * union. A null or empty text, or
    one without words, has no shingles and links with nothing; fewer words than
    ``size`` are one shingle. component_id is the smallest id that links reach,
    the row's own included; null ids count only where there is no other.
    Repeated rows and equal sets are linked like others. Other columns are not
    looked at; an empty table gives an empty result.
    """
    docs = stable(docs)
    source = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)})
    folder = shared_folder(docs.sparkSession, "sets")
    _read_sets(source, size).write.parquet(f"{folder}/rows")
    read = docs.sparkSession.read.parquet(f"{folder}/rows")
    rows = read.where("block is null").select("_rid", "doc_id", "n", "digest")
    total, n_rows = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
    rarity = _rarity(read.where("block is not null").select("block", "counts"), total or 0)
    sets = rows.where("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("low"), F.min("_rid").alias("_first"))
    sets = checkpointed(sets.withColumn("cid", F.monotonically_increasing_id()))
    texts = source.join(sets.select("cid", "digest", F.col("_first").alias("_rid")), "_rid").select("cid", "digest", "text")
    _representatives(texts, rarity, size, percent).write.option("compression", "zstd").parquet(f"{folder}/sets")
    reps = docs.sparkSession.read.parquet(f"{folder}/sets")

    root = _joined(_links(reps, size, percent)).toDF("cid", "root")
    linked = checkpointed(sets.select("cid", "digest", "low", F.col("_n").alias("_docs")).join(root, "cid", "left").withColumn(
        "root", F.coalesce("root", "cid")))
    tops = checkpointed(linked.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("_n")))
    of_set = checkpointed(lookup_join(linked.withColumn("_rid", F.col("cid")), tops, ["root"], linked.count()).select(
        "digest", F.col("_docs").alias("_n"), "component"))
    out = lookup_join(rows.where("n > 0"), of_set, ["digest"], n_rows).select("_rid", "doc_id", F.col("n").alias("n_shingles"), F.col(
        "component").alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("_rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
