"""Benchmark decontamination by a prefix-filtered set join.

A benchmark text is cut into item-sized windows (13 words; a shorter text is one
window). A window can only occur where all its word shingles occur, so one of
them, the one rarest in the corpus, is its necessary prefix token: documents are
joined to windows on that shingle alone. Positional and length bounds then fix
where the window would have to begin and end in the document, and the words
there are compared one by one.

The benchmark side is dealt into blocks of at most ``BLOCK_WORDS`` window words;
each block is broadcast and all documents pass it, so a benchmark of any size is
searched in full with bounded memory.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import keep_rows, stable, text_bytes, with_row_id

WINDOW, SHINGLE = 13, 5
BLOCK_WORDS = 2_000_000
"""Words in the item texts of one broadcast block."""

# Bytes of words stay (A-Z lower-cased), all other ASCII becomes a blank.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 32
                    for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, letters and all that isn't ASCII."""
    return text.translate(_WORD_BYTES).split()


class ItemBlock:
    """Windows of some benchmark items over a numbered vocabulary.

    items: (id, words) pairs. A window shorter than a shingle is looked up by
    all its words; ``sizes`` are the shingle lengths in use.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.windows.setdefault(tuple(ids[i:i + size]), set()).add(number[name])
        self.shingle = shingle
        self.shingles = sorted({s for w in self.windows for s in self._shingles(w)})
        self.number = {s: i for i, s in enumerate(self.shingles)}
        self.sizes = sorted({len(s) for s in self.shingles})
        self.by_prefix: dict[tuple[int, ...], list[tuple[int, tuple[int, ...], tuple[int, ...]]]] = {}

    def _shingles(self, window: tuple[int, ...]) -> list[tuple[int, ...]]:
        k = min(self.shingle, len(window))
        return [window[i:i + k] for i in range(len(window) - k + 1)]

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        """Choose each window's prefix: its rarest shingle, ties by the words' numbers."""
        self.by_prefix = {}
        for w, items in self.windows.items():
            at, s = min(enumerate(self._shingles(w)), key=lambda x: (counts.get(self.number[x[1]], 0), x[1]))
            self.by_prefix.setdefault(s, []).append((at, w, tuple(sorted(items))))

    def candidates(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...], np.ndarray]]:
        """(position, shingle, word numbers) for every shingle of known words that some window has."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        for k in self.sizes:
            if len(ids) < k:
                continue
            known = np.concatenate([[0], np.cumsum(ids >= 0)])
            for p in np.flatnonzero(known[k:] - known[:-k] == k).tolist():
                s = tuple(ids[p:p + k].tolist())
                if s in self.number:
                    yield p, s, ids

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words that are window occurrences, and the items that have them."""
        spans, items = [], set()
        for p, s, ids in self.candidates(words):
            for at, window, names in self.by_prefix.get(s, ()):
                start = p - at
                end = start + len(window)
                if start >= 0 and end <= len(ids) and tuple(ids[start:end].tolist()) == window:
                    spans.append((start, end))
                    items.update(names)
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> Iterator[ItemBlock]:
    """The benchmark's items as blocks of a bounded number of words, read row by row."""
    items, held = [], 0
    rows = benchmark.select(benchmark[id_col].cast("string").alias("name"), text_bytes(benchmark, text_col).alias("text"))
    for r in rows.where(F.col("name").isNotNull()).toLocalIterator():
        words = words_of(bytes(r["text"]))
        if not words:
            continue
        if items and held + len(words) > BLOCK_WORDS:
            yield ItemBlock(items, window, shingle)
            items, held = [], 0
        items.append((r["name"], words))
        held += len(words)
    if items:
        yield ItemBlock(items, window, shingle)


_HITS = "_rid long, doc_id long, _text binary, _starts array<int>, _ends array<int>, _items array<string>"
_HITS_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("_text", pa.binary()), ("_starts", pa.list_(pa.int32())),
                         ("_ends", pa.list_(pa.int32())), ("_items", pa.list_(pa.string()))])
_RESULT = "_rid long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"
_RESULT_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                           ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
                           ("item_ids", pa.list_(pa.string()))])


def _shingle_counts(docs: DataFrame, block) -> dict[int, int]:
    """Occurrences of each of the block's shingles in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pickle.loads(block.value)
        total: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, s, _ in b.candidates(words_of(text)):
                    n = b.number[s]
                    total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["s", "n"])

    found = docs.select("_text").mapInArrow(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in found.toLocalIterator()}  # at most one for each shingle of the block


def _search(docs: DataFrame, block, last: bool, share: int) -> DataFrame:
    """Add a block's hits to the rows; the last block turns them into the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pickle.loads(block.value) if block is not None else ItemBlock([])
        for batch in batches:
            rid, doc, texts = (batch.column(i).to_pylist() for i in range(3))
            before = [batch.column(i).to_pylist() for i in range(3, 6)] if batch.num_columns > 3 else None
            found, n_words = [], []
            for i, text in enumerate(texts):
                words = words_of(text)
                spans, items = b.occurrences(words) if b.by_prefix else ([], set())
                names = {b.names[x] for x in items}
                if before is not None:
                    spans += list(zip(before[0][i], before[1][i]))
                    names.update(before[2][i])
                found.append((_merged(spans), sorted(names)))
                n_words.append(len(words))
            if last:
                hit = [sum(e - s for s, e in spans) for spans, _ in found]
                arrays = [rid, doc, n_words, hit, [len(n) for _, n in found],
                          [hashlib.sha256(",".join(n).encode()).hexdigest() for _, n in found],
                          [h > 0 and share * h >= n for h, n in zip(hit, n_words)], [n for _, n in found]]
            else:
                arrays = [rid, doc, texts, [[s for s, _ in spans] for spans, _ in found], [[e for _, e in spans] for spans, _ in found],
                          [n for _, n in found]]
            schema = _RESULT_ARROW if last else _HITS_ARROW
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)

    return docs.mapInArrow(run, _RESULT if last else _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """One row per document: _rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A word is hit inside any occurrence of an item's window; a document is
    contaminated when it has hits and they make up 1/``share`` of its words or
    more. A null text has no words; an item without words or without an id
    occurs nowhere; rows with the same item id are one item with all their
    windows. Empty documents give an empty result, an empty benchmark no hits.
    Other columns are not looked at.
    """
    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "_text": text_bytes(docs, text_col)})
    sc, blocks = docs.sparkSession.sparkContext, []
    for b in _item_blocks(benchmark, item_id_col, item_text_col, window, shingle):
        plain = sc.broadcast(pickle.dumps(b))
        b.order_by_rarity(_shingle_counts(rows, plain))
        plain.unpersist()
        blocks.append(sc.broadcast(pickle.dumps(b)))
    out = rows
    for i, b in enumerate(blocks or [None]):
        out = _search(out, b, i + 1 >= len(blocks), share)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, columns as they were."""
    docs = stable(docs)
    return keep_rows(docs, contamination(docs, benchmark, id_col, text_col).where("contaminated"), id_col)
