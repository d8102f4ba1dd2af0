"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Texts are cut by the vocabulary's pattern and their distinct words are set out
end to end as bytes. An inverted index holds, for each pair of neighbouring
tokens that some rank merges, the positions where it stands. Merges are replayed
over the whole corpus of words, lowest rank first: all of a pair's positions
are merged at once, and only the pairs with the touched neighbours are taken
out of and put into the index. A text's ids are then its words' ids in order.

A replay covers the words of one slice of documents (``SLICE_CHARS`` characters
at most, or one longer document), so tasks need neither the other tasks' words nor a shuffle of
all word occurrences.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from upswell.llm.common import text_bytes, with_row_id

SLICE_CHARS = 2_000_000
# First and last code points that the vocabulary library's character tables (Unicode 16) have neither as
# letters nor as digits, while this module's regular expressions, whose tables are newer, do.
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_IS_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _NEWER) + "]")
_BESIDE_BLANK = re.compile(r" \s|\s | \Z")


class Vocabulary:
    """Ranks of a tiktoken file: token bytes by id, and the rank that merges each pair of ids.

    A pair's rank is that of its joined bytes, whichever pair of tokens gives
    them. ``stepwise`` has the ranks whose token is the end of a token of lower
    rank: merging one may open a pair that goes before the merge's other places.
    """

    def __init__(self, tokens: list[bytes], byte_ids: np.ndarray, pair_keys: np.ndarray, pair_ranks: np.ndarray, stepwise: np.ndarray) -> None:
        self.tokens, self.byte_ids, self.pair_keys, self.pair_ranks, self.stepwise = tokens, byte_ids, pair_keys, pair_ranks, stepwise
        self.size = len(tokens)

    @staticmethod
    def tables(ranks_file: bytes) -> tuple:
        """What the constructor takes, from a file: worked out once and broadcast, so that tasks needn't."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            tokens[r] = token
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, stepwise = {}, np.zeros(len(tokens), bool)
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * len(tokens) + b] = r
                for x in (a, b):
                    if x is not None and x > r:
                        stepwise[x] = True
        keys = sorted(pairs)
        return tokens, byte_ids, np.array(keys, np.int64), np.array([pairs[k] for k in keys], np.int32), stepwise

    @classmethod
    def from_file(cls, ranks_file: bytes) -> Vocabulary:
        return cls(*cls.tables(ranks_file))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where none merges it."""
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1) if len(self.pair_keys) else np.full(len(keys), -1)

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join(map(tokens.__getitem__, ids.tolist()))


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, start of each word and the end of the last)."""
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = int(starts[-1])
    token = np.full(n + 1, -1, np.int32)
    token[:n] = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    place = np.int32 if n < 1 << 30 else np.int64
    word = np.repeat(np.arange(len(words), dtype=place), lengths)
    after, before = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
    last = np.zeros(n + 1, bool)  # no neighbour to the right in the same word
    last[starts[1:][lengths > 0] - 1] = True
    last[n] = True

    index: dict[int, list[np.ndarray]] = {}
    pending: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        at = at[~last[at]]
        ranks = vocabulary.rank_of(token[at], token[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else [], np.split(at, cuts)):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(pending, r)

    enter(np.arange(n, dtype=place))
    while pending:
        rank = heapq.heappop(pending)
        parts = index.pop(rank)
        at = np.sort(np.concatenate(parts))
        at = at[(token[at] >= 0) & ~last[at] & np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[vocabulary.rank_of(token[at], token[after[at]]) == rank]  # postings that a merge has changed since
        if not len(at):
            continue
        kept = at
        if vocabulary.stepwise[rank]:
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            kept, waiting = at[first], at[~first]
        else:
            waiting = at[:0]
            if len(at) > 1 and (after[at[:-1]] == at[1:]).any():  # a run of one token: every other place, from the left
                touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
                run_start = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
                kept = at[(np.arange(len(at)) - run_start) % 2 == 0]
        right = after[kept]
        token[kept], token[right] = rank, -1
        last[kept] = last[right]
        after[kept] = after[right]
        inner = kept[~last[kept]]
        before[after[inner]] = inner
        left = before[kept]
        has_left = (left >= 0) & (word[np.maximum(left, 0)] == word[kept])
        enter(np.concatenate([kept, left[has_left]]))
        if len(waiting):
            if rank not in index:
                index[rank] = []
                heapq.heappush(pending, rank)
            index[rank].append(waiting)
    alive = token[:n] >= 0
    counts = np.concatenate([[0], np.cumsum(alive)])
    return token[:n][alive], counts[starts]


def _pieces(text: str) -> list[str] | None:
    """The text cut before every blank, where the pattern's matches surely end; None if some blank has white space beside it."""
    if _BESIDE_BLANK.search(text):
        return None
    head, *rest = text.split(" ")
    return [head, *[" " + p for p in rest]]


def _matches(pattern, text: str) -> list[str]:
    """All matches of the vocabulary's pattern; letters newer than the library's tables are matched as symbols."""
    if text.isascii() or not _IS_NEWER.search(text):
        return pattern.findall(text)
    return [text[slice(*m.span())] for m in pattern.finditer(_IS_NEWER.sub("\uffff", text))]


def encode_slice(texts: list[str], vocabulary: Vocabulary, pattern) -> list[np.ndarray]:
    """Ids of each text; every distinct word is merged once.

    Most texts are cut at single blanks first, so that the pattern runs only
    over each distinct piece; the others are matched as a whole.
    """
    number: dict[str, int] = defaultdict(count().__next__)
    lines = []
    for t in texts:
        pieces = _pieces(t)
        lines.append(np.fromiter(map(number.__getitem__, _matches(pattern, t) if pieces is None else pieces), np.int32))
    of_word: dict[str, int] = defaultdict(count().__next__)
    words_of = [[of_word[w] for w in _matches(pattern, p)] for p in number]
    ids, starts = replay([w.encode() for w in of_word], vocabulary)
    ids, bounds = _gather(ids, starts, np.fromiter(chain.from_iterable(words_of), np.int32),
                          np.cumsum([0, *map(len, words_of)]))
    del number, of_word, words_of
    ids, ends = _gather(ids, bounds, np.concatenate(lines) if lines else np.zeros(0, np.int32), np.cumsum([0, *map(len, lines)]))
    return np.split(ids, ends[1:-1]) if texts else []


def _gather(values: np.ndarray, starts: np.ndarray, wanted: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[i]:starts[i + 1]]`` for each wanted i, end to end; and where each group of them begins."""
    sizes = np.diff(starts)[wanted]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat((starts[wanted] - ends[:-1]).astype(np.int32 if max(ends[-1], starts[-1]) < 1 << 31 else np.int64), sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return values[at], ends[groups]


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts, together of a bounded size (a longer text is a slice of its own)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


_ENCODED = "_rid long, doc_id long, ids array<int>"
_ENCODED_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = "_rid long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                           ("decoded_sha256", pa.string())])


def _with_vocabulary(rows: DataFrame, ranks_path: str, per_batch, schema: str) -> DataFrame:
    with open(ranks_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.tables(f.read()))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        for b in batches:
            yield per_batch(b, vocabulary)

    return rows.mapInArrow(run, schema)


def _encoded_slices(pattern: str):
    """Ids of a batch's texts, slice by slice, so that a batch's ids needn't be held at once."""
    def encoded(b: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[list[np.ndarray]]:
        compiled = regex.compile(pattern)
        for part in slices(b.column("text").to_pylist()):
            yield encode_slice(part, vocabulary, compiled)

    return encoded


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col).cast("string")})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _rid, doc_id, ids. A null or empty text has no ids; no special tokens.

    Whole texts of any length; other columns are not looked at; an empty table
    gives an empty result.
    """
    encoded = _encoded_slices(pattern)

    def per_batch(b: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
        ids = [x.astype(np.int32) for part in encoded(b, vocabulary) for x in part]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], schema=_ENCODED_ARROW)

    return _with_vocabulary(_source(docs, id_col, text_col), ranks_path, per_batch, _ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``encode`` as _rid, doc_id, decoded (the bytes of the ids)."""

    def per_batch(b: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
        texts = [vocabulary.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["_rid", "doc_id", "decoded"])

    return _with_vocabulary(encoded.select("_rid", "doc_id", "ids"), ranks_path, per_batch, "_rid long, doc_id long, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: _rid, doc_id, n_tokens, and the SHA-256 of ids and of decoded bytes."""
    encoded = _encoded_slices(pattern)

    def per_batch(b: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
        sizes, digests, decoded = [], [], []
        for part in encoded(b, vocabulary):
            sizes += [len(x) for x in part]
            digests += [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in part]
            decoded += [hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in part]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                                           pa.array(decoded, pa.string())], schema=_DIGEST_ARROW)

    return _with_vocabulary(_source(docs, id_col, text_col), ranks_path, per_batch, _DIGEST)
