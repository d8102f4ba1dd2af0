"""Token ids in files of range-coded blocks.

Ids are written in blocks of a fixed number of ids. A block starts from nothing:
it lists its distinct ids, codes each id's place in that list with its own
adaptive model, and ends with a CRC-32, so that blocks can be read in any order
and a damaged one is found.

The model mixes three predictions, all learned from the ids of the block before
the one to code. Order 0 is a table of frequencies, renewed every ``EPOCH`` ids.
Orders 1 and 2 name the id that came last after the same one or two ids; each
gets a share of the probability that follows how often it was right so far.
Their sum drives a range coder. Blocks are coded side by side: a step codes the
next id of many blocks with array operations.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, row_place, text_bytes, with_row_id

BLOCK, LANES, EPOCH = 4096, 2048, 1024
_SCALE, _ZERO = 16, 14  # bits of all probability, and of the order-0 table
_STEP = 24
HELD_PIECES = 500_000
_CONTEXTS = 1 << 12
_MOST = 3 << (_SCALE - 3)  # the largest share of orders 1 and 2, each
_TOP, _BOTTOM = 1 << 48, 1 << 32
_MAGIC = b"IDB2"


class Model:
    """The adaptive mixture for blocks side by side, as its decoder keeps it; ``_intervals`` has the same for whole blocks at once.

    Tables are flat, a stretch for each block, so that a step looks all blocks
    up by one index array. Row 0 of what holds orders 1 and 2 is of order 1.
    What a block's ids are predicted from is the block alone, not what is coded
    beside it.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        n = len(sizes)
        self.sizes, self.width = sizes, int(sizes.max(initial=1))
        self.counts = _first_counts(sizes, self.width)
        self.at = np.arange(n) * (self.width + 2) + 1  # of an id's bound in the table of order 0; the place before is for no prediction
        self.at_inverse = np.arange(n) << _ZERO
        self.after = np.full(n * (self.width + 1 + _CONTEXTS), -1, np.int16)
        self.at_after = np.stack([np.arange(n) * (self.width + 1), n * (self.width + 1) + np.arange(n) * _CONTEXTS])
        self.place = self.at_after + 0
        self.last = np.zeros(n, np.int64)
        self.trust = np.full((2, n), _MOST >> 2, np.int64)  # share of orders 1 and 2 where they have a prediction

    def renew(self, ids: np.ndarray) -> None:
        """Set the order-0 tables by the counts so far and those of the ids (a row a step)."""
        k = ids.shape[1]
        _count(self.counts, ids.T)
        bounds = _spread(self.counts[:k], self.sizes[:k])
        self.bounds = np.pad(bounds, ((0, 0), (1, 0))).ravel()
        own = np.tile(np.arange(self.width, dtype=np.int16), k)
        self.inverse = np.repeat(own, np.diff(bounds).ravel())

    def keep(self, k: int) -> None:
        """Go on with the first k blocks."""
        self.at, self.at_inverse, self.last = self.at[:k], self.at_inverse[:k], self.last[:k]
        self.at_after, self.place, self.trust = (np.ascontiguousarray(x[:, :k]) for x in (self.at_after, self.place, self.trust))

    def find(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that hold the targets, where their probabilities begin and how large they are; the ids are learned.

        The id is a predicted one, or one of the table once the shares below the target are taken off.
        """
        take, bounds = np.take, self.bounds
        guess = take(self.after, self.place, mode="clip").astype(np.int64)
        known = guess >= 0
        share = self.trust * known
        rest = (1 << _SCALE) - share[0] - share[1]
        at = guess + self.at
        low = (take(bounds, at, mode="clip") * rest) >> _ZERO
        high = (take(bounds, at + 1, mode="clip") * rest) >> _ZERO
        other, its = guess[::-1], share[::-1]  # what the other prediction adds before this one's place
        low += its * (other < guess)
        high += its * (other <= guess)
        high += share
        above = target >= high
        hit = (target >= low) > above
        below = share * above
        place = (((target - below[0] - below[1] + 1 << _ZERO) - 1) / rest).astype(np.int64)  # exact: below 2**53
        np.minimum(place, (1 << _ZERO) - 1, out=place)
        s = take(self.inverse, place + self.at_inverse, mode="clip").astype(np.int64)
        np.copyto(s, guess[0], where=hit[0])
        np.copyto(s, guess[1], where=hit[1])
        at = s + self.at
        zero = (take(bounds, at, mode="clip") * rest) >> _ZERO
        right = guess == s
        before, more = share * (guess < s), share * right
        begin = zero + before[0] + before[1]
        size = ((take(bounds, at + 1, mode="clip") * rest) >> _ZERO) - zero + more[0] + more[1]
        self.trust += ((right * _MOST - self.trust) * known) >> 5
        self.after[self.place] = s
        now = s + 1
        self.place[0] = now
        self.place[1] = (self.last * 40503 + now * 2531) & (_CONTEXTS - 1)
        self.place += self.at_after
        self.last = now
        return s, begin, size


def _first_counts(sizes: np.ndarray, width: int) -> np.ndarray:
    return (np.arange(width)[None, :] < sizes[:, None]).astype(np.int64)


def _count(counts: np.ndarray, ids: np.ndarray) -> None:
    """Add the ids (a row a block) to the first blocks' counts."""
    k, width = len(ids), counts.shape[1]
    found = np.bincount((ids + np.arange(k)[:, None] * width).ravel(), minlength=k * width)
    counts[:k] += _STEP * found.reshape(k, width)


def _spread(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order-0 tables by the counts, as bounds below 2**14; every id of a block keeps a chance."""
    whole = np.zeros((len(counts), counts.shape[1] + 1), np.int64)
    np.cumsum(counts, axis=1, out=whole[:, 1:])
    spread = (whole * ((1 << _ZERO) - sizes[:, None]) / whole[:, -1:]).astype(np.int64)  # exact: below 2**53
    return spread + np.minimum(np.arange(whole.shape[1]), sizes[:, None])


def _came_after(contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every id of each block (a row) the one that came last after the same context, -1 if there was none."""
    at = np.argsort(contexts, axis=1, kind="stable") + np.arange(len(ids))[:, None] * ids.shape[1]
    context, s = contexts.ravel()[at], ids.ravel()[at]
    out = np.full(ids.size, -1, np.int16)
    out[at[:, 1:]] = np.where(context[:, 1:] == context[:, :-1], s[:, :-1], np.int16(-1))
    return out.reshape(ids.shape)


def _intervals(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the probabilities of the ids of each block (a row) begin and how large they are, of 2**16: for ``EPOCH`` ids
    at a time, a row a step. What ``Model`` finds id by id."""
    n, most = ids.shape
    width = int(sizes.max(initial=1))
    guesses = np.empty((2, n, most), np.int16)
    for i in range(0, n, 128):
        own = ids[i:i + 128]
        last = np.zeros((len(own), most + 1), np.uint32)  # 0: none
        last[:, 2:] = own[:, :-1] + 1
        guesses[0, i:i + 128] = _came_after(last[:, 1:].astype(np.uint16), own)
        guesses[1, i:i + 128] = _came_after(((last[:, :-1] * 40503 + last[:, 1:] * 2531) & (_CONTEXTS - 1)).astype(np.uint16), own)
    counts, rows = _first_counts(sizes, width), np.arange(n) * (width + 1)
    trust = np.full((2, n), _MOST >> 2, np.int32)
    for t in range(0, most, EPOCH):
        if t:
            _count(counts, ids[:, t - EPOCH:t])
        bounds = _spread(counts, sizes).astype(np.int32).ravel()
        s = np.ascontiguousarray(ids[:, t:t + EPOCH].T)
        guess = np.stack([g[:, t:t + EPOCH].T for g in guesses], axis=1)
        known, right = (guess >= 0).astype(np.int32), guess == s[:, None]
        aim, share = right * np.int32(_MOST), np.empty(guess.shape, np.int32)
        for held, to, k in zip(share, aim, known):
            held[:] = trust
            to -= trust
            to *= k
            to >>= 5
            trust += to
        share *= known
        rest = (1 << _SCALE) - share[:, 0] - share[:, 1]
        at = s + rows
        zero = bounds[at] * rest >> _ZERO
        before, more = share * (guess < s[:, None]), share * right
        begin = zero + before[:, 0] + before[:, 1]
        size = (bounds[at + 1] * rest >> _ZERO) - zero + more[:, 0] + more[:, 1]
        over = np.arange(t, t + len(s))[:, None] >= lengths
        begin[over], size[over] = 0, 1 << _SCALE  # nothing is written for what a block doesn't have
        yield begin.astype(np.int64), size.astype(np.int64)


def _range_code(lanes: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    """Code sequences of numbers below their sizes, as words of 16 bits."""
    lengths = np.array([len(x) for x in lanes])
    n, most = len(lanes), int(lengths.max(initial=0))
    ids = np.zeros((n, most), np.int16)
    for i, x in enumerate(lanes):
        ids[i, :len(x)] = x
    low, width = np.zeros(n, np.int64), np.full(n, _TOP, np.int64)
    words, written = [np.zeros((0, n), np.int32)], [np.zeros((0, n), bool)]
    for begin, size in _intervals(ids, lengths, np.maximum(sizes, 1)):
        word, full = np.empty(begin.shape, np.int32), np.empty(begin.shape, bool)
        for a, s, w, f in zip(begin, size, word, full):
            width >>= _SCALE
            a *= width
            low += a
            width *= s
            np.less(width, _BOTTOM, out=f)
            top = low >> 32
            w[:] = top  # may hold a carry for the word before
            top <<= 32
            top *= f
            low -= top
            bits = f * np.int64(16)
            low <<= bits
            width <<= bits
        words.append(word)
        written.append(full)
    words, written = np.ascontiguousarray(np.concatenate(words).T), np.ascontiguousarray(np.concatenate(written).T)
    out = []
    for own, full, end in zip(words, written, low.tolist()):
        own = np.append(own[full], [end >> 32, end >> 16 & 0xFFFF, end & 0xFFFF])
        number = int.from_bytes((own & 0xFFFF).astype(">u2").tobytes(), "big") + (int.from_bytes((own >> 16).astype(">u2").tobytes(), "big") << 16)
        out.append(number.to_bytes(2 * len(own), "big"))
    return out


def _range_decode(lanes: list[bytes], lengths: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sequences that ``_range_code`` was given; the longest first."""
    n, most = len(lanes), int(lengths.max(initial=0))
    words = np.zeros((n, max((len(x) for x in lanes), default=0) // 2 + 4), np.uint16)
    for i, x in enumerate(lanes):
        words[i, :len(x) // 2] = np.frombuffer(x, ">u2", len(x) // 2)
    at = np.arange(n) * words.shape[1] + 3  # of a block's next word
    code = (words[:, 0].astype(np.int64) << 32) + (words[:, 1].astype(np.int64) << 16) + words[:, 2]
    words, width, out = words.ravel(), np.full(n, _TOP, np.int64), np.zeros((most, n), np.int16)
    model, ends, k = Model(np.maximum(sizes, 1)), set(lengths.tolist()), n
    for t in range(most):
        if t in ends:
            k = int(np.searchsorted(-lengths, -t))  # blocks longer than t
            code, width, at = code[:k], width[:k], at[:k]
            model.keep(k)
        if t % EPOCH == 0:
            model.renew(out[max(0, t - EPOCH):t, :k])
        width >>= _SCALE
        target = (code / width).astype(np.int64)  # exact: below 2**48, and a quotient below 2**17
        np.minimum(target, (1 << _SCALE) - 1, out=target)
        s, begin, size = model.find(target)
        out[t, :k] = s
        begin *= width
        code -= begin
        width *= size
        full = width < _BOTTOM
        bits = full * np.int64(16)
        code <<= bits
        width <<= bits
        code += np.take(words, at, mode="clip") * full
        at += full
    return [out[:length, i] for i, length in enumerate(lengths.tolist())]


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and the place of each id among them."""
    if not len(ids) or ids.max() >> 20:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    head = np.flatnonzero(there)
    place = np.empty(len(there), np.int16)
    place[head] = np.arange(len(head))
    return head, place[ids]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes: magic, number of ids, distinct ids as gaps, coded ids, CRC-32 of all that."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for start in range(0, len(order), LANES):
        own = order[start:start + LANES]
        heads, lanes = zip(*(_distinct(blocks[i]) for i in own))
        if any(len(head) > 1 << _ZERO for head in heads):
            raise ValueError("a block has more distinct ids than order 0 has places")
        for i, head, body in zip(own, heads, _range_code(list(lanes), np.array([len(h) for h in heads]))):
            gaps = np.diff(head, prepend=0).astype("<u4")
            narrow = bool((gaps[1:] < 256).all()) and len(gaps) > 0
            listed = gaps[:1].tobytes() + gaps[1:].astype("u1").tobytes() if narrow else gaps.tobytes()
            raw = _MAGIC + np.array([len(blocks[i]), len(head), int(narrow)], "<u4").tobytes() + listed + body
            out[i] = raw + zlib.crc32(raw).to_bytes(4, "little")
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of the blocks; a block whose checksum doesn't fit is an error."""
    parts = []
    for raw in blocks:
        if raw[:4] != _MAGIC or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise ValueError("damaged block of ids")
        length, distinct, narrow = np.frombuffer(raw, "<u4", 3, 4).tolist()
        if narrow:
            gaps = np.concatenate([np.frombuffer(raw, "<u4", 1, 16).astype(np.int64), np.frombuffer(raw, "u1", distinct - 1, 20)])
        else:
            gaps = np.frombuffer(raw, "<u4", distinct, 16).astype(np.int64)
        parts.append((length, np.cumsum(gaps), raw[20 + distinct - 1 if narrow else 16 + 4 * distinct:-4]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(blocks)
    order = sorted(range(len(parts)), key=lambda i: -parts[i][0])
    for start in range(0, len(order), LANES):
        own = order[start:start + LANES]
        found = _range_decode([parts[i][2] for i in own], np.array([parts[i][0] for i in own]), np.array([len(parts[i][1]) for i in own]))
        for i, x in zip(own, found):
            out[i] = parts[i][1][x] if len(x) else np.zeros(0, np.int64)
    return out


_BLANK, _MARK, _CAPITAL, _LETTER = (np.uint8(1 << i) for i in range(4))
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((_BLANK, b" \t\n\r"), (_MARK, b",."), (_CAPITAL, bytes(range(65, 91))), (_LETTER, bytes([*range(65, 91), *range(97, 123)]))):
    _KINDS[list(_bytes)] |= _kind


def _is_word(piece: str) -> bool:
    return piece.isalpha()


class TextEncoder:
    """Ids of texts by a tokenizer for which white space parts tokens and is dropped.

    Each distinct piece between blanks is encoded once; the pieces' ids are held
    for the texts that follow, until ``HELD_PIECES`` are. Where the tokenizer
    has them as tokens of their own, a comma or full stop at the end of a word is a piece
    too, and where it lower-cases, so are pieces before they are told apart.
    """

    def __init__(self, tokenizer, end_id: int) -> None:
        self.tokenizer, self.end_id = tokenizer, end_id
        normalizer, split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.lowers = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.parts_marks = split is not None and all(len(split.pre_tokenize_str("z" + x)) == 2 for x in ",.")
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
        self.between = special[0] if special else None
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = None
        if suffix:
            self.ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
            self.ends_word[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count(1).__next__)
        # piece 0 is the end
        self.ids, self.begins, self.sizes = np.array([self.end_id], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another and how many each has, from one text where that tells the pieces apart: words each
        end with a token that ends a word; others are parted by a special token, which none of them may make itself."""
        if self.ends_word is not None and all(map(_is_word, pieces)):
            ids = np.array(self._encoded([" ".join(pieces)])[0], np.int32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == len(pieces) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        elif self.between:
            ids = np.array(self._encoded([f" {self.between} ".join(pieces)])[0], np.int32)
            cuts = np.flatnonzero(ids == self.tokenizer.token_to_id(self.between))
            if len(cuts) == len(pieces) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        each = self._encoded(pieces)
        return np.fromiter(chain.from_iterable(each), np.int32), np.array([len(x) for x in each])

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, which have the next numbers, words before others."""
        words = np.fromiter(map(_is_word, pieces), bool, len(pieces))
        order = np.argsort(~words, kind="stable")
        ids, sizes = [self.ids], []
        edges = [*range(0, words.sum(), 256), *range(words.sum(), len(pieces), 256), len(pieces)]
        for i, j in zip(edges, edges[1:]):
            found, each = self._joined([pieces[x] for x in order[i:j]])
            ids.append(found)
            sizes.append(each)
        ends = len(self.ids) + np.cumsum(np.concatenate(sizes), dtype=np.int64)
        begins, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        size[order] = np.concatenate(sizes)
        begins[order] = ends - size[order]
        self.ids, self.begins, self.sizes = np.concatenate(ids), np.concatenate([self.begins, begins]), np.concatenate([self.sizes, size])

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (none null) one after another, each with the end id, and how many each has."""
        if len(self.number) > HELD_PIECES:
            self.forget()
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        # blank, tab, line feed, carriage return: white space to the vocabulary's own pattern, whatever stands beside it
        kind = np.take(_KINDS, raw)
        blank = (kind & _BLANK).view(bool)
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:] = blank
        begins[offsets] = True
        if self.parts_marks and len(raw) > 2:  # a mark between a letter and a blank, so that no other character can change it
            begins[1:-2] |= (kind[:-2] >= _LETTER) & (kind[1:-1] == _MARK) & blank[2:]
        if self.lowers and len(raw) and b"<|" not in raw.tobytes():  # a special token's name is told by case
            capital = kind & _CAPITAL
            capital[:-1] *= raw[1:] < 128  # else a sign that combines with the letter may follow
            raw = raw + (capital << 3)
        begins = np.flatnonzero(begins)
        gone = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
        pieces = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer((begins - gone[begins]).astype(np.int32)), pa.py_buffer(raw[~blank]))
        pieces = pieces.dictionary_encode()
        before = len(self.number)
        numbers = np.array([self.number[x] for x in pieces.dictionary.to_pylist()], np.int64)
        if len(self.number) > before:
            self._learn(list(islice(self.number, before, None)))
        ends = np.searchsorted(begins, offsets[1:])  # of each text's pieces
        line = np.insert(numbers[pieces.indices.to_numpy()], ends, 0)
        n = self.sizes[line]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.begins[line] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.diff(stop[ends + np.arange(len(ends))], prepend=0)


# Columns of a file of blocks. For each document in a block: its row number and id, how many ids it has there and in all.
_FILE = "part int, block int, row_ids array<long>, doc_ids array<long>, parts array<int>, totals array<int>, payload binary"
_FILE_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("row_ids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
                         ("parts", pa.list_(pa.int32())), ("totals", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_ids(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
              block: int = BLOCK) -> None:
    """Encode all texts and write their ids, in ascending order of the ids of documents, to block files under ``path``.

    The files are Parquet files of blocks, part by part (``part`` counts up with
    the ids of documents), a block a row. A null text is empty; each document
    has at least the end id; null document ids come first, rows of one id in
    the order of the table.
    """
    with open(tokenizer_json, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    place = {f"_place{i}": c for i, c in enumerate(row_place(docs))}
    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col).cast("string"), **place})
    order = ["doc_id", *place, "_rid"]  # elsewhere than in a scan the number counts up with the rows
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_rid", "doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = TextEncoder(Tokenizer.from_buffer(shared.value), end_id)
        held_ids, held_docs, held, made, part = [], [], 0, 0, 0

        def cut(ids: list[np.ndarray], marks: list[tuple[int, int | None, int, int]], last: bool):
            """Full blocks of what is held; the rest is held on, or is a block too at the end."""
            nonlocal made
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            n = -(-len(flat) // block) if last else len(flat) // block
            pieces = [flat[i * block:(i + 1) * block] for i in range(n)]
            meta: list[tuple[list, ...]] = []
            i = 0
            for piece in pieces:
                left, own = len(piece), ([], [], [], [])
                while left:
                    rid, doc, size, whole = marks[i]
                    take = min(size, left)
                    for column, value in zip(own, (rid, doc, take, whole)):
                        column.append(value)
                    left -= take
                    if take == size:
                        i += 1
                    else:
                        marks[i] = (rid, doc, size - take, whole)
                meta.append(own)
            payload = encode_blocks(pieces)
            numbers = list(range(made, made + n))
            made += n
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(numbers, pa.int32()), *(pa.array([m[j] for m in meta], _FILE_ARROW.field(2 + j).type)
                                                                                   for j in range(4)), pa.array(payload, pa.binary())], schema=_FILE_ARROW)
            return out, [flat[n * block:]], marks[i:]

        for b in batches:
            part = b.column(3)[0].as_py() if len(b) else part
            for i in range(0, len(b), 4096):
                rid, doc, texts = (b.column(j).slice(i, 4096) for j in range(3))
                own, sizes = encoder(texts.cast(pa.string()))
                held_ids.append(own)
                held_docs += zip(rid.to_pylist(), doc.to_pylist(), sizes.tolist(), sizes.tolist())
                held += len(own)
                if held >= LANES * block:
                    out, held_ids, held_docs = cut(held_ids, held_docs, False)
                    held = sum(map(len, held_ids))
                    yield out
        out, _, _ = cut(held_ids, held_docs, True)
        yield out

    ordered.mapInArrow(run, _FILE).write.parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """(row of the file without its payload, ids) for every block; some blocks are decoded side by side."""
    for whole in batches:
        for i in range(0, whole.num_rows, LANES):
            rows = whole.slice(i, LANES).to_pylist()
            yield from zip(rows, decode_blocks([r.pop("payload") for r in rows]))


def read_ids(files: DataFrame) -> DataFrame:
    """From a table of blocks, the pieces of documents: part, block, _rid, doc_id, ids. A document's pieces lie in
    neighbouring blocks of a part."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("_rid", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _blocks(batches):
            n = len(row["parts"])
            pieces = np.split(ids.astype(np.int32), np.cumsum(row["parts"])[:-1])
            columns = ([row["part"]] * n, [row["block"]] * n, row["row_ids"], row["doc_ids"], pieces)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return files.mapInArrow(run, "part int, block int, _rid long, doc_id long, ids array<int>")


def document_digests(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """From a table of blocks: _rid, doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents inside one block are finished where the block is decoded; the
    pieces of the others are put together by row number. An empty table gives
    an empty result.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("_rid", pa.int64()), ("doc_id", pa.int64()),
                        ("n", pa.int64()), ("crc", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _blocks(batches):
            n, ends = len(row["parts"]), np.cumsum(row["parts"])
            raw = [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]
            whole = [p == t for p, t in zip(row["parts"], row["totals"])]
            columns = ([row["part"]] * n, [row["block"]] * n, ends - row["parts"], row["row_ids"], row["doc_ids"], row["parts"],
                       [zlib.crc32(x) if w else None for x, w in zip(raw, whole)], [None if w else x for x, w in zip(raw, whole)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    pieces = checkpointed(files.mapInArrow(run, "part int, block int, offset long, _rid long, doc_id long, n long, crc long, piece binary"))
    place = F.col("block").cast("long") * block + F.col("offset")
    whole = pieces.where("piece is null").select("part", place.alias("_at"), "_rid", "doc_id", "n", "crc")
    parted = pieces.where("piece is not null").groupBy("part", "_rid", "doc_id").agg(
        F.min(place).alias("_at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("_pieces"))
    joined = F.aggregate("_pieces", F.lit(b""), lambda acc, x: F.concat(acc, x["piece"]))
    parted = parted.select("part", "_at", "_rid", "doc_id", "n", F.crc32(joined).alias("crc"))
    sizes = files.groupBy("part").agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the file
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    return whole.union(parted).join(starts, "part").select(
        "_rid", "doc_id", (F.col("_before") + F.col("_at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
