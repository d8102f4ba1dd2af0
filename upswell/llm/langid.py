"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; a binary classifier for each bit says
from hashed byte n-grams whether a text's language has the bit. The classifiers
are linear: the weight of an n-gram is the log ratio of its frequency among the
languages with the bit and among those without, from counts over every labelled
training text. Decoding compares each codeword with the bits' margins and
picks the one of least weighted logistic loss; a bit weighs as much as its
classifier is right on the training texts. A text is ambiguous when the best two
codewords are nearly as good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import filter_texts, text_bytes, with_row_id

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
SHARPNESS = 12.0
AMBIGUOUS = 0.02
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int) -> np.ndarray:
    """A matrix of 0 and 1, one row a language: all two-sided splits up to 7 languages, a random code beyond."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = range(1, 1 << (n - 1))
        return np.array([[(s >> (n - 2 - i)) & 1 if i < n - 1 else 0 for s in splits] for i in range(n)], np.int8)
    rng, bits = np.random.default_rng(7), max(31, 6 * int(np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits)).astype(np.int8)
        code = code[:, (code.sum(0) > 0) & (code.sum(0) < n)]
        signs = 2 * code.astype(np.float32) - 1  # whole numbers far below 2^24: exact
        apart = int((code.shape[1] - (signs @ signs.T)[~np.eye(n, dtype=bool)].max()) // 2)
        if apart > far:
            best, far = code, apart
    return best


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed byte n-grams of the lower-cased letters; all else is one blank."""
    flat = np.frombuffer(text.lower(), np.uint8)
    letter = (flat >= 0x80) | ((flat >= 0x61) & (flat <= 0x7A))
    flat = np.where(letter, flat, 32)
    flat = flat[letter | np.concatenate([[True], letter[:-1]])] if len(flat) else flat
    out = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(flat) + 1, np.uint32)[: len(flat)]
    for n in range(1, max(ORDERS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + flat[n - 1:].astype(np.uint32) + np.uint32(1)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out += np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    return out


class Model:
    """Learned languages, their codewords, a weight for each n-gram and bit, and the bits' weights."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True) if len(langs) else counts
        self.weights = np.stack([
            np.log(share[c == 1].mean(0)) - np.log(share[c == 0].mean(0)) if 0 < c.sum() < len(c) else np.zeros(BUCKETS)
            for c in self.code.T], axis=1).astype(np.float32) if len(langs) else np.zeros((BUCKETS, 1), np.float32)
        self.trust = np.ones(self.code.shape[1] if len(langs) else 1)

    def margins(self, text: bytes) -> np.ndarray:
        """Mean log ratio of the text's n-grams, for each bit."""
        counts = ngram_counts(text)
        at = np.flatnonzero(counts)
        return counts[at] @ self.weights[at] / max(1, counts[at].sum())

    def losses(self, margins: np.ndarray) -> np.ndarray:
        signs = 2.0 * self.code - 1
        return (np.logaddexp(0, -SHARPNESS * signs * margins) * self.trust).sum(1) / self.trust.sum()

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous). No letter or nothing learned: ("und", 0, True)."""
        if not self.langs or not _LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = self.losses(self.margins(text))
        order = np.argsort(loss, kind="stable")
        odds = np.exp(-(loss - loss[order[0]]))
        return self.langs[order[0]], float(odds[order[0]] / odds.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def _held_out(doc_id, folds: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> Model:
    """Learn from every row with a language whose crc32(id) mod ``folds`` isn't 0.

    The driver gets a count for each language and n-gram bucket, and a count
    of right margins for each language and bit: both bounded by the languages.
    """
    labelled = docs.select(docs[lang_col].alias("lang"), text_bytes(docs, text_col).alias("text"), docs[id_col].cast("string").alias("id"))
    labelled = labelled.where(F.col("lang").isNotNull() & ((F.col("id").isNull()) | (F.crc32(F.col("id").cast("binary")) % folds != 0)))
    labelled = labelled.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += ngram_counts(text)
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    sums = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy()
    model = Model(langs, counts)
    if len(langs) > 1:
        model.trust = _bit_trust(labelled, model)
    return model


def _bit_trust(labelled: DataFrame, model: Model) -> np.ndarray:
    """Weight of each bit: the log odds that its margin has the right sign, languages counting alike."""
    sc, number = labelled.sparkSession.sparkContext, {x: i for i, x in enumerate(model.langs)}
    shared = sc.broadcast(model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((len(m.langs), m.code.shape[1] + 1), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = number[lang]
                total[i, :-1] += (m.margins(text) > 0) == (m.code[i] == 1)
                total[i, -1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(total))), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))],
                                         names=["i", "n"])

    bits = model.code.shape[1] + 1
    rows = labelled.mapInArrow(right, "i int, n array<long>").groupBy("i").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(bits)])
    total = np.zeros((len(model.langs), bits))
    for r in rows.collect():  # one row a language
        total[r["i"]] = [r[f"n{k}"] for k in range(bits)]
    shared.unpersist()
    rate = ((total[:, :-1] + 1) / (total[:, -1:] + 2)).mean(0)
    return np.maximum(0.05, np.log(rate / (1 - rate)))


_RESULT = "_rid long, doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
_RESULT_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                           ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: _rid, doc_id, held_out, lang_pred, score, ambiguous.

    Only the text is an input of the prediction. A null text, a text without a
    letter, or a model without languages gives ``und`` with score 0; a null id
    is not held out. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rid, ids, texts = (b.column(i).to_pylist() for i in range(3))
            found = [m.predict(t) for t in texts]
            arrays = [rid, ids, [_held_out(i, folds) for i in ids], *([f[k] for f in found] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, _RESULT_ARROW)], schema=_RESULT_ARROW)

    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)})
    return rows.mapInArrow(run, _RESULT)


def drop_undetermined(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose language can't be told (``und``), columns as they were.

    A model that learned no language (no labelled document outside the held-out
    ids) tells nothing of a text; then only documents without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        m = shared.value
        if not m.langs:
            return lambda text: _LETTER.search(text.decode("utf-8", "replace")) is not None
        return lambda text: m.predict(text)[0] != "und"

    return filter_texts(docs, keep, text_col)
