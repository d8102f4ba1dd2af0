"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic regressions over
words; the models of later categories also get the probabilities of the earlier
ones. While learning, those probabilities are out of fold: a document's inputs
come from models that haven't seen it, as they will for new documents.

Labelled are the documents of the ``labels`` table. The first category is its
mark of low quality, the last its mark of toxicity. Between them stand two kinds of
toxic texts, which the toxic training rows part into by themselves: the two sides of the
direction in which the words that set them off from clean rows vary most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, text_bytes, with_row_id

CATEGORIES = ("low_quality", "kind_1", "kind_2", "toxic")
MAX_TRAINING_ROWS = 20_000
"""At most so many labelled documents are learned from, chosen by a hash of the id, toxic and clean in their own proportion."""
VOCABULARY, QUALITY_VOCABULARY, MIN_DOCUMENTS, FOLDS = 256, 64, 5, 5
STEMS = (5, 6, 7, 8)

_LETTER_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))
_BLANK_BYTES = bytes(range(33)) + b"\x7f"
_PLAIN_BYTES = bytes(b for b in range(256) if b >= 0x7F or b <= 0x20 or chr(b).isalnum())


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased words, runs of letters and of what isn't ASCII, and ``#`` with the share of signs in twentieths, 9 at most."""
    raw = text.lower().encode()
    words = set(raw.translate(_LETTER_BYTES).split())
    if solid := len(raw.translate(None, _BLANK_BYTES)):
        words.add(b"#%d" % min(9, 20 * len(raw.translate(None, _PLAIN_BYTES)) // solid))
    return words


def features_of(words: set[bytes]) -> set[bytes]:
    """The words and, with a star, their first bytes, so that a stem counts whatever its ending."""
    return words.union(*({w[:k] + b"*" for w in words if len(w) >= k} for k in STEMS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the bias) of an L2 logistic regression, by Newton steps; constant labels give a constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else 6.0 if y[0] else -6.0
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Chain:
    """Words with numbers, one weight vector a category (words, earlier categories, bias), and the threshold of the last."""

    def __init__(self, words: list[bytes], names: list[str]) -> None:
        self.words, self.names = {w: i for i, w in enumerate(words)}, names
        self.stems = {k: {w[:k] for w in words if len(w) == k + 1 and w.endswith(b"*")} for k in STEMS}
        self.weights: list[np.ndarray] = []
        self.threshold = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Learn all categories (columns of y); the out-of-fold probabilities come back."""
        inner = np.zeros((len(x), 0))
        for j in range(y.shape[1]):
            z = np.hstack([x, inner])
            own = np.zeros(len(x))
            for k in np.unique(fold):
                own[fold == k] = self._apply(fit_logistic(z[fold != k], y[fold != k, j]), z[fold == k])
            self.weights.append(fit_logistic(z, y[:, j]))
            inner = np.hstack([inner, own[:, None]])
        self.threshold = best_threshold(inner[:, -1], y[:, -1]) if len(x) else 0.5
        return inner

    @staticmethod
    def _apply(w: np.ndarray, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z @ w[:-1] + w[-1])

    def numbers_of(self, words: set[bytes]) -> list[int]:
        """Numbers of the chain's features that a text with these words has."""
        found = words & self.words.keys()
        for k, stems in self.stems.items():
            if stems:
                found |= {s + b"*" for s in {w[:k] for w in words} & stems}
        return sorted(self.words[f] for f in found)

    def predict(self, held: list[int]) -> list[float]:
        """The categories' probabilities for a text with the words of these numbers."""
        out: list[float] = []
        n = len(self.words)
        for w in self.weights:
            z = w[held].sum() + w[-1] + sum(p * w[n + i] for i, p in enumerate(out))
            out.append(float(_sigmoid(z)))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the labels with the best F1, midway to the next lower one; 0.5 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    q, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(q) + 1) + y.sum())
    f1[:-1][q[:-1] == q[1:]] = -1
    i = int(np.argmax(f1))
    return float(min(0.9, (q[i] + (q[i + 1] if i + 1 < len(q) else 0)) / 2))


def kinds_of(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Two columns of 0 and 1: a toxic row's side of the toxic rows' main direction; features count by how much more toxic rows have them."""
    out = np.zeros((len(x), 2))
    if toxic.any() and not toxic.all():
        rows = x[toxic]
        z = (rows - rows.mean(0)) * np.maximum(0, rows.mean(0) - x[~toxic].mean(0))
        main = np.linalg.eigh(z.T @ z)[1][:, -1] if z.shape[1] else np.zeros(0)
        side = z @ (main * (1 if not len(main) or main[np.abs(main).argmax()] > 0 else -1)) > 0
        out[toxic, 0], out[toxic, 1] = side, ~side
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, fold, toxic, low, text) of the labelled documents to learn from.

    A document labelled twice is toxic, or of low quality (0), if one label says so; without a quality it isn't low.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"), F.coalesce(F.min("quality") <= 0, F.lit(False)).alias("low"))
    part = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(part), "doc_id")  # at most max_rows ids
    return joined.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"),
                         (F.col("toxic") > 0).alias("toxic"), "low", "text")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Chain:
    """Learn the chain. The driver gets the chosen words and, for at most ``max_rows`` rows, the numbers of those they hold."""
    rows = training_rows(docs, labels, max_rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, low, texts = (b.column(i).to_pylist() for i in range(3))
            total: dict[bytes, list[int]] = {b"": [0, 0, 0]}  # rows, toxic ones, ones of low quality
            for y, q, t in zip(toxic, low, texts):
                for w in features_of(words_of(t)) | {b""}:
                    n = total.setdefault(w, [0, 0, 0])
                    n[0] += 1
                    n[1] += y
                    n[2] += q
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), *(pa.array([n[i] for n in total.values()], pa.int64()) for i in range(3))],
                                             names=["w", "n", "toxic", "low"])

    sums = checkpointed(rows.select("toxic", "low", "text").mapInArrow(counted, "w binary, n long, toxic long, low long").groupBy("w").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("low").alias("low")).where((F.col("n") >= MIN_DOCUMENTS) | (F.col("w") == b"")))
    whole = sums.where(F.col("w") == b"").first() or {"n": 0, "toxic": 0, "low": 0}

    def foremost(mark: str, limit: int) -> list[bytes]:
        """The features whose shares with and without the mark differ most for their number."""
        have, rest = whole[mark], whole["n"] - whole[mark]
        lift = F.abs(F.col(mark) / max(1, have) - (F.col("n") - F.col(mark)) / max(1, rest)) * F.sqrt(F.lit(float(whole["n"])) / F.col("n"))
        return [bytes(r["w"]) for r in sums.where(F.col("w") != b"").orderBy(lift.desc(), "w").limit(limit).select("w").collect()]

    chain = Chain(list(dict.fromkeys(foremost("toxic", VOCABULARY) + foremost("low", QUALITY_VOCABULARY))), list(CATEGORIES))
    number = chain.words

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fold, toxic, low, texts = (b.column(i).to_pylist() for i in range(5))
            marks = [[int(q), int(y)] for q, y in zip(low, toxic)]
            known = [sorted(number[w] for w in features_of(words_of(t)) & number.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fold, pa.int32()), pa.array(marks, pa.list_(pa.int32())),
                                              pa.array(known, pa.list_(pa.int32()))], names=["doc_id", "fold", "marks", "known"])

    learned = sorted(rows.mapInArrow(held, "doc_id long, fold int, marks array<int>, known array<int>").collect(),
                     key=lambda r: (r["doc_id"], r["known"], r["marks"]))
    x = np.zeros((len(learned), len(number)))
    for i, r in enumerate(learned):
        x[i, r["known"]] = 1
    marks = np.array([r["marks"] for r in learned], float).reshape(len(learned), 2)
    y = np.hstack([marks[:, :1], kinds_of(x, marks[:, 1] > 0), marks[:, 1:]])
    chain.fit(x, y, np.array([r["fold"] for r in learned]))
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _rid, doc_id, p_<category> in the chain's order, toxic.

    A null or empty text holds no word and gets the chain's constants. Whole
    texts of any length; without labels nothing is toxic; other columns aren't
    looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]
    schema = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.float64()) for n in names], ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            found = [c.predict(c.numbers_of(words_of(t.decode()))) for t in b.column(2).to_pylist()]
            arrays = [b.column(0), b.column(1), *(pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))),
                      pa.array([bool(c.words) and f[-1] >= c.threshold for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)})
    return rows.mapInArrow(run, "_rid long, doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")
