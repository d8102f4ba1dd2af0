"""Fill-in-middle: texts are cut at two places and written with the middle last.

Cuts are chosen in units (lines or code points), spans are reported in code
points, and texts are kept as UTF-8. A sparse index records only the characters
of several bytes, each with its position and its excess bytes; a binary search
in it turns a cut in code points into one in bytes and back, and where there is
no such character the two are the same number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import text_bytes, with_row_id

MARKERS = ("<P>", "<S>", "<M>")
SLICE_BYTES = 4_000_000
"""Neighbouring texts are indexed together up to this size; a longer text is indexed by itself."""


class ExceptionIndex:
    """The characters of more than one byte in UTF-8 data, and how cuts move past them."""

    def __init__(self, data: np.ndarray) -> None:
        self.byte_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte_at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])  # of the first i exceptions together
        self.char_at = self.byte_at - self.excess[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each cut, which is given in bytes."""
        return cuts - self.excess[np.searchsorted(self.byte_at, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each cut, which is given in code points."""
        return cuts + self.excess[np.searchsorted(self.char_at, cuts)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the id alone."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[i:i + 8], 16) for i in range(0, 32, 8)]


def cut_texts(ids: list[int | None], texts: list[bytes], unit: str, seed: int) -> tuple[np.ndarray, ...]:
    """For each text: number of units, both cuts in bytes, both cuts in code points."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    starts, ends = ends[:-1], ends[1:]
    index = ExceptionIndex(data)
    first = index.chars(starts)
    if unit == "line":
        breaks = np.flatnonzero(data == 10) + 1
        before, through = np.searchsorted(breaks, starts, "right"), np.searchsorted(breaks, ends, "right")
        whole = through - before  # lines that end in a line break
        closed = np.zeros(len(texts), bool)
        closed[ends > starts] = data[ends[ends > starts] - 1] == 10
        n = whole + ((ends > starts) & ~closed)
    else:
        n = index.chars(ends) - first
    drawn = np.array([draws(i, seed)[:2] for i in ids], np.int64).reshape(-1, 2) % (n + 1)[:, None]
    cuts = np.sort(drawn, axis=1).T
    if unit == "line":
        padded = np.append(breaks, 0)
        at = [np.where(k == 0, starts, np.where(k <= whole, padded[np.minimum(before + k - 1, len(breaks))], ends)) for k in cuts]
    else:
        at = [index.bytes(first + k) for k in cuts]
    return n, at[0] - starts, at[1] - starts, index.chars(at[0]) - first, index.chars(at[1]) - first


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > SLICE_BYTES:
            yield low, i
            low, size = i, 0
        size += len(t)
    if texts:
        yield low, len(texts)


_SCHEMA = "_rid long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100,
                   spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row per document: _rid, doc_id, n (units), form, prefix_chars and middle_chars (code points), output (the text as trained on).

    ``unit`` is "line" (a line holds its line break) or "char". The cuts, whether
    a document is transformed (``rate`` percent are) and whether as spm
    (``spm_rate`` percent) or psm depend on the seed and doc_id alone, so
    repeated rows give repeated results; a null id counts as an empty one. Form
    plain, with the text as output and null spans: documents left out by
    ``rate``, empty or null texts (n is 0), and texts that hold a marker, which
    couldn't be taken apart again. Texts are valid UTF-8 of any length and stay
    whole. Other columns are not looked at; an empty table gives an empty result.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unit must be line or char, not {unit!r}")
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in markers)
    names = tuple(m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids, ids, texts = (b.column(i).to_pylist() for i in range(3))
            for low, high in _slices(texts):
                rows = []
                part = zip(rids[low:high], ids[low:high], texts[low:high], *[x.tolist() for x in cut_texts(ids[low:high], texts[low:high], unit, seed)])
                for rid, i, text, n, a, z, prefix, through in part:
                    _, _, h3, h4 = draws(i, seed)
                    if not text or h3 % 100 >= rate or any(m in text for m in names):
                        rows.append((rid, i, n, "plain", None, None, text))
                    elif h4 % 100 < spm_rate:
                        rows.append((rid, i, n, "spm", prefix, through - prefix,
                                     b"".join((suffix_mark, text[z:], prefix_mark, text[:a], middle_mark, text[a:z]))))
                    else:
                        rows.append((rid, i, n, "psm", prefix, through - prefix,
                                     b"".join((prefix_mark, text[:a], suffix_mark, text[z:], middle_mark, text[a:z]))))
                columns = [pa.array(c, pa.binary() if f.name == "output" else f.type) for c, f in zip(zip(*rows), _ARROW)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], schema=_ARROW)

    return with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)}).mapInArrow(run, _SCHEMA)


def restore(outputs: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``outputs`` with a column ``restored``: the text, from form and output alone."""
    part = F.split("output", "|".join(rf"\Q{m}\E" for m in markers))
    second, third, fourth = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return outputs.withColumn("restored", F.when(F.col("form") == "psm", F.concat(second, fourth, third))
                              .when(F.col("form") == "spm", F.concat(third, fourth, second)).otherwise(F.col("output")))
