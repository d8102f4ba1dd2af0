"""Secret scans over a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams
that any match must hold: literals give conjunctions of their trigrams, choices
give disjunctions, and what isn't literal ends a run. A shard of documents is
indexed by the trigrams that some query names, the postings are intersected
and united as the query says, and only the documents left are searched with the
regular expression. A rule whose query is empty (it has no mandatory trigram) is
searched in every document.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from upswell.llm.common import text_bytes, with_row_id

MAX_STRINGS, MAX_CLASS = 64, 4


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are taken leftmost first without overlap, and those that fail ``valid`` are dropped."""

    kind: str
    pattern: str
    flags: int = 0
    valid: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE,
         lambda m: len(m[2]) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # a whole run: the same matches as runs of any length, short ones dropped
)

# Published formats of tokens and keys.
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@[A-Za-z0-9.-]+"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", re.IGNORECASE),
)

Query = tuple | bytes | None
"""A trigram, ("and" | "or", parts), or None for no condition."""


def _all_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    if not parts or None in parts:
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings_query(strings: frozenset[str] | None) -> Query:
    """What a text must hold if it holds one of the strings (lower-cased as A-Z)."""
    if strings is None:
        return None
    held = [s.encode().lower() for s in sorted(strings)]
    return _any_of([_all_of([b[i:i + 3] for i in range(len(b) - 2)]) for b in held])


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    """(all strings that the items can match, if they are few; the trigram query)."""
    run, exact, found = frozenset([""]), True, []
    for op, arg in items:
        strings, query = _item(op, arg)
        joined = frozenset(a + b for a in run for b in strings) if strings is not None else None
        if joined is not None and len(joined) <= MAX_STRINGS:
            run = joined
            continue
        exact = False
        found += [_strings_query(run), query]
        run = strings if strings is not None else frozenset([""])
    found.append(_strings_query(run))
    return (run, found[-1]) if exact else (None, _all_of(found))


def _item(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg)]), None
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return frozenset([""]), None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < MAX_CLASS:
                chars.update(map(chr, range(x[0], x[1] + 1)))
            else:
                return None, None
        return (frozenset(chars), None) if len(chars) <= MAX_CLASS + 1 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        strings = frozenset().union(*(s for s, _ in parts if s is not None))
        if all(s is not None for s, _ in parts) and len(strings) <= MAX_STRINGS:
            return strings, _strings_query(strings)
        return None, _any_of([q for _, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and (least, most) in ((0, 1), (1, 1)):
            return strings | {""} if least == 0 else strings, query if least else None
        return None, query if least else None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The query that holds for every text with a match of the regular expression."""
    return _sequence(sre_parser.parse(pattern, re.ASCII))[1]


def _trigrams(query: Query) -> set[bytes]:
    if query is None or isinstance(query, bytes):
        return {query} - {None}
    return set().union(*map(_trigrams, query[1]))


class TrigramIndex:
    """Postings of a shard of texts, for the wanted trigrams of the texts with A-Z lower-cased."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]) -> None:
        self.n = len(texts)
        codes = sorted(int.from_bytes(t, "big") for t in wanted)
        asked = np.zeros(1 << 24, bool)
        asked[codes] = True
        self.postings: dict[bytes, np.ndarray] = {c.to_bytes(3, "big"): [] for c in codes}
        for i, t in enumerate(texts):
            flat = np.frombuffer(t.lower(), np.uint8).astype(np.uint32)
            if len(flat) < 3:
                continue
            code = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
            for c in np.unique(code[asked[code]]).tolist():
                self.postings[c.to_bytes(3, "big")].append(i)
        self.postings = {t: np.array(p, np.int64) for t, p in self.postings.items()}

    def candidates(self, query: Query) -> np.ndarray:
        """Positions of the texts that fulfil the query."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted(map(self.candidates, query[1]), key=len)
        out = lists[0]
        for p in lists[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
_FOUND = "_rid long, doc_id long, spans array<struct<start: long, rank: int, kind: string, end: long>>"
_FOUND_ARROW = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: _rid, doc_id, spans, sorted by start, then by the rules' order (``rank``).

    Offsets are code points, the end exclusive. A null or empty text has no
    span; texts are searched whole. Other columns are not looked at; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(rank, r, r.compiled(), trigram_query(r.pattern)) for rank, r in enumerate(rules)]
        wanted = set().union(*(_trigrams(q) for *_, q in ready)) if ready else set()
        for b in batches:
            raw = b.column(2).to_pylist()
            index = TrigramIndex(raw, wanted)
            spans: list[list[dict]] = [[] for _ in raw]
            texts: dict[int, str] = {}
            for rank, rule, compiled, query in ready:
                for i in index.candidates(query).tolist():
                    if i not in texts:
                        texts[i] = raw[i].decode()
                    spans[i] += [{"start": m.start(), "rank": rank, "kind": rule.kind, "end": m.end()}
                                 for m in compiled.finditer(texts[i]) if rule.valid is None or rule.valid(m)]
            for s in spans:
                s.sort(key=lambda x: (x["start"], x["rank"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _FOUND_ARROW.field("spans").type)], schema=_FOUND_ARROW)

    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "text": text_bytes(docs, text_col)})
    return rows.mapInArrow(run, _FOUND)
