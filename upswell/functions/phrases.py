"""Narrative phrase signals and the systemic score (N1) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upswell.functions.text import WHITESPACE_CLASS, py_regex_to_java

# Phrases suggesting a systemic (process / systems) failure.
SYSTEMIC_PHRASES = (
    r"\b(multiple|many|several|repeated|again|recurring)\b",
    r"\b(same\s+problem|same\s+issue|same\s+error)\b",
    r"\b(their\s+system|bank\s+error|company\s+error|system\s+error)\b",
    r"\b(incorrectly|wrong\s+amount|wrong\s+balance|wrong\s+information)\b",
    r"\b(not\s+just\s+me|other\s+customers|many\s+people)\b",
    r"\b(process\s+failure|failed\s+to|never\s+fixed)\b",
    r"\b(automated|automatically\s+charged|without\s+notification)\b",
    r"\b(repossessed|repossession)\s+(without|with\s+no)\b",
    r"\b(investigation|investigated)\s+(and\s+)?(wrong|incorrect|nothing)\b",
)

# Phrases suggesting an individual grievance or preference.
INDIVIDUAL_PHRASES = (
    r"\b(interest\s+too\s+high|rate\s+too\s+high|apr\s+too\s+high)\b",
    r"\b(i\s+think|i\s+feel|i\s+believe)\s+",
    r"\b(my\s+rate|my\s+card|my\s+account)\s+(is|was)\s+",
    r"\b(unfair\s+rate|unfair\s+fee)\b",
    r"\b(just\s+want|only\s+asking)\b",
)

# Score for a clipped hit difference, i.e. round(((clip(d/3,-1,1))+1)/2, 3)
# spelled out per integer d so that no floating rounding is involved.
_SCORE_BY_DIFF = {-3: 0.0, -2: 0.167, -1: 0.333, 0: 0.5, 1: 0.667, 2: 0.833, 3: 1.0}


def needs_stripped_text(phrases) -> bool:
    r"""Only a phrase that can *start* with whitespace depends on stripping the
    text before the search; every phrase list here starts with a word."""
    return any(p.startswith(r"\s") for p in phrases)


def phrase_regex(p: str) -> str:
    r"""Java form of a phrase searched in ``text.strip()``, applied to the raw text.

    Stripping can only remove a match whose trailing ``\s+`` ends at the end
    of the text; the lookahead rejects exactly those. Case-insensitive.
    """
    java = py_regex_to_java(p)
    if p.endswith(r"\s+") or p.endswith(r"\s*"):
        java += "(?!" + WHITESPACE_CLASS + r"*\z)"
    return "(?iu)" + java


def hit_count(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """Number of phrases found at least once (each phrase counts once)."""
    if not phrases:
        return F.lit(0)
    hits = [F.when(F.coalesce(text.rlike(phrase_regex(p)), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
            for p in phrases]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def score_from_diff(diff: Column) -> Column:
    d = F.greatest(F.least(diff, F.lit(3)), F.lit(-3))
    expr = None
    for k, v in sorted(_SCORE_BY_DIFF.items()):
        expr = F.when(d == F.lit(k), F.lit(v)) if expr is None else expr.when(d == F.lit(k), F.lit(v))
    return expr


def narrative_signals(text: Column, systemic=SYSTEMIC_PHRASES, individual=INDIVIDUAL_PHRASES
                      ) -> tuple[Column, Column]:
    """(systemic_hits, individual_hits) for one text column, with the phrases
    searched as in the stripped text (see ``phrase_regex``). Project these
    before deriving the score: the score's CASE branches would otherwise each
    re-run every search."""
    return hit_count(text, systemic).cast("long"), hit_count(text, individual).cast("long")
