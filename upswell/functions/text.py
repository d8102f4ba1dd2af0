"""String expressions (JVM-side, codegen'd) with Python-like semantics.

Python's ``str.strip()`` and regex ``\\s`` treat every Unicode space as
whitespace while Spark's ``trim`` only removes the ASCII space, and Java's
``\\b`` / ``\\w`` differ from Python's. The classes below spell the Python
behaviour out explicitly so that Spark (Java regex) and an RE2-based oracle
evaluate exactly the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.isspace() accepts.
WHITESPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Characters of Python's Unicode \w (letters, numbers, underscore).
WORD_CHARS = r"\p{L}\p{N}_"
WORD_CLASS = "[" + WORD_CHARS + "]"
NON_WORD_CLASS = "[^" + WORD_CHARS + "]"

# A word boundary as zero-width lookarounds (Java regex).
_BOUNDARY = (
    "(?:(?<=" + WORD_CLASS + ")(?!" + WORD_CLASS + ")|(?<!" + WORD_CLASS + ")(?=" + WORD_CLASS + "))"
)


def py_regex_to_java(pattern: str) -> str:
    """Give a Python-style pattern the Python meaning of ``\\b``, ``\\s`` and ``\\w``.

    A ``\\b`` at either end of the pattern (next to a word character, as in
    every phrase list here) becomes a single cheap lookaround; any other
    ``\\b`` becomes the general two-sided boundary test.
    """
    lead, trail = pattern.startswith(r"\b"), pattern.endswith(r"\b") and len(pattern) > 2
    core = pattern[2:] if lead else pattern
    core = core[:-2] if trail else core
    core = (core.replace(r"\b", _BOUNDARY).replace(r"\s", WHITESPACE_CLASS)
            .replace(r"\w", WORD_CLASS))
    return (("(?<!" + WORD_CLASS + ")" if lead else "") + "(?:" + core + ")"
            + ("(?!" + WORD_CLASS + ")" if trail else ""))


def icontains(col: Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive regex search (``literal``: search for the text itself); NULL never matches."""
    if literal:
        regex = "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in pattern)
    else:
        regex = py_regex_to_java(pattern)
    return F.coalesce(col.rlike("(?iu)" + regex), F.lit(False))


def py_strip(col: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.

    (An O(1) edge test before the regex was tried: faster in isolation, slower
    inside the full plans, so the plain regex stays.)
    """
    ws = WHITESPACE_CLASS
    return F.regexp_replace(col, "^" + ws + "+|" + ws + "+$", "")


def collapse_ws(col: Column) -> Column:
    """``str.replace(r'\\s+', ' ')`` followed by ``strip()``."""
    return F.btrim(F.regexp_replace(col, WHITESPACE_CLASS + "+", " "), F.lit(" "))


def has_text(col: Column) -> Column:
    """``clean_text(col) != ''`` without rewriting the text: one search that
    stops at the first non-whitespace character."""
    return F.coalesce(col.cast("string").rlike("[^" + WHITESPACE_CLASS[1:-1] + "]"), F.lit(False))


def clean_text(col: Column) -> Column:
    """NULL -> '', whitespace runs -> one space, stripped."""
    return collapse_ws(F.coalesce(col.cast("string"), F.lit("")))


def safe_token(col: Column, max_len: int = 80, fallback: str = "issue") -> Column:
    """File-name token: non-alphanumerics -> '_', trimmed of '_', 80 chars."""
    t = F.btrim(F.regexp_replace(col.cast("string"), "[^\\p{L}\\p{N}]", "_"), F.lit("_"))
    t = F.left(t, F.lit(max_len))
    return F.when((t.isNull()) | (t == ""), F.lit(fallback)).otherwise(t)
