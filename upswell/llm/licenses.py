"""Licence scans by sentence rules.

Texts are cut into sentences, sentences are normalised (case, white space,
comment marks, spelling), each known licence sentence is replaced by the
identifiers of all that it names, in their order, and the sequence of a
document's identifiers is matched against ordered rules. A rule takes the identifiers it matches out of the sequence, so
the sentences of a full licence text aren't reported again by the rules for single
sentences that come after it.

Only column functions: a document is cut into sentences if it holds a word of one
of the anchors, and a sentence is looked at if it holds one of the anchors; every
known sentence does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import with_row_id

ANCHORS = ("licens", "licenc", "copyright", "warrant", "permission", "redistribut", "public domain", "rights reserved", "altered",
           "general public", "cc by", "cc-by", "cc attribution", "cc-attribution", "cc0", "creative commons", "endorse or promote", "gpl")
_WHOLE = ("licens", "licenc", "copyright", "warrant", "permission", "redistribut", "domain", "reserved", "altered", "cc0", "commons", "endorse", "gpl")
"""A word of each anchor, as an anchor of several words may be spread over lines and comment marks; by and attribution count after cc only."""

_UNDER = (r"(?:\b(?:licensed|distributed|released|available) under (?:either )?(?:the )?(?:terms of (?:either )?(?:the )?)?"
          r"|\b(?:or|and|either) (?:the )?(?:terms of the )?|^)")
"""What comes before a licence's bare name: a grant, the other licence of a choice, or the sentence's start."""


def _to(words: str) -> str:
    """Text up to the words, not past another licence's name; possessive, so that a long sentence takes no stack."""
    return rf"(?:(?!public license|{words}).)*+{words}"


_SPDX = r"[a-z0-9.+:-]*[a-z0-9+]"
"""One name of an SPDX expression, without the full stop of its sentence."""

# Sentences of the published licences and notices, normalised, as regular expressions,
# and the identifier of each; $1 and so on stand for what the parts in parentheses matched.
SENTENCES = (
    (rf"spdx-license-identifier: ?\(({_SPDX}(?: (?:and|or|with) {_SPDX})*+)\)(?! (?:and|or|with) )", "spdx:$1"),
    (rf"spdx-license-identifier: ?(\(*{_SPDX}\)*(?: (?:and|or|with) \(*{_SPDX}\)*)*+)", "spdx:$1"),
    (rf"(?:gnu )?affero general public license(?:,? v?(?=3)|{_to('version (?=3)')})(3)(?:\.0)?{_to('any later')}", "agpl-$1-or-later"),
    (r"(?:gnu )?affero general public license,? (?:as published by the free software foundation[,;:] (?:either )?)?(?:v|version )?(3)", "agpl-$1-only"),
    (rf"gnu (?:lesser|library) general public license{_to('version (?=[23])')}(2\.1|2|3)(?:\.0)?{_to('any later version')}", "lgpl-$1-or-later"),
    (r"gnu (?:lesser|library) general public license,? (?:as published by the free software foundation[,;] )?(?:v|version )(2\.1|2|3)", "lgpl-$1-only"),
    (rf"gnu general public license{_to('version (?=[23])')}(2|3)(?:\.0)?{_to('any later version')}", "gpl-$1-or-later"),
    (r"gnu general public license,? (?:as published by the free software foundation[,;] )?(?:v|version )(2|3)", "gpl-$1-only"),
    (rf"{_UNDER}(gpl|lgpl|agpl)[ -]?v?(2\.1|2|3)", "$1-$2-only"),
    (r"licensed under the apache license,? (?:v|version )?(2\.0|2|1\.1)", "apache-$1"),
    (r"\bapache(?: software)? license,? (?:v|version )?(2\.0|2|1\.1)", "apache-$1"),
    (r"permission is hereby granted, free of charge, to any person obtaining a copy", "mit-grant"),
    (r"the above copyright notice and this permission notice shall be included in all copies", "mit-notice"),
    (r"the software is provided \W?as is\W?, without warranty of any kind, express or implied", "mit-warranty"),
    (rf"{_UNDER}(?:mit|expat)(?:/x11)? license", "mit-name"),
    (r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "isc-grant"),
    (rf"{_UNDER}isc license", "isc-name"),
    (r"redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-grant"),
    (r"redistributions of source code must retain the above copyright notice", "bsd-source"),
    (r"redistributions in binary form must reproduce the above copyright notice", "bsd-binary"),
    (r"neither the name of .* may be used to endorse or promote products", "bsd-endorse"),
    (r"this software is provided by .*as is.* warranties", "bsd-warranty"),
    (rf"{_UNDER}(?:new |modified |simplified )?bsd(?:[ -](2|3)[ -]clause)? license", "bsd-name$1"),
    (r"subject to the terms of the mozilla public license,? (?:v|version )\.? ?(2\.0|1\.1)", "mpl-$1"),
    (r"\bmozilla public license,? (?:v|version )?(2\.0|1\.1)", "mpl-$1"),
    (r"\beclipse public license,? (?:-? ?v|version )? ?(2\.0|1\.0)", "epl-$1"),
    (r"this software is provided \W?as-is\W?, without any express or implied warranty", "zlib-warranty"),
    (r"permission is granted to anyone to use this software for any purpose", "zlib-grant"),
    (r"altered source versions must be plainly marked", "zlib-marked"),
    (r"\bunder (?:a |the )?(?:terms of (?:a |the )?)?(?:creative commons |cc[ -])(?:attribution|by)((?:[ -](?:noncommercial|non-commercial|nc|sharealike|share-alike|sa|noderivatives|noderivs|nd))*+)"
     r"[ -]?(?:international )?(?:license )?(\d\.\d)?", "cc-by$1 $2"),
    (r"\bcc0(?: 1\.0)?(?: universal)?", "cc0-1.0"),
    (r"this is free and unencumbered software released into the public domain", "unlicense"),
    (r"\b(?:dedicated to|placed in|released into|in) the public domain", "public-domain"),
    (r"\ball rights reserved", "all-rights-reserved"),
    (r"\bcopyright (?:\(c\)|©|\d{4})", "copyright"),
)
# Ordered rules over the identifiers, each in angle brackets, and the licence each rule stands for.
RULES = (
    (r"<mit-grant>(?:<copyright>)?(?:<mit-notice>)?<mit-warranty>", "MIT"),
    (r"<mit-grant><mit-notice>", "MIT"),
    (r"<isc-grant>", "ISC"),
    (r"<bsd-grant><bsd-source><bsd-binary><bsd-endorse>(?:<bsd-warranty>)?", "BSD-3-Clause"),
    (r"<bsd-grant><bsd-source><bsd-binary>(?:<bsd-warranty>)?", "BSD-2-Clause"),
    (r"<zlib-warranty><zlib-grant>(?:<zlib-marked>)?", "Zlib"),
    (r"<mit-name>", "MIT"),
    (r"<isc-name>", "ISC"),
    (r"<bsd-name([23])>", "BSD-$1-Clause"),
    (r"<bsd-name>", "BSD"),
    (r"<spdx:([^>]+)>", "$1"),
    (r"<apache-2(?:\.0)?>", "Apache-2.0"),
    (r"<apache-1\.1>", "Apache-1.1"),
    (r"<(agpl|lgpl|gpl)-(\d)-(only|or-later)>", "$1-$2.0-$3"),
    (r"<lgpl-2\.1-(only|or-later)>", "lgpl-2.1-$1"),
    (r"<(mpl|epl)-([^>]+)>", "$1-$2"),
    (r"<(cc-by[^>]*)>", "$1"),
    (r"<cc0-1\.0>", "CC0-1.0"),
    (r"<unlicense>", "Unlicense"),
    (r"<public-domain>", "public-domain"),
    (r"<all-rights-reserved>", "all-rights-reserved"),
)
_SHORT = (("noncommercial", "nc"), ("non-commercial", "nc"), ("sharealike", "sa"), ("share-alike", "sa"), ("noderivatives", "nd"),
          ("noderivs", "nd"))


def normalised_sentences(text: Column) -> Column:
    """Array of the text's sentences: lower case, one blank between words, no comment marks, American spelling.

    A sentence ends at . ! or ? before white space (so does the number of a
    list, as in 1.), at an empty line, at : before a line break, and before a line that
    begins with a bullet or a number in brackets. Lines that begin with * are
    items if a line of text or an empty line comes before them, else comments.
    """
    t = F.regexp_replace(F.lower(text), r"(?m)(^[ \t]*(?:[^\s*/#;%-](?!.*/\*).*)?\r?\n|\G(?!\A))[ \t]*\*[ \t]+(.*\r?\n?)", "$1\u0001$2")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|rem |dnl )[ \t]*", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:[*+•·‣▪◦–-]|\(?(?:[0-9]{1,2}|[abd-z]|i{1,3}|iv|vi{0,3})\))[ \t]+(?!v(?:ersion)?[ .]?[0-9])", "\u0001")
    t = F.regexp_replace(t, r"\n[ \t\r]*\n\s*|(?<=(?<!identifier):)[ \t\r]*\n", "\u0001")
    t = F.regexp_replace(F.regexp_replace(t, r"licenc", "licens"), r"[ \t\r\n\f]+", " ")
    return F.filter(F.transform(F.split(t, "(?<=[.!?]) |\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_ids(sentence: Column) -> Column:
    """Identifiers of all that a sentence names, from left to right without overlap; at one place the first fitting row of the table counts."""
    return F.transform(F.regexp_extract_all(sentence, F.lit("|".join(f"(?:{p})" for p, _ in SENTENCES)), F.lit(0)), _identifier)


def _identifier(match: Column) -> Column:
    """Identifier of a match of the table."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SENTENCES):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.regexp_replace(match, f"^(?:{pattern})$", name)).otherwise(out)
    for long, short in _SHORT:
        out = F.replace(out, F.lit(long), F.lit(short))
    return F.regexp_replace(F.trim(out), " +", "-")


def match_rules(ids: Column) -> Column:
    """Licences of a sequence of identifiers, in the rules' order, each as often as its rule matches.

    A match takes its identifiers out of the sequence and leaves a gap, so that
    no later rule matches across it.
    """
    line = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in RULES])
    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hits = F.regexp_extract_all(acc["line"], rule["p"], F.lit(0))
        names = F.transform(hits, lambda h: F.regexp_replace(h, rule["p"], rule["n"]))
        return F.struct(F.regexp_replace(acc["line"], rule["p"], F.lit("-")).alias("line"), F.concat(acc["found"], names).alias("found"))

    return F.aggregate(rules, start, step, lambda acc: F.transform(acc["found"], _cased))


def _cased(name: Column) -> Column:
    """Licence names as their lists write them: family in capitals, a few words and names in their own way."""
    out = F.upper(name)
    for own in ("-only", "-or-later", "-Clause", "Apache-", "Zlib", "Unlicense", "public-domain", "all-rights-reserved", "-AND-", "-OR-", "-WITH-"):
        out = F.replace(out, F.lit(own.upper()), F.lit(own))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _rid, doc_id, sentence_ids, licenses, n_unknown.

    sentence_ids are the identifiers in the order of the text; licenses the
    distinct licences that the rules find, in the rules' order; n_unknown counts
    sentences with an anchor word that no known sentence fits. A null or empty
    text has none of them. Texts are read whole; other columns aren't looked at;
    an empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "_text": text})

    def holds(c: Column, words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        return hit

    low = F.lower("_text")
    some = rows.withColumn("_sentences", F.when(holds(low, _WHOLE) | low.rlike(r"\bcc\W+(?:by|attribution)"), F.filter(
        normalised_sentences(F.col("_text")), lambda s: holds(s, ANCHORS))))
    known = some.select("_rid", "doc_id", F.transform("_sentences", sentence_ids).alias("_ids"))
    known = known.select("_rid", "doc_id", F.flatten("_ids").alias("_known"), F.filter("_ids", lambda i: F.size(i) == 0).alias("_unknown"))
    none = F.array().cast("array<string>")
    return known.select(
        "_rid", "doc_id", F.coalesce("_known", none).alias("sentence_ids"),
        F.coalesce(F.when(F.size("_known") > 0, F.array_distinct(match_rules(F.col("_known")))), none).alias("licenses"),
        F.coalesce(F.size("_unknown"), F.lit(0)).cast("long").alias("n_unknown"))
