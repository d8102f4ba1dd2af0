"""Personal data by gradient-boosted candidates.

The base kinds (mail and IP addresses, card and phone numbers) are found by
pattern and check; they are always reported. Beside them high-recall generators
propose loose spans that may overlap each other and the base spans. Each
generator has evidence of its own for and against a proposal (check digits of an
IBAN, a domain that exists, national grouping of a phone number after a word for
it, dates), which isn't a feature. A proposal proven by it is sure. Of those
without evidence, boosted trees score format and context, and a threshold
calibrated on held-out proposals picks those sure enough. Of all these the ones
that touch no base span and no surer proposal are added. The trees learn from
the corpus: a proposal that nearly covers a base span or is proven is an example,
one that only touches a base span or is refuted a counterexample; those without
evidence are what they are then asked about.

Only column functions and Spark ML's boosted trees are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import checkpointed, with_row_id

# Each base pattern with its guard. They find what the plain patterns find from left to right without overlap, but
# begin only where a match can begin, and don't go back over what can't match otherwise. Repeated groups are possessive
# here and below: Java takes stack for each round of others, so that one long text would end an executor.
_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# Lengths of the registered IBANs by country, and top-level domains.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
DOMAINS = (
    "com net org edu gov mil int info biz name pro app dev io ai email mail online site shop store tech cloud blog company agency example test "
    "ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu "
    "cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu "
    "id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq "
    "mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg "
    "sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt "
    "za zm zw")


def _iban(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}\b"


_IBANS = "|".join(_iban(n, c) for n, c in IBAN_LENGTHS.items())
_DOMAIN = DOMAINS.replace(" ", "|")
_SPELLED = (r"(?i)^[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])? ?[(\[]at[)\]] ?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?: ?[(\[]dot[)\]] ?| ?\. ?))++"
            rf"(?:{_DOMAIN})$")
_FOREIGN_MAIL = rf"(?i)^[\p{{L}}\p{{N}}._%+-]+@(?:[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?\.)++(?:{_DOMAIN})$"
_NATIONAL = (r"^(?:\([0-9]{2,5}\) ?[0-9]{2,4}(?:[ .-]?[0-9]{2,5}){1,3}|(?:1[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|[0-9]{3}-[0-9]{4}"
             r"|0[0-9]{1,5}[ /.-]{1,3}[0-9]{2,8}(?:[ .-]?[0-9]{2,4}){0,4}|0[0-9]{8,10})$")
_CALLS = r"(?i)\b(?:(?:tele)?phone|tel|call|mobile|cell|fax|dial|ring|whatsapp|t[eé]l[eé]phone|t[eé]l|tel[eé]fono|m[oó]vil|telefon|handy)\b[^0-9\n]{0,12}$"
_DATE = r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:[0-9]{2}|[0-9]{4}))$"
_COUNTED = r"(?i)\b(?:version|section|chapter|page|order|invoice|total|isbn|issn|serial)\b[\s:#.]{0,4}$"
_QUAD = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
_AMOUNT = r"^[0-9]{1,3}(?:,[0-9]{3}){2,8}(?:\.[0-9]{1,2})?$|^[0-9]{1,3}(?:\.[0-9]{3}){2,8}$|^[0-9]+\.[0-9]+$"

GENERATORS = {
    "mail_like": (r"(?:\G|(?<![^\s<>(),;\[\]]))[^\s<>(),;@\[\]]++@[^\s<>(),;@\[\]]+", "@"),
    "spelled_mail": (r"(?i)\b[a-z0-9._%+-]{2,64} ?[(\[]at[)\]] ?[a-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| ?\.(?! )| \. )[a-z0-9-]{2,63})++", r"(?i)at[)\]]"),
    "number_like": (r"(?:\+|\()?(?<![0-9A-Za-z])[0-9][0-9\x20()./-]{5,30}[0-9](?![0-9A-Za-z])", None),
    "account_like": (rf"\b(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?)\b", None),
}
PRECISION, NEAR, MIN_KNOWN = 0.98, 0.8, 20
TREES, DEPTH = 12, 4

_CONTEXT = {
    "call": "phone|tel|call|mobile|fax|dial", "write": "mail|contact|write|send", "pay": "card|visa|payment|account|iban|bank",
    "host": r"\bip\b|host|server|address|ping", "other": r"version|section|chapter|page|date|\bno\b|\bid\b|order|total",
}


def find_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match), leftmost first without overlap, in code points.

    A start is the length of all matches and of all text between them so far.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))
                                                  ).alias("spans"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    places = F.sequence(F.lit(1), F.length(digits))
    doubled = F.transform(places, lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return (F.length(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0)


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _valid(spans: Column, rank: int, kind: str, check: Callable[[Column], Column]) -> Column:
    """The spans whose match passes the check, as (start, rank, kind, end)."""
    return F.transform(F.filter(spans, lambda s: check(s["match"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column, has_digit: Column) -> Column:
    """Array of (start, rank, kind, end) of the base kinds, sorted by start, then kind."""

    def valid_ip(m: Column) -> Column:
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    def digits_between(m: Column, low: int, high: int) -> Column:
        return F.length(digits_of(m)).between(low, high)

    guards = (text.contains("@"), has_digit & text.contains("."), has_digit, text.contains("+") & has_digit)
    checks = (lambda m: F.lit(True), valid_ip, lambda m: digits_between(m, 12, 19) & passes_luhn(digits_of(m)),
              lambda m: digits_between(m, 9, 15))
    found = []
    for rank, (kind, pattern, guard, check) in enumerate(zip(KINDS, (_MAIL, _IP, _CARD, _PHONE), guards, checks)):
        found.append(F.when(guard, _valid(find_spans(text, pattern), rank, kind, check)).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*found))


def _proposed(text: Column, rank: int, name: str, pattern: str) -> Column:
    return F.transform(find_spans(text, pattern), lambda s: F.struct(
        F.lit(rank).alias("rank"), F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"),
        F.substring(text, s["end"] + 1, F.lit(12)).alias("after")))


def proposals(text: Column, has_digit: Column) -> Column:
    """Array of (rank, generator, start, end, match, text before, text after) of the generators' spans."""
    none = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int,match:string,before:string,after:string>>")
    return F.concat(*[
        F.when(text.rlike(needs) if needs else has_digit, _proposed(text, rank, name, pattern)).otherwise(none)
        for rank, (name, (pattern, needs)) in enumerate(GENERATORS.items(), len(KINDS))])


def _features() -> dict[str, Column]:
    """Format and context of a proposal (columns kind, match, before, after) as numbers."""
    m, before, after = F.col("match"), F.lower("before"), F.lower("after")
    size = F.length(m)

    def times(pattern: str) -> Column:
        return size - F.length(F.regexp_replace(m, pattern, ""))

    out = {f"is_{g}": F.col("kind") == g for g in GENERATORS}
    out |= {
        "length": size, "digits": times("[0-9]"), "letters": times("[A-Za-z]"), "blanks": times(r"\x20"), "dots": times(r"\."), "hyphens": times("-"),
        "brackets": times("[()]"), "slashes": times("/"), "plus": m.startswith("+"), "groups": F.size(F.split(m, "[^0-9]+")),
        "longest": F.array_max(F.transform(F.split(m, "[^0-9]+"), F.length)), "check_digit": passes_luhn(digits_of(m)),
        "domain": m.rlike(r"@[^@]*\.[A-Za-z]{2,}$"), "kinds_of_chars": F.size(F.array_distinct(F.split(m, ""))),
        "glued_before": F.col("before").rlike(r"[\p{L}\p{N}_+@.-]$"), "glued_after": F.col("after").rlike(r"^[\p{L}\p{N}_@]"),
    }
    out |= {f"near_{n}": before.rlike(p) | after.rlike(p) for n, p in _CONTEXT.items()}
    return out


def passes_mod_97(account: Column) -> Column:
    """Whether an IBAN without blanks (capitals and digits) has right check digits."""
    chars = F.filter(F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: (
        F.when(c < "A", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55)) % 97) == 1


def evidence() -> Column:
    """Whether a proposal (columns kind, match, before) is proven or refuted by its generator's own evidence; null without evidence.

    An IBAN of a listed country by its length and check digits, a spelled or
    non-ASCII mail address by its domain, a phone number by national grouping
    after a word for it. Against a proposal: dates, amounts, counted things
    (versions, pages, orders), a dotted quad that is no address, 12 to 19 digits
    that aren't a phone number and fail the check digit, and a mail address
    without a domain.
    """
    m = F.col("match")
    account = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(account, 1, 2)
    listed, iban = F.lit(False), F.lit(False)
    for n, countries in IBAN_LENGTHS.items():
        own = country.isin(*countries.split())
        listed, iban = listed | own, iban | (own & (F.length(account) == n))
    digits = digits_of(m)
    number = (F.when(m.rlike(_DATE) | F.col("before").rlike(_COUNTED), False)
              .when(m.rlike(_NATIONAL) & F.length(digits).between(7, 15) & F.col("before").rlike(_CALLS), True)
              .when(m.rlike(_AMOUNT) | m.rlike(_QUAD), False)
              .when(F.length(digits).between(12, 19) & ~passes_luhn(digits) & ~m.rlike(r"^[+(0]"), False))
    return (F.when(F.col("kind") == "account_like", F.when(listed, iban & passes_mod_97(account)))
            .when(F.col("kind") == "spelled_mail", F.when(m.rlike(_SPELLED), True))
            .when(F.col("kind") == "mail_like", F.when(m.rlike(_FOREIGN_MAIL), True).when(~m.rlike(r"@.*\."), False))
            .when(F.col("kind") == "number_like", number))


def scored_rows(found: DataFrame) -> DataFrame:
    """One row per proposal: what it is, its label (null without evidence), and the vector of its features."""
    p = found.select("_rid", "doc_id", "_base", F.explode("_proposals").alias("_p")).select("_rid", "doc_id", "_base", "_p.*")
    cover = F.transform("_base", lambda b: (F.least(F.col("end"), b["end"]) - F.greatest(F.col("start"), b["start"]))
                        / (F.greatest(F.col("end"), b["end"]) - F.least(F.col("start"), b["start"])))
    p = p.withColumn("_cover", F.coalesce(F.array_max(cover), F.lit(-1.0)))
    p = p.select("_rid", "doc_id", "rank", "kind", "start", "end", "match", "before", "after",
                 F.when(F.col("_cover") >= NEAR, 1.0).when(F.col("_cover") > 0, 0.0).otherwise(evidence().cast("double")).alias("label"),
                 (F.col("_cover") > 0).alias("_touches"))
    features = _features()
    p = p.select("_rid", "doc_id", "rank", "kind", "start", "end", "label", "_touches", F.xxhash64("_rid", "start", "end", "match").alias("_h"),
                 *[c.cast("double").alias(f"f_{n}") for n, c in features.items()])
    return VectorAssembler(inputCols=[f"f_{n}" for n in features], outputCol="features").transform(p).select(
        "_rid", "doc_id", "rank", "kind", "start", "end", "label", "_touches", "_h", "features")


def fit(rows: DataFrame) -> tuple[GBTClassificationModel, float] | None:
    """The trees and the calibrated threshold; None if the proposals don't hold both labels or no threshold is sure enough.

    The trees learn from all the proposals with evidence, and from these alone, but for a fifth, chosen by a hash of what
    they are and where, that is held out to calibrate. The threshold is the lowest at which
    ``PRECISION`` of the held-out proposals with evidence are right, bin by bin
    from the top; it is measured only where at least ``MIN_KNOWN`` of them are
    known to be right and as many to be wrong, as fewer tell nothing of its precision.
    """
    known = rows.where(F.col("label").isNotNull()).select("label", "features", "_h")
    held = F.pmod(F.col("_h"), F.lit(5)) == 0
    if known.where(~held).agg(F.count_distinct("label")).first()[0] < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False).fit(known.where(~held))
    bins = model.transform(known.where(held)).groupBy(F.floor(_sure() * 100).alias("bin")).agg(
        F.sum("label").alias("right"), F.count(F.lit(1)).alias("n"))
    counted = bins.collect()  # at most 101 rows
    right, n = sum(b["right"] for b in counted), sum(b["n"] for b in counted)
    if min(right, n - right) < MIN_KNOWN:
        return None
    right = n = 0
    threshold = None
    for b in sorted(counted, key=lambda r: -r["bin"]):
        right, n = right + b["right"], n + b["n"]
        if right >= PRECISION * n:
            threshold = b["bin"] / 100
    return None if threshold is None else (model, max(threshold, 0.5))


def _sure() -> Column:
    return vector_to_array("probability")[1]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _rid, doc_id, spans (start, rank, kind, end), sorted by start, then by rank.

    The ranks of base kinds are below ``len(KINDS)``. Offsets are code points,
    the end exclusive. A null or empty text has no span; texts are read whole;
    other columns are not looked at; an empty table gives an empty result, and
    a corpus that gives no sure threshold gets base spans and proven proposals.
    """
    rows = with_row_id(docs, {"doc_id": docs[id_col].cast("long"), "_text": F.coalesce(docs[text_col], F.lit(""))})
    rows = rows.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    text, digit = F.col("_text"), F.col("_digit")
    found = checkpointed(rows.select("_rid", "doc_id", base_spans(text, digit).alias("_base"), proposals(text, digit).alias("_proposals")))
    candidates = checkpointed(scored_rows(found.where(F.size("_proposals") > 0)))
    learned = fit(candidates)
    free = candidates.where(~F.col("_touches"))
    proven = F.col("label") == 1.0
    sure = free.where(proven).select("_rid", "doc_id", "rank", "kind", "start", "end", F.lit(2.0).alias("_score"))
    if learned is not None:
        model, threshold = learned
        scored = model.transform(free.where(F.col("label").isNull())).where(_sure() >= threshold)
        sure = sure.unionByName(scored.select("_rid", "doc_id", "rank", "kind", "start", "end", _sure().alias("_score")))
    each = F.struct((-F.col("_score")).alias("order"), F.col("start"), F.col("rank"), F.col("kind"), F.col("end"))
    added = sure.groupBy("_rid", "doc_id").agg(F.sort_array(F.collect_list(each)).alias("_sure"))  # the proposals of one document
    kept = F.aggregate("_sure", F.array().cast(_SPANS), lambda acc, x: F.when(
        F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))))
    added = added.select(F.col("_rid").alias("_of"), F.col("doc_id").alias("_of_id"), kept.alias("_added"))
    out = found.select("_rid", "doc_id", "_base").join(added, (F.col("_rid") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_of_id")), "left")
    return out.select("_rid", "doc_id", F.when(F.col("_added").isNull(), F.col("_base")).otherwise(
        F.array_sort(F.concat("_base", "_added"))).alias("spans"))
