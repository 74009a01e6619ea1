"""Personal data by weak supervision, in DataFrame expressions.

Base spans (email, ip, card, phone) are matched and checked by rule and always stay. Wider patterns
propose more spans: identity numbers, account numbers, secrets, names after a title or a greeting, and
addresses written with words for their signs. Four labelers vote on every candidate, base ones included:
a format check, a gazetteer, the words before it and the characters around it. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is on each kind, and the posteriors
train the final span classifier, a naive Bayes model over the candidate's own features. It decides on the
added spans.

What is gathered is one histogram of at most kinds x 3^4 votes x 36 features cells, whatever the input.
Texts are read twice and never shuffled. Null text counts as empty. Patterns use possessive repeats and
anchors at the last match, so their time is linear in the text and their depth constant. Spans that start
together are listed by kind. Repeated rows get equal spans and count as often in the model; an empty table
gives no rows; the report ignores extra columns, redaction keeps them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import let, whole_text

_LOCAL = "A-Za-z0-9._%+-"
_FOUR = r"(?:[\x20]?[A-Z0-9]{4})"
#: Base kinds, in the order in which equal starts are listed. A match starts at the start of a run or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method may add.
MORE = {
    "secret": r"(?i)(?<![A-Za-z0-9])(?:password|passwd|token|secret|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?[A-Za-z0-9_/+-]{12,}+",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    # 15 to 34 characters in groups of four, the last one of one to four
    "account": rf"(?<![0-9A-Za-z])[A-Z]{{2}}[0-9]{{2}}(?:{_FOUR}{{7}}(?:[\x20]?[A-Z0-9]{{1,2}})?|{_FOUR}{{3,6}}(?:[\x20]?[A-Z0-9]{{1,3}})?|{_FOUR}{{2}}[\x20]?[A-Z0-9]{{3}})(?![0-9A-Za-z])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?[\x20]\p{Lu}\p{Ll}{1,30}(?:[\x20]\p{Lu}\p{Ll}{1,30})?",
    "spelled": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[(\[][\x20]?at[\x20]?[)\]][\x20]?[A-Za-z0-9-]{1,64}[\x20]?(?:\.|[(\[][\x20]?dot[\x20]?[)\]])[\x20]?[A-Za-z]{2,24}",
}
KINDS = [*BASE, *MORE]
#: A text without one of these strings, or without this pattern, can't hold a match.
_HOLDS = {"email": ["@"], "name": ["Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr"], "secret": ["=", ":"]}
_NEEDS = {
    "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "id": "-[0-9]{2}-", "account": "[A-Z]{2}[0-9]{2}",
    "spelled": "(?i)[(\\[][\\x20]?at",
}
#: Words that speak for a kind when they stand before a span.
_CONTEXT = {
    "email": "mail|contact|write|reach|from|to:", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|credit|pay|amex", "phone": "call|phone|tel|mobile|fax|sms",
    "secret": "login|user|account|key", "id": "ssn|social|security|identity", "account": "iban|account|bank|konto", "name": "dear|name|signed|by|contact", "spelled": "mail|contact|write|reach",
}
# The gazetteers. Given names of the four languages, top-level domains, countries with IBANs, and the
# first digits of calling codes and of card issuers, and the names under which secrets are kept.
GIVEN = """
James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Karen Sarah Charles Nancy Daniel Lisa Matthew Anna
Anthony Mark Sandra Paul Ashley Steven Emily Andrew Donna George Michelle Laura Peter Alice Emma Henry Grace Jack Olivia Hans Klaus Jürgen Wolfgang Uwe Stefan Andreas Heike
Monika Sabine Petra Ursula Gabriele Karl Heinz Franz Otto Greta Lukas Leon Mia Jean Pierre Michel Jacques Philippe Alain Bernard Marie Nathalie Isabelle Sylvie Catherine
Françoise Camille Louis Chloé Antoine Claire José María Antonio Manuel Francisco Juan Carmen Josefa Isabel Pilar Ana Javier Carlos Miguel Lucía Sofía Pablo Diego Elena Rosa Luis Maria Jose
""".split()
DOMAINS = "com org net edu gov mil int info biz name io dev app me tv co ai eu de at ch fr be lu es pt it nl uk ie us ca mx br ar cl au nz jp cn in kr se no dk fi pl cz ru ua tr gr za".split()
IBANS = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CALLING_3 = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
ISSUERS = "22 23 24 25 26 27 34 35 36 37 38 40 41 42 43 44 45 46 47 48 49 50 51 52 53 54 55 56 57 58 60 62 63 64 65 67".split()
SECRETS = "password passwd token secret apikey api_key api-key".split()


def _listed(kind: str, value: Column) -> Column:
    """Whether the part of a span that its kind's gazetteer lists is in it, as a whole token."""
    digits = _digits(value)
    if kind in ("email", "spelled"):
        return F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(DOMAINS)
    if kind == "ip":
        return F.regexp_extract(value, "^0*([0-9]{1,3})", 1).cast("int").isin([i for i in range(1, 224) if i != 127])
    if kind == "card":
        return F.left(digits, F.lit(2)).isin(ISSUERS)
    if kind == "phone":
        return F.left(digits, F.lit(1)).isin(CALLING) | F.left(digits, F.lit(2)).isin(CALLING + CALLING_3)
    if kind == "secret":
        return F.lower(F.regexp_extract(value, "^([A-Za-z_-]+)", 1)).isin(SECRETS)
    if kind == "id":
        return F.left(value, F.lit(3)).cast("int").isin([i for i in range(1, 900) if i != 666])
    if kind == "account":
        return F.left(value, F.lit(2)).isin(IBANS)
    return F.arrays_overlap(F.split(value, r"[\x20.]+"), F.array(*[F.lit(x) for x in GIVEN]))


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, kind: str) -> Column:
    """All leftmost, non-overlapping matches with code-point offsets: what lies between matches gives the starts."""
    pattern = {**BASE, **MORE}[kind]

    def located(found: Column, gaps: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            s = a["at"] + x["gap"]
            return F.struct((s + x["own"]).alias("at"), F.concat(a["out"], F.array(s)).alias("out"))

        pairs = F.transform(found, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(v).alias("own")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(pairs, zero, step, lambda a: a["out"])

        def span(v: Column, s: Column) -> Column:
            return F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s + F.length(v)).alias("end"), v.alias("value"))

        return F.zip_with(found, starts, span)

    # offsets are found for texts with a match only
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    spans = let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(_SPAN)).otherwise(let(F.split(text, pattern, -1), lambda g: located(f, g)).cast(_SPAN)))
    if kind in _HOLDS:
        needs = reduce(or_, [text.contains(x) for x in _HOLDS[kind]])
    else:
        needs = text.rlike(_NEEDS[kind])
    return F.when(needs, spans).otherwise(F.array().cast(_SPAN))


def luhn(digits: Column) -> Column:
    """Whether at most 20 digits pass Luhn's test."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(1, 21):
        d = F.substring(padded, i, 1)
        total = total + (F.translate(d, "0123456789", "0246813579") if i % 2 else d).cast("int")
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~value.rlike("(?:^|\\.)0*[1-9][0-9]{3}") & ~value.rlike("(?:^|\\.)0*(?:2(?:5[6-9]|[6-9][0-9])|[3-9][0-9]{2})(?:\\.|$)")
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans that pass their checks, by start, then kind."""

    def checked(kind: str) -> Column:
        return F.filter(_matches(text, kind), lambda x: _valid(kind, x["value"]))

    return F.array_sort(F.concat(*[checked(k) for k in BASE]))


def more_spans(text: Column) -> Column:
    """Candidates that the method may add, by start."""
    return F.array_sort(F.concat(*[_matches(text, k) for k in MORE]))


def _by_kind(kind: Column, table: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(kind == KINDS.index(k), v).otherwise(out)
    return out


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)


def described(text: Column, spans: Column) -> Column:
    """Each span with the votes of the labelers (1 for, -1 against, 0 abstains) and its features as small numbers."""

    def one(x: Column) -> Column:
        v = x["value"]
        left = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
        after = F.substring(text, x["end"] + 1, F.lit(1))
        before = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise(F.lit(""))
        n_digits = F.length(_digits(v))
        checks = _by_kind(x["kind"], {
            "email": _vote(v.rlike(r"^[A-Za-z0-9].*[A-Za-z]{2,}$"), v.rlike(r"\.\.|[0-9]$")), "ip": _vote(v.rlike(r"^[1-9]"), v.rlike(r"(?:^|\.)0[0-9]")),
            "card": _vote(v.rlike("^[3-6]"), v.rlike("^0")), "phone": _vote(n_digits.between(10, 13), n_digits < 10), "secret": _vote(v.rlike("[0-9]"), ~v.rlike("[0-9]")),
            "id": _vote(~v.rlike("^(?:000|666|9)|-00-|-0000$"), v.rlike("^(?:000|666|9)|-00-|-0000$")), "account": _vote(n_digits >= 10, n_digits < 10),
            "name": _vote(v.rlike(r"[\x20][A-Z][a-z]+[\x20][A-Z]")), "spelled": _vote(v.rlike("(?i)dot"), F.lit(False)),
        })
        gaz = _by_kind(x["kind"], {k: _vote(_listed(k, v)) for k in KINDS})
        ctx = _by_kind(x["kind"], {k: _vote(left.rlike(p)) for k, p in _CONTEXT.items()})
        edge = _vote(before.rlike(r"^[\s(\[<\"',;:]?$") & after.rlike(r"^[\s)\]>\"',;:.!?]?$"), before.rlike("[A-Za-z0-9]") | after.rlike("[A-Za-z0-9]"))
        size = F.when(F.length(v) < 12, 0).when(F.length(v) < 20, 1).otherwise(2)
        share = F.when(n_digits == 0, 0).when(n_digits * 2 < F.length(v), 1).otherwise(2)
        line = F.when(before.rlike(r"^\n?$") | after.rlike(r"^\n?$"), 1).otherwise(0)
        word = F.when(left.rlike(r"[a-z]{2,}[^a-z]{1,2}$"), 1).otherwise(0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.array(checks, gaz, ctx, edge).alias("votes"), F.array(size, share, line, word).alias("features"))

    return F.transform(spans, one)


def _em(cells: list[tuple[int, tuple, tuple, int]], rounds: int = 50) -> dict[tuple, float]:
    """Posterior that a candidate of this kind and these votes is personal data, by expectation-maximisation.

    Each labeler has, per class, a probability for each of its three answers; kinds share the labelers and
    have a prior each. Counts are smoothed by one. It starts from the majority of the votes.
    """
    hist: dict[tuple, int] = defaultdict(int)
    for kind, votes, _, n in cells:
        hist[kind, votes] += n
    keys = sorted(hist)
    post = {k: 1 / (1 + math.exp(-sum(k[1]) - (0.5 if k[0] < len(BASE) else -0.5))) for k in keys}
    for _ in range(rounds):
        prior, tot = defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        table = defaultdict(lambda: 1.0)
        mass = [12.0, 12.0]
        for k in keys:
            p, n = post[k], hist[k]
            prior[k[0]] += p * n
            tot[k[0]] += n
            for c, q in ((1, p), (0, 1 - p)):
                mass[c] += q * n
                for j, v in enumerate(k[1]):
                    table[c, j, v] += q * n
        size = [mass[c] - 9.0 for c in (0, 1)]
        for k in keys:
            lo = math.log(prior[k[0]] / max(tot[k[0]] - prior[k[0]], 1e-9))
            for j, v in enumerate(k[1]):
                lo += math.log(table[1, j, v] / size[1]) - math.log(table[0, j, v] / size[0])
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, lo))))
    return post


def fit(docs: DataFrame) -> dict:
    """The span classifier: per kind a prior log-odds, per feature value a log-odds, from a histogram of all candidates."""
    text = whole_text()
    # an inner explode would have the optimizer find all spans again in a filter before it
    found = described(F.col("_t"), F.concat(base_spans(F.col("_t")), more_spans(F.col("_t"))))
    spans = docs.select(text.alias("_t")).select(F.explode_outer(found).alias("c")).where("c IS NOT NULL")
    rows = spans.groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded: see the module's text
    cells = sorted((r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in rows)
    post = _em(cells)
    prior: dict[int, list[float]] = {k: [1.0, 1.0] for k in range(len(KINDS))}
    seen: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for kind, votes, features, n in cells:
        p = post[kind, votes]
        for c, q in ((0, 1 - p), (1, p)):
            prior[kind][c] += q * n
            for j, v in enumerate([*features, *votes]):
                seen[j, v][c] += q * n
    all_ = [sum(prior[k][c] for k in prior) for c in (0, 1)]
    return {
        "prior": [math.log(prior[k][1] / prior[k][0]) for k in range(len(KINDS))],
        "odds": {f"{j}:{v}": math.log(a[1] / all_[1]) - math.log(a[0] / all_[0]) for (j, v), a in sorted(seen.items())},
    }


def _accepted(model: dict, spans: Column) -> Column:
    """The spans that the classifier takes for personal data."""
    flat = [x for kv in model["odds"].items() for x in (F.lit(kv[0]), F.lit(kv[1]))] or [F.lit(""), F.lit(0.0)]
    odds, prior = F.create_map(*flat), F.array(*[F.lit(x) for x in model["prior"]])

    def keep(x: Column) -> Column:
        score = prior[x["kind"]]
        for j in range(8):
            v = x["features"][j] if j < 4 else x["votes"][j - 4]
            score = score + F.coalesce(odds[F.concat(F.lit(f"{j}:"), v.cast("string"))], F.lit(0.0))
        return score > 0

    return F.filter(spans, keep)


_BARE = "array<struct<start:int,kind:int,end:int>>"


def with_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Add ``base`` and ``spans`` (base ones and the added ones): arrays of (start, kind, end), in that order."""
    model = model or fit(docs)
    df = docs.withColumn("_t", whole_text())
    df = df.withColumns({"_b": base_spans(F.col("_t")), "_m": more_spans(F.col("_t"))})
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).cast(_BARE)
    extra = F.when(F.size("_m") == 0, F.array().cast(_BARE)).otherwise(bare(_accepted(model, described(F.col("_t"), F.col("_m")))))
    df = df.withColumns({"base": bare(F.col("_b")), "_x": extra}).withColumn("spans", F.array_sort(F.concat("base", "_x")))
    return df.drop("_t", "_b", "_m", "_x")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of spans per document."""
    df = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one.

    n_chars, where there is one, becomes the new length. Null text stays null; own columns keep their names and order.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    df = with_spans(packed)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], gap, names[x["kind"]])).otherwise(a["out"]).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    df = df.withColumn("_new", F.when(F.size("spans") == 0, text).otherwise(done))
    value = lambda c: F.col("_new") if c == "text" else F.length("_new").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"_doc.`{c}`")
    return df.select(*[value(c).alias(c) for c in docs.columns])
