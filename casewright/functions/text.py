"""Text expressions: tokens, normalisers, snippets, splits. All are column expressions inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the search and of the fidelity check.
SEARCH_STOPWORDS = ["a", "an", "the", "and", "or", "but", "of", "in", "on", "at", "to", "for", "is", "are", "was", "were", "be", "been", "being", "that", "this"]
FIDELITY_STOPWORDS = [
    "the", "a", "an", "of", "to", "for", "in", "on", "at", "with", "and", "or", "but", "not", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had",
    "it", "its", "this", "that", "these", "those", "court", "plaintiff", "defendant", "case",
]
LEADING_WORDS = ["In", "The", "A", "An", "And", "But", "Of", "For", "On", "At", "From", "By", "With", "As", "See", "Cf", "Per", "Via"]
#: All line ends that count, the two-character one first.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def tokens(text: Column, stopwords: list[str]) -> Column:
    """Lower-cased runs of ASCII letters and digits that are not stopwords, with repeats."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(*stopwords))


def match_score(query: list[str], text: Column) -> Column:
    """One per query token found as a substring, and half the tokens' number if the phrase occurs; 0 for no tokens."""
    if not query:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in query), F.lit(0.0))
    return hits + F.when(low.contains(" ".join(query)), 0.5 * len(query)).otherwise(0.0)


def snippet(text: Column, query: str, window: int = 120) -> Column:
    """The text around the first occurrence of the query, else its head; ellipses where it was cut."""
    at = F.locate(query.lower(), F.lower(text)) if query else F.lit(1)
    first = F.greatest(at - window, F.lit(1))
    last = F.least(at - 1 + len(query) + window, F.length(text))
    dots = lambda cond: F.when(cond, F.lit("…")).otherwise(F.lit(""))
    around = F.trim(F.translate(F.concat(dots(first > 1), F.substring(text, first, last - first + 1), dots(last < F.length(text))), "\n", " "))
    head = F.concat(F.trim(F.translate(F.substring(text, F.lit(1), F.lit(2 * window)), "\n", " ")), dots(F.length(text) > 2 * window))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").when(at > 0, around).otherwise(head)


def equal_name(name: Column) -> Column:
    """A case name for comparison: lower case, single blanks, one form of "v", no trailing dots."""
    out = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    out = F.regexp_replace(out, r"\bv(?:s)?\.?(?=\s|$)", "v")
    return F.regexp_replace(out, r"\.+$", "")


def fuzzy_name(name: Column) -> Column:
    """A case name for scoring: no leading opener word, every separator written " v. "."""
    openers = "|".join(LEADING_WORDS)
    out = F.regexp_replace(F.ltrim(name), rf"^(?:{openers})\s+(?=\S)", "")
    for pattern in (r"(?i)\s+versus\s+", r"(?i)\s+vs\.?\s+", r"(?i)\s+vee\s+", r"\s+B\s+", r"\s+v\s+(?=[A-Z])"):
        out = F.regexp_replace(out, pattern, " v. ")
    return F.trim(out)


# The two shapes of a mention.
V_SHAPE = r"(\b[A-Z][A-Za-z'.]+(?:\s+[A-Z][A-Za-z'.]+){0,4}\s+(?:v\.?|vs\.?|versus|vee|B)\s+[A-Z][A-Za-z'.]+(?:\s+[A-Z][A-Za-z'.]+){0,4}\b)"
CAPITALISED = r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b)"


def mentions(text: Column) -> Column:
    """Candidate names in order: "X v. Y" shapes, then capitalised runs that are not inside an earlier candidate."""
    shaped = F.array_distinct(F.regexp_extract_all(text, F.lit(V_SHAPE), 1))
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), 1))
    return F.aggregate(runs, shaped, lambda kept, x: F.when(F.exists(kept, lambda k: k.contains(x)), kept).otherwise(F.concat(kept, F.array(x))))


def raw_text(markdown: Column) -> Column:
    """Markdown without heading marks, stars and comments."""
    out = F.regexp_replace(markdown, r"(?md)^\s*#{1,6}\s*", "")
    out = F.regexp_replace(out, r"\*{1,3}", "")
    return F.btrim(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), F.lit(" \t\n\r\x0b\x0c"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark before a blank and a capital."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.trim(x)), lambda x: x != "")


def line_of(text: Column, needle: Column) -> Column:
    """The number, from 0, of the line in which the first 40 characters of ``needle`` first occur; 0 if they don't."""
    at = F.call_function("instr", text, F.left(needle, F.lit(40)))
    before = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.when(at > 0, F.length(before) - F.length(F.translate(before, "\n", ""))).otherwise(0)


def lines_before(text: Column, at: Column) -> Column:
    """Line breaks before the position ``at`` (from 0)."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.translate(before, "\n", ""))


def between(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches of a pattern that matches no empty text.

    A split by a pattern compiles it for every row, one by a single character doesn't; so the matches become one that the text lacks.
    """
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x00")), "\x00", -1)
    return F.when(F.contains(text, F.lit("\x00")), F.split(text, pattern, -1)).otherwise(marked)


def first_match(text: Column, pattern: str) -> Column:
    """Struct (at, found): the position from 0 of the first match of the pattern and the match, or null."""
    found = F.regexp_substr(text, F.lit(pattern))
    at = F.length(between(text, pattern)[0])
    return F.when(found.isNotNull(), F.struct(at.alias("at"), found.alias("found")))


def all_matches(text: Column, pattern: str) -> Column:
    """Array of (at, found) of all matches; where there is none, the text is not split."""
    none = F.array().cast("array<struct<at:int,found:string>>")

    def located(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(between(text, pattern), 1, F.size(found)), lambda f, g: F.struct(F.length(f).alias("f"), F.length(g).alias("g"), f.alias("found")))
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            at = a["at"] + x["g"]
            return F.struct((at + x["f"]).alias("at"), F.concat(a["out"], F.array(F.struct(at.alias("at"), x["found"].alias("found")))).alias("out"))

        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, zero, step, lambda a: a["out"]))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)), located)[0]


def title_of(kind: Column, id_: Column, *names: Column) -> Column:
    """The first name that is not blank, else "kind · id"."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(*[blank(n) for n in names], F.concat(kind, F.lit(" · "), F.left(id_.cast("string"), F.lit(8))))


def masked(key: Column) -> Column:
    """The first seven and the last four characters."""
    return F.concat(F.left(key, F.lit(7)), F.lit("…"), F.right(key, F.lit(4)))


#: How a JSON value may begin; a text that doesn't is not parsed, as a failed parse costs more than all else.
JSON_START = r"^\s*(?:[\[{\"\-+0-9NI]|true|false|null)"


def json_payload(text: Column) -> Column:
    """The JSON object in a reply: bare, else fenced, else from the first brace to the last; null if none parses."""
    read = lambda x: F.when(x.rlike(JSON_START), F.try_parse_json(F.trim(x)))
    fenced = F.when(F.contains(text, F.lit("```")), read(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)))
    braced = F.when(F.contains(text, F.lit("{")), read(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))
    return F.coalesce(read(text), fenced, braced)
