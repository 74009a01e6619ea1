"""Books: page markers, page slices, typed blocks and tables of contents.

Lines and groups are exploded and joined with built-in expressions. Two steps are ordered state machines and
run in Python on Arrow batches, one book or page a row: the longest marker chain and the block segmenter.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.session import ship
from casewright.functions.text import LINE_END, raw_text


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    # one line end for all, as a split by a pattern compiles it for every row
    ends = F.regexp_replace(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, "\n")
    return F.split(ends, "\n", -1)


def numeric_lines(markdown: Column) -> Column:
    """array<struct<line_index, value>> of the lines that hold one whole number."""
    numbered = F.transform(lines(markdown), lambda x, i: F.struct(i.alias("line_index"), F.trim(x).alias("text")))
    digits = F.filter(numbered, lambda x: x["text"].rlike("^[0-9]{1,9}$"))
    return F.transform(digits, lambda x: F.struct(x["line_index"].alias("line_index"), x["text"].cast("int").alias("value")))


def longest_chain(candidates: list[tuple[int, int]], max_gap: int = 2, max_start: int = 3) -> list[tuple[int, int]]:
    """The longest run of candidates, in line order, that starts at 1..max_start and rises by 1..max_gap a step.

    Linear: for each value the best chain that ends there so far is kept, longer first, then earlier.
    """
    best: dict[int, tuple[int, int]] = {}  # value -> (length, -index)
    before: list[int] = []
    top = (0, 0)
    for i, (_, value) in enumerate(candidates):
        ends = [best[value - g] for g in range(1, max_gap + 1) if value - g in best]
        if ends:
            length, at = max(ends)
            before.append(-at)
        elif 1 <= value <= max_start:
            length = 0
            before.append(-1)
        else:
            before.append(-1)
            continue
        mine = (length + 1, -i)
        if mine > best.get(value, (0, 0)):
            best[value] = mine
        top = max(top, mine)
    out: list[tuple[int, int]] = []
    at = -top[1] if top[0] else -1
    while at >= 0:
        out.append(candidates[at])
        at = before[at]
    return out[::-1]


MARKER = "array<struct<line_index:int,value:int,start:int,end:int>>"


def _chains(max_gap: int, max_start: int):
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("line_index", "value", "start", "end")]))

    def marked(text: str, candidates: list[dict]) -> list[dict]:
        """The chain, each marker with the code points of its page: after its line, up to the next marker's."""
        chain = longest_chain([(c["line_index"], c["value"]) for c in candidates], max_gap, max_start)
        starts = [0, *itertools.accumulate(map(len, text.splitlines(keepends=True)))] if chain else []
        ends = [starts[i] for i, _ in chain[1:]] + starts[-1:]
        return [{"line_index": i, "value": v, "start": min(starts[i + 1], e), "end": e} for (i, v), e in zip(chain, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marked(t or "", c or []) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            names = ["markdown", *batch.schema.names[2:], "markers"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, kind)], names)

    return run


def page_markers(books: DataFrame, max_gap: int = 2, max_start: int = 3, keep: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """markdown, ``keep`` columns and markers of books; the text passes through, so nothing is joined back."""
    ship(books.sparkSession)
    rows = books.select("markdown", numeric_lines(F.col("markdown")).alias("c"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(_chains(max_gap, max_start), f"markdown string, {kinds}, markers {MARKER}")


def page_slices(marked: DataFrame, keep: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """``keep``, source_page, start, end, markdown, raw_text of every marked page, without line ends around; text before the first is dropped."""
    df = marked.select("markdown", *keep, F.explode("markers").alias("m"))
    body = F.btrim(F.substring(F.col("markdown"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")), F.lit("\n"))
    df = df.select(*keep, F.col("m.value").alias("source_page"), "m.start", "m.end", body.alias("markdown"))
    return df.withColumn("raw_text", raw_text(F.col("markdown")))


# -- blocks ---------------------------------------------------------------------------------------------

# The shapes that tell blocks apart.
_NAME = r"[A-Za-z0-9 .’'\-&,]"
CASE = re.compile(rf"^(?:\s*(?:#{{1,3}}\s*|\*{{2,4}}\s*))?([A-Z]{_NAME}+?)\s+v\.\s+([A-Z]{_NAME}+?)(?:\s*\*{{2,4}})?\s*$")
COURT = re.compile(r"^\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z.]*)*\s+Court\s+of\s+[A-Z][A-Za-z.]+(?:\s+[A-Z][A-Za-z.]+)*),\s*(\d{4})\.?\s*$")
CITE = re.compile(r"^\s*(\d+\s+U\.S\.\s+\d+(?:,\s*\d+)?|\d+\s+[A-Z][A-Za-z.]+(?:\s+[A-Z][A-Za-z.]+)*\s+\d+[a-zA-Z]*\s+\d+)\s*$")
NOTES = re.compile(r"^\s*(?:#{1,6}\s*|\*{1,4}\s*)?Notes\s+and\s+Questions\s*(?:\*{1,4}\s*)?$", re.I)
NUMBERED = re.compile(r"^\s*(\d+)\.\s+\S")
PROBLEM = re.compile(r"^\s*Problem(?:\s+\d+)?\s*[:.]?\s*$")
PROBLEM_IN = re.compile(r"^\s*Problem(?:\s+\d+)?\s*[:.]|Problem:", re.M)
FOOTNOTE = re.compile(r"^(\d+)\s+\S")
RULE = re.compile(r"^\s*(?:---+|\*)\s*$")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
FIGURE = re.compile(r"^\s*!\[([^\]]*)\]\(([^)]+)\)\s*$")
ALIGN = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")


def _court(group: str) -> dict:
    """Court, year and citation from a group's first three lines; empty if the first is prose."""
    out: dict = {}
    for line in [x for x in group.splitlines() if x.strip()][:3]:
        if m := COURT.match(line):
            out |= {"court": m[1].strip(), "year": int(m[2])}
        elif m := CITE.match(line):
            out["citation"] = m[1].strip()
        else:
            break
    return out


def _kind(group: str) -> str:
    """What a group is by itself, by the first shape that fits."""
    lines = group.splitlines()
    first, start = lines[0] if lines else "", group.lstrip()[:1]
    # a pattern is tried only where its first character is there
    if "v." in first and CASE.match(first):
        return "case"
    if start in ("#", "*", "N", "n") and NOTES.match(group):
        return "notes"
    if start.isdecimal() and NUMBERED.match(group):
        return "numbered_note"
    if PROBLEM.match(first):
        return "problem"
    rows = [x for x in lines if x.strip()]
    if len(rows) > 1 and "|" in rows[0] and ALIGN.match(rows[1]):
        return "table"
    if len(rows) == 1 and start == "!" and FIGURE.match(group.strip()):
        return "figure"
    if rows and all(r.lstrip().startswith(">") for r in rows):
        return "block_quote"
    return "header" if len(rows) == 1 and start == "#" and HEADING.match(group.strip()) else "narrative_text"


def segment(page: str) -> list[tuple[str, str, dict]]:
    """(type, markdown, metadata) of a page's blocks in order; an empty page has one empty narrative block."""
    if not page:
        return [("narrative_text", "", {})]
    groups = [g for g in re.split(r"\n[ \t]*(?:\n[ \t]*)+", "\n".join(page.splitlines()).strip("\n")) if g.strip()]
    kinds = [_kind(g) for g in groups]
    # footnotes: the run of numbered groups at the end, if a rule stands before it
    at = len(groups)
    while at and not RULE.match(groups[at - 1].strip()) and FOOTNOTE.match(groups[at - 1].strip()):
        at -= 1
    if 0 < at < len(groups) and RULE.match(groups[at - 1].strip()):
        del groups[at - 1], kinds[at - 1]
        kinds[at - 1 :] = ["footnote"] * (len(kinds) - at + 1)
    out: list[tuple[str, str, dict]] = []
    i = 0

    def take(stop) -> list[str]:
        nonlocal i
        got = []
        while i < len(groups) and not stop(kinds[i], groups[i]):
            got.append(groups[i])
            i += 1
        return got

    def emit(kind: str, parts: list[str], meta: dict) -> None:
        out.append((kind, "\n\n".join(parts).rstrip(), meta))

    while i < len(groups):
        kind, group = kinds[i], groups[i]
        i += 1
        if kind == "case":
            m = CASE.match(group.splitlines()[0])
            meta = {"case_name": f"{m[1].strip()} v. {m[2].strip()}"}
            parts = [group]
            if i < len(groups) and kinds[i] != "footnote" and (more := _court(groups[i])):
                meta |= more
                parts.append(groups[i])
                i += 1
            emit("case_header", parts, meta)
            ends = ("footnote", "case", "notes", "numbered_note", "problem")
            if body := take(lambda k, g: k in ends or g.startswith("# ")):
                emit("case_opinion", body, meta)
        elif kind == "numbered_note":
            parts = [group, *take(lambda k, g: k in ("footnote", "case", "notes", "numbered_note") or g.startswith("# ") or not PROBLEM_IN.match(g.splitlines()[0]) and k != "problem")]
            emit(kind, parts, {"number": int(NUMBERED.match(group)[1]), "has_problem": bool(PROBLEM_IN.search("\n\n".join(parts)))})
        elif kind == "footnote":
            emit(kind, [group.strip()], {"footnote_number": int(FOOTNOTE.match(group.strip())[1])})
        elif kind == "table":
            rows = [r for r in group.splitlines() if r.strip()]
            emit(kind, [group], {"rows": len(rows) - 1, "cols": len(rows[0].strip().strip("|").split("|"))})
        elif kind == "figure":
            m = FIGURE.match(group.strip())
            emit(kind, [group], {"alt": m[1], "src": m[2]})
        elif kind in ("header", "notes"):
            m = HEADING.match(group.strip())
            emit("header", [group], {"level": len(m[1]) if m else 2, "text": m[2].strip() if m else group.strip().strip("*").strip()})
        else:
            emit(kind, [group], {})
    return out or [("narrative_text", "", {})]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["book_id", "source_page", "order_index", "type", "markdown", "metadata"]
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for row, md in enumerate(batch.column(2).to_pylist()):
            for i, (kind, text, meta) in enumerate(segment(md or "")):
                for c, v in zip(cols, (row, i, kind, text, json.dumps(meta, sort_keys=True) if meta else "{}"), strict=True):
                    c.append(v)
        of = pa.array(cols[0], pa.int64())
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names)


def blocks(pages: DataFrame) -> DataFrame:
    """Typed blocks of pages (book_id, source_page, markdown)."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)["book_id"]
    rows = pages.select("book_id", F.col("source_page").cast("int"), "markdown")
    out = rows.mapInArrow(_segments, f"book_id {kind}, source_page int, order_index int, type string, markdown string, metadata string")
    return out.withColumn("id", F.sha2(F.concat_ws("|", F.col("book_id").cast("string"), "source_page", "order_index"), 256))


# -- table of contents ----------------------------------------------------------------------------------

# The shapes of a contents block's title and rows, and of a heading.
CONTENTS = r"(?i)^\s*(?:#{1,6}\s*)?(?:\*{1,3}\s*)?(?:Table\s+of\s+)?Contents\s*(?:\*{1,3})?\s*$"
ROW = r"^\s*(\S.*?\S)\s*[\.\s_]{2,}\s*(\d+)\s*$"
PIPE = r"^\s*(\S.*?)\s*\|\s*(\d+)\s*$"
HEAD = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def _entries(markers: Column, text: Column) -> Column:
    """array<struct<order_index, level, title, source_page, parent_index>> of a book's contents, in its own row.

    Only lines that may be a title, a row or a heading are looked at; each step is over the book's array of them.
    """
    numbered = F.transform(lines(text), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    some = F.filter(numbered, lambda x: x["text"].rlike(r"(?i)contents|^#|\d\s*$"))

    def read(x: Column) -> Column:
        hashes = F.length(F.regexp_extract(x["text"], HEAD, 1))
        body = F.when(hashes > 0, F.regexp_extract(x["text"], HEAD, 2)).otherwise(x["text"])
        return F.struct(x["line"].alias("line"), x["text"].alias("text"), hashes.alias("hashes"), body.alias("body"), x["text"].rlike(CONTENTS).alias("is_title"), body.rlike(ROW).alias("dotted"), body.rlike(PIPE).alias("piped"))

    def row(x: Column, start: Column) -> Column:
        part = lambda k: F.when(x["dotted"], F.regexp_extract(x["body"], ROW, k)).otherwise(F.regexp_extract(x["body"], PIPE, k))
        title = F.trim(F.regexp_replace(F.trim(part(1)), r"^[*_]+|[*_]+$", ""))
        indent = F.length(x["text"]) - F.length(F.regexp_replace(x["text"], "^ +", ""))
        level = F.when(x["hashes"] > 0, x["hashes"]).otherwise(F.least(1 + F.floor(indent / 4), F.lit(6))).cast("int")
        is_row = (x["dotted"] | x["piped"]) & (x["line"] > start) & (title != "")
        return F.struct(x["line"].alias("line"), x["text"].alias("text"), x["hashes"].alias("hashes"), is_row.alias("is_row"), level.alias("level"), title.alias("title"), F.when(is_row, part(2)).cast("int").alias("page"))

    least = lambda found: F.get(found, F.lit(0))["line"]  # noqa: E731  the lines are in order
    last = F.lit(2**31 - 1)

    def listed(rows: Column) -> Column:
        """The rows of the contents block: a heading that is no row ends it once there are rows."""
        first = F.coalesce(least(F.filter(rows, lambda x: x["is_row"])), last)
        ends = lambda x: (x["hashes"] > 0) & ~x["is_row"] & ~x["text"].contains(". . .") & ~x["text"].contains("…") & (x["line"] > first)
        stop = F.coalesce(least(F.filter(rows, ends)), last)
        mine = F.filter(rows, lambda x: x["is_row"] & (x["line"] < stop))
        return F.transform(mine, lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("source_page")))

    def headed(x: Column) -> Column:
        before = F.filter(markers, lambda m: m["line_index"] <= x["line"])
        page = F.coalesce(F.get(before, F.size(before) - 1)["value"], F.get(markers, F.lit(0))["value"], F.lit(0))
        return F.struct(x["hashes"].alias("level"), F.trim(F.regexp_extract(x["text"], HEAD, 2)).alias("title"), page.alias("source_page"))

    def entries(found: Column) -> Column:
        start = least(F.filter(found, lambda x: x["is_title"]))
        # without a contents block no line is a row, also where every line looks like one
        rows = F.when(start.isNotNull(), _let(_let(start, lambda at: F.transform(F.filter(found, lambda x: (x["line"] > at) & (x["dotted"] | x["piped"] | (x["hashes"] > 0))), lambda x: row(x, at))), listed))
        headings = F.transform(F.filter(found, lambda x: (x["hashes"] > 0) & ~x["is_title"]), headed)
        return _let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(headings))

    return _let(_let(F.transform(some, read), entries), parents)


def _let(value: Column, f) -> Column:
    """Evaluate ``value`` once and use it in ``f``."""
    return F.transform(F.array(value), f)[0]


def parents(rows: Column) -> Column:
    """The entries (level 1 to 6, title, source_page) with order_index and parent_index: the latest earlier entry of a lower level."""
    kind = "struct<seen:array<int>,out:array<struct<order_index:int,level:int,title:string,source_page:int,parent_index:int>>>"
    zero = F.struct(F.array_repeat(F.lit(None).cast("int"), 6).alias("seen"), F.array().alias("out")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        at = F.size(a["out"])
        entry = F.struct(at.alias("order_index"), x["level"].alias("level"), x["title"].alias("title"), x["source_page"].alias("source_page"), F.array_max(F.slice(a["seen"], F.lit(1), x["level"] - 1)).alias("parent_index"))
        seen = F.transform(a["seen"], lambda v, i: F.when(i + 1 == x["level"], at).otherwise(v))
        return F.struct(seen.alias("seen"), F.concat(a["out"], F.array(entry)).alias("out")).cast(kind)

    return F.aggregate(rows, zero, step, lambda a: a["out"])


def toc(marked: DataFrame) -> DataFrame:
    """(book_id, order_index, level, title, source_page, parent_index) from a contents block, else from headings.

    A heading takes the page of the last marker at or before its line, the first marker's before all, 0 without any.
    A book's contents are found in its own row, so nothing is shuffled.
    """
    return marked.select("book_id", F.inline(_entries(F.col("markers"), F.col("markdown"))))
