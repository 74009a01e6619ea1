"""Registered queries over built texts: books with markers, contents and all kinds of blocks, and answers with each pattern.

Each text is put together from parts that hold the row's number, so that SQL can say what comes out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.session import scratch
from casewright.operators import ingest, patterns, segment, study
from casewright.plans.queries import query
from casewright.sources.views import table
from casewright.streaming import flows


def _quoted(text: str) -> str:
    """SQL for a text of this module: # stands for the row's number, line ends are chr(10)."""
    parts = []
    for i, piece in enumerate(text.split("#N")):
        if i:
            parts.append("CAST(id AS VARCHAR)")
        for j, line in enumerate(piece.split("\n")):
            if j:
                parts.append("chr(10)")
            if line:
                parts.append("'" + line.replace("'", "''") + "'")
    return f"concat({', '.join(parts or [chr(39) * 2])})"


def _filled(text: str, by: str = "id") -> Column:
    return F.replace(F.lit(text), F.lit("#N"), F.col(by).cast("string"))


def _rows(values: list[tuple], columns: str) -> str:
    """A list of structs in SQL; texts are quoted, numbers and None are written as they are."""
    names = columns.split()
    cell = lambda v: "NULL" if v is None else _quoted(v) if isinstance(v, str) else f"CAST({v} AS INTEGER)"
    return "[" + ", ".join("{" + ", ".join(f"'{n}': {cell(v)}" for n, v in zip(names, row, strict=True)) + "}" for row in values) + "]"


def _expected(source: str, values: dict[int, list[tuple]], columns: str, key: str) -> str:
    """SQL: the rows of values[k] for every id of ``source`` whose number k is id modulo their count."""
    names = columns.split()
    parts = [f"SELECT id, unnest({_rows(rows, columns)}) AS x FROM ({source}) WHERE id % {len(values)} = {k}" for k, rows in values.items() if rows]
    return f"SELECT id AS {key}, " + ", ".join(f"x.{n} AS {n}" for n in names) + " FROM (" + " UNION ALL ".join(parts) + ")"


_ORDERS = "SELECT o_orderkey AS id FROM orders"


def _texts(spark, d, texts: dict[int, str]) -> DataFrame:
    """(book_id, markdown): for each order the text of its number."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    out = F.lit(None).cast("string")
    for k, text in texts.items():
        out = F.when(F.col("id") % len(texts) == k, _filled(text)).otherwise(out)
    return rows.select(F.col("id").alias("book_id"), out.alias("markdown"))


# -- markers and slices ---------------------------------------------------------------------------------

#: A chain with a gap and numbers beside it; one that starts at 3; two chains of equal length, of which the earlier stays; none.
MARKED = {
    0: ("before\n2\nalpha #N\n9\nbeta\n3\ngamma\n5\n\ndelta #N\n", [(2, "alpha #N\n9\nbeta"), (3, "gamma"), (5, "delta #N")]),
    1: ("3\none #N\n12\n 4 \ntwo\n8\nthree", [(3, "one #N\n12"), (4, "two\n8\nthree")]),
    2: ("1\nfirst #N\n2\nsecond\n1\nthird\n2\nfourth #N", [(1, "first #N"), (2, "second\n1\nthird\n2\nfourth #N")]),
    3: ("7\nno start #N\n8\nat all", []),
}


@query("marked_pages", _expected(_ORDERS, {k: v[1] for k, v in MARKED.items()}, "source_page markdown", "book_id"))
def _(spark, d):
    books = _texts(spark, d, {k: v[0] for k, v in MARKED.items()})
    return segment.page_slices(segment.page_markers(books)).select("book_id", "source_page", "markdown")


# -- blocks ---------------------------------------------------------------------------------------------

_N = "narrative_text"
#: Two pages that hold every kind of block, and an empty one: text -> (order_index, type, markdown, metadata).
PAGES = {
    0: (
        "# Chapter #N #\n\nIntro words #N\nsecond line\n\n> quoted #N\n> more\n\n| a | b |\n| --- | --- |\n| #N | 2 |\n\n![fig #N](img/#N.png)\n\nProblem 7:\n\nAlpha Co v. Beta Inc\n\nSupreme Court of Ohio, 1931.\n12 U.S. 345\n\n"
        "The court speaks #N.\n\nIt goes on.\n\n**Notes and Questions**\n\n1. First note #N\n\nProblem: what if #N?\n\n2. Second note\n\nAfter the notes.\n\n---\n\n1 Foot #N\n\n2 Second foot",
        [
            (0, "header", "# Chapter #N #", '{"level": 1, "text": "Chapter #N"}'), (1, _N, "Intro words #N\nsecond line", "{}"), (2, "block_quote", "> quoted #N\n> more", "{}"),
            (3, "table", "| a | b |\n| --- | --- |\n| #N | 2 |", '{"cols": 2, "rows": 2}'), (4, "figure", "![fig #N](img/#N.png)", '{"alt": "fig #N", "src": "img/#N.png"}'), (5, "problem", "Problem 7:", "{}"),
            (6, "case_header", "Alpha Co v. Beta Inc\n\nSupreme Court of Ohio, 1931.\n12 U.S. 345", '{"case_name": "Alpha Co v. Beta Inc", "citation": "12 U.S. 345", "court": "Supreme Court of Ohio", "year": 1931}'),
            (7, "case_opinion", "The court speaks #N.\n\nIt goes on.", '{"case_name": "Alpha Co v. Beta Inc", "citation": "12 U.S. 345", "court": "Supreme Court of Ohio", "year": 1931}'),
            (8, "header", "**Notes and Questions**", '{"level": 2, "text": "Notes and Questions"}'), (9, "numbered_note", "1. First note #N\n\nProblem: what if #N?", '{"has_problem": true, "number": 1}'),
            (10, "numbered_note", "2. Second note", '{"has_problem": false, "number": 2}'), (11, _N, "After the notes.", "{}"),
            (12, "footnote", "1 Foot #N", '{"footnote_number": 1}'), (13, "footnote", "2 Second foot", '{"footnote_number": 2}'),
        ],
    ),
    1: (
        "1 Not a footnote #N\n\n## Gamma v. Delta\n\nProse right away #N.\n\n# Next chapter\n\nwords #N",
        [
            (0, _N, "1 Not a footnote #N", "{}"), (1, "case_header", "## Gamma v. Delta", '{"case_name": "Gamma v. Delta"}'), (2, "case_opinion", "Prose right away #N.", '{"case_name": "Gamma v. Delta"}'),
            (3, "header", "# Next chapter", '{"level": 1, "text": "Next chapter"}'), (4, _N, "words #N", "{}"),
        ],
    ),
    2: ("", [(0, _N, "", "{}")]),
}


@query("page_blocks", _expected(_ORDERS, {k: v[1] for k, v in PAGES.items()}, "order_index type markdown metadata", "book_id"))
def _(spark, d):
    pages = _texts(spark, d, {k: v[0] for k, v in PAGES.items()}).withColumn("source_page", F.lit(1))
    return segment.blocks(pages).select("book_id", "order_index", "type", "markdown", "metadata")


# -- contents -------------------------------------------------------------------------------------------

_TOC = "order_index level title source_page parent_index"
#: A contents block with dotted, indented, hashed and piped rows that a heading ends; headings on marked pages; neither.
BOOKS = {
    0: (
        "words\nTable of Contents\nOpening #N . . . . . 1\n    *Deeper part* .... 12\n# Big title #N ........ 20\n### Small | 25\nnot a row\n# Real heading\nAfter it ....... 99",
        [(0, 1, "Opening #N", 1, None), (1, 2, "Deeper part", 12, 0), (2, 1, "Big title #N", 20, None), (3, 3, "Small", 25, 2)],
    ),
    1: (
        "# Zero #N\n1\n## One\ntext\n2\n\n### Two #N ##\n3\n# Three\n#### Four",
        [(0, 1, "Zero #N", 1, None), (1, 2, "One", 1, 0), (2, 3, "Two #N", 2, 1), (3, 1, "Three", 3, None), (4, 4, "Four", 3, 3)],
    ),
    2: ("no heading #N\nat all", []),
}


@query("contents_entries", _expected(_ORDERS, {k: v[1] for k, v in BOOKS.items()}, _TOC, "book_id"))
def _(spark, d):
    books = _texts(spark, d, {k: v[0] for k, v in BOOKS.items()})
    return segment.toc(segment.page_markers(books)).select("book_id", *_TOC.split())


# -- patterns -------------------------------------------------------------------------------------------

#: Answers and their rows (name, severity, excerpt, line) of the scanners that look at paragraphs, sentences and words around.
ANSWERS = {
    0: ("Intro #N.\n\nIt depends on the facts. The claim is unclear. More words follow.", [("hedge_without_resolution", "high", "It depends on the facts", 2)]),
    1: ("It depends on the facts. The tenant commits here #N.", []),
    2: ("It depends on the facts, #N. On balance the tenant wins.", []),
    3: ("First #N.\nThe rule is that leases end. Nothing else matters. It ends.", [("rule_recited_not_applied", "high", "The rule is that leases end.", 1)]),
    4: ("The rule is that leases end. Here the lease ended, #N.", []),
    5: ("In sum, Smith wins. Therefore, Smith does not win.", [("conclusion_mismatches_analysis", "medium", "In sum, Smith wins. Therefore, Smith does not win.", 0)]),
    6: ("Words #N.\nIn sum, Smith wins.\nTherefore, Jones wins.", [("conclusion_mismatches_analysis", "medium", "In sum, Smith wins. Therefore, Jones wins.", 2)]),
    7: ("In sum, Smith wins. Therefore, Smith wins again.", []),
    8: ("It is a contingent remainder and a vested remainder subject to open #N. Yes.", [("mismatched_future_interests", "high", "It is a contingent remainder and a vested remainder subject to open #N.", 0)]),
    9: ("One #N.\nA vested remainder subject to complete divestment exists. Nothing more.", [("mismatched_future_interests", "high", "A vested remainder subject to complete divestment exists.", 1)]),
    10: ("A vested remainder subject to complete divestment exists. So does an executory interest.", []),
    11: ("The tenant thought he owned the land #N.", [("ny_adverse_possession_reasonable_basis", "medium", "The tenant thought he owned the land #N.", 0)]),
    12: ("The tenant thought he owned the land on a reasonable basis #N.", []),
}


@query("answer_patterns", _expected(_ORDERS, {k: v[1] for k, v in ANSWERS.items()}, "name severity excerpt line", "id"))
def _(spark, d):
    answers = _texts(spark, d, {k: v[0] for k, v in ANSWERS.items()}).select(F.col("book_id").alias("id"), F.col("markdown").alias("text"))
    return patterns.scan(answers).select("id", "name", "severity", "excerpt", "line")


# -- ingestion ------------------------------------------------------------------------------------------

#: Two converted files a book: page comments in the first, none in the second; books divisible by 4 are known already.
PARTS = ["<!-- page 1 -->\n1\n# Alpha **#N**\n<!-- page 2 -->\n2\nbeta\n\nmore", "gamma\n3\n\n## Delta #N\n\nlast"]
_INGESTED = "source_page batch_pdf pdf_page_start pdf_page_end markdown raw_text n_blocks"
_PAGES_IN = [
    (1, "p0.pdf", 1, 2, "# Alpha **#N**\n<!-- page 2 -->", "Alpha #N", 1),
    (2, "p0.pdf", 2, 2, "beta\n\nmore\n\n<!-- batch:1 path:p1.pdf -->\n\ngamma", "beta\n\nmore\n\n\n\ngamma", 4),
    (3, "p1.pdf", 1, 1, "## Delta #N\n\nlast", "Delta #N\n\nlast", 2),
]


def _ingested(spark, d) -> dict[str, DataFrame]:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("corpus"))
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(f"p{i}.pdf").alias("path"), _filled(t).alias("markdown")) for i, t in enumerate(PARTS)])
    given = rows.select("id", F.concat(F.lit("Book "), F.col("id").cast("string")).alias("title"), F.when(F.col("id") % 3 > 0, F.col("corpus").cast("string")).alias("corpus_id"), F.explode(parts).alias("p"))
    files = given.select("title", "corpus_id", "p.*", F.sha2(F.concat("title", F.col("p.part").cast("string")), 256).alias("sha256"))
    corpora = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    known = ingest.books(files.where("CAST(substr(title, 6) AS BIGINT) % 4 = 0")).select(F.col("book_id").alias("id"))
    return ingest.ingested(files, known, corpora)


@query("ingested_pages", "SELECT concat('Book ', CAST(id AS VARCHAR)) AS title, " + _INGESTED.replace(" ", ", ") + f" FROM ({_expected(_ORDERS + ' WHERE o_orderkey % 4 <> 0 AND (o_orderkey % 3 = 0 OR o_custkey % 2 = 0)', {0: _PAGES_IN}, _INGESTED, 'id')})")
def _(spark, d):
    out = _ingested(spark, d)
    n = out["block"].groupBy("book_id", "source_page").agg(F.count(F.lit(1)).cast("int").alias("n_blocks"))
    pages = out["page"].join(n, ["book_id", "source_page"]).join(out["book"].select(F.col("id").alias("book_id"), "title"), "book_id")
    return pages.select("title", *_INGESTED.split())


@query(
    "ingested_books",
    """SELECT concat('Book ', CAST(o_orderkey AS VARCHAR)) AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'known' WHEN o_orderkey % 3 = 0 THEN 'new corpus' WHEN o_custkey % 2 = 0 THEN 'known corpus' ELSE 'corpus not found' END AS state,
    CASE WHEN o_orderkey % 4 <> 0 AND (o_orderkey % 3 = 0 OR o_custkey % 2 = 0) THEN 3 END AS source_page_max, CASE WHEN o_orderkey % 4 <> 0 AND (o_orderkey % 3 = 0 OR o_custkey % 2 = 0) THEN 2 ELSE 0 END AS n_toc FROM orders""",
)
def _(spark, d):
    out = _ingested(spark, d)
    toc = out["toc_entry"].groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n_toc"))
    rows = out["request"].select(F.col("book_id").alias("id"), "title", "state").join(out["book"].select("id", "source_page_max"), "id", "left").join(toc, "id", "left")
    return rows.select("title", "state", "source_page_max", F.coalesce("n_toc", F.lit(0)).alias("n_toc"))


@query(
    "streamed_books",
    """WITH o AS (SELECT *, o_orderkey % 3 = 0 OR o_custkey % 2 = 0 AS taken FROM orders)
    SELECT concat('Book ', CAST(o_orderkey AS VARCHAR)) AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'new corpus' WHEN taken THEN 'known corpus' ELSE 'corpus not found' END AS state,
    CASE WHEN taken THEN 3 END AS source_page_max, CASE WHEN taken THEN 3 ELSE 0 END AS n_pages, CASE WHEN taken THEN 7 ELSE 0 END AS n_blocks, CASE WHEN taken THEN 2 ELSE 0 END AS n_toc FROM o""",
)
def _(spark, d):
    """Two thirds of the books arrive first, then all of them: each is ingested once."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("corpus"))
    title = F.concat(F.lit("Book "), F.col("id").cast("string"))
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(f"p{i}.pdf").alias("path"), _filled(t).alias("markdown"), F.sha2(F.concat(title, F.lit(str(i))), 256).alias("sha256")) for i, t in enumerate(PARTS)])
    uploads = rows.select("id", title.alias("title"), F.when(F.col("id") % 3 > 0, F.col("corpus").cast("string")).alias("corpus_id"), parts.alias("files"))
    corpora = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    folder, out = scratch(spark, "uploads"), scratch(spark, "books")
    for some in (uploads.where("id % 3 <> 0"), uploads):
        some.drop("id").write.mode("append").option("compression", "zstd").parquet(folder)
        flows.ingest_books(flows.follow(spark, folder), corpora, out)
    made = flows.book_tables(spark, out)
    count = lambda name: made[name].groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias(f"n_{name}"))
    got = made["request"].select(F.col("book_id").alias("id"), "title", "state").join(made["book"].select("id", "source_page_max"), "id", "left")
    for name in ("page", "block", "toc_entry"):
        got = got.join(count(name), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return got.select("title", "state", "source_page_max", zero("n_page").alias("n_pages"), zero("n_block").alias("n_blocks"), zero("n_toc_entry").alias("n_toc"))


# -- texts, by their values -----------------------------------------------------------------------------


@query(
    "snippets",
    """WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS text, strpos(lower(coalesce(text, '')), 'thin th') AS hit, length(coalesce(text, '')) AS n FROM documents), u AS (SELECT *, greatest(hit - 120, 1) AS a, least(hit - 1 + 7 + 120, n) AS b FROM t)
    SELECT id, CASE WHEN n = 0 THEN '' WHEN hit > 0 THEN trim(replace(concat(CASE WHEN a > 1 THEN '…' ELSE '' END, substr(text, a, b - a + 1), CASE WHEN b < n THEN '…' ELSE '' END), chr(10), ' '))
        ELSE concat(trim(replace(substr(text, 1, 240), chr(10), ' ')), CASE WHEN n > 240 THEN '…' ELSE '' END) END AS snippet FROM u""",
)
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.snippet(F.col("text"), "Thin TH").alias("snippet"))


@query("word_counts", "SELECT doc_id AS id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\f\\r\\v]+'), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.word_count(F.coalesce("text", F.lit(""))).alias("n"))


@query(
    "switched_off_patterns",
    "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('p', o_custkey % 5, ',q') WHEN 1 THEN '' WHEN 2 THEN concat('p', o_custkey % 5) ELSE 'none' END AS names FROM orders",
)
def _(spark, d):
    kind, name = F.col("o_orderkey") % 4, F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string"))
    peeves = F.concat(F.lit('{"pet_peeves":[{"name":"'), name, F.lit('","disabled":'), F.when(kind == 1, "false").otherwise("true"), F.lit('},{"name":"x"},{"name":"q","disabled":'), F.when(kind == 0, "true").otherwise("false"), F.lit("}]}"))
    profile = F.parse_json(F.when(kind == 3, F.lit('{"course":"none"}')).otherwise(peeves))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.array_join(patterns.disabled(profile), ","), F.lit("none")).alias("names"))


@query(
    "hypothetical_summaries",
    """SELECT conv_id AS transcript_id, concat('Case ', turn % 2) AS label, coalesce(string_agg(substr(text, 1, 80), '|' ORDER BY turn) FILTER (turn % 3 <> 1 AND text IS NOT NULL), '') AS summaries, count(*) FILTER (turn % 3 <> 1) AS n FROM conversations GROUP BY 1, 2""",
)
def _(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("transcript_id"), F.col("turn").alias("order_index"), F.col("text").alias("content"), F.array(F.concat(F.lit("Case "), (F.col("turn") % 2).cast("string"))).alias("mentioned_cases"), none.alias("mentioned_rules"), none.alias("mentioned_concepts"),
        F.when(F.col("turn") % 3 != 1, F.array(F.lit("professor_hypothetical"))).alias("sentiment_flags"), F.lit(0).alias("start_char"), F.lit(10).alias("end_char"),
    )
    got = study.subject_features(rows)
    return got.select("transcript_id", "label", F.array_join("hypotheticals_run", "|").alias("summaries"), F.size("hypotheticals_run").cast("long").alias("n"))
