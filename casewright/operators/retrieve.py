"""Retrieval of pages and blocks: by page range, case name, assignment code, or vector; and the book listings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions.session import ship
from casewright.functions.text import equal_name
from casewright.sources import store

READING = ["source_page", "order_index"]
PLAIN_TRAIL = ["numbered_note", "narrative_text", "footnote"]
#: Queries whose likeness to a block of vectors a task holds at once.
AT_ONCE = 128


@dataclass(frozen=True)
class PageRange:
    book_id: object
    start: int
    end: int

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("start is after end")


def page_range(rows: DataFrame, q: PageRange) -> DataFrame:
    """Pages or blocks of a book between two pages, inclusive; the filter reaches the scan, of a stored table the book's folder."""
    return rows.where(store.of_book(rows, q.book_id) & F.col("source_page").between(q.start, q.end))


def range_notes(pages: DataFrame, q: PageRange) -> DataFrame:
    """Notes: nothing found, start clamped, end clamped."""
    ends = pages.where(store.of_book(pages, q.book_id)).agg(F.min("source_page").alias("lo"), F.max("source_page").alias("hi"))
    none = F.col("lo").isNull() | (F.col("hi") < q.start) | (F.col("lo") > q.end)
    notes = F.array_compact(F.array(
        F.when(none, "no pages in this range"), F.when(~none & (F.col("lo") > q.start), F.concat(F.lit("start clamped to "), F.col("lo").cast("string"))),
        F.when(~none & (F.col("hi") < q.end), F.concat(F.lit("end clamped to "), F.col("hi").cast("string"))),
    ))
    return ends.select(F.explode(notes).alias("note"))


def with_case(blocks: DataFrame) -> DataFrame:
    """Add ``case_no``, headers and opinions so far in reading order, and ``opinion_id``, the last of them if it is an opinion.

    An opinion and what trails it share both; a case starts with its only opinion, so one sorted window finds them.
    """
    order = Window.partitionBy("book_id").orderBy(*READING, "id").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("type").isin("case_header", "case_opinion")
    last = F.last(F.when(starts, F.struct(F.when(F.col("type") == "case_opinion", F.col("id")).alias("id"))), ignorenulls=True)
    return blocks.withColumns({"case_no": F.sum(starts.cast("long")).over(order), "opinion_id": last.over(order)["id"]})


def case_trails(blocks: DataFrame) -> DataFrame:
    """Every opinion's blocks: the opinion itself and those up to the next header or opinion, with the opinion's id."""
    return with_case(blocks).where(F.col("opinion_id").isNotNull())


def case_reference(blocks: DataFrame, book_id, name: str) -> DataFrame:
    """The blocks of the first opinion of a book whose name is equal after normalising."""
    df = case_trails(blocks.where(store.of_book(blocks, book_id)))
    mine = df.where((F.col("type") == "case_opinion") & (equal_name(F.col("case_name")) == equal_name(F.lit(name))))
    first = mine.agg(F.min_by("id", F.struct(*READING, "id")).alias("opinion_id"))
    return df.join(F.broadcast(first), "opinion_id", "left_semi")


def trail_note(trail: DataFrame) -> DataFrame:
    """The sorted block types that follow an opinion and are neither notes, narrative nor footnotes."""
    odd = trail.where(~F.col("type").isin("case_opinion", *PLAIN_TRAIL))
    return odd.groupBy("opinion_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"))


def assignment_blocks(entries: DataFrame, rows: DataFrame, books: DataFrame) -> DataFrame:
    """(code, id, ...) of pages or blocks in the page ranges of each assignment, in the corpus's oldest book, each once.

    ``entries``: corpus_id, code, ranges array<struct<start, end>>; ranges that lack an end are skipped.
    """
    oldest = books.groupBy("corpus_id").agg(F.min_by("id", F.struct("ingested_at", "id")).alias("book_id"))
    spans = entries.select("corpus_id", "code", F.posexplode("ranges").alias("position", "r")).where("r.start IS NOT NULL AND r.end IS NOT NULL")
    spans = spans.join(oldest, "corpus_id").select("code", "position", "book_id", F.col("r.start").alias("_s"), F.col("r.end").alias("_e"))
    hits = rows.join(spans, "book_id").where(F.col("source_page").between(F.col("_s"), F.col("_e")))
    return hits.groupBy("code", "id").agg(F.min("position").alias("position"), *[F.first(c).alias(c) for c in ("book_id", *READING)])


def latest_entry(entries: DataFrame, syllabi: DataFrame) -> DataFrame:
    """For each (corpus, code) the entry of the newest syllabus."""
    df = entries.join(syllabi, "syllabus_id")
    newest = Window.partitionBy("corpus_id", "code").orderBy(F.desc("created_at"), F.desc("syllabus_id"))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def bad_ranges(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Ranges that leave their book's pages; those without two ends are passed over."""
    spans = entries.select("book_id", "code", F.explode("ranges").alias("r")).where("r.start IS NOT NULL AND r.end IS NOT NULL")
    df = spans.join(books.select(F.col("id").alias("book_id"), "page_min", "page_max"), "book_id")
    return df.where((F.col("r.start") < F.col("page_min")) | (F.col("r.end") > F.col("page_max"))).select("book_id", "code", "r.start", "r.end")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, order: list[str] | None = None) -> DataFrame:
    """The value of the last right row at or before each left row's ``at``; among equals the last by ``order``.

    One shuffle by key over the union of both sides and one pass of a window, whatever the ranges' sizes.
    """
    order = order or []
    kinds = dict(right.dtypes)
    l = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(kinds[o]).alias(f"_o{i}") for i, o in enumerate(order)], F.lit(None).cast(kinds[value]).alias("_v"))  # noqa: E741
    r = right.select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(value))


def in_order(ids: DataFrame, blocks: DataFrame, key: str, array: str) -> DataFrame:
    """Blocks in the order of each row's list of ids; unknown ids are passed over."""
    return ids.select(key, F.posexplode(array).alias("position", "id")).join(blocks, "id")


def case_rows(blocks: DataFrame, start: int | None = None, end: int | None = None, seed: int | None = None) -> DataFrame:
    """Opinions as a listing: name, year, excerpt of 220 characters; one at random if a seed is given.

    The year is the metadata's (JSON text) if it is a whole number, else null, as without metadata.
    """
    df = blocks.where(F.col("type") == "case_opinion")
    df = df if start is None else df.where(F.col("source_page") >= start)
    df = df if end is None else df.where(F.col("source_page") <= end)
    flat = F.trim(F.translate("markdown", "\n", " "))
    excerpt = F.when(F.length(flat) > 220, F.concat(F.left(flat, F.lit(220)), F.lit("…"))).otherwise(flat)
    year = F.get_json_object("metadata", "$.year") if "metadata" in blocks.columns else F.lit(None).cast("string")
    year = F.when(year.rlike("^-?[0-9]{1,9}$"), year.cast("int"))
    df = df.select("id", "book_id", *READING, F.coalesce(F.nullif(F.trim("case_name"), F.lit("")), F.lit("Untitled case")).alias("case_name"), year.alias("year"), excerpt.alias("excerpt"))
    return df if seed is None else df.orderBy(F.rand(seed)).limit(1)


def first_opinion(blocks: DataFrame, q: PageRange) -> DataFrame:
    return page_range(blocks, q).where(F.col("type") == "case_opinion").orderBy(*READING, "id").limit(1)


def page_offsets(starts: Column, offset: Column) -> Column:
    """The page, from 1, on which a character offset lies, given the pages' start offsets."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= offset)), F.lit(1))


def _closest(k: int):
    def find(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The k rows of one block of vectors that are nearest to each query of one block; ties by id."""
        kinds = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
        if not queries.num_rows or not vectors.num_rows:
            return kinds.empty_table()
        # vectors of one length lie one after another
        wide = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        q, v = wide(queries), wide(vectors)
        qid, vid = queries["vec_id"].to_numpy(), vectors["vec_id"].to_numpy()
        order = np.argsort(vid, kind="stable")
        v, vid = v[order], vid[order]
        q_size, v_size = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        out = []
        for at in range(0, len(q), AT_ONCE):
            some, own = q[at : at + AT_ONCE], qid[at : at + AT_ONCE]
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round(some @ v.T / (q_size[at : at + AT_ONCE, None] * v_size[None, :]), 6)
            score[(own[:, None] == vid[None, :]) | np.isnan(score)] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(score, best, axis=1)
            rows, cols = np.nonzero(np.isfinite(found))
            out.append(pa.table([pa.array(own[rows]), pa.array(vid[best[rows, cols]]), pa.array(found[rows, cols])], schema=kinds))
        return pa.concat_tables(out)

    return find


def nearest(vectors: DataFrame, query: DataFrame, k: int = 10, rows: int = 4096) -> DataFrame:
    """An extension: (qid, id, cosine, rank), the k vectors of greatest cosine to each query vector, itself apart.

    Both sides are dealt into blocks of about ``rows`` rows. A task multiplies one block of queries with one of vectors and
    keeps k rows a query, so no side is broadcast or gathered whole. Vectors of length 0 are near to none.
    """
    ship(vectors.sparkSession)
    blocks = lambda df: max(1, -(-df.count() // rows))
    n_q, n_v = blocks(query), blocks(vectors)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = query.where("embedding IS NOT NULL").select("vec_id", "embedding", own(n_q).alias("qb"), every(n_v).alias("vb"))
    v = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", own(n_v).alias("vb"), every(n_q).alias("qb"))
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(_closest(k), "qid long, id long, cosine double")
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def case_of(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(asked, block_id, problem): the opinion of each asked id and what trails it; a problem if the id is no opinion's."""
    kinds = asked.join(blocks.select(F.col("id").alias("asked"), "type"), "asked", "left")
    problem = F.when(F.col("type").isNull(), "missing").when(F.col("type") != "case_opinion", F.concat(F.lit("type is "), "type"))
    trails = case_trails(blocks).select(F.col("opinion_id").alias("asked"), F.col("id").alias("block_id"))
    return kinds.withColumn("problem", problem).drop("type").join(trails, "asked", "left")


@dataclass(frozen=True)
class CaseReference:
    """``book_id`` may be None: the first opinion of the name in any book."""

    book_id: object
    name: str


@dataclass(frozen=True)
class AssignmentCode:
    corpus_id: object
    code: str


@dataclass(frozen=True)
class Semantic:
    """The vectors nearest to one; where blocks have none, nothing is found."""

    embedding: tuple[float, ...]
    top_k: int = 10


def _columns(query) -> dict:
    if isinstance(query, PageRange):
        return {"kind": "page_range", "book_id": query.book_id, "start": query.start, "end": query.end}
    if isinstance(query, CaseReference):
        return {"kind": "case_reference", "book_id": query.book_id, "case_name": query.name}
    if isinstance(query, AssignmentCode):
        return {"kind": "assignment_code", "corpus_id": query.corpus_id, "code": query.code}
    if isinstance(query, Semantic):
        return {"kind": "semantic"}
    raise TypeError(f"unknown query: {type(query).__name__}")


REQUEST = ("request", "kind", "book_id", "start", "end", "case_name", "corpus_id", "code")


def answers(requests: DataFrame, blocks: DataFrame, books: DataFrame, entries: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(request, id) of the blocks that many typed requests ask for, and (request, note) of those that find nothing.

    ``requests``: REQUEST. A page range gives its blocks; a case the first opinion of equal name in the book, or in any
    book if none is named, and what trails it; an assignment the blocks of its page ranges in the corpus's oldest book, by
    the newest entry (``entries``: corpus_id, code, ranges); ``near`` (request, id, rank) are the blocks of semantic requests.
    """
    of = lambda kind: requests.where(F.col("kind") == kind)
    spans = store.spans(of("page_range").select("request", "book_id", "start", "end"), blocks).select("request", "id")
    trails = case_trails(blocks).withColumn("_case", equal_name(F.col("case_name")))
    named = trails.where("type = 'case_opinion'").select(F.col("book_id").alias("_book"), "_case", "opinion_id", *READING)
    asked = of("case_reference").select("request", "book_id", equal_name(F.col("case_name")).alias("_asked"))
    # the first of each name, in a book and in all, is found before requests meet it: as many rows as names, not requests times opinions
    order = F.struct("_book", *READING, "opinion_id")
    in_book = named.groupBy("_book", "_case").agg(F.min(order).alias("_first"))
    anywhere = in_book.groupBy("_case").agg(F.min("_first").alias("_first"))
    one = asked.where("book_id IS NOT NULL").join(in_book, (F.col("_case") == F.col("_asked")) & (F.col("book_id") == F.col("_book")))
    every = asked.where("book_id IS NULL").join(anywhere, F.col("_case") == F.col("_asked"))
    first = one.select("request", "_first.opinion_id").unionByName(every.select("request", "_first.opinion_id"))
    cases = first.join(trails.select("opinion_id", "id"), "opinion_id").select("request", "id")
    codes = of("assignment_code").select("request", "corpus_id", "code").join(entries.select("corpus_id", "code", "ranges"), ["corpus_id", "code"])
    assigned = assignment_blocks(codes.select("corpus_id", F.col("request").alias("code"), "ranges"), blocks, books).select(F.col("code").alias("request"), "id")
    found = spans.unionByName(cases).unionByName(assigned)
    if near is not None:
        found = found.unionByName(of("semantic").select("request").join(near.select("request", "id"), "request"))
    note = (
        F.when(~F.col("kind").isin("page_range", "case_reference", "assignment_code", "semantic"), F.concat(F.lit("unknown query: "), "kind")).when(F.col("start") > F.col("end"), "start is after end")
        .when(F.col("kind") == "page_range", "no pages in this range").when(F.col("kind") == "case_reference", "no such case").when(F.col("kind") == "assignment_code", "no such assignment").otherwise("no vectors")
    )
    empty = requests.join(found.select("request").distinct(), "request", "left_anti").select("request", note.alias("note"))
    return found, empty


def retrieved(query, blocks: DataFrame, books: DataFrame | None = None, entries: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The blocks that one typed query asks for, in reading order (a semantic one in order of nearness); another type of query is an error."""
    spark, columns = blocks.sparkSession, _columns(query)
    if isinstance(query, PageRange):
        return page_range(blocks, query).orderBy(*READING, "id")
    if isinstance(query, CaseReference) and query.book_id is not None:
        return case_reference(blocks, query.book_id, query.name).orderBy(*READING, "id")
    if isinstance(query, Semantic):
        if vectors is None:
            return blocks.limit(0)
        one = spark.createDataFrame([(-1, list(query.embedding))], "vec_id long, embedding array<double>")
        close = nearest(vectors, one, query.top_k).select("id", "rank")
        return blocks.join(close, "id").orderBy("rank").drop("rank")
    kinds = {"book_id": blocks.schema["book_id"].dataType.simpleString(), "corpus_id": books.schema["corpus_id"].dataType.simpleString() if books is not None else "string"}
    row = spark.range(1).select(F.lit(0).alias("request"), *[F.lit(columns.get(c)).cast(kinds.get(c, "int" if c in ("start", "end") else "string")).alias(c) for c in REQUEST[1:]])
    if isinstance(query, AssignmentCode) and (books is None or entries is None):
        raise ValueError("an assignment needs the books and the entries")
    none = spark.createDataFrame([], f"id {kinds['book_id']}, corpus_id {kinds['corpus_id']}, ingested_at timestamp") if books is None else books
    listed = spark.createDataFrame([], f"corpus_id {kinds['corpus_id']}, code string, ranges array<struct<start:int,end:int>>") if entries is None else entries
    found = answers(row, blocks, none, listed)[0]
    return blocks.join(found.select("id"), "id", "left_semi").orderBy("book_id", *READING, "id")
