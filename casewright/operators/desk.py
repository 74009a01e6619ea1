"""Listings, lookups, labels and landings around a corpus's records. Nested payloads are JSON texts, read as variants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import schema as json_schema
from casewright.functions.session import ship
from casewright.operators.retrieve import as_of

# Where a title may stand, the label keys of a search hit, the fields of a profile that may be edited, providers.
TITLE_KEYS = ["case_name", "topic", "doctrinal_area", "course", "title", "question_label"]
NESTED_KEYS = [f"{k}.{s}" for k in ("hypo", "synthesis", "rubric") for s in ("title", "topic", "case_name")]
LABEL_KEYS = ["case_name", "question_label", "topic", "doctrinal_area", "course"]
EDITABLE = ["course", "school", "exam_format", "pet_peeves", "favored_framings", "stable_traps", "voice_conventions", "commonly_tested", "source_artifact_paths"]
PROVIDERS = ["anthropic", "voyage"]

# -- payloads -------------------------------------------------------------------------------------------


def text_at(payload: Column, path: str) -> Column:
    """The text at a path of a variant, trimmed; null where there is none, another type or blanks only."""
    found = F.try_variant_get(payload, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.trim(F.try_variant_get(payload, f"$.{path}", "string")), F.lit("")))


def title(payload: Column, kind: Column, id_: Column) -> Column:
    """An artifact's title: the first text under its keys, then one level deeper, else kind and id."""
    return F.coalesce(*[text_at(payload, k) for k in (*TITLE_KEYS, *NESTED_KEYS)], F.concat(kind, F.lit(" · "), F.left(id_.cast("string"), F.lit(8))))


def flat_text(content: Column) -> Column:
    """All texts inside a JSON text, at any depth, in order, one a line; empty where it is no JSON. Walked in Arrow batches."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        import json

        def one(text: str | None) -> str:
            try:
                nodes, out = [json.loads(text or "null")], []
            except ValueError:
                return ""
            while nodes:
                x = nodes.pop()
                if isinstance(x, str):
                    out.append(x)
                elif isinstance(x, dict | list):
                    nodes.extend(reversed(list(x.values()) if isinstance(x, dict) else x))
            return "\n".join(out)

        return texts.map(one)

    return walk(content)


# -- labels of search hits ------------------------------------------------------------------------------


def artifact_label(payload: Column, kind: Column, id_: Column) -> Column:
    """Kind in title case and the first label that is there."""
    first = F.coalesce(*[F.nullif(F.try_variant_get(payload, f"$.{k}", "string"), F.lit("")) for k in LABEL_KEYS], F.left(id_.cast("string"), F.lit(8)))
    return F.concat(F.initcap(F.translate(kind, "_", " ")), F.lit(": "), first)


def block_label(blocks: DataFrame, toc: DataFrame, books: DataFrame) -> DataFrame:
    """Blocks with ``label``: book, the last contents entry at or before the page, page."""
    df = as_of(blocks, toc.select("book_id", "source_page", F.col("title").alias("_entry"), "order_index"), ["book_id"], "source_page", "_entry", ["order_index"])
    df = df.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("_book")), "book_id", "left")
    return df.withColumn("label", F.concat_ws(" — ", F.coalesce("_book", F.lit("Unknown book")), "_entry", F.concat(F.lit("p. "), F.col("source_page").cast("string")))).drop("_entry", "_book")


def segment_label(segments: DataFrame, transcripts: DataFrame, corpus=None) -> DataFrame:
    """The segments of known transcripts (of a corpus) with ``label``: topic or assignment, turn and speaker."""
    mine = transcripts if corpus is None else transcripts.where(F.col("corpus_id") == corpus)
    known = mine.select(F.col("id").alias("transcript_id"), "topic", "assignment_code")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    label = F.concat(F.coalesce(given("topic"), given("assignment_code"), F.lit("Transcript")), F.lit(" — turn "), F.col("order_index").cast("string"), F.lit(" ("), "speaker", F.lit(")"))
    return segments.join(known, "transcript_id").withColumn("label", label).drop("topic", "assignment_code")


# -- listings and lookups -------------------------------------------------------------------------------


def newest(rows: DataFrame, at: str, limit: int | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the values given, newest first, then by id from the greatest, with their place from 1."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    if limit is not None:
        rows = rows.orderBy(F.desc(at), F.desc("id")).limit(limit)
    keys = list(equal) or [F.lit(0)]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("id"))))


def placed(rows: DataFrame, key: str, *by: Column) -> DataFrame:
    """Rows with their place from 1 inside each key, in the order given: reading order, turns, scores."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by)))


def looked_up(wanted: DataFrame, rows: DataFrame, kind: str | None = None, corpus: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each wanted id (with the corpus that asks) and ``problem``: missing, another type, another corpus, or null.

    ``carried`` are columns of the rows that come along, so that what is found need not be joined again.
    """
    held = rows.select("id", F.col("type").alias("_type"), F.col("corpus_id").alias("_corpus"), *carried)
    problem = F.when(F.col("_type").isNull(), "missing")
    problem = problem if kind is None else problem.when(F.col("_type") != kind, "another type")
    problem = problem if corpus is None else problem.when(~F.col("_corpus").eqNullSafe(F.col(corpus)), "another corpus")
    return wanted.join(held, "id", "left").withColumn("problem", problem).drop("_type", "_corpus")


def chosen_retrieval(start: Column, end: Column, case_name: Column, code: Column) -> Column:
    """Which retrieval a request asks for: a page range before a case before an assignment; else an error text."""
    return F.when(start.isNotNull() & end.isNotNull(), "page_range").when(case_name.isNotNull(), "case_reference").when(code.isNotNull(), "assignment_code").otherwise("error: no page range, case or assignment")


def provider(value: Column) -> Column:
    """A known provider in lower case, else null."""
    return F.when(F.lower(value).isin(PROVIDERS), F.lower(value))


def moment(text: Column) -> Column:
    """An ISO time as a timestamp: Z and offsets are read, times without one are UTC, fractions that don't parse are left out."""
    zoned = lambda t: F.when(t.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.coalesce(F.try_to_timestamp(zoned(text)), F.try_to_timestamp(zoned(F.substring_index(text, ".", 1))))


def lineage_sources(artifacts: DataFrame, chains: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, cited_blocks, cited_segments, missing): sources of the artifact itself, and those of its whole chain that don't exist.

    ``chains``: id, ancestor; ``sources``: artifact_id, kind, ref, found.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    own = sources.groupBy(F.col("artifact_id").alias("id")).agg(kind("block").alias("cited_blocks"), kind("transcript_segment").alias("cited_segments"))
    gone = sources.where("NOT found").select(F.col("artifact_id").alias("ancestor"), "ref").distinct()
    missing = chains.join(gone, "ancestor").groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("missing"))
    out = artifacts.select("id").join(own, "id", "left").join(missing, "id", "left").fillna(0, ["cited_blocks", "cited_segments"])
    return out.withColumn("missing", F.coalesce("missing", F.array().cast(out.schema["missing"].dataType)))


def emphasis_prompts(rows: DataFrame) -> DataFrame:
    """(transcript_id, items): a transcript's subjects by score from the highest, then label, as structs for a prompt."""
    one = F.struct((-F.col("score")).alias("_o"), "label", "kind", "score", "justification")
    items = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["kind"].alias("subject_kind"), x["label"].alias("subject_label"), x["score"].alias("exam_signal_score"), x["justification"].alias("justification")))
    return rows.groupBy("transcript_id").agg(items.alias("items"))


#: What of a profile its schema speaks of.
PROFILE_PAYLOAD = ["professor_name", *EDITABLE]
PROFILE = ["id", "professor_name", "course", "school", "exam_format", "pet_peeves", "favored_framings", "stable_traps", "voice_conventions", "commonly_tested"]


def profile_struct() -> Column:
    """A profile as prompts read it; absent lists are empty."""
    empty = F.array().cast("array<string>")
    return F.struct(*[F.col(c) if c in PROFILE[:5] else F.coalesce(c, empty).alias(c) for c in PROFILE])


def edited(profiles: DataFrame, edits: DataFrame, schema: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles after the edits (id, field, value), and (id, problem) of refused ones.

    All edits of a profile are refused if one names a field that may not change, asks for an unknown profile, or leaves a
    profile that breaks ``schema``. Values are JSON texts where the field is no text, a null one empties the field; one that
    doesn't read as the field's type is refused too.
    """
    asked = edits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("e"))
    wrong = F.array_sort(F.array_except(F.map_keys("e"), F.array(*[F.lit(f) for f in EDITABLE])))
    fields = {f.name: f.dataType for f in profiles.schema.fields if f.name in EDITABLE}
    said = lambda c: F.try_element_at("e", F.lit(c))
    typed = {c: said(c) if t.typeName() == "string" else F.from_json(said(c), t) for c, t in fields.items()}
    given = {c: F.map_contains_key("e", F.lit(c)) for c in fields}
    judged = asked.join(profiles.withColumn("_p", F.lit(True)), "id", "left").withColumn("_wrong", wrong)
    judged = judged.withColumns({c: F.when(given[c], typed[c]).otherwise(F.col(c)) for c in fields})
    unread = F.array_compact(F.array(*[F.when(given[c] & said(c).isNotNull() & (F.try_parse_json(said(c)).isNull() | F.col(c).isNull()), F.lit(c)) for c, t in fields.items() if t.typeName() != "string"], F.lit(None).cast("string")))
    # the payload as JSON: what was said as it was said, the rest as it is
    plain = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    parts = [F.concat(F.lit(f'"{c}":'), F.when(given[c], F.coalesce(said(c), F.lit("null"))).otherwise(plain(c)) if c in fields and fields[c].typeName() != "string" else plain(c)) for c in profiles.columns if c in PROFILE_PAYLOAD]
    payload = F.try_parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    broken = json_schema.problems(payload, schema) if schema else F.array().cast("array<string>")
    problem = (
        F.when(F.col("_p").isNull(), "profile not found").when(F.size("_wrong") > 0, F.concat(F.lit("cannot edit protected fields: "), F.array_join("_wrong", ", ")))
        .when(F.size(unread) > 0, F.concat(F.lit("cannot read: "), F.array_join(unread, ", "))).when(F.size(broken) > 0, F.array_join(broken, "; "))
    )
    judged = judged.withColumn("problem", problem)
    good = judged.where("problem IS NULL").select("id", F.struct(F.lit(1).alias("_"), *fields).alias("_new"))
    new = profiles.join(good, "id", "left").withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields})
    return new.select(*profiles.columns), judged.where("problem IS NOT NULL").select("id", "problem")


# -- landings and chats ---------------------------------------------------------------------------------


def landed(uploads: DataFrame) -> DataFrame:
    """Past exams and their memos (id, exam, memo, year) as artifacts: id, type, parent_artifact_id, content; a memo points to its exam."""
    exam_id = F.sha2(F.concat(F.lit("past_exam|"), F.col("id").cast("string")), 256)
    memo_id = F.sha2(F.concat(F.lit("grader_memo|"), F.col("id").cast("string")), 256)
    exam = uploads.select(exam_id.alias("id"), F.lit("past_exam").alias("type"), F.lit(None).cast("string").alias("parent_artifact_id"), F.to_json(F.struct(F.col("exam").alias("markdown"), "year")).alias("content"))
    tied = F.to_json(F.struct(F.col("memo").alias("markdown"), exam_id.alias("tied_to_past_exam"), "year"))
    memo = uploads.where("memo IS NOT NULL").select(memo_id.alias("id"), F.lit("grader_memo").alias("type"), exam_id.alias("parent_artifact_id"), tied.alias("content"))
    return exam.unionByName(memo)


def answered(answers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Practice answers (id, markdown, grade_id) as artifacts, and the artifacts with each grade's parent set to its answer."""
    new = answers.select(F.sha2(F.concat(F.lit("practice_answer|"), F.col("id").cast("string")), 256).alias("id"), F.lit("practice_answer").alias("type"), F.lit(None).cast("string").alias("parent_artifact_id"), "grade_id")
    links = new.select(F.col("grade_id").alias("id"), F.col("id").alias("_parent"))
    old = artifacts.join(links, "id", "left").withColumn("parent_artifact_id", F.coalesce("_parent", "parent_artifact_id")).select("id", "type", "parent_artifact_id")
    return old.unionByName(new.drop("grade_id"))


def appended(history: DataFrame, new: DataFrame) -> DataFrame:
    """Turns (chat_id, turn, role, content, at): the new ones of each chat are numbered on from its last, in order of time."""
    last = history.groupBy("chat_id").agg(F.max("turn").alias("_last"))
    order = F.row_number().over(Window.partitionBy("chat_id").orderBy("at", "role", "content"))
    more = new.join(last, "chat_id", "left").withColumn("turn", order + F.coalesce("_last", F.lit(0))).drop("_last")
    return history.unionByName(more.select(*history.columns))


#: A chat's type by its mode.
CHATS = {"socratic": "socratic_drill", "cold_call": "cold_call_session"}


def opened(requests: DataFrame, artifacts: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(request, id, type, case_block_id, mode, turns) of the chats that requests go on with or begin, the new artifacts, and (request, problem).

    ``requests``: request, corpus_id, case_block_id, mode, existing_id; ``artifacts``: id, corpus_id, type, content. A request that
    names a chat loads it from its content, whatever else it says; one that names none begins a chat, whose id derives from the request.
    """
    kinds = list(CHATS.values())
    old = artifacts.select(F.col("id").alias("existing_id"), F.col("type").alias("_type"), F.col("content").alias("_content"))
    asked = requests.join(old, "existing_id", "left")
    problem = F.when(F.col("existing_id").isNull(), F.when(~F.col("mode").isin(*CHATS), F.concat(F.lit("unknown mode: "), "mode"))).when(F.col("_type").isNull(), "chat not found").when(~F.col("_type").isin(kinds), F.concat(F.lit("not a chat: "), "_type"))
    asked = asked.withColumn("problem", problem)
    good = asked.where("problem IS NULL")
    at = lambda k: F.get_json_object("_content", f"$.{k}")
    own = lambda c: F.sha2(F.concat(F.lit("chat|"), F.col(c).cast("string")), 256)
    turns = F.coalesce(F.size(F.from_json(at("history"), "array<string>")), F.lit(0))
    loaded = good.where("existing_id IS NOT NULL").select("request", F.col("existing_id").alias("id"), F.col("_type").alias("type"), at("case_block_id").alias("case_block_id"), F.coalesce(at("mode"), F.lit("socratic")).alias("mode"), turns.alias("turns"))
    fresh = good.where("existing_id IS NULL")
    kind = F.when(F.col("mode") == "socratic", CHATS["socratic"]).otherwise(CHATS["cold_call"])
    began = fresh.select("request", own("request").alias("id"), kind.alias("type"), F.col("case_block_id").cast("string"), "mode", F.lit(0).alias("turns"))
    state = F.to_json(F.struct(F.col("case_block_id").cast("string"), F.array().cast("array<string>").alias("history"), "mode", F.lit(now).alias("started_at")))
    sources = F.to_json(F.array(F.struct(F.lit("block").alias("kind"), F.col("case_block_id").cast("string").alias("id"))))
    new = fresh.select(own("request").alias("id"), "corpus_id", kind.alias("type"), state.alias("content"), sources.alias("sources"))
    return loaded.unionByName(began), new, asked.where("problem IS NOT NULL").select("request", "problem")


def closed(chats: DataFrame, turns: DataFrame, asked: DataFrame) -> DataFrame:
    """Chats (id, ended_at) with the asked ones closed at the given time, unless they are already, and their history as roles and contents."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    history = turns.groupBy(F.col("chat_id").alias("id")).agg(said.alias("history"))
    df = chats.join(asked.select("id", F.col("at").alias("_at")), "id", "left").join(history, "id", "left")
    return df.withColumn("ended_at", F.coalesce("ended_at", "_at")).drop("_at")


def ordered_union(first: Column, second: Column) -> Column:
    """The entries of both lists in order, each once."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def verified(requests: DataFrame, profiles: dict[str, DataFrame]) -> DataFrame:
    """(artifact_id, profile, errors, warnings, passed): each request's issues under its profile; an unknown profile is an error.

    ``profiles``: issues (artifact_id, severity) by profile name, over all artifacts.
    """
    parts = [issues.select("artifact_id", F.lit(name).alias("profile"), "severity") for name, issues in profiles.items()]
    unknown = requests.where(~F.col("profile").isin(list(profiles))).select("artifact_id", "profile", F.lit("error").alias("severity"))
    for p in parts:
        unknown = unknown.unionByName(p)
    counts = unknown.groupBy("artifact_id", "profile").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = requests.select("artifact_id", "profile").join(counts, ["artifact_id", "profile"], "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("passed", F.col("errors") == 0)
