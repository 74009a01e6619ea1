"""Registered queries over listings, lookups, labels, landings and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import desk, ingest, profiles, retrieve, study, verify
from casewright.plans.queries import query
from casewright.sources.views import table, view, with_views

_text = lambda c: F.col(c).cast("string")

# -- payloads and labels --------------------------------------------------------------------------------

_CONTENT = """CASE doc_id % 6 WHEN 0 THEN concat('{"case_name": " Case ', CAST(doc_id AS VARCHAR(20)), ' "}') WHEN 1 THEN concat('{"case_name": 5, "topic": "T', CAST(doc_id AS VARCHAR(20)), '"}')
    WHEN 2 THEN concat('{"hypo": {"title": " ", "topic": "H', CAST(doc_id AS VARCHAR(20)), '"}}') WHEN 3 THEN concat('{"question_label": "Q', CAST(doc_id AS VARCHAR(20)), '"}') WHEN 4 THEN '{}'
    ELSE concat('{"course": "", "title": "X', CAST(doc_id AS VARCHAR(20)), '"}') END"""
_ID = "left(CAST(doc_id AS VARCHAR), 8)"


@query(
    "artifact_labels",
    f"""SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('Case ', doc_id) WHEN 1 THEN concat('T', doc_id) WHEN 2 THEN concat('H', doc_id) WHEN 3 THEN concat('Q', doc_id) WHEN 4 THEN concat('case_brief · ', {_ID}) ELSE concat('X', doc_id) END AS title,
    concat('Case Brief: ', CASE doc_id % 6 WHEN 0 THEN concat(' Case ', doc_id, ' ') WHEN 1 THEN '5' WHEN 3 THEN concat('Q', doc_id) ELSE {_ID} END) AS label FROM documents""",
)
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.parse_json(F.expr(_CONTENT.replace("VARCHAR(20)", "STRING"))).alias("p"))
    kind = F.lit("case_brief")
    return rows.select("id", desk.title(F.col("p"), kind, F.col("id")).alias("title"), desk.artifact_label(F.col("p"), kind, F.col("id")).alias("label"))


@query("flat_texts", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('x', doc_id, chr(10), 'y', chr(10), 'z') END AS flat FROM documents")
def _(spark, d):
    content = F.when(F.col("doc_id") % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"a": ["x'), _text("doc_id"), F.lit('", {"b": "y"}], "n": 3, "c": null, "d": {"e": {"f": [["z"]]}}}')))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), desk.flat_text(content).alias("flat"))


@query(
    "block_labels",
    with_views("block", "section") + """SELECT b.id, concat(CASE WHEN b.book_id % 5 = 0 THEN 'Unknown book' ELSE concat('Book ', b.book_id) END, coalesce(' — ' || s.title, ''), ' — p. ', b.source_page) AS label
    FROM block b ASOF LEFT JOIN section s ON b.book_id = s.book_id AND b.source_page >= s.source_page""",
)
def _(spark, d):
    books = view(spark, d, "book").where("id % 5 <> 0").select("id", F.concat(F.lit("Book "), _text("id")).alias("title"))
    toc = view(spark, d, "section").withColumn("order_index", F.lit(0))
    return desk.block_label(view(spark, d, "block").select("id", "book_id", "source_page"), toc, books).select("id", "label")


_TRANSCRIPTS = "SELECT conv_id AS id, conv_id % 2 AS corpus_id, CASE WHEN conv_id % 3 = 0 THEN concat('Topic ', CAST(conv_id AS VARCHAR(20))) END AS topic, CASE WHEN conv_id % 3 = 1 THEN 'A7' ELSE '' END AS assignment_code FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id"


@query(
    "segment_labels",
    with_views("segment") + f", t AS ({_TRANSCRIPTS}) SELECT transcript_id, order_index, concat(coalesce(topic, nullif(assignment_code, ''), 'Transcript'), ' — turn ', order_index, ' (', speaker, ')') AS label FROM segment JOIN t ON id = transcript_id WHERE corpus_id = 1",
)
def _(spark, d):
    transcripts = spark.sql(_TRANSCRIPTS.replace("VARCHAR(20)", "STRING").replace("FROM conversations", "FROM {c}"), c=table(spark, d, "conversations"))
    return desk.segment_label(view(spark, d, "segment"), transcripts, 1).select("transcript_id", "order_index", "label")


# -- listings and lookups -------------------------------------------------------------------------------


@query("newest_artifacts", with_views("artifact") + "SELECT id, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM artifact WHERE corpus_id = 5")
def _(spark, d):
    return desk.newest(view(spark, d, "artifact"), "created_at", corpus_id=5).select("id", "place")


@query("reading_order", with_views("block") + "SELECT id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY source_page, order_index, id) AS INTEGER) AS place FROM block")
def _(spark, d):
    return desk.placed(view(spark, d, "block"), "book_id", F.col("source_page"), F.col("order_index"), F.col("id")).select("id", "place")


@query("ranked_emphasis", "SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars % 50 DESC, doc_id) AS INTEGER) AS place FROM documents")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") % 50).alias("score"))
    return desk.placed(rows, "source", F.desc("score"), F.col("id")).select("id", "place")


@query(
    "looked_up",
    with_views("artifact") + """, w AS (SELECT DISTINCT l_orderkey + 2 * (l_partkey % 3) AS id, l_suppkey % 9 AS asks FROM lineitem)
    SELECT w.id, asks, CASE WHEN a.id IS NULL THEN 'missing' WHEN type <> 'flashcards' THEN 'another type' WHEN corpus_id % 9 <> asks THEN 'another corpus' END AS problem FROM w LEFT JOIN artifact a USING (id)""",
)
def _(spark, d):
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") + 2 * (F.col("l_partkey") % 3)).alias("id"), (F.col("l_suppkey") % 9).alias("asks")).distinct()
    rows = view(spark, d, "artifact").withColumn("corpus_id", F.col("corpus_id") % 9)
    return desk.looked_up(wanted, rows, "flashcards", "asks").select("id", "asks", "problem")


@query(
    "retrieval_choices",
    "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber < 3 THEN 'page_range' WHEN l_partkey % 2 = 0 THEN 'case_reference' WHEN l_suppkey % 2 = 0 THEN 'assignment_code' ELSE 'error: no page range, case or assignment' END AS chosen FROM lineitem",
)
def _(spark, d):
    when = lambda c, v: F.when(F.expr(c), v)
    chosen = desk.chosen_retrieval(when("l_linenumber < 5", 1), when("l_linenumber < 3", 2), when("l_partkey % 2 = 0", "a v. b"), when("l_suppkey % 2 = 0", "A"))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), chosen.alias("chosen"))


@query(
    "case_of_opinion",
    with_views("block") + """, n AS (SELECT *, sum(CASE WHEN type IN ('case_header', 'case_opinion') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY source_page, order_index, id) AS c FROM block),
    t AS (SELECT *, max(CASE WHEN type = 'case_opinion' THEN id END) OVER (PARTITION BY book_id, c) AS opinion_id FROM n), w AS (SELECT id AS asked FROM block WHERE source_page <= 2)
    SELECT asked, t.id AS block_id, CASE WHEN b.type <> 'case_opinion' THEN concat('type is ', b.type) END AS problem FROM w JOIN block b ON b.id = asked LEFT JOIN t ON t.opinion_id = asked""",
)
def _(spark, d):
    blocks = view(spark, d, "block")
    return retrieve.case_of(blocks.where("source_page <= 2").select(F.col("id").alias("asked")), blocks).select("asked", "block_id", "problem")


@query(
    "call_moments",
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN NULL ELSE epoch(o_orderdate::timestamp)::bigint + CASE o_orderkey % 6 WHEN 3 THEN 30600 ELSE 36000 END END AS at, CASE WHEN o_orderkey % 3 < 2 THEN 'anthropic' END AS provider FROM orders""",
)
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = ["T10:00:00Z", " 10:00:00", "T10:00:00.123456789123Z", "T10:00:00+01:30", "T25:00:00", "T10:00:00.5"]
    raw = F.concat(day, F.element_at(F.array(*[F.lit(x) for x in forms]), F.expr("int(o_orderkey % 6 + 1)")))
    named = F.element_at(F.array(F.lit("Anthropic"), F.lit("ANTHROPIC"), F.lit("other")), F.expr("int(o_orderkey % 3 + 1)"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(desk.moment(raw)).alias("at"), desk.provider(named).alias("provider"))


@query(
    "lineage_sources",
    with_views("artifact", "block") + """, s AS (SELECT l_orderkey AS artifact_id, 'block' AS kind, CASE WHEN l_partkey % 11 = 0 THEN -l_linenumber ELSE (l_orderkey * 10 + l_linenumber) * 1000 END AS ref FROM lineitem WHERE l_linenumber % 2 = 1),
    g AS (SELECT DISTINCT artifact_id, ref FROM s WHERE ref NOT IN (SELECT id FROM block)), own AS (SELECT artifact_id, count(*) AS n FROM s GROUP BY 1),
    m AS (SELECT a.id, list_sort(list_distinct(list(g.ref))) AS missing FROM artifact a JOIN g ON g.artifact_id = a.id OR g.artifact_id = a.parent_id GROUP BY 1)
    SELECT artifact.id, coalesce(n, 0) AS cited_blocks, CAST(0 AS BIGINT) AS cited_segments, coalesce(array_to_string(missing, ','), '') AS missing FROM artifact LEFT JOIN own ON artifact_id = artifact.id LEFT JOIN m ON m.id = artifact.id""",
)
def _(spark, d):
    artifacts = view(spark, d, "artifact")
    refs = view(spark, d, "reference").where("l_linenumber % 2 = 1").select("artifact_id", F.lit("block").alias("kind"), "ref")
    found = study.source_summary(refs, view(spark, d, "block").select("id"), view(spark, d, "block").where(F.lit(False)).select("id"))
    own = artifacts.select("id", F.col("id").alias("ancestor"))
    chain = own.unionByName(artifacts.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor")))
    return desk.lineage_sources(artifacts, chain, found).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


# -- profiles and prompts -------------------------------------------------------------------------------

_PROFILES = "SELECT c_custkey AS id, c_name AS professor_name, c_mktsegment AS course, CAST(NULL AS VARCHAR(20)) AS school FROM customer"


@query(
    "edited_profiles",
    f"""WITH p AS ({_PROFILES}) SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 4 = 1 THEN concat('new ', id) ELSE course END AS course, CASE WHEN id % 4 = 1 THEN 'S' END AS school, NULL AS problem FROM p
    UNION ALL SELECT CAST(id AS VARCHAR), NULL, NULL, 'cannot edit protected fields: id, professor_name' FROM p WHERE id % 4 = 2 UNION ALL SELECT concat('x', id), NULL, NULL, 'profile not found' FROM p WHERE id % 4 = 3""",
)
def _(spark, d):
    profiles = spark.sql(_PROFILES.replace("VARCHAR(20)", "STRING").replace("FROM customer", "FROM {c}"), c=table(spark, d, "customer"))
    edit = lambda where, id_, field, value: profiles.where(where).select(id_.alias("id"), F.lit(field).alias("field"), value.alias("value"))
    own = _text("id")
    edits = edit("id % 4 = 1", own, "course", F.concat(F.lit("new "), own)).unionByName(edit("id % 4 = 1", own, "school", F.lit("S")))
    for field in ("professor_name", "id", "course"):
        edits = edits.unionByName(edit("id % 4 = 2", own, field, F.lit("v")))
    edits = edits.unionByName(edit("id % 4 = 3", F.concat(F.lit("x"), own), "course", F.lit("v")))
    new, refused = desk.edited(profiles.withColumn("id", own), edits)
    return new.select("id", "course", "school", F.lit(None).cast("string").alias("problem")).unionByName(refused.select("id", F.lit(None).cast("string").alias("course"), F.lit(None).cast("string").alias("school"), "problem"))


_PROFILE_SCHEMA = {
    "type": "object", "required": ["professor_name", "course", "exam_format", "pet_peeves"], "$defs": {"Part": {"type": "object", "required": ["part"], "properties": {"part": {"enum": ["I", "II"]}, "weight": {"type": "number", "maximum": 1}}}},
    "properties": {
        "professor_name": {"type": "string"}, "course": {"type": "string", "minLength": 1}, "school": {"type": ["string", "null"]}, "pet_peeves": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]"}},
        "exam_format": {"type": "object", "required": ["duration_hours"], "properties": {"duration_hours": {"type": "number", "minimum": 0}, "structure": {"type": ["array", "null"], "items": {"$ref": "#/$defs/Part"}}}},
    },
}


@query(
    "refused_edits",
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 8 AS k FROM customer)
    SELECT id, CASE k WHEN 1 THEN '- exam_format/duration_hours: under minimum 0; - exam_format/structure/1: lacks part; - exam_format/structure/1/weight: over maximum 1' WHEN 2 THEN '- course: under minLength 1' WHEN 3 THEN 'cannot read: pet_peeves'
        WHEN 4 THEN '- course: not of type string' WHEN 5 THEN 'cannot edit protected fields: professor_name' WHEN 6 THEN concat('- pet_peeves/', id % 2, ': not of the pattern') END AS problem,
        CASE WHEN k = 0 THEN concat('C', id) ELSE 'Torts' END AS course, CASE WHEN k = 0 THEN 4.5 ELSE 3.0 END AS hours, CASE WHEN k = 0 THEN 2 ELSE 1 END AS peeves FROM c""",
)
def _(spark, d):
    shape = "struct<duration_hours:double,structure:array<struct<part:string,weight:double>>>"
    id_, kind = F.col("c_custkey"), F.col("c_custkey") % 8
    profiles = table(spark, d, "customer").select(
        id_.alias("id"), F.col("c_name").alias("professor_name"), F.lit("Torts").alias("course"), F.lit(None).cast("string").alias("school"),
        F.from_json(F.lit('{"duration_hours": 3, "structure": [{"part": "I", "weight": 0.5}]}'), shape).alias("exam_format"), F.array(F.lit("vague rules")).alias("pet_peeves"),
    )
    edit = lambda k, field, value: table(spark, d, "customer").where(kind == k).select(id_.alias("id"), F.lit(field).alias("field"), value.cast("string").alias("value"))
    edits = edit(0, "course", F.concat(F.lit("C"), id_.cast("string"))).unionByName(edit(0, "exam_format", F.lit('{"duration_hours": 4.5}'))).unionByName(edit(0, "pet_peeves", F.lit('["one", "two"]')))
    edits = edits.unionByName(edit(1, "exam_format", F.lit('{"duration_hours": -1, "structure": [{"part": "II"}, {"weight": 2}]}'))).unionByName(edit(2, "course", F.lit(""))).unionByName(edit(3, "pet_peeves", F.lit("not a list")))
    peeves = F.when(id_ % 2 == 0, '["Upper", "lower"]').otherwise('["lower", "Upper"]')
    edits = edits.unionByName(edit(4, "course", F.lit(None))).unionByName(edit(5, "professor_name", F.lit("x"))).unionByName(edit(5, "course", F.lit("y"))).unionByName(edit(6, "pet_peeves", peeves))
    new, refused = desk.edited(profiles, edits, _PROFILE_SCHEMA)
    return new.join(refused, "id", "left").select("id", "problem", "course", F.col("exam_format.duration_hours").alias("hours"), F.size("pet_peeves").alias("peeves"))


@query(
    "emphasis_prompts",
    "SELECT source AS transcript_id, string_agg(concat('case:', doc_id, ':', n_chars % 50, ':', coalesce(lang, '')), ' ' ORDER BY n_chars % 50 DESC, CAST(doc_id AS VARCHAR)) AS items FROM documents WHERE source IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("transcript_id"), F.lit("case").alias("kind"), _text("doc_id").alias("label"), (F.col("n_chars") % 50).alias("score"), F.coalesce("lang", F.lit("")).alias("justification"))
    one = lambda x: F.concat_ws(":", x["subject_kind"], x["subject_label"], x["exam_signal_score"].cast("string"), x["justification"])
    return desk.emphasis_prompts(rows).select("transcript_id", F.array_join(F.transform("items", one), " ").alias("items"))


@query("merged_paths", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('a,b', o_custkey % 5, CASE WHEN o_custkey % 5 = 1 THEN '' ELSE ',b1' END) ELSE concat('b', o_custkey % 5, CASE WHEN o_custkey % 5 = 1 THEN '' ELSE ',b1' END) END AS paths FROM orders")
def _(spark, d):
    own = F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string"))
    first = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), own))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(desk.ordered_union(first, F.array(own, F.lit("b1"), own)), ",").alias("paths"))


# -- landings and chats ---------------------------------------------------------------------------------


@query(
    "landed_exams",
    """WITH u AS (SELECT doc_id, sha256(concat('past_exam|', doc_id)) AS e, sha256(concat('grader_memo|', doc_id)) AS m FROM documents)
    SELECT e AS id, 'past_exam' AS type, NULL AS parent_artifact_id, concat('{"markdown":"exam ', doc_id, '","year":', 2000 + doc_id % 20, '}') AS content FROM u
    UNION ALL SELECT m, 'grader_memo', e, concat('{"markdown":"memo ', doc_id, '","tied_to_past_exam":"', e, '","year":', 2000 + doc_id % 20, '}') FROM u WHERE doc_id % 3 = 0""",
)
def _(spark, d):
    named = lambda w: F.concat(F.lit(f"{w} "), _text("doc_id"))
    return desk.landed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), named("exam").alias("exam"), F.when(F.col("doc_id") % 3 == 0, named("memo")).alias("memo"), (F.lit(2000) + F.col("doc_id") % 20).alias("year")))


@query(
    "answered_grades",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'grade' AS type, CASE WHEN o_orderkey % 2 = 0 THEN sha256(concat('practice_answer|', o_orderkey)) END AS parent_artifact_id FROM orders
    UNION ALL SELECT sha256(concat('practice_answer|', o_orderkey)), 'practice_answer', NULL FROM orders WHERE o_orderkey % 2 = 0""",
)
def _(spark, d):
    grades = table(spark, d, "orders").select(_text("o_orderkey").alias("id"), F.lit("grade").alias("type"), F.lit(None).cast("string").alias("parent_artifact_id"))
    answers = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("text").alias("markdown"), _text("o_orderkey").alias("grade_id"))
    return desk.answered(answers, grades)


_TURNS = "SELECT conv_id AS chat_id, turn, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' AS at FROM conversations"


@query(
    "appended_turns",
    """WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0), n AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1), l AS (SELECT conv_id, max(turn) AS last FROM h GROUP BY 1)
    SELECT conv_id AS chat_id, turn, turn AS said FROM h UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + coalesce(last, 0), turn FROM n LEFT JOIN l USING (conv_id)""",
)
def _(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").cast("long").alias("turn"), "role", _text("turn").alias("content"), F.timestamp_seconds("turn").alias("at"))
    out = desk.appended(turns.where("turn % 2 = 0"), turns.where("turn % 2 = 1"))
    return out.select("chat_id", "turn", F.col("content").cast("long").alias("said"))


@query(
    "closed_chats",
    """WITH t AS (SELECT conv_id AS id, string_agg(concat(role, ':', length(text)), ' ' ORDER BY turn) AS history FROM conversations GROUP BY 1)
    SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' WHEN id % 3 = 1 THEN TIMESTAMP '2024-01-03 00:00:00' END AS ended_at, history FROM t""",
)
def _(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", "role", F.length("text").cast("string").alias("content"))
    time = lambda t: F.lit(f"2024-01-{t} 00:00:00").cast("timestamp_ntz")
    chats = turns.select(F.col("chat_id").alias("id")).distinct().withColumn("ended_at", F.when(F.col("id") % 3 == 0, time("02")))
    out = desk.closed(chats, turns, chats.where("id % 3 < 2").select("id", time("03").alias("at")))
    return out.withColumn("history", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), " "))


@query(
    "verified_artifacts",
    with_views("block", "reference") + """, m AS (SELECT artifact_id, count(*) AS n FROM (SELECT DISTINCT artifact_id, ref FROM reference WHERE ref NOT IN (SELECT id FROM block)) GROUP BY 1), s AS (SELECT l_orderkey AS id, count(*) < 3 AS few FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS artifact_id, profile, errors, warnings, errors = 0 AS passed FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'citation_grounding' WHEN 1 THEN 'rubric_shape' ELSE 'odd' END AS profile,
    CASE o_orderkey % 3 WHEN 0 THEN coalesce(n, 0) WHEN 1 THEN 0 ELSE 1 END AS errors, CAST(CASE WHEN o_orderkey % 3 = 1 AND few THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM orders LEFT JOIN m ON artifact_id = o_orderkey LEFT JOIN s ON s.id = o_orderkey)""",
)
def _(spark, d):
    refs = view(spark, d, "reference").select("artifact_id", "ref")
    shapes = verify.rubric_shape(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.lit(0.2).alias("weight"), F.lit("x").alias("label")))
    profiles = {
        "citation_grounding": verify.grounding(refs, refs, view(spark, d, "block")),
        "rubric_shape": shapes.where("NOT enough").select("artifact_id", F.lit("warning").alias("severity")),
    }
    kind = F.element_at(F.array(F.lit("citation_grounding"), F.lit("rubric_shape"), F.lit("odd")), F.expr("int(o_orderkey % 3 + 1)"))
    return desk.verified(table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), kind.alias("profile")), profiles)


@query(
    "verified_payloads",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS kind FROM orders)
    SELECT concat('a', k) AS artifact_id, CASE kind WHEN 0 THEN 'citation_grounding' WHEN 1 THEN 'rule_fidelity' WHEN 2 THEN 'rubric_coverage' WHEN 3 THEN 'issue_spotting_completeness' ELSE 'odd' END AS profile, errors, warnings, errors = 0 AS passed
    FROM (SELECT *, CAST(CASE kind WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END ELSE 1 END AS BIGINT) AS errors,
        CAST(CASE WHEN kind = 1 AND k % 3 = 2 THEN 1 WHEN kind = 2 AND k % 2 = 0 THEN 3 WHEN kind = 3 AND k % 3 <> 0 THEN 3 ELSE 0 END AS BIGINT) AS warnings FROM o)""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("kind"), F.col("o_orderkey").cast("string").alias("t"))
    put = lambda text: F.replace(F.lit(text), F.lit("#"), F.col("t"))
    rule = F.when(F.col("k") % 3 == 0, put('{"rule": {"text": "The words of block #", "source_block_ids": ["b#"]}}')).when(F.col("k") % 3 == 1, '{"rule": "text"}').otherwise(put('{"rule": {"text": "entirely different matter", "source_block_ids": ["b#", 5]}}'))
    hypo = F.when(F.col("k") % 3 == 0, '{"rubric": 5}').otherwise('{"rubric": {"required_issues": [{"label": "a", "weight": 0.5}, {"label": " ", "weight": 0.4}], "prompt_role": "clerk"}}')
    content = (
        F.when(F.col("kind") == 0, put('{"x": [{"source_block_ids": ["b#", "zz"]}], "sources": ["b#", {"kind": "page", "id": "p"}]}')).when(F.col("kind") == 1, rule)
        .when(F.col("kind") == 2, put('{"rubric_id": "r#", "per_rubric_scores": [{"rubric_item_id": "i1", "rubric_item_kind": "required_issue", "points_possible": 5}, {"rubric_item_id": "x", "points_possible": 0}, {"rubric_item_id": "c1", "rubric_item_kind": "required_rule"}, {"rubric_item_id": "i1", "points_possible": 0}, 7]}'))
        .when(F.col("kind") == 3, hypo)
    )
    types = F.element_at(F.array(*map(F.lit, ("case_brief", "case_brief", "grade", "hypo", "rubric"))), (F.col("kind") + 1).cast("int"))
    names = F.element_at(F.array(*map(F.lit, (*profiles.PROFILES, "odd"))), (F.col("kind") + 1).cast("int"))
    made = orders.select(F.concat(F.lit("a"), "t").alias("id"), types.alias("type"), content.alias("content"))
    rubric = '{"required_issues": [{"id": "i1"}], "required_rules": [{"id": "r1"}, {"id": "i1"}, {"id": 4}], "expected_counterarguments": [{"id": "c1"}]}'
    made = made.unionByName(orders.where("kind = 2 AND k % 2 = 0").select(F.concat(F.lit("r"), "t").alias("id"), F.lit("rubric").alias("type"), F.lit(rubric).alias("content")))
    blocks = orders.select(F.concat(F.lit("b"), "t").alias("id"), put("words of block #").alias("markdown"))
    return profiles.verdicts(orders.select(F.concat(F.lit("a"), "t").alias("artifact_id"), names.alias("profile")), made, blocks)


# -- transcripts ----------------------------------------------------------------------------------------


@query(
    "ingested_transcripts",
    """WITH r AS (SELECT o_orderkey AS id, concat('raw ', o_orderkey) AS raw FROM orders WHERE o_orderkey % 5 <> 0), s AS (SELECT id, sha256(raw) AS transcript_id, unnest([{'i': 0, 'w': 'professor', 'c': concat('today Alpha v. Beta ', id)}, {'i': 1, 'w': 'unknown', 'c': 'and then Gamma versus Delta or Alpha v. Beta'}, {'i': 3, 'w': 'student', 'c': 'nothing'}]) AS x FROM r)
    SELECT transcript_id, x.i AS order_index, x.w AS speaker, CASE x.i WHEN 0 THEN 'Alpha v. Beta' WHEN 1 THEN 'Gamma v. Delta,Alpha v. Beta' ELSE '' END AS cases FROM s""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("raw "), _text("o_orderkey")).alias("raw"))
    said = [("Professor ", F.concat(F.lit("today Alpha v. Beta "), _text("id"))), ("clerk", F.lit("and then Gamma versus Delta or Alpha v. Beta")), ("student", F.lit("  ")), ("STUDENT", F.lit("nothing"))]
    parts = F.array(*[F.struct(F.lit(i).alias("order_index"), F.lit(w).alias("speaker"), c.alias("content")) for i, (w, c) in enumerate(said)])
    known = orders.where("id % 5 = 0").select(F.sha2("raw", 256).alias("id"))
    names = spark.createDataFrame([("Alpha v. Beta",), ("Gamma v. Delta",)], "name string")
    _, segments = ingest.transcripts(orders.select("raw", F.lit(1).alias("corpus_id"), parts.alias("segments")), known, names)
    return segments.select("transcript_id", "order_index", "speaker", F.array_join("mentioned_cases", ",").alias("cases"))


@query(
    "ingested_syllabi",
    with_views("book") + """, s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS book_id FROM orders)
    SELECT s.id AS syllabus_id, code, CASE WHEN code = 'A' AND s.id % 3 = 0 THEN DATE '2024-02-03' END AS assignment_date, CASE code WHEN 'A' THEN '1-2,0-99' ELSE '' END AS ranges,
    CASE WHEN code = 'A' AND book.id IS NOT NULL THEN CASE WHEN 1 < page_min OR 2 > page_max THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS wrong FROM s CROSS JOIN (VALUES ('A'), ('B')) c(code) LEFT JOIN book ON book.id = s.book_id""",
)
def _(spark, d):
    date = F.when(F.col("o_orderkey") % 3 == 0, '"2024-02-03"').when(F.col("o_orderkey") % 3 == 1, '"soon"').otherwise("null")
    content = F.concat(F.lit('{"entries": [{"code": "A", "title": "t", "assignment_date": '), date, F.lit(', "page_ranges": [[1, 2], [3], [0, 99]]}, {"code": "B", "title": "u"}]}'))
    replies = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("corpus_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("book_id"), content.alias("content"))
    _, entries, wrong = ingest.syllabi(replies, view(spark, d, "book"))
    n = wrong.groupBy("syllabus_id", "code").agg(F.count(F.lit(1)).alias("wrong"))
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return entries.select("syllabus_id", "code", "assignment_date", ranges.alias("ranges")).join(n, ["syllabus_id", "code"], "left").fillna(0, ["wrong"])
