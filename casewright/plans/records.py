"""More registered queries: lookups, text functions, archives, replies, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.session import scratch
from casewright.operators import desk, features, ledger, records, retrieve, study, verify
from casewright.plans.queries import _SM2, _SUBJECTS, _double, _segments, query
from casewright.sources import archive
from casewright.sources.views import table, view, with_views
from casewright.streaming import flows

# -- retrieval ------------------------------------------------------------------------------------------


@query("first_opinion", with_views("block") + "SELECT id, source_page FROM block WHERE book_id = 7 AND type = 'case_opinion' AND source_page BETWEEN 1 AND 7 ORDER BY source_page, order_index, id LIMIT 1")
def _(spark, d):
    return retrieve.first_opinion(view(spark, d, "block"), retrieve.PageRange(7, 1, 7)).select("id", "source_page")


@query(
    "case_reference",
    with_views("block") + """, n AS (SELECT *, sum(CASE WHEN type IN ('case_header', 'case_opinion') THEN 1 ELSE 0 END) OVER (ORDER BY source_page, order_index, id) AS c FROM block WHERE book_id = 1),
    t AS (SELECT *, max(CASE WHEN type = 'case_opinion' THEN id END) OVER (PARTITION BY c) AS opinion_id FROM n),
    o AS (SELECT * FROM n WHERE type = 'case_opinion' ORDER BY source_page DESC, order_index DESC, id DESC LIMIT 1),
    f AS (SELECT n.id FROM n JOIN o ON n.case_name = o.case_name WHERE n.type = 'case_opinion' ORDER BY n.source_page, n.order_index, n.id LIMIT 1)
    SELECT id, source_page FROM t WHERE opinion_id = (SELECT id FROM f)""",
)
def _(spark, d):
    blocks = view(spark, d, "block")
    last = blocks.where("book_id = 1 AND type = 'case_opinion'").orderBy(F.desc("source_page"), F.desc("order_index"), F.desc("id")).first()
    name = last.case_name.upper().replace(" V. ", " VS.  ") if last else ""
    return retrieve.case_reference(blocks, 1, name).select("id", "source_page")


@query(
    "range_notes",
    with_views("block") + """, e AS (SELECT min(source_page) AS lo, max(source_page) AS hi FROM block WHERE book_id = 7)
    SELECT note FROM (SELECT unnest([concat('start clamped to ', CAST(lo AS VARCHAR)), concat('end clamped to ', CAST(hi AS VARCHAR))]) AS note FROM e WHERE lo IS NOT NULL)
    UNION ALL SELECT 'no pages in this range' FROM e WHERE lo IS NULL""",
)
def _(spark, d):
    return retrieve.range_notes(view(spark, d, "block"), retrieve.PageRange(7, -3, 99))


@query(
    "latest_entry",
    """WITH e AS (SELECT l_orderkey AS s, l_returnflag AS code, max(l_partkey) AS page FROM lineitem GROUP BY 1, 2)
    SELECT o_custkey AS corpus_id, code, s AS syllabus_id, page FROM e JOIN orders ON s = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY o_custkey, code ORDER BY o_orderdate DESC, s DESC) = 1""",
)
def _(spark, d):
    entries = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("syllabus_id"), F.col("l_returnflag").alias("code")).agg(F.max("l_partkey").alias("page"))
    syllabi = table(spark, d, "orders").select(F.col("o_orderkey").alias("syllabus_id"), F.col("o_custkey").alias("corpus_id"), F.col("o_orderdate").alias("created_at"))
    return retrieve.latest_entry(entries, syllabi).select("corpus_id", "code", "syllabus_id", "page")


@query(
    "blocks_in_order",
    with_views("block", "reference") + """, a AS (SELECT artifact_id, list(ref ORDER BY l_linenumber DESC, ref DESC) AS ids FROM reference GROUP BY 1),
    u AS (SELECT artifact_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS position, unnest(ids) AS id FROM a)
    SELECT artifact_id, position, id, type FROM u JOIN block USING (id)""",
)
def _(spark, d):
    pairs = F.sort_array(F.collect_list(F.struct("l_linenumber", "ref")), asc=False)
    ids = view(spark, d, "reference").groupBy("artifact_id").agg(F.transform(pairs, lambda x: x["ref"]).alias("ids"))
    return retrieve.in_order(ids, view(spark, d, "block"), "artifact_id", "ids").select("artifact_id", "position", "id", "type")


@query("primary_book", with_views("book") + "SELECT corpus_id, arg_min(id, (ingested_at, id)) AS book_id FROM book GROUP BY 1")
def _(spark, d):
    return records.primary_book(view(spark, d, "book"))


@query("offset_pages", with_views("segment") + "SELECT transcript_id, CAST(greatest(count(*) FILTER (end_char - n <= 500), 1) AS INTEGER) AS page FROM segment GROUP BY 1")
def _(spark, d):
    starts = view(spark, d, "segment").groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.col("end_char") - F.col("n"))).alias("starts"))
    return starts.select("transcript_id", retrieve.page_offsets(F.col("starts"), F.lit(500)).alias("page"))


@query(
    "cited_text",
    with_views("block", "reference") + """, f AS (SELECT DISTINCT artifact_id, ref FROM reference)
    SELECT artifact_id, string_agg(markdown, chr(10) || chr(10) ORDER BY book_id, source_page, order_index, id) AS text FROM f JOIN block ON id = ref GROUP BY 1""",
)
def _(spark, d):
    return records.cited_text(view(spark, d, "reference"), view(spark, d, "block"))


# -- ledger and tasks -----------------------------------------------------------------------------------


@query(
    "ledger_csv",
    with_views("cost_event") + "SELECT CAST(id AS VARCHAR) AS id, feature, CAST(cached AS VARCHAR) AS cached, CAST(input_tokens AS VARCHAR) AS input_tokens FROM cost_event ORDER BY ts DESC, cost_event.id DESC LIMIT 100000",
)
def _(spark, d):
    path = scratch(spark, "csv")
    ledger.export_csv(ledger.priced(spark, view(spark, d, "cost_event").drop("total_cost_usd")), path)
    return spark.read.option("header", True).csv(path).select("id", "feature", "cached", "input_tokens")


@query(
    "ledger_appends",
    with_views("cost_event") + "SELECT cached, count(*) AS n, count(*) FILTER (cached) AS n_free FROM cost_event GROUP BY 1",
)
def _(spark, d):
    path = scratch(spark, "ledger")
    events = view(spark, d, "cost_event").drop("total_cost_usd")
    for part in ("id % 2 = 0", "id % 2 <> 0"):
        ledger.append(events.where(part), path)
    return spark.read.parquet(path).groupBy("cached").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cached") & (F.col("total_cost_usd") == 0)).alias("n_free"))


_TASKS = "SELECT o_orderkey AS id, o_custkey AS corpus_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, o_orderpriority AS kind, o_orderdate AS created_at FROM orders"


def _tasks(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("corpus_id"), status.alias("status"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created_at"))


@query("task_listing", f"SELECT id, kind FROM ({_TASKS}) WHERE status = 'running' ORDER BY created_at DESC, id DESC LIMIT 50")
def _(spark, d):
    return records.tasks(_tasks(spark, d), corpus_id=None, status="running").select("id", "kind")


@query(
    "task_changes",
    f"""SELECT id, CASE WHEN status = 'completed' OR id % 3 = 0 THEN status WHEN id % 3 = 1 THEN 'failed' ELSE 'cancelled' END AS status,
    CASE WHEN status <> 'completed' AND id % 3 = 1 THEN left(repeat('no ', 900), 2000) END AS error FROM ({_TASKS})""",
)
def _(spark, d):
    rows = _tasks(spark, d).select("id", "status", F.lit(None).cast("string").alias("error"))
    asked = rows.where("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, "failed").otherwise("cancelled").alias("to"), F.repeat(F.lit("no "), 900).alias("message"))
    return records.moved(rows, asked)


@query("health", "SELECT 'orders' AS name, count(*) AS n, 'ok' AS state FROM orders UNION ALL SELECT 'none', 0, 'empty' UNION ALL SELECT 'spare', 0, 'ok'")
def _(spark, d):
    orders = table(spark, d, "orders")
    return records.health({"orders": orders, "none": orders.limit(0), "spare": orders.limit(0)}, ["orders", "none"])


@query("task_progress", "SELECT l_orderkey * 10 + l_linenumber AS id, round(20 + 60 * least(l_quantity / 40.0, 1.0), 6) AS pct FROM lineitem")
def _(spark, d):
    pct = records.progress(F.lit(20.0), F.lit(80.0), F.col("l_quantity"), F.lit(40.0))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(pct, 6).alias("pct"))


@query("elapsed_seconds", "SELECT event_id AS id, greatest(CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-05')) AS BIGINT), 0) AS seconds FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), records.elapsed(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("seconds"))


# -- study ----------------------------------------------------------------------------------------------


@query(
    "known_subjects",
    _SUBJECTS + """, r AS (SELECT transcript_id, kind, CASE WHEN return_count % 2 = 0 THEN label ELSE 'unheard' END AS l, count(*) AS n FROM f GROUP BY 1, 2, 3)
    SELECT r.transcript_id, r.kind, l AS label, f.label IS NOT NULL AS known FROM r LEFT JOIN f ON f.transcript_id = r.transcript_id AND f.kind = r.kind AND f.label = r.l""",
)
def _(spark, d):
    f = study.subject_features(_segments(spark, d))
    returned = f.select("transcript_id", "kind", F.when(F.col("return_count") % 2 == 0, F.col("label")).otherwise("unheard").alias("label")).distinct()
    known, not_known = study.reconciled(returned, f)
    cols = ["transcript_id", "kind", "label"]
    return known.select(*cols, F.lit(True).alias("known")).unionByName(not_known.select(*cols, F.lit(False).alias("known")))


@query(
    "fresh_cards",
    "SELECT DISTINCT concat(CAST(user_id AS VARCHAR), ':', event_type) AS card, 0 AS reps FROM events WHERE concat(CAST(user_id AS VARCHAR), ':', event_type) NOT IN (SELECT concat(CAST(user_id AS VARCHAR), ':', event_type) FROM events WHERE event_id % 40 = 0)",
)
def _(spark, d):
    log = view(spark, d, "review")
    return study.seeded(log.select("card"), study.review_states(log.where("seq % 40 = 0")), "2024-02-05 00:00:00").select("card", "reps")


@query("card_texts", "SELECT doc_id AS set_id, concat('c', CAST(doc_id AS VARCHAR)) AS card, lang AS front FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL")
def _(spark, d):
    one = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("front")), F.struct(F.lit(" ").alias("id"), F.lit("x").alias("front"))).alias("cards")))
    sets = table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.lit('{"cards": 7}')).otherwise(one).alias("content"))
    return records.cards(sets).select("set_id", "card", "front")


@query("next_turns", with_views("segment") + "SELECT transcript_id, count(*) FILTER (speaker = 'professor') + 1 AS turn FROM segment GROUP BY 1")
def _(spark, d):
    return records.next_turn(view(spark, d, "segment"))


@query(
    "mentioned_in_order",
    with_views("segment") + """, u AS (SELECT transcript_id, order_index, unnest([length(content) % 3, 7]) AS w, unnest([0, 1]) AS i FROM segment),
    f AS (SELECT transcript_id, concat('w', CAST(w AS VARCHAR)) AS name, min(order_index * 10 + i) AS p FROM u GROUP BY 1, 2)
    SELECT transcript_id, name, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY p) - 1 AS INTEGER) AS position FROM f""",
)
def _(spark, d):
    names = F.array(F.concat(F.lit("w"), (F.length("content") % 3).cast("string")), F.lit("w7"))
    return records.ordered_union(view(spark, d, "segment").withColumn("names", names), "transcript_id", "order_index", "names")


@query(
    "sole_profiles",
    "SELECT o_custkey AS corpus_id, coalesce(min(o_orderkey) FILTER (o_orderpriority = '1-URGENT'), CASE WHEN count(*) = 1 THEN min(o_orderkey) END) AS id FROM orders GROUP BY 1",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("corpus_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    return records.sole_profile(rows, "1-URGENT")


@query(
    "gated_artifacts",
    with_views("artifact") + ", w AS (SELECT DISTINCT l_orderkey + l_linenumber * 3 AS id FROM lineitem) SELECT w.id, CASE WHEN type IS NULL THEN 'missing' WHEN type <> 'case_brief' THEN concat('type is ', type) END AS problem FROM w LEFT JOIN artifact ON artifact.id = w.id",
)
def _(spark, d):
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("id")).distinct()
    return records.gated(wanted, view(spark, d, "artifact"), "case_brief")


@query(
    "memo_sources",
    "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'no markdown' ELSE CASE WHEN doc_id % 4 = 1 THEN 'type is outline' END END AS problem, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 <> 1 THEN concat('artifact://', CAST(doc_id AS VARCHAR)) END AS path FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 4 <> 1 "
    "UNION ALL SELECT doc_id, 'type is outline', NULL FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 = 1",
)
def _(spark, d):
    memos = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 1, "outline").otherwise("memo").alias("type"), F.when(F.col("doc_id") % 5 > 0, F.lit("m")).alias("markdown"), F.lit(" ").alias("path"))
    good, warned = records.memo_sources(memos.select("id"), memos)
    return good.select("id", F.lit(None).cast("string").alias("problem"), "path").unionByName(warned.withColumn("path", F.lit(None).cast("string")))


@query(
    "typed_answers",
    with_views("block", "book") + """, n AS (SELECT *, sum(CASE WHEN type IN ('case_header', 'case_opinion') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY source_page, order_index, id) AS c FROM block),
    t AS (SELECT *, max(CASE WHEN type = 'case_opinion' THEN id END) OVER (PARTITION BY book_id, c) AS opinion_id FROM n), r AS (SELECT o_orderkey AS request, o_custkey, o_orderkey % 6 AS kind FROM orders),
    cn AS (SELECT r.request, 'Party ' || (r.request % 40) || ' v. Party ' || (r.request % 7) AS name, kind FROM r WHERE kind IN (1, 2)),
    f AS (SELECT cn.request, arg_min(t.opinion_id, (t.book_id, t.source_page, t.order_index, t.id)) AS o FROM cn JOIN t ON t.type = 'case_opinion' AND t.case_name = cn.name AND (cn.kind = 2 OR t.book_id = cn.request) GROUP BY 1),
    ob AS (SELECT corpus_id, arg_min(id, (ingested_at, id)) AS book_id FROM book GROUP BY 1),
    a AS (SELECT request, block.id FROM r JOIN block ON book_id = request WHERE kind = 0 AND source_page BETWEEN 2 AND 3 UNION ALL SELECT f.request, t.id FROM f JOIN t ON t.opinion_id = f.o
        UNION ALL SELECT r.request, block.id FROM r JOIN ob ON ob.corpus_id = r.o_custkey JOIN block USING (book_id) WHERE kind = 3 AND source_page <= 2)
    SELECT request, id, NULL AS note FROM a UNION ALL SELECT request, NULL, CASE kind WHEN 0 THEN 'no pages in this range' WHEN 1 THEN 'no such case' WHEN 2 THEN 'no such case' WHEN 3 THEN 'no such assignment' WHEN 4 THEN 'no vectors' ELSE 'unknown query: odd' END FROM r WHERE request NOT IN (SELECT request FROM a)""",
)
def _(spark, d):
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 6
    names = F.element_at(F.array(*map(F.lit, ("page_range", "case_reference", "case_reference", "assignment_code", "semantic", "odd"))), (kind + 1).cast("int"))
    case = F.concat(F.lit("PARTY "), (key % 40).cast("string"), F.lit(" vs. Party "), (key % 7).cast("string"))
    requests = table(spark, d, "orders").select(
        key.alias("request"), names.alias("kind"), F.when(kind <= 1, key).alias("book_id"), F.when(kind == 0, 2).alias("start"), F.when(kind == 0, 3).alias("end"), F.when(kind.isin(1, 2), case).alias("case_name"),
        F.when(kind == 3, F.col("o_custkey")).alias("corpus_id"), F.when(kind == 3, "A").alias("code"),
    )
    ranges = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(2).alias("end")))
    entries = table(spark, d, "customer").select(F.col("c_custkey").alias("corpus_id"), F.lit("A").alias("code"), ranges.alias("ranges"))
    found, empty = retrieve.answers(requests, view(spark, d, "block"), view(spark, d, "book"), entries)
    return found.select("request", "id", F.lit(None).cast("string").alias("note")).unionByName(empty.select("request", F.lit(None).cast("long").alias("id"), "note"))


@query(
    "due_card_texts",
    """WITH s AS (SELECT doc_id AS set_id, 'c' || CAST(doc_id % 7 AS VARCHAR) AS card, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 60 AS INTEGER)) AS due_at FROM documents WHERE doc_id % 5 <> 4),
    q AS (SELECT * FROM s WHERE due_at <= TIMESTAMP '2024-02-01 00:00:00' ORDER BY due_at, set_id, card LIMIT 1000000)
    SELECT set_id, card, CASE WHEN set_id % 7 < 3 THEN concat('{"id":"', card, '","front":"f', set_id, '"}') END AS payload, due_at FROM q WHERE set_id % 7 < 3 AND set_id % 11 <> 0""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("set_id"))
    key = F.col("set_id").cast("string")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    states = docs.where("set_id % 5 <> 4").select("set_id", F.concat(F.lit("c"), (F.col("set_id") % 7).cast("string")).alias("card"), (start + F.make_dt_interval((F.col("set_id") % 60).cast("int"))).alias("due_at"))
    one = lambda i, front: F.concat(F.lit('{"id":"c%d","front":"' % i), front, F.lit('"}'))
    held = F.concat(F.lit('{"cards":['), F.concat_ws(",", one(0, F.concat(F.lit("f"), key)), one(1, F.concat(F.lit("f"), key)), F.lit("7"), one(2, F.concat(F.lit("f"), key)), one(2, F.lit("again"))), F.lit("]}"))
    sets = docs.where("set_id % 11 <> 0").select(F.col("set_id").alias("id"), held.alias("content"))
    return study.due_cards(states, sets, "2024-02-01 00:00:00", 1_000_000)


@query(
    "opened_chats",
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 6 AS kind FROM orders)
    SELECT k AS request, CASE WHEN kind <= 1 THEN concat('a', k) WHEN kind IN (2, 3) THEN sha256(concat('chat|', k)) END AS id, CASE kind WHEN 0 THEN 'socratic_drill' WHEN 1 THEN 'cold_call_session' WHEN 2 THEN 'socratic_drill' WHEN 3 THEN 'cold_call_session' END AS type,
        CASE WHEN kind <= 1 THEN concat('b', k) WHEN kind <= 3 THEN concat('n', k) END AS case_block_id, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS turns, CASE kind WHEN 4 THEN 'chat not found' WHEN 5 THEN 'not a chat: outline' END AS problem,
        CASE WHEN kind IN (2, 3) THEN concat('[{"kind":"block","id":"n', k, '"}]') END AS sources FROM r""",
)
def _(spark, d):
    key, kind, text = F.col("o_orderkey"), F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    name = lambda p: F.concat(F.lit(p), text)
    requests = table(spark, d, "orders").select(key.alias("request"), F.lit(1).alias("corpus_id"), name("n").alias("case_block_id"), F.when(kind == 3, "cold_call").otherwise("socratic").alias("mode"), F.when(~kind.isin(2, 3), name("a")).alias("existing_id"))
    types = F.when(kind == 0, "socratic_drill").when(kind == 1, "cold_call_session").otherwise("outline")
    content = F.concat(F.lit('{"case_block_id":"b'), text, F.lit('"'), F.when(kind == 0, ',"history":[{"role":"student"},{"role":"professor"}],"mode":"socratic"').otherwise(""), F.lit("}"))
    held = table(spark, d, "orders").where("o_orderkey % 6 IN (0, 1, 5)").select(name("a").alias("id"), F.lit(1).alias("corpus_id"), types.alias("type"), content.alias("content"))
    chats, new, wrong = desk.opened(requests, held, "2024-02-01T00:00:00Z")
    out = requests.select("request").join(chats.drop("mode"), "request", "left").join(wrong, "request", "left").join(new.select("id", "sources"), "id", "left")
    return out.select("request", "id", "type", "case_block_id", "turns", "problem", "sources")


@query(
    "stored_profiles",
    """WITH o AS (SELECT c_custkey AS k, c_custkey % 4 AS kind FROM customer)
    SELECT k AS corpus_id, 'P' AS professor_name, CASE WHEN kind = 3 THEN 'old' ELSE concat('Course ', k) END AS course, CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'old school' WHEN 2 THEN concat('S', k) ELSE 'old school' END AS school,
        CASE kind WHEN 3 THEN NULL WHEN 2 THEN '["x","m","n"]' ELSE '["m","n"]' END AS source_artifact_paths FROM o""",
)
def _(spark, d):
    key, kind, text = F.col("c_custkey"), F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer")
    old = rows.where("c_custkey % 4 IN (1, 3)").select(key.alias("corpus_id"), F.lit("P").alias("professor_name"), F.lit("old").alias("course"), F.lit("old school").alias("school"), *[F.lit(None).cast("string").alias(f) for f in features.PROFILE_FIELDS[2:]])
    asked = rows.where("c_custkey % 4 <> 3").select(F.concat(F.lit("q"), text).alias("id"), key.alias("corpus_id"), F.lit("P").alias("professor_name"), F.array(F.lit("m"), F.lit("n"), F.lit("m")).alias("paths"))
    more = F.when(kind == 2, F.concat(F.lit(',"school":"S'), text, F.lit('","source_artifact_paths":["x","m"]'))).otherwise("")
    out = rows.where("c_custkey % 4 <> 3").select(F.concat(F.lit("q"), text).alias("id"), F.concat(F.lit('{"course":"Course '), text, F.lit('"'), more, F.lit("}")).alias("content"))
    return features.stored_profiles(out, asked, old).select("corpus_id", "professor_name", "course", "school", "source_artifact_paths")


# -- verification and replies ---------------------------------------------------------------------------


@query(
    "rubric_shapes",
    "SELECT l_orderkey AS artifact_id, count(*) >= 3 AS enough, round(sum(l_tax * 5), 6) BETWEEN 0.95 AND 1.05 AS sums_to_one, count(*) FILTER (l_linenumber % 4 = 0) AS unlabelled FROM lineitem GROUP BY 1",
)
def _(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), (F.col("l_tax") * 5).alias("weight"), F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise(F.col("l_returnflag")).alias("label"))
    return verify.rubric_shape(items)


@query("passed_artifacts", "SELECT l_orderkey AS artifact_id, NOT bool_or(l_quantity > 45) AS passed FROM lineitem GROUP BY 1")
def _(spark, d):
    issues = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.when(F.col("l_quantity") > 45, "error").otherwise("warning").alias("severity"))
    return verify.passed(issues)


@query(
    "cited_ids",
    "SELECT l_orderkey * 10 + l_linenumber AS id, array_to_string(list_sort(list_distinct([concat('b', CAST(l_partkey % 5 AS VARCHAR)), concat('b', CAST(l_suppkey % 5 AS VARCHAR)), concat('b', CAST(l_linenumber AS VARCHAR))])), ',') AS cited FROM lineitem",
)
def _(spark, d):
    content = """concat('{"a": {"source_block_ids": ["b', l_partkey % 5, '", "b', l_suppkey % 5, '"], "n": [1]}, "source_block_ids": ["b', l_linenumber, '"]}')"""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr(content).alias("content"))
    return rows.select("id", F.array_join(F.array_sort(verify.cited_ids(F.col("content"))), ",").alias("cited"))


@query("canonical_sources", "SELECT l_orderkey * 10 + l_linenumber AS id, concat('block:b', CAST(l_partkey AS VARCHAR), ' transcript_segment:s', CAST(l_suppkey AS VARCHAR), ' block:r') AS sources FROM lineitem")
def _(spark, d):
    refs = """array(concat('b', l_partkey), concat('{"kind": "transcript_segment", "id": "s', l_suppkey, '"}'), '{"ref": "r"}', '{"kind": "block"}', concat('b', l_partkey))"""
    found = F.transform(verify.sources(F.expr(refs)), lambda x: F.concat(x["kind"], F.lit(":"), x["id"]))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array_join(found, " ").alias("sources"))


@query("reply_payloads", "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE CAST(l_linenumber % 4 + 1 AS INTEGER) END AS k FROM lineitem")
def _(spark, d):
    reply = """CASE l_linenumber % 4 WHEN 0 THEN '{"k": 1}' WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), '{"k": 2}', chr(10), '```') WHEN 2 THEN 'It is {"k": 3} now' ELSE 'none' END"""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr(reply).alias("reply"))
    return rows.select("id", F.try_variant_get(X.json_payload(F.col("reply")), "$.k", "int").alias("k"))


_KEY = """sha256(concat('{"messages":"', o_orderstatus, '","model":"m","template":"', o_orderpriority, '","temperature":0.2}'))"""


@query("replayed_calls", f"SELECT o_orderkey AS id, {_KEY} AS cache_key, o_orderstatus = 'F' AS found FROM orders")
def _(spark, d):
    key = archive.cache_key(F.col("o_orderpriority"), F.lit("m"), F.col("o_orderstatus"), F.lit(0.2))
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), key.alias("cache_key"), "o_orderstatus")
    replay = calls.where("o_orderstatus = 'F'").select("cache_key").distinct().withColumn("reply", F.lit("{}"))
    had, lacked = archive.replayed(calls, replay)
    return had.select("id", "cache_key", F.lit(True).alias("found")).unionByName(lacked.select("id", "cache_key", F.lit(False).alias("found")))


# -- texts and archives ---------------------------------------------------------------------------------


@query(
    "case_name_forms",
    """SELECT l_orderkey * 10 + l_linenumber AS id, concat('the party ', l_returnflag_low, ' v party x') AS equal_form, concat('Party ', l_returnflag, ' v. Party X..') AS fuzzy_form
    FROM (SELECT *, lower(l_returnflag) AS l_returnflag_low FROM lineitem)""",
)
def _(spark, d):
    name = F.concat(F.lit("The Party "), F.col("l_returnflag"), F.lit(" vs. Party X.."))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), X.equal_name(name).alias("equal_form"), X.fuzzy_name(name).alias("fuzzy_form"))


@query(
    "indented_titles",
    with_views("section") + "SELECT book_id, source_page, concat(repeat('  ', CAST(source_page % 3 AS INTEGER)), title) AS line FROM section",
)
def _(spark, d):
    return view(spark, d, "section").select("book_id", "source_page", records.indented(F.col("title"), F.col("source_page") % 3 + 1).alias("line"))


@query(
    "content_hashes",
    "SELECT doc_id, sha256(text) AS sha256, sha256(concat(sha256(text), chr(10), sha256('x'))) AS book_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) AND text IS NOT NULL",
)
def _(spark, d):
    files = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    hashed = archive.content_hash(files)
    fresh = archive.misses(hashed, hashed.where("path % 3 = 0"))
    return fresh.select(F.col("path").alias("doc_id"), "sha256", archive.book_id(F.array(F.col("sha256"), F.sha2(F.lit("x").cast("binary"), 256))).alias("book_id"))


@query("export_names", "SELECT o_orderkey AS id, concat('5-LOW-corpus-', CAST(o_custkey AS VARCHAR), '-', strftime(o_orderdate, '%Y%m%dT%H%M%SZ')) AS name FROM orders")
def _(spark, d):
    corpus = F.concat(F.lit(" 5-LOW__corpus: "), F.col("o_custkey").cast("string"), F.lit("!"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), archive.export_name(corpus, F.col("o_orderdate")).alias("name"))


@query(
    "restored_artifacts",
    with_views("artifact") + "SELECT sha256(concat('copy|', CAST(id AS VARCHAR))) AS id, sha256(concat('copy|', CAST(corpus_id AS VARCHAR))) AS corpus_id, sha256('copy|' || CAST(parent_id AS VARCHAR)) AS parent_artifact_id, type FROM artifact WHERE corpus_id = (SELECT min(corpus_id) FROM artifact)",
)
def _(spark, d):
    artifacts = view(spark, d, "artifact").select("id", "corpus_id", F.col("parent_id").alias("parent_artifact_id"), "type")
    corpus = artifacts.agg(F.min("corpus_id")).first()[0]
    held = {"corpus": table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "book": view(spark, d, "book").select("id", "corpus_id"), "artifact": artifacts}
    path = scratch(spark, "export")
    archive.export(held, corpus, path)
    schemas = {"corpus": "id string", "book": "id string, corpus_id string", "artifact": "id string, corpus_id string, parent_artifact_id string, type string"}
    return archive.restore(spark, path, schemas, "copy")["artifact"]


# -- streams --------------------------------------------------------------------------------------------


@query("streamed_reviews", _SM2 + 'SELECT card, ease, "interval", reps, last_at FROM z WHERE k = 1')
def _(spark, d):
    events = flows.follow(spark, f"{d}/events.parquet")
    log = events.selectExpr("concat(user_id, ':', event_type) AS card", "ts AS at", "event_id AS seq", "CAST(event_id % 6 AS INT) AS grade")
    return flows.latest(spark, flows.drained(flows.review_states(log)), ["card"])


@query("streamed_costs", "SELECT CAST(ts AS DATE) AS day, event_type AS feature, round(CAST(sum(CAST(value AS DECIMAL(20,10))) AS DOUBLE), 6) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    events = flows.follow(spark, f"{d}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS feature", "CAST(value AS DECIMAL(20,10)) AS total_cost_usd")
    return _double(flows.latest(spark, flows.drained(flows.daily_costs(events)), ["day", "feature"]), "total")
