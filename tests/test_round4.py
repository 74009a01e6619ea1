"""What round 3's findings found, on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import patterns, records, replies, retrieve, segment
from casewright.plans import queries as plans
from casewright.plans import features  # noqa: F401
from casewright.functions import text as X
from casewright.sources import archive


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_book_of_one_line_like_a_contents_row_keeps_its_heading(spark):
    books = spark.createDataFrame([(1, "# A total of . . 7"), (2, "# x | 3"), (3, "# plain")], "book_id long, markdown string")
    got = segment.toc(segment.page_markers(books)).select("book_id", "title", "source_page").collect()
    assert sorted(map(tuple, got)) == [(1, "A total of . . 7", 0), (2, "x | 3", 0), (3, "plain", 0)]


def test_messages_of_task_changes_are_not_broadcast(spark):
    rows = spark.range(3).select("id", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"))
    asked = spark.range(2).select("id", F.when(F.col("id") == 0, "failed").otherwise("cancelled").alias("to"), F.repeat(F.lit("no "), 900).alias("message"))
    out = records.moved(rows, asked)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {r.id: (r.status, len(r.error or "")) for r in out.collect()} == {0: ("failed", 2000), 1: ("cancelled", 0), 2: ("queued", 0)}


def test_first_opinions_are_found_before_requests_meet_them(spark):
    blocks = spark.createDataFrame([(10, 2, 1, 0, "case_opinion", "A v. B", "m"), (11, 2, 1, 1, "narrative_text", "A v. B", "m"), (20, 1, 5, 0, "case_opinion", "a vs. B", "m"), (21, 1, 2, 0, "case_opinion", "A v. B", "m")], "id long, book_id long, source_page long, order_index int, type string, case_name string, markdown string")
    books = spark.createDataFrame([], "id long, corpus_id long, ingested_at timestamp")
    entries = spark.createDataFrame([], "corpus_id long, code string, ranges array<struct<start:int,end:int>>")
    asked = spark.createDataFrame([(1, "case_reference", None, "A V. B"), (2, "case_reference", 2, "a v. b"), (3, "case_reference", 3, "a v. b"), (4, "case_reference", None, "x")], "request long, kind string, book_id long, case_name string")
    asked = asked.withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int"), "corpus_id": F.lit(None).cast("long"), "code": F.lit(None).cast("string")})
    found, empty = retrieve.answers(asked, blocks, books, entries)
    assert "OR (book_id" not in optimized(found) and "isnull(book_id" in optimized(found)
    assert sorted(map(tuple, found.collect())) == [(1, 21), (2, 10), (2, 11)]
    assert sorted(r.request for r in empty.collect()) == [3, 4]


def test_chats_of_equal_texts_get_their_own_replies(spark, tmp_path):
    spark.createDataFrame([(c, t, r, "same") for c in (1, 2, 3) for t, r in ((0, "user"), (1, "assistant"))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["chat_turns"](spark, str(tmp_path)).select("chat_id", "content", "turn_index").collect()
    assert sorted(map(tuple, got)) == [(1, "Q1", 2), (2, "Q2", 2), (3, "Q3", 2)]


def test_a_generate_step_reads_its_requests_once(spark):
    asked = spark.range(7, 10).select(
        "id", F.lit(1).cast("long").alias("corpus_id"), F.lit("t").alias("template"), replies.schema_column('{"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}}}'),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit("m").alias("model"), F.array().cast("array<string>").alias("block_ids"), F.lit("").alias("case_name"),
    )
    from casewright.sources.archive import cache_key

    key = lambda p: spark.range(1).select(cache_key(F.lit("t"), F.lit("m"), F.lit(p), F.lit(0.2)).alias("k")).first().k
    retry = spark.range(1).select(replies.retry_message(F.lit("p8"), F.lit('{"n": 0}'), F.array(F.lit("- n: under minimum 1"))).alias("m")).first().m
    replay = spark.createDataFrame([(key("p7"), '{"n": 5}', 10, 1), (key("p8"), '{"n": 0}', 10, 1), (key(retry), '{"n": 2}', 30, 3)], "cache_key string, reply string, input_tokens int, output_tokens int")
    none = spark.createDataFrame([], "id string, corpus_id long, cache_key string, created_at timestamp_ntz, content string")
    out = replies.generate(asked, replay, none)
    assert optimized(out).count("Range (7, 10") == 1
    got = {r.id: (r.status, r.attempts, r.content, r.input_tokens, list(r.problems), r.artifact_id is None) for r in out.collect()}
    assert got == {
        7: ("made", 1, '{"n":5,"sources":[]}', 10, [], False), 8: ("made", 2, '{"n":2,"sources":[]}', 30, [], False), 9: ("unrecorded", 1, None, 0, [], True),
    }


def test_citations_of_all_columns_are_put_back_in_one_pass(spark):
    deep = '{"sources": ["b1", {"kind": "page", "id": "p1", "x": {"source_block_ids": ["b1", 4, "zz", {"source_page_ids": ["p1"]}]}}, 5], "n": 1}'
    rows = spark.createDataFrame([("a", deep, '["b1", {"id": "b1"}]'), ("b", "no json", '[{"kind":"page","id":"p1"}]'), ("c", '{"source_block_ids": [ "gone" ]}', None), ("d", None, "[")], "id string, content string, sources string")
    known = spark.createDataFrame([("block", "b1"), ("block", "b1"), ("page", "p1"), ("block", "p1")], "kind string, ref string")
    out = archive.rekeyed(rows, ("content", "sources"), known, lambda c: F.concat(F.lit("new "), c))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one to find and one to put back, for both columns
    new = '{"sources":["new b1",{"kind":"page","id":"new p1","x":{"source_block_ids":["new b1",4,"zz",{"source_page_ids":["new p1"]}]}},5],"n":1}'
    got = sorted(map(tuple, out.collect()))
    assert got == [("a", new, '["new b1",{"id":"new b1"}]'), ("b", "no json", '[{"kind":"page","id":"new p1"}]'), ("c", '{"source_block_ids": [ "gone" ]}', None), ("d", None, "[")]


def test_an_export_is_not_sorted_and_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    held = {"corpus": spark.createDataFrame([("1", "x")], "id string, name string"), "book": spark.createDataFrame([("b", "1")], "id string, corpus_id string")}
    archive.export(held, None, str(tmp_path / "a"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    lines = spark.read.text(str(tmp_path / "a/rows")).groupBy("table").count().collect()
    assert sorted(map(tuple, lines)) == [("book", 1), ("corpus", 1)]


def test_positions_of_matches_are_found_without_a_pattern_a_row(spark):
    rows = spark.createDataFrame([("clearly, and Clearly",), ("un\x00clearly clearly\x00",), ("\U0001f600 clearly",), ("none",)], "t string").coalesce(1)
    text = F.col("t")
    out = rows.select(F.transform(X.all_matches(text, patterns.CLEARLY), lambda m: m["at"]).alias("all"), X.first_match(text, patterns.CLEARLY)["at"].alias("first"), segment.lines(text).alias("lines"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan
    assert [(list(r["all"]), r["first"]) for r in out.collect()] == [([0, 13], 0), ([3, 11], 3), ([2], 2), ([], None)]
    ends = spark.createDataFrame([("a\r\nb\u2028\nc\r",), ("\n",), ("",)], "t string").coalesce(1)
    assert [r[0] for r in ends.select(segment.lines(F.col("t"))).collect()] == [["a", "b", "", "c"], [""], [""]]


def test_each_trigger_holds_one_of_its_words():
    said = {
        "hedge_without_resolution": ["it depends  on the facts", "It's ultimately a fact question", "the court would need to evaluate the facts"], "clearly_as_argument_substitution": ["CLEARLY"], "no_arguing_in_the_alternative": ["could be argued that", "one might\nargue"],
        "rule_recited_not_applied": ["rule is", "doctrine holds", "the Test", "the standard"], "conclusion_mismatches_analysis": ["In  sum, x"], "mismatched_future_interests": ["contingent remainder", "Indefeasibly vested", "subject to complete divestment"],
        "read_the_prompt": ["I would argue", "My client", "we should"], "ny_adverse_possession_reasonable_basis": ["thought he owned"],
    }
    assert set(patterns.WORDS) == set(patterns.TRIGGERS) == set(said)
    for name, texts in said.items():
        assert all(any(w in t.lower() for w in patterns.WORDS[name]) for t in texts), name


def test_a_group_is_tried_with_the_patterns_that_can_fit_it(monkeypatch):
    tried = []

    class Pattern:
        def __init__(self, name, own):
            self.name, self.own = name, own

        def match(self, text):
            tried.append(self.name)
            return self.own.match(text)

    for name in ("CASE", "NOTES", "NUMBERED", "ALIGN", "FIGURE", "HEADING"):
        monkeypatch.setattr(segment, name, Pattern(name, getattr(segment, name)))
    assert [segment._kind(g) for g in ("plain words", "> q", "1. x", "# h", "Ab v. Bc")] == ["narrative_text", "block_quote", "numbered_note", "header", "case"]
    assert tried == ["NUMBERED", "NOTES", "HEADING", "CASE"]


def test_a_schema_is_read_once_a_batch(monkeypatch):
    import pyarrow as pa

    schema, read = '{"type": "object", "required": ["a"]}', []
    loads = replies.json.loads
    monkeypatch.setattr(replies.json, "loads", lambda t: read.append(t) or loads(t))
    columns = [["{}"] * 5, ["t"] * 5, [schema] * 5, [["b"]] * 5, [""] * 5, list(range(5))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_p", "_t", "_s", "_i", "_c", "id"])
    got = list(replies._repairer(set())([batch]))[0].to_pydict()
    assert read.count(schema) == 1 and got["content"] == ['{"a":null,"sources":[]}'] * 5


def test_nearest_compares_few_queries_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    made = np.random.default_rng(1).integers(-3, 4, (700, 5)).astype("float32")
    made[7] = 0
    rows = lambda at: pa.table({"vec_id": pa.array(at, pa.int64()), "embedding": pa.array([made[i].tolist() for i in at], pa.list_(pa.float32()))})
    sizes, rounded = [], np.round
    monkeypatch.setattr(np, "round", lambda x, n: sizes.append(x.shape[0]) or rounded(x, n))
    asked, order = list(range(0, 700, 2)), list(range(699, -1, -1))
    got = retrieve._closest(3)(rows(asked), rows(order)).to_pylist()
    assert max(sizes) <= retrieve.AT_ONCE < len(asked) and sum(sizes) == len(asked)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = made.astype(float) / np.linalg.norm(made.astype(float), axis=1)[:, None]
    want = []
    for q in asked:
        cosine = [(-rounded(float(unit[q] @ unit[i]), 6), i) for i in range(700) if i != q and 7 not in (i, q)]
        want += [(q, i, -c) for c, i in sorted(cosine)[:3]]
    assert [(r["qid"], r["id"], r["cosine"]) for r in got] == want
