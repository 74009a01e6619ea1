"""What the fourth round's findings were about."""

from __future__ import annotations

import json

import duckdb

from casewright.operators import replies
from casewright.plans import queries as plans


def test_headings_of_odd_lines_are_those_of_the_sql(spark, tmp_path):
    texts = ["", "one\n\n  \n###\n# \n", "Contents\nChapter | 5\nbody", "a\r12\rb\n x\t\nc # #\nd## \n e", "f\u0085g h\x0bi\x0cj\x1ck\nb\n", "\n", None, "## C\ncontents of this", "l\r\nm #\r\n7\n8"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["toc_headings"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLE['toc_headings']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_schema_is_read_once_for_all_replies_of_a_batch(monkeypatch):
    import pyarrow as pa

    node = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/N"}}}}
    schema = {"$ref": "#/$defs/N", "$defs": {"N": node}}
    seen = []
    monkeypatch.setattr(replies, "target", lambda *a, f=replies.target: seen.append(a) or f(*a))
    rows = [('{"a":1}', json.dumps(schema), 1), ('{"kids":[{"a":"x"},{"kids":[{"a":true}]}]}', json.dumps(schema), 2), (None, json.dumps(schema), 3)] * 50
    columns = [[x[0] for x in rows], ["t"] * 150, [x[1] for x in rows], [["b"]] * 150, ["c"] * 150, [x[2] for x in rows]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_p", *replies.REQUEST, "id"])
    out = next(replies._repairer(set(), ["id"])(iter([batch]))).to_pylist()
    assert len(seen) < 20
    assert out[0] == {"id": 1, "content": '{"a":1,"sources":[]}', "problems": []}
    assert out[1]["content"] == '{"a":0,"kids":[{"a":"x"},{"a":0,"kids":[{"a":true}]}],"sources":[]}'
    assert out[1]["problems"] == ["- kids/0/a: not of type integer", "- kids/1/kids/0/a: not of type integer"] and out[2]["content"] is None


def test_a_reply_that_cannot_be_json_is_not_parsed(spark):
    from casewright.functions.text import json_payload
    from pyspark.sql import functions as F

    texts = ['{"a": 1}', ' \n[1] ', "so:\n```json\n{\"b\": 2}\n```", 'x {"c": {"d": 3}} y', "no", "", None, "nullify", "null", '{"a": {', "```\nno\n``` {\"e\": 4}"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.to_json(json_payload(F.col("t"))).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == ['{"a":1}', "[1]", '{"b":2}', '{"c":{"d":3}}', None, None, None, None, "null", None, '{"e":4}']


def _exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_generate_stores_its_attempts_and_looks_up_prompts_of_second_ones_only(spark):
    from pyspark.sql import functions as F

    schema = json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}})
    rows = [(1, "good"), (2, "mended"), (3, "mended"), (4, "bad"), (5, "unknown")]
    asked = spark.createDataFrame(rows, "id long, prompt string").select("id", F.lit(1).cast("long").alias("corpus_id"), F.lit("t").alias("template"), replies.schema_column(schema), "prompt", F.lit("m").alias("model"), F.array(F.lit("b")).alias("block_ids"), F.lit("").alias("case_name"))
    problem = F.array(F.lit("- (root): response was not valid JSON"))
    said = F.when(F.col("prompt") == "good", '{"a":1}').otherwise("no")
    record = lambda key, reply, n: asked.where(F.col("prompt").isin("good", "mended", "bad")).select(replies.call_key(key).alias("cache_key"), reply.alias("reply"), F.lit(n).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    first = record(F.col("prompt"), said, 10)
    again = record(replies.retry_message(F.col("prompt"), F.lit("no"), problem), F.when(F.col("prompt") == "mended", '{"a":2}').otherwise("never"), 20)
    replay = first.unionByName(again).dropDuplicates(["cache_key"])
    out = {r.id: r for r in replies.generate(asked, replay).collect()}
    assert {i: (r.status, r.attempts, r.content, r.input_tokens) for i, r in out.items()} == {
        1: ("made", 1, '{"a":1,"sources":[]}', 10), 2: ("made", 2, '{"a":2,"sources":[]}', 20), 3: ("made", 2, '{"a":2,"sources":[]}', 20), 4: ("failed", 2, None, 20), 5: ("unrecorded", 1, None, 0),
    }
    assert out[2].artifact_id == out[3].artifact_id != out[1].artifact_id and len(out[1].cache_key) == 64
    # with what is there by text keys, one is cached and costs nothing
    there = spark.createDataFrame([("x", 1, out[4].cache_key, "{}")], "id string, corpus_id long, cache_key string, content string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    cached = {r.id: r for r in replies.generate(asked, replay.withColumn("cache_key", F.lower(F.hex("cache_key"))), there).collect()}
    assert (cached[4].status, cached[4].attempts, cached[4].artifact_id, cached[4].content, cached[4].cache_key) == ("cached", 0, "x", "{}", out[4].cache_key)
    assert {i: r.status for i, r in cached.items() if i != 4} == {i: r.status for i, r in out.items() if i != 4}
    # what reads first attempts reads what is stored: no join, no shuffle
    assert _exchanges(replies.generate(asked.where("prompt NOT IN ('mended', 'bad')"), replay)) == 0


def test_blocks_of_a_book_are_dealt_once_for_cases_and_ranges(spark):
    from casewright.operators import retrieve
    from casewright.plans import features as F_plans

    d = "/root/testdata/sf0.001"
    assert retrieve.case_trails(F_plans._blocks(spark, d))._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_an_upload_is_a_book_whose_hashes_are_not_shuffled(spark, tmp_path):
    import hashlib

    from casewright.streaming import flows

    uploads = [("T", None, [(1, "b.pdf", "2\nmore", "h2"), (0, "a.pdf", "1\n# A", "h1")]), ("T", None, [(0, "c.pdf", "1\nother", "h3")]), ("T", None, [(0, "c.pdf", "1\nother", "h3")])]
    spark.createDataFrame(uploads, flows.UPLOAD).coalesce(1).write.parquet(f"{tmp_path}/in")
    first = flows.first_uploads(spark.read.parquet(f"{tmp_path}/in"))
    assert first.schema["files"].dataType.elementType.names == ["part", "path", "markdown"] and first.schema["book_id"].dataType.typeName() == "binary"
    flows.ingest_books(flows.follow(spark, f"{tmp_path}/in"), spark.createDataFrame([], "id string"), f"{tmp_path}/out")
    made = flows.book_tables(spark, f"{tmp_path}/out")
    ids = {hashlib.sha256(b"h1\nh2").hexdigest(): 2, hashlib.sha256(b"h3").hexdigest(): 1}
    assert {r.id: (r.title, r.source_page_min, r.source_page_max) for r in made["book"].collect()} == {i: ("T", 1, n) for i, n in ids.items()}
    assert sorted((r.book_id, r.source_page, r.batch_pdf) for r in made["page"].collect()) == sorted((i, k + 1, ["a.pdf", "b.pdf"][k] if n == 2 else "c.pdf") for i, n in ids.items() for k in range(n))
