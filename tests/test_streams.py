"""The streams over several batches against the batch forms, and the record operators on odd rows."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators import ingest, records, study
from casewright.streaming import flows


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("events") / "t")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ranked = events.withColumn("n", sum((F.col("ts") > F.lit(c).cast("timestamp_ntz")).cast("int") for c in [r[0] for r in events.select("ts").orderBy("ts").collect()][249:750:250]))
    for i in range(4):
        ranked.where(f"n = {i}").drop("n").coalesce(1).write.mode("append").parquet(path)
    return path


def test_reviews_over_batches(spark, split):
    columns = ["concat(user_id, ':', event_type) AS card", "ts AS at", "event_id AS seq", "CAST(event_id % 6 AS INT) AS grade"]
    table = flows.drained(flows.review_states(flows.follow(spark, split, 1).selectExpr(*columns)))
    assert spark.read.parquet(table).select("_batch").distinct().count() == 4
    got = flows.latest(spark, table, ["card"]).select("card", "ease", "interval", "reps", "last_at")
    want = study.review_states(spark.read.parquet(split).selectExpr(*columns)).drop("due_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reviews_in_any_order_give_the_batch_result(spark, split, tmp_path):
    """Batches from the latest to the earliest, then mixed: within the watermark the order of arrival says nothing."""
    events = spark.read.parquet(split).selectExpr("concat(user_id, ':', event_type) AS card", "ts AS at", "event_id AS seq", "CAST(event_id % 6 AS INT) AS grade")
    want = sorted(map(tuple, study.review_states(events).drop("due_at").collect()))
    for name, order in (("back", F.col("at").desc()), ("mixed", F.xxhash64("seq"))):
        path = f"{tmp_path}/{name}"
        ranked = events.withColumn("n", F.ntile(5).over(Window.orderBy(order)))
        for i in range(1, 6):
            ranked.where(f"n = {i}").drop("n").coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)  # files are taken in order of their times
        table = flows.drained(flows.review_states(flows.follow(spark, path, 1), "60 days"))
        got = flows.latest(spark, table, ["card"]).select("card", "ease", "interval", "reps", "last_at")
        assert sorted(map(tuple, got.collect())) == want, name


def test_reviews_settle_behind_the_watermark(spark, tmp_path):
    """A late review within the watermark is counted in its place, one behind it is left out, and what is settled is kept."""
    day = "2024-01-%02d 00:00:00"
    batches = [[("a", 1, 1, 5), ("b", 1, 2, 4)], [("a", 10, 3, 2), ("c", 12, 4, 5)], [("a", 8, 5, 5), ("b", 11, 6, 5)], [("a", 2, 7, 0), ("a", 20, 8, 4)], [("a", 19, 9, 4), ("b", 30, 10, 3)], [("c", 31, 11, 1)]]
    rows = [(i, c, day % d, s, g) for i, b in enumerate(batches) for c, d, s, g in b]
    every = spark.createDataFrame(rows, "n int, card string, at string, seq long, grade int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    for i in range(len(batches)):
        every.where(f"n = {i}").drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        time.sleep(1.1)
    got = flows.latest(spark, flows.drained(flows.review_states(flows.follow(spark, f"{tmp_path}/t", 1), "5 days")), ["card"])
    want = study.review_states(every.where("seq <> 7").drop("n")).drop("due_at")
    columns = ["card", "ease", "interval", "reps", "last_at"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_costs_over_batches(spark, split):
    columns = ["CAST(ts AS TIMESTAMP) AS ts", "event_type AS feature", "CAST(value AS DECIMAL(20,10)) AS total_cost_usd"]
    got = flows.latest(spark, flows.drained(flows.daily_costs(flows.follow(spark, split, 1).selectExpr(*columns))), ["day", "feature"])
    rows = spark.read.parquet(split).selectExpr(*columns)
    want = rows.groupBy(F.to_date("ts").alias("day"), "feature").agg(F.sum("total_cost_usd").alias("total"))
    assert sorted(map(tuple, got.select("day", "feature", "total").collect())) == sorted(map(tuple, want.collect()))


def test_books_arrive_in_overlapping_batches_once(spark, tmp_path):
    upload = lambda k, text="# A\\n\\nbody": (f"B{k}", None if k % 2 else "c", [(0, "p.pdf", f"1\n{text} {k}", f"h{k}")])
    corpora = spark.createDataFrame([("c",)], "id string")
    for i, keys in enumerate(([1, 2, 3], [2, 3, 4], [4, 4, 5, 1])):
        spark.createDataFrame([upload(k) for k in keys] + [("empty", None, [])], flows.UPLOAD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i != 1:  # the second and third come as two batches of one run
            flows.ingest_books(flows.follow(spark, f"{tmp_path}/in", 1), corpora, f"{tmp_path}/out")
        time.sleep(1.1)
    got = flows.book_tables(spark, f"{tmp_path}/out")
    every = spark.createDataFrame([upload(k) for k in range(1, 6)], flows.UPLOAD).select("title", "corpus_id", F.explode("files").alias("f")).select("title", "corpus_id", "f.*")
    want = ingest.ingested(every, spark.createDataFrame([], "id string"), corpora)
    for name in flows.BOOK_TABLES:
        assert sorted(map(str, got[name].select(*want[name].columns).collect())) == sorted(map(str, want[name].collect())), name
    # a batch without its marker is not there yet
    spark.createDataFrame([("x", "y")], "id string, title string").write.parquet(f"{tmp_path}/out/book/n=99")
    assert flows.book_tables(spark, f"{tmp_path}/out")["book"].count() == 5


def test_a_grade_out_of_range_is_an_error():
    assert flows.review_step(2.5, 6, 2, 4) == (2.5, 15, 3)
    assert flows.review_step(2.6, 15, 3, 2) == (2.6, 1, 0)
    for grade in (-1, 6, 100):
        with pytest.raises(ValueError):
            flows.review_step(2.5, 0, 0, grade)


def test_finished_tasks_stay(spark):
    rows = spark.createDataFrame([(1, "completed", None), (2, "running", None), (3, "queued", "old")], "id int, status string, error string")
    asked = spark.createDataFrame([(1, "failed", "x"), (2, "failed", "y" * 3000)], "id int, to string, message string")
    got = {r.id: r for r in records.moved(rows, asked).collect()}
    assert (got[1].status, got[1].error, got[2].status, len(got[2].error), got[3].status, got[3].error) == ("completed", None, "failed", 2000, "queued", "old")


def test_profiles_are_ambiguous_without_a_name(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "corpus_id string, id int, name string")
    assert {r.corpus_id: r.id for r in records.sole_profile(rows).collect()} == {"a": None, "b": 3}
    assert {r.corpus_id: r.id for r in records.sole_profile(rows, "y").collect()} == {"a": 2, "b": 3}


def test_names_keep_their_first_place(spark):
    rows = spark.createDataFrame([("t", 1, ["b", "a"]), ("t", 0, ["c", "b", "b"]), ("t", 2, None), ("u", 0, [])], "t string, o int, names array<string>")
    got = records.ordered_union(rows, "t", "o", "names").orderBy("position").collect()
    assert [(r.t, r["name"], r.position) for r in got] == [("t", "c", 0), ("t", "b", 1), ("t", "a", 2)]


def test_cards_pass_over_what_is_malformed(spark):
    rows = spark.createDataFrame([(1, '{"cards": [{"id": "a", "front": "f"}, {"front": "g"}, {"id": " "}]}'), (2, "{"), (3, None), (4, '{"cards": 1}')], "id int, content string")
    assert [(r.set_id, r.card) for r in records.cards(rows).collect()] == [(1, "a")]
