"""Findings of round 3, second part: rows of one value, contents and books in one pass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casewright.operators import ingest, resolve, retrieve, segment, verify


@pytest.fixture
def plain_joins(spark):
    """No join is made a broadcast by the planner, no partition is dealt anew."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_mentions_of_one_name_are_dealt_to_many_tasks(spark, plain_joins, monkeypatch):
    monkeypatch.setattr(resolve, "SHARE", 50, raising=False)
    joined = []
    texts = spark.range(600).select("id", F.concat(F.lit("see Alpha v. Beta and "), F.when(F.col("id") == 7, "Gamma v. Delta").otherwise("none")).alias("text"))

    def watch(name):
        plain = getattr(resolve.DataFrame, name)

        def run(self, key, *rest):
            out = plain(self, key, *rest)
            if key == "hit":  # the first column after mentions met their names
                joined.append(self.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
            return out

        monkeypatch.setattr(resolve.DataFrame, name, run)

    kind = type(texts)
    monkeypatch.setattr(resolve, "DataFrame", kind)
    watch("withColumn")
    got = resolve.resolve(texts, spark.createDataFrame([("Alpha v. Beta",), ("Gamma v. Delta",)], "name string"))
    rows = got.groupBy("canonical").count().collect()
    assert {r[0]: r[1] for r in rows} == {"Alpha v. Beta": 600, "Gamma v. Delta": 1}
    assert len(joined) == 1 and joined[0] < 400, joined


def test_contents_of_a_book_are_found_in_its_row(spark):
    """No line is moved: the plan has no exchange and no window; parents, pages and the block's end are as they were."""
    text = "# Before\nTable of Contents\nOne ..... 1\n    Two | 12\n# Three .... 20\n# After\nFour .... 9"
    books = spark.createDataFrame([(1, text), (2, "# A\n1\n## B\n2\n### C\n## D"), (3, None)], "book_id long, markdown string")
    got = segment.toc(segment.page_markers(books))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert sorted(map(tuple, got.select("book_id", "order_index", "level", "title", "source_page", "parent_index").collect())) == [
        (1, 0, 1, "One", 1, None), (1, 1, 2, "Two", 12, 0), (1, 2, 1, "Three", 20, None),
        (2, 0, 1, "A", 1, None), (2, 1, 2, "B", 1, 0), (2, 2, 3, "C", 2, 1), (2, 3, 2, "D", 2, 0),
    ]


def test_books_are_stitched_and_marked_once(spark):
    """Pages, blocks and contents are read from the marked books: none stitches, joins or marks again."""
    rows = [("T", None, 1, "b.pdf", "2\n## B\ntext", "s2"), ("T", None, 0, "a.pdf", "1\n# A\nwords", "s1"), ("U", "gone", 0, "c.pdf", "1\nx", "s3")]
    files = spark.createDataFrame(rows, "title string, corpus_id string, part int, path string, markdown string, sha256 string")
    none = spark.createDataFrame([], "id string")
    out = ingest.ingested(files, none, none)
    assert {(r.title, r.state) for r in out["request"].collect()} == {("T", "new corpus"), ("U", "corpus not found")}
    assert [(r.title, r.source_page_min, r.source_page_max) for r in out["book"].collect()] == [("T", 1, 2)]
    for name, n in (("page", 2), ("block", 3), ("toc_entry", 2)):
        assert "Exchange" not in out[name]._jdf.queryExecution().executedPlan().toString(), name
        assert out[name].count() == n, name


def test_equal_texts_of_a_batch_are_walked_once(spark):
    texts = ['{"source_block_ids": ["b", "a", "b", 3]}', "no json", None, "", '{"x": [{"sources": [{"kind": "block", "id": "c"}]}]}']
    walk = verify.cited_ids(F.col("t")).alias("ids")
    rows = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "i int, t string").coalesce(1).select("i", walk)
    assert [r.ids for r in rows.orderBy("i").collect()] == [["b", "a"], [], [], [], ["c"]] * 10


def test_trails_are_found_by_one_sort(spark):
    kinds = ["narrative_text", "case_opinion", "header", "case_header", "header", "case_opinion", "case_opinion", "footnote"]
    blocks = spark.createDataFrame([(10 * b + i, b, 1, i, k) for b in (1, 2) for i, k in enumerate(kinds)], "id long, book_id long, source_page int, order_index int, type string")
    got = retrieve.case_trails(blocks)
    assert sorted((r.id, r.opinion_id, r.case_no) for r in got.collect()) == [(10 * b + i, 10 * b + o, n) for b in (1, 2) for i, o, n in ((1, 1, 1), (2, 1, 1), (5, 5, 3), (6, 6, 4), (7, 6, 4))]
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1
