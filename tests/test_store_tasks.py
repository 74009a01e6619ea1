"""The stored table is written in tasks of bounded size, and its texts are those of the view."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.plans import queries
from casewright.sources import store
from casewright.sources.views import view

SF = "/root/testdata/sf0.001"


def test_tasks_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 5_000)
    rows = spark.range(40_000).select("id", F.lit(7).cast("long").alias("book_id"), (F.col("id") / 10).cast("int").alias("source_page"), F.lit(0).alias("order_index"))
    path = str(tmp_path / "blocks")
    store.write(rows, path, buckets=4, late={"text": F.concat(F.lit("page "), F.col("source_page").cast("string"))})
    held = store.read(spark, path)
    # one book fills several tasks, each with a share of its pages
    sizes = [r["count"] for r in held.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 10_000
    assert held.where("text = concat('page ', source_page)").count() == 40_000


def test_stored_blocks_are_the_views_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 1_000)
    monkeypatch.setattr(queries, "_STORED", {})
    want = view(spark, SF, "block")
    held = queries.stored_blocks(spark, SF).select(want.columns)
    assert held.dtypes == want.dtypes
    assert held.exceptAll(want).isEmpty() and want.exceptAll(held).isEmpty()
