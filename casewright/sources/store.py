"""A stored table of pages or blocks, laid out for retrieval by book and page.

Books are hashed into buckets, each a folder; rows are dealt by ranges of (bucket, book, page, order), so a bucket of one
huge book spans several files, and each file is sorted. A retrieval of one book's pages therefore lists one folder and
reads the row groups and pages whose statistics hold the book and the pages. The number of buckets is kept with the
schema. Rows without a book are kept in the bucket of null and found by no retrieval of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READING = ["book_id", "source_page", "order_index", "id"]
#: Rows a bucket holds on average, buckets at most, rows dealt to a task, bytes of a row group, rows of a page of it.
BUCKET_ROWS, MOST, TASK_ROWS, GROUP_BYTES, PAGE_ROWS = 4_000_000, 65_536, 200_000, 16 << 20, 2000


def bucket_of(book_id: Column, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(book_id), F.lit(buckets)).cast("int"), F.lit(-1))


def tasks_of(count: int) -> int:
    """So many tasks that each can sort its rows in memory, however many there are."""
    return max(1, -(-count // TASK_ROWS))


def write(rows: DataFrame, path: str, buckets: int | None = None, mode: str = "errorifexists", late: dict[str, Column] | None = None, count: int | None = None) -> None:
    """Write the table; ``buckets`` is chosen by the number of rows unless given. A failed write can be repeated with mode overwrite.

    ``late`` are columns made of the others when rows are written, so that long texts are neither shuffled nor sorted.
    ``count`` is the number of rows, where it is known.
    """
    count = rows.count() if count is None else count
    n = buckets or max(1, min(MOST, -(-count // BUCKET_ROWS)))
    order = [c for c in READING if c in rows.columns]
    kept = rows.withColumn("bucket", F.when(F.col("book_id").isNull(), -1).otherwise(bucket_of(F.col("book_id"), n)))
    kept = kept.withColumn("book_id", F.col("book_id").alias("book_id", metadata={"buckets": n}))
    dealt = kept.repartitionByRange(tasks_of(count), "bucket", *order).sortWithinPartitions("bucket", *order)
    dealt = dealt.withColumns(late or {})
    dealt.write.mode(mode).option("parquet.block.size", str(GROUP_BYTES)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def buckets(rows: DataFrame) -> int | None:
    """How many buckets the table has, None if the rows are of no stored table."""
    if "bucket" not in rows.columns or "book_id" not in rows.columns:
        return None
    return rows.schema["book_id"].metadata.get("buckets")


def of_book(rows: DataFrame, book_id) -> Column:
    """The condition that a row is the book's; of a stored table also that it lies in the book's folder."""
    mine = F.col("book_id") == book_id
    n = buckets(rows)
    return mine if not n else mine & (F.col("bucket") == bucket_of(F.lit(book_id).cast(rows.schema["book_id"].dataType), n))


def spans(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each asked span (request, book_id, start, end), with the request.

    The join is on the folder and the book, so few spans read the folders of their books only, and many are joined by a
    shuffle of both sides.
    """
    want = asked.where("start <= end").select("request", F.col("book_id").cast(rows.schema["book_id"].dataType).alias("_book"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    n = buckets(rows)
    on = (F.col("book_id") == F.col("_book")) & F.col("source_page").between(F.col("_start"), F.col("_end"))
    if n:
        want = want.withColumn("_bucket", bucket_of(F.col("_book"), n))
        on = on & (F.col("bucket") == F.col("_bucket"))
    return rows.join(want, on).drop("_book", "_start", "_end", "_bucket")
