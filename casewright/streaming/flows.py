"""The ledger's totals, the cards' review states and the ingestion of books as streams.

A stream is written to a table of one folder a batch, so a batch that is run again after a loss replaces its
own folder; ``latest`` reads the last state of every key. State is bounded by the keys: one row a card, and
one a day and feature (days older than the watermark are dropped in append mode).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casewright.functions.session import scratch, ship
from casewright.operators import ingest
from casewright.operators.study import START
from casewright.sources.archive import book_id

STATE = "ease double, interval int, reps int"


def follow(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A folder or file of Parquet as a stream with the schema that it has now. As a glob of one name, it may be a single file."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{parent}/{{{name}}}")


def daily_costs(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, feature, total) of a stream of ledger rows; rows later than ``late`` are no longer counted."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "feature")
    return days.agg(F.sum("total_cost_usd").alias("total")).select(F.to_date("window.start").alias("day"), "feature", "total")


def check_grade(grade: int) -> None:
    if not 0 <= grade <= 5:
        raise ValueError(f"grade outside 0 to 5: {grade}")


def review_step(ease: float, interval: int, reps: int, grade: int) -> tuple[float, int, int]:
    """The state of a card after one review; the same rule as in the batch form."""
    check_grade(grade)
    if grade < 3:
        return ease, 1, 0
    miss = 5 - grade
    ease = max(1.3, ease + (0.1 - miss * (0.08 + miss * 0.02)))
    return ease, 1 if reps == 0 else 6 if reps == 1 else max(1, round(interval * ease)), reps + 1


class _Reviews(StatefulProcessor):
    """A card's state up to the watermark, and the reviews after it, which may still be joined by earlier ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", f"{STATE}, last long")
        self.waiting = handle.getListState("waiting", "at long, seq long, grade int")

    def _now(self) -> tuple[tuple[float, int, int], int | None]:
        if not self.settled.exists():
            return (START["ease"], START["interval"], START["reps"]), None
        ease, interval, reps, last = self.settled.get()
        return (ease, interval, reps), last

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        arrived = [x for f in rows for x in zip(f["micros"].tolist(), f["seq"].tolist(), f["grade"].tolist(), strict=True)]
        for _, _, grade in arrived:
            check_grade(grade)
        waiting = sorted([*map(tuple, self.waiting.get()), *arrived])
        self.waiting.put(waiting)
        # wakes when the first of them can't be preceded any more
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(waiting[0][0] // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        state, last = self._now()
        for _, _, grade in waiting:
            state = review_step(*state, grade)
        last = max(waiting[-1][0], last) if last is not None else waiting[-1][0]
        yield pd.DataFrame({"card": [key[0]], "ease": [round(state[0], 6)], "interval": [state[1]], "reps": [state[2]], "last_at": [pd.Timestamp(last, unit="us")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        state, last = self._now()
        waiting = sorted(map(tuple, self.waiting.get()))
        due = [x for x in waiting if x[0] // 1000 < passed]
        for at, _, grade in due:
            state, last = review_step(*state, grade), at
        if due:
            self.settled.update((*state, last))
        rest = waiting[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][0] // 1000 + 1, passed + 1))
        else:
            self.waiting.clear()
        yield pd.DataFrame({"card": [], "ease": [], "interval": [], "reps": [], "last_at": []}).astype({"card": str, "ease": float, "interval": "int32", "reps": "int32", "last_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def review_states(log: DataFrame, late: str = "30 days") -> DataFrame:
    """The state of each card that a batch of reviews (card, at, seq, grade) changes.

    Reviews may come in any order within ``late`` of the latest: a card keeps those that the watermark hasn't passed and counts
    all of them in order of (at, seq) each time, so what comes out last is the batch form's result. What the watermark
    has passed is settled and takes no room; a review that comes later than that is left out, as elsewhere in streams.
    The session's state store must be one that keeps timers (RocksDB), which is set here.
    """
    spark = log.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = log.schema["at"].dataType.simpleString()
    timed = log.select("card", F.col("at").cast("timestamp").alias("event_time"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), F.col("seq").cast("long").alias("seq"), F.col("grade").cast("int").alias("grade")).withWatermark("event_time", late)
    out = timed.groupBy("card").transformWithStateInPandas(_Reviews(), f"card string, {STATE}, last_at timestamp_ntz", "Update", "EventTime")
    return out.withColumn("last_at", F.col("last_at").cast(kind))


def drained(stream: DataFrame, mode: str = "update", path: str | None = None) -> str:
    """Run a stream over all that is there now and return the folder of its table."""
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/table/n={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return f"{path}/table"


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of every key."""
    rows = spark.read.parquet(path).drop("n")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


# -- books ----------------------------------------------------------------------------------------------

UPLOAD = "title string, corpus_id string, files array<struct<part:int,path:string,markdown:string,sha256:string>>"
BOOK_TABLES = ("request", "book", "page", "block", "toc_entry")


def first_uploads(uploads: DataFrame) -> DataFrame:
    """A stream of uploads (UPLOAD) without those whose files have come before: their hashes in order are the book's id, which state keeps.

    The id stands for the files' hashes, as bytes, so that they are not shuffled with the texts.
    """
    files = F.array_sort("files")
    texts = F.transform(files, lambda x: F.struct(*[x[c].alias(c) for c in ("part", "path", "markdown")]))
    rows = uploads.where(F.size("files") > 0).select(F.unhex(book_id(F.transform(files, lambda x: x["sha256"]))).alias("book_id"), "title", "corpus_id", texts.alias("files"))
    return rows.dropDuplicates(["book_id"])


def ingest_books(uploads: DataFrame, corpora: DataFrame, path: str) -> str:
    """Ingest the uploads that are there now and return the folder of the tables, which ``book_tables`` reads.

    Each batch writes its own folder of every table, and its marker last, so a batch that is run again after a loss
    replaces what it had begun and a reader sees whole batches only. Run again over a folder to which files were added,
    it goes on where it ended; books that came before, in whatever file, are not ingested again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # an upload is a whole book, and what comes of the batch's state is read once
        files = F.transform("files", lambda x: F.struct(*[x[c].alias(c) for c in ("part", "path", "markdown")], ingest.page_offsets(x["markdown"]).alias("offsets")))
        books = ingest.stitched(batch.select(F.lower(F.hex("book_id")).alias("book_id"), "title", "corpus_id", files.alias("f")))
        for name, rows in ingest.ingested_books(books, None, corpora).items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/n={number}")
        spark.range(1).select(F.lit(number).alias("n")).write.mode("overwrite").json(f"{path}/batches/n={number}")

    first_uploads(uploads).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return path


def book_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of all whole batches."""
    whole = spark.read.json(f"{path}/batches").select("n").distinct()
    return {name: spark.read.parquet(f"{path}/{name}").join(F.broadcast(whole), "n", "left_semi").drop("n") for name in BOOK_TABLES}
