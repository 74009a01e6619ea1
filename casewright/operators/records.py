"""Lookups, listings and state changes over a corpus's records: profiles, artifacts, tasks, turns and cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The states that a task never leaves, and the length of a kept error.
TERMINAL = ["completed", "failed", "cancelled"]
ERROR_CHARS = 2000
CARDS = "array<struct<id:string,front:string,back:string>>"


def sole_profile(profiles: DataFrame, name: str | None = None) -> DataFrame:
    """(corpus_id, id): the profile of this name, else the corpus's only profile; null where that is ambiguous."""
    named = F.min(F.when(F.col("name") == F.lit(name), F.col("id")))
    only = F.when(F.count(F.lit(1)) == 1, F.min("id"))
    return profiles.groupBy("corpus_id").agg(F.coalesce(named, only).alias("id"))


def gated(wanted: DataFrame, artifacts: DataFrame, kind: str) -> DataFrame:
    """Each wanted id with ``problem``: missing, another type, or null where the artifact is of this kind."""
    found = wanted.join(artifacts.select("id", F.col("type").alias("_type")), "id", "left")
    problem = F.when(F.col("_type").isNull(), "missing").when(F.col("_type") != kind, F.concat(F.lit("type is "), "_type"))
    return found.withColumn("problem", problem).drop("_type")


def memo_sources(wanted: DataFrame, artifacts: DataFrame, kind: str = "memo") -> tuple[DataFrame, DataFrame]:
    """Memos (id, markdown, path) of the wanted ids, and a warning for each id that has none.

    A memo without a path gets one that names its id.
    """
    df = gated(wanted, artifacts, kind).join(artifacts.select("id", "markdown", "path"), "id", "left")
    problem = F.coalesce("problem", F.when(F.coalesce(F.trim("markdown"), F.lit("")) == "", F.lit("no markdown")))
    df = df.withColumn("problem", problem)
    path = F.coalesce(F.nullif(F.trim("path"), F.lit("")), F.concat(F.lit("artifact://"), F.col("id").cast("string")))
    return df.where("problem IS NULL").select("id", "markdown", path.alias("path")), df.where("problem IS NOT NULL").select("id", "problem")


def tasks(rows: DataFrame, limit: int = 50, **equal) -> DataFrame:
    """The newest tasks whose columns equal the values given; None asks nothing."""
    for name, value in equal.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def moved(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Tasks (id, status, error) after the asked changes (id, to, message), one a task; finished tasks stay as they are.

    Messages may be far larger than the files that they are estimated by, so no side is broadcast; only what is kept of them is moved.
    """
    kept = F.when(F.col("to") == "failed", F.left("message", F.lit(ERROR_CHARS)))
    df = rows.join(asked.select("id", "to", kept.alias("message")).hint("merge"), "id", "left")
    go = F.col("to").isNotNull() & ~F.col("status").isin(*TERMINAL)
    error = F.when(go & (F.col("to") == "failed"), F.col("message")).otherwise(F.col("error"))
    return df.withColumns({"error": error, "status": F.when(go, F.col("to")).otherwise(F.col("status"))}).drop("to", "message")


def health(tables: dict[str, DataFrame], needed: list[str]) -> DataFrame:
    """(name, n, state) a table: ``empty`` where a needed one has no rows."""
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in tables.items()]
    state = F.when((F.col("n") == 0) & F.col("name").isin(*needed), "empty").otherwise("ok")
    return reduce(DataFrame.unionByName, counts).withColumn("state", state)


def primary_book(books: DataFrame) -> DataFrame:
    """Each corpus's book that was ingested first."""
    return books.groupBy("corpus_id").agg(F.min_by("id", F.struct("ingested_at", "id")).alias("book_id"))


def ordered_union(rows: DataFrame, key: str, order: str, array: str) -> DataFrame:
    """(key, name, position): the names of all lists of a key, each once, numbered by where it came first."""
    seen = rows.select(key, order, F.posexplode(array).alias("_i", "name"))
    first = seen.groupBy(key, "name").agg(F.min(F.struct(order, "_i")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return first.withColumn("position", rank).select(key, "name", "position")


def cited_text(refs: DataFrame, blocks: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(key, text): the markdown of the cited blocks in reading order, a blank line between; unknown ids add nothing.

    The text is what a prompt of the artifact holds, so its blocks are gathered in one row.
    """
    found = refs.select(key, F.col("ref").alias("id")).distinct().join(blocks.select("id", "book_id", "source_page", "order_index", "markdown"), "id")
    rows = F.array_sort(F.collect_list(F.struct("book_id", "source_page", "order_index", "id", "markdown")))
    return found.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["markdown"]), "\n\n").alias("text"))


def indented(title: Column, level: Column) -> Column:
    """A contents title after two blanks a level below the first."""
    return F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0)).cast("int")), title)


def next_turn(turns: DataFrame, key: str = "transcript_id") -> DataFrame:
    """(key, turn): one more than the professor's turns so far."""
    return turns.groupBy(key).agg((F.count_if(F.col("speaker") == "professor") + 1).alias("turn"))


def elapsed(start: Column, at: Column) -> Column:
    """Whole seconds from the start, never under 0."""
    return F.greatest(F.timestamp_diff("SECOND", start, at), F.lit(0))


def progress(floor: Column, ceiling: Column, done: Column, total: Column) -> Column:
    """Where a step that runs from floor to ceiling stands when ``done`` of ``total`` is done."""
    share = F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return floor + (ceiling - floor) * share


def cards(artifacts: DataFrame) -> DataFrame:
    """(set_id, card, front, back) from the artifacts' JSON; malformed sets and cards without an id are passed over."""
    held = F.from_json(F.get_json_object("content", "$.cards"), CARDS)
    df = artifacts.select(F.col("id").alias("set_id"), F.explode(held).alias("c")).where("c.id IS NOT NULL AND trim(c.id) <> ''")
    return df.select("set_id", F.col("c.id").alias("card"), "c.front", "c.back")
