"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of code points other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this session import this package (a cluster may use --py-files instead)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *[x for x in have if x]])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.

    Where ``spark.checkpoint.dir`` is unset, a local master gets a folder of its own; a cluster, whose machines
    share no local folder, is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, read again with the sizes of its files.

    A checkpoint keeps the size that the planner guessed; where rounds join what earlier ones joined, the guesses
    multiply until the planner spends its time on them. ``drop`` removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored``."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _numbers(values: list, kind: str) -> Column:
    """A constant array, given as one text so that the plan stays small; the optimizer folds it."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def _rank(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = _numbers(bounds, "double")
    steps = _numbers([1 << i for i in reversed(range(len(bounds).bit_length()))], "int")
    go = lambda at, step: at + F.when(F.coalesce(F.get(table, at + step - 1) <= value, F.lit(False)), step).otherwise(0)
    return F.aggregate(steps, F.lit(0), go)


def id_blocks(df: DataFrame, key: str, tie: Column, rows: int = 8192, most: int = 4096) -> Column:
    """An expression that deals rows into consecutive ranges of (key, tie), null keys first.

    The bounds are quantiles of the key by a mergeable sketch, so outliers and gaps don't widen a range; a range has
    about ``rows`` rows, and there are about ``most`` at most, so what is later gathered per range has a fixed
    bound. A key with very many rows, null included, has ranges of its own, split evenly by ``tie``, a hash of the row
    in [0, 1). Keys are compared as doubles: neighbours beyond 2^53 may share a range, but never change order.
    Only the key column is read for this.
    """
    value = F.col(key).cast("double")
    n = df.count()
    blocks = max(1, min(most, -(-n // rows)))
    bounds: list[float] = []
    if blocks > 1:
        shares = _numbers([i / blocks for i in range(1, blocks)], "double")
        found = df.agg(F.percentile_approx(value, shares, F.lit(max(10_000, 4 * blocks))).alias("q")).first()["q"] or []
        # what fills a whole range by itself is parted from what follows it
        bounds = sorted({*found, *(math.nextafter(b, math.inf) for a, b in zip(found, found[1:]) if a == b)})
    index = F.when(value.isNull(), 0).otherwise(_rank(value, bounds) + 1)
    held = df.groupBy(index.alias("b")).agg(F.count(F.lit(1)).alias("n"), (F.min(value).eqNullSafe(F.max(value))).alias("one"))
    parts = [1] * (len(bounds) + 2)
    share = max(rows, -(-n // most))
    for r in held.where(F.col("one") & (F.col("n") > 2 * share)).collect():  # at most a row a range
        parts[r["b"]] = -(-r["n"] // share)
    first = [0]
    for p in parts:
        first.append(first[-1] + p)
    inside = F.floor(tie * F.get(_numbers(parts, "int"), index)).cast("int")
    return (F.get(_numbers(first, "int"), index) + inside).cast("long")


def slots(df: DataFrame, group: str, block: str, order: list[Column], name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without a gap, in the order of (block, order).

    No task holds a whole group: rows are numbered inside (group, block), and the counts of the blocks
    before, a table of at most groups x blocks rows, give the offset.
    """
    counts = df.groupBy(group, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"), F.col(block).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, block).orderBy(*order)) - 1)
    return (
        numbered.join(F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col(block) == F.col("_b")))
        .withColumn(name, F.col("_r").cast("long") + F.col("_o"))
        .drop("_g", "_b", "_o", "_r")
    )


def let(value: Column, f) -> Column:
    """Evaluate ``value`` once and use it in ``f``; inside a lambda an expression would be evaluated per element."""
    return F.transform(F.array(value), f)[0]
