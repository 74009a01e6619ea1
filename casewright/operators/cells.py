"""Nearest vectors through cells: an index that covers every row, fitted on a bounded sample, with exact ranking of what is probed.

Cells are the centres of k-means over unit vectors of at most SAMPLE rows, chosen by a hash. Every row lies in the cell of its
nearest centre. A query looks into the cells of its ``probes`` nearest centres and ranks their rows by cosine exactly; so
what is found is exact, and the share of the true neighbours found is the recall, which ``recall`` measures and
``probes_for`` reaches: vectors without clusters need many cells, clustered ones few. A cell of
any size is dealt into blocks of about ROWS rows; a task ranks one block for the queries that look into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions.session import cut, ship
from casewright.operators.retrieve import _closest, nearest

SAMPLE, MOST_CELLS, ROWS = 20_000, 1024, 4096


def centres(vectors: DataFrame, n_cells: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """The unit centres (cells x dimensions) of a sample of ``sample`` rows at most; by default about the root of the rows' number."""
    n = vectors.where("embedding IS NOT NULL").count()
    cells = n_cells or max(1, min(MOST_CELLS, round(n**0.5)))
    drawn = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding")
    got = drawn.toArrow()["embedding"]  # bounded by the sample
    if not len(got):
        return np.zeros((1, 1))
    x = np.array(got.to_pylist(), float)
    if not (np.linalg.norm(x, axis=1) > 0).any():
        return np.zeros((1, x.shape[1]))
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rng = np.random.Generator(np.random.PCG64(10))
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def _assigned(c: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, c.shape[1])
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def _with_cells(vectors: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select("vec_id", "embedding").schema.fields)
    return vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(_assigned(c, probes), f"{kinds}, cells array<int>")


def index(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, embedding, cell, block of every row with a vector; kept by a checkpoint."""
    ship(vectors.sparkSession)
    rows = cut(_with_cells(vectors, c, 1).select("vec_id", "embedding", F.col("cells")[0].alias("cell")))
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))  # a row a cell
    return rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))


def near(held: DataFrame, c: np.ndarray, query: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(qid, id, cosine, rank): the k rows of greatest cosine in the cells that each query looks into, itself apart."""
    blocks = held.groupBy("cell").agg(F.max("blocks").alias("blocks"))
    asked = _with_cells(query, c, probes).select("vec_id", "embedding", F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(blocks), "cell").select("vec_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = asked.groupBy("cell", "block").cogroup(held.select("vec_id", "embedding", "cell", "block").groupBy("cell", "block")).applyInArrow(_closest(k), "qid long, id long, cosine double")
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def probes_for(held: DataFrame, c: np.ndarray, vectors: DataFrame, target: float = 0.95, k: int = 10, queries: int = 100) -> int:
    """How many cells hold ``target`` of the true neighbours of ``queries`` rows, chosen by a hash, whose neighbours are found by comparing all."""
    drawn = cut(vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(queries).select("vec_id", "embedding"))
    order = _with_cells(drawn, c, len(c)).select(F.col("vec_id").alias("qid"), F.posexplode("cells").alias("place", "cell"))
    true = nearest(vectors, drawn, k).select("qid", "id").join(held.select(F.col("vec_id").alias("id"), "cell"), "id").join(order, ["qid", "cell"])
    row = true.agg(F.percentile_approx("place", F.lit(target)).alias("p")).first()
    return 1 if row["p"] is None else min(len(c), row["p"] + 1)


def recall(found: DataFrame, vectors: DataFrame, query: DataFrame, k: int = 10) -> float:
    """The share of each query's k nearest rows, found by comparing all, that ``found`` has."""
    exact = nearest(vectors, query, k).select("qid", "id")
    row = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).first()
    return (row["hits"] or 0) / row["n"] if row["n"] else 1.0
