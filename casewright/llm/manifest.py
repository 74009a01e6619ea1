"""Merkle manifest of a dataset: a tree of digests per language and one root above them.

Each row's leaf is hashed in the scan, and only ids and digests are shuffled from there on. Leaves of a language
are numbered by (doc_id, leaf) without a gap and gathered in aligned blocks of ARITY ** LEVELS. One task walks a
block recursively in postorder: a call returns its subtree's digest and, while unwinding, appends the siblings of
each child to the leaves below that child. The blocks' roots are the leaves of the next traversal, until one root a
language is left; the languages' subroots, in order, go through the same traversals. What the upper traversals say
of a block is joined to it for a second walk, in which each leaf gets all its siblings and is folded to the root.

A last run of fewer than ARITY nodes, even of one, is hashed like others; a lone leaf is its language's subroot.
Null values count as ``-``; rows without a doc_id come first in their language and are never tampered with; rows
without a language are one language, the first. Rows that share a doc_id are ordered by their leaf; rows equal in
all five columns are interchangeable leaves of their own, numbered in one range. An empty table has no root and
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import cut, ship

ARITY, LEVELS = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """The digest of a row; ``text`` stands in for its text."""
    parts = [encoded(F.col(c) if text is None or c != "text" else text) for c in COLUMNS]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; texts of one byte a character take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def walk(leaves: list[str], height: int, arity: int = ARITY) -> tuple[str, list[list[str]], list[list[int]]]:
    """(root, siblings of each leaf, [siblings before, siblings after, ...] of each leaf) of one block.

    Siblings are listed level by level from the leaf up, left to right; the second list says at each level how many of
    them stand left and right of the node.
    """
    siblings: list[list[str]] = [[] for _ in leaves]
    places: list[list[int]] = [[] for _ in leaves]

    def visit(lo: int, hi: int, level: int) -> str:
        if level == 0:
            return leaves[lo]
        step = arity ** (level - 1)
        cuts = list(range(lo, hi, step))
        digests = [visit(x, min(x + step, hi), level - 1) for x in cuts]
        for k, x in enumerate(cuts):
            others = digests[:k] + digests[k + 1 :]
            for i in range(x, min(x + step, hi)):
                siblings[i] += others
                places[i] += (k, len(others) - k)
        return sha(digests)

    return visit(0, len(leaves), height), siblings, places


def fold(leaf: str, siblings: list[str], places: list[int]) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for left, right in zip(places[::2], places[1::2], strict=True):
        leaf = sha([*siblings[at : at + left], leaf, *siblings[at + left : at + left + right]])
        at += left + right
    return leaf


def _height(n: int, block: int, arity: int, levels: int) -> int:
    """How many levels a block has: all if its tree has others, else as many as bring its n leaves to one node."""
    height = levels if block else 0
    while arity**height < n:
        height += 1
    return height


def _roots(arity: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for block, nodes in zip(batch.column("block").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                roots.append(walk([x["leaf"] for x in nodes], _height(len(nodes), block, arity, levels), arity)[0])
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(roots, pa.string())], ["tree", "block", "leaf"])

    return run


def _each_block(batches: Iterator[pa.RecordBatch], arity: int, levels: int):
    """(row, first rank, nodes, siblings and places of each up to the top) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            siblings, places = walk([x["leaf"] for x in row["nodes"]], _height(len(row["nodes"]), row["block"], arity, levels), arity)[1:]
            whole = [(s + row["siblings"], p + row["places"]) for s, p in zip(siblings, places, strict=True)]
            yield row, row["block"] * arity**levels, row["nodes"], whole


def _proofs(arity: int, levels: int):
    """Each node of a block with its siblings and places up to the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, first, nodes, whole in _each_block(batches, arity, levels):
            cols = [
                pa.array([row["tree"]] * len(nodes), pa.string()), pa.array(range(first, first + len(nodes)), pa.int64()),
                pa.array([s for s, _ in whole], pa.list_(pa.string())), pa.array([p for _, p in whole], pa.list_(pa.int32())),
                pa.array([row["tops"]] * len(nodes), pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["tree", "rank", "siblings", "places", "tops"])

    return run


def _verdicts(arity: int, levels: int):
    """Each leaf with its proof's digest and the root that its tampered, else its own leaf gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, nodes, whole in _each_block(batches, arity, levels):
            subroot, root = row["tops"]
            folded = [fold(x["tampered"] or x["leaf"], *w) for x, w in zip(nodes, whole, strict=True)]
            cols = [
                pa.array([x["doc_id"] for x in nodes], pa.int64()), pa.array([x["leaf"] for x in nodes]), pa.array([subroot] * len(nodes)), pa.array([root] * len(nodes)),
                pa.array([sha(s) for s, _ in whole]), pa.array(folded), pa.array([f == root for f in folded]),
            ]
            yield pa.RecordBatch.from_arrays(cols, NAMES)

    return run


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rank``: each tree's rows numbered from 0 by ``order`` without a gap.

    Rows are dealt by ranges of (tree, order), numbered inside a range and moved up by the counts of the ranges before.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = cut(rows.repartitionByRange(F.col(tree).asc(), *keys).withColumn("_b", F.spark_partition_id()))
    counts = dealt.groupBy(tree, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(tree).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(tree, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(tree, "_b").orderBy(*keys)) - 1)
    return inside.join(first, [tree, "_b"]).withColumn("rank", F.col("_r") + F.col("_first")).drop("_b", "_r", "_first")


_ABOVE = "tree string, rank long, siblings array<string>, places array<int>, tops array<string>"


def _climb(nodes: DataFrame, columns: list[str], finish, arity: int, levels: int) -> DataFrame:
    """The aligned blocks of each tree (tree, block, nodes in order) with the siblings, places and tops above them.

    ``finish`` gives them (tree, siblings, places, tops) to trees of one block from their roots (tree, leaf).
    """
    block = F.floor(F.col("rank") / F.lit(arity**levels)).alias("block")
    blocks = cut(nodes.groupBy("tree", block).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("nodes")))  # arity ** levels nodes at most
    roots = cut(blocks.mapInArrow(_roots(arity, levels), "tree string, block long, leaf string"))
    if roots.where("block > 0").isEmpty():
        return blocks.join(finish(roots.select("tree", "leaf")), ["tree"])
    above = _climb(roots.select("tree", F.col("block").alias("rank"), "leaf"), ["leaf"], finish, arity, levels)
    return blocks.join(above.mapInArrow(_proofs(arity, levels), _ABOVE).withColumnRenamed("rank", "block"), ["tree", "block"])


def build(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    ship(docs.sparkSession)
    none = [F.array().cast("array<string>").alias("siblings"), F.array().cast("array<int>").alias("places")]

    def root_of_all(roots: DataFrame) -> DataFrame:
        return roots.select("tree", *none, F.array("leaf").alias("tops"))

    def over_languages(subroots: DataFrame) -> DataFrame:
        ranked = cut(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf"), "tree", ["name"]))
        proofs = _climb(ranked.select("tree", "rank", "leaf"), ["leaf"], root_of_all, arity, levels).mapInArrow(_proofs(arity, levels), _ABOVE)
        return proofs.drop("tree").join(ranked.drop("tree"), ["rank"]).select(F.col("name").alias("tree"), "siblings", "places", F.concat(F.array("leaf"), "tops").alias("tops"))

    # a name that orders null first
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    tampered = F.when(is_tampered(F.col("doc_id")), leaf_of(lower_ascii(F.col("text"))))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_of().alias("leaf"), tampered.alias("tampered")))
    ranked = numbered(rows, "tree", ["doc_id", "leaf"])
    blocks = _climb(ranked, ["doc_id", "leaf", "tampered"], over_languages, arity, levels)
    types = ["long", *["string"] * 5, "boolean"]
    return blocks.mapInArrow(_verdicts(arity, levels), ", ".join(f"{n} {t}" for n, t in zip(NAMES, types, strict=True)))
