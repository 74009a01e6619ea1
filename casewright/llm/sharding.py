"""Sharding: a hierarchical weighted hash tree.

A row descends from the root through a region and a rack to a shard. At each level every child draws
``ln(u) / weight`` with u in (0, 1] hashed from the row's key and the child's name, and the greatest draw
wins, so a child gets rows in proportion to its weight. A draw does not depend on the other children:
when weights change below one child, rows only move into or out of that child's subtree. An added shard
stands in a region of its own, so it takes rows only into itself.

Null keys count as the empty key; equal keys always share a shard. An empty table gives an empty result. Texts of any
length give two numbers each; null text has no bytes. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import id_blocks, slots, whole_text

#: regions -> racks -> (shard, weight)
Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards 0.. in regions of ``racks`` racks of ``per_rack`` shards, each of weight 1."""
    ids = list(range(shards))
    held = [ids[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [[[(s, 1.0) for s in rack] for rack in held[i : i + racks]] for i in range(0, len(held), racks)]


def grown(t: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*t, [[(1 + max((s for g in t for r in g for s, _ in r), default=-1), weight)]]]


def _draw(key: Column, node: Column, weight: Column) -> Column:
    # 52 bits of MD5 in (0, 1]; a weight of 0 never wins
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), node)), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return F.when(weight > 0, F.log(u) / weight)


def _pick(key: Column, prefix: Column | None, weights: list[Column]) -> Column:
    """The index of the child with the greatest draw; the least index wins a tie."""
    rows = []
    for i, w in enumerate(weights):
        node = F.lit(str(i)) if prefix is None else F.concat(prefix, F.lit(f"/{i}"))
        rows.append(F.struct(_draw(key, node, w).alias("d"), F.lit(-i).alias("i")))
    return -F.array_max(F.filter(F.array(*rows), lambda x: x["d"].isNotNull()))["i"]


def _table(values: list) -> Column:
    return F.array(*[_table(v) if isinstance(v, list) else F.lit(v) for v in values])


def place(df: DataFrame, key: Column, t: Tree, name: str = "shard") -> DataFrame:
    """Add the shard of each row: one draw per child at each of the three levels, no shuffle."""
    racks = max(len(g) for g in t)
    width = max(len(r) for g in t for r in g)
    leaf = [[[(r[j] if j < len(r) else (-1, 0.0)) for j in range(width)] for r in [*g, *[[]] * (racks - len(g))]] for g in t]
    rack_w = _table([[sum(w for _, w in r) for r in g] for g in leaf])
    leaf_w = _table([[[w for _, w in r] for r in g] for g in leaf])
    leaf_s = _table([[[s for s, _ in r] for r in g] for g in leaf])
    k, g, r = f"_{name}_k", f"_{name}_g", f"_{name}_r"
    df = df.withColumn(k, F.coalesce(key.cast("string"), F.lit("")))
    df = df.withColumn(g, _pick(F.col(k), None, [F.lit(float(sum(w for rack in region for _, w in rack))) for region in t]))
    at = F.col(g).cast("string")
    df = df.withColumn(r, _pick(F.col(k), at, [rack_w[F.col(g)][i] for i in range(racks)]))
    at = F.concat(at, F.lit("/"), F.col(r).cast("string"))
    leaf_i = _pick(F.col(k), at, [leaf_w[F.col(g)][F.col(r)][i] for i in range(width)])
    df = df.withColumn(f"_{name}_l", leaf_i)
    return df.withColumn(name, leaf_s[F.col(g)][F.col(r)][F.col(f"_{name}_l")]).drop(k, g, r, f"_{name}_l")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place documents by doc_id and number them inside each shard by doc_id.

    Only doc_id, two numbers of the text and the shards are shuffled, never the text. Rows of one
    doc_id are ordered by their text's CRC and size; rows equal in all of these are alike.
    """
    t = tree(shards)
    text = whole_text()
    crc = F.crc32(text.cast("binary")).cast("long")
    block = id_blocks(docs, "doc_id", F.col("text_crc32") / F.lit(float(1 << 32)))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"))
    rows = rows.withColumn("_block", block)
    rows = place(place(rows, F.col("doc_id"), t, "shard"), F.col("doc_id"), grown(t), "grown_shard")
    rows = slots(rows, "shard", "_block", [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
