"""Fuzzy resolution of entity mentions against a list of canonical names.

Similarity is the mean of three ratios over insertions and deletions: the best window of the longer string,
the token sets, and a weighted choice of both. Its bit-parallel longest common subsequence is a small helper;
mentions are extracted and ranked by built-in expressions, and scored in Arrow batches.

The result is that of all pairs: blocks of mentions are joined with blocks of names, and a bound on the similarity,
from the counts of letters both have and from the tokens they may share, says which pairs need no scoring.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions.session import kept, ship
from casewright.functions.text import fuzzy_name, mentions

#: Names a block, mentions a block, counters of letters (letters that share one only raise the bound).
NAMES, MENTIONS, LETTERS = 4096, 2048, 40
#: Mentions of one norm that a task joins with its name.
SHARE = 100_000
#: Tokens between the parties of a case.
SEPARATORS = ("v.", "v")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u) | (s - u)
        s &= full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, at either end also with shorter windows."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    windows = [b[i : i + n] for i in range(len(b) - n + 1)]
    windows += [b[:i] for i in range(1, n)] + [b[-i:] for i in range(1, n)]
    return max(ratio(a, w) for w in dict.fromkeys(windows))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Compares what both share with what either has besides; 100 if one's tokens hold the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    pair = ratio(f"{both} {left}".strip(), f"{both} {right}".strip())
    if not both:
        return pair
    return max(pair, ratio(both, f"{both} {left}"), ratio(both, f"{both} {right}"))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    plain = ratio(a, b)
    sizes = max(len(a), len(b)) / min(len(a), len(b))
    if sizes < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if sizes <= 8 else 0.6
    tokens = max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 100.0 if set(a.split()) & set(b.split()) else 0.0)
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * tokens)


def similarity(a: str, b: str) -> float:
    return (partial_ratio(a, b) + token_set_ratio(a, b) + weighted_ratio(a, b)) / 3.0


class _Forms:
    """What the bound on the similarity needs of many strings, as arrays: lengths, letter counts and tokens as bits."""

    def __init__(self, texts: list[str]) -> None:
        tokens = [t.split() for t in texts]
        size = lambda words: sum(map(len, words)) + max(0, len(words) - 1)
        self.plain = np.array([len(t) for t in texts], np.float64)
        self.sorted = np.array([size(t) for t in tokens], np.float64)
        self.distinct = np.array([size(set(t)) for t in tokens], np.float64)
        self.counts = np.zeros((len(texts), LETTERS), np.uint16)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
        np.add.at(self.counts, (np.repeat(np.arange(len(texts)), self.plain.astype(np.int64)), points), 1)
        bit = lambda word: 1 << (zlib.crc32(word.encode("utf-8", "surrogatepass")) & 63)
        whole = [(reduce(or_, map(bit, t), 0), reduce(or_, (bit(w) for w in t if w not in SEPARATORS), 0)) for t in tokens]
        self.all, self.own = (np.array([w[k] for w in whole], np.uint64) for k in (0, 1))


def bound(a: _Forms, i: int, b: _Forms) -> np.ndarray:
    """At least ``similarity`` of the string ``i`` of ``a`` with each of ``b``.

    A common subsequence has at most the characters that both have, in any order of the tokens. Tokens are looked
    up as bits, which two may share: that only raises the bound. Without a shared token beyond the separator, what
    both share is the separator at most.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        common = np.minimum(a.counts[i], b.counts).sum(axis=1, dtype=np.float64)
        share = lambda x, y: np.where(x + y > 0, np.minimum(100.0, 200.0 * common / (x + y)), 100.0)
        short, long = np.minimum(a.plain[i], b.plain), np.maximum(a.plain[i], b.plain)
        plain, order = share(a.plain[i], b.plain), share(a.sorted[i], b.sorted)
        # a window may be as short as what it shares
        window = lambda n: np.where(n > 0, np.minimum(100.0, 200.0 * common / (n + np.minimum(common, n))), 100.0)
        part = window(short)
        joined = ((a.own[i] & b.own) > 0) | ((a.all[i] & ~b.all) == 0) | ((b.all & ~a.all[i]) == 0)
        separator = 400.0 / (2.0 + np.minimum(a.distinct[i], b.distinct))
        tokens = np.where(joined, 100.0, np.maximum(share(a.distinct[i], b.distinct), separator))
        scale = np.where(long <= 8 * short, 0.9, 0.6)
        touching = np.where((a.all[i] & b.all) > 0, 100.0, window(np.minimum(a.sorted[i], b.sorted)))
        unlike = np.maximum(plain, np.maximum(scale * part, 0.95 * scale * touching))
        weighted = np.where(long < 1.5 * short, np.maximum(plain, 0.95 * np.maximum(order, tokens)), unlike)
        return (part + tokens + weighted) / 3.0 + 1e-6


def _best(threshold: float):
    """For each mention of a block the name of the greatest similarity in a block of names, the first of equal ones, if at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mentioned, named = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                named.sort(key=lambda x: (x["name"], x["norm"]))
                norms = [x["norm"] for x in named]
                said, known = _Forms(mentioned), _Forms(norms)
                out: list[list] = [[], [], [], []]
                for i, text in enumerate(mentioned):
                    most = bound(said, i, known)
                    top, at = threshold, -1
                    maybe = np.flatnonzero(most >= threshold)
                    for j in maybe[np.argsort(-most[maybe], kind="stable")].tolist():
                        if most[j] < top:
                            break
                        s = similarity(text, norms[j])
                        if s > top or (s == top and (at < 0 or j < at)):
                            top, at = s, j
                    if at >= 0:
                        for c, v in zip(out, (text, named[at]["name"], norms[at], top), strict=True):
                            c.append(v)
                cols = [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["norm", "canonical", "canonical_norm", "score"])

    return run


def name_blocks(names: DataFrame) -> DataFrame:
    """block, named: the distinct names (name, norm) in blocks of about NAMES, of one name a norm the first.

    The table of a corpus can be written once and given to every ``resolve`` instead of the names.
    """
    first = names.where("name IS NOT NULL").select("name", fuzzy_name(F.col("name")).alias("norm")).groupBy("norm").agg(F.min("name").alias("name"))
    blocks = max(1, -(-first.count() // NAMES))
    return first.groupBy(F.pmod(F.xxhash64("norm"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("name", "norm")).alias("named"))


def scored(norms: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """norm, canonical, canonical_norm, score: the best name of each distinct norm that has one at the threshold.

    Blocks of mentions meet all blocks of names by a join on the block's number; in a task all pairs of two blocks are
    bounded at once, and only what can still be the best is scored.
    """
    ship(norms.sparkSession)
    count = blocks.agg(F.max("block")).first()[0]
    count = 0 if count is None else count + 1
    groups = max(1, -(-norms.count() // MENTIONS))
    asked = norms.groupBy(F.pmod(F.xxhash64("norm"), F.lit(groups)).alias("group")).agg(F.collect_list("norm").alias("norms"))
    each = asked.select("norms", F.explode(F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")).alias("block"))
    pairs = each.join(blocks, "block").select("norms", "named")
    found = pairs.mapInArrow(_best(threshold), "norm string, canonical string, canonical_norm string, score double")
    best = found.groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("down"), "canonical", "canonical_norm")).alias("b"))
    return best.select("norm", "b.canonical", "b.canonical_norm", (-F.col("b.down")).alias("score"))


def candidates(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, position, raw, norm) of every mention."""
    rows = texts.select(F.col(key).alias("key"), F.posexplode(mentions(F.col(text))).alias("position", "raw"))
    return rows.withColumn("norm", fuzzy_name(F.col("raw")))


def _named(found: DataFrame, got: DataFrame, counted: DataFrame) -> DataFrame:
    """The mentions with what was got for their norm, if anything. ``counted``: norm, n.

    A norm of very many mentions is dealt to tasks of about SHARE of them, each with a copy of its row.
    """
    heavy = F.broadcast(counted.where(F.col("n") > SHARE).select("norm", F.ceil(F.col("n") / SHARE).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = found.join(heavy, "norm", "left").withColumn("_part", F.pmod(F.xxhash64("key", "position"), parts).cast("int")).drop("_parts")
    copies = got.join(heavy, "norm", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, ["norm", "_part"], "left").drop("_part")


def resolve(texts: DataFrame, names: DataFrame, threshold: float = 82.0, key: str = "id", text: str = "text") -> DataFrame:
    """(key, position, raw, canonical, score, method) of every mention; unresolved ones have a null canonical.

    ``names`` has a column name, or is a table of ``name_blocks``. One mention stays per key and canonical name: exact
    before normalized before fuzzy, then the higher score, then the earlier. Mentions equal to a name after normalising
    are found by a join; each other distinct mention is scored once, whatever the number of texts that have it.
    """
    blocks = names if "named" in names.columns else name_blocks(names)
    found = candidates(texts, key, text)
    first = blocks.select(F.explode("named").alias("n")).select("n.norm", F.col("n.name").alias("canonical"))
    counted = kept(found.groupBy("norm").agg(F.count(F.lit(1)).alias("n")), "mentioned")
    mentioned = counted.select("norm")
    equal = mentioned.join(first, "norm").select("norm", "canonical", F.col("norm").alias("canonical_norm"), F.lit(100.0).alias("score"))
    others = mentioned.join(first, "norm", "left_anti")
    got = equal.unionByName(scored(others, blocks, threshold))
    df = _named(found, got, counted).withColumn("hit", F.col("canonical").isNotNull())
    rank = F.when(F.col("raw") == F.col("canonical"), 3).when(F.col("norm") == F.col("canonical_norm"), 2).otherwise(1)
    df = df.withColumn("rank", F.when(F.col("hit"), rank))
    order = Window.partitionBy("key", "hit", F.when(F.col("hit"), F.col("canonical")).otherwise(F.col("raw"))).orderBy(F.desc("rank"), F.desc("score"), "position")
    df = df.withColumn("n", F.row_number().over(order)).where("n = 1")
    method: Column = F.element_at(F.array(F.lit("fuzzy"), F.lit("normalized"), F.lit("exact")), F.col("rank"))
    return df.select("key", "position", "raw", F.when(F.col("hit"), F.col("canonical")).alias("canonical"), F.when(F.col("hit"), F.col("score")).alias("score"), F.when(F.col("hit"), method).alias("method"))


def known_names(blocks: DataFrame, books: DataFrame, corpus) -> DataFrame:
    """The distinct case names of a corpus's opinions and headers, in order."""
    rows = blocks.where(F.col("type").isin("case_opinion", "case_header") & (F.trim("case_name") != ""))
    mine = books.where(F.col("corpus_id") == corpus).select(F.col("id").alias("book_id"))
    return rows.join(mine, "book_id", "left_semi").select(F.trim("case_name").alias("name")).distinct().orderBy("name")
