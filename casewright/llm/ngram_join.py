"""N-gram Jaccard join: MinHash banding, then verification on full sets.

1. Every text becomes its set of five-word shingles (64-bit values; a shorter text has one shingle of all
   its words). Documents of equal sets form one group, which has a number of its own from here on; one
   of its rows, known by the 128-bit hash of its doc_id and text, gives the text.
2. Band and row counts are the cheapest that reach the target recall at the threshold. The groups are
   shuffled on their band hashes; the members of a bucket are linked to its least member only, so a bucket
   of any size costs its size. Connected components of these stars hold every pair that shares a bucket.
3. Inside a component all pairs that can be alike are compared on their full sets. A component of more than one block
   of bounded rows and bytes is parted by the size of the sets, into classes so wide that sets of more than
   neighbouring classes can't reach the similarity, and its classes into blocks; one task's work is two blocks.
   Similarities there are matrix products over the shingles that at least two members share, and only each
   member's number of links and a spanning forest of the links leave the task. No link is left out, none is
   written out.
4. Components of the verified links give the classes; the least doc_id in one is only its label.

Documents with no words (null, empty, blank) have equal, empty sets. Every row counts as a document: rows
without a doc_id, and different texts under one doc_id, are compared like all others. A class none of whose
rows has a doc_id has a null label. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import WORD, cut, drop, ship, stored, whole_text

SHINGLE, SIMILARITY, RECALL, MAX_HASHES = 5, 0.8, 0.999, 400
#: A block of a component: so many members and characters at most (one member may be longer).
BLOCK_ROWS, BLOCK_CHARS = 2048, 12_000_000
_WORD = re.compile(WORD)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        for b in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** b >= recall:
                best = (b, rows)
                break
        else:
            return best
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of the text's n-word shingles as 64-bit values."""
    words = _WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    n = min(n, len(h))
    v = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        v = v * _MUL + h[j : len(h) - n + 1 + j]
    v = np.sort(_mix(v))
    return v[np.concatenate(([True], v[1:] != v[:-1]))]


def _signer(n_bands: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(20240229))
    a = rng.integers(0, 1 << 31, n_bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, n_bands * rows, dtype=np.uint32)
    powers = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seeds = np.arange(n_bands, dtype=np.uint64) * _MUL

    def sign(s: np.ndarray) -> np.ndarray:
        short = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(short), 512):
            h = a[:, None] * short[None, i : i + 512]
            h += b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        return _mix((_mix(least.astype(np.uint64)).reshape(n_bands, rows) * powers).sum(axis=1) + seeds).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs, lengths = [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                raw = s.tobytes()
                keys.append(xxhash.xxh3_128_digest(raw))
                sizes.append(len(s))
                lengths.append(len(text or ""))
                signs.append(sign(s) if len(s) else None)
            offsets = np.cumsum([0, *[0 if x is None else n_bands for x in signs]]).astype(np.int32)
            full = [x for x in signs if x is not None]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(full) if full else np.empty(0, np.int64)))
            cols = [batch.column(1), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "key", "size", "chars", "bands"])

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with an edge to a lesser one has only that edge, and its end none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").count() == 0


def _spread(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key; ``_n``: how many rows have the key; ``n``: rows in all).

    Keys with very many rows, of which there are at most 4096 by their number, are joined by broadcast where
    their rows lie; all others by a shuffle, in which no key is heavy then.
    """
    many = max(256, n // 4096)
    rest = [c for c in table.columns if c not in (*keys, "_n")]
    heavy = table.where(F.col("_n") > many).select(F.struct(*keys).alias("_key"), F.struct(*rest).alias("_got"))
    tagged = rows.join(F.broadcast(heavy), F.struct(*keys) == F.col("_key"), "left")
    here = tagged.where("_key IS NOT NULL").select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in rest])
    others = tagged.where("_key IS NULL").select(*rows.columns).join(table.where(F.col("_n") <= many).drop("_n"), keys)
    return here.unionByName(others.select(*rows.columns, *rest))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, by alternating large and small stars.

    Each round shuffles edges by one end; minima are pre-aggregated, and hubs of very many edges are joined by
    broadcast. Rounds end when every component is a star around its least node.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    count = F.count(F.lit(1)).alias("_n")
    while not _are_stars(edges):
        n = 2 * edges.count()
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), count).select("u", F.least("u", "m").alias("m"), "_n")
        # stored, as each use of a plan is planned and compiled again on the driver
        large = stored(_spread(both.where("v > u"), low, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), count)
        small = _spread(large, low, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        fewer = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop(edges, large)
        edges = fewer
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _links(sets: list[np.ndarray], split: int, similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between members: all pairs if split is 0, else those between members before and from ``split``.

    Returns a boolean matrix over the compared pairs in blocks and the forest of its links.
    """
    sizes = np.array([len(s) for s in sets], np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    freq = np.diff(np.concatenate((start, [len(flat)])))
    shared = freq > 1
    column = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), freq)
    owner, column = owner[column >= 0], column[column >= 0]
    m, width = len(sets), int(shared.sum())
    common = np.zeros((m, m), np.float32) if not split else np.zeros((split, m - split), np.float32)
    step = max(64, min(2048, (1 << 23) // max(m, 1)))
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        dense = np.zeros((m, min(step, width - lo)), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        common += dense @ dense.T if not split else dense[:split] @ dense[split:].T
    union = (sizes[:, None] + sizes[None, :] if not split else sizes[:split, None] + sizes[None, split:]) - common
    linked = common >= np.float32(similarity) * union - np.float32(1e-3)
    # settle pairs at the threshold in whole numbers
    num, den = round(similarity * 1000), 1000
    linked &= den * common.astype(np.float64) >= num * union.astype(np.float64)
    if not split:
        np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray, split: int) -> list[int]:
    """The least member index reachable from each member through the links."""
    m = len(linked) if not split else sum(linked.shape)
    root = np.full(m, -1)
    for first in range(m):
        if root[first] >= 0:
            continue
        root[first] = first
        queue = [first]
        while queue:
            x = queue.pop()
            if not split:
                near = np.flatnonzero(linked[x])
            elif x < split:
                near = np.flatnonzero(linked[x]) + split
            else:
                near = np.flatnonzero(linked[:, x - split])
            near = near[root[near] < 0]
            root[near] = first
            queue.extend(near.tolist())
    return root


def _verifier(similarity: float):
    def settle(members: list[tuple[int, int, int, str]], inner: bool) -> pa.RecordBatch | None:
        """members: (side, node, copies, text) of one pair of blocks, or of one block."""
        rows = sorted(members, key=lambda m: m[:2])
        split = 0 if inner else sum(m[0] == 0 for m in rows)
        if not inner and split in (0, len(rows)):
            return None
        ids = np.array([m[1] for m in rows], np.int64)
        weight = np.array([m[2] for m in rows], np.int64)
        linked = _links([shingles(m[3]) for m in rows], split, similarity)
        links = linked @ weight if inner else np.concatenate((linked @ weight[split:], linked.T @ weight[:split]))
        least = np.full(len(rows), np.iinfo(np.int64).max)
        root = _forest(linked, split)
        np.minimum.at(least, root, ids)
        some = links > 0
        cols = [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(least[root][some])]
        return pa.RecordBatch.from_arrays(cols, ["node", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            for *task, inner, side, node, copies, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now and (*task, inner) != now:
                    if (found := settle(members, now[-1])) is not None:
                        yield found
                    members = []
                now = (*task, inner)
                members.append((side, node, copies, text))
        if members and (found := settle(members, now[-1])) is not None:
            yield found

    return run


def _tasks(inside: DataFrame, n: int, similarity: float) -> DataFrame:
    """(task, inner, side, node, row_key, copies): which pairs of blocks each member of a component goes to.

    ``inside``, of ``n`` rows: root, node, row_key, copies, chars, size. A member goes to its own block, to the other blocks of its class of
    sizes, and to those of the next and the last class; a class that has a member alone has no task of its own.
    """
    rows = F.count(F.lit(1)) / BLOCK_ROWS
    # up to four blocks are made already for a quarter of the rows each
    blocks = F.greatest(F.ceil(rows), F.least(F.ceil(4 * rows), F.lit(4)), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    whole = inside.groupBy("root").agg(blocks.alias("parts"), F.count(F.lit(1)).alias("_n"))
    # a bit wider than the similarity asks for, against rounding
    level = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(np.log(1.0001 / similarity))).cast("int")
    classed = _spread(inside, whole, ["root"], n).withColumn("level", F.when(F.col("parts") == 1, 0).otherwise(level)).drop("parts")
    sizes = classed.groupBy("root", "level").agg(blocks, F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("root").orderBy("level")
    beside = lambda f, d: F.when(f("level").over(order) == F.col("level") + d, f("blocks").over(order)).otherwise(0)
    sizes = sizes.withColumns({"after": beside(F.lead, 1), "before": beside(F.lag, -1), "alone": F.col("_n") == 1})
    dealt = _spread(classed, sizes, ["root", "level"], n).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    def numbers(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def pair(low: Column, i: Column, high: Column, j: Column, inner: Column, side: Column) -> Column:
        task = F.struct("root", low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))
        return F.struct(task.alias("task"), inner.alias("inner"), side.cast("int").alias("side"))

    at, own = F.col("level"), F.col("block")
    same = F.transform(numbers(F.when(F.col("alone"), 0).otherwise(F.col("blocks"))), lambda o: pair(at, F.least(own, o), at, F.greatest(own, o), own == o, own > o))
    later = F.transform(numbers(F.col("after")), lambda o: pair(at, own, at + 1, o, F.lit(False), F.lit(0)))
    earlier = F.transform(numbers(F.col("before")), lambda o: pair(at - 1, o, at, own, F.lit(False), F.lit(1)))
    return dealt.select("node", "row_key", "copies", F.explode(F.concat(same, later, earlier)).alias("t")).select("t.*", "node", "row_key", "copies")


def _row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of the row's doc_id and text; rows that agree in both are repeats of one row."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), whole_text(text)).cast("binary")))


def _grouped(docs: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key), and one row per set: key, its first row's row_key, class_id, class_row, n_copies, n_links.

    First is the least doc_id, rows without one last, then the least row_key; class_row is the first row of the class.
    """
    ship(docs.sparkSession)
    n_bands, rows = bands(similarity, recall)
    row_key = _row_key(F.col("doc_id"), F.col("text"))
    signed = docs.select("text", "doc_id", row_key.alias("row_key")).mapInArrow(
        _signer(n_bands, rows), "doc_id long, row_key binary, key binary, size long, chars long, bands array<long>"
    )
    signed = cut(signed)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    groups = signed.groupBy("key").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("chars").alias("chars"), F.max("size").alias("size"), F.any_value("bands").alias("bands")
    )
    # the checkpoint fixes the numbers
    groups = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    buckets = groups.select("node", F.explode("bands").alias("hash"))  # a band's hash differs from another's
    hubs = buckets.groupBy("hash").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_n"))
    stars = _spread(buckets, hubs.where("_n > 1"), ["hash"], n_bands * groups.count()).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    candidates = components(stars)
    inside = cut(candidates.join(groups.select("node", "first.row_key", "copies", "chars", "size"), "node"))
    n = inside.count()
    dealt = _tasks(inside, n, similarity)
    texts = docs.select(row_key.alias("row_key"), "text").join(inside.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])
    pairs = texts.join(dealt, "row_key").select("task", "inner", "side", "node", "copies", "text")
    pairs = pairs.repartition("task").sortWithinPartitions("task").select("task.*", "inner", "side", "node", "copies", "text")
    found = cut(pairs.mapInArrow(_verifier(similarity), "node long, links long, least long"))
    joined = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    members = joined.join(groups.select("node", "first"), "node")
    heads = _spread(members, members.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("_n")), ["root"], n).select("node", "head")
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(heads, "node", "left")
    of_key = groups.select("key", "node", "first", "copies").join(links, "node", "left").withColumn("head", F.coalesce("head", "first"))
    of_key = of_key.select(
        "key", "first.row_key", F.col("head.doc_id").alias("class_id"), F.col("head.row_key").alias("class_row"), F.col("copies").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed.select("doc_id", "key"), of_key


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_copies, n_links.

    class_id is the least doc_id among the documents reachable through links, n_copies the number of
    documents with the same set, n_links the number of other documents at the similarity or more.
    """
    signed, of_key = _grouped(docs, similarity, recall)
    of_key = of_key.withColumn("_n", F.col("n_copies"))
    return _spread(signed, of_key, ["key"], signed.count()).select("doc_id", "class_id", "n_copies", "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the least doc_id, a row without one only where no row has one.

    Of different texts under that doc_id the one of the least row key stays, of repeats of a row any one.
    """
    keep = _grouped(docs, SIMILARITY, RECALL)[1].where("row_key = class_row").select(F.col("row_key").alias("_keep"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    kept = packed.join(keep, F.col("_row") == F.col("_keep"), "left_semi")
    return kept.dropDuplicates(["_row"]).select("_doc.*")
