"""MinHash near-duplicate detection: one-permutation hashing with optimal densification, banding and stars of candidates.

1. A text becomes its set of two-word shingles (A-Z in lower case, 64-bit values; a single word is one shingle).
   One permutation of the values deals them over bins, of which each keeps its least; an empty bin takes the value
   of the first filled one in a fixed random order of its own (optimal densification). Documents of equal sets
   form one group, which is compared once.
2. Groups are shuffled on the hashes of their bands; of buckets with the same members one is kept. A bucket proposes
   stars only: edges from a hub to those of its members that aren't in the hub's component yet and may be alike by
   size. The sets at both ends of an edge are joined and intersected; edges at the similarity unite what their ends belong to.
3. In each of QUICK rounds every group proposes one edge, to a hub of the largest component in one of its buckets: near
   copies of any number are united by about one edge each. Buckets all of one component are done.
4. What is left are buckets that hold several components. Joined by their common members they form clusters, in which
   every group outside the cluster's largest component is compared with all others of the cluster, on full sets, as
   products of two bounded blocks a task. So every pair of one bucket is compared or already in one component; no
   bucket, star or number of partners has a cap, and no pair is a row.

The bands give a recall of RECALL at the similarity by arithmetic; what is found is exact. Texts without words (null,
empty, blank) are linked with nothing. Every row counts: rows without a doc_id link like others, and a component of
only such rows has a null component_id, all of whose rows are kept; rows that share a doc_id are separate. An empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import drop, ship, stored
from casewright.llm.ngram_join import _forest, _links, _row_key, _spread, components

SHINGLE, SIMILARITY = 2, 80
BANDS, ROWS = 56, 8
#: The chance that a pair of the least similarity shares a bucket.
RECALL = 1 - (1 - (SIMILARITY / 100) ** ROWS) ** BANDS
#: Edges of a hub that one task compares.
STAR = 512
#: Rounds in which each group proposes one edge; groups and values of a block at most (one group may have more).
QUICK, BLOCK_ROWS, BLOCK_VALUES = 2, 2048, 1_500_000
#: Bins of a sequence that are looked at before the whole.
FIRST = 12
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of the text's n-word shingles; of all its words as one where it has fewer."""
    words = (text or "").encode().lower().split()  # bytes know ASCII's case and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    n = min(n, len(h))
    v = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        v = v * _MUL + h[j : len(h) - n + 1 + j]
    return np.unique(mix(v))


@functools.cache
def _sequences(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bin's random order of all bins, and the place of each in it."""
    order = np.argsort(np.random.Generator(np.random.PCG64(13)).random((bins, bins)), axis=1)
    return order[:, :FIRST].copy(), np.argsort(order, axis=1).astype(np.uint16)


def densified(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Give each empty bin the value of a filled one: the first in the bin's own random order of the bins."""
    order, places = _sequences(len(least))
    out, empty = least.copy(), np.flatnonzero(~filled)
    hits = filled[order[empty]]
    first = hits.argmax(axis=1)
    soon = hits[np.arange(len(empty)), first] if len(empty) else np.empty(0, bool)
    out[empty[soon]] = least[order[empty[soon], first[soon]]]
    late, full = empty[~soon], np.flatnonzero(filled)
    if len(late):
        out[late] = least[full[places[np.ix_(late, full)].argmin(axis=1)]]
    return out


def signature(values: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One value a bin. Sets of one value or more; equal sets have equal signatures."""
    v = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    at = ((v >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # the high half picks the bin
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at.astype(np.int64), v)
    filled = np.zeros(bins, bool)
    filled[at.astype(np.int64)] = True
    return densified(least, filled)


def band_hashes(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = mix(signature(values, bands * rows).reshape(bands, rows) + np.arange(rows, dtype=np.uint64))
    powers = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((s * powers).sum(axis=1) + np.arange(bands, dtype=np.uint64) * _MUL).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, hashes = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sizes.append(len(s))
            hashes.append(band_hashes(s) if len(s) else np.empty(0, np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *hashes])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "row_key", "key", "n_shingles", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            sets = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "members"])


def _may_link(a: Column, b: Column, similarity: int) -> Column:
    """Whether sets of these sizes can be at the similarity."""
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def linked(edges: DataFrame, sets: DataFrame, n: int, similarity: int = SIMILARITY) -> DataFrame:
    """The ``n`` edges (hub, node, ...), of which those whose full sets are at the similarity have ``linked`` true.

    A hub's edges are dealt to tasks of about STAR; its set is sent once to each of them.
    """
    count = F.count(F.lit(1))
    degrees = stored(edges.groupBy("hub").agg(F.ceil(count / F.lit(STAR)).cast("int").alias("parts"), count.alias("_n")))
    centres = degrees.join(sets.select(F.col("node").alias("hub"), F.col("members").alias("centre")), "hub")
    centres = centres.select("hub", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centre")
    tagged = _spread(edges, degrees, ["hub"], n)
    pairs = tagged.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts").join(sets, "node")
    both, sizes = F.size(F.array_intersect("members", "centre")), F.size("members") + F.size("centre")
    return pairs.join(centres.drop("parts"), ["hub", "part"]).select(*edges.columns, (100 * both >= similarity * (sizes - both)).alias("linked"))


def _one_edge_each(alive: DataFrame, seed: int, n: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the buckets that span components, an edge of each node in them to a hub of a largest component there)."""
    drawn = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "size", "label")
    parts = alive.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("pick"))
    hubs = parts.groupBy("bucket").agg(F.max(F.struct("n", "pick")).alias("top"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    hubs = stored(hubs.select("bucket", "_n", F.col("top.pick.h").alias("drawn"), F.col("top.pick.node").alias("hub"), F.col("top.pick.size").alias("hub_size"), F.col("top.pick.label").alias("hub_label")))
    rows = stored(_spread(alive, hubs, ["bucket"], n))
    drop(hubs)
    away = rows.where((F.col("label") != F.col("hub_label")) & _may_link(F.col("size"), F.col("hub_size"), similarity))
    # the same hub for as many as can be
    one = away.groupBy("node").agg(F.max(F.struct("drawn", "hub", "hub_label", "label")).alias("e"))
    return rows, one.select("e.hub", "e.hub_label", "node", "e.label")


def _relabelled(rows: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """The rows with each label replaced by the least that is linked to it, and that one's by its own least.

    Labels may stay finer than components for a round or two, which costs comparisons but loses none.
    """
    both = met.select(F.col("label").alias("a"), F.col("hub_label").alias("b"))
    least = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).where("b < a"))
    further = least.join(least.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("label"), F.coalesce("c", "b").alias("_to"))
    every = stored(rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).join(further, "label", "left").select("label", F.coalesce("_to", "label").alias("_to"), "_n"))
    drop(least)
    return _spread(rows, every, ["label"], n).withColumn("label", F.col("_to"))


def _settled(similarity: int):
    """The forest of the links between the two sides of each task, or inside a side where there is only that one."""

    def settle(members: list[tuple[int, int, np.ndarray]], inner: bool) -> pa.RecordBatch | None:
        rows = sorted(members, key=lambda m: m[:2])
        split = 0 if inner else sum(m[0] == 0 for m in rows)
        if not inner and split in (0, len(rows)):
            return None
        nodes = np.array([m[1] for m in rows], np.int64)
        root = nodes[_forest(_links([m[2] for m in rows], split, similarity / 100), split)]
        some = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some])], ["node", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            lists = batch.column(5)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (*task, side, node) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)):
                if now and task != now:
                    if (found := settle(members, now[1] == now[2])) is not None:
                        yield found
                    members = []
                now = task
                members.append((side, node, values[ends[i] : ends[i + 1]].copy().view(np.uint64)))
        if members and (found := settle(members, now[1] == now[2])) is not None:
            yield found

    return run


def _clusters(alive: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (node, hub) between the components inside the clusters of the buckets ``alive``: bucket, node, size, label.

    A cluster's groups outside its largest component are dealt into the blocks 0, 1, ..., those inside into -1, -2, ...; a task
    is two blocks, one of the former at least.
    """
    count = F.count(F.lit(1))
    hubs = stored(alive.groupBy("bucket").agg(F.min("node").alias("hub"), count.alias("_n")))
    n = alive.count()
    stars_ = _spread(alive, hubs, ["bucket"], n).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    inside = stored(components(stars_).join(alive.select("node", "size", "label").distinct(), "node"))
    n = inside.count()
    parts = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_VALUES)).cast("int")
    labels = inside.groupBy("root", "label").agg(count.alias("n"), F.sum("size").alias("values"))
    whole = labels.groupBy("root").agg(F.max(F.struct("n", "label", "values")).alias("top"), F.sum("n").alias("_n"), F.sum("values").alias("values"))
    whole = stored(whole.select("root", "_n", F.col("top.label").alias("top"), parts(F.col("top.n"), F.col("top.values")).alias("mains"), parts(F.col("_n") - F.col("top.n"), F.col("values") - F.col("top.values")).alias("others")))
    dealt = _spread(inside, whole, ["root"], n).withColumn("main", F.col("label") == F.col("top"))
    own = F.when(F.col("main"), -1 - F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    with_others = F.transform(upto("others"), lambda o: F.struct(F.least("own", o).alias("a"), F.greatest("own", o).alias("b")))
    with_mains = F.when(F.col("main"), F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.transform(upto("mains"), lambda o: F.struct((-1 - o).alias("a"), F.col("own").alias("b"))))
    tasks = dealt.withColumn("own", own).select("root", "node", "own", F.explode(F.concat(with_others, with_mains)).alias("t"))
    tasks = tasks.select("root", "t.a", "t.b", (F.col("own") != F.col("t.a")).cast("int").alias("side"), "node")
    pairs = tasks.join(sets, "node").select("root", "a", "b", "side", "node", "members")
    return pairs.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(_settled(similarity), "node long, hub long")


def united(alive: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Links (node, hub) that connect what the buckets' links connect. ``alive``: bucket, node, size."""
    alive, links = alive.withColumn("label", F.col("node")), []
    for step in range(QUICK):
        if not (n := alive.count()):
            break
        rows, edges = _one_edge_each(alive, step, n, similarity)
        edges = stored(edges)
        found = stored(linked(edges, sets, edges.count(), similarity).where("linked"))
        links.append(found.select("node", "hub"))
        left = stored(_relabelled(rows, found, n).select("bucket", "node", "size", "label"))
        drop(edges, alive, rows)
        alive = left
    span = stored(alive.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo < hi").drop("lo", "hi"))
    alive = stored(_spread(alive, span, ["bucket"], 1 << 30))
    if not alive.isEmpty():
        links.append(stored(_clusters(alive, sets, similarity)))
    return functools.reduce(DataFrame.unionByName, links) if links else alive.select("node", F.col("node").alias("hub"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept of every row."""
    ship(docs.sparkSession)
    row_key = _row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key.alias("row_key"))
    signed = stored(keyed.mapInArrow(_signed, "doc_id long, row_key binary, key binary, n_shingles long, bands array<long>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    count = F.count(F.lit(1))
    groups = signed.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("first"), F.max("n_shingles").alias("size"), count.alias("_n"), F.any_value("bands").alias("bands"))
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers
    buckets = groups.select("node", "size", F.explode("bands").alias("bucket"))
    print_of = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    held = buckets.groupBy("bucket").agg(count.alias("_n"), F.min("node").alias("low"), F.max("node").alias("high"), *print_of).where("_n > 1")
    held = held.groupBy("_n", "low", "high", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    held = stored(held.select("bucket", "_n"))  # planned once, as are the tables below that a join reads twice
    alive = stored(_spread(buckets, held, ["bucket"], BANDS * groups.count()))
    wanted = groups.select("node", "first.row_key").join(alive.select("node").distinct(), "node")
    texts = keyed.join(wanted, "row_key").dropDuplicates(["row_key"]).select("node", "text")
    sets = stored(texts.mapInArrow(_sets, "node long, members array<long>"))
    links = united(alive, sets, similarity)
    own = groups.select("key", "node", "first", "_n")
    members = stored(components(links.select(F.col("hub").alias("u"), F.col("node").alias("v"))).join(own, "node").select("key", "first", "root"))
    heads = stored(members.groupBy("root").agg(F.min("first").alias("head"), count.alias("_n")))
    heads = _spread(members.select("key", "root"), heads, ["root"], groups.count()).select("key", "head")
    of_key = stored(own.join(heads, "key", "left").select("key", "_n", F.coalesce("head", "first")["doc_id"].alias("component_id")))
    rows = _spread(signed.where("key IS NOT NULL").select("doc_id", "n_shingles", "key"), of_key, ["key"], signed.count()).select("doc_id", "n_shingles", "component_id")
    rows = rows.unionByName(signed.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
