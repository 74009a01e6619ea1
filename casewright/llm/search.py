"""Ranked lexical search: an index of compressed postings per shard, searched a document at a time.

Index. Documents are dealt to shards where they are read: consecutive rows of a partition, SHARD_CHARS characters and
SHARD_ROWS rows at most (one document may be longer). A shard's task counts its terms, orders its documents by doc_id
and writes one row a term: how many documents hold it, and their places in that order and term frequencies as gaps in
variable bytes. One more row a shard, without a term, holds the doc_ids and lengths. No text is shuffled.

Search. The items' distinct terms are joined with the index, so only their postings move; document frequencies and
the corpus's counts are sums over shards. Each (shard, block of ITEMS items) is one task's work: it walks an item's
postings in order of the documents with a heap of cursors, a document at a time, and keeps a heap of the best by
(score, doc_id). Terms whose greatest contributions together can't lift a document over the worst kept one drive no
cursor; they are looked up for the documents that the others bring, while these can still get in. The shards' best
are merged, first in groups of shards, then all.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Null, empty and
other texts without a term are no documents of the counts and match nothing; items without a term, and items all of
whose terms are absent, have no rows. Items equal in id and text count once; different texts under one item_id are
items of their own. Rows that share a doc_id are documents of their own, those without one come before all others
among equal scores. An empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import cut, ship

TOP = 50
SHARD_ROWS, SHARD_CHARS, ITEMS = 16_384, 32_000_000, 256
#: Documents between two choices of the terms that drive cursors; shards a group of the first merge.
STRIDE, GROUP = 1024, 256
#: Terms of items, counted once an item, that are broadcast (some 60 bytes each); more are joined by a shuffle.
SMALL = 200_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id of rows without one, below all others.
NO_ID = -(1 << 63)


def terms(text: str | None) -> list[str]:
    text = text or ""
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable bytes of whole numbers, seven bits a byte, low ones first, the last without its high bit; and each number's byte count."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        lengths += (values >> np.uint64(bits)) > 0
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(lengths.max(initial=0))):
        has = lengths > k
        more = np.where(lengths[has] > k + 1, 128, 0).astype(np.uint64)
        out[ends[has] - lengths[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)) | more
    return out, lengths


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    first = np.concatenate(([0], np.flatnonzero(raw < 128)[:-1] + 1))
    owner = np.zeros(len(raw), np.int64)
    owner[first[1:]] = 1
    at = np.arange(len(raw)) - first[np.cumsum(owner)]
    return np.add.reduceat((raw & 127) << (7 * at), first)


def postings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places of the documents, term frequencies)."""
    numbers = unpack_numbers(data).reshape(-1, 2)
    return np.cumsum(numbers[:, 0]) - 1, numbers[:, 1]


_INDEX = ["shard", "term", "n", "total", "postings"]
INDEX = "shard string, term string, n long, total long, postings binary"


def _shard(name: str, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
    """A shard's rows: its documents (n of them with a term, total terms), then its terms (n documents)."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    known: dict[str, int] = {}
    numbers, places, counts, lengths = [], [], [], []
    for place, i in enumerate(order):
        found = Counter(terms(texts[i]))
        lengths.append(found.total())
        numbers.append(np.fromiter((known.setdefault(t, len(known)) for t in found), np.int32, len(found)))
        counts.append(np.fromiter(found.values(), np.int64, len(found)))
        places.append(np.full(len(found), place, np.int64))
    term, place, count = np.concatenate(numbers), np.concatenate(places), np.concatenate(counts)
    by = np.argsort(term, kind="stable")
    term, place, count = term[by], place[by], count[by]
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
    gaps = np.diff(place, prepend=-1)
    gaps[first] = place[first] + 1
    data, sizes = pack_numbers(np.stack([gaps, count], axis=1).ravel())
    ends = np.concatenate((np.cumsum(sizes)[2 * first - 1], [len(data)])) if len(first) else np.zeros(1, np.int64)
    if len(first):
        ends[0] = 0
    held = np.diff(np.concatenate((first, [len(term)])))
    words, raw = list(known), data.tobytes()  # numbered as they came
    table = np.array([[NO_ID if ids[i] is None else ids[i] for i in order], lengths], np.int64).tobytes()
    head = [[name], [None], [sum(x > 0 for x in lengths)], [sum(lengths)], [table]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head, _TYPES, strict=True)], _INDEX)
    for lo in range(0, len(words), 10_000):
        hi = min(lo + 10_000, len(words))
        cols = [[name] * (hi - lo), words[lo:hi], held[lo:hi], [None] * (hi - lo), [raw[ends[i] : ends[i + 1]] for i in range(lo, hi)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _INDEX)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _indexer(rows: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (len(ids) >= rows or size + len(text or "") > chars):
                    yield from _shard(f"{part}-{made}", ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
        if ids:
            yield from _shard(f"{part}-{made}", ids, texts)

    return run


def build_index(docs: DataFrame, rows: int = SHARD_ROWS, chars: int = SHARD_CHARS) -> DataFrame:
    """shard, term, n, total, postings: the whole index, checkpointed. ``total`` and a null term mark a shard's table of documents."""
    ship(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_indexer(rows, chars), INDEX))


#: A posting as one number: the document's place above SHIFT bits, what the term adds to its score below.
SHIFT = 40
_PART = (1 << SHIFT) - 1


def best(lists: list[tuple[int, list[int]]], n: int, top: int = TOP, stride: int = STRIDE) -> list[tuple[int, int]]:
    """The ``top`` greatest (score, -place) above 0 of ``n`` documents, greatest first.

    ``lists``: (greatest part, postings in order) of each term. Documents are visited in order of their places, so of
    equal scores the earlier stays.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0])
    reach = [0]
    for most, _ in lists:
        reach.append(reach[-1] + most)  # what the terms before can add together
    heap: list[tuple[int, int]] = []
    least = 0
    for lo in range(0, n, stride):
        # terms before ``drive`` can't bring a document in by themselves
        drive = bisect_left(reach, least + 1) - 1
        if drive >= len(lists):
            break
        start, stop = lo << SHIFT, (lo + stride) << SHIFT
        cursors = [p[bisect_left(p, start) : bisect_left(p, stop)] for _, p in lists[drive:]]
        rest = lists[:drive]
        at, score = -1, 0
        for x in heapq.merge(*cursors):
            place = x >> SHIFT
            if place != at:
                if at >= 0 and score + reach[drive] > least:
                    least = _offer(heap, at, score, rest, reach, least, top)
                at, score = place, x & _PART
            else:
                score += x & _PART
        if at >= 0:
            least = _offer(heap, at, score, rest, reach, least, top)
    return sorted(heap, reverse=True)


def _offer(heap: list, place: int, score: int, rest: list, reach: list[int], least: int, top: int) -> int:
    """Add what the terms without cursors give to the document, and keep it if it is among the best; the score to beat."""
    key = place << SHIFT
    for k in range(len(rest) - 1, -1, -1):
        if score + reach[k + 1] <= least:
            return least
        p = rest[k][1]
        i = bisect_left(p, key)
        if i < len(p) and p[i] >> SHIFT == place:
            score += p[i] & _PART
    if score > least:
        if len(heap) < top:
            heapq.heappush(heap, (score, -place))
        else:
            heapq.heapreplace(heap, (score, -place))
        if len(heap) == top:
            return heap[0][0]
    return least


def contributions(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term of weight 1 gives to documents that hold it ``counts`` times and have ``lengths`` terms, in whole numbers."""
    m = 50 + (50 * lengths * n) // total
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _searcher(n: int, total: int, top: int):
    def settle(rows: list) -> pa.RecordBatch:
        """rows: (shard, block, term, postings, weight, items) of one shard and block of items."""
        shard = rows[0][0]
        ids, lengths = np.frombuffer(next(r[3] for r in rows if r[2] is None), np.int64).reshape(2, -1)
        of_item: dict = {}
        for _, _, term, data, weight, items in rows:
            if term is not None:
                places, counts = postings(data)
                parts = weight * contributions(counts, lengths[places], n, total)
                one = (int(parts.max()), ((places << SHIFT) | parts).tolist())
                for item in items:
                    of_item.setdefault((item["item_id"], item["item"]), []).append(one)
        out: list[list] = [[], [], [], [], []]
        for (item_id, item), lists in of_item.items():
            for score, place in best(lists, len(ids), top):
                for c, v in zip(out, (shard, item_id, item, ids[-place], score), strict=True):
                    c.append(v)
        docs = [None if x == NO_ID else int(x) for x in out[3]]
        cols = [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(docs, pa.int64()), pa.array(out[4], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["shard", "item_id", "item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and row[:2] != rows[0][:2]:
                    yield settle(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield settle(rows)

    return run


def search(index: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of the index for each item."""
    ship(index.sparkSession)
    tables = index.where("term IS NULL")
    n, total = tables.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    term = F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), 0))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", "text").alias("item"), "text").dropDuplicates(["item_id", "item"])
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select("item_id", "item", F.pmod("item", F.lit(blocks)).alias("block"), F.explode(term).alias("term"))
    by_term = cut(asked.groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "item")).alias("items")))  # about ``block`` at most
    held = by_term.agg(F.sum(F.size("items"))).first()[0] or 0
    small = F.broadcast if held <= SMALL else lambda df: df
    found = cut(index.where("term IS NOT NULL").select("shard", "term", "n", "postings").join(small(by_term), "term"))
    df = found.select("shard", "term", "n").distinct().groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1)))
    weighed = found.join(small(df.select("term", weight.alias("weight"))), "term").select("shard", "block", "term", "postings", "weight", "items")
    heads = found.select("shard", "block").distinct().join(tables.select("shard", "postings"), "shard")
    heads = heads.select("shard", "block", F.lit(None).cast("string").alias("term"), "postings", F.lit(None).cast("long").alias("weight"), F.lit(None).cast(weighed.schema["items"].dataType).alias("items"))
    work = weighed.unionByName(heads).repartition("shard", "block").sortWithinPartitions("shard", "block")
    hits = work.mapInArrow(_searcher(n, total, top), "shard string, item_id long, item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    near = F.pmod(F.xxhash64("shard"), F.lit(GROUP)).alias("near")
    some = hits.withColumn("near", near).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "item", "near").orderBy(*order))).where(F.col("rank") <= top)
    merged = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "item").orderBy(*order))).where(F.col("rank") <= top)
    return merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
