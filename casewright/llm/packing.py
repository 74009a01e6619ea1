"""Packing along a space-filling curve.

Each document's token ids are hashed into BUCKETS counts, projected by a fixed random matrix to DIMS numbers
and, scaled by the median and spread of a sample, placed on a Hilbert curve. Documents are range-sorted by (curve key, doc_id)
and concatenated, so each
sequence of LENGTH tokens holds neighbours on the curve. Documents are cut where a sequence ends; only the
last sequence of a range is not full, and it is cut into sequences of powers of two, which need no padding.

Token ids travel in one shuffle as 16-bit numbers, tokenized once. Ranges come from the keys of a bounded
sample of documents (about SAMPLE a range, at most RANGES ranges), so that each range holds about as many tokens, with
the hash of doc_id and text in the key's low bits, so that a group of equal texts of any size is dealt over many ranges. The
sample is drawn a row at a time, whatever the rows hold; rows equal in id and text that fill several ranges are dealt
over them by their place in the input.

Null text counts as empty and yields the end token alone. Rows that repeat a doc_id, or lack one, are packed one after
the other, by their text's hash. An empty table gives no pieces. Very long texts are cut into as many pieces as they
need; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import ship, whole_text

LENGTH, END = 2048, 1
BUCKETS, DIMS, BITS = 1024, 4, 10
#: Documents a range, sampled keys a range, ranges at most.
RANGE_ROWS, SAMPLE, RANGES = 1500, 24, 65_536
#: Rows worked on at a time.
PART = 256
#: Distinct parts of words whose ids a worker keeps (some 200 bytes each).
CACHE, LONG = 600_000, 64


def _letters_and_numbers() -> tuple[str, str]:
    kinds = {i: unicodedata.category(chr(i))[0] for i in range(0x180)}
    return tuple("".join(re.escape(chr(i)) for i, k in kinds.items() if k == x) for x in "LN")


#: Texts of these characters, which lower-casing and NFC leave to one rule, are split here, others by the tokenizer.
_SIMPLE = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]*")
_L, _N = _letters_and_numbers()
#: The tokenizer's own pattern over those characters.
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def _shown_bytes() -> list[str]:
    """How byte-level tokenizers write each byte: itself if it is printable, else the next character from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_SHOWN = _shown_bytes()


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("ids don't fit in 16 bits")
    return tok, tok.model, {}


def tokenize(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as 16-bit numbers, with the end id.

    The tokenizer splits a text into parts that it merges one by one. Common parts are looked up, new ones
    go to its merge model; texts with special tokens or characters beyond Latin go to it as they are.
    """
    tok, model, known = _tokenizer(path)
    if len(known) > CACHE:
        known.clear()
    end = np.array([END], "<u2").tobytes()
    out: list[bytes] = [b""] * len(texts)
    get, split, simple = known.get, _PARTS.findall, _SIMPLE.fullmatch
    hard: list[int] = []
    for i, t in enumerate(texts):
        if "<|" in t or not simple(t):
            hard.append(i)
            continue
        parts = split(t.lower())
        ids = list(map(get, parts))
        if None in ids:
            for k, (w, x) in enumerate(zip(parts, ids, strict=True)):
                if x is None:
                    x = get(w)
                    if x is None:
                        x = np.array([m.id for m in model.tokenize("".join([_SHOWN[b] for b in w.encode()]))], "<u2").tobytes()
                        if len(w) <= LONG:
                            known[w] = x
                    ids[k] = x
        out[i] = b"".join(ids) + end
    for i, e in zip(hard, tok.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u2").tobytes() + end
    return out


@functools.cache
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id, and the random matrix."""
    buckets = (np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    return buckets.astype(np.int64), np.random.Generator(np.random.PCG64(8)).standard_normal((BUCKETS, DIMS))


def vector(ids: np.ndarray) -> np.ndarray:
    """The document's hashed counts, projected and divided by the root of their sum."""
    buckets, matrix = _projection()
    return np.bincount(buckets[ids], minlength=BUCKETS) @ matrix / np.sqrt(len(ids))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The positions of whole-number points (n x dims) on the Hilbert curve, by Skilling's transposition."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, tie: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Curve position in the high 40 bits, 23 bits of the doc_id's hash below."""
    cells = np.clip((vectors - centre) / scale * 2 ** (BITS - 3) + 2 ** (BITS - 1), 0, 2**BITS - 1)
    return (hilbert(cells) << 23) | (tie & ((1 << 23) - 1))


_AXES = [f"v{i}" for i in range(DIMS)]


def _bounds(keys: np.ndarray, sizes: np.ndarray, ranges: int) -> np.ndarray:
    """Keys that part the sampled documents into ranges of about equal numbers of tokens; a key that fills several is repeated."""
    order = np.argsort(keys, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    at = np.searchsorted(before, np.arange(1, ranges) * (sizes.sum() / ranges))
    return keys[order][np.minimum(at, len(keys) - 1)]


def ranges_of(keys: np.ndarray, spare: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each key; a key that is a bound several times is dealt over that many ranges by ``spare``."""
    low, high = np.searchsorted(bounds, keys, side="left"), np.searchsorted(bounds, keys, side="right")
    return np.where(high > low, low + 1 + spare % np.maximum(high - low, 1), high)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, PART at a time: what a worker holds besides its batch doesn't grow with the batch."""
    for batch in batches:
        yield from (batch.slice(i, PART) for i in range(0, batch.num_rows, PART))


def _vectors(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids = [np.frombuffer(x, "<u2") for x in tokenize(part.column(0).to_pylist(), path)]
            v = np.array([vector(x) for x in ids])
            sizes = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in v.T.copy()], part.column(1), sizes], [*_AXES, "tie", "n"])

    return run


def _keyed(path: str, centre: np.ndarray, scale: np.ndarray, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids = tokenize(part.column(0).to_pylist(), path)
            vectors = np.array([vector(np.frombuffer(x, "<u2")) for x in ids])
            keys = curve_keys(vectors, part.column(1).to_numpy(), centre, scale)
            ranges = ranges_of(keys, part.column(4).to_numpy(), bounds)
            cols = [part.column(2), part.column(3), pa.array(keys), pa.array(ranges), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "key", "range", "n", "ids"])

    return run


def _cuts(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence in the range, offset there, tokens) of each piece of a document at ``start`` of a range of ``total``."""
    out, full = [], total // length
    while n:
        if start < full * length:
            seq, at = divmod(start, length)
            room = length - at
        else:  # the rest of the range, as descending powers of two
            rest, at, seq = total - full * length, start - full * length, full
            while True:
                room = 1 << (rest.bit_length() - 1)
                if at < room:
                    break
                at, rest, seq = at - room, rest - room, seq + 1
            room -= at
        take = min(n, room)
        out.append((seq, at, take))
        start, n = start + take, n - take
    return out


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizer.cache_clear()  # all is tokenized by now, and the worker that did it may be this one
        for part in _parts(batches):
            cols: list[list] = [[] for _ in range(8)]
            for doc, rng, n, ids, before, total in zip(*[c.to_pylist() for c in part.columns], strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                at = 0
                for seq, offset, take in _cuts(before, n, total, length):
                    row = (doc, at, take, zlib.crc32(wide[4 * at : 4 * (at + take)]), n, (rng << 40) | seq, offset, wide[4 * at : 4 * (at + take)])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += take
            types = [*[pa.int64()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _NAMES)

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit little-endian)."""
    ship(docs.sparkSession)
    # ``spare`` tells rows apart that are equal in all else
    spare = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
    rows = docs.select(whole_text().alias("text"), F.xxhash64("doc_id", "text").alias("tie"), "doc_id", F.xxhash64("text").alias("text_hash"), spare.alias("spare"))
    n = docs.count()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    wanted = max(2000, ranges * SAMPLE)
    share = min(1.0, wanted / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("tie", "spare"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).limit(2 * wanted)
    got = chosen.select("text", "tie").mapInArrow(_vectors(path), ", ".join(f"{c} double" for c in _AXES) + ", tie long, n long").toArrow()  # bounded by the limit
    centre, scale, bounds = np.zeros(DIMS), np.ones(DIMS), np.empty(0, np.int64)
    if got.num_rows:
        v = np.stack([got[c].to_numpy() for c in _AXES], axis=1)
        centre, scale = np.median(v, axis=0), np.maximum(v.std(axis=0), 1e-6)
        bounds = _bounds(curve_keys(v, got["tie"].to_numpy(), centre, scale), got["n"].to_numpy(), ranges)
    keyed = rows.mapInArrow(_keyed(path, centre, scale, bounds), "doc_id long, text_hash long, key long, range long, n long, ids binary")
    whole = Window.partitionBy("range")
    order = whole.orderBy("key", F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.select("doc_id", "range", "n", "ids", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    return placed.mapInArrow(_pieces(length), ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in _NAMES))


def digest(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path).drop("ids")
