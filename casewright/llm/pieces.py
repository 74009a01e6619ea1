"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Every way to cut a text into the model's pieces is a path through its lattice; a path's weight is the
product of its pieces' probabilities, raised to ALPHA. The forward pass sums the weights of all paths to
each position, the backward pass draws the last piece from the end on in proportion to them, so whole
segmentations are drawn exactly from their distribution. Draws come from a counter-based generator seeded
by the row's key: the same key and text give the same pieces in any task, and a retried task repeats itself.

Pieces hold their blank in front only, so the lattice falls apart at blanks into words. The distinct words of
some hundred rows are filtered together, all of one length at a time, and all their occurrences sampled
together. Words of more than LONG characters (text without blanks, encoded data) go one by one in stretches of STRETCH
positions: the forward pass keeps one number a position, and the backward pass finds the pieces of a stretch again,
so memory is some twelve bytes a character beside the text and time is linear. This model's scores are merge ranks; the probability of rank r is taken in proportion to
1 / (r + 2). A character without a piece is written as its UTF-8 bytes, and so is a literal lower
one-eighth block, which the model writes for blanks; decoding therefore returns every text exactly.

Null text has no pieces and decodes to null; the empty text has no pieces. Repeated rows get equal pieces; an empty
table gives no rows. Extra columns are ignored unless they are asked for.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import ship

ALPHA = 1.5
MARK = "▁"
_PART = re.compile(r" *[^ ]+| +")
#: Rows and characters that are encoded together (one text may be longer).
ROWS, CHARS = 512, 1_500_000
#: Cells (words x positions x lengths) filtered at once.
CELLS = 1 << 22
LONG, STRETCH = 48, 4096
_MUL, _ADD = 0x9E3779B97F4A7C15, np.uint64(0x632BE59BD9B4E019)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's key and a position in its text only."""
    return (_mix(_mix(key + _ADD) + at.astype(np.uint64) * np.uint64(_MUL)) >> np.uint64(11)) * 2.0**-53


class Pieces:
    """The pieces of a model, with blanks written as blanks, and their lookup by a 64-bit rolling hash."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[str | bytes] = [""] * n
        self.byte = np.zeros(256, np.int32)
        shown: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace(MARK, " ")
                shown[self.text[i]] = i
        self.longest = max(map(len, shown))
        self.power = np.array([pow(_MUL, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        back = pow(_MUL, -1, 1 << 64)
        self.forth = np.array([pow(_MUL, k, 1 << 64) for k in range(STRETCH + self.longest)], np.uint64)
        self.back = np.array([pow(back, k, 1 << 64) for k in range(STRETCH + self.longest)], np.uint64)
        raw = [x if isinstance(x, bytes) else x.encode() for x in self.text]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        # weights by id; the last entry is that of no piece
        self.weight = np.zeros(n + 1)
        for x, i in shown.items():
            self.weight[i] = (1.0 / (2.0 - model.get_score(i))) ** alpha
        self.rare = (1.0 / (n + 2.0)) ** alpha
        self.none = n
        keys = np.zeros(n + 1, np.uint64)
        for x, i in shown.items():
            h = 0
            for c in x:
                h = (h * _MUL + ord(c) + 1) & _MASK
            keys[i] = h
        self.keys = keys
        # two tables: what collides in the first is in the second, and the piece in its place is marked
        self.first, self.second = np.full(1 << 20, n, np.int32), np.full(1 << 20, n, np.int32)
        self.crowded = np.zeros(n + 1, bool)
        with np.errstate(over="ignore"):
            slots = (keys * _ADD) >> np.uint64(44), _mix(keys) >> np.uint64(44)
        for i in sorted(shown.values()):
            a, b = int(slots[0][i]), int(slots[1][i])
            if self.first[a] == n:
                self.first[a] = i
            elif self.second[b] == n:
                self.second[b] = i
                self.crowded[self.first[a]] = True
            else:
                raise ValueError("pieces collide twice")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of the piece with each hash, or that of no piece."""
        got = self.first[(h * _ADD) >> np.uint64(44)]
        same = self.keys[got] == h
        again = np.flatnonzero(self.crowded[got] & ~same)
        got = np.where(same, got, np.int32(self.none))
        if len(again):
            other = self.second[_mix(h[again]) >> np.uint64(44)]
            got[again] = np.where(self.keys[other] == h[again], other, self.none)
        return got

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (words x positions): cumulative chances and ids of the pieces that end at each position, by length."""
        w, n = codes.shape
        most = min(n, self.longest)
        h = np.zeros((n + 1, w), np.uint64)
        for i in range(n):
            h[i + 1] = h[i] * np.uint64(_MUL) + codes[:, i] + np.uint64(1)
        cdf, ids = np.ones((w, n, most), np.float32), np.full((w, n, most), self.none, np.int32)
        alpha = np.zeros((n + 1, w))
        alpha[0] = 1.0
        for end in range(1, n + 1):
            part = np.zeros((w, most))
            for size in range(1, min(end, most) + 1):
                found = self.find(h[end] - h[end - size] * self.power[size])
                weight = self.weight[found]
                if size == 1 and (found == self.none).any():
                    c = codes[:, end - 1]
                    width = 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)
                    weight = np.where(found == self.none, self.rare**width, weight)
                part[:, size - 1] = alpha[end - size] * weight
                ids[:, end - 1, size - 1] = found
            np.cumsum(part, axis=1, out=part)
            total = part[:, -1]
            cdf[:, end - 1] = part / total[:, None]
            alpha[end] = total
            low = max(0, end - most)
            if (total < 1e-150).any():  # ratios alone matter
                alpha[low : end + 1] = np.minimum(alpha[low : end + 1] / total, 1e290)
        return cdf, ids

    def stretch(self, codes: np.ndarray, low: int, high: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """The pieces of a word that end at its positions low + 1 to high, in order of their ends, then sizes.

        Returns where each end's pieces begin, and the pieces' sizes, weights and ids.
        """
        first = max(0, low + 1 - self.longest)
        part = codes[first:high].astype(np.uint64)
        n, at = len(part), low - first
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * self.back[:n], dtype=np.uint64)))
        ends = np.arange(at + 1, n + 1)
        ids = np.full((len(ends), self.longest), self.none, np.int32)
        for size in range(1, min(self.longest, n) + 1):
            e = ends[ends >= size]
            ids[len(ends) - len(e) :, size - 1] = self.find((sums[e] - sums[e - size]) * self.forth[e - 1])
        weight = self.weight[ids]
        lone = np.flatnonzero(ids[:, 0] == self.none)
        c = part[at + lone]
        width = 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)
        weight[lone, 0] = self.rare**width
        row, col = np.nonzero(weight)
        begins = np.searchsorted(row, np.arange(len(ends) + 1))
        return begins.tolist(), (col + 1).tolist(), weight[row, col].tolist(), ids[row, col].tolist()

    def sample_long(self, codes: np.ndarray, keys: list[int], offsets: list[int]) -> list[tuple[list[int], list[int]]]:
        """(ends, ids) of a sampled segmentation of one long word for each occurrence: its row's key and its offset in the text."""
        n = len(codes)
        value, shift = np.ones(n + 1), np.zeros(n + 1, np.int64)  # the chance of all paths to a position is value * 2**shift
        near, exponent = [1.0], 0
        for low in range(0, n, STRETCH):
            begins, sizes, weights, _ = self.stretch(codes, low, min(n, low + STRETCH))
            for r in range(len(begins) - 1):
                total = 0.0
                for x in range(begins[r], begins[r + 1]):
                    total += near[-sizes[x]] * weights[x]
                if total < 1e-100:
                    near, total, exponent = [min(v * 2.0**300, 1e300) for v in near], total * 2.0**300, exponent - 300
                value[low + r + 1], shift[low + r + 1] = total, exponent
                near.append(total)
                if len(near) > 4 * self.longest:
                    del near[: -self.longest]
        out: list[tuple[list[int], list[int]]] = [([], []) for _ in keys]
        left = [n] * len(keys)
        for low in reversed(range(0, n, STRETCH)):
            high = min(n, low + STRETCH)
            begins, sizes, weights, ids = self.stretch(codes, low, high)
            first = max(0, low + 1 - self.longest)
            val, sh = value[first : high + 1].tolist(), shift[first : high + 1].tolist()
            for i, (key, offset) in enumerate(zip(keys, offsets, strict=True)):
                chance = _uniform(np.full(high - low, key & _MASK, np.uint64), np.arange(low + 1, high + 1) + offset).tolist()
                end = left[i]
                while end > low:
                    b, e = begins[end - low - 1], begins[end - low]
                    here = sh[end - first]
                    parts = [weights[x] * val[end - sizes[x] - first] * 2.0 ** (sh[end - sizes[x] - first] - here) for x in range(b, e)]
                    left_over, pick = chance[end - low - 1] * sum(parts), b
                    for x, p in zip(range(b, e), parts, strict=True):
                        pick = x
                        left_over -= p
                        if left_over < 0:
                            break
                    out[i][0].append(end)
                    out[i][1].append(ids[pick])
                    end -= sizes[pick]
                left[i] = end
        return out

    def encode(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts, one after the other, and how many each text has."""
        words: dict[str, int] = {}
        which: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                parts = _PART.findall(" " + t)
                counts[i] = len(parts)
                which += [words.setdefault(p, len(words)) for p in parts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        occ = np.array(which, np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        length = sizes[occ] if len(occ) else np.empty(0, np.int64)
        begin = np.cumsum(length) - length  # in the texts put together
        base = np.zeros(len(texts), np.int64)
        base[counts > 0] = begin[(np.cumsum(counts) - counts)[counts > 0]]
        key = np.array([k & _MASK for k in keys], np.uint64)
        listed = np.array(list(words), object)
        at_all, id_all, char_all = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint32)]
        by_size = np.argsort(length, kind="stable")
        for n in np.unique(length):
            mine = by_size[np.searchsorted(length[by_size], n) : np.searchsorted(length[by_size], n, side="right")]
            if n > LONG:
                for kind in np.unique(occ[mine]):
                    some = mine[occ[mine] == kind]
                    codes = np.frombuffer(listed[kind].encode("utf-32-le"), np.uint32)
                    starts = begin[some]
                    found = self.sample_long(codes, key[row[some]].tolist(), (starts - base[row[some]]).tolist())
                    for start, (ends, ids) in zip(starts.tolist(), found, strict=True):
                        at = np.array(ends, np.int64)
                        at_all.append(start + at)
                        id_all.append(np.array(ids, np.int32))
                        char_all.append(codes[at - 1])
                continue
            kinds, at_kind = np.unique(occ[mine], return_inverse=True)
            step = max(1, CELLS // int(n * min(n, self.longest)))
            for lo in range(0, len(kinds), step):
                some = kinds[lo : lo + step]
                here = (at_kind >= lo) & (at_kind < lo + step)
                codes = np.frombuffer("".join(listed[some]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                cdf, ids = self.forward(codes)
                m, r = mine[here], at_kind[here] - lo
                end, start, k, off = np.full(len(m), n), begin[m], key[row[m]], base[row[m]]
                while len(r):
                    chance = cdf[r, end - 1]
                    u = _uniform(k, start + end - off)
                    size = np.minimum((chance <= u[:, None]).sum(axis=1) + 1, np.minimum(end, cdf.shape[2]))
                    at_all.append(start + end)
                    id_all.append(ids[r, end - 1, size - 1])
                    char_all.append(codes[r, end - 1])
                    end = end - size
                    on = end > 0
                    r, end, start, k, off = r[on], end[on], start[on], k[on], off[on]
        at, ids, chars = np.concatenate(at_all), np.concatenate(id_all), np.concatenate(char_all)
        order = np.argsort(at, kind="stable")
        at, ids, chars = at[order], ids[order], chars[order]
        owner = np.searchsorted(np.cumsum(np.where(counts > 0, np.bincount(row, length, len(texts)), 0)), at) if len(at) else at
        missing = np.flatnonzero(ids == self.none)
        if len(missing):
            raw = [self.byte[list(chr(c).encode())] for c in chars[missing].tolist()]
            reps = np.ones(len(ids), np.int64)
            reps[missing] = [len(x) for x in raw]
            starts = np.cumsum(reps) - reps
            ids, owner = np.repeat(ids, reps), np.repeat(owner, reps)
            for p, x in zip(starts[missing].tolist(), raw, strict=True):
                ids[p : p + len(x)] = x
        return ids.astype(np.int32), np.bincount(owner.astype(np.int64), minlength=len(texts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids put one after the other: all bytes gathered, then the blank before each text taken off."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        flat = self.raw[np.repeat(self.raw_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [flat[a:b].decode()[1:] for a, b in zip(cuts, cuts[1:])]


@functools.cache
def load(path: str, alpha: float = ALPHA) -> Pieces:
    return Pieces(path, alpha)


def _groups(texts: list[str | None]) -> Iterator[slice]:
    """Consecutive rows that are encoded together."""
    first = chars = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > first and (i - first >= ROWS or chars + size > CHARS):
            yield slice(first, i)
            first, chars = i, 0
        chars += size
    if first < len(texts):
        yield slice(first, len(texts))


def _encoder(path: str, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, alpha)
        for batch in batches:
            texts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g in _groups(texts):
                ids, counts = model.encode(texts[g], keys[g])
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                null = pa.array([t is None for t in texts[g]])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=null)
                own = batch.slice(g.start, g.stop - g.start)
                yield pa.RecordBatch.from_arrays([*own.columns[2:], lists], [*own.schema.names[2:], "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                lists = part.column(0)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                found = model.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                texts = pa.array([x if ok else None for x, ok in zip(found, lists.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, texts], [*part.schema.names[1:], "ids", "decoded"])

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, path: str, keep: list[str], alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """``keep`` columns and ids, the pieces of each whole text, drawn with the row's doc_id and ``seed`` as key. No shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").alias("_text"), F.xxhash64("doc_id", F.lit(seed)).alias("_key"), *keep)
    return rows.mapInArrow(_encoder(path, alpha), f"{_schema(rows.drop('_text', '_key'))}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and ``decoded``, the text that the ids stand for."""
    ship(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != "ids"]
    rows = encoded.select("ids", *[F.col(f"`{c}`") for c in rest])
    return rows.mapInArrow(_decoder(path), f"{_schema(rows.drop('ids'))}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_pieces, the digest of the text decoded from the ids, and whether it is the text's own.

    Null text has null ids and digests, and is lossless by definition.
    """
    named = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    back = decode(encode(named, path, ["doc_id", "text_sha256"]), path)
    digest = F.sha2("decoded", 256)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), digest.alias("decoded_sha256"), digest.eqNullSafe(F.col("text_sha256")).alias("lossless"))
