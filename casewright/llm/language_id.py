"""Language ID by rank-order profiles.

A profile is a language's TOP most frequent letter n-grams in rank order. A document's own most frequent
n-grams are ranked alike, and its distance to a profile is the sum over them of how far each is out of its
place; an n-gram that the profile lacks counts the profile's length. The least distance gives the
language, and one minus the mean displacement (over the profile's length) the score.

N-grams of 1 to 3 code points are taken from the lower-cased letters, with words apart by single spaces,
packed into one 64-bit number each. Counts cover all training documents: tasks emit a batch's counts, which
are summed by (lang, gram); only the ranked profiles, languages x TOP rows, reach the driver and the tasks.

Null texts and texts without a letter get ``und`` with score 0. Equal counts rank by the n-gram, equal
distances go to the language first in the alphabet. Without training documents every text is ``und``. Very long texts
are counted whole, in parts; repeated rows count as often in the profiles and are judged alike; an empty table gives no
rows; extra columns are ignored, by the filter kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import ship

TOP, MAX_N, MAX_LANGS = 400, 3, 1000


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str, size: int = 500_000) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            blank = text.rfind(" ", at, end)
            end = blank if blank > at else end
        yield text[at:end]
        at = end


def grams(text: str, max_n: int = MAX_N) -> np.ndarray:
    """The text's n-grams as packed code points, with repeats; none without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    codes = np.where(is_letter, codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    gap = codes == 32
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]
    out = [codes[codes != 32]]
    packed = codes
    for n in range(2, max_n + 1):
        packed = packed[:-1] | (codes[n - 1 :] << (21 * (n - 1)))
        out.append(packed)
    return np.concatenate(out)


Counts = tuple[np.ndarray, np.ndarray]


def merged(counts: list[Counts]) -> Counts:
    """The sum of several counts."""
    if len(counts) == 1:
        return counts[0]
    kinds, at = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    return kinds, np.bincount(at, np.concatenate([c[1] for c in counts]), len(kinds)).astype(np.int64)


def counted(texts: list[str]) -> Counts:
    """Counts of the n-grams of all texts, held for some 500,000 characters at a time."""
    done: list[Counts] = []
    found: list[np.ndarray] = []
    size = 0
    for part in (p for t in texts for p in _pieces(t)):
        found.append(grams(part))
        size += len(part)
        if size > 500_000:
            done.append(np.unique(np.concatenate(found), return_counts=True))
            found, size = [], 0
            if len(done) > 20:
                done = [merged(done)]
    if found or not done:
        done.append(np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True))
    return merged(done)


def ranked(text: str | None, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    kinds, counts = counted([text or ""])
    return kinds[np.lexsort((kinds, -counts))[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            kinds, counts = counted(texts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(counts)], ["lang", "gram", "n"])


def in_training(key: Column) -> Column:
    """crc32 of the id's text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles from the text and lang of the rows given; rows of null lang or text are passed over."""
    ship(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    found = best.limit(MAX_LANGS * top + 1).collect()
    if len(found) > MAX_LANGS * top:
        raise ValueError(f"over {MAX_LANGS} languages")
    profiles: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["r"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


def _predictor(profiles: dict[str, np.ndarray], top: int):
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.int64)
    # rank of each known n-gram in each language, -1 where it lacks it
    place = np.full((len(langs), len(known)), -1, np.int64)
    for i, x in enumerate(langs):
        place[i, np.searchsorted(known, profiles[x])] = np.arange(len(profiles[x]))

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(text, top)
        if not len(own) or not langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        ranks = np.where(known[at] == own, place[:, at], -1)
        away = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(own))), top), top).sum(axis=1)
        best = int(away.argmin())
        return langs[best], 1.0 - float(away[best]) / (top * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column(0).to_pylist()]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], top: int = TOP) -> DataFrame:
    """``keep`` columns plus lang_pred and score, from the text alone; no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").alias("_text"), *keep)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_predictor(profiles, top), f"{names}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; profiles come from the documents not held out."""
    profiles = fit(docs.where(in_training(F.col("doc_id"))))
    out = docs.select("doc_id", "text", (~in_training(F.col("doc_id"))).alias("held_out"))
    return predict(out, profiles, ["doc_id", "held_out"])


def cutoffs(docs: DataFrame, profiles: dict[str, np.ndarray], low: float = 0.01, least: float = 0.05) -> dict[str, float]:
    """The least score of each language, from the training documents whose own label is predicted.

    A mergeable sketch, the counts of scores in steps of a thousandth, gives their low quantile; the cutoff is three quarters
    of it, but at least ``least``. At most 1001 counts a language are held.
    """
    judged = predict(docs.where("lang IS NOT NULL AND text IS NOT NULL"), profiles, ["lang"]).where("lang_pred = lang")
    sketch = judged.groupBy("lang_pred", F.floor(F.col("score") * 1000).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("lang_pred")
    ranks = sketch.withColumns({"cum": F.sum("n").over(one.orderBy("b")), "total": F.sum("n").over(one)})
    at = lambda q: F.min(F.when(F.col("cum") >= F.ceil(q * F.col("total")), F.col("b"))) / 1000
    rows = ranks.groupBy("lang_pred").agg(at(low).alias("low")).collect()  # a row a language
    return {r["lang_pred"]: max(least, 0.75 * r["low"]) for r in rows}


def filter_language(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """Drop documents without letters and those under the cutoff of the language they are most like (like no learned language).

    A language that no training document was told for has the cutoff ``least``. The documents' columns ride along in a
    struct, so names can't clash; the label in lang serves the training alone.
    """
    train = docs.where(in_training(F.col("doc_id")))
    profiles = fit(train)
    known = cutoffs(train, profiles, least=least)
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    judged = predict(packed, profiles, ["_doc"])
    flat = [F.lit(x) for kv in known.items() for x in kv]
    bar = F.coalesce(F.create_map(*flat)[F.col("lang_pred")], F.lit(least)) if flat else F.lit(least)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= bar)).select("_doc.*")
