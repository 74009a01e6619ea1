"""Quality rules with adaptive thresholds.

Each document's counts are turned into a few integer measures. Per language and source, a mergeable
quantile sketch of each measure (relative-error buckets: the counts of equal powers of GAMMA, merged by
plain addition) gives the quartiles, and the fences lie REACH quartile distances beyond the median, a distance
being one bucket at least. Of a measure that most rows have at 0, the sketch of the other rows gives the quartiles.
No threshold is fixed beforehand. Where a group's quartiles rest on few rows, the merged sketch of its language
gives the measure's fences, then that of all rows.

Buckets and sums are exact integers, so thresholds are the same in every run and partitioning, and a hot
source is pre-aggregated before its shuffle. Null text has no words and fails the base rules; a null
language or source is a group of its own; repeated rows are judged alike; an empty table gives no rows. Texts are
counted whole whatever their length; extra columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import WORD, cut, let, whole_text

GAMMA = 1.02
#: measure -> whether there is a fence below the median as well
MEASURES = {"word_len": True, "others": False, "symbols": False, "marks": False, "upper": False, "dup_lines": False, "repeats": False}
#: Rows behind a group's quartiles at least, and quartile distances from the median to a fence.
MIN_ROWS, REACH = 200, 12.0
NONE = "\x00"


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more in the text, the first included.

    Window hashes are compared first; only texts with a repeat are sorted, and windows of equal hash
    count as equal (64 bits). Positions of repeated windows in order cover min(5, gap) new words each.
    """

    def windows(w: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            return F.transform(F.slice(h, 1, F.size(h) - 4), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, 5)]))

        return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)

    def count(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def with_last(last: Column) -> Column:
                # a window is repeated if a neighbour in hash order is equal
                hits = F.filter(
                    s,
                    lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
                )
                at = F.array_sort(F.transform(hits, lambda x: x["i"]))
                return let(
                    at,
                    lambda p: F.aggregate(
                        p,
                        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).cast("int").alias("at")),
                        lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["at"])).alias("n"), x.alias("at")),
                        lambda a: a["n"],
                    ),
                )

            return let(F.size(s) - 1, with_last)

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, of_sorted))

    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(let(windows(words), count))


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the base counts of each whole text, one scan, no shuffle."""
    text = whole_text()
    df = docs.withColumn("_t", text).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), 1))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("_l", lines)
    without = lambda p: (F.length("_t") - F.length(F.regexp_replace("_t", p, ""))).cast("long")
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": without(r"[#*$%&|<>]+"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_w")),
            "n_marks": without(r"[!?=@^~_{}\[\]\\]+"),
            "n_upper": without(r"\p{Lu}+"),
            "n_letters": without(r"[\p{L}\p{M}]+"),
        }
    ).drop("_t", "_w", "_l")


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda n, d, k: F.floor(F.col(n) * k / d).cast("long")
    return {
        "word_len": per("word_chars", words, 100),
        "others": F.floor((F.col("word_chars") - F.col("n_letters")) * 10000 / F.greatest(F.col("word_chars"), F.lit(1))).cast("long"),
        "symbols": per("n_symbols", words, 10000),
        "marks": per("n_marks", words, 10000),
        "upper": per("n_upper", F.greatest(F.col("word_chars"), F.lit(1)), 10000),
        "dup_lines": per("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)), 10000),
        "repeats": per("n_repeat_words", words, 10000),
    }


def with_verdict_inputs(docs: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = docs.withColumns({f"m_{k}": v for k, v in _measures().items()})
    return df.withColumns({"base_failed": base, "_lang": F.coalesce("lang", F.lit(NONE)), "_source": F.coalesce("source", F.lit(NONE))})


def bucket(x: Column) -> Column:
    """The sketch bucket of a whole number; 0 has the bucket -1."""
    return F.when(x <= 0, F.lit(-1)).otherwise(F.ceil(F.log(x) / F.lit(math.log(GAMMA))).cast("int"))


def thresholds(stats: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """One row per (language, source) with the fences of every measure, from the rows that pass the base rules.

    The sketch has at most about 1000 buckets a group and measure.
    """
    names = list(MEASURES)
    cells = F.array(*[F.struct(F.lit(i).alias("m"), bucket(F.col(f"m_{k}")).alias("b")) for i, k in enumerate(names)])
    sketch = (
        stats.where(~F.col("base_failed")).select("_lang", "_source", F.explode(cells).alias("c"))
        .groupBy("_lang", "_source", F.col("c.m").alias("m"), F.col("c.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    )
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("_lang").alias("l"), F.col("_source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("_lang").alias("l"), F.lit("").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
    )
    merged = sketch.select(F.explode(levels).alias("k"), "m", "b", "n").groupBy("k.level", "k.l", "k.s", "m", "b").agg(F.sum("n").alias("n"))
    cell = Window.partitionBy("level", "l", "s", "m")
    zeros = F.coalesce(F.sum(F.when(F.col("b") < 0, F.col("n"))).over(cell), F.lit(0))
    merged = merged.withColumns({"all": F.sum("n").over(cell), "zeros": zeros}).where((F.col("b") >= 0) | (2 * F.col("zeros") < F.col("all")) | (F.col("zeros") == F.col("all")))
    ranked = merged.withColumns({"cum": F.sum("n").over(cell.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(cell)})
    value = F.when(F.col("b") < 0, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("b")) / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("cum") >= F.ceil(q * F.col("total")), value))
    quart = ranked.groupBy("level", "l", "s", "m").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("total").alias("total"))
    width = F.greatest(F.col("q2") * (GAMMA - 1), F.lit(1.0))
    low = F.array(*[F.lit(MEASURES[k]) for k in names])[F.col("m")]
    fences = quart.select(
        "level", "l", "s", "m", "total",
        (F.col("q2") + reach * F.greatest(F.col("q3") - F.col("q2"), width)).alias("hi"),
        F.when(low, F.col("q2") - reach * F.greatest(F.col("q2") - F.col("q1"), width)).otherwise(-1.0).alias("lo"),
    )
    cols = [f"{c}_{k}" for k in names for c in ("total", "hi", "lo")]
    wide = fences.groupBy("level", "l", "s").agg(*[F.max(F.when(F.col("m") == i, F.col(c))).alias(f"{c}_{k}") for i, k in enumerate(names) for c in ("total", "hi", "lo")])
    group, lang, whole = (wide.where(F.col("level") == i) for i in range(3))
    renamed = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("l", "s", *cols)])
    out = renamed(group, "g_").join(renamed(lang, "l_"), F.col("g_l") == F.col("l_l"), "left").join(F.broadcast(renamed(whole, "w_")), F.lit(True), "left")

    def pick(c: str, k: str) -> Column:
        enough = lambda p: F.col(f"{p}_total_{k}") >= min_rows
        return F.when(enough("g"), F.col(f"g_{c}_{k}")).when(enough("l"), F.col(f"l_{c}_{k}")).otherwise(F.col(f"w_{c}_{k}"))

    return out.select(F.col("g_l").alias("_tl"), F.col("g_s").alias("_ts"), *[pick(c, k).alias(f"{c}_{k}") for k in names for c in ("hi", "lo")])


def judge(stats: DataFrame, fences: DataFrame, small: int = 200_000) -> DataFrame:
    """Add ``kept``. The fences are broadcast while they are at most ``small`` rows (some 20 MB), else joined by shuffle.

    A group none of whose rows passes the base rules has no fences, and none are needed.
    """
    fences = cut(fences)
    if fences.count() <= small:
        fences = F.broadcast(fences)
    joined = stats.join(fences, (F.col("_lang") == F.col("_tl")) & (F.col("_source") == F.col("_ts")), "left")
    inside = F.lit(True)
    for k in MEASURES:
        inside = inside & (F.col(f"m_{k}") <= F.col(f"hi_{k}")) & (F.col(f"m_{k}") >= F.col(f"lo_{k}"))
    # one condition over both sides: a part of it alone would be pushed into the scan and count words per element
    kept = F.coalesce(F.when(F.col("base_failed"), F.lit(False)).otherwise(inside), F.lit(False))
    drop = [f"{c}_{k}" for k in MEASURES for c in ("hi", "lo")]
    return joined.withColumn("kept", kept).drop("_tl", "_ts", "_lang", "_source", *drop)


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document. The counts, a narrow table, are checkpointed; the texts are read once."""
    narrow = with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text")
    stats = with_verdict_inputs(cut(narrow))
    return judge(stats, thresholds(stats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    Own columns are carried in a struct, so names can't clash. Texts are read and counted once: documents
    and counts are checkpointed together (the size of the input), and never shuffled.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text", "lang", "source")
    stats = with_verdict_inputs(cut(with_counts(packed).drop("doc_id", "text")))
    return judge(stats, thresholds(stats)).where("kept").select("_doc.*")
