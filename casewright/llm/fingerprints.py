"""Document fingerprints by winnowing, in DataFrame expressions.

Tokens are lower-cased words cut into runs of at most 16 letters or digits (one for each Han, Hiragana,
Katakana, Hangul or Thai character); a text without any has its whole text as one token. Each k-gram of
tokens gets its Karp-Rabin value, a polynomial in the tokens' hashes modulo the prime 2^31 - 1. Of every
window of w consecutive values the least is chosen, the rightmost of equal ones, and kept with its
position. Any run of k + w - 1 equal tokens in two texts therefore yields at least one common value.

A text with fewer than k tokens has one gram of all of them; with fewer than w grams one window. Null text
counts as empty: an empty fingerprint, equal to other empty ones. Equal texts have equal fingerprints. Repeated rows
are neighbours like any others, a single row is its own neighbour, an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.common import id_blocks, let, whole_text

K, W = 5, 8
PRIME = (1 << 31) - 1
BASE = 1_000_003_019 % PRIME
TOKEN = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]]{1,16})"
LOW = (1 << 32) - 1


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen (value << 32 | reversed position) numbers of a text in order of position: array<bigint>."""

    def grams(h: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            v = x
            for j in range(1, k):
                v = (v * BASE + F.get(h, i + j)) % PRIME
            return v * F.lit(LOW + 1) + (F.lit(LOW) - i)

        short = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME)
        return F.when(F.size(h) < k, F.array(short * F.lit(LOW + 1) + F.lit(LOW))).otherwise(
            F.transform(F.slice(h, 1, F.size(h) - (k - 1)), value)
        )

    def choose(v: Column) -> Column:
        def least(x: Column, i: Column) -> Column:
            return F.least(x, *[F.get(v, i + j) for j in range(1, w)])

        windows = F.when(F.size(v) <= w, F.array(F.array_min(v))).otherwise(F.transform(F.slice(v, 1, F.size(v) - (w - 1)), least))
        return F.array_distinct(windows)

    def of_tokens(t: Column) -> Column:
        t = F.when(F.size(t) == 0, F.array(text)).otherwise(t)
        hashes = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))
        return let(hashes, lambda h: let(grams(h), choose))

    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(let(tokens, of_tokens))


def values(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftrightunsigned(x, 32)))


def printed(prints: Column) -> Column:
    """value@position in order of position, the value as 8 hexadecimal digits."""
    one = lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0"), F.lit("@"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("string"))
    return F.array_join(F.transform(prints, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, add, rows: int = 512, most: int = 65_536) -> DataFrame:
    """Give each row the row before it in ascending (doc_id, hash of the text) order, the first row the last one.

    Rows are dealt once, by ranges of that order. The last row of each range is dealt to the following range
    as well, so that the neighbour is always in the same range; a table of about ``most`` ranges at most says
    which row that is and which range follows. ``add`` maps a DataFrame (doc_id, text) to one with more columns
    after the shuffle.
    """
    docs = docs.select("doc_id", whole_text().alias("text"), F.shiftrightunsigned(F.xxhash64(whole_text()), 11).alias("_h"))
    block = id_blocks(docs, "doc_id", F.col("_h") / F.lit(float(1 << 53)), rows=rows, most=most)
    docs = docs.withColumn("_b", block)
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"), F.col("_h"))
    ends = docs.groupBy("_b").agg(F.max(place).alias("_last"))
    everything = Window.partitionBy(F.lit(0))
    ends = ends.select(
        F.col("_b").alias("_eb"), "_last",
        F.coalesce(F.lead("_b").over(everything.orderBy("_b")), F.min("_b").over(everything)).alias("_to"),
    )
    dealt = docs.join(F.broadcast(ends), F.col("_b") == F.col("_eb"), "left")
    ghost = place.eqNullSafe(F.col("_last"))
    here, there = F.struct(F.col("_b").alias("b"), F.lit(1).alias("own")), F.struct(F.col("_to").alias("b"), F.lit(0).alias("own"))
    dealt = dealt.select("doc_id", "text", "_h", F.explode(F.when(ghost, F.array(here, there)).otherwise(F.array(here))).alias("_p"))
    dealt = add(dealt.select("doc_id", "text", "_h", F.col("_p.b").alias("_b"), F.col("_p.own").alias("_own")).repartition("_b"))
    order = Window.partitionBy("_b").orderBy("_own", F.col("doc_id").asc_nulls_first(), "_h", "text")
    made = [c for c in dealt.columns if c not in ("doc_id", "_b", "_own", "_h")]
    return dealt.withColumns({f"next_{c}": F.lag(c).over(order) for c in made}).where("_own = 1").drop("_b", "_own", "_h")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Rows that share a doc_id, or lack one, are ordered by the hash of their text; rows without one come before all others.
    """
    df = with_next(docs, lambda d: d.withColumn("prints", winnow(F.col("text"))))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    df = df.withColumns({"_edited_prints": winnow(F.col("_edited")), "edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256)})
    df = df.withColumns({"_v": values(F.col("prints")), "_e": values(F.col("_edited_prints")), "_n": values(F.col("next_prints"))})
    return df.select(
        "doc_id", "n_chars", "edited_sha256",
        printed(F.col("prints")).alias("fingerprint"), printed(F.col("_edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("_v"), F.col("_e")).alias("near_edited"), likeness(F.col("_v"), F.col("_n")).alias("near_next"),
    )
