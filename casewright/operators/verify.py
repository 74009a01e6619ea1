"""Verification profiles over generated artifacts. Issues are rows (artifact_id, profile, severity, subject)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.session import ship
from casewright.functions.text import FIDELITY_STOPWORDS, tokens

FIDELITY = 0.60


def missing(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """References (artifact_id, ref) to blocks that don't exist."""
    return refs.join(blocks.select(F.col("id").alias("ref")), "ref", "left_anti")


def grounding(declared: DataFrame, cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Errors: a reference, declared or cited, to no block; and a cited one that is not declared."""
    every = declared.select("artifact_id", "ref").union(cited.select("artifact_id", "ref")).distinct()
    gone = missing(every, blocks).select("artifact_id", F.lit("unknown block").alias("message"), "ref")
    undeclared = cited.select("artifact_id", "ref").distinct().join(declared, ["artifact_id", "ref"], "left_anti").select("artifact_id", F.lit("not declared").alias("message"), "ref")
    return gone.unionByName(undeclared).withColumn("severity", F.lit("error"))


def coverage(rules: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, n, present, coverage) of rule texts: the share of their words, with repeats, that their sources hold.

    ``rules``: id, text; ``links``: id, source, several a rule; ``sources``: source, text. A source is one array of its
    distinct words, a rule is counted in its own row; a rule without a source has no word present.
    """
    held = sources.select("source", F.array_distinct(tokens(F.col("text"), FIDELITY_STOPWORDS)).alias("w"))
    known = links.join(held, "source").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("known"))
    own = rules.select("id", tokens(F.col("text"), FIDELITY_STOPWORDS).alias("w")).join(known, "id", "left")
    present = F.size(F.filter("w", lambda x: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), x)))
    df = own.where(F.size("w") > 0).select("id", F.size("w").cast("long").alias("n"), present.cast("long").alias("present"))
    return df.withColumn("coverage", F.round(F.col("present") / F.col("n"), 6))


def fidelity(rules: DataFrame, links: DataFrame, sources: DataFrame, threshold: float = FIDELITY) -> DataFrame:
    """(id, severity): error without a source, warning without a word or under the threshold; "(paraphrase)" passes."""
    found = rules.join(coverage(rules, links, sources).select("id", "coverage"), "id", "left")
    found = found.join(links.join(sources.select("source"), "source", "left_semi").select("id").distinct().withColumn("_s", F.lit(1)), "id", "left")
    severity = (
        F.when(F.col("_s").isNull(), "error").when(F.lower("text").contains("(paraphrase)"), None)
        .when(F.col("coverage").isNull() | (F.col("coverage") < threshold), "warning")
    )
    return found.withColumn("severity", severity).where("severity IS NOT NULL").select("id", "severity", "coverage")


def rubric_coverage(items: DataFrame, scores: DataFrame) -> DataFrame:
    """(artifact_id, item, severity, message): an item without a score is an error, a score without an item or of another kind a warning."""
    keys = ["artifact_id", "item"]
    df = items.select(*keys, F.col("kind").alias("_want")).join(scores.select(*keys, F.col("kind").alias("_got")), keys, "full_outer")
    message = F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_want") != F.col("_got"), "kind differs")
    df = df.withColumn("message", message).where("message IS NOT NULL")
    return df.select(*keys, F.when(F.col("message") == "missing", "error").otherwise("warning").alias("severity"), "message")


def rubric_shape(items: DataFrame) -> DataFrame:
    """Per rubric: whether there are three items or more, whether weights sum to 0.95 to 1.05, how many lack a label."""
    total = F.round(F.sum("weight"), 6)
    return items.groupBy("artifact_id").agg(
        (F.count(F.lit(1)) >= 3).alias("enough"), total.between(0.95, 1.05).alias("sums_to_one"), F.count_if(F.coalesce(F.trim("label"), F.lit("")) == "").alias("unlabelled")
    )


def passed(issues: DataFrame) -> DataFrame:
    return issues.groupBy("artifact_id").agg((~F.bool_or(F.col("severity") == "error")).alias("passed"))


def _harvest(node: object, keys: tuple[str, ...], kind: str | None, out: dict[str, None]) -> None:
    """Collect the strings of the lists under ``keys``, and the ids of this kind in lists of ``sources``, in order."""
    nodes = [node]
    while nodes:
        x = nodes.pop()
        if isinstance(x, dict):
            for k in keys:
                for s in x[k] if isinstance(x.get(k), list) else ():
                    if isinstance(s, str):
                        out[s] = None
            for s in x["sources"] if kind and isinstance(x.get("sources"), list) else ():
                if isinstance(s, dict) and s.get("kind") == kind and isinstance(s.get("id"), str):
                    out[s["id"]] = None
            nodes.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            nodes.extend(reversed(x))


def cited_ids(content: Column, keys: tuple[str, ...] = ("source_block_ids",), kind: str | None = "block") -> Column:
    """All ids that a JSON text cites at any depth, in order, each once: strings in lists under ``keys`` and
    ``sources`` entries of ``kind``. Text that is no JSON cites nothing. JSON is walked in Arrow batches, as no expression recurses.
    """
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        import json

        def one(text: str | None) -> list[str]:
            out: dict[str, None] = {}
            try:
                _harvest(json.loads(text if isinstance(text, str) and text else "null"), keys, kind, out)
            except ValueError:
                pass
            return list(out)

        # equal texts of a batch are walked once
        numbers, distinct = pd.factorize(texts, use_na_sentinel=False)
        found = pd.Series(list(map(one, distinct)), dtype=object)
        return found.take(numbers).reset_index(drop=True)

    return walk(content)


def sources(refs: Column) -> Column:
    """Source references as (kind, id): plain strings are blocks; those without an id are passed over; each once."""
    one = lambda s: F.when(s.startswith("{"), F.struct(
        F.coalesce(F.get_json_object(s, "$.kind"), F.lit("block")).alias("kind"), F.coalesce(F.get_json_object(s, "$.id"), F.get_json_object(s, "$.ref")).alias("id"),
    )).otherwise(F.struct(F.lit("block").alias("kind"), s.alias("id")))
    return F.array_distinct(F.filter(F.transform(refs, one), lambda x: x["id"].isNotNull() & (x["id"] != "")))
