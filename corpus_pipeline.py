"""The corpus pipeline: five stages over documents, each of which works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.llm import language_id, ngram_join, packing, pii, quality
from casewright.llm.common import cut, documents
from casewright.llm.queries import WORD_BPE, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents like no learned language, or without letters, go."""
    return language_id.filter_language(docs.select(*COLUMNS))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adaptive quality rules; rejected documents go."""
    return quality.filter_quality(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; the document with the least id of each group stays."""
    return ngram_join.deduplicate(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences along the space-filling curve: one row per piece, with its token ids."""
    return packing.pack(docs.select(*COLUMNS), tokenizer_path(WORD_BPE))


STAGES = [("language", by_language), ("quality", by_quality), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packed)]

#: Trained models, MinHash and a tokenizer are beyond SQL; tests/llm/test_operators.py holds the whole pipeline against plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage kept is checkpointed for the next."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
