"""Findings of round 3, second part: what the operators ask of the driver."""

from __future__ import annotations

import re

from casewright.llm import common, minhash, ngram_join


def test_no_plan_of_near_duplicates_is_large(spark, monkeypatch):
    """A table that is read twice is stored, so that no plan repeats what another has: joins and aggregates a plan are few."""
    sizes = []

    def weigh(df):
        sizes.append(len(re.findall(r"\b(?:Join|Aggregate) ", df._jdf.queryExecution().optimizedPlan().toString())))
        return df

    for module in (minhash, ngram_join):
        monkeypatch.setattr(module, "stored", lambda df: common.stored(weigh(df)))
    rows = [(i, " ".join(f"w{i // 3 * 100 + j}" for j in range(30 + i % 3))) for i in range(60)]
    got = weigh(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i // 3 * 3) for i, _ in rows}
    assert max(sizes) <= 12 and sum(sizes) <= 150, sizes
