"""Packing's workers hold a bounded part of a batch, whatever the batch holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from casewright.llm import packing
from casewright.llm.queries import WORD_BPE, tokenizer_path


def test_pieces_and_vectors_are_made_a_part_at_a_time():
    n = 3 * packing.PART + 5
    path = tokenizer_path(WORD_BPE)
    texts = pa.array([f"word {i} and more" for i in range(n)])
    sampled = list(packing._vectors(path)(iter([pa.RecordBatch.from_arrays([texts, pa.array(range(n), pa.int64())], ["text", "tie"])])))
    assert [b.num_rows for b in sampled] == [packing.PART] * 3 + [5]
    ids = packing.tokenize(texts.to_pylist(), path)
    assert [x for b in sampled for x in b["n"].to_pylist()] == [len(x) // 2 for x in ids]
    assert len(packing._tokenizer(path)[2]) > 0
    sizes = np.array([len(x) // 2 for x in ids])
    cols = [range(n), [0] * n, sizes, ids, np.cumsum(sizes) - sizes, [int(sizes.sum())] * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "range", "n", "ids", "before", "total"])
    pieces = list(packing._pieces(64)(iter([batch])))
    assert len(pieces) == 4
    found = b"".join(x for b in pieces for x in b["ids"].to_pylist())
    assert np.array_equal(np.frombuffer(found, "<u4"), np.frombuffer(b"".join(ids), "<u2"))
    # the tokenizer and its known words are let go before pieces are cut
    assert packing._tokenizer.cache_info().currsize == 0
