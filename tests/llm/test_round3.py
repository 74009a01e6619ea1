"""Search, manifest and near-duplicate detection against plain versions, SQL and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import manifest, minhash, search
from casewright.llm.common import drop, stored
from casewright.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, repeated and tied rows, with extra columns of clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, long, "en", "a"), (5, "x" * 100_000, "en", "a"), (6, "ÀÉ É straße 😀 Word WORD", None, "b"),
        (7, "the same words here again", "en", "a"), (7, "the same words here again", "en", "a"), (8, "The Same words here again", "fr", "a"), (None, "no id 😀 é", "en", "a"), (None, None, None, None), (9, "one", "en", "a"), (10, "ONE", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "tree": F.lit(1), "node": F.lit("k"), "term": F.lit(2), "rank": F.lit(3), "shard": F.lit(4), "bucket": F.lit(5)})


# -- search ---------------------------------------------------------------------------------------------


def plain_search(docs, items, top=50):
    terms = lambda t: re.findall(search.TERM, (t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, (doc is not None, doc or 0), doc))
        out |= {(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:top], 1)}
    return out


def test_search_is_brute_force_and_its_sql(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for rows, block in ((16_384, 256), (37, 7)):  # one shard, and many with several blocks of items
        got = search.search(search.build_index(docs, rows=rows), items, block=block).collect()
        assert {(r.item_id, r.rank, r.doc_id, r.score) for r in got} == want and len(got) == len(want)
    names = ["item_id", "rank", "doc_id", "score"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    assert {tuple(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op11_search']})").fetchall()} == want


def test_search_odd_rows_and_ties(spark, odd):
    items = spark.createDataFrame([(1, "same WORDS again"), (1, "same WORDS again"), (1, "w7 w8"), (2, None), (3, "!!"), (None, "É"), (4, "absent"), (5, "one the no")], "item_id long, text string").withColumn("block", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain_search(rows, [(1, "same WORDS again"), (1, "w7 w8"), (None, "É"), (5, "one the no")], 3)
    got = search.search(search.build_index(odd, rows=2), items, top=3).collect()
    assert {tuple(r) for r in got} == want
    assert search.search(search.build_index(odd.limit(0)), items).count() == 0
    assert search.search(search.build_index(odd), items.limit(0)).count() == 0
    ties = spark.range(500).select((F.lit(1000) - F.col("id")).alias("doc_id"), F.lit("alike in every word").alias("text")).unionByName(odd.select("doc_id", "text"))
    best = search.search(search.build_index(ties, rows=64), spark.createDataFrame([(1, "alike word")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in best] == list(range(501, 551)) and [r["rank"] for r in best] == list(range(1, 51))


def test_postings_and_heaps_are_plain():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << int(b), 50) for b in range(1, 50)] + [[0, 127, 128, (1 << 62)]])
    data, _ = search.pack_numbers(values)
    assert (search.unpack_numbers(data.tobytes()) == values).all() and len(search.unpack_numbers(b"")) == 0
    for _ in range(200):
        n, lists, scores = int(rng.integers(1, 80)), [], Counter()
        for _ in range(int(rng.integers(0, 9))):
            places = sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
            parts = rng.integers(0, 6, len(places)).tolist()
            scores.update(dict(zip(places, parts, strict=True)))
            lists.append((max(parts), [(p << search.SHIFT) | c for p, c in zip(places, parts, strict=True)]))
        want = sorted(((s, -p) for p, s in scores.items() if s > 0), reverse=True)[:5]
        assert search.best(lists, n, 5, int(rng.integers(1, 20))) == want


# -- manifest -------------------------------------------------------------------------------------------


def plain_manifest(rows, arity=8):
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h([enc(r.doc_id), enc(r.source), enc(r.lang), enc(r.n_chars), enc(text)])

    def climb(nodes):
        """(root, [(siblings before, after) a level] of each node)."""
        ways = [[] for _ in nodes]
        groups = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            new, joined = [], []
            for lo in range(0, len(nodes), arity):
                run = nodes[lo : lo + arity]
                for k, below in enumerate(groups[lo : lo + arity]):
                    for i in below:
                        ways[i].append((run[:k], run[k + 1 :]))
                new.append(h(run))
                joined.append([i for g in groups[lo : lo + arity] for i in g])
            nodes, groups = new, joined
        return nodes[0], ways

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for x in langs:
        by_lang[x].sort(key=lambda t: t[:3])
        subs[x] = climb([t[2] for t in by_lang[x]])
    root, tops = climb([subs[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, own, r), way in zip(by_lang[x], subs[x][1], strict=True):
            node = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                node = leaf(r, None if r.text is None else r.text.translate(LOWER))
            for before, after in way + top:
                node = h([*before, node, *after])
            proof = h([d for before, after in way + top for d in (*before, *after)])
            out.append((r.doc_id, own, subs[x][0], root, proof, node, node == root))
    return Counter(out)


def test_manifest_is_plain_at_all_shapes(spark, docs, odd):
    rows = docs.collect()
    for arity, levels in ((8, 4), (8, 1), (2, 2), (3, 1)):
        assert Counter(map(tuple, manifest.build(docs, arity, levels).collect())) == plain_manifest(rows, arity), (arity, levels)
    want = plain_manifest(odd.collect())
    assert Counter(map(tuple, manifest.build(odd).collect())) == want == Counter(map(tuple, manifest.build(odd, levels=1).collect()))
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)
    assert manifest.build(odd.limit(0)).count() == 0
    one = manifest.build(docs.limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    many = spark.range(300).select("id", F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("T").alias("text"))
    assert Counter(map(tuple, manifest.build(many, levels=1).collect())) == plain_manifest(many.collect())


def test_manifest_is_its_sql(spark, docs, odd):
    names = ", ".join(manifest.NAMES)
    for frame in (docs, odd.select("doc_id", "text", "lang", "source", "n_chars")):
        con = duckdb.connect()
        con.register("documents", frame.toArrow())
        got = Counter(con.execute(f"SELECT {names} FROM ({ORACLE['op12_manifest']})").fetchall())
        assert got == Counter(map(tuple, manifest.build(frame).collect()))


def test_a_proof_shows_each_tampering():
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(77)]
    root, siblings, places = manifest.walk(leaves, 3)
    for i, leaf in enumerate(leaves):
        assert manifest.fold(leaf, siblings[i], places[i]) == root
        assert manifest.fold(leaves[i - 1], siblings[i], places[i]) != root


# -- near duplicates ------------------------------------------------------------------------------------


def plain_components(rows, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append(frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([(w,) for w in words]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    label = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((d, len(s), label[find(i)], d == label[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_near_duplicates_are_brute_force(spark, docs, odd):
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == plain_components(rows_of(docs))
    assert Counter(map(tuple, minhash.near_duplicates(odd).collect())) == plain_components(rows_of(odd))
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_in_chains_and_borderline_groups(spark, monkeypatch):
    """Chains whose ends are unlike, a group of copies about the threshold, shared passages: nothing is lost in small blocks."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(0, 4000)}"
    texts, base = [], [word() for _ in range(60)]
    for _ in range(40):  # a chain: each a bit on from the last
        base = [*base[2:], word(), word()]
        texts.append(" ".join(base))
    core = [word() for _ in range(50)]
    for k in range(90):  # copies with up to eight words changed
        some = core[:]
        for at in rng.choice(50, k % 9, replace=False):
            some[at] = word()
        texts.append(" ".join(some))
    passage = [word() for _ in range(30)]
    texts += [" ".join(passage + [word() for _ in range(6 + k % 12)]) for k in range(60)] + ["Two Words", "two words", "TWO", "two"] * 2
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(minhash, "STAR", 4)
    for quick in (1, 2):
        monkeypatch.setattr(minhash, "QUICK", quick)
        assert Counter(map(tuple, minhash.near_duplicates(frame).collect())) == want


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for size in (1, 3, 30, 3000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[: max(1, size * 9 // 10)], rng.integers(0, 1 << 63, size // 10, dtype=np.uint64)])
        same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - same) < (0.25 if size < 30 else 0.08)
        assert (minhash.signature(a) == minhash.signature(rng.permutation(a))).all()
        assert (minhash.band_hashes(a) == minhash.band_hashes(np.sort(a))).all()
    assert minhash.RECALL > 0.9999
    hits = 0
    for _ in range(300):  # pairs at the threshold, of 9 values and of 90
        size = int(rng.choice([9, 90]))
        v = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        k = size // 9
        hits += bool(len(np.intersect1d(minhash.band_hashes(v[: 9 * k]), minhash.band_hashes(np.concatenate([v[: 8 * k], v[9 * k : 10 * k]])))))
    assert hits >= 299


def test_stored_tables_are_read_back_and_dropped(spark, tmp_path):
    import os

    df = stored(spark.range(5).selectExpr("id", "array(id) AS a", "struct(id AS x) AS s", "CAST(NULL AS BINARY) AS b"))
    assert df.count() == 5 and df.schema["a"].dataType.simpleString() == "array<bigint>"
    files = df.inputFiles()
    drop(df)
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
