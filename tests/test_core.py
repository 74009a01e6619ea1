"""Helpers, odd rows and limits of the engine's operators, each against plain code or fixed values."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import schema
from casewright.functions import text as X
from casewright.operators import cells, desk, ingest, ledger, patterns, profiles, replies, resolve, retrieve, segment, study, verify
from casewright.sources import archive, conversions, store, templates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- resolution -----------------------------------------------------------------------------------------


def test_mentions_are_resolved_as_by_brute_force(spark):
    """Every distinct mention against every name."""
    names = ["Hadley v. Baxendale", "Marbury v. Madison", "Palsgraf v. Long Island Railroad", "International Shoe v. Washington", "Pennoyer v. Neff", "Erie Railroad v. Tompkins", "Shelley v. Kraemer", "Lochner v. New York"]
    texts = [
        "As in Hadley v. Baxendale and Hadly vs. Baxendale.", "See Marbury versus Madison; Marbury v. Maddison too.", "The Palsgraf v. Long Island Rail Road case", "Compare Intl Shoe v. Washington with Penoyer v Neff",
        "Erie B Tompkins was cited. Shelly v. Kramer, not Smith v. Jones.", "Lochner v. New York City", "nothing here", "", None, "New York Times",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.key, r.raw): r for r in resolve.resolve(rows, known).collect()}
    norms = {r.name: r.norm for r in known.select("name", X.fuzzy_name(F.col("name")).alias("norm")).collect()}
    kept = {}
    for c in resolve.candidates(rows).collect():
        best = max(sorted(norms), key=lambda n: resolve.similarity(c.norm, norms[n]))
        score = resolve.similarity(c.norm, norms[best])
        if score >= 82:
            rank = 3 if c.raw == best else 2 if c.norm == norms[best] else 1
            kept[c.key, best] = max(kept.get((c.key, best), (0, 0.0, 0, "")), (rank, score, -c.position, c.raw))
    want = {(k, best): (("fuzzy", "normalized", "exact")[v[0] - 1], v[3], round(v[1], 6)) for (k, best), v in kept.items()}
    assert {(r.key, r.canonical): (r.method, r.raw, round(r.score, 6)) for r in got.values() if r.canonical} == want
    assert len(want) > 6


def test_resolver_is_all_pairs_on_random_names(spark, monkeypatch):
    """Short names, near misses, shared tokens, repeated tokens, no separator, odd characters: the best of all pairs, in many blocks."""
    rng = random.Random(5)
    letters = "abcdeilnorstuvwé"
    word = lambda k: "".join(rng.choice(letters) for _ in range(k)).capitalize()
    names = ["Io v. La", "Ng v. Wu", "Cole v. Dray", "V. v. V.", "v.", "United States v. New York", "In re A", "A v. A", "A"]
    names += [f"{word(rng.randint(2, 4))} v. {word(rng.randint(2, 4))}" for _ in range(40)] + [f"{word(rng.randint(2, 12))} {word(rng.randint(2, 12))} v. {word(rng.randint(2, 16))}" for _ in range(40)]
    said = ["Nig v. Wsu", "Ciolie v. Dsrany", "Ino v. Lma", "United States", "New York v. United States", "A A v. A", "X", ""]
    for name in names * 4:
        chars = list(name)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.randint(0, 1)] = rng.choice(letters)
        said.append("".join(chars))
    said += [f"{word(rng.randint(1, 9))} v. {word(rng.randint(1, 9))}" for _ in range(100)]
    monkeypatch.setattr(resolve, "NAMES", 16)
    monkeypatch.setattr(resolve, "MENTIONS", 50)
    known = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    norms = {}
    for r in known.where("name IS NOT NULL").select("name", X.fuzzy_name(F.col("name")).alias("norm")).distinct().orderBy("name").collect():
        norms.setdefault(r.norm, r.name)
    asked = [r.norm for r in spark.createDataFrame([(t,) for t in said], "t string").select(X.fuzzy_name(F.col("t")).alias("norm")).distinct().collect()]
    want = {}
    for a in asked:
        best = max(resolve.similarity(a, n) for n in norms)
        if best >= 82:
            want[a] = (min(norms[n] for n in norms if resolve.similarity(a, n) == best), round(best, 6))
    blocks = resolve.name_blocks(known)
    assert blocks.count() > 3
    got = resolve.scored(spark.createDataFrame([(a,) for a in asked], "norm string"), blocks, 82.0).collect()
    assert {r.norm: (r.canonical, round(r.score, 6)) for r in got} == want
    assert len(want) > 100 and {"nig v. wsu", "ino v. lma"} <= {a.lower() for a in want}
    one, many = resolve._Forms(asked), resolve._Forms(list(norms))
    for i in range(0, len(asked), 7):
        most = resolve.bound(one, i, many)
        assert all(resolve.similarity(asked[i], n) <= m for n, m in zip(norms, most, strict=True))
    assert resolve.scored(spark.createDataFrame([("a v. b",)], "norm string"), resolve.name_blocks(known.limit(0)), 82.0).count() == 0
    texts = spark.createDataFrame([(1, "As in Nig v. Wsu today.")], "id int, text string")
    found = resolve.resolve(texts, resolve.name_blocks(known.where("name like '% v. %'"))).collect()
    assert [(r.raw, r.canonical, r.method) for r in found] == [("Nig v. Wsu", "Ng v. Wu", "fuzzy")]


def test_longest_common_subsequence_is_plain():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for a, b in (("", "x"), ("abc", "abc"), ("Hadley v. Baxendale", "Hadly vs. Baxendale"), ("aaaa", "aa"), ("xyz", "abc")):
        assert resolve.lcs(a, b) == plain(a, b)


# -- templates ------------------------------------------------------------------------------------------


def test_templates_are_read_split_and_compiled(spark, tmp_path):
    head = "---\nname: one\nversion: 1\ndescription: >\n  two\n  lines: of it\ninputs:\n  a: \"str\"\noutput_schema: 's.json'\nmodel_defaults:\n  model: m-1\nlist:\n  - x\n---\n"
    got, body = templates.split("\ufeff" + head + "\nBody\n---\nmore\n")
    assert got == {"name": "one", "version": "1", "description": "two lines: of it", "inputs": {"a": "str"}, "output_schema": "s.json", "model_defaults": {"model": "m-1"}, "list": ["x"]} and body == "Body\n---\nmore\n"
    for bad in ("no header", "---\nname: x\n", "--- x\nname: x\n---\n", "---\nname: x\nversion: 1\n---\nbody"):
        with pytest.raises(templates.TemplateError, match="frontmatter"):
            templates.split(bad)
    (tmp_path / "b.prompt.md").write_text(head + "B {{x}}")
    (tmp_path / "a.prompt.md").write_text(head + "A")
    (tmp_path / "c.md").write_text("no template")
    assert {n: b for n, (_, b) in templates.load(spark, str(tmp_path)).items()} == {"a": "A", "b": "B {{x}}"}
    assert list(templates.load(spark, str(tmp_path))) == ["a", "b"]
    for bad, word in (("{{#each x}}a", "unclosed each"), ("a{{/if}}", "stray close of if"), ("{{#if x}}{{#each y}}{{/if}}{{/each}}", "unclosed each"), ("{{else}}", "stray else"), ("{{#if x}}{{else}}{{else}}{{/if}}", "stray else"), ("{{a b c}}", "not understood"), ("{{}}", "not understood")):
        with pytest.raises(templates.TemplateError, match=word):
            templates.parse(bad)
    rows = spark.createDataFrame(
        [(1, "a<b", 0, True, ["x", None, "y"], {"k": 1}, {"n": {"t": "deep"}, "l": []}, [[1, 2], []]), (2, None, None, None, None, None, None, None), (3, "", 5, False, [], {}, {"n": None, "l": [3]}, [])],
        "id int, s string, i int, b boolean, a array<string>, m map<string,int>, o struct<n:struct<t:string>,l:array<int>>, aa array<array<int>>",
    )
    show = lambda body: [r.x for r in rows.orderBy("id").select(templates.rendered(body, rows).alias("x")).collect()]
    assert show("{{s}}|{{{s}}}|{{&s}}|{{i}}|{{b}}") == ["a&lt;b|a<b|a<b|0|true", "||||", "|||5|false"]
    assert show("{{#if s}}s{{/if}}{{#if i}}i{{/if}}{{#if b}}b{{/if}}{{#if a}}a{{/if}}{{#if m}}m{{/if}}{{#if o}}o{{/if}}{{#if none}}none{{/if}}") == ["sbamo", "", "io"]
    assert show("{{#each a}}{{@index}}{{this}}{{#if @last}}.{{else}},{{/if}}{{else}}none{{/each}}") == ["0x,1,2y.", "none", "none"]
    assert show("{{#each aa}}({{#each this}}{{this}}{{../../id}}{{/each}}){{/each}}") == ["(1121)()", "", ""]
    assert show("{{o.n.t}}{{o/n/t}}{{o.n.t.u}}{{a.0}}{{a.length}}{{m.k}}{{m.z}}") == ["deepdeepx31", "", "0"]
    assert show("{{#each m}}{{@key}}={{this}}{{/each}}{{#each o}}{{@key}}{{/each}}{{#with o.n}}{{t}}{{../id}}{{else}}no{{/with}}") == ["k=1nldeep1", "no", "nlno"]
    assert show("{{#a}}{{this}}{{/a}}{{#s}}S{{/s}}{{#o}}{{#n}}{{t}}{{/n}}{{/o}}{{#unless b}}u{{/unless}}{{#unless none}}v{{/unless}}") == ["xySdeepv", "uv", "uv"]
    assert show("a {{~! gone ~}} b{{!-- {{x}} --}}{{#if s ~}} c {{~/if}}")[0] == "abc"
    assert json.loads(show("{{{o}}}")[0]) == {"n": {"t": "deep"}, "l": []} and show("plain") == ["plain"] * 3 and show("") == [""] * 3


# -- schemas --------------------------------------------------------------------------------------------


def test_compiled_schemas_find_what_the_walk_finds(spark):
    claim = {"type": "object", "required": ["text", "ids"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 5, "pattern": "^[a-z]*$"}, "ids": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string"}}}}
    shape = {
        "type": "object", "$defs": {"C": claim}, "required": ["a", "n"],
        "properties": {
            "a": {"$ref": "#/$defs/C"}, "list": {"type": "array", "items": {"$ref": "#/$defs/C"}}, "n": {"type": ["number", "null"], "minimum": 1, "maximum": 9}, "i": {"type": "integer"}, "e": {"enum": ["x", 1, None, [1, "y"], {"k": True}]},
            "c": {"const": "fix"}, "any": {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "integer"}}]}, "nested": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}}, "free": {}, "odd": {"type": "nothing"}, "gone": {"$ref": "#/none"},
        },
    }
    rng = random.Random(1)
    claims = lambda: {"text": rng.choice(["ab", "", 5, "UP", "toolong"]), "ids": rng.choice([["a"], [], ["a", "b", "c"], [1], "a"]), **({"z": 1} if rng.random() < 0.2 else {})}
    likely = {
        "a": claims, "list": lambda: [claims() for _ in range(rng.randrange(3))], "n": lambda: rng.choice([0, 5, 10, 1.5, None]), "i": lambda: rng.choice([1, -7, 2.5, True]), "e": lambda: rng.choice(["x", 1, 1.5, True, None, [1, "y"], {"k": True}, "q"]),
        "c": lambda: rng.choice(["fix", "fix", 1]), "any": lambda: rng.choice(["s", [1], [1.5], 2]), "nested": lambda: [[True], [1], []],
    }

    def some(depth=0):
        k = rng.randrange(12 if depth < 3 else 9)
        if k < 9:
            return rng.choice([None, True, False, 0, 5, 10, 1.5, "", "abc", "é", "fix", [], {}])
        return [some(depth + 1) for _ in range(rng.randrange(3))] if k < 11 else {c: likely[c]() if rng.random() < 0.5 and c in likely else some(depth + 1) for c in shape["properties"] if rng.random() < 0.7}

    values = [some() for _ in range(100)] + [{c: likely[c]() if rng.random() < 0.6 and c in likely else some(1) for c in shape["properties"] if rng.random() < 0.7} for _ in range(600)]
    values.append({"a": {"text": "ab", "ids": ["x"]}, "n": 2})
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, values))), "id int, t string")
    got = {r.id: r.p for r in rows.select("id", schema.problems(F.parse_json("t"), shape).alias("p")).collect()}
    for i, value in enumerate(values):
        assert sorted(got[i]) == sorted(replies.violations(value, shape, shape)), value
    assert got[len(values) - 1] == []
    loop = {"type": "object", "properties": {"child": {"$ref": "#"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/N"}}}, "$defs": {"N": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/N"}}}}}}
    with pytest.raises(schema.Recursive):
        schema.problems(F.lit(None), loop)
    said = spark.createDataFrame([('{"kids": [{"id": 1, "kids": [{"id": "x"}]}]}', "outline", json.dumps(loop), ["b"], "")], "reply string, template string, schema string, block_ids array<string>, case_name string")
    assert replies.checked(said, ["template"], [json.dumps(loop)]).first().problems == ["- kids/0/kids/0/id: not of type integer"]


# -- archives -------------------------------------------------------------------------------------------


def test_archives_are_whole_or_refused(spark, tmp_path):
    kinds = {
        "corpus": "id string, name string, budget decimal(12,3), made timestamp, raw binary", "book": "id string, corpus_id string", "page": "id string, book_id string", "block": "id string, book_id string, page_id string",
        "artifact": "id string, corpus_id string, parent_artifact_id string, content string, sources string", "cost_event": "id string, artifact_id string, ts timestamp_ntz, cost double",
    }
    at = datetime.datetime(2024, 2, 3, 4, 5, 6, 789012)
    rows = {
        "corpus": [("1", "One \n two", Decimal("1.230"), at, b"\x00\xff"), ("2", None, None, None, None)], "book": [("h1", "1"), ("h2", "2")], "page": [("p1", "h1")], "block": [("b1", "h1", "p1"), ("b2", "h1", None), ("b3", "h2", "p9")],
        "artifact": [
            ("a1", "1", None, '{"x": [{"source_block_ids": ["b1", "b3", 5, {"source_page_ids": ["p1", "p1"]}]}], "sources": ["b2", {"id": "p1", "kind": "page"}, {"id": "b1"}, {"kind": "block"}], "text": "b1 é"}', '[{"kind": "artifact", "id": "a2"}]'),
            ("a2", "1", "a1", "no json", "null"), ("a3", "2", None, None, None),
        ],
        "cost_event": [("c1", "a1", at, float("nan")), ("c2", "a3", at, 1.5), ("c3", None, at, 0.0)],
    }
    held = {n: spark.createDataFrame(rows[n], kinds[n]) for n in kinds}
    path = str(tmp_path / "one")
    archive.export(held, "1", path)
    got = archive.restore(spark, path, kinds, "s", name="Copy")
    new = lambda x: hashlib.sha256(f"s|{x}".encode()).hexdigest()
    corpus = got["corpus"].collect()
    assert [(r.id, r.name, r.budget, r.made, bytes(r.raw)) for r in corpus] == [(new("1"), "Copy", Decimal("1.230"), at, b"\x00\xff")]
    assert [tuple(r) for r in got["book"].collect()] == [("h1", new("1"))] and [tuple(r) for r in got["page"].collect()] == [(new("p1"), "h1")]
    assert {tuple(r) for r in got["block"].collect()} == {(new("b1"), "h1", new("p1")), (new("b2"), "h1", None)}
    found = {r.id: r for r in got["artifact"].collect()}
    assert set(found) == {new("a1"), new("a2")} and found[new("a2")].parent_artifact_id == new("a1") and found[new("a2")].content == "no json" and found[new("a2")].sources == "null"
    assert json.loads(found[new("a1")].content) == {"x": [{"source_block_ids": [new("b1"), "b3", 5, {"source_page_ids": [new("p1"), new("p1")]}]}], "sources": [new("b2"), {"id": new("p1"), "kind": "page"}, {"id": new("b1")}, {"kind": "block"}], "text": "b1 é"}
    assert json.loads(found[new("a1")].sources) == [{"kind": "artifact", "id": new("a2")}]
    event = got["cost_event"].collect()
    assert [(r.id, r.artifact_id, r.ts, r.cost != r.cost) for r in event] == [(new("c1"), new("a1"), at, True)]
    assert {r.id for r in archive.restore(spark, path, {"corpus": kinds["corpus"]}, "s", keep_corpus_id=True)["corpus"].collect()} == {"1"}
    with pytest.raises(Exception, match="exist"):
        archive.export(held, "1", path)
    archive.export(held, None, path, mode="overwrite")
    assert archive.restore(spark, path, kinds, "s")["artifact"].count() == 3
    line = next((tmp_path / "one" / "rows" / "table=artifact").glob("*.gz"))
    text = gzip.decompress(line.read_bytes()).decode().splitlines()[0]
    assert text.index('"content"') < text.index('"corpus_id"') < text.index('"id"') < text.index('"sources"')
    line.unlink()
    with pytest.raises(ValueError, match="not complete: artifact"):
        archive.restore(spark, path, kinds, "s")
    part = next((tmp_path / "one" / "manifest").glob("part-*"))
    spark.read.json(str(tmp_path / "one" / "manifest")).withColumn("version", F.lit(1)).write.json(str(tmp_path / "old" / "manifest"))
    with pytest.raises(ValueError, match="of version 1"):
        archive.restore(spark, str(tmp_path / "old"), kinds, "s")
    assert part.exists()
    with pytest.raises(ValueError, match="without a manifest"):
        archive.restore(spark, str(tmp_path / "none"), kinds, "s")


# -- conversions ----------------------------------------------------------------------------------------


def test_conversions_are_cached_by_content_and_broken_entries_redone(spark, tmp_path):
    up, cache = tmp_path / "up", tmp_path / "cache"
    (up / "deep").mkdir(parents=True)
    for name, content in (("a.pdf", b"one"), ("deep/b.pdf", b"two"), ("c.pdf", b"one"), ("bad.pdf", b"?")):
        (up / name).write_bytes(content)
    asked = []

    def convert(missing):
        rows = missing.withColumn("pages", F.when(F.col("content").cast("string") != "?", F.array(F.concat(F.lit("page "), F.col("content").cast("string")))))
        asked.append(rows)
        return rows

    found = conversions.files(spark, str(up))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    run = lambda: {r.path.rsplit("/", 1)[-1]: (r.sha256, r.pages, r.hit) for r in conversions.converted(conversions.files(spark, str(up)), str(cache), convert).collect()}
    first = run()
    assert first == {"a.pdf": (sha(b"one"), ["page one"], False), "b.pdf": (sha(b"two"), ["page two"], False), "c.pdf": (sha(b"one"), ["page one"], False), "bad.pdf": (sha(b"?"), None, False)}
    assert asked[0].count() == 3  # a content is converted once
    assert {k: v[2] for k, v in run().items()} == {"a.pdf": True, "b.pdf": True, "c.pdf": True, "bad.pdf": False}
    whole = "".join(p.read_text() for p in cache.glob("*.json"))
    for p in [*cache.glob("*.json"), *cache.glob(".*.crc")]:
        p.unlink()
    lines = [x for x in whole.splitlines() if sha(b"one") in x]
    torn = lines[0][: len(lines[0]) // 2]
    spoiled = next(x for x in whole.splitlines() if sha(b"two") in x).replace("page two", "page 2")
    (cache / "part-x.json").write_text("\n".join([torn, spoiled, "no json", '{"sha256": "x"}', ""]))
    again = run()
    assert {k: v[2] for k, v in again.items()} == dict.fromkeys(again, False) and {k: v[1] for k, v in again.items()} == {k: v[1] for k, v in first.items()}
    assert conversions.cached(spark, str(cache)).count() == 2
    (up / f"{sha(b'one')}.pdf").write_bytes(b"one")
    (up / f"{sha(b'one')}.pdf.part").write_bytes(b"12345")
    live = spark.createDataFrame([(sha(b"one"),)], "hash string")
    found = conversions.files(spark, str(up))
    names = {r["name"] for r in conversions.unneeded(found, live).collect()}
    assert names == {"a.pdf", "b.pdf", "c.pdf", "bad.pdf", f"{sha(b'one')}.pdf.part"}
    assert conversions.removed(found, live) == (5, 15) and (up / "a.pdf").exists()
    assert conversions.removed(found, live, dry_run=False) == (5, 15) and sorted(p.name for p in up.rglob("*.*")) == [f"{sha(b'one')}.pdf"]


# -- cells ----------------------------------------------------------------------------------------------


def test_cells_cover_every_row_and_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS", 50)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 64)], "vec_id long, embedding array<float>")
    vectors = vectors.unionByName(odd)
    c = cells.centres(vectors, sample=1000)
    held = cells.index(vectors, c).cache()
    assert held.count() == vectors.count() - 1 and held.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 150
    query = vectors.where("vec_id % 50 = 0 AND vec_id >= 0")
    probes = cells.probes_for(held, c, vectors)
    assert 1 <= probes < len(c)
    found = cells.near(held, c, query, probes=probes).cache()
    assert cells.recall(found, vectors, query) >= 0.9
    exact = {(r.qid, r.id): r.cosine for r in retrieve.nearest(vectors, query, 2000).collect()}
    assert all(exact[r.qid, r.id] == r.cosine for r in found.collect())
    every = cells.near(held, c, query, probes=len(c))
    assert cells.recall(every, vectors, query) == 1.0
    none = vectors.limit(0)
    c = cells.centres(none)
    assert cells.near(cells.index(none, c), c, query.limit(0)).count() == 0


# -- the stored table -----------------------------------------------------------------------------------


def scanned(df) -> tuple[int, int]:
    """(files, rows) that the plan of ``df`` reads, by the scan's own metrics."""
    df._jdf.queryExecution().executedPlan().executeCollectPublic()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_stored_blocks_are_read_by_folder_and_statistics(spark, tmp_path):
    one = F.col("id")
    rows = spark.range(200_000).select("id", (one % 97).alias("book_id"), (one / 97 % 1000).cast("int").alias("source_page"), (one % 3).cast("int").alias("order_index"), F.lit("case_opinion").alias("type"), F.repeat(F.lit("text "), 20).alias("markdown"))
    rows = rows.unionByName(rows.limit(5).withColumn("book_id", F.lit(None).cast("long")))
    path = str(tmp_path / "blocks")
    store.write(rows, path, buckets=8)
    held = store.read(spark, path)
    assert store.buckets(held) == 8 and store.buckets(rows) is None and held.count() == rows.count()
    found = retrieve.page_range(held, retrieve.PageRange(7, 20, 30))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in retrieve.page_range(rows, retrieve.PageRange(7, 20, 30)).collect())
    files, read = scanned(retrieve.page_range(held, retrieve.PageRange(7, 20, 30)))
    assert files <= 2 and read <= 3 * store.PAGE_ROWS
    assert scanned(rows_of_all := held.where("markdown <> ''"))[0] >= 8 and rows_of_all.count() == rows.count()
    asked = spark.createDataFrame([(1, 7, 20, 30), (2, 9, 0, 2), (3, 500, 0, 9), (4, 7, 5, 1), (5, None, 0, 9)], "request int, book_id long, start int, end int")
    got = store.spans(asked, held).groupBy("request").count().collect()
    want = {1: rows.where("book_id = 7 AND source_page BETWEEN 20 AND 30").count(), 2: rows.where("book_id = 9 AND source_page BETWEEN 0 AND 2").count()}
    assert {r["request"]: r["count"] for r in got} == want
    assert store.spans(asked, rows).count() == sum(want.values())
    store.write(rows.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="exist"):
        store.write(rows, path)


# -- books ----------------------------------------------------------------------------------------------


def test_longest_chain_is_brute_force():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(300):
        rows = [(i, rng.randint(1, 7)) for i in range(rng.randint(0, 9))]
        best = 0
        for n in range(len(rows), 0, -1):
            fits = [c for c in itertools.combinations(rows, n) if 1 <= c[0][1] <= 3 and all(1 <= b[1] - a[1] <= 2 for a, b in zip(c, c[1:]))]
            if fits:
                best = n
                break
        got = segment.longest_chain(rows)
        assert len(got) == best
        assert not got or (1 <= got[0][1] <= 3 and all(1 <= b[1] - a[1] <= 2 and b[0] > a[0] for a, b in zip(got, got[1:])))


def test_books_without_text_or_marks(spark):
    books = spark.createDataFrame([(1, None), (2, ""), (3, "no number\r\nat all"), (4, "1\r\na b\r\n2\r\n")], "book_id int, markdown string")
    marked = segment.page_markers(books)
    assert {r.book_id: len(r.markers) for r in marked.collect()} == {1: 0, 2: 0, 3: 0, 4: 2}
    pages = {(r.book_id, r.source_page): r.markdown for r in segment.page_slices(marked).collect()}
    assert pages == {(4, 1): "a b\r", (4, 2): ""}
    assert segment.toc(marked).count() == 0


def test_footnotes_and_problems_by_themselves():
    kinds = lambda page: [b[0] for b in segment.segment(page)]
    assert kinds("words\n\n*\n\n1 Foot\n\n2 Foot") == ["narrative_text", "footnote", "footnote"]
    assert kinds("Problem 2.\n\nwords") == ["problem", "narrative_text"]
    assert kinds("Ab v. Bc\n\n1. note") == ["case_header", "numbered_note"]


def test_page_offsets_and_spans(spark):
    assert one(spark, ingest.page_offsets(F.lit("<!-- page 1 -->\nab<!-- PAGE 12 -->c"))) == [0, 18]
    assert one(spark, ingest.page_offsets(F.lit("nothing"))) == [0]
    batches = F.array(F.struct(F.lit(5).alias("start"), F.lit("a").alias("path"), F.array(F.lit(0), F.lit(10)).alias("offsets")), F.struct(F.lit(50).alias("start"), F.lit("b").alias("path"), F.array(F.lit(0)).alias("offsets")))
    span = lambda a, b: tuple(one(spark, ingest.page_span(batches, F.lit(a), F.lit(b))))
    assert [span(0, 3), span(6, 30), span(20, 60), span(50, 51)] == [("a", 1, 1), ("a", 1, 2), ("a", 2, 2), ("b", 1, 1)]


# -- retrieval ------------------------------------------------------------------------------------------


def test_typed_queries(spark):
    blocks = spark.createDataFrame([(1, 7, 1, 0, "case_opinion", "A v. B", None), (2, 7, 1, 1, "numbered_note", "", None), (3, 7, 2, 0, "header", "", None)], "id int, book_id int, source_page int, order_index int, type string, case_name string, markdown string")
    assert [r.id for r in retrieve.retrieved(retrieve.PageRange(7, 1, 1), blocks).collect()] == [1, 2]
    assert [r.id for r in retrieve.retrieved(retrieve.CaseReference(7, "a VS b"), blocks).collect()] == [1, 2, 3]
    with pytest.raises(TypeError):
        retrieve.retrieved("page 3", blocks)
    with pytest.raises(ValueError):
        retrieve.PageRange(7, 3, 2)


def test_random_case_and_long_excerpt(spark):
    rows = [(i, 7, 1, i, "case_opinion", " ", "x" * 300) for i in range(20)]
    blocks = spark.createDataFrame(rows, "id int, book_id int, source_page int, order_index int, type string, case_name string, markdown string")
    picked = retrieve.case_rows(blocks, seed=5).collect()
    assert len(picked) == 1 and picked[0].case_name == "Untitled case" and picked[0].excerpt == "x" * 220 + "…" and picked[0].year is None
    assert retrieve.case_rows(blocks, seed=5).first().id == picked[0].id


def test_nearest_in_many_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8)).round(3)
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None)], "vec_id long, embedding array<double>")
    got = {(r.qid, r["rank"]): (r.id, r.cosine) for r in retrieve.nearest(df, df.where("vec_id % 5 = 0"), 3, rows=7).collect()}
    for q in range(0, 60, 5):
        score = [(-round(float(v[q] @ x / np.linalg.norm(v[q]) / np.linalg.norm(x)), 6), i) for i, x in enumerate(v) if i not in (q, 7)]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in sorted(score)[:3]]


# -- study ----------------------------------------------------------------------------------------------


def test_lineage_of_cycles_roots_and_long_chains(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (303, 300), (400, 400), (500, 999)]
    artifacts = spark.createDataFrame(rows, "id int, parent_id int")
    events = spark.createDataFrame([(i, "1.5") for i, _ in rows], "artifact_id int, c string").select("artifact_id", F.col("c").cast("decimal(20,10)").alias("total_cost_usd"))
    parent = dict(rows)

    def walk(i):
        seen = []
        while i is not None and i in parent and i not in seen and len(seen) < 64:
            seen.append(i)
            i = parent[i]
        return len(seen)

    got = {r.id: (r.length, float(r.total)) for r in study.lineage_cost(artifacts, events).collect()}
    assert got == {i: (walk(i), 1.5 * walk(i)) for i, _ in rows}
    assert {r.id: r.n for r in study.chains(artifacts).groupBy("id").agg(F.count("*").alias("n")).collect()} == {i: walk(i) for i, _ in rows}


def test_subjects_without_a_label_don_t_count(spark):
    rows = [(1, 0, ["", None, "A", "A"], None, ["r"], None, 0, 750, "text")]
    segments = spark.createDataFrame(rows, "transcript_id int, order_index int, mentioned_cases array<string>, mentioned_rules array<string>, mentioned_concepts array<string>, sentiment_flags array<string>, start_char int, end_char int, content string")
    assert {(r.kind, r.label, r.return_count, r.minutes_on) for r in study.subject_features(segments).collect()} == {("case", "A", 1, 1.0), ("concept", "r", 1, 1.0)}


def test_weights_and_rates_from_files(tmp_path):
    good = tmp_path / "w.toml"
    good.write_text("[weights]\nminutes_on = 1\nreturn_count = 2\nhypotheticals_run = 3\nengaged_questions = 4\nnot_disclaimed = 5\n[penalties]\ndisclaimed = -1\n[normalization]\nminutes_on_cap = 1\nreturn_count_cap = 2\nhypotheticals_run_cap = 3\nengaged_questions_cap = 4\n")
    assert study.weights(str(good)) == ({"minutes_on": 1, "return_count": 2, "hypotheticals_run": 3, "engaged_questions": 4, "not_disclaimed": 5}, {"minutes_on": 1, "return_count": 2, "hypotheticals_run": 3, "engaged_questions": 4}, -1)
    fixed = (study.WEIGHTS, study.CAPS, study.PENALTY)
    for bad in (good.read_text().replace("= 5", "= true"), "[weights]\n", "weights = 3", "not toml ["):
        good.write_text(bad)
        assert study.weights(str(good)) == fixed
    assert study.weights(str(tmp_path / "none.toml")) == fixed
    rates = tmp_path / "r.toml"
    rates.write_text('title = "x"\n[Anthropic.Model-A]\ninput_per_mtok = 1.5\noutput_per_mtok = 2\n[conservative_default]\ninput_per_mtok = 9\noutput_per_mtok = 10\n')
    assert ledger.rates(str(rates)) == ([("anthropic", "model-a", "1.5", "2")], ("9", "10"))
    rates.write_text("[a.b]\ninput_per_mtok = true\noutput_per_mtok = 2\n")
    assert ledger.rates(str(rates)) == (ledger.RATES, ledger.UNKNOWN) == ledger.rates(None)


# -- replies --------------------------------------------------------------------------------------------


def test_schemas_as_types_and_files(tmp_path):
    schema = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": ["integer", "null"]}, "c": {"type": "array", "items": {"$ref": "#/$defs/D"}}, "e": {"type": ["string", "object"]}, "f": {"type": "object"}, "g": {"type": "boolean"}}, "$defs": {"D": {"type": "object", "properties": {"x": {"type": "number"}}}}}
    want = T.StructType().add("a", "string").add("b", "long").add("c", T.ArrayType(T.StructType().add("x", "double"))).add("e", "string").add("f", "string").add("g", "boolean")
    assert replies.struct_type(schema) == want
    (tmp_path / "brief.json").write_text(json.dumps(schema))
    assert replies.load_schema(str(tmp_path), "brief") == schema
    (tmp_path / "brief.json").write_text("[]")
    with pytest.raises(ValueError):
        replies.load_schema(str(tmp_path), "brief")


def test_violations_name_what_is_wrong():
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 2, "maximum": 3}, "b": {"type": "string", "pattern": "^x", "minLength": 2, "maxLength": 3}, "c": {"enum": [1, 2]}, "d": {"type": "array", "maxItems": 1, "items": {"type": "string"}}, "e": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "f": {"const": 5}},
    }
    bad = {"a": 1, "b": "y", "c": 3, "d": ["s", 4], "e": 1, "f": 6, "g": 0}
    lines = replies.violations(bad, schema, schema)
    assert {x.split(":")[0][2:] for x in lines} == {"a", "b", "c", "d", "d/1", "e", "f", "(root)"} and len(lines) == 9
    assert replies.violations({"a": 2, "b": "xy", "c": 1, "d": ["s"], "e": None, "f": 5}, schema, schema) == []
    assert replies.violations({"a": True}, schema, schema) == ["- a: not of type integer"] and replies.violations([], schema, schema) == ["- (root): not of type object"]


def test_dangling_references_and_unions_are_left_alone():
    root = {"type": "object", "required": ["a", "b", "c"], "properties": {"a": {"$ref": "#/none"}, "b": {"type": ["string", "integer"]}, "c": {"type": ["integer", "null"]}, "d": {"$ref": "other.json"}}}
    assert replies.filled({"d": ["x"]}, root, root) == {"a": None, "b": "", "c": None, "d": ["x"]}
    assert replies.filled({"a": 1, "b": ["x"], "c": 2}, root, root) == {"a": 1, "b": ["x"], "c": 2}
    assert replies.filled("text", root, root) == "text" and replies.repaired([1], "case_brief", [], "") == [1]


def test_context_and_model_precedence(spark):
    ctx = one(spark, replies.context({"a": F.lit(1), "b": F.lit(2)}, {"b": F.lit(3)}, F.lit("p"), F.lit("t")))
    assert ctx.asDict() == {"a": 1, "b": 3, "professor_profile": "p", "book_toc_context": "t"}
    model = lambda *m: one(spark, replies.resolved_model(*[F.lit(x).cast("string") for x in m]))
    assert [model("x", "y", "z"), model("", "y", "z"), model(None, "", "z"), model(None, None, "")] == ["x", "y", "z", replies.DEFAULT_MODEL]


def test_ids_are_harvested_at_any_depth(spark):
    texts = ['{"sources":[{"kind":"block","id":"q"},{"kind":"x","id":"n"},"s"],"source_block_ids":["a]b","c",4]}', '[{"d":{"source_block_ids":["e"]}},{"source_block_ids":"f"}]', "no json", None, '{"source_block_ids":["a","a"]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", verify.cited_ids(F.col("t")).alias("ids"))
    assert [r.ids for r in df.orderBy("i").collect()] == [["a]b", "c", "q"], ["e"], [], [], ["a"]]


# -- texts ----------------------------------------------------------------------------------------------


def test_paragraphs_and_switched_off_scanners(spark):
    text = F.lit("a\nb\r\n\r\n  \nc\n\n\nd")
    assert [tuple(p) for p in one(spark, patterns.paragraphs(text))] == [("a\nb", 0), ("c", 4), ("d", 7)]
    rows = spark.createDataFrame([(1, "It is clearly so. My client wins."), (2, ""), (3, None)], "id int, text string")
    assert [r.name for r in patterns.scan(rows).collect()] == ["clearly_as_argument_substitution", "read_the_prompt"]
    assert [r.name for r in patterns.scan(rows, {"read_the_prompt"}).collect()] == ["clearly_as_argument_substitution"]
    profile = F.parse_json(F.lit('{"pet_peeves": [{"name": "x", "disabled": true}, {"name": "y", "disabled": false}]}'))
    assert one(spark, patterns.disabled(profile)) == ["x"]


def test_speakers_titles_and_times(spark):
    assert one(spark, F.transform(F.array(*[F.lit(x) for x in (" Professor", "STUDENT", "clerk")]), ingest.speaker)) == ["professor", "student", "unknown"]
    title = lambda t: one(spark, desk.title(F.parse_json(F.lit(t)), F.lit("hypo"), F.lit("123456789")))
    assert [title('{"topic":" T ","case_name":7}'), title('{"rubric":{"case_name":"R"},"synthesis":{"topic":""}}'), title("{}")] == ["T", "R", "hypo · 12345678"]
    assert one(spark, desk.moment(F.lit("2024-01-05T00:00:00-01:00"))).isoformat() == "2024-01-05T01:00:00"
    assert one(spark, desk.moment(F.lit("soon"))) is None


# -- compositions ---------------------------------------------------------------------------------------


def test_typed_queries_one_at_a_time(spark):
    blocks = spark.createDataFrame([(1, 7, 1, 0, "case_opinion", "A v. B"), (2, 7, 2, 0, "numbered_note", None), (3, 8, 1, 0, "case_opinion", "A v. B"), (4, 8, 9, 0, "header", None)], "id long, book_id long, source_page int, order_index int, type string, case_name string")
    books = spark.createDataFrame([(7, 1, datetime.datetime(2024, 1, 2)), (8, 1, datetime.datetime(2024, 1, 1))], "id long, corpus_id long, ingested_at timestamp")
    entries = spark.createDataFrame([(1, "X-1", [(9, 9), (None, 3)])], "corpus_id long, code string, ranges array<struct<start:int,end:int>>")
    ids = lambda q, **more: [r.id for r in retrieve.retrieved(q, blocks, **more).collect()]
    assert ids(retrieve.CaseReference(None, "a VS b")) == [1, 2] and ids(retrieve.CaseReference(8, "A v. B")) == [3, 4] and ids(retrieve.CaseReference(None, "none")) == []
    assert ids(retrieve.AssignmentCode(1, "X-1"), books=books, entries=entries) == [4] and ids(retrieve.AssignmentCode(1, "X-2"), books=books, entries=entries) == []
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert ids(retrieve.Semantic((1.0, 0.0), 2), vectors=vectors) == [1, 2] and ids(retrieve.Semantic((1.0, 0.0))) == []
    with pytest.raises(ValueError):
        retrieve.retrieved(retrieve.AssignmentCode(1, "X-1"), blocks)
    with pytest.raises(TypeError):
        retrieve.retrieved("X-1", blocks)


def test_profiles_of_odd_payloads(spark):
    rows = [
        ("n", "case_brief", None), ("j", "case_brief", "no json"), ("l", "case_brief", "[1]"), ("r", "case_brief", '{"rule": {"text": "  ", "source_block_ids": ["b"]}}'), ("e", "case_brief", '{"rule": {"text": "x", "source_block_ids": []}}'),
        ("p", "case_brief", '{"rule": {"text": "anything else (PARAPHRASE)", "source_block_ids": ["gone"]}}'), ("g", "case_brief", '{"rule": {"text": "Gold bars", "source_block_ids": ["gone", null]}}'),
        ("u", "grade", "{}"), ("v", "grade", '{"rubric_id": "n"}'), ("w", "outline", "{}"), ("z", "grade", '{"rubric_id": "q", "per_rubric_scores": "none"}'), ("q", "rubric", '{"required_issues": "none", "required_rules": [{"id": "a"}, {"id": "a"}, 3, {"id": ""}]}'),
    ]
    artifacts = spark.createDataFrame(rows, "id string, type string, content string")
    blocks = spark.createDataFrame([("b", "some words"), ("c", None)], "id string, markdown string")
    ask = lambda profile, *ids: spark.createDataFrame([(i, profile) for i in ids], "artifact_id string, profile string")
    got = lambda profile, *ids: {(r.artifact_id, r.severity, r.message) for r in profiles.issues(ask(profile, *ids), artifacts, blocks).collect()}
    assert got("rule_fidelity", "n", "j", "l", "r", "e", "p", "g") == {("n", "error", "no rule"), ("j", "error", "no rule"), ("l", "error", "no rule"), ("r", "warning", "no words"), ("e", "error", "no source"), ("g", "warning", "diverges")}
    assert got("rubric_coverage", "u", "v", "w", "z") == {("u", "error", "no rubric_id"), ("v", "error", "not a rubric: case_brief"), ("w", "error", "not a grade: outline"), ("z", "error", "not scored")}
    assert got("issue_spotting_completeness", "q", "w") == {("q", "warning", "few issues"), ("q", "warning", "no role"), ("q", "warning", "no anti-patterns"), ("w", "error", "neither hypo nor rubric: outline")}
    assert got("citation_grounding", "n", "j", "l") == set() and got("other", "n") == {("n", "error", "unknown profile")} and got("rule_fidelity", "absent") == {("absent", "error", "artifact not found")}
