"""Corpus export and restore, content hashes, and the conversion cache."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.session import ship

VERSION = 2
#: Each table's column by which its rows belong to a parent's.
BELONGS = {
    "book": ("corpus_id", "corpus"), "page": ("book_id", "book"), "block": ("book_id", "book"), "toc_entry": ("book_id", "book"), "transcript": ("corpus_id", "corpus"), "transcript_segment": ("transcript_id", "transcript"),
    "emphasis_item": ("transcript_id", "transcript"), "artifact": ("corpus_id", "corpus"), "syllabus": ("corpus_id", "corpus"), "syllabus_entry": ("syllabus_id", "syllabus"), "professor_profile": ("corpus_id", "corpus"),
    "flashcard_review": ("corpus_id", "corpus"), "cost_event": ("artifact_id", "artifact"),
}
#: Further columns that point to rows of a table.
POINTS = {"block": {"page_id": "page"}, "toc_entry": {"parent_id": "toc_entry"}, "artifact": {"parent_artifact_id": "artifact"}, "flashcard_review": {"flashcard_set_id": "artifact"}}
#: Tables whose ids are hashes of their content and stay as they are.
CONTENT_KEYED = {"book", "transcript"}
#: Columns of JSON text that cite rows at any depth; lists of ids by their key, and sources of a kind with an id.
CITING = {"artifact": ("content", "sources")}
CITED = {"source_block_ids": "block", "source_page_ids": "page", "source_segment_ids": "transcript_segment"}
#: How times are written: ISO, to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def content_hash(files: DataFrame) -> DataFrame:
    """(path, sha256) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def book_id(hashes: Column) -> Column:
    """The hash of a book's file hashes, one a line, in order."""
    return F.sha2(F.array_join(hashes, "\n"), 256)


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash has no conversion yet."""
    return files.join(cache.select("sha256"), "sha256", "left_anti")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def belonging(tables: dict[str, DataFrame], corpus=None) -> dict[str, DataFrame]:
    """The rows of each table that belong to a corpus, parent by parent, by semi joins; to any corpus there is if none is named."""
    out = {"corpus": tables["corpus"] if corpus is None else tables["corpus"].where(F.col("id") == corpus)}
    for name, (col, parent) in BELONGS.items():
        if name in tables:
            out[name] = tables[name].join(out[parent].select(F.col("id").alias(col)), col, "left_semi").select(*tables[name].columns)
    return out


def written(rows: DataFrame) -> Column:
    """A row as JSON: keys sorted, decimals as text, times in ISO, nulls kept."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[(F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`")).alias(f.name) for f in fields]), TIMES)


def export(tables: dict[str, DataFrame], corpus, path: str, mode: str = "errorifexists") -> None:
    """One archive of all tables: a line of compressed JSON a row, in one write whose tasks commit together, then the manifest.

    The manifest has the version and each table's count of the lines that are there; an archive without one is not
    complete. A failed export is repeated with mode overwrite.
    """
    mine = belonging(tables, corpus)
    lines = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("table"), written(t).alias("value")) for n, t in mine.items()])
    conf, one = lines.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(one, None)
    conf.set(one, len(mine))  # a task has rows of few tables, so they need no sort by table
    try:
        lines.write.mode(mode).partitionBy("table").option("compression", "gzip").text(f"{path}/rows")
    finally:
        conf.unset(one) if before is None else conf.set(one, before)
    there = lines.sparkSession.read.schema("value string, table string").text(f"{path}/rows").groupBy(F.col("table").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    names = lines.sparkSession.createDataFrame([(n,) for n in mine], "name string")
    counts = names.join(there, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.lit(VERSION).alias("version"))
    counts.coalesce(1).write.mode(mode).json(f"{path}/manifest")


def _cites(value: object, change) -> object:
    """A JSON value in which each cited (kind, id) is replaced, in place, by what ``change`` gives."""
    nodes = [value]
    while nodes:
        node = nodes.pop()
        if isinstance(node, list):
            nodes.extend(x for x in node if isinstance(x, (dict, list)))
            continue
        for key, held in node.items() if isinstance(node, dict) else ():
            if isinstance(held, list) and key in CITED:
                for i, x in enumerate(held):
                    if isinstance(x, str):
                        held[i] = change(CITED[key], x)
            elif isinstance(held, list) and key == "sources":
                for i, x in enumerate(held):
                    if isinstance(x, str):
                        held[i] = change("block", x)
                    elif isinstance(x, dict) and isinstance(x.get("id"), str):
                        x["id"] = change(str(x.get("kind") or "block"), x["id"])
            if isinstance(held, (dict, list)):
                nodes.append(held)
    return value


def _read_json(text: str | None, column: str) -> object:
    """A citing column's value; the column ``sources`` is a list of sources itself."""
    value = json.loads(text)
    return {"sources": value} if column == "sources" else value


def _harvester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, kind, ref) of all citing columns after the first, once a row."""
    for batch in batches:
        out: list[list] = [[], [], []]
        found: dict[tuple[str, str], None] = {}
        change = lambda kind, x: found.setdefault((kind, x)) or x  # noqa: B023, E731
        for row, *texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found.clear()
            for column, text in zip(batch.schema.names[1:], texts, strict=True):
                if text is None:
                    continue
                # a text that turns out to be no JSON cites nothing
                before = dict(found)
                try:
                    _cites(_read_json(text, column), change)
                except (TypeError, ValueError):
                    found.clear()
                    found.update(before)
            for kind, ref in found:
                for c, v in zip(out, (row, kind, ref), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["_row", "kind", "ref"])


def _replacer(columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            out = [batch.column(names.index(c)).to_pylist() for c in columns]
            known = batch.column(batch.num_columns - 1)
            at, each = known.offsets.to_pylist(), [known.values.field(n).to_pylist() for n in ("kind", "ref", "new")]
            pairs = list(zip(zip(each[0], each[1], strict=True), each[2], strict=True))
            for i in range(batch.num_rows):
                new = dict(pairs[at[i] : at[i + 1]])
                if not new:
                    continue
                change = lambda kind, x: new.get((kind, x), x)  # noqa: B023, E731
                for column, texts in zip(columns, out, strict=True):
                    texts[i] = _changed(texts[i], column, new, change)
            mine = dict(zip(columns, (pa.array(texts, pa.string()) for texts in out), strict=True))
            yield pa.RecordBatch.from_arrays([mine.get(n, c) for n, c in zip(names, batch.columns, strict=False)], names)

    return run


def _changed(text: str | None, column: str, new: dict, change) -> str | None:
    """The text with what it cites changed; as it is, to the blank, where it is no JSON or cites nothing of ``new``."""
    if text is None:
        return None
    hit = False

    def one(kind: str, x: str) -> str:
        nonlocal hit
        hit = hit or (kind, x) in new
        return change(kind, x)

    try:
        value = _cites(_read_json(text, column), one)
    except (TypeError, ValueError):
        return text
    if not hit:
        return text
    return json.dumps(value["sources"] if column == "sources" else value, ensure_ascii=False, separators=(",", ":"))


def rekeyed(rows: DataFrame, columns: tuple[str, ...], known: DataFrame, renew) -> DataFrame:
    """``rows`` (id, ...) with what JSON text columns cite at any depth replaced: an id in ``known`` (kind, ref) by ``renew`` of it.

    What ``known`` lacks stays. Citations of all columns are harvested in one pass and joined with the ids that there are, of which
    only the cited ones are renewed; they are put back a row at a time, and a row gathers its own citations only.
    """
    ship(rows.sparkSession)
    refs = rows.select(F.col("id").cast("string").alias("_row"), *columns).mapInArrow(_harvester, "_row string, kind string, ref string")
    held = refs.join(known, ["kind", "ref"], "left_semi").select("_row", "kind", "ref", renew(F.col("ref")).alias("new"))
    mine = held.groupBy("_row").agg(F.collect_list(F.struct("kind", "ref", "new")).alias("_new"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    joined = rows.join(mine, F.col("id").cast("string") == F.col("_row"), "left").select(*rows.columns, "_new")
    return joined.mapInArrow(_replacer(columns), kinds)


def _only_id(schema: str) -> T.StructType:
    """Of a table's schema the id, which is what is read of rows that are only cited."""
    return T.StructType([f for f in T.StructType.fromDDL(schema).fields if f.name == "id"])


def restore(spark: SparkSession, path: str, schemas: dict[str, str], salt: str, keep_corpus_id: bool = False, name: str | None = None) -> dict[str, DataFrame]:
    """The tables of an archive under new ids, which derive from the old ones and ``salt``.

    Every key that points to a renewed id is rewritten, in columns and inside JSON texts at any depth; ids that no table
    of the archive has stay. An archive of another version, without a manifest or with other counts than its manifest's
    is refused. ``name`` renames the corpus.
    """
    try:
        head = {r["name"]: (r["n"], r["version"]) for r in spark.read.schema("name string, n long, version int").json(f"{path}/manifest").collect()}  # a row a table
    except AnalysisException:
        head = {}
    if not head:
        raise ValueError("archive without a manifest")
    if versions := {v for _, v in head.values()} - {VERSION}:
        raise ValueError(f"archive of version {versions.pop()}")
    lines = spark.read.schema("value string, table string").text(f"{path}/rows")
    there = {r["table"]: r["n"] for r in lines.groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()}
    if short := [n for n, (count, _) in head.items() if there.get(n, 0) != count]:
        raise ValueError(f"archive is not complete: {', '.join(sorted(short))}")
    renew = lambda c: F.when(c.isNotNull(), F.sha2(F.concat_ws("|", F.lit(salt), c.cast("string")), 256))
    kept = CONTENT_KEYED | ({"corpus"} if keep_corpus_id else set())
    old = {n: lines.where(F.col("table") == n).select(F.from_json("value", schema, {**TIMES, "mode": "FAILFAST"}).alias("r")).select("r.*") for n, schema in schemas.items()}
    # of what is cited the ids alone are read
    ids = {n: lines.where(F.col("table") == n).select(F.from_json("value", _only_id(schema), {**TIMES, "mode": "FAILFAST"}).alias("r")).select(F.col("r.id").cast("string").alias("ref")) for n, schema in schemas.items() if n in ("block", "page", "transcript_segment", "artifact")}
    cited = [rows.select(F.lit(n).alias("kind"), "ref") for n, rows in ids.items()]
    out = {}
    for n, rows in old.items():
        points = {**({BELONGS[n][0]: BELONGS[n][1]} if n in BELONGS else {}), **POINTS.get(n, {})}
        if cited and (columns := tuple(c for c in CITING.get(n, ()) if c in rows.columns)):
            rows = rekeyed(rows, columns, reduce(DataFrame.unionByName, cited), renew)
        new = {} if n in kept else {"id": renew(F.col("id"))}
        new |= {c: renew(F.col(c)) for c, parent in points.items() if c in rows.columns and parent in schemas and parent not in kept}
        if n == "corpus" and name is not None:
            new["name"] = F.lit(name)
        out[n] = rows.withColumns(new)
    return out


def export_name(corpus: Column, at: Column) -> Column:
    """A file name of letters, digits and dashes, 40 characters at most, with the time."""
    slug = F.left(F.regexp_replace(F.regexp_replace(corpus, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), F.lit(40))
    return F.concat(slug, F.lit("-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def cache_key(template: Column, model: Column, messages: Column, temperature: Column) -> Column:
    """The key of a call: the hash of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), model.alias("model"), template.alias("template"), F.round(temperature, 4).alias("temperature"))), 256)


def replayed(calls: DataFrame, replay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with their recorded reply, and calls that have none. Nothing is ever requested."""
    return calls.join(replay, "cache_key"), calls.join(replay.select("cache_key"), "cache_key", "left_anti")

