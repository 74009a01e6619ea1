"""Queries of the training-data operators over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

import math

import public_tokenizers

from casewright.llm import fingerprints, html_extract, language_id, manifest, minhash, ngram_join, packing, pieces, pii, quality, search, sharding, url_filter
from casewright.llm.common import documents, pages

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    return str(public_tokenizers.path(name))


QUERIES = {
    "op1_language_id": lambda spark, d: language_id.identify(documents(spark, d)),
    "op2_pii": lambda spark, d: pii.find_pii(documents(spark, d)),
    "op3_fingerprints": lambda spark, d: fingerprints.fingerprint_documents(documents(spark, d)),
    "op4_quality": lambda spark, d: quality.quality_report(documents(spark, d)),
    "op5_sharding": lambda spark, d: sharding.shard_documents(documents(spark, d)),
    "op6_pieces": lambda spark, d: pieces.round_trip(documents(spark, d), tokenizer_path(PIECE_BPE)),
    "op7_html": lambda spark, d: html_extract.extract_pages(pages(spark, d)),
    "op8_packing": lambda spark, d: packing.digest(documents(spark, d), tokenizer_path(WORD_BPE)),
    "op9_ngram_join": lambda spark, d: ngram_join.classes(documents(spark, d)),
    "op10_url_filter": lambda spark, d: url_filter.judge_urls(pages(spark, d)),
    "op11_search": lambda spark, d: search.search(search.build_index(documents(spark, d)), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op12_manifest": lambda spark, d: manifest.build(documents(spark, d)),
    "op13_minhash": lambda spark, d: minhash.near_duplicates(documents(spark, d)),
}


def _sharding_sql(shards: int = 40) -> str:
    """The tree in SQL: at each level the child with the greatest ln(u) / weight, the least index among equals."""

    def draw(node: str, weight: str) -> str:
        return f"(ln((('0x' || substr(md5(k || '/' || {node}), 1, 13))::bigint + 1) / {float(1 << 52)}::double) / {weight})"

    def pick(name: str, nodes: list[tuple[str, str]]) -> str:
        values = ", ".join(f"{{'d': {draw(n, w)}, 'i': {-i}}}" for i, (n, w) in enumerate(nodes))
        return f"-(list_max([{values}])).i AS {name}"

    def placed(t, name: str, source: str) -> str:
        regions = pick("g", [(f"'{i}'", str(float(sum(w for r in g for _, w in r)))) for i, g in enumerate(t)])
        size = max(len(g) for g in t), max(len(r) for g in t for r in g)
        # regions of another form (an added shard) have one rack and one shard
        alone = [i for i, g in enumerate(t) if len(g) == 1 and len(g[0]) == 1]
        none = f"g IN ({', '.join(map(str, alone)) or 'NULL'})"
        racks = pick("r0", [(f"g || '/{i}'", str(float(size[1]))) for i in range(size[0])])
        leaves = pick("l0", [(f"g || '/' || r || '/{i}'", "1.0") for i in range(size[1])])
        shard = f"coalesce(CASE WHEN {none} THEN g * {size[0] * size[1]} END, g * {size[0] * size[1]} + r * {size[1]} + l0)::integer AS {name}"
        return (
            f"SELECT * EXCLUDE (g, r, r0, l0), {shard} FROM (SELECT *, {leaves} FROM (SELECT *, CASE WHEN {none} THEN 0 ELSE r0 END AS r FROM "
            f"(SELECT *, {racks} FROM (SELECT *, {regions} FROM {source}))))"
        )

    base = sharding.tree(shards)
    rows = "(SELECT doc_id, coalesce(doc_id::varchar, '') AS k, strlen(coalesce(text, '')) + 16 AS size, text FROM documents)"
    both = placed(sharding.grown(base), "grown_shard", f"({placed(base, 'shard', rows)})")
    return (
        f"SELECT doc_id, size::bigint AS size, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1 AS slot, grown_shard FROM ({both})"
    )


def _url_sql() -> str:
    def like(p: str) -> str:
        shape = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        return f"(u LIKE '{shape}' ESCAPE '\\' OR uq LIKE '{shape}' ESCAPE '\\')"

    allow = " OR ".join(like(p) for p in url_filter.ALLOW)
    block = " ".join(f"WHEN {like(p)} THEN '{p}'" for p in url_filter.BLOCK)
    ruled = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    )
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in url_filter.UNRESERVED.items()) + "}"
    decoded = lambda x: f"string_split({x}, '%')[1] || list_aggregate(list_prepend('', list_transform(string_split({x}, '%')[2:], lambda p: coalesce({plain}[p[1:2]] || p[3:], '%' || p))), 'string_agg', '')"
    default = " ".join(f"WHEN scheme = '{k}' AND ends_with(h, ':{v}') THEN h[:-{len(v) + 2}]" for k, v in url_filter.PORTS.items())
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, {lower("split_part(url, '://', 1)")} AS scheme, coalesce(strpos(url, '://') > 0, false) AS ok FROM pages),
b AS (SELECT page_id, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {lower("regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1)")} AS query, scheme, ok FROM a),
c AS (SELECT *, regexp_replace(host, '^.*@', '') AS h, {decoded(lower("path"))} AS p, {decoded("query")} AS q FROM b),
d AS (SELECT *, CASE {default} WHEN ends_with(h, ':') THEN h[:-2] ELSE h END AS name, string_split(p, '/')[2:] AS parts FROM c),
e AS (SELECT *, CASE WHEN contains(p, '/.') THEN list_reduce(list_transform(parts, lambda x: [x]), lambda k, x: CASE x[1] WHEN '.' THEN k WHEN '..' THEN k[:-2] ELSE k || x END, []::VARCHAR[]) || CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END ELSE parts END AS kept FROM d),
f AS (SELECT *, CASE WHEN ok THEN name || '/' || coalesce(array_to_string(kept, '/'), '') ELSE '/' END AS u FROM e),
g AS (SELECT *, CASE WHEN q = '' THEN u ELSE u || '?' || q END AS uq FROM f),
i AS (SELECT page_id, host, path, CASE WHEN {allow} THEN NULL ELSE CASE {block} END END AS pattern, CASE {ruled} END AS r FROM g)
SELECT page_id, host, path, nullif(split_part(r, ' ', 2), '') AS rule,
       coalesce(split_part(r, ' ', 1), CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM i"""


def _quality_sql(min_rows: int = quality.MIN_ROWS, reach: float = quality.REACH) -> str:
    """The counts, the sketch, its merged levels and the fences in SQL."""
    names = list(quality.MEASURES)
    symbols, marks, upper, letters = "[#*$%&|<>]+", r"[!?=@^~_{}\[\]\\]+", r"\p{Lu}+", r"[\p{L}\p{M}]+"
    space, word = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    low = "[" + ", ".join(str(v).lower() for v in quality.MEASURES.values()) + "][m]"
    width = f"greatest(q2 * {quality.GAMMA - 1!r}::double, 1.0::double)"
    without = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    per = lambda n, d, k: f"({n} * {k}) // {d}"
    chars = "greatest(word_chars, 1)"
    measures = {
        "word_len": per("word_chars", "greatest(n_words, 1)", 100), "others": per("(word_chars - n_letters)", chars, 10000), "symbols": per("n_symbols", "greatest(n_words, 1)", 10000),
        "marks": per("n_marks", "greatest(n_words, 1)", 10000), "upper": per("n_upper", chars, 10000), "dup_lines": per("n_dup_lines", "greatest(n_lines, 1)", 10000),
        "repeats": per("n_repeat_words", "greatest(n_words, 1)", 10000),
    }
    values = ", ".join(measures[n] for n in names)
    at = lambda q: f"min(v) FILTER (cum >= ceil({q} * total))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, chr(1)) AS l, coalesce(source, chr(1)) AS s FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS n FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) > 5),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
k AS (SELECT r, sum(least(5, i - p)) AS c FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9) AS p FROM h) GROUP BY r),
a AS (SELECT d.*, len(w)::bigint AS n_words, length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars, {without(symbols)} AS n_symbols, len(n)::bigint AS n_lines,
    (len(n) - len(list_distinct(n)))::bigint AS n_dup_lines, coalesce(c, 0)::bigint AS n_repeat_words, {without(marks)} AS n_marks, {without(upper)} AS n_upper, {without(letters)} AS n_letters
    FROM d JOIN w USING (r) LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{values}] AS ms FROM a),
c AS (SELECT l, s, m, CASE WHEN ms[m] <= 0 THEN -1 ELSE ceil(ln(ms[m]) / {math.log(quality.GAMMA)!r})::integer END AS b, count(*) AS n FROM b, range(1, {len(names) + 1}) x(m) WHERE NOT base_failed GROUP BY ALL),
e AS (SELECT 0 AS level, l, s, m, b, n FROM c UNION ALL SELECT 1, l, '', m, b, n FROM c UNION ALL SELECT 2, '', '', m, b, n FROM c),
f AS (SELECT * FROM (SELECT level, l, s, m, b, sum(n) AS n FROM e GROUP BY ALL)
    QUALIFY b >= 0 OR 2 * n < sum(n) OVER (PARTITION BY level, l, s, m) OR n = sum(n) OVER (PARTITION BY level, l, s, m)),
q AS (SELECT level, l, s, m, total, {at(0.25)} AS q1, {at(0.5)} AS q2, {at(0.75)} AS q3 FROM (
    SELECT *, CASE WHEN b < 0 THEN 0.0::double ELSE 2 * pow({quality.GAMMA}::double, b) / {quality.GAMMA + 1}::double END AS v, sum(n) OVER (PARTITION BY level, l, s, m ORDER BY b) AS cum, sum(n) OVER (PARTITION BY level, l, s, m) AS total FROM f) GROUP BY ALL),
z AS (SELECT *, q2 + {reach} * greatest(q3 - q2, {width}) AS hi, CASE WHEN {low} THEN q2 - {reach} * greatest(q2 - q1, {width}) ELSE -1 END AS lo FROM q),
y AS (SELECT x.l, x.s, x.m, CASE WHEN x.total >= {min_rows} THEN [x.lo, x.hi] WHEN o.total >= {min_rows} THEN [o.lo, o.hi] ELSE [u.lo, u.hi] END AS fence
    FROM z x LEFT JOIN z o ON o.level = 1 AND o.l = x.l AND o.m = x.m LEFT JOIN z u ON u.level = 2 AND u.m = x.m WHERE x.level = 0),
v AS (SELECT r, bool_and(ms[m] BETWEEN fence[1] AND fence[2]) AS inside FROM b JOIN y USING (l, s) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept FROM b LEFT JOIN v USING (r)"""


#: CRC-32 of a text, with the table ``crc(t)`` of CRC_TABLE at hand.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"


def _crc_sql(text_bytes: str, table: str = "(SELECT t FROM crc)") -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {text_bytes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _manifest_sql(levels: int = 8, top: int = 2, arity: int = manifest.ARITY) -> str:
    """The tree level by level, and every leaf's way up, for languages of at most arity ** levels leaves."""

    def leaf(text: str) -> str:
        part = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
        return "sha256(" + " || ".join(part(text if c == "text" else c) for c in manifest.COLUMNS) + ")"

    digits = "list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)"
    lower = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"
    parts = [
        CRC_TABLE,
        f"d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf('text')} AS leaf, CASE WHEN {_crc_sql(digits, 't')} % 3 = 0 THEN {leaf(lower)} END AS bad FROM documents, crc)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, coalesce(bad, leaf) AS f, '' AS proof FROM d)",
        "n0 AS (SELECT tree, rank, leaf AS d FROM p0)",
    ]
    for k in range(levels + top):
        if k == levels:
            parts += [
                f"s AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM n{k})",
                f"n{k}x AS (SELECT '' AS tree, place AS rank, subroot AS d FROM s)",
                f"p{k}x AS (SELECT p.doc_id, '' AS tree, p.leaf, s.place AS rank, p.f, p.proof, s.subroot FROM p{k} p JOIN s USING (tree))",
            ]
        x = "x" if k == levels else ""
        parts += [
            f"r{k} AS (SELECT tree, rank // {arity} AS run, list(d ORDER BY rank) AS ds, sum(count(*)) OVER (PARTITION BY tree) > 1 AS more FROM n{k}{x} GROUP BY 1, 2)",
            f"n{k + 1} AS (SELECT tree, run AS rank, CASE WHEN more THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{k})",
            f"p{k + 1} AS (SELECT p.* EXCLUDE (rank, f, proof), rank // {arity} AS rank, CASE WHEN more THEN sha256(array_to_string(ds[:rank % {arity}], '') || f || array_to_string(ds[rank % {arity} + 2:], '')) ELSE f END AS f, "
            f"CASE WHEN more THEN proof || array_to_string(ds[:rank % {arity}], '') || array_to_string(ds[rank % {arity} + 2:], '') ELSE proof END AS proof FROM p{k}{x} p JOIN r{k} r ON p.tree = r.tree AND p.rank // {arity} = r.run)",
        ]
    end = levels + top
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM p{end} JOIN n{end} USING (tree)"


def _search_sql(top: int = search.TOP) -> str:
    of = lambda name, key: f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{manifest.UPPER}', '{manifest.LOWER}'), '{search.TERM}')) AS term FROM {name}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), t AS ({of("d", "r")}),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT r, sum(tf)::bigint AS n FROM tf GROUP BY r),
c AS (SELECT count(*)::bigint AS N, sum(n)::bigint AS L FROM n), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, text, term FROM ({of("benchmark", "item_id, text")})),
w AS (SELECT term, floor(1000 * ln((2 * N + 2) / (2 * df + 1)))::bigint AS w FROM df, c),
m AS (SELECT r, 50 + (50 * n.n * c.N) // c.L AS m FROM n, c),
s AS (SELECT item_id, text, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id NULLS FIRST)::integer AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id NULLS FIRST) <= {top}"""


ORACLE = {"op4_quality": _quality_sql(), "op10_url_filter": _url_sql(), "op11_search": _search_sql(), "op12_manifest": _manifest_sql()}
