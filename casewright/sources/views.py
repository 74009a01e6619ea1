"""Canonical tables over the driver's tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The block's texts, of its other columns.
_TEXTS = {
    "case_name": "concat('Party ', CAST(l_suppkey % 40 AS VARCHAR(20)), ' v. Party ', CAST(l_partkey % 40 AS VARCHAR(20)))",
    "markdown": "concat('note on part ', CAST(l_partkey AS VARCHAR(20)), ' and state action of supplier ', CAST(l_suppkey % 40 AS VARCHAR(20)))",
}

#: name -> SQL that both engines run; each reads the driver's tables only.
SQL = {
    "block": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000 + n - 1 AS id, l_orderkey AS book_id, l_linenumber AS source_page, CAST(n - 1 AS INTEGER) AS order_index,
        CASE WHEN l_returnflag = 'R' THEN 'case_opinion' WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'numbered_note' WHEN l_returnflag = 'A' THEN 'header'
             WHEN l_linestatus = 'F' THEN 'case_header' ELSE 'narrative_text' END AS type,
        {_TEXTS['case_name']} AS case_name,
        {_TEXTS['markdown']} AS markdown, l_partkey, l_suppkey
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) AS l""",
    "book": """SELECT o_orderkey AS id, o_custkey AS corpus_id, o_orderdate AS ingested_at, page_min, page_max FROM orders
        JOIN (SELECT l_orderkey, min(l_linenumber) AS page_min, max(l_linenumber) AS page_max FROM lineitem GROUP BY l_orderkey) p ON l_orderkey = o_orderkey""",
    "section": "SELECT l_orderkey AS book_id, l_linenumber AS source_page, 1 AS level, concat('Section ', CAST(max(l_partkey) AS VARCHAR(20))) AS title FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY l_orderkey, l_linenumber",
    "cost_event": """SELECT event_id AS id, ts, user_id AS session_id, event_type AS feature, CAST(event_id % 7 = 0 AS BOOLEAN) AS cached, event_id % 500 AS artifact_id,
        CASE WHEN event_id % 3 = 0 THEN 'anthropic' ELSE 'voyage' END AS provider,
        CASE WHEN event_id % 6 = 0 THEN 'claude-opus-4-7' WHEN event_id % 3 = 0 THEN 'claude-haiku-4-5' WHEN event_id % 3 = 1 THEN 'voyage-3' ELSE 'unlisted' END AS model,
        event_id % 1000 AS input_tokens, event_id % 300 AS output_tokens, CAST(value AS DECIMAL(20,10)) AS total_cost_usd FROM events""",
    "artifact": """SELECT o_orderkey AS id, o_custkey AS corpus_id, CASE o_orderstatus WHEN 'F' THEN 'case_brief' WHEN 'O' THEN 'flashcards' ELSE 'outline' END AS type, o_orderdate AS created_at,
        o_orderpriority AS name, o_orderkey % 97 AS cache_key, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM orders""",
    "reference": "SELECT l_orderkey AS artifact_id, CASE WHEN l_partkey % 11 = 0 THEN -l_linenumber ELSE (l_orderkey * 10 + l_linenumber) * 1000 END AS ref, l_linenumber FROM lineitem",
    "segment": """SELECT conv_id AS transcript_id, turn AS order_index, CASE role WHEN 'assistant' THEN 'professor' WHEN 'user' THEN 'student' ELSE 'unknown' END AS speaker, text AS content,
        CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_char,
        CAST(length(text) AS BIGINT) AS n FROM conversations""",
    "review": "SELECT concat(CAST(user_id AS VARCHAR(20)), ':', event_type) AS card, ts AS at, event_id AS seq, CAST(event_id % 6 AS INTEGER) AS grade FROM events",
}


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A canonical table as a DataFrame; the tables that its SQL reads are bound to this directory's files, or ``given``."""
    sql = SQL[name].replace("VARCHAR(20)", "STRING")
    tables = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "events", "conversations") if t in sql}
    return spark.sql(_braced(sql, tables), **tables)


def block_texts() -> dict[str, Column]:
    """The texts of the view ``block``, to be made from a row's other columns."""
    return {k: F.expr(v.replace("VARCHAR(20)", "STRING")) for k, v in _TEXTS.items()}


def _braced(sql: str, tables) -> str:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*names: str) -> str:
    """The WITH clause that gives a query these canonical tables."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
