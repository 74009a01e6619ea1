"""Registered queries over prompts rendered from templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.plans.queries import query
from casewright.sources import templates
from casewright.sources.views import table

_SHEET = """---
name: order_sheet
version: 1.0.0
description: >
  A sheet of one order: its lines,
  their tags.
inputs:
  lines: "list of lines"
output_schema: schemas/sheet.json
---

Order {{id}}{{#if buyer.comment}} of {{buyer.name}}: {{buyer.comment}}{{else}} of {{buyer.name}}{{/if}}
{{#each lines}}{{@index}}. part {{this.part}}{{#each this.tags}} <{{this}}|{{../no}}>{{/each}}{{#if ../urgent}}!{{/if}}{{#unless @last}};{{/unless}}
{{else}}no lines
{{/each}}{{absent}}{{#absent.deeper}}never{{/absent.deeper}}{{{buyer.raw}}}
"""


@query(
    "rendered_prompts",
    """WITH l AS (SELECT l_orderkey, string_agg(concat(n, '. part ', l_partkey, ' <a&amp;', l_returnflag, '|', l_linenumber, '>', CASE WHEN l_quantity > 25 THEN concat(' <&quot;', l_linestatus, '&quot;|', l_linenumber, '>') ELSE '' END,
        CASE WHEN urgent THEN '!' ELSE '' END, CASE WHEN n < m THEN ';' ELSE '' END, chr(10)), '' ORDER BY n) AS t
        FROM (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY l_orderkey) - 1 AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) q
        JOIN (SELECT o_orderkey, o_orderpriority LIKE '1%' AS urgent FROM orders) o ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT o_orderkey AS id, concat('Order ', o_orderkey, ' of ', c_name, CASE WHEN c_nationkey % 5 <> 0 THEN concat(': it&#x27;s ', c_mktsegment) ELSE '' END, chr(10), coalesce(t, concat('no lines', chr(10))), '<b>', c_mktsegment, '</b>', chr(10)) AS prompt
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def _(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    tags = F.array_compact(F.array(F.concat(F.lit("a&"), "l_returnflag"), F.when(F.col("l_quantity") > 25, F.concat(F.lit('"'), "l_linestatus", F.lit('"')))))
    one = F.struct(*order, F.struct(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("no"), tags.alias("tags")).alias("line"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["line"]).alias("lines"))
    segment = F.col("c_mktsegment")
    buyer = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("it's "), segment)).alias("comment"), F.concat(F.lit("<b>"), segment, F.lit("</b>")).alias("raw"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", buyer.alias("buyer")), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select(F.col("o_orderkey").alias("id"), "buyer", "lines", F.col("o_orderpriority").startswith("1").alias("urgent"))
    return rows.select("id", templates.rendered(templates.split(_SHEET)[1], rows).alias("prompt"))
