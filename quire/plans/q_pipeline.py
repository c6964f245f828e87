"""Registered queries for the conversion pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..session import scratch_dir
from ..sources import csv as CSV
from ..sources import json as JS
from . import pipeline as P
from .catalog import register, table
from .transformations import apply_transformations, conversion_delta

SPEC_STEPS = [
    {"type": "filter", "parameters": {"columnFilters": [{"columnName": "c_mktsegment", "operator": "equals",
                                                         "value": "AUTOMOBILE"}],
                                      "customConditions": ["c_acctbal > 1000"]}},
    {"type": "keyStyle", "parameters": {"style": "camelCase"}},
    {"type": "columnOperation", "parameters": {"operations": [
        {"type": "remove", "columnName": "cNationkey"},
        {"type": "add", "columnName": "tier", "defaultValue": "gold"}]}},
]


@register("c1_apply_transformations", """
SELECT c_custkey AS "cCustkey", c_name AS "cName", c_acctbal AS "cAcctbal", c_mktsegment AS "cMktsegment",
       'gold' AS tier
FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 1000
""")
def c1_apply_transformations(spark, sf_dir):
    """Request-style step list applied in the order given (filter first, on original names)."""
    return apply_transformations(table(spark, sf_dir, "customer"), SPEC_STEPS)


@register("a3_conversion_delta", """
SELECT (SELECT count(*) FROM customer) AS original_rows,
       count(*) AS transformed_rows, 5 AS original_columns, 5 AS transformed_columns,
       CAST(to_json([(SELECT count(*) FROM customer) - count(*) || ' rows were filtered out during transformation'])
         AS VARCHAR) AS warnings
FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 1000
""")
def a3_conversion_delta(spark, sf_dir):
    """Rows filtered out and columns removed or added by a step list (A3)."""
    cu = table(spark, sf_dir, "customer")
    out = conversion_delta(cu, apply_transformations(cu, SPEC_STEPS))
    return out.withColumn("warnings", F.to_json("warnings"))


@register("c3_convert", """
SELECT o_orderkey AS "oOrderkey", o_custkey AS "oCustkey", o_orderstatus AS "oOrderstatus",
       o_totalprice AS "oTotalprice", o_orderpriority AS "oOrderpriority"
FROM orders WHERE o_orderstatus = 'F'
""")
def c3_convert(spark, sf_dir):
    """CSV file -> detect -> validate -> read -> camelCase, drop a column, filter -> JSON file."""
    src = scratch_dir(spark, "convert-src")
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    CSV.write_csv(orders, src)
    out = scratch_dir(spark, "convert-out")
    steps = [{"type": "filter", "parameters": {"columnFilters": [
                 {"columnName": "oOrderstatus", "operator": "equals", "value": "F"}]}},
             {"type": "keyStyle", "parameters": {"style": "camelCase"}}]
    res = P.convert(spark, src, "json", out, transformations=steps)
    back = JS.read_json(spark, res.output_path, layout="rows")
    schema = orders.schema
    return back.select(*[F.col(n).cast(schema[o].dataType).alias(n) for n, o in (
        ("oOrderkey", "o_orderkey"), ("oCustkey", "o_custkey"), ("oOrderstatus", "o_orderstatus"),
        ("oTotalprice", "o_totalprice"), ("oOrderpriority", "o_orderpriority"))])


@register("c3_convert_all_columns", """
SELECT o_orderkey AS "oOrderkey", o_custkey AS "oCustkey", o_orderstatus AS "oOrderstatus", o_totalprice AS "oTotalprice",
       o_orderdate AS "oOrderdate", o_orderpriority AS "oOrderpriority" FROM orders
""")
def c3_convert_all_columns(spark, sf_dir):
    """All columns of orders, instants too, from CSV files to JSON files with camelCase keys."""
    src, out = scratch_dir(spark, "convert-all"), scratch_dir(spark, "convert-all-out")
    orders = table(spark, sf_dir, "orders")
    CSV.write_csv(orders, src)
    res = P.convert(spark, src, "json", out, transformations=[{"type": "keyStyle", "parameters": {"style": "camelCase"}}])
    back = JS.read_json(spark, res.output_path, layout="rows")
    names = {N.transform_key(f.name, "camelCase"): f.dataType for f in orders.schema.fields}
    return back.select(*[(F.col(n).cast("timestamp").cast(t) if "timestamp" in t.simpleString() else F.col(n).cast(t)).alias(n)
                         for n, t in names.items()])


@register("c4_convert_json_text_all", """
SELECT c_custkey, '{"cCustkey":' || c_custkey || ',"cName":"' || c_name || '","cNationkey":' || c_nationkey || ',"cAcctbal":'
       || c_acctbal || ',"cMktsegment":"' || c_mktsegment || '"}' AS converted FROM customer
""")
def c4_convert_json_text_all(spark, sf_dir):
    """All customer columns as JSON payloads, keys restyled inside the text (C4)."""
    cu = table(spark, sf_dir, "customer")
    cu = cu.select("c_custkey", F.to_json(F.struct(*cu.columns)).alias("payload"))
    return P.convert_text_column(cu, "payload", "json", "json", key_style="camelCase").select("c_custkey", "converted")


@register("c4_convert_json_to_csv_all", r"""
SELECT c_custkey, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' || chr(10) || c_custkey || ',' || c_name || ',' || c_nationkey
       || ',' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\.0$', '') || ',' || c_mktsegment AS converted FROM customer
""")
def c4_convert_json_to_csv_all(spark, sf_dir):
    """All customer columns from JSON payloads to CSV text (C4)."""
    cu = table(spark, sf_dir, "customer")
    cu = cu.select("c_custkey", F.to_json(F.struct(*cu.columns)).alias("payload"))
    return P.convert_text_column(cu, "payload", "json", "csv").select("c_custkey", "converted")


@register("c4_convert_json_text", """
SELECT c_custkey, json_object('cCustkey', c_custkey, 'cName', c_name, 'cMktsegment', c_mktsegment)::VARCHAR
       AS converted FROM customer
""")
def c4_convert_json_text(spark, sf_dir):
    """Customer rows as JSON payloads, keys restyled to camelCase inside the text (C4)."""
    cu = table(spark, sf_dir, "customer").select(
        "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("payload"))
    return P.convert_text_column(cu, "payload", "json", "json", key_style="camelCase").select("c_custkey", "converted")


@register("c4_convert_json_to_csv", """
SELECT c_custkey, 'c_custkey,c_name,c_mktsegment' || chr(10) || c_custkey || ',' || c_name || ',' || c_mktsegment
       AS converted FROM customer
""")
def c4_convert_json_to_csv(spark, sf_dir):
    """JSON payloads to CSV text with a header line (C4)."""
    cu = table(spark, sf_dir, "customer").select(
        "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("payload"))
    return P.convert_text_column(cu, "payload", "json", "csv").select("c_custkey", "converted")


@register("c4_convert_csv_to_json", """
SELECT s_suppkey, '[{"sName":"' || s_name || '","sNationkey":"' || s_nationkey || '"}]' AS converted FROM supplier
""")
def c4_convert_csv_to_json(spark, sf_dir):
    """CSV payloads to JSON arrays with camelCase keys (C4)."""
    su = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("s_name,s_nationkey\n"), "s_name", F.lit(","),
                              F.col("s_nationkey").cast("string")).alias("payload"))
    return P.convert_text_column(su, "payload", "csv", "json", key_style="camelCase").select("s_suppkey", "converted")


@register("c4_convert_csv_records", """
SELECT s_suppkey, '[{"sSuppkey":' || s_suppkey || ',"sName":"' || s_name || ', \\"Ltd\\"\\nEast","sNationkey":' || s_nationkey ||
       ',"sName_1":true},{"sSuppkey":null,"sName":null,"sNationkey":0.5,"sName_1":"x","__parsed_extra":["' || s_name ||
       '",' || s_suppkey || ']},{"sSuppkey":"a"}]' AS converted FROM supplier
""")
def c4_convert_csv_records(spark, sf_dir):
    """CSV payloads of several records to typed JSON: quoted commas, quotes and line breaks, a repeated
    header, empty, surplus and missing cells (C4)."""
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(
        F.lit("s_suppkey,s_name,s_nationkey,s_name\r\n"), key, F.lit(',"'), name, F.lit(', ""Ltd""\nEast",'),
        F.col("s_nationkey").cast("string"), F.lit(",true\r\n,,0.5,x,"), name, F.lit(","), key, F.lit("\r\n\r\na\r\n")).alias("payload"))
    return P.convert_text_column(su, "payload", "csv", "json", key_style="camelCase", typed=True).select("s_suppkey", "converted")


@register("c4_json_array_to_csv", """
SELECT c_custkey, 'cName,cname,cAcctbal,note,cNationkey' || chr(10) || '"' || c_name || ', ""x' || chr(34) || chr(34) || chr(34)
       || ',' || c_mktsegment || ',' || c_nationkey || ',,' || chr(10) || ',,,"{""k"":[1,null]}",' || c_custkey || chr(10)
       || 'true,,,"a' || chr(10) || 'b",' AS converted
FROM customer
""")
def c4_json_array_to_csv(spark, sf_dir):
    """JSON arrays of objects to CSV records: keys that differ in case or come late, nested values, quotes (C4)."""
    key = F.col("c_custkey").cast("string")
    p = F.concat(F.lit('[{"c_name":"'), "c_name", F.lit(', \\"x\\"","cname":"'), "c_mktsegment", F.lit('","c_acctbal":'),
                 F.col("c_nationkey").cast("string"), F.lit('},{"note":{"k":[1,null]},"c_nationkey":'), key,
                 F.lit('},{"c_name":true,"note":"a\\nb"}]'))
    cu = table(spark, sf_dir, "customer").select("c_custkey", p.alias("payload"))
    return P.convert_text_column(cu, "payload", "json", "csv", key_style="camelCase").select("c_custkey", "converted")


def _order_xml(df):
    """Customers as XML with an attribute, a repeated child, an empty one, CDATA and entities."""
    key = F.col("c_custkey").cast("string")
    p = F.concat(F.lit('<?xml version="1.0"?><!-- c --><order_row order_id="'), key, F.lit('"><c_name>'), "c_name",
                 F.lit(" &amp; co</c_name><tag>"), "c_mktsegment", F.lit('</tag><tag unit="&lt;">'), F.col("c_nationkey").cast("string"),
                 F.lit("</tag><empty/><raw><![CDATA[<i>]]></raw></order_row>"))
    return df.select("c_custkey", p.alias("payload"))


@register("c4_xml_to_json_document", """
SELECT c_custkey, '{"orderRow":{"$":{"orderId":"' || c_custkey || '"},"cName":["' || c_name || ' & co"],"tag":["' || c_mktsegment
       || '",{"$":{"unit":"<"},"_":"' || c_nationkey || '"}],"empty":[""],"raw":["<i>"]}}' AS converted FROM customer
""")
def c4_xml_to_json_document(spark, sf_dir):
    """XML documents to JSON with root, lists, attributes and text, keys restyled (C4)."""
    return P.convert_text_column(_order_xml(table(spark, sf_dir, "customer")), "payload", "xml", "json", key_style="camelCase",
                                 document=True).select("c_custkey", "converted")


@register("c4_xml_to_csv", """
SELECT c_custkey, 'order_id,c_name,tag,empty,raw' || chr(10) || c_custkey || ',' || c_name || ' & co,"[""' || c_mktsegment
       || '"",{""unit"":""<"",""text"":""' || c_nationkey || '""}]",,<i>' AS converted FROM customer
""")
def c4_xml_to_csv(spark, sf_dir):
    """XML documents to CSV: the outer element is a record (C4)."""
    return P.convert_text_column(_order_xml(table(spark, sf_dir, "customer")), "payload", "xml", "csv").select(
        "c_custkey", "converted")


@register("c4_xml_to_xml", """
SELECT c_custkey, '<ORDER_ROW ORDER_ID="' || c_custkey || '"><C_NAME>' || c_name || ' &amp; co</C_NAME><TAG>' || c_mktsegment
       || '</TAG><TAG UNIT="&lt;">' || c_nationkey || '</TAG><EMPTY/><RAW>&lt;i&gt;</RAW></ORDER_ROW>' AS converted FROM customer
""")
def c4_xml_to_xml(spark, sf_dir):
    """XML documents to XML with names in capitals (C4)."""
    return P.convert_text_column(_order_xml(table(spark, sf_dir, "customer")), "payload", "xml", "xml",
                                 key_style="uppercase").select("c_custkey", "converted")


@register("c4_json_to_xml", """
SELECT c_custkey, '<root><c_custkey>' || c_custkey || '</c_custkey><c_name>' || c_name || ' &lt;</c_name><tags>' || c_mktsegment
       || '</tags><tags><_1id>true</_1id></tags><none/></root>' AS converted FROM customer
""")
def c4_json_to_xml(spark, sf_dir):
    """JSON objects to XML: lists repeat their element, names are made valid, null is empty (C4)."""
    p = F.concat(F.lit('{"c_custkey":'), F.col("c_custkey").cast("string"), F.lit(',"c_name":"'), "c_name",
                 F.lit(' <","tags":["'), "c_mktsegment", F.lit('",{"1id":true}],"none":null}'))
    cu = table(spark, sf_dir, "customer").select("c_custkey", p.alias("payload"))
    return P.convert_text_column(cu, "payload", "json", "xml").select("c_custkey", "converted")


@register("k14_output_paths", """
SELECT doc_id, 'out/' || source || '_' || doc_id || '_converted.' ||
       CASE lang WHEN 'en' THEN 'json' WHEN 'de' THEN 'xml' WHEN 'fr' THEN 'md' ELSE 'csv' END AS output_path
FROM documents
""")
def k14_output_paths(spark, sf_dir):
    """Output path rule applied per row (name + _converted + target extension, in a folder)."""
    fmt = F.when(F.col("lang") == "en", "json").when(F.col("lang") == "de", "xml").when(
        F.col("lang") == "fr", "md").otherwise("csv")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("in/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("path"), fmt.alias("target"))
    return d.select("doc_id", P.output_path_col(F.col("path"), F.col("target"), output_dir="out").alias("output_path"))


CONVENTIONAL_STEPS = [
    {"type": "filter", "parameters": {"columnFilters": [{"columnName": "cMktsegment", "operator": "equals",
                                                         "value": "BUILDING"}]}},
    {"type": "columnOperation", "parameters": {"operation": {"type": "rename", "columnName": "cAcctbal",
                                                             "newName": "balance"}}},
    {"type": "keyStyle", "parameters": {"style": "camelCase"}},
]


@register("c2_convert_data", """
SELECT c_custkey AS "cCustkey", c_name AS "cName", c_nationkey AS "cNationkey", c_acctbal AS balance,
       c_mktsegment AS "cMktsegment"
FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def c2_convert_data(spark, sf_dir):
    """The command's fixed order (key style, column operations, filters; D20): the filter and
    the rename refer to the restyled names although they are listed first."""
    from .transformations import conventional_order, convert_data
    converted = convert_data(table(spark, sf_dir, "customer"), conventional_order(CONVENTIONAL_STEPS))
    return converted.data


@register("c3_format_chain", "SELECT * FROM part")
def c3_format_chain(spark, sf_dir):
    """Round trip through every format with ``convert`` (formats detected from the files):
    JSON -> XML -> Markdown -> XLSX -> CSV, then read back and typed like the table."""
    part = table(spark, sf_dir, "part")
    src = scratch_dir(spark, "chain-json")
    JS.write_json(part, src, layout="array")
    path = src
    for fmt in ("xml", "md", "xlsx", "csv"):
        out = scratch_dir(spark, f"chain-{fmt}")
        path = P.convert(spark, path, fmt, out).output_path
    return CSV.conform(CSV.read_csv(spark, path), part.schema)
