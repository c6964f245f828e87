"""Registered queries for sources and sinks.

Round trips write a given table to a fresh folder under the shared checkpoint location,
read it back with the engine's reader and conform the types; the oracle is the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from ..sources import csv as CSV
from ..sources import json as JS
from ..sources import markdown as MD
from ..sources import xml as XML
from .catalog import register, table


@register("s1_csv_roundtrip", "SELECT * FROM part")
def s1_csv_roundtrip(spark, sf_dir):
    """K1 write (quoted, js number text) then S1-S3 read with delimiter sniffing."""
    part = table(spark, sf_dir, "part")
    out = scratch_dir(spark, "csv")
    CSV.write_csv(part, out)
    back = CSV.read_csv(spark, out, sep=None)
    return CSV.conform(back, part.schema)


@register("s1_csv_documents", """
SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents
""")
def s1_csv_documents(spark, sf_dir):
    """All columns of documents as CSV, with quotes and line ends in cells, read back by byte ranges."""
    docs = table(spark, sf_dir, "documents")
    out = scratch_dir(spark, "csvdocs")
    CSV.write_csv(docs, out)
    return CSV.conform(CSV.read_csv(spark, out, clean=False), docs.schema)


@register("s4_json_documents", "SELECT * FROM documents")
def s4_json_documents(spark, sf_dir):
    """All columns of documents as JSON arrays, with braces and quotes in texts, read back by byte ranges."""
    docs = table(spark, sf_dir, "documents")
    out = scratch_dir(spark, "jsondocs")
    JS.write_json(docs, out, layout="array", indent=True)
    return CSV.conform(JS.read_json(spark, out), docs.schema)


def _delimiter_sql() -> str:
    """Scores from the lines that the files of s2_csv_delimiter_profile hold, cell by cell."""
    files = {"nation": (",", "n_nationkey, n_name, n_regionkey"), "region": (";", "r_regionkey, r_name"),
             "supplier": ("\t", "s_suppkey, s_name, s_nationkey, s_acctbal"),
             "customer": ("|", "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment")}
    parts = []
    for name, (sep, cols) in files.items():
        names = cols.split(", ")
        cells = ", ".join(f"CASE WHEN contains(CAST({c} AS VARCHAR), '{sep}') THEN 'q' ELSE CAST({c} AS VARCHAR) END"
                          for c in names)
        parts.append(f"SELECT '{name}' AS source, '{sep.join(names)}' AS line\n  UNION ALL SELECT '{name}', "
                     f"concat_ws('{sep}', {cells}) FROM {name}")
    lines = "\n  UNION ALL ".join(parts)
    return f"""
WITH lines AS (
  {lines}
), scored AS (
  SELECT source, k, delimiter, avg(n) * CASE WHEN count(*) > 1 AND min(n) = max(n) THEN 2 ELSE 1 END AS score
  FROM (SELECT source, k, delimiter, 1 + length(line) - length(replace(line, delimiter, '')) AS n
        FROM lines, (VALUES (0, ','), (1, ';'), (2, '\t'), (3, '|')) d(k, delimiter))
  GROUP BY source, k, delimiter
)
SELECT source, delimiter, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, k) = 1 AS chosen FROM scored
"""


@register("s2_csv_delimiter_profile", _delimiter_sql())
def s2_csv_delimiter_profile(spark, sf_dir):
    """Sniff the delimiter of files written with ',', ';', tab and '|'."""
    base = scratch_dir(spark, "sniff")
    for name, sep in (("nation", ","), ("region", ";"), ("supplier", "\t"), ("customer", "|")):
        (table(spark, sf_dir, name).coalesce(1).write.option("header", True).option("sep", sep)
         .csv(f"{base}/{name}"))
    prof = CSV.delimiter_profile(spark, base, "*.csv", whole=True)
    return prof.select(F.regexp_extract("path", r"/([a-z]+)/[^/]+$", 1).alias("source"), "delimiter", "score",
                       "chosen")


@register("s4_json_roundtrip", "SELECT * FROM customer")
def s4_json_roundtrip(spark, sf_dir):
    """K2 array documents (one per part file) read back as rows."""
    cu = table(spark, sf_dir, "customer")
    out = scratch_dir(spark, "json")
    JS.write_json(cu, out, layout="array")
    return CSV.conform(JS.read_json(spark, out, layout="rows"), cu.schema)


@register("s4_json_lines_roundtrip", "SELECT * FROM orders")
def s4_json_lines_roundtrip(spark, sf_dir):
    """JSON lines with sorted keys written and read back."""
    od = table(spark, sf_dir, "orders")
    out = scratch_dir(spark, "jsonl")
    JS.write_json(od, out, layout="lines", sort_keys=True)
    return CSV.conform(JS.read_json(spark, out, layout="rows", lines=True), od.schema)


_JS_TYPE_SQL = """CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'object' ELSE 'number' END"""


@register("s5_json_indexed", f"""
SELECT event_id, i AS "index", CAST(json_extract(j, '$[' || i || ']') AS VARCHAR) AS value,
       {_JS_TYPE_SQL.format(v="json_extract(j, '$[' || i || ']')")} AS type
FROM (SELECT event_id, '[' || event_id || ',"' || event_type || '",' || props || ',null,[1,2]]' AS j FROM events),
     range(5) t(i)
""")
def s5_json_indexed(spark, sf_dir):
    """Mixed JSON arrays as (index, value, type) rows."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("["), F.col("event_id"), F.lit(',"'), F.col("event_type"), F.lit('",'),
                             F.col("props"), F.lit(",null,[1,2]]")).alias("j"))
    out = JS.json_indexed(ev, "j", keep=["event_id"])
    return out.select("event_id", "index", F.to_json("value").alias("value"), "type")


@register("s6_json_entries", f"""
SELECT event_id, k AS key, CAST(json_extract(props, '$."' || k || '"') AS VARCHAR) AS value,
       {_JS_TYPE_SQL.format(v="json_extract(props, '$.\"' || k || '\"')")} AS type
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
""")
def s6_json_entries(spark, sf_dir):
    """Every events.props object as (key, value, type) rows."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    out = JS.json_entries(ev, "props", keep=["event_id"])
    return out.select("event_id", "key", F.to_json("value").alias("value"), "type")


@register("s7_json_scalar", """
SELECT event_id, json_extract_string(props, '$.k') AS value, 'number' AS type FROM events
""")
def s7_json_scalar(spark, sf_dir):
    """JSON scalars as (value, type) rows."""
    ev = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    out = JS.json_scalar(ev, "k", keep=["event_id"])
    return out.select("event_id", F.to_json("value").alias("value"), "type")


@register("k3_json_object", """
SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey
""")
def k3_json_object(spark, sf_dir):
    """Object layout: first column is the key, the last row (by order key) wins."""
    od = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    obj = JS.to_object_layout(od, order_by=["o_orderkey"])
    return obj.select("key", F.col("value.o_totalprice").alias("value"))


@register("k4_json_keyvalue", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def k4_json_keyvalue(spark, sf_dir):
    """Key/value layout from the first two columns (K4)."""
    return JS.to_keyvalue_layout(table(spark, sf_dir, "nation"))


@register("s8_xml_roundtrip", "SELECT * FROM nation")
def s8_xml_roundtrip(spark, sf_dir):
    """K5 write (root/row tags) then S8 read with the row tag sniffed from the file."""
    n = table(spark, sf_dir, "nation")
    out = scratch_dir(spark, "xml")
    XML.write_xml(n, out, root_tag="data", row_tag="item")
    return CSV.conform(XML.read_xml(spark, out), n.schema)


@register("s9_xml_entries", """
SELECT c_custkey, key, value, 'string' AS type FROM (
  SELECT c_custkey, 1 AS pos, 'c_name' AS key, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 2, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 3, 'c_mktsegment', c_mktsegment FROM customer)
""")
def s9_xml_entries(spark, sf_dir):
    """Each customer row as an XML element; its children become (key, value, type) rows."""
    cu = table(spark, sf_dir, "customer")
    x = cu.select("c_custkey", F.to_xml(F.struct("c_name", "c_nationkey", "c_mktsegment")).alias("x"))
    return XML.xml_entries(x, "x", keep=["c_custkey"]).select("c_custkey", "key", "value", "type")


@register("s9_xml_nested_entries", """
SELECT c_custkey, key, value, type FROM (
  SELECT c_custkey, 'c_custkey' AS key, CAST(c_custkey AS VARCHAR) AS value, 'string' AS type FROM customer
  UNION ALL SELECT c_custkey, 'c_name', c_name || ' <b> & c', 'string' FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', '<c_nationkey>' || c_nationkey || '</c_nationkey>', 'object' FROM customer
  UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR), 'text' FROM customer
  UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 'array' FROM customer
  UNION ALL SELECT c_custkey, 'c_mktsegment', '<c_mktsegment/>', 'array' FROM customer)
""")
def s9_xml_nested_entries(spark, sf_dir):
    """All customer columns as an element with nested, same-named and CDATA children and a comment."""
    cu = table(spark, sf_dir, "customer")
    x = F.concat(
        F.lit("<customer><c_custkey>"), F.col("c_custkey").cast("string"), F.lit("</c_custkey><c_name><![CDATA["),
        "c_name", F.lit(" <b> & c]]></c_name><!-- <c_name>none</c_name> --><c_nationkey><c_nationkey>"),
        F.col("c_nationkey").cast("string"), F.lit('</c_nationkey></c_nationkey><c_acctbal unit="a > b">'),
        F.col("c_acctbal").cast("string"), F.lit("</c_acctbal><c_mktsegment>"), "c_mktsegment",
        F.lit("</c_mktsegment><c_mktsegment><c_mktsegment/></c_mktsegment></customer>"))
    return XML.xml_entries(cu.select("c_custkey", x.alias("x")), "x", keep=["c_custkey"]).select(
        "c_custkey", "key", "value", "type")


@register("s10_xml_attributes", """
SELECT n_nationkey AS id, n_name AS name_text, n_nationkey * 100 AS name_code, n_regionkey AS region FROM nation
""")
def s10_xml_attributes(spark, sf_dir):
    """Attributes and text-with-attributes survive a write/read and lose Spark's prefixes."""
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("@id"),
        F.struct(F.col("n_name").alias("_VALUE"), (F.col("n_nationkey") * 100).alias("@code")).alias("name"),
        F.col("n_regionkey").alias("region"))
    out = scratch_dir(spark, "xmlattr")
    XML.write_xml(n, out, row_tag="nation")
    back = XML.read_xml(spark, out, row_tag="nation")
    return back.select(F.col("id").cast("int").alias("id"), F.col("name.text").alias("name_text"),
                       F.col("name.code").cast("int").alias("name_code"), F.col("region").cast("int").alias("region"))


@register("s13_md_table_roundtrip", "SELECT * FROM part")
def s13_md_table_roundtrip(spark, sf_dir):
    """K9 table per part file, then S13/S14 read with per-column typing."""
    part = table(spark, sf_dir, "part")
    out = scratch_dir(spark, "mdtable")
    MD.write_markdown_table(part, out)
    return CSV.conform(MD.read_markdown_table(spark, out), part.schema)


@register("s15_md_list", "SELECT n_name AS text, 'list-item' AS type, 'list' AS content_type FROM nation")
def s15_md_list(spark, sf_dir):
    """A Markdown list written from nation and scanned back."""
    out = scratch_dir(spark, "mdlist")
    MD.write_markdown_list(table(spark, sf_dir, "nation").select("n_name"), out, title=None)
    docs = MD.read_markdown_texts(spark, out)
    return MD.structured_content(docs).select("text", "type", "content_type")


@register("s16_md_headings", "SELECT n_regionkey + 1 AS level, n_name AS text, 'heading' AS type FROM nation")
def s16_md_headings(spark, sf_dir):
    """Markdown headings written with levels and scanned back."""
    out = scratch_dir(spark, "mdhead")
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1).alias("level"), F.col("n_name").alias("text"))
    MD.write_markdown_headings(n, out)
    docs = MD.read_markdown_texts(spark, out)
    return MD.structured_content(docs).select("level", "text", "type")


@register("s17_md_paragraphs", """
SELECT r_name || ' region' AS text, 'paragraph' AS type FROM region
UNION ALL SELECT 'key ' || r_regionkey, 'paragraph' FROM region
""")
def s17_md_paragraphs(spark, sf_dir):
    """One plain-text document per region: blank-line separated paragraphs."""
    r = table(spark, sf_dir, "region")
    docs = r.select(F.col("r_regionkey").cast("string").alias("path"),
                    F.concat("r_name", F.lit(" region\n\n  key "), F.col("r_regionkey").cast("string"),
                             F.lit("\n\n\n")).alias("text"))
    return MD.structured_content(docs).select("text", "type")


@register("s18_md_frontmatter", """
SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, 'Nation ' || n_nationkey AS body
FROM nation
""")
def s18_md_frontmatter(spark, sf_dir):
    """Front matter parsed into a key/value map and a body."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit('---\nname: "'), F.col("n_name"), F.lit('"\nregion: '), F.col("n_regionkey"),
                    F.lit("\n---\nNation "), F.col("n_nationkey"))
    meta, body = MD.frontmatter(text)
    return n.select("n_nationkey", meta["name"].alias("name"), meta["region"].alias("region"), body.alias("body"))


@register("k9_md_table_lines", r"""
SELECT '| ' || n_nationkey || ' | ' || trim(replace(replace(n_name || ' \ |' || r_name, '\', '\\'), '|', '\|'))
       || ' | ' || n_regionkey || ' |' AS line
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def k9_md_table_lines(spark, sf_dir):
    """Row lines with escaped backslashes and pipes (D25 order: backslash first)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.concat("n_name", F.lit(" \\ |"), "r_name").alias("n_name"), "n_regionkey")
    return j.select(MD.table_line(j).alias("line"))


@register("a10_md_structure", """
SELECT 'doc-' || n_nationkey AS path, true AS has_table, CAST(1 AS BIGINT) AS table_count, true AS has_headings,
       CAST(1 AS BIGINT) AS heading_count, true AS has_lists, CAST(2 AS BIGINT) AS list_item_count,
       'table' AS content_type
FROM nation
""")
def a10_md_structure(spark, sf_dir):
    """One Markdown document per nation: a heading, a one-row table and a two-item list."""
    n = table(spark, sf_dir, "nation")
    docs = n.select(
        F.concat(F.lit("doc-"), F.col("n_nationkey").cast("string")).alias("path"),
        F.concat(F.lit("# "), "n_name", F.lit("\n\n| name | key |\n|---|---|\n| "), "n_name", F.lit(" | "),
                 F.col("n_nationkey").cast("string"), F.lit(" |\n\n- "), "n_name", F.lit("\n- region "),
                 F.col("n_regionkey").cast("string"), F.lit("\n")).alias("text"))
    return MD.structure_profile(docs)


@register("s3_csv_clean", """
SELECT CAST(c_custkey AS INTEGER) AS "name_key", nullif(trim(c_mktsegment), '') AS column_1, c_name AS "label"
FROM customer
""")
def s3_csv_clean(spark, sf_dir):
    """Padded headers and cells, an empty header and empty cells: trimmed, column_<n>, nulls."""
    from ..sources.markdown import _with_preamble
    cu = table(spark, sf_dir, "customer")
    lines = cu.select(F.concat(F.col("c_custkey").cast("string"), F.lit(",  "), F.col("c_mktsegment"), F.lit(" , "),
                               F.col("c_name"), F.lit("  ")).alias("value"))
    out = scratch_dir(spark, "csvclean")
    _with_preamble(lines, [" name_key ,, label "]).write.text(out)
    return CSV.read_csv(spark, out, sep=",")


@register("k6_xml_names_all", """
SELECT c_custkey AS "_1id", c_name AS "c_name", c_nationkey AS "nation_key", c_acctbal AS "_-balance", c_mktsegment AS "field_xmlSegment"
FROM customer
""")
def k6_xml_names_all(spark, sf_dir):
    """All customer columns under names that XML does not allow (K6)."""
    cu = table(spark, sf_dir, "customer")
    names = ["1id", "c name", "nation/key", "-balance", "xmlSegment"]
    out = scratch_dir(spark, "xmlnamesall")
    XML.write_xml(cu.toDF(*names), out, row_tag="customer")
    back = XML.read_xml(spark, out, row_tag="customer")
    valid = ["_1id", "c_name", "nation_key", "_-balance", "field_xmlSegment"]
    return back.select(*[F.col(f"`{v}`").cast(f.dataType).alias(v) for v, f in zip(valid, cu.schema.fields)])


@register("k6_xml_names", """
SELECT c_custkey AS "_1id", c_name AS "c_name", c_mktsegment AS "field_xmlSegment" FROM customer
""")
def k6_xml_names(spark, sf_dir):
    """Column names that are not valid XML names are sanitised on write and come back so."""
    cu = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("1id"), F.col("c_name").alias("c name"), F.col("c_mktsegment").alias("xmlSegment"))
    out = scratch_dir(spark, "xmlnames")
    XML.write_xml(cu, out, row_tag="customer")
    back = XML.read_xml(spark, out, row_tag="customer")
    return back.select(F.col("_1id").cast("long").alias("_1id"), "c_name", "field_xmlSegment")


@register("s11_xlsx_roundtrip", "SELECT * FROM part")
def s11_xlsx_roundtrip(spark, sf_dir):
    """K8 one workbook per partition, then S11 read (one task per workbook, header row detected)."""
    from ..sources import xlsx as XL
    part = table(spark, sf_dir, "part")
    out = scratch_dir(spark, "xlsx")
    XL.write_xlsx(part, out, sheet_name="part")
    return CSV.conform(XL.read_xlsx(spark, out, sheet_name="part"), part.schema)


@register("k8_xlsx_overwrite", """
SELECT *, event_type || chr(1) || chr(9) || '_x0041_' AS note, event_id + 1 AS after FROM events
""")
def k8_xlsx_overwrite(spark, sf_dir):
    """Events with instants and control characters as workbooks (K8, S11), read and written over themselves."""
    from ..sources import xlsx as XL
    ev = table(spark, sf_dir, "events")
    out = scratch_dir(spark, "xlsxover")
    XL.write_xlsx(ev.withColumn("note", F.concat("event_type", F.lit("\x01\t_x0041_"))), out, sheet_name="events")
    XL.write_xlsx(XL.read_xlsx(spark, out).withColumn("after", F.col("event_id") + 1), out, sheet_name="events")
    schema = T.StructType([*ev.schema.fields, T.StructField("note", T.StringType()), T.StructField("after", T.LongType())])
    return CSV.conform(XL.read_xlsx(spark, out, sheet_name="events"), schema)


@register("s12_xlsx_inventory", """
SELECT 'part' AS sheet_name, 0 AS sheet_index, CAST(6 AS BIGINT) AS column_count, count(*) AS data_rows FROM part
""")
def s12_xlsx_inventory(spark, sf_dir):
    """Sheet inventory of the workbooks written from part: data rows summed over workbooks."""
    from ..sources import xlsx as XL
    part = table(spark, sf_dir, "part")
    out = scratch_dir(spark, "xlsxinv")
    XL.write_xlsx(part, out, sheet_name="part")
    inv = XL.sheet_inventory_df(spark, out)
    return inv.groupBy("sheet_name", "sheet_index", "column_count").agg(
        (F.sum("row_count") - F.count(F.lit(1))).alias("data_rows"))


@register("s19_read_encoding", "SELECT * FROM customer")
def s19_read_encoding(spark, sf_dir):
    """Read options: a Latin-1 encoded CSV read back with the encoding option."""
    cu = table(spark, sf_dir, "customer")
    out = scratch_dir(spark, "latin1")
    CSV.write_csv(cu, out, encoding="ISO-8859-1")
    return CSV.conform(CSV.read_csv(spark, out, sep=",", encoding="ISO-8859-1"), cu.schema)


@register("s19_xlsx_sheet_range", "SELECT p_name, p_brand FROM part")
def s19_xlsx_sheet_range(spark, sf_dir):
    """Read options: sheet chosen by 0-based index and a cell range selecting two columns."""
    from ..sources import xlsx as XL
    part = table(spark, sf_dir, "part")
    out = scratch_dir(spark, "xlsxrange")
    XL.write_xlsx(part, out, sheet_name="parts")
    return XL.read_xlsx(spark, out, sheet_index=0, range_="B1:C1048576")


@register("k7_xml_nested", """
SELECT n_nationkey, n_name AS info_name, n_regionkey AS info_region, 2 AS tag_count, CAST(NULL AS VARCHAR) AS note
FROM nation
""")
def k7_xml_nested(spark, sf_dir):
    """Nested values in XML: a struct becomes child elements, an array repeated elements,
    null an empty element (read back as null)."""
    n = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("info"),
        F.array("n_name", F.concat("n_name", F.lit("!"))).alias("tag"), F.lit(None).cast("string").alias("note"))
    out = scratch_dir(spark, "xmlnested")
    XML.write_xml(n, out, row_tag="nation")
    back = XML.read_xml(spark, out, row_tag="nation")
    note = F.col("note") if "note" in back.columns else F.lit(None).cast("string")
    return back.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("info.name").alias("info_name"),
                       F.col("info.region").cast("int").alias("info_region"), F.size("tag").alias("tag_count"),
                       F.nullif(note.cast("string"), F.lit("")).alias("note"))


@register("k10_md_ordered_list", """
SELECT n_nationkey + 1 AS number, n_name AS text FROM nation
""")
def k10_md_ordered_list(spark, sf_dir):
    """Ordered Markdown list numbered by an explicit order (with_ordinal), read back."""
    out = scratch_dir(spark, "mdordered")
    MD.write_markdown_list(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), out, ordered=True,
                           order_by=["n_nationkey"])
    lines = spark.read.text(out).where(F.col("value").rlike(r"^\d+\. "))
    return lines.select(F.regexp_extract("value", r"^(\d+)\.", 1).cast("int").alias("number"),
                        F.regexp_extract("value", r"\*\*n_name\*\*: ([^,]*)", 1).alias("text"))
