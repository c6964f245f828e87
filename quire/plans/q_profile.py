"""Registered queries for profiles and data-quality findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from ..operators import quality as Q
from ..session import scratch_dir
from ..sources.files import list_files
from .catalog import register, table

_LI_COLS = ("l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
            "l_returnflag,l_linestatus,l_shipdate")


@register("a4_table_summary", f"""
SELECT count(*) AS row_count, 11 AS column_count, '{_LI_COLS}' AS column_names, true AS has_headers,
       'parquet' AS format, 'utf-8' AS encoding FROM lineitem
""")
def a4_table_summary(spark, sf_dir):
    """Row and column counts, names, format and encoding of lineitem (A4)."""
    return PR.table_summary(table(spark, sf_dir, "lineitem"), fmt="parquet")


def _doc_json(spark, sf_dir):
    """Documents with their labels as JSON objects; unlabeled documents lack quality/toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars", "quality", "toxic")).alias("j"))


_DOC_JSON_SQL = """(SELECT d.doc_id, json_object('doc_id', d.doc_id, 'lang', d.lang, 'n_chars', d.n_chars)
   AS base, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


@register("a5_json_schema", """
WITH k AS (
  SELECT doc_id, unnest(['doc_id', 'lang', 'n_chars', 'quality', 'toxic']) AS key,
         unnest([CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), CAST(quality AS VARCHAR),
                 CAST(toxic AS VARCHAR)]) AS v
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT key, CASE WHEN key = 'lang' THEN 'string' ELSE 'integer' END AS type, count(*) AS present,
       (SELECT count(*) FROM documents) AS total_rows,
       count(*) / (SELECT count(*) FROM documents) > 0.8 AS required
FROM k WHERE v IS NOT NULL GROUP BY key
""")
def a5_json_schema(spark, sf_dir):
    """JSON type of the first value and the required flag per key (A5)."""
    return PR.json_schema_profile(_doc_json(spark, sf_dir), "j", order_by=["doc_id"])


@register("a8_json_depth")
def a8_json_depth(spark, sf_dir):
    """Depth and size of nested JSON built from orders (depth 4) and event props (depth 1)."""
    o = table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        "o_orderkey", F.struct("o_custkey", F.array(F.struct("o_totalprice", F.array("o_orderstatus")))
                               .alias("lines")).alias("c"))).alias("j"))
    e = table(spark, sf_dir, "events").select(F.col("props").alias("j"))
    return Q.json_depth_profile(o.unionByName(e), "j")


@register("a8_json_depth_by_key", r"""
SELECT doc_id, 1 + doc_id % 14 AS depth FROM documents
""")
def a8_json_depth_by_key(spark, sf_dir):
    """Depth of a payload per document: 1 to 14 nested objects around the whole text, whose own
    brackets and quotes do not count (A8)."""
    d = (F.col("doc_id") % 14).cast("int")
    inner = F.to_json(F.struct(F.concat(F.lit('[{"'), F.coalesce("text", F.lit(""))).alias("t")))
    nested = F.concat(F.repeat(F.lit('{"a":'), d), inner, F.repeat(F.lit("}"), d))
    return table(spark, sf_dir, "documents").select("doc_id", Q.json_depth(nested).cast("long").alias("depth"))


@register("a9_xml_schema", """
SELECT 'nation' AS element, 'element' AS type, ['key'] AS attributes, ['name', 'note', 'regions'] AS children,
       false AS is_array, count(*) AS root_count FROM nation
UNION ALL SELECT 'name', 'text-element', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, 0
UNION ALL SELECT 'note', 'text-element', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, 0
UNION ALL SELECT 'regions', 'element', CAST([] AS VARCHAR[]), ['r'], false, 0
UNION ALL SELECT 'r', 'text-element', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), true, 0
""")
def a9_xml_schema(spark, sf_dir):
    """Element profile of one XML document per nation (attributes, repeated children, empty element)."""
    n = table(spark, sf_dir, "nation")
    r = F.col("n_regionkey").cast("string")
    docs = n.select(F.concat(
        F.lit('<nation key="'), F.col("n_nationkey").cast("string"), F.lit('"><name>'), "n_name",
        F.lit("</name><regions><r>"), r, F.lit("</r><r>"), r, F.lit("</r></regions><note/></nation>")).alias("xml"))
    return PR.xml_schema_profile(docs, "xml")


@register("v1_structure_checks", """
SELECT 'warning' AS severity, 'MISSING_FIELDS' AS code, CAST(NULL AS VARCHAR) AS field, doc_id AS "row",
       'Row ' || doc_id || ' missing fields: quality, toxic' AS message
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
""")
def v1_structure_checks(spark, sf_dir):
    """Missing-field findings for documents whose JSON rows lack the label keys (V1)."""
    return Q.structure_checks(_doc_json(spark, sf_dir), "j", "doc_id",
                              headers=["doc_id", "lang", "n_chars", "quality", "toxic"])


@register("v3_csv_checks", """
SELECT 'warning' AS severity, 'PROBLEMATIC_CSV_CHARACTERS' AS code, 'rows' AS field, CAST(NULL AS BIGINT) AS "row",
       'Data contains quotes or newlines that will be escaped in CSV' AS message
FROM documents HAVING bool_or(regexp_matches(text, '[\\n\\r"]') OR regexp_matches(lang, '[\\n\\r"]')
                              OR regexp_matches(source, '[\\n\\r"]'))
""")
def v3_csv_checks(spark, sf_dir):
    """CSV suitability findings over the documents table (V3)."""
    return Q.csv_checks(table(spark, sf_dir, "documents"))


@register("v3_csv_row_checks", """
WITH t AS (SELECT doc_id, l.doc_id IS NOT NULL AS labelled FROM documents LEFT JOIN labels l USING (doc_id)),
     f AS (SELECT arg_min(labelled, doc_id) AS first FROM t)
SELECT 'warning' AS severity, 'INCONSISTENT_CSV_STRUCTURE' AS code, 'rows' AS field, CAST(NULL AS BIGINT) AS "row",
       count(*) || ' rows have inconsistent field structure' AS message
FROM t, f WHERE labelled <> first HAVING count(*) > 0
UNION ALL SELECT 'warning', 'HEADER_ROW_MISMATCH', 'headers', NULL,
       'Header count (4) doesn''t match row field count (' || CASE WHEN first THEN 5 ELSE 3 END || ')' FROM f
""")
def v3_csv_row_checks(spark, sf_dir):
    """Document rows that lack the label fields, against the first row and four headers (V3)."""
    return Q.csv_row_checks(_doc_json(spark, sf_dir), "j", ["doc_id"], headers=["doc_id", "lang", "n_chars", "quality"])


@register("v1_metadata_checks", """
SELECT 'warning' AS severity, 'METADATA_MISMATCH' AS code, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS "row",
       'Metadata totalRows (1) doesn''t match actual rows (' || count(*) || ')' AS message
FROM documents HAVING count(*) <> 1
UNION ALL SELECT 'warning', 'METADATA_MISMATCH', NULL, NULL, 'Metadata totalColumns (4) doesn''t match headers length (5)'
""")
def v1_metadata_checks(spark, sf_dir):
    """Stated row and column counts against the documents table (V1, V2)."""
    d = table(spark, sf_dir, "documents")
    return Q.metadata_checks(d, 1, d.columns, 4)


@register("v4_json_checks", """
SELECT 'error' AS severity, 'INVALID_JSON' AS code, 'j' AS field, CAST(NULL AS BIGINT) AS "row",
       count(*) || ' values are not valid JSON' AS message
FROM (SELECT html AS j FROM pages UNION ALL SELECT props FROM events) WHERE NOT json_valid(j) HAVING count(*) > 0
""")
def v4_json_checks(spark, sf_dir):
    """Invalid-JSON, depth and size findings over pages and event payloads (V4)."""
    p = table(spark, sf_dir, "pages").select(F.col("html").alias("j"))
    e = table(spark, sf_dir, "events").select(F.col("props").alias("j"))
    return Q.json_checks(p.unionByName(e), "j")


@register("v5_xml_checks", """
SELECT 'warning' AS severity, 'XML_CONTROL_CHARACTERS' AS code, 'rows' AS field, CAST(NULL AS BIGINT) AS "row",
       'Data contains control characters invalid in XML' AS message
FROM documents HAVING bool_or(regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'))
""")
def v5_xml_checks(spark, sf_dir):
    """XML suitability findings over the documents table (V5)."""
    return Q.xml_checks(table(spark, sf_dir, "documents"))


def _md_sql() -> str:
    cols = ["text", "lang", "source"]
    special = "[" + "".join("\\" + c if c in "\\[]^-" else c for c in Q.MD_SPECIAL_CHARS) + "]"

    def any_of(pred):
        return "bool_or(" + " OR ".join(pred.replace("{c}", c) for c in cols) + ")"
    checks = [
        (f"{any_of('length({c}) > ' + str(Q.MD_LONG_TEXT))}", "LONG_TEXT_IN_MARKDOWN",
         "Data contains long text that may not display well in Markdown tables"),
        (f"{any_of('regexp_matches({c}, ' + chr(39) + '[\\n\\r]' + chr(39) + ')')}", "NEWLINES_IN_MARKDOWN",
         "Data contains newlines that will be converted to spaces in Markdown tables"),
        (f"{any_of('regexp_matches({c}, ' + chr(39) + special + chr(39) + ')')}", "MARKDOWN_SPECIAL_CHARACTERS",
         "Data contains Markdown special characters that will be escaped"),
    ]
    return " UNION ALL ".join(
        f"SELECT 'warning' AS severity, '{code}' AS code, 'rows' AS field, CAST(NULL AS BIGINT) AS \"row\", '{msg}' AS message "
        f"FROM documents HAVING {cond}" for cond, code, msg in checks)


@register("v6_md_checks", _md_sql())
def v6_md_checks(spark, sf_dir):
    """Markdown suitability findings over the documents table (V6)."""
    return Q.markdown_checks(table(spark, sf_dir, "documents"))


@register("v7_xlsx_checks", """
SELECT 'error' AS severity, 'EXCEL_ROW_LIMIT_EXCEEDED' AS code, 'rows' AS field, CAST(NULL AS BIGINT) AS "row",
       'Data has ' || count(*) || ' rows, exceeding Excel''s limit of 1048576' AS message
FROM lineitem HAVING count(*) > 1048576
""")
def v7_xlsx_checks(spark, sf_dir):
    """Sheet-limit findings for lineitem (V7)."""
    return Q.xlsx_checks(table(spark, sf_dir, "lineitem"), sheet_name="lineitem")


@register("v5_xml_checks_found", """
SELECT 'warning' AS severity, 'INVALID_XML_FIELD_NAMES' AS code, 'headers' AS field, CAST(NULL AS BIGINT) AS "row",
       'Field names will be sanitized for XML: 1st lang' AS message
UNION ALL SELECT 'warning', 'RESERVED_XML_NAMES', 'headers', NULL, 'Field names starting with ''xml'' are reserved: xmlSource'
UNION ALL SELECT 'warning', 'COMPLEX_XML_STRUCTURES', 'rows', NULL,
       'Data contains nested objects or arrays that will be converted to XML elements'
UNION ALL SELECT 'warning', 'XML_CONTROL_CHARACTERS', 'rows', NULL, 'Data contains control characters invalid in XML'
FROM documents WHERE doc_id % 7 = 3 HAVING count(*) > 0
""")
def v5_xml_checks_found(spark, sf_dir):
    """XML findings over documents with bad names, a nested column and control characters in some texts (V5)."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("1st lang"), F.col("source").alias("xmlSource"), F.struct("n_chars").alias("size"),
        F.when(F.col("doc_id") % 7 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("\x01"))).otherwise(F.col("text"))
        .alias("text"))
    return Q.xml_checks(d)


@register("v7_xlsx_checks_found", """
SELECT 'warning' AS severity, 'INVALID_SHEET_NAME_CHARS' AS code, 'sheetName' AS field, CAST(NULL AS BIGINT) AS "row",
       'Sheet name contains invalid characters' AS message
UNION ALL SELECT 'warning', 'SHEET_NAME_TOO_LONG', 'sheetName', NULL, 'Sheet name is longer than 31 characters'
UNION ALL SELECT 'warning', 'COMPLEX_DATA_TYPES', 'rows', NULL,
       'Data contains complex objects that will be converted to JSON strings'
UNION ALL SELECT 'error', 'EXCEL_ROW_LIMIT_EXCEEDED', 'rows', NULL,
       'Data has ' || count(*) * 20 || ' rows, exceeding Excel''s limit of 1048576'
FROM lineitem HAVING count(*) * 20 > 1048576
""")
def v7_xlsx_checks_found(spark, sf_dir):
    """Sheet findings for lineitem, each row 20 times, with a nested column and a bad sheet name (V7)."""
    rows = table(spark, sf_dir, "lineitem").select("*", F.struct("l_orderkey", "l_linenumber").alias("key"),
                                                   F.explode(F.sequence(F.lit(1), F.lit(20))).alias("copy"))
    return Q.xlsx_checks(rows, sheet_name="lineitem / every row of it, twenty times")


@register("v8_file_checks")
def v8_file_checks(spark, sf_dir):
    """File checks for 'csv' over a folder holding CSV and JSON files written from tables."""
    base = scratch_dir(spark, "filecheck")
    table(spark, sf_dir, "nation").write.option("header", True).csv(f"{base}/a")
    table(spark, sf_dir, "region").write.json(f"{base}/b")
    return Q.file_checks(list_files(spark, base), "csv").select("severity", "code", "message")


@register("v8_file_checks_of_listing", """
WITH f AS (SELECT doc_id, '/in/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.markdown' ELSE '.txt' END AS path,
                  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE strlen(text) * 20000 END AS bytes FROM documents)
SELECT 'error' AS severity, 'FILE_TOO_LARGE' AS code, path AS field, CAST(NULL AS BIGINT) AS "row",
       'File size (' || format('{:,.2f}', bytes / 1048576.0::DOUBLE) || 'MB) exceeds maximum allowed size (10MB)' AS message
FROM f WHERE bytes > 10 * 1048576
UNION ALL SELECT 'warning', 'EMPTY_FILE', path, NULL, 'File is empty' FROM f WHERE bytes = 0
UNION ALL SELECT 'warning', 'EXTENSION_MISMATCH', path, NULL,
       'File extension ''.txt'' does not match expected format ''md''. Expected: .md, .markdown' FROM f WHERE doc_id % 3 = 2
""")
def v8_file_checks_of_listing(spark, sf_dir):
    """Size, emptiness and extension findings over a listing with one file per document (V8)."""
    ext = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".markdown").otherwise(".txt")
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ext).alias("path"), ext.alias("extension"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(0)).otherwise(F.octet_length("text") * F.lit(20000).cast("long")).alias("length"))
    return Q.file_checks(files, "md")


@register("v5_xml_texts", """
SELECT 'error' AS severity, 'INVALID_XML' AS code, CAST(c_custkey AS VARCHAR) AS field, CAST(line AS BIGINT) AS "row",
       'XML is not well-formed: ' || wrong || ' at line ' || line || ', column ' || (place + CASE WHEN named THEN strlen(c_name) ELSE 0 END)
         AS message
FROM customer JOIN (VALUES (1, 'mismatched tag', 2, 3, true), (2, 'no element found', 1, 7, true),
                           (3, 'junk after document element', 1, 8, true), (4, 'undefined entity', 1, 4, true),
                           (5, 'not well-formed (invalid token)', 1, 5, false)) w(kind, wrong, line, place, named)
  ON c_custkey % 7 = kind
""")
def v5_xml_texts(spark, sf_dir):
    """The first broken place of XML texts: tags that cross, an open end, a second root, an entity, a bad name (V5)."""
    n = F.col("c_name")
    broken = (F.when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("<a><b>\n"), n, F.lit("</a></b>")))
              .when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("<a><b>"), n))
              .when(F.col("c_custkey") % 7 == 3, F.concat(F.lit("<a>"), n, F.lit("</a><a/>")))
              .when(F.col("c_custkey") % 7 == 4, F.concat(F.lit("<a>"), n, F.lit("&none;</a>")))
              .when(F.col("c_custkey") % 7 == 5, F.concat(F.lit("<a><1>"), n, F.lit("</1></a>")))
              .otherwise(F.concat(F.lit("<a><![CDATA["), n, F.lit("]]></a>"))))
    return Q.xml_text_checks(table(spark, sf_dir, "customer").select("c_custkey", broken.alias("x")), "x", "c_custkey")


@register("v5_xml_pages")
def v5_xml_pages(spark, sf_dir):
    """The first place where each page is not well-formed XML (V5)."""
    return Q.xml_text_checks(table(spark, sf_dir, "pages"), "html", "page_id")


@register("v8_path_checks", """
SELECT CASE k % 3 WHEN 2 THEN 'warning' ELSE 'error' END AS severity,
       CASE k % 3 WHEN 0 THEN 'FILE_NOT_FOUND' WHEN 1 THEN 'NOT_A_FILE' ELSE 'EXTENSION_MISMATCH' END AS code, k,
       CASE k % 3 WHEN 0 THEN 'File does not exist' WHEN 1 THEN 'Path is not a file' ELSE 'File extension ' END AS message
FROM (SELECT n_nationkey AS k FROM nation)
""")
def v8_path_checks(spark, sf_dir):
    """Paths asked for below a folder: missing ones, folders, and files of another format (V8)."""
    base = scratch_dir(spark, "paths")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy(
        "k").option("header", True).csv(base)
    files = list_files(spark, base).select("path", F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("k"))
    asked = files.select(F.when(F.col("k") % 3 == 0, F.regexp_replace("path", "[^/]+$", "none.csv"))
                         .when(F.col("k") % 3 == 1, F.regexp_replace("path", "/[^/]+$", "")).otherwise(F.col("path")).alias("path"))
    found = Q.path_checks(spark, asked, base, "json")
    return found.select("severity", "code", F.regexp_extract("field", "k=([0-9]+)", 1).cast("int").alias("k"),
                        F.regexp_extract("message", "^[^:']+", 0).alias("message"))


@register("v9_content_json", """
SELECT 'error' AS severity, 'INVALID_JSON' AS code, CAST(event_id AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS "row",
       'Invalid JSON content' AS message
FROM events WHERE event_type = 'error'
""")
def v9_content_json(spark, sf_dir):
    """Content check of event payloads as JSON; those of errors lack their end (V9)."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.when(
        F.col("event_type") == "error", F.regexp_replace("props", "}$", "")).otherwise(F.col("props")).alias("head"))
    return Q.content_checks(ev, "json")


@register("v9_content_md", """
SELECT 'warning' AS severity, CASE k WHEN 0 THEN 'EMPTY_MARKDOWN' ELSE 'NO_MARKDOWN_PATTERNS' END AS code,
       CAST(p_partkey AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS "row",
       CASE k WHEN 0 THEN 'Markdown file appears to be empty' ELSE 'No Markdown patterns found in content' END AS message
FROM (SELECT p_partkey, p_partkey % 3 AS k FROM part) WHERE k < 2
""")
def v9_content_md(spark, sf_dir):
    """Content check of part names as Markdown: blank texts, plain ones, and headings (V9)."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.lit("  ")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("# "), "p_name", F.lit("\n\ntext")))
    return Q.content_checks(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"),
                                                                text.alias("head")), "md")


@register("v9_content_xml", """
SELECT 'warning' AS severity, 'UNBALANCED_XML_TAGS' AS code, CAST(page_id AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS "row",
       'XML tags may be unbalanced (this is a basic check)' AS message
FROM pages
WHERE len(regexp_extract_all(html, '<[^/][^>]*[^/]>'))
      <> len(regexp_extract_all(html, '</[^>]+>')) + len(regexp_extract_all(html, '<[^>]*/>'))
""")
def v9_content_xml(spark, sf_dir):
    """Content check of every whole page as XML (V9)."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("head"))
    return Q.content_checks(p, "xml")


@register("v9_content_csv", r"""
SELECT 'warning' AS severity, 'INCONSISTENT_CSV_FIELDS' AS code, CAST(doc_id AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS "row",
       bad || ' lines have different field counts than the first line' AS message
FROM (SELECT doc_id, len(list_filter(lines[2:10], lambda l: len(string_split(l, ',')) <> len(string_split(lines[1], ','))))
        AS bad
      FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: length(regexp_replace(l, '^\s+|\s+$', '', 'g')) > 0) AS lines
            FROM documents))
WHERE bad > 0
""")
def v9_content_csv(spark, sf_dir):
    """Content check of every whole document as CSV (V9)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"),
                                                 F.col("text").alias("head"))
    return Q.content_checks(d, "csv")


@register("v14_findings_report", """
SELECT severity, code, count(*) AS count FROM (
  SELECT 'warning' AS severity, 'MISSING_FIELDS' AS code FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.doc_id IS NULL
  UNION ALL SELECT 'error', 'INVALID_JSON' FROM pages HAVING count(*) > 0)
GROUP BY ALL
""")
def v14_findings_report(spark, sf_dir):
    """Findings of two checks counted per severity and code."""
    v1 = Q.structure_checks(_doc_json(spark, sf_dir), "j", "doc_id",
                            headers=["doc_id", "lang", "n_chars", "quality", "toxic"])
    v4 = Q.json_checks(table(spark, sf_dir, "pages").select(F.col("html").alias("j")), "j")
    return Q.findings_report(v1, v4)

