"""Data-quality reports as findings DataFrames.

A finding is ``(severity, code, field, row, message)``. Schema checks run on the driver
(names only); data checks are aggregates with map-side combine, so each check costs one
pass and returns one row per finding, never the offending data.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jscompat import js_trim
from ..functions.ordinal import sort_columns
from ..session import ship_package
from ..sources.files import every_file
from ..sources.xml_text import broken_place

FINDING_SCHEMA = "severity string, code string, field string, row long, message string"

# Thresholds and limits used by the checks.
MAX_FILE_MB = {"csv": 50, "xlsx": 100, "json": 25, "xml": 25, "md": 10}
DEFAULT_MAX_FILE_MB = 100
EXPECTED_EXTENSIONS = {"csv": [".csv"], "xlsx": [".xlsx", ".xls"], "json": [".json"], "xml": [".xml"],
                       "md": [".md", ".markdown"]}
XLSX_MAX_ROWS = 1_048_576
XLSX_MAX_COLUMNS = 16_384
JSON_MAX_DEPTH = 10
JSON_MAX_MB = 100
MD_LONG_TEXT = 100
MD_MAX_COLUMNS = 10
MD_SPECIAL_CHARS = ["|", "\\", "`", "*", "_", "{", "}", "[", "]", "(", ")", "#", "+", "-", ".", "!"]
XML_NAME_RE = r"^[a-zA-Z_][\w\-.]*$"
XML_CONTROL_RE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
SHEET_NAME_BAD_RE = r"[\\/?*\[\]:]"


def finding(severity: str, code: str, message, field=None, row=None) -> Column:
    msg = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                    (field if isinstance(field, Column) else F.lit(field)).cast("string").alias("field"),
                    (row if isinstance(row, Column) else F.lit(row)).cast("long").alias("row"), msg.alias("message"))


def static_findings(spark: SparkSession, items: Sequence[tuple]) -> DataFrame:
    """Findings known on the driver from a schema: (severity, code, message, field) tuples."""
    rows = [(sev, code, fld, None, msg) for sev, code, msg, fld in items]
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def flags_to_findings(agg_row_df: DataFrame, checks: Sequence[tuple[str, str, str, Column, str | None]]) -> DataFrame:
    """Turn one-row aggregate flags into finding rows: (flag column, severity, code, message)."""
    arr = F.array_compact(F.array(*[F.when(F.col(flag), finding(sev, code, msg, field)) for flag, sev, code, msg, field
                                    in checks]))
    return agg_row_df.select(F.explode(arr).alias("f")).select("f.*")


def _header_findings(spark, names: Sequence[str], prefix: str = "") -> list:
    out = []
    dup = [n for n, k in Counter(names).items() if k > 1]
    if dup:
        out.append(("warning", f"DUPLICATE{prefix}_HEADERS", f"Duplicate headers found: {', '.join(dup)}", "headers"))
    if any(not n or not n.strip() for n in names):
        out.append(("warning", f"EMPTY{prefix}_HEADERS", "Some headers are empty or contain only whitespace", "headers"))
    return out


# ---------------------------------------------------------------------------------------
# V1/V2 structure checks on JSON row documents
# ---------------------------------------------------------------------------------------

def metadata_checks(rows: DataFrame, total_rows: int | None, headers: Sequence[str] | None = None,
                    total_columns: int | None = None) -> DataFrame:
    """V1/V2: stated row and column counts that are negative or not the real ones."""
    items = []
    if headers is not None and total_columns is not None and total_columns != len(headers):
        items.append(("warning", "METADATA_MISMATCH", f"Metadata totalColumns ({total_columns}) doesn't match headers "
                      f"length ({len(headers)})", None))
    for name, n in (("totalRows", total_rows), ("totalColumns", total_columns)):
        if n is not None and n < 0:
            items.append(("error", "INVALID_COUNT", f"Metadata {name} must not be negative", None))
    static = static_findings(rows.sparkSession, items)
    if total_rows is None:
        return static
    counted = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != total_rows)
    return static.unionByName(counted.select(finding("warning", "METADATA_MISMATCH", F.concat(
        F.lit(f"Metadata totalRows ({total_rows}) doesn't match actual rows ("), F.col("n").cast("string"),
        F.lit(")"))).alias("f")).select("f.*"))


def structure_checks(rows: DataFrame, json_col: str, row_col: str, headers: Sequence[str] | None = None) -> DataFrame:
    """V1: per row EMPTY_ROW, MISSING_FIELDS, EXTRA_FIELDS against ``headers``; plus header checks."""
    spark = rows.sparkSession
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    row = F.col(row_col)
    items = [F.when(F.size(keys) == 0, finding("warning", "EMPTY_ROW", F.concat(F.lit("Row "), row.cast("string"),
                                                                               F.lit(" is empty")), None, row))]
    if headers is not None:
        h = F.array(*[F.lit(x) for x in headers])
        missing, extra = F.array_except(h, keys), F.array_except(keys, h)
        items.append(F.when(F.size(missing) > 0, finding(
            "warning", "MISSING_FIELDS", F.concat(F.lit("Row "), row.cast("string"), F.lit(" missing fields: "),
                                                  F.array_join(missing, ", ")), None, row)))
        items.append(F.when(F.size(extra) > 0, finding(
            "warning", "EXTRA_FIELDS", F.concat(F.lit("Row "), row.cast("string"), F.lit(" has extra fields: "),
                                                F.array_join(extra, ", ")), None, row)))
    per_row = rows.select(F.explode(F.array_compact(F.array(*items))).alias("f")).select("f.*")
    if headers is None:
        return per_row
    return static_findings(spark, _header_findings(spark, headers)).unionByName(per_row)


# ---------------------------------------------------------------------------------------
# V3-V7 format checks on a DataFrame about to be written
# ---------------------------------------------------------------------------------------

def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _any_string(df: DataFrame, pred) -> Column:
    cols = _string_cols(df)
    if not cols:
        return F.lit(False)
    return F.max(F.greatest(*[F.coalesce(pred(F.col(f"`{c}`")), F.lit(False)) for c in cols]) if len(cols) > 1
                 else F.coalesce(pred(F.col(f"`{cols[0]}`")), F.lit(False)))


def _nested_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]


def csv_checks(df: DataFrame) -> DataFrame:
    """V3: empty data, header problems, quotes or newlines inside values."""
    spark = df.sparkSession
    static = static_findings(spark, _header_findings(spark, df.columns, "_CSV"))
    agg = df.agg((F.count(F.lit(1)) == 0).alias("empty"),
                 _any_string(df, lambda c: c.rlike('[\\n\\r"]')).alias("special"))
    dyn = flags_to_findings(agg, [
        ("empty", "warning", "EMPTY_CSV_DATA", "CSV data contains no rows", "rows"),
        ("special", "warning", "PROBLEMATIC_CSV_CHARACTERS",
         "Data contains quotes or newlines that will be escaped in CSV", "rows")])
    return static.unionByName(dyn)


def csv_row_checks(rows: DataFrame, json_col: str, order_by, headers: Sequence[str] | None = None) -> DataFrame:
    """V3 on JSON row documents: rows whose fields differ from the first row's (under ``order_by``),
    and a first row that has not as many fields as there are headers.

    With headers the numbers of fields are compared, without them their names; every row counts once
    and a null row has no fields. Rows are counted by their fields map-side; no rows, no findings.
    """
    fields = F.array_sort(F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>")))
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_columns(order_by))])
    shapes = rows.groupBy(fields.alias("fields")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    first = shapes.agg(F.min_by("fields", "o")).scalar()
    other = F.size("fields") != F.size(first) if headers is not None else F.col("fields") != first
    agg = shapes.agg(F.sum(F.when(other, F.col("n")).otherwise(0)).alias("bad"), F.size(F.min_by("fields", "o")).alias("k"))
    items = [F.when(F.col("bad") > 0, finding("warning", "INCONSISTENT_CSV_STRUCTURE", F.concat(
        F.col("bad").cast("string"), F.lit(" rows have inconsistent field structure")), "rows"))]
    if headers is not None:
        items.append(F.when(F.col("k") != len(headers), finding("warning", "HEADER_ROW_MISMATCH", F.concat(
            F.lit(f"Header count ({len(headers)}) doesn't match row field count ("), F.col("k").cast("string"),
            F.lit(")")), "headers")))
    return agg.select(F.explode(F.array_compact(F.array(*items))).alias("f")).select("f.*")


def json_depth(json_text: Column) -> Column:
    """Nesting depth of a JSON document as the tool counts it (a flat object is 1)."""
    # strings go first (possessive: no recursion per character), then every scalar, so that only
    # brackets and one mark per innermost value are left to fold over
    s = F.regexp_replace(json_text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "0")
    s = F.regexp_replace(s, r"\{\s*+\}|\[\s*+\]", "0")
    s = F.regexp_replace(s, r"[^\[\]{}]++", "0")
    s = F.regexp_replace(s, r"0(?=[^\]}])|(?<=[\]}])0", "")
    tokens = F.regexp_extract_all(s, F.lit(r"[\[{]++|[\]}]++|0"), 0)
    state = F.aggregate(tokens, F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best")),
                        lambda acc, t: F.when(t.startswith("[") | t.startswith("{"),
                                              F.struct((acc["cur"] + F.length(t)).alias("cur"), acc["best"].alias("best")))
                        .when(t == "0", F.struct(acc["cur"].alias("cur"),
                                                 F.greatest(acc["best"], acc["cur"]).alias("best")))
                        .otherwise(F.struct((acc["cur"] - F.length(t)).alias("cur"), acc["best"].alias("best"))))
    return state["best"]


def json_checks(df: DataFrame, json_col: str) -> DataFrame:
    """V4 + A8: empty data, invalid documents, depth over 10, total size over 100 MB."""
    c = F.col(json_col)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNotNull() & F.try_parse_json(c).isNull()).alias("bad"),
                 F.max(json_depth(c)).alias("depth"), F.sum(F.octet_length(c)).alias("bytes"))
    mb = F.col("bytes") / (1024 * 1024)
    arr = F.array_compact(F.array(
        F.when(F.col("n") == 0, finding("warning", "EMPTY_JSON_DATA", "JSON data contains no rows", "rows")),
        F.when(F.col("bad") > 0, finding("error", "INVALID_JSON", F.concat(
            F.col("bad").cast("string"), F.lit(" values are not valid JSON")), json_col)),
        F.when(F.col("depth") > JSON_MAX_DEPTH, finding("warning", "DEEP_NESTED_OBJECTS", F.concat(
            F.lit("Data contains deeply nested objects (depth: "), F.col("depth").cast("string"),
            F.lit("), which may cause performance issues")), "rows")),
        F.when(mb > JSON_MAX_MB, finding("warning", "LARGE_JSON_SIZE", F.concat(
            F.lit("JSON data is very large ("), F.format_number(mb, 2), F.lit(" MB), which may cause memory issues")),
            "rows"))))
    return agg.select(F.explode(arr).alias("f")).select("f.*")


def json_depth_profile(df: DataFrame, json_col: str) -> DataFrame:
    """Max depth and total payload bytes, with the tool's warning flags."""
    c = F.col(json_col)
    return df.agg(F.max(json_depth(c)).alias("max_depth"), F.sum(F.octet_length(c)).alias("total_bytes")).select(
        "max_depth", "total_bytes", (F.col("max_depth") > JSON_MAX_DEPTH).alias("deep_warning"),
        (F.col("total_bytes") / (1024 * 1024) > JSON_MAX_MB).alias("size_warning"))


def xml_checks(df: DataFrame) -> DataFrame:
    """V5: empty data, invalid or reserved element names, nested values, control characters."""
    spark = df.sparkSession
    items = []
    bad = [c for c in df.columns if not re.match(XML_NAME_RE, c)]
    if bad:
        items.append(("warning", "INVALID_XML_FIELD_NAMES",
                      f"Field names will be sanitized for XML: {', '.join(bad)}", "headers"))
    reserved = [c for c in df.columns if c.lower().startswith("xml")]
    if reserved:
        items.append(("warning", "RESERVED_XML_NAMES",
                      f"Field names starting with 'xml' are reserved: {', '.join(reserved)}", "headers"))
    if _nested_cols(df):
        items.append(("warning", "COMPLEX_XML_STRUCTURES",
                      "Data contains nested objects or arrays that will be converted to XML elements", "rows"))
    agg = df.agg((F.count(F.lit(1)) == 0).alias("empty"), _any_string(df, lambda c: c.rlike(XML_CONTROL_RE)).alias("ctl"))
    dyn = flags_to_findings(agg, [
        ("empty", "warning", "EMPTY_XML_DATA", "XML data contains no rows", "rows"),
        ("ctl", "warning", "XML_CONTROL_CHARACTERS", "Data contains control characters invalid in XML", "rows")])
    return static_findings(spark, items).unionByName(dyn)


def xml_text_checks(texts: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """V5 for a column of XML texts: the first place where each stops being well-formed, as a finding whose ``row`` is
    the line; null texts have none. One run of parser events a text, in tasks."""
    place = pa.struct([("wrong", pa.string()), ("line", pa.int64()), ("place", pa.int64())])

    @F.arrow_udf("struct<wrong:string,line:bigint,place:bigint>")
    def broken(column: pa.Array) -> pa.Array:
        found = (broken_place(t) for t in column.to_pylist())
        return pa.array([None if b is None else dict(zip(("wrong", "line", "place"), b)) for b in found], place)

    ship_package(texts.sparkSession)
    b = texts.select(F.col(key_col).cast("string").alias("key"), broken(F.col(text_col).cast("string")).alias("b")).where(
        "b is not null")
    return b.select(finding("error", "INVALID_XML", F.concat(
        F.lit("XML is not well-formed: "), "b.wrong", F.lit(" at line "), F.col("b.line").cast("string"), F.lit(", column "),
        F.col("b.place").cast("string")), F.col("key"), F.col("b.line")).alias("f")).select("f.*")


def markdown_checks(df: DataFrame) -> DataFrame:
    """V6: one aggregate of flags (empty, complex, long text, newlines, special characters, wide)."""
    spark = df.sparkSession
    items = []
    if len(df.columns) > MD_MAX_COLUMNS:
        items.append(("warning", "WIDE_MARKDOWN_TABLE",
                      f"Table has many columns ({len(df.columns)}) which may not display well in Markdown", "headers"))
    nested = bool(_nested_cols(df))
    special = "[" + re.escape("".join(MD_SPECIAL_CHARS)) + "]"
    agg = df.agg((F.count(F.lit(1)) == 0).alias("empty"), F.lit(nested).alias("complex"),
                 _any_string(df, lambda c: F.length(c) > MD_LONG_TEXT).alias("long"),
                 _any_string(df, lambda c: c.rlike("[\\n\\r]")).alias("newlines"),
                 _any_string(df, lambda c: c.rlike(special)).alias("special"))
    dyn = flags_to_findings(agg, [
        ("empty", "warning", "EMPTY_MARKDOWN_DATA", "Markdown data contains no rows", "rows"),
        ("complex", "warning", "COMPLEX_MARKDOWN_DATA",
         "Data contains complex objects that will be converted to strings in Markdown", "rows"),
        ("long", "warning", "LONG_TEXT_IN_MARKDOWN",
         "Data contains long text that may not display well in Markdown tables", "rows"),
        ("newlines", "warning", "NEWLINES_IN_MARKDOWN",
         "Data contains newlines that will be converted to spaces in Markdown tables", "rows"),
        ("special", "warning", "MARKDOWN_SPECIAL_CHARACTERS",
         "Data contains Markdown special characters that will be escaped", "rows")])
    return static_findings(spark, items).unionByName(dyn)


def xlsx_checks(df: DataFrame, sheet_name: str = "Sheet1") -> DataFrame:
    """V7: row and column limits, sheet-name characters and length, nested values."""
    spark = df.sparkSession
    items = []
    if len(df.columns) > XLSX_MAX_COLUMNS:
        items.append(("error", "EXCEL_COLUMN_LIMIT_EXCEEDED",
                      f"Data has {len(df.columns)} columns, exceeding Excel's limit of {XLSX_MAX_COLUMNS}", "headers"))
    if re.search(SHEET_NAME_BAD_RE, sheet_name):
        items.append(("warning", "INVALID_SHEET_NAME_CHARS", "Sheet name contains invalid characters", "sheetName"))
    if len(sheet_name) > 31:
        items.append(("warning", "SHEET_NAME_TOO_LONG", "Sheet name is longer than 31 characters", "sheetName"))
    if _nested_cols(df):
        items.append(("warning", "COMPLEX_DATA_TYPES",
                      "Data contains complex objects that will be converted to JSON strings", "rows"))
    n = F.count(F.lit(1))
    agg = df.agg((n == 0).alias("empty"), (n > XLSX_MAX_ROWS).alias("rows_over"), n.alias("n"))
    dyn = agg.select(F.explode(F.array_compact(F.array(
        F.when(F.col("empty"), finding("warning", "EMPTY_EXCEL_DATA", "Excel data contains no rows", "rows")),
        F.when(F.col("rows_over"), finding("error", "EXCEL_ROW_LIMIT_EXCEEDED", F.concat(
            F.lit("Data has "), F.col("n").cast("string"), F.lit(f" rows, exceeding Excel's limit of {XLSX_MAX_ROWS}")),
            "rows"))))).alias("f")).select("f.*")
    return static_findings(spark, items).unionByName(dyn)


# ---------------------------------------------------------------------------------------
# V8/V9 file and content checks over a file listing
# ---------------------------------------------------------------------------------------

def file_checks(files: DataFrame, fmt: str, strict_extension: bool = False,
                max_mb: float | None = None) -> DataFrame:
    """V8: too large for the format, empty, extension not matching (error when strict)."""
    limit = max_mb if max_mb is not None else MAX_FILE_MB.get(fmt, DEFAULT_MAX_FILE_MB)
    exts = EXPECTED_EXTENSIONS.get(fmt, [])
    mb = F.col("length") / (1024 * 1024)
    ext = F.col("extension")
    ext_msg = F.concat(F.lit("File extension '"), ext, F.lit(f"' does not match expected format '{fmt}'. Expected: "
                                                             f"{', '.join(exts)}"))
    arr = F.array_compact(F.array(
        F.when(mb > limit, finding("error", "FILE_TOO_LARGE", F.concat(
            F.lit("File size ("), F.format_number(mb, 2), F.lit(f"MB) exceeds maximum allowed size ({limit}MB)")),
            F.col("path"))),
        F.when(F.col("length") == 0, finding("warning", "EMPTY_FILE", "File is empty", F.col("path"))),
        F.when(~ext.isin(*exts), finding("error" if strict_extension else "warning",
                                         "INVALID_EXTENSION" if strict_extension else "EXTENSION_MISMATCH",
                                         ext_msg, F.col("path")))))
    return files.select(F.explode(arr).alias("f")).select("f.*")


def path_checks(spark: SparkSession, asked: DataFrame, root: str, fmt: str, strict_extension: bool = False,
                max_mb: float | None = None) -> DataFrame:
    """V8 for paths that are asked for (column ``path``, without scheme or as Spark names them) below ``root``: missing
    ones, folders, and what ``file_checks`` finds about the files.

    One listing of ``root``, which Spark makes, meets the table of paths; a path that is no file but lies above one is
    a folder. A missing ``root`` makes every path missing.
    """
    plain = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), "/+$", "")
    paths = asked.select(F.col("path").alias("asked"), plain.alias("_p")).distinct()
    files = every_file(spark, root).select("path", "length", "extension", plain.alias("_p"))
    # every folder that a file lies in, at any depth
    parts = F.split("_p", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))),
                        lambda n: F.array_join(F.slice(F.split(F.col("_p"), "/"), 1, n), "/"))
    folders = files.select(F.explode(above).alias("_p")).distinct().withColumn("_d", F.lit(True))
    met = paths.join(files, "_p", "left").join(folders, "_p", "left")
    missing = F.when(F.col("length").isNotNull(), F.lit(None)).when(F.col("_d"), finding(
        "error", "NOT_A_FILE", F.concat(F.lit("Path is not a file: "), "asked"), F.col("asked"))).otherwise(finding(
            "error", "FILE_NOT_FOUND", F.concat(F.lit("File does not exist: "), "asked"), F.col("asked")))
    found = met.select(F.col("asked").alias("path"), "length", "extension", missing.alias("f"))
    return found.where("f is not null").select("f.*").unionByName(
        file_checks(found.where("length is not null"), fmt, strict_extension, max_mb))


def content_checks(heads: DataFrame, fmt: str, text_col: str = "head", key_col: str = "path",
                   sample_chars: int | None = None) -> DataFrame:
    """V9: JSON parses; XML starts with '<', has elements, balanced tags; CSV field counts of
    the first 10 lines; Markdown patterns. Rules look at the whole of ``text_col``; with
    ``sample_chars`` (the source tool: 2,048) at that many first characters, except JSON, which is
    parsed whole since a cut sample is nearly always invalid."""
    from .detect import markdown_hits
    full = F.coalesce(F.col(text_col), F.lit(""))
    t = F.substring(full, 1, sample_chars) if sample_chars else full
    key = F.col(key_col)
    if fmt == "json":
        t = full
        arr = F.array(F.when(F.try_parse_json(t).isNull(), finding("error", "INVALID_JSON", "Invalid JSON content", key)))
    elif fmt == "xml":
        opens = F.size(F.regexp_extract_all(t, F.lit(r"<[^/][^>]*[^/]>"), 0))
        closes = F.size(F.regexp_extract_all(t, F.lit(r"</[^>]+>"), 0))
        selfc = F.size(F.regexp_extract_all(t, F.lit(r"<[^>]*/>"), 0))
        arr = F.array(
            F.when(~F.regexp_replace(t, r"^\s+", "").startswith("<"),
                   finding("error", "INVALID_XML_START", "XML content must start with <", key)),
            F.when(~t.rlike("<[^>]+>"), finding("error", "NO_XML_ELEMENTS", "No XML elements found in content", key)),
            F.when(opens != closes + selfc, finding("warning", "UNBALANCED_XML_TAGS",
                                                    "XML tags may be unbalanced (this is a basic check)", key)))
    elif fmt == "csv":
        lines = F.filter(F.split(t, "\n"), lambda ln: F.length(js_trim(ln)) > 0)
        first = F.size(F.split(F.try_element_at(lines, F.lit(1)), ",", -1))
        head10 = F.slice(lines, 2, 9)
        bad = F.size(F.filter(head10, lambda ln: F.size(F.split(ln, ",", -1)) != first))
        arr = F.array(
            F.when(F.size(lines) == 0, finding("error", "EMPTY_CSV", "CSV file appears to be empty", key)),
            F.when((F.size(lines) > 0) & (bad > 0), finding("warning", "INCONSISTENT_CSV_FIELDS", F.concat(
                bad.cast("string"), F.lit(" lines have different field counts than the first line")), key)))
    elif fmt == "md":
        arr = F.array(
            F.when(F.trim(t) == "", finding("warning", "EMPTY_MARKDOWN", "Markdown file appears to be empty", key)),
            F.when((F.trim(t) != "") & (markdown_hits(t) == 0),
                   finding("warning", "NO_MARKDOWN_PATTERNS", "No Markdown patterns found in content", key)))
    else:
        arr = F.array(finding("warning", "BINARY_FORMAT", "Excel files are binary format, content validation skipped",
                              key))
    return heads.select(F.explode(F.array_compact(arr)).alias("f")).select("f.*")


def findings_report(*findings: DataFrame) -> DataFrame:
    """Combine findings and count them per severity and code."""
    allf = reduce(lambda a, b: a.unionByName(b), findings)
    return allf.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("count"))


def combine_findings(*findings: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings)
