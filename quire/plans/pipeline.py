"""File conversion end to end (C3), output paths and write modes (K13, K14), and the
row-wise conversion of a column of payload texts (C4).

``convert`` is read -> transform -> write as one Spark job per output: the row counts for
the change warnings are collected by Observations during the write, not by extra passes.
"""

from __future__ import annotations

import csv
import datetime as _dt
import io
import json
import os
import re
import sys
import time
from dataclasses import dataclass, field
from typing import Callable, Sequence
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions.jscompat import js_date_ms_py
from ..operators import detect as D
from ..operators import quality as Q
from ..sources import csv as CSV
from ..sources import json as JS
from ..sources import markdown as MD
from ..sources import xml as XML
from ..sources import xml_text as XT
from ..session import scratch_dir, ship_package
from ..sources.files import list_files
from .transformations import conventional_order, convert_data

# File extension written for each format.
FORMAT_EXTENSIONS = {"csv": "csv", "xlsx": "xlsx", "json": "json", "xml": "xml", "md": "md"}


def output_path(source: str, target_format: str, output_dir: str | None = None, preserve_name: bool = False,
                add_timestamp: bool = False, exists: Callable[[str], bool] | None = None,
                now: _dt.datetime | None = None) -> str:
    """``<name>_converted.<ext>`` next to the source (or in ``output_dir``), with an
    optional timestamp and ``_1``, ``_2``... on collisions when ``exists`` is given."""
    ext = FORMAT_EXTENSIONS.get(target_format, target_format)
    stem = os.path.splitext(os.path.basename(source.rstrip("/")))[0]
    name = stem if preserve_name else f"{stem}_converted"
    if add_timestamp:
        ts = (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y-%m-%dT%H-%M-%S-%f")[:-3] + "Z"
        name = f"{name}_{ts}"
    base = output_dir or os.path.dirname(source.rstrip("/"))
    out = os.path.join(base, f"{name}.{ext}")
    if exists is not None and exists(out):
        for counter in range(1, 1000):
            out = os.path.join(base, f"{name}_{counter}.{ext}")
            if not exists(out):
                return out
        raise RuntimeError("Too many file collisions, cannot generate unique name")
    return out


def output_path_col(source: Column, target_format: Column, output_dir: str | None = None,
                    preserve_name: bool = False) -> Column:
    """K14 as a column expression, for a table of conversion requests (no collisions check)."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]+)$", 1), r"\.[^.]*$", "")
    name = stem if preserve_name else F.concat(stem, F.lit("_converted"))
    ext = F.coalesce(F.create_map(*[x for k, v in FORMAT_EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])[
        target_format], target_format)
    base = F.lit(output_dir.rstrip("/")) if output_dir else F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    return F.concat(base, F.lit("/"), name, F.lit("."), ext)


def path_exists(spark: SparkSession) -> Callable[[str], bool]:
    """An ``exists`` check through the cluster's file system API (metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        return hp.getFileSystem(conf).exists(hp)
    return exists


def read_any(spark: SparkSession, path: str, fmt: str, options: dict | None = None) -> DataFrame:
    o = dict(options or {})
    if fmt == "csv":
        return CSV.read_csv(spark, path, sep=o.get("sep"), encoding=o.get("encoding", "utf-8"),
                            multiline=o.get("multiline", True))
    if fmt == "json":
        return JS.read_json(spark, path, layout=o.get("layout", "rows"), lines=o.get("lines", False))
    if fmt == "xml":
        return XML.read_xml(spark, path, row_tag=o.get("row_tag"))
    if fmt == "md":
        return MD.read_markdown_table(spark, path, all_tables=o.get("all_tables", False))
    if fmt == "xlsx":
        from ..sources import xlsx as XL
        return XL.read_xlsx(spark, path, sheet_name=o.get("sheet_name"), sheet_index=o.get("sheet_index"),
                            range_=o.get("range"))
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported format: {fmt}")


def write_any(df: DataFrame, path: str, fmt: str, overwrite: bool = True, options: dict | None = None) -> None:
    """Overwrite by default; ``overwrite=False`` refuses an existing target."""
    o = dict(options or {})
    if fmt == "csv":
        CSV.write_csv(df, path, overwrite=overwrite)
    elif fmt == "json":
        JS.write_json(df, path, overwrite=overwrite, layout=o.get("layout", "array"), sort_keys=o.get("sort_keys", False),
                      indent=o.get("indent", False), order_by=o.get("order_by"))
    elif fmt == "xml":
        XML.write_xml(df, path, root_tag=o.get("root_tag", "data"), row_tag=o.get("row_tag", "item"), overwrite=overwrite)
    elif fmt == "md":
        MD.write_markdown_table(df, path, alignment=o.get("alignment", "left"), title=o.get("title"),
                                overwrite=overwrite, extension=".md")
    elif fmt == "xlsx":
        from ..sources import xlsx as XL
        XL.write_xlsx(df, path, sheet_name=o.get("sheet_name", "Sheet1"), overwrite=overwrite)
    elif fmt == "parquet":
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def detect_formats(spark: SparkSession, path: str) -> list[tuple[str, object]]:
    """(format, what to read) of the files under ``path``, each file judged by its own whole content.

    One format: the folder itself is read. Several: the files of each (only then do paths reach
    the driver). A file without a recognisable format is an error that names it.
    """
    # count per detected format (at most six groups) and choose on the driver: a filter on the
    # derived format would be pushed below the projections and inline the whole rule tree
    found = D.detect_files(spark, path)
    counts = {r["format"]: r["example"] for r in found.groupBy("format").agg(F.min("path").alias("example")).collect()}
    if not counts or None in counts:
        raise ValueError(f"Failed to detect format for: {counts.get(None, path)}")
    if len(counts) == 1:
        return [(next(iter(counts)), path)]
    files = found.select("path", "format").collect()
    return [(f, sorted(r["path"] for r in files if r["format"] == f)) for f in sorted(counts)]


_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def read_detected(spark: SparkSession, parts: list[tuple[str, object]], options: dict | None = None) -> DataFrame:
    """The files of every format read by their reader and put together by column name; a column that
    the formats type differently becomes text."""
    frames = [read_any(spark, p, f, options) for f, ps in parts
              for p in (ps if isinstance(ps, list) and f in ("md", "xlsx") else [ps])]
    types: dict[str, set] = {}
    for fr in frames:
        for fld in fr.schema.fields:
            types.setdefault(fld.name, set()).add(fld.dataType.simpleString())
    mixed = {n for n, t in types.items() if len(t) > 1 and not t <= _NUMBERS}     # numbers widen in the union
    frames = [fr.select(*[_as_text(fr, f).alias(f.name) if f.name in mixed else fr[f"`{f.name}`"]
                          for f in fr.schema.fields]) for fr in frames]
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr, allowMissingColumns=True)
    return out


def _as_text(df: DataFrame, f: T.StructField) -> Column:
    c = df[f"`{f.name}`"]
    nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
    return F.to_json(c) if nested else c.cast("string")


@dataclass
class ConversionResult:
    input_path: str
    output_path: str
    input_format: str
    output_format: str
    rows_in: int
    rows_out: int
    duration_ms: float
    warnings: list = field(default_factory=list)
    findings: list = field(default_factory=list)


def convert(spark: SparkSession, input_path: str, output_format: str, output_path_: str | None = None,
            input_format: str | None = None, transformations: Sequence = (), overwrite: bool = True,
            read_options: dict | None = None, write_options: dict | None = None, validate: bool = True,
            fixed_order: bool = True, max_mb: float | None = None) -> ConversionResult:
    """Detect -> validate -> read -> transform -> write, with change warnings.

    Errors propagate (D32). Files over ``max_mb`` are refused. Without it, those over the usual limit of their
    format (V8) are found and converted: how large a table's part files are says how Spark wrote them, no more. ``fixed_order`` applies key style, column operations and
    filters in that order, as the command does (D20); set it False to keep the list order.
    """
    start = time.time()
    parts = [(input_format, input_path)] if input_format else detect_formats(spark, input_path)
    fmt_in = "+".join(f for f, _ in parts)
    findings = []
    if validate:
        errs = Q.file_checks(list_files(spark, input_path), parts[0][0] if len(parts) == 1 else None,
                             max_mb=max_mb).where("severity = 'error'").collect()
        findings = [r.asDict() for r in errs]
        fatal = [f for f in findings if max_mb is not None or f["code"] != "FILE_TOO_LARGE"]
        if fatal:
            raise ValueError(f"Input failed validation: {fatal[0]['message']}")
    df = read_any(spark, input_path, fmt_in, read_options) if len(parts) == 1 else read_detected(spark, parts, read_options)
    steps = conventional_order(transformations) if fixed_order else list(transformations)
    converted = convert_data(df, steps)
    target = output_path_ or output_path(input_path, output_format)
    write_any(converted.data, target, output_format, overwrite, write_options)
    warnings = converted.collect_warnings()
    rows_in = converted.observed_input.get.get("rows", 0)
    rows_out = converted.observed_output.get.get("rows", 0)
    return ConversionResult(input_path, target, fmt_in, output_format, rows_in, rows_out,
                            (time.time() - start) * 1000, warnings, findings)


# ---------------------------------------------------------------------------------------
# C4: a column of payload texts
# ---------------------------------------------------------------------------------------

def _restyle_type(dt: T.DataType, style: str) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(N.transform_key_simple(f.name, style), _restyle_type(f.dataType, style),
                                           f.nullable) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_restyle_type(dt.elementType, style), dt.containsNull)
    return dt


def payload_schema(df: DataFrame, col: str, from_format: str) -> T.DataType:
    """Merged schema of all JSON payloads (one aggregate; only the DDL text is collected),
    top-level fields in the key order of the first payload; or the schema of the first XML
    payload."""
    if from_format == "json":
        row = df.agg(F.schema_of_variant_agg(F.parse_json(F.col(col))).alias("s"),
                     F.first(F.json_object_keys(F.col(col)), ignorenulls=True).alias("k")).collect()[0]
        dt = _variant_ddl_to_type(row["s"])
        if isinstance(dt, T.StructType) and row["k"]:
            rank = {k: i for i, k in enumerate(row["k"])}
            dt = T.StructType(sorted(dt.fields, key=lambda f: rank.get(f.name, len(rank))))
        return dt
    if from_format == "xml":
        return _xml_payload_schema(df, col)
    raise ValueError(from_format)


def _xml_payload_schema(df: DataFrame, col: str) -> T.DataType:
    """Merged schema of all XML payloads: they are written to the shared scratch folder and inferred by
    the XML source, root element by root element (the distinct roots reach the driver). Children
    come in the order of their smallest place in any payload."""
    spark = df.sparkSession
    bare = F.regexp_replace(F.col(col), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*+>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"<([A-Za-z_][\w.:-]*+)"), 1)
    texts = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("t"), tags.alias("tags"))
    roots = sorted(r[0] for r in texts.select(F.try_element_at("tags", F.lit(1))).distinct().collect() if r[0])
    if not roots:
        return T.StructType([])
    path = scratch_dir(spark, "payloads")
    texts.select("t").write.text(path)
    fields: dict[str, T.DataType] = {}
    for root in roots:
        found = spark.read.format("xml").option("rowTag", root).option("inferSchema", True).load(path).schema
        for f in found.fields:
            known = fields.setdefault(f.name, f.dataType)
            if known != f.dataType:
                fields[f.name] = T.StringType()
    places = texts.select(F.posexplode("tags").alias("i", "n")).groupBy("n").agg(F.min("i").alias("i"))
    order = {r["n"]: r["i"] for r in places.where(F.col("n").isin(list(fields))).collect()}
    return T.StructType([T.StructField(n, fields[n]) for n in sorted(fields, key=lambda n: (order.get(n, 1 << 30), n))])


def _variant_ddl_to_type(ddl: str) -> T.DataType:
    s = ddl.replace("OBJECT<", "STRUCT<")
    return T._parse_datatype_string(s)


# What the reference's CSV parser types (papaparse: dynamicTyping), and the key of surplus cells.
CSV_NUMBER_RE = r"\s*-?(\d+\.?|\.\d+|\d+\.\d+)([eE][-+]?\d+)?\s*"
CSV_INSTANT_RE = r"\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d(:[0-5]\d(\.\d+)?)?([+-][0-2]\d:[0-5]\d|Z)"
SURPLUS_KEY = "__parsed_extra"


def _csv_cell(text: str, typed: bool):
    """A cell as its number, boolean, null (empty) or instant (ISO text in UTC) if ``typed``, else the text."""
    if not typed:
        return text
    if text == "":
        return None
    if text in ("true", "TRUE", "false", "FALSE"):
        return text in ("true", "TRUE")
    if re.fullmatch(CSV_NUMBER_RE, text, re.ASCII):
        v = float(text)
        if abs(v) < 1 << 53:
            return int(v) if v.is_integer() else v
        return text
    if re.fullmatch(CSV_INSTANT_RE, text, re.ASCII):
        ms = js_date_ms_py(re.sub(r"(\.\d{9})\d+", r"\1", text))
        return text if ms is None else (_dt.datetime(1970, 1, 1) + _dt.timedelta(milliseconds=ms)).isoformat(
            timespec="milliseconds") + "Z"
    return text


def _own_names(names: Sequence[str]) -> list[str]:
    """A repeated name gets ``_1``, ``_2``... so that no cell replaces another."""
    used, seen, out = set(names) | {SURPLUS_KEY}, set(), []
    for name in names:
        new, k = name, 0
        while new in seen or (k or name == SURPLUS_KEY) and new in used:
            k += 1
            new = f"{name}_{k}"
        seen.add(new)
        out.append(new)
    return out


def _cell_text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v)


def _convert_csv_text(text: str | None, to_format: str, key_style: str | None, typed: bool) -> str | None:
    """One header-row CSV text as JSON, CSV or XML text. Records are read with their quotes; empty lines are
    none; cells that a record lacks are left out, cells beyond the header go under ``__parsed_extra``."""
    if text is None:
        return None
    csv.field_size_limit(sys.maxsize)
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if r]
    names = _own_names(rows[0]) if rows else []
    if key_style and key_style != "unchanged":
        names = _own_names([N.transform_key_simple(n, key_style) for n in names])
    cells = [[_csv_cell(c, typed) for c in r] for r in rows[1:]]
    if to_format == "csv":
        out = io.StringIO()
        write = csv.writer(out, lineterminator="\n")
        write.writerow(names)
        write.writerows([_cell_text(v) for v in r] + [""] * (len(names) - len(r)) for r in cells)
        return out.getvalue().removesuffix("\n")
    recs = []
    for r in cells:
        rec = dict(zip(names, r))
        if len(r) > len(names):
            rec[SURPLUS_KEY] = r[len(names):]
        recs.append(rec)
    if to_format == "json":
        return json.dumps(recs, ensure_ascii=False, separators=(",", ":"))
    items = []
    for rec in recs:
        pairs = [(k, v) for k, vs in rec.items() for v in (vs if isinstance(vs, list) else [vs])]
        items.append("<item>" + "".join(f"<{N.sanitize_xml_name(k)}>{escape(_cell_text(v))}</{N.sanitize_xml_name(k)}>"
                                        for k, v in pairs) + "</item>")
    return f"<root>{''.join(items)}</root>"


# A JSON text as tokens: object keys (a string followed by a colon), other strings, and runs
# of everything else; joined back they give the text unchanged.
# Possessive throughout: Java's matcher must not recurse once per character.
JSON_TOKEN_RE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'


def restyle_json_text(text: Column, key_style: str | None) -> Column:
    """Restyle every object key of JSON texts, nested ones too, keeping key order and all
    values byte for byte (the inline converter's simple styles)."""
    if not key_style or key_style == "unchanged":
        return text
    tokens = F.regexp_extract_all(text, F.lit(JSON_TOKEN_RE), 0)

    def fix(tok):
        key = F.regexp_extract(tok, r'^"(.*)"\s*:$', 1)
        return F.when(tok.rlike(r'^".*"\s*:$'), F.concat(
            F.lit('"'), N.transform_key_simple_col(key, key_style), F.lit('":'))).otherwise(tok)
    return F.when(text.isNull(), text).otherwise(F.array_join(F.transform(tokens, fix), ""))


def _restyled(value, key_style: str | None):
    """A JSON value with the keys of all its objects restyled; of keys that meet the last stays."""
    if not key_style or key_style == "unchanged":
        return value
    if isinstance(value, list):
        return [_restyled(v, key_style) for v in value]
    if isinstance(value, dict):
        return {k if k in ("$", "_") else N.transform_key_simple(k, key_style): _restyled(v, key_style) for k, v in value.items()}
    return value


def _records(value) -> tuple[list[str], list[list]]:
    """(names, rows) of a JSON value as a table: objects of an array are records, under all their keys in the order in
    which they come; arrays of an array are rows; an object is one record, anything else a cell named ``value``."""
    rows = value if isinstance(value, list) else [value]
    if rows and all(isinstance(r, list) for r in rows):
        return [], rows
    rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return names, [[r.get(n) for n in names] for r in rows]


def _table_text(value) -> str:
    names, rows = _records(value)
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    write.writerows([*([names] if names else []), *([XT.written(v) for v in r] for r in rows)])
    return out.getvalue().removesuffix("\n")


def _convert_tree_text(text: str | None, from_format: str, to_format: str, key_style: str | None) -> str | None:
    """One JSON or XML text as CSV, XML or, document by document, JSON; null where it cannot be parsed."""
    if text is None:
        return None
    try:
        value = json.loads(text.removeprefix("\ufeff"), parse_constant=_no_constant) if from_format == "json" else XT.tree(text)
        value = _restyled(value, key_style)
        if to_format == "json":
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        if to_format == "csv":
            if from_format == "json":
                return _table_text(value)
            # the repeated children of the outer element are the records, else it is one itself
            (root,) = value.values()
            kinds = {k: v for k, v in root.items() if k not in ("$", "_")} if isinstance(root, dict) else {}
            many = [v for v in kinds.values() if len(v) > 1]
            return _table_text([XT.plain(v) for v in many[0]] if len(kinds) == 1 and many else XT.plain(root))
        if isinstance(value, dict) and len(value) == 1 and not isinstance(next(iter(value.values())), list):
            ((name, inner),) = value.items()
        else:
            name, inner = "root", {"item": value} if isinstance(value, list) else value if isinstance(value, dict) else {"_": value}
        return XT.element(name, inner, N.sanitize_xml_name)
    except (ValueError, RecursionError, ExpatError):
        return None


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def convert_text_column(df: DataFrame, col: str, from_format: str, to_format: str, key_style: str | None = None,
                        out_col: str = "converted", typed: bool = False, document: bool = False) -> DataFrame:
    """C4: convert every payload in ``col`` between JSON, XML and CSV text, restyling keys
    with the inline converter's simple styles; a payload that cannot be parsed gives null.

    JSON to JSON, and XML to JSON as records (root left out, values typed over all payloads), stay in the
    JVM; the rest is one function over Arrow batches, payload by payload, so names may differ in case alone and from
    payload to payload. ``document``: XML becomes JSON with its root, children as lists, attributes under
    ``$`` and text beside them under ``_``, as the tool's parser gives it. JSON arrays become CSV records; the one key of
    an object becomes the root of XML. ``typed``: CSV cells become numbers, booleans, nulls and instants.
    """
    if (from_format, to_format) not in [(a, b) for a in ("csv", "json", "xml") for b in ("csv", "json", "xml")]:
        raise ValueError(f"Unsupported target format: {to_format}" if from_format in ("csv", "json", "xml")
                         else f"Unsupported source format: {from_format}")
    if (from_format, to_format) == ("json", "json"):
        return df.withColumn(out_col, restyle_json_text(F.col(col), key_style))
    if (from_format, to_format, document) == ("xml", "json", False):
        dt = payload_schema(df, col, from_format)
        parsed = F.from_xml(F.col(col), dt)
        if key_style and key_style != "unchanged":
            parsed = parsed.cast(_restyle_type(dt, key_style))
        return df.withColumn(out_col, F.to_json(parsed))
    ship_package(df.sparkSession)

    @F.arrow_udf("string")
    def converted(texts: pa.Array) -> pa.Array:
        if from_format == "csv":
            return pa.array([_convert_csv_text(t, to_format, key_style, typed) for t in texts.to_pylist()], pa.string())
        return pa.array([_convert_tree_text(t, from_format, to_format, key_style) for t in texts.to_pylist()], pa.string())

    return df.withColumn(out_col, converted(F.col(col).cast("string")))
