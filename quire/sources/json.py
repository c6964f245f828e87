"""JSON scans (S4-S7) and sinks (K2-K4).

Arrays of objects and JSON lines map onto Spark's JSON reader (sorted union of keys, as the
tool does). Arrays of mixed values, single objects and scalars go through the VARIANT
type, which keeps per-value types without a schema; ``layout`` is chosen by the caller,
never guessed from the data (D22).
"""

from __future__ import annotations

from functools import partial
from typing import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jscompat import iso_instant
from ..functions.nested import map_leaves
from ..functions.ordinal import sort_columns
from ..session import written
from . import json_ranges
from .files import write_documents
from .ranges import portions

LAYOUTS = ("rows", "indexed", "entries", "scalar")
WRITE_LAYOUTS = ("lines", "array", "object", "keyValue")


def variant_js_type(v: Column) -> Column:
    """The tool's type name of a VARIANT value: array / object (also null) / string / number / boolean."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull() | (s == "VOID"), F.lit("object"))
            .when(s.startswith("ARRAY"), F.lit("array"))
            .when(s.startswith("OBJECT"), F.lit("object"))
            .when(s == "STRING", F.lit("string"))
            .when(s == "BOOLEAN", F.lit("boolean"))
            .when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.lit("number"))
            .otherwise(F.lit("string")))


def variant_json_type(v: Column) -> Column:
    """JSON-schema type name: null / string / integer / number / boolean / array / object."""
    s = F.schema_of_variant(v)
    frac = F.try_variant_get(v, "$", "double") != F.floor(F.try_variant_get(v, "$", "double"))
    return (F.when(v.isNull() | (s == "VOID"), F.lit("null"))
            .when(s.startswith("ARRAY"), F.lit("array"))
            .when(s.startswith("OBJECT"), F.lit("object"))
            .when(s == "STRING", F.lit("string"))
            .when(s == "BOOLEAN", F.lit("boolean"))
            .when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT)"), F.lit("integer"))
            .when(s.rlike("^(FLOAT|DOUBLE|DECIMAL)"), F.when(frac, F.lit("number")).otherwise(F.lit("integer")))
            .otherwise(F.lit("string")))


def read_json(spark: SparkSession, path: str, layout: str = "rows", lines: bool = False,
              encoding: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """S4 (rows), S5 (indexed), S6 (entries), S7 (scalar).

    ``rows``: array-of-objects files (``lines=False``) or JSON lines; columns are the
    sorted union of keys, missing keys are null. Arrays are read by byte ranges (``json_ranges``), so a
    large file has many tasks; only UTF-8 is: with another ``encoding`` each file is one task. Files without an
    array give a row per value. Other layouts read each file as one VARIANT and explode it, one task per file.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    reader = spark.read.option("multiLine", not lines)
    if encoding:
        reader = reader.option("encoding", encoding)
    if layout == "rows":
        if schema is not None:
            reader = reader.schema(schema)
        if lines or encoding and encoding.lower().replace("-", "") != "utf8":
            return reader.json(path)
        profile = written(json_ranges.range_profile(spark, path), "json-ranges")
        found = json_ranges.elements(spark, path, profile)
        # Spark's JSON parser over a column of values: its reader takes a dataset of strings on the JVM side
        strings = spark._jvm.org.apache.spark.sql.Encoders.STRING()
        reader = reader.option("multiLine", False)
        return reader._df(reader._jreader.json(getattr(found._jdf, "as")(strings)))
    from .files import whole_texts
    doc = whole_texts(spark, path).withColumnRenamed("text", "doc")  # one row per file, key order kept
    if layout == "scalar":
        return json_scalar(doc, "doc", keep=["path"])
    if layout == "indexed":
        return json_indexed(doc, "doc", keep=["path"])
    return json_entries(doc, "doc", keep=["path"])


def _as_variant(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    return F.col(col) if isinstance(dt, T.VariantType) else F.try_parse_json(F.col(col))


def _as_text(df: DataFrame, col: str) -> Column:
    """JSON text of a column; VARIANT objects come back with sorted keys, text keeps its order."""
    dt = df.schema[col].dataType
    return F.to_json(F.col(col)) if isinstance(dt, T.VariantType) else F.col(col)


def json_indexed(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON array (text or VARIANT column) -> rows (index, value, type)."""
    arr = F.from_json(_as_text(df, col), "array<variant>")
    return df.select(*keep, F.posexplode(arr).alias("index", "value")).select(
        *keep, F.col("index").cast("long").alias("index"), "value", variant_js_type(F.col("value")).alias("type"))


def json_entries(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON object (text or VARIANT column) -> rows (key, value, type), in key order."""
    m = F.from_json(_as_text(df, col), "map<string,variant>")
    return df.select(*keep, F.posexplode(m).alias("pos", "key", "value")).select(
        *keep, "pos", "key", "value", variant_js_type(F.col("value")).alias("type"))


def json_scalar(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON scalar per row -> (value, type)."""
    v = _as_variant(df, col)
    return df.select(*keep, v.alias("value"), variant_js_type(v).alias("type"))


# ---------------------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------------------

def write_json(df: DataFrame, path: str, sort_keys: bool = False, overwrite: bool = True,
               layout: str = "lines", single_file: bool = False, indent: bool = False, order_by=None) -> None:
    """K2-K4: rows as JSON, nulls written explicitly; NaN and infinities as null.

    ``lines``: one object per line. ``array``: every part file is one JSON array. ``object``: every
    part file is one JSON object, first column to the rest, the last row of a key under ``order_by``
    wins; a key is in one file only. ``keyValue``: arrays of {key, value} from the first two columns.
    ``indent`` spreads each row over lines of two more spaces (not for ``lines``). A table
    without rows gives an empty array or object (``lines``: no line).
    """
    if layout not in WRITE_LAYOUTS:
        raise ValueError(f"unknown JSON layout {layout!r}; use one of {', '.join(WRITE_LAYOUTS)}")
    if indent and layout == "lines":
        raise ValueError("JSON lines cannot be indented")
    out = df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]) if sort_keys else df
    if layout == "object":
        out = to_object_layout(out, order_by)
    elif layout == "keyValue":
        out = to_keyvalue_layout(out)
    out = json_ready(out)
    if single_file:
        out = out.coalesce(1)
    if layout == "lines":
        out.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)
        return
    options = {"ignoreNullFields": "false", "pretty": str(indent).lower()}
    if layout == "object":
        # {"key": value} without its braces is a member of the document
        row = F.to_json(F.create_map(F.coalesce("key", F.lit("null")), F.col("value")), options)
        row, ends = F.regexp_replace(row, r"^\{\s*|\s*\}$", ""), ("{", "}")
    else:
        row, ends = F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), options), ("[", "]")
        row = F.replace(row, F.lit("\n"), F.lit("\n  ")) if indent else row
    rows = out.select(row.alias("value")).mapInArrow(partial(_document, ends), "value string")
    write_documents(rows, path, overwrite, ".json", "".join(ends))


def json_ready(df: DataFrame) -> DataFrame:
    """NaN and infinities, which have no JSON form, as null and instants as ISO text, at any depth."""
    def leaf(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(dt)).otherwise(c)
        return iso_instant(c)
    kinds = (T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType)
    return df.select(*[map_leaves(F.col(f"`{f.name}`"), f.dataType, kinds, leaf).alias(f.name) for f in df.schema.fields])


def _document(ends: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn a partition's JSON members into the lines of one document between ``ends``."""
    def lines(values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    pending = None
    for batch in batches:
        for values in portions(batch.column(0).cast(pa.string())):
            yield lines([ends[0]] if pending is None else ["  " + pending + ","])
            yield lines(pc.binary_join_element_wise("  ", values.slice(0, len(values) - 1), ",", ""))
            pending = values[len(values) - 1].as_py()
    if pending is not None:
        yield lines(["  " + pending, ends[1]])
    elif TaskContext.get().partitionId() == 0:
        # Spark writes a file for the first partition even if it has no rows
        yield lines(["".join(ends)])


def to_object_layout(df: DataFrame, order_by=None) -> DataFrame:
    """K3: first column is the key; two columns -> the second as value, more -> a struct of
    the rest. The last row per key wins under ``order_by``; ``max_by`` aggregates map-side,
    so a hot key costs one row per map task in the shuffle."""
    key, rest = df.columns[0], df.columns[1:]
    if not rest:
        raise ValueError("object layout needs at least two columns")
    value = F.col(f"`{rest[0]}`") if len(rest) == 1 else F.struct(*[F.col(f"`{c}`") for c in rest])
    if order_by is None:
        return df.groupBy(F.col(f"`{key}`").cast("string").alias("key")).agg(F.last(value).alias("value"))
    keys = sort_columns(order_by)
    return df.groupBy(F.col(f"`{key}`").cast("string").alias("key")).agg(
        F.max_by(value, F.struct(*keys)).alias("value"))


def to_keyvalue_layout(df: DataFrame) -> DataFrame:
    """K4: rows {key, value} from the first two columns."""
    if len(df.columns) < 2:
        raise ValueError("key/value layout needs two columns")
    a, b = df.columns[0], df.columns[1]
    return df.select(F.col(f"`{a}`").cast("string").alias("key"), F.col(f"`{b}`").alias("value"))
