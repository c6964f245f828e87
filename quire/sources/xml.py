"""XML scan (S8-S10) and sink (K5-K7) on Spark's native XML source.

The row element is the repeated child of each document's root; the scan itself is
Spark's splittable ``rowTag`` reader. Attributes arrive with an ``@`` prefix and the text
of an element with attributes as ``_VALUE``; ``normalise_xml`` renames them to the tool's
plain keys and ``text`` (D24, S10). Writing, columns named ``@x`` become attributes.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions.jscompat import iso_instant
from ..functions.nested import map_leaves
from ..session import ship_package
from .xml_text import entries

# Attributes use "@" (not Spark's default "_"): sanitised element names may start with "_"
# and must stay elements, and "@" can never occur in a sanitised name.
ATTR_PREFIX = "@"
VALUE_TAG = "_VALUE"


def _tags(content: bytes | None) -> tuple[str | None, str | None]:
    """(root, row element) of one document: of the root's children the first whose name repeats,
    else the first child, else the root. Broken documents count as far as they parse."""
    from xml.parsers import expat
    depth, root, children, repeated = 0, None, {}, None

    def start(name, _):
        nonlocal depth, root, repeated
        if depth == 0:
            root = name
        elif depth == 1:
            children[name] = children.get(name, 0) + 1
            if children[name] == 2 and repeated is None:
                repeated = name
        depth += 1

    def end(_):
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(content or b"", True)
    except expat.ExpatError:
        pass
    return root, repeated or next(iter(children), root)


def detect_row_tags(spark: SparkSession, path) -> DataFrame:
    """(path, root_tag, row_tag) per file, by depth over the whole document (one task per file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option(
        "recursiveFileLookup", "true").load(path).select("path", "content")

    @F.pandas_udf("struct<root_tag: string, row_tag: string>")
    def tags(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tags(c) for c in content], columns=["root_tag", "row_tag"], dtype=object)

    return files.select("path", tags("content").alias("t")).select("path", "t.*")


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None, infer_schema: bool = False,
             schema: T.StructType | None = None, normalise: bool = True, encoding: str | None = None) -> DataFrame:
    """One row per ``row_tag`` element; columns are the sorted union of child names.

    Text is kept as text unless ``infer_schema`` (the tool keeps element text). With
    ``row_tag=None`` the tag is sniffed per file; files with different tags are read
    separately and unioned by name (at most a handful of distinct tags reach the driver).
    """
    if row_tag is None:
        tags = detect_row_tags(spark, path)
        found = sorted(r[0] for r in tags.select("row_tag").distinct().collect() if r[0])
        if not found:
            return spark.createDataFrame([], T.StructType([]))
        if len(found) == 1:
            return read_xml(spark, path, found[0], infer_schema, schema, normalise, encoding)
        frames = [read_xml(spark, [r[0] for r in tags.where(F.col("row_tag") == t).select("path").collect()], t,
                           infer_schema, schema, normalise, encoding) for t in found]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
    reader = (spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", infer_schema)
              .option("attributePrefix", ATTR_PREFIX).option("valueTag", VALUE_TAG).option("ignoreSurroundingSpaces", True))
    if encoding:
        reader = reader.option("charset", encoding)
    if schema is not None:
        reader = reader.schema(schema)
    paths = path if isinstance(path, (list, tuple)) else [path]
    df = reader.load(paths if len(paths) > 1 else paths[0])
    return normalise_xml(df) if normalise else df


def _plain(name: str, siblings: set[str]) -> str:
    if name == VALUE_TAG:
        return "text"
    if name.startswith(ATTR_PREFIX) and len(name) > 1:
        bare = name[len(ATTR_PREFIX):]
        return name if bare in siblings else bare  # on a clash keep the prefix
    return name


def _normal_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        names = {f.name for f in dt.fields}
        return T.StructType([T.StructField(_plain(f.name, names), _normal_type(f.dataType), f.nullable)
                             for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_normal_type(dt.elementType), dt.containsNull)
    return dt


def normalise_xml(df: DataFrame) -> DataFrame:
    """Strip the attribute prefix and call element text ``text``, through nested
    structs and arrays of structs, with one positional cast (metadata only)."""
    top = set(df.columns)
    out = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        nt = _normal_type(f.dataType)
        if nt != f.dataType:
            c = c.cast(nt)
        out.append(c.alias(_plain(f.name, top)))
    return df.select(*out)


def xml_entries(df: DataFrame, xml_col: str, keep=()) -> DataFrame:
    """The children of one XML element (a text column) -> (key, value, type) rows.

    Types follow the tool: null, array (repeated child), text (text with attributes),
    object (element with children) and string. The value of an element with children is its
    inner XML, else its text. Texts are read by parser events, batch by batch, in time that is
    linear in their length; one that breaks off has the children that end before.
    """
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string()), ("type", pa.string())]))

    @F.arrow_udf("array<struct<key:string,value:string,type:string>>")
    def children(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("key", "value", "type"), e)) for e in entries(t)] for t in texts.to_pylist()], kind)

    ship_package(df.sparkSession)
    ex = df.select(*keep, F.posexplode(children(F.col(xml_col).cast("string"))).alias("pos", "c"))
    return ex.select(*keep, "pos", "c.key", "c.value", "c.type")


# ---------------------------------------------------------------------------------------
# Sink
# ---------------------------------------------------------------------------------------

def xml_name(name: str) -> str:
    """K6 for one field; attribute (``@x``) and element-text (``_VALUE``) fields keep their role."""
    if name == VALUE_TAG:
        return name
    if name.startswith(ATTR_PREFIX) and len(name) > 1:
        return ATTR_PREFIX + N.sanitize_xml_name(name[len(ATTR_PREFIX):])
    return N.sanitize_xml_name(name)


def _sanitised_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(xml_name(f.name), _sanitised_type(f.dataType), f.nullable)
                             for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_sanitised_type(dt.elementType), dt.containsNull)
    return dt


def xml_ready(df: DataFrame) -> DataFrame:
    """K6 + K7: XML-safe element names (recursively) and text values (null -> '')."""
    out = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        nt = _sanitised_type(f.dataType)
        if isinstance(f.dataType, T.MapType) or isinstance(f.dataType, T.VariantType):
            c = F.to_json(c)
        elif nt != f.dataType:
            c = c.cast(nt)
        c = map_leaves(c, nt, (T.TimestampType, T.TimestampNTZType), lambda v, _: iso_instant(v))
        out.append(c.alias(xml_name(f.name)))
    return df.select(*out)


def write_xml(df: DataFrame, path: str, root_tag: str = "data", row_tag: str = "item", overwrite: bool = True,
              single_file: bool = False) -> None:
    """K5: one ``row_tag`` element per row inside ``root_tag``; every part file is a document."""
    out = xml_ready(df)
    if single_file:
        out = out.coalesce(1)
    (out.write.mode("overwrite" if overwrite else "errorifexists").format("xml")
     .option("rootTag", root_tag).option("rowTag", row_tag).option("nullValue", "")
     .option("attributePrefix", ATTR_PREFIX).option("valueTag", VALUE_TAG)
     .option("declaration", 'version="1.0" encoding="UTF-8"').save(path))
