"""Whole-table profiles (A4, A5, A9): table summary, JSON schema profile of a JSON text
column and XML element profile of an XML text column. Each is one aggregation (with
map-side combine) whose output is bounded by the number of distinct keys or elements.
"""

from __future__ import annotations

from typing import Iterator
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import sort_columns
from ..sources.json import variant_json_type

REQUIRED_SHARE = 0.8


def table_summary(df: DataFrame, fmt: str | None = None, encoding: str = "utf-8", has_headers: bool = True) -> DataFrame:
    """A4: row count, column count, column names, headers flag, format and encoding (one row).
    The first rows are ``df.limit(n)``: a sample operator, bounded by n."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("column_names"), F.lit(has_headers).alias("has_headers"),
        F.lit(fmt).cast("string").alias("format"), F.lit(encoding).alias("encoding"))


def table_sample(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """A4: the first ``n`` rows (under ``order_by`` when given; a top-n, bounded by n)."""
    if order_by is None:
        return df.limit(n)
    from ..functions.ordinal import sort_columns as _keys
    return df.orderBy(*_keys(order_by)).limit(n)


def json_schema_profile(df: DataFrame, json_col: str, order_by) -> DataFrame:
    """A5: per key of a JSON-object column, the JSON type of the first value seen (under
    ``order_by``) and whether the key is present in more than 80 % of the rows."""
    keys = sort_columns(order_by)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    entries = df.select(F.struct(*keys).alias("_o"), F.posexplode(
        F.from_json(F.col(json_col), "map<string,variant>")).alias("_p", "key", "value"))
    per_key = entries.groupBy("key").agg(
        F.min_by(variant_json_type(F.col("value")), F.struct("_o", "_p")).alias("type"),
        F.count(F.lit(1)).alias("present"))
    n = total.scalar()  # scalar subquery: one aggregate value, no join
    return per_key.select("key", "type", "present", n.alias("total_rows"),
                          (F.col("present") / n > REQUIRED_SHARE).alias("required"))


def _xml_elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document: one row per (element, attribute / child / text / repeated) fact."""
    for pdf in batches:
        out = {"element": [], "kind": [], "name": []}

        def add(e, k, n):
            out["element"].append(e)
            out["kind"].append(k)
            out["name"].append(n)

        for text in pdf["xml"]:
            if not text:
                continue
            try:
                root = ET.fromstring(text)
            except ET.ParseError:
                add(None, "parse_error", None)
                continue
            add(root.tag, "root", None)
            stack = [root]
            while stack:
                el = stack.pop()
                add(el.tag, "seen", None)
                for a in el.attrib:
                    add(el.tag, "attribute", a)
                kids = list(el)
                if (el.text or "").strip() or not kids:
                    add(el.tag, "text", None)
                counts: dict[str, int] = {}
                for k in kids:
                    counts[k.tag] = counts.get(k.tag, 0) + 1
                    stack.append(k)
                for tag, n in counts.items():
                    add(el.tag, "child", tag)
                    if n > 1:
                        add(tag, "repeated", None)
        yield pd.DataFrame(out)


def xml_schema_profile(df: DataFrame, xml_col: str) -> DataFrame:
    """Per element name: text or element, attributes, children, repeated?

    Each document is parsed in its task (Arrow batches of rows); the facts are then
    aggregated by element with map-side combine."""
    facts = df.select(F.col(xml_col).alias("xml")).mapInPandas(
        _xml_elements, "element string, kind string, name string")
    return facts.where(F.col("element").isNotNull()).groupBy("element").agg(
        F.when(F.max((F.col("kind") == "text").cast("int")) == 1, F.lit("text-element"))
        .otherwise(F.lit("element")).alias("type"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "attribute", F.col("name")))).alias("attributes"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "child", F.col("name")))).alias("children"),
        (F.max((F.col("kind") == "repeated").cast("int")) == 1).alias("is_array"),
        F.count_if(F.col("kind") == "root").alias("root_count"))
