"""Markdown scans (S13-S18), the Markdown sinks (K9-K12) and the structure profile (A10).

Tables are read by byte ranges (``markdown_ranges``), so a large file has many tasks. Lists, headings and
paragraphs take a whole document: one row per file (parallel across files), without a shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jscompat import js_string, js_trim
from ..functions.ordinal import with_ordinal
from ..functions.maps import map_last_wins
from ..session import written
from . import markdown_ranges
from .files import whole_texts, write_documents

# The patterns of the Markdown structures the tool recognises.
LIST_UNORDERED_RE = r"(?m)^[\s]*[-*+]\s+(.+)$"
LIST_ORDERED_RE = r"(?m)^[\s]*\d+\.\s+(.+)$"
HEADING_RE = r"(?m)^(#{1,6})\s+(.+)$"
INT_CELL_RE = r"^-?\d+$"
DECIMAL_CELL_RE = r"^-?\d*\.\d+$"

NO_PIPE_LINE_RE = r"(?md)^[^|\n]*$"   # (?d): only \n ends a line


def read_markdown_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per Markdown document (path, text)."""
    return whole_texts(spark, path, glob)


def _trim(c: Column) -> Column:
    return js_trim(c)


def strip_marks(c: Column) -> Column:
    """S14 first step: remove bold, italic, code and link marks."""
    c = F.regexp_replace(c, r"\*\*(.*?)\*\*", "$1")
    c = F.regexp_replace(c, r"\*(.*?)\*", "$1")
    c = F.regexp_replace(c, r"`(.*?)`", "$1")
    c = F.regexp_replace(c, r"\[(.*?)\]\(.*?\)", "$1")
    return _trim(c)


def cell_text(c: Column) -> Column:
    """Cleaned cell text; '' -> null."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(F.nullif(strip_marks(c), F.lit("")))


def _mask_escapes(line: Column) -> Column:
    """Hide escaped backslashes and pipes (D25) so that only real cell separators split."""
    return F.regexp_replace(F.regexp_replace(line, r"\\\\", "\u0001"), r"\\\|", "\u0002")


def _unmask(cell: Column) -> Column:
    return F.translate(cell, "\u0001\u0002", "\\|")


def _row_cells(line: Column) -> Column:
    return F.transform(F.split(_mask_escapes(line), r"\|", -1), lambda p: _trim(_unmask(p)))


def tables_of(text: Column) -> Column:
    """Array of the pipe tables of a document, each the array of its lines from the header on.

    Lines without a pipe separate runs of lines with one. A table starts at the first line of a
    run that has at least two pipes and is followed by a line that holds a hyphen.
    """
    runs = F.transform(F.split(text, NO_PIPE_LINE_RE, -1), lambda run: F.filter(
        F.transform(F.split(run, "\n"), _trim), lambda ln: ln.contains("|")))
    started = F.transform(runs, lambda lines: F.struct(lines.alias("lines"), F.array_position(
        F.transform(lines, lambda ln, i: F.coalesce(F.get(lines, i + 1).contains("-"), F.lit(False))
                    & (F.size(F.split(_mask_escapes(ln), r"\|", -1)) > 2)), True).cast("int").alias("start")))
    return F.transform(F.filter(started, lambda t: t["start"] > 0),
                       lambda t: F.slice(t["lines"], t["start"], F.size(t["lines"])))


def table_lines(docs: DataFrame, text_col: str = "text", key: str = "path") -> DataFrame:
    """Every line that belongs to a pipe table, with (table_index, row_index, headers, cells).

    ``row_index`` -1 is the header; the separator line under it is left out. All of it is work
    inside one row of ``docs``: nothing is shuffled.
    """
    tables = docs.select(F.col(key).alias(key), F.posexplode(tables_of(F.col(text_col))).alias("table_index", "lines"))
    # the header is found before the lines become rows: a row would carry all lines of its table for it
    headed = tables.select(key, "table_index", "lines", _header_cells(F.get("lines", F.lit(0))).alias("headers"))
    rows = headed.select(key, "table_index", "headers", F.posexplode("lines").alias("i", "line")).where("i <> 1")
    rows = rows.select(key, "table_index", "i", "headers", _row_cells(F.col("line")).alias("_q_parts"))
    return rows.select(
        key, "table_index", F.when(F.col("i") == 0, F.lit(-1)).otherwise(F.col("i") - 2).alias("row_index"), "headers",
        F.when(F.col("i") == 0, F.col("headers")).otherwise(_data_cells(F.col("_q_parts"))).alias("cells"))


def _header_cells(line: Column) -> Column:
    return F.filter(_row_cells(line), lambda p: F.length(p) > 0)


def _data_cells(parts: Column) -> Column:
    """The cells of a row without the empty ones outside its first and last pipe."""
    return F.filter(parts, lambda p, i: ~(((i == 0) & (p == "")) | ((i == F.size(parts) - 1) & (p == ""))))


def markdown_table_rows(docs: DataFrame, text_col: str = "text", key: str = "path",
                        all_tables: bool = False) -> DataFrame:
    """S13 long form: (path, table_index, row_index, cells map header -> cleaned text)."""
    tl = table_lines(docs, text_col, key)
    if not all_tables:
        tl = tl.where(F.col("table_index") == 0)
    return _rows_of(tl.where("row_index >= 0"), key)


def _rows_of(body: DataFrame, key: str) -> DataFrame:
    cells = F.transform(F.col("headers"), lambda h, i: F.struct(
        h.alias("key"), cell_text(F.coalesce(F.get(F.col("cells"), i), F.lit(""))).alias("value")))
    # a header that occurs twice keeps its last cell
    return body.where(F.size("cells") > 0).withColumn("_q_cells", cells).select(
        key, "table_index", "row_index", "headers", map_last_wins(F.col("_q_cells")).alias("cells"))


def read_markdown_table(spark: SparkSession, path: str, all_tables: bool = False, typed: bool = True) -> DataFrame:
    """S13 wide form: one column per header (union over files), typed per column.

    Header names and per-column types are two small aggregates collected on the driver
    (names and flags only); the rows stay distributed, those of a large file too.
    """
    profile = written(markdown_ranges.range_profile(spark, path), "markdown-ranges")
    lines = markdown_ranges.table_rows(spark, path, profile, all_tables)
    return widen_table(_rows_of(range_cells(lines), "file"), typed)


def range_cells(lines: DataFrame) -> DataFrame:
    """(file, table_index, row_index, headers, cells) of the rows that ``markdown_ranges`` finds."""
    rows = lines.select("file", "table_index", "row_index", _header_cells(_trim(F.col("header"))).alias("headers"),
                        _row_cells(_trim(F.col("line"))).alias("_q_parts"))
    return rows.select("file", "table_index", "row_index", "headers", _data_cells(F.col("_q_parts")).alias("cells"))


def widen_table(rows: DataFrame, typed: bool = True) -> DataFrame:
    hdrs = rows.select("headers").distinct().select(F.posexplode("headers").alias("i", "h")).groupBy("h").agg(
        F.min("i").alias("i")).orderBy("i", "h").collect()
    names = [r["h"] for r in hdrs]
    wide = rows.select(*[F.col("cells").getItem(n).alias(n) for n in names])
    if not typed or not names:
        return wide
    flags = wide.agg(*[F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").rlike(INT_CELL_RE)).alias(f"i{j}")
                       for j, n in enumerate(names)],
                     *[F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").rlike(INT_CELL_RE)
                                  | F.col(f"`{n}`").rlike(DECIMAL_CELL_RE)).alias(f"d{j}") for j, n in enumerate(names)],
                     *[F.bool_and(F.col(f"`{n}`").isNull() | F.lower(F.col(f"`{n}`")).isin("true", "false"))
                       .alias(f"b{j}") for j, n in enumerate(names)]).collect()[0]
    out = []
    for j, n in enumerate(names):
        c = F.col(f"`{n}`")
        if flags[f"i{j}"]:
            c = c.try_cast("long")
        elif flags[f"d{j}"]:
            c = c.try_cast("double")
        elif flags[f"b{j}"]:
            c = F.lower(c) == "true"
        out.append(c.alias(n))
    return wide.select(*out)


def list_items(text: Column) -> Column:
    """Unordered items first, then ordered ones."""
    items = F.concat(F.regexp_extract_all(text, F.lit(LIST_UNORDERED_RE), 1),
                     F.regexp_extract_all(text, F.lit(LIST_ORDERED_RE), 1))
    return F.transform(items, lambda x: _trim(x))


def headings(text: Column) -> Column:
    """Array of (level, text)."""
    marks = F.regexp_extract_all(text, F.lit(HEADING_RE), 1)
    texts = F.regexp_extract_all(text, F.lit(HEADING_RE), 2)
    return F.transform(F.arrays_zip(marks.alias("m"), texts.alias("t")),
                       lambda z: F.struct(F.length(z["m"]).alias("level"), _trim(z["t"]).alias("text")))


def paragraphs(text: Column) -> Column:
    """Blank-line separated blocks, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: _trim(p)), lambda p: F.length(p) > 0)


def structured_content(docs: DataFrame, text_col: str = "text", key: str = "path") -> DataFrame:
    """S15-S17 fallback for documents without a table: list, else headings, else paragraphs.

    Output rows: (path, content_type, index, level, text, type).
    """
    t = F.col(text_col)
    li, hd, pa = list_items(t), headings(t), paragraphs(t)
    kind = F.when(F.size(li) > 0, F.lit("list")).when(F.size(hd) > 0, F.lit("headings")).otherwise(F.lit("text"))
    entries = (F.when(F.size(li) > 0, F.transform(li, lambda x: F.struct(
                   F.lit(None).cast("int").alias("level"), x.alias("text"), F.lit("list-item").alias("type"))))
               .when(F.size(hd) > 0, F.transform(hd, lambda h: F.struct(
                   h["level"].alias("level"), h["text"].alias("text"), F.lit("heading").alias("type"))))
               .otherwise(F.transform(pa, lambda p: F.struct(
                   F.lit(None).cast("int").alias("level"), p.alias("text"), F.lit("paragraph").alias("type")))))
    return docs.select(F.col(key).alias(key), kind.alias("content_type"),
                       F.posexplode(entries).alias("index", "e")).select(
        key, "content_type", F.col("index").cast("long").alias("index"), "e.level", "e.text", "e.type")


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(metadata map, body) from a leading ``---`` block; first colon splits key and value."""
    pat = r"^---\n([\s\S]*?)\n---\n([\s\S]*)$"
    has = text.rlike(pat)
    block = F.regexp_extract(text, pat, 1)
    body = F.when(has, F.regexp_extract(text, pat, 2)).otherwise(text)
    pairs = F.filter(F.split(block, "\n"), lambda ln: F.instr(ln, ":") > 1)
    entries = F.transform(pairs, lambda ln: F.struct(
        _trim(F.substring_index(ln, ":", 1)).alias("key"),
        F.regexp_replace(_trim(F.substring(ln, F.instr(ln, ":") + 1, 1 << 30)), "^[\"']|[\"']$", "").alias("value")))
    meta = F.when(has, map_last_wins(entries)).otherwise(F.create_map().cast("map<string,string>"))
    return meta, body


def structure_profile(docs: DataFrame, text_col: str = "text", key: str = "path") -> DataFrame:
    """A10: per document table, heading and list-item counts and the content type; one projection."""
    t = F.col(text_col)
    out = docs.select(F.col(key).alias(key), F.size(headings(t)).alias("heading_count"),
                      F.size(list_items(t)).alias("list_item_count"),
                      F.coalesce(F.size(tables_of(t)), F.lit(0)).cast("long").alias("table_count"))
    kind = (F.when(F.col("table_count") > 0, F.lit("table")).when(F.col("heading_count") > 0, F.lit("structured"))
            .when(F.col("list_item_count") > 0, F.lit("list")).otherwise(F.lit("text")))
    return out.select(key, (F.col("table_count") > 0).alias("has_table"), "table_count",
                      (F.col("heading_count") > 0).alias("has_headings"), F.col("heading_count").cast("long"),
                      (F.col("list_item_count") > 0).alias("has_lists"), F.col("list_item_count").cast("long"),
                      kind.alias("content_type"))


# ---------------------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------------------

def md_value(c: Column, dt: T.DataType) -> Column:
    """Newline -> space, CR removed, backslash then pipe escaped (D25), dates as
    YYYY-MM-DD, arrays joined by ', ', objects as JSON; null -> ''."""
    if isinstance(dt, T.StringType):
        s = F.regexp_replace(F.regexp_replace(c, "\n", " "), "\r", "")
        s = F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), r"\|", r"\\|")
        s = _trim(s)
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        s = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(dt, T.ArrayType) and not isinstance(dt.elementType, (T.StructType, T.MapType, T.ArrayType)):
        s = F.array_join(F.transform(c, lambda x: md_value(x, dt.elementType)), ", ")
    elif isinstance(dt, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        s = F.to_json(c)
    else:
        s = js_string(c, dt)
    return F.coalesce(s, F.lit(""))


def table_line(df: DataFrame) -> Column:
    """K9 row line ``| a | b |``."""
    cells = [md_value(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _with_preamble(lines: DataFrame, preamble: Sequence[str]) -> DataFrame:
    """Put ``preamble`` (title, header, separator) in front of the first line of every
    partition, so every written part file is a document of its own. The first row of a task
    is the one whose ``monotonically_increasing_id`` has a zero in-partition index; the
    projection runs in the writing task, so no row leaves the JVM."""
    if not preamble:
        return lines.select("value")
    first = F.col("_q_mid").bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = F.lit("\n".join(preamble) + "\n")
    return (lines.select("value", F.monotonically_increasing_id().alias("_q_mid"))
            .select(F.when(first, F.concat(head, F.col("value"))).otherwise(F.col("value")).alias("value")))


def write_markdown_table(df: DataFrame, path: str, alignment: str = "left", title: str | None = None,
                         overwrite: bool = True, single_file: bool = False, extension: str | None = ".md") -> None:
    """K9: header, alignment separator and rows; every part file starts with its own header."""
    sep = {"center": ":---:", "right": "---:"}.get(alignment, "---")
    pre = ([f"# {title}", ""] if title else []) + [
        "| " + " | ".join(df.columns) + " |", "| " + " | ".join(sep for _ in df.columns) + " |"]
    lines = df.select(table_line(df).alias("value"))
    if single_file:
        lines = lines.coalesce(1)
    write_documents(_with_preamble(lines, pre), path, overwrite, extension, "<!-- Empty table -->")


def list_lines(df: DataFrame, ordered: bool = False, order_by=None) -> DataFrame:
    """K10 lines: ``- value`` or ``- **a**: x, **b**: y``; numbers need ``order_by``."""
    fields = df.schema.fields
    if len(fields) == 1:
        item = md_value(df[f"`{fields[0].name}`"], fields[0].dataType)
    else:
        item = F.concat_ws(", ", *[F.concat(F.lit(f"**{f.name}**: "), md_value(df[f"`{f.name}`"], f.dataType))
                                   for f in fields])
    if not ordered:
        return df.select(F.concat(F.lit("- "), item).alias("value"))
    if order_by is None:
        raise ValueError("an ordered list needs order_by")
    numbered = with_ordinal(df.select(*[F.col(f"`{c}`") for c in df.columns], item.alias("_q_item")), order_by, "_q_n")
    return numbered.orderBy("_q_n").select(F.concat((F.col("_q_n") + 1).cast("string"), F.lit(". "),
                                                     F.col("_q_item")).alias("value"))


def write_markdown_list(df: DataFrame, path: str, ordered: bool = False, order_by=None, title: str | None = None,
                        overwrite: bool = True) -> None:
    pre = [f"# {title}", ""] if title else []
    write_documents(_with_preamble(list_lines(df, ordered, order_by), pre), path, overwrite, ".md", "<!-- Empty list -->")


def heading_lines(df: DataFrame) -> DataFrame:
    """``#`` x level (clamped 1-6) + the first non-empty of ``text``, ``content`` and the
    first column (``level`` missing or 0 means 1)."""
    cols = df.columns
    level = F.coalesce(F.col("level").cast("int"), F.lit(1)) if "level" in cols else F.lit(1)
    level = F.when(level == 0, F.lit(1)).otherwise(level)
    candidates = [c for c in ("text", "content") if c in cols] + [cols[0]]
    texts = [F.nullif(js_string(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("")) for c in candidates]
    text = F.coalesce(*texts, F.lit(""))
    return df.select(F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), text,
                              F.lit("\n")).alias("value"))


def write_markdown_headings(df: DataFrame, path: str, overwrite: bool = True) -> None:
    write_documents(heading_lines(df), path, overwrite, ".md", "<!-- Empty headings -->")
