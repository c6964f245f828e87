"""Format detection over a corpus of files or a text column.

Every rule is a native column expression over a path or over the first 1 KB of content,
so detection is one projection over a file listing (with heads read in tasks) or over a
table column; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jscompat import js_trim

from ..sources.content_ranges import file_formats
from ..sources.files import file_heads, list_files
from ..sources.ranges import file_names

# Extension -> format, in the tool's order; confidences of each method.
EXTENSION_FORMATS = [(".csv", "csv"), (".xls", "xlsx"), (".xlsx", "xlsx"), (".json", "json"), (".xml", "xml"),
                     (".md", "md"), (".markdown", "md")]
SUPPORTED_FORMATS = ("csv", "xlsx", "json", "xml", "md")
EXTENSION_CONFIDENCE = 0.8
FALLBACK_CONFIDENCE = 0.5
SAMPLE_CHARS = 1024
# The nine Markdown patterns; two or more hits mean Markdown.
MARKDOWN_PATTERNS = [
    r"(?m)^#{1,6}\s+.+$",
    r"(?m)^\*\s+.+$",
    r"(?m)^\d+\.\s+.+$",
    r"\*\*[^*]+\*\*",
    r"\*[^*]+\*",
    r"\[.+\]\(.+\)",
    r"(?m)^\|.+\|$",
    r"(?m)^```[\s\S]*?```$",
    r"(?m)^>\s+.+$",
]
XML_DECLARATION_RE = r"(?i)^<\?xml\s+version"
XML_ELEMENT_RE = r"(?s)^<[a-zA-Z_][\w\-.:]*(\s+[^>]*)?>.*</[a-zA-Z_][\w\-.:]*>"
CSV_DELIMITERS = (",", ";", "\t", "|")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def format_of_extension(ext: Column) -> Column:
    out = None
    for e, f in EXTENSION_FORMATS:
        out = F.when(ext == e, F.lit(f)) if out is None else out.when(ext == e, F.lit(f))
    return out


def detect_by_extension(path: Column) -> Column:
    """struct(format, confidence, method, error); unknown extensions give an error text."""
    ext = extension_of(path)
    fmt = format_of_extension(ext)
    return F.struct(fmt.alias("format"), F.when(fmt.isNotNull(), F.lit(EXTENSION_CONFIDENCE)).alias("confidence"),
                    F.lit("extension").alias("method"),
                    F.when(fmt.isNull(), F.concat(F.lit("Unsupported format: "),
                                                  F.when(ext == "", F.lit("unknown")).otherwise(ext))).alias("error"))


def _trim(c: Column) -> Column:
    return js_trim(c)


def is_json_text(t: Column) -> Column:
    starts = t.startswith("{") | t.startswith("[")
    partial = t.contains('"') & (t.contains(":") | t.contains(","))
    return starts & (F.try_parse_json(t).isNotNull() | partial)


def is_xml_text(t: Column) -> Column:
    return t.startswith("<") & (t.rlike(XML_DECLARATION_RE) | t.rlike(XML_ELEMENT_RE))


def markdown_hits(t: Column) -> Column:
    return sum((F.when(t.rlike(p), 1).otherwise(0) for p in MARKDOWN_PATTERNS), F.lit(0))


def is_markdown_text(t: Column) -> Column:
    """Two or more of the nine patterns, short-circuiting: every pattern is tried at most
    once per row and the search stops at the second hit."""
    def at_least_two(patterns):
        if len(patterns) < 2:
            return F.lit(False)
        rest = patterns[1:]
        any_rest = reduce(lambda a, b: a | b, [t.rlike(p) for p in rest])
        return F.when(t.rlike(patterns[0]), any_rest).otherwise(at_least_two(rest))
    return at_least_two(list(MARKDOWN_PATTERNS))


def first_two_lines(t: Column) -> tuple[Column, Column]:
    """First and second non-blank lines of an already trimmed text, by one anchored
    regular expression (no split of the whole text into lines)."""
    first = F.substring_index(t, "\n", 1)
    second = F.regexp_extract(t, r"^[^\n]*\n(?:[^\S\n]*\n)*([^\n]*)", 1)
    return first, second


def is_csv_text(t: Column) -> Column:
    lines = F.filter(F.split(t, "\n"), lambda ln: F.length(_trim(ln)) > 0)
    first, second = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
    checks = []
    for d in CSV_DELIMITERS:
        pat = "\\Q" + d + "\\E"
        a, b = F.size(F.split(first, pat, -1)), F.size(F.split(second, pat, -1))
        checks.append((a > 1) & (a == b))
    return (F.size(lines) >= 2) & F.coalesce(F.greatest(*checks), F.lit(False))


def content_sample(text: Column, sample_chars: int | None = None) -> Column:
    """The trimmed text the content rules look at: the whole text, or its first ``sample_chars``
    characters (``SAMPLE_CHARS``: as the tool's detector defines it)."""
    t = F.coalesce(text, F.lit(""))
    return _trim(t if sample_chars is None else F.substring(t, 1, sample_chars))


def detect_by_content(text: Column, sample_chars: int | None = None) -> Column:
    """struct(format, confidence) from the text or its head; NULL format when no pattern fits.

    As a single expression the sample is re-derived inside every rule; over a DataFrame
    prefer ``with_content_format``, which projects the sample once."""
    return detect_by_sample(content_sample(text, sample_chars))


def with_content_format(df: DataFrame, text_col: str, name: str = "detected",
                        sample_chars: int | None = None) -> DataFrame:
    """T2 over a DataFrame in layered projections: the sample once, then every rule once
    as a flag, then the format from the flags. Each layer is referenced several times by
    the next, so CollapseProject keeps them apart and no rule is evaluated twice."""
    s = F.col("_q_sample")
    first, second = F.col("_q_first"), F.col("_q_second")
    csv_checks = []
    for d in CSV_DELIMITERS:
        pat = "\\Q" + d + "\\E"
        a = F.size(F.split(first, pat, -1))
        b = F.size(F.split(second, pat, -1))
        csv_checks.append((a > 1) & (a == b))
    fmt = (F.when(F.col("_q_json"), F.lit("json")).when(F.col("_q_xml"), F.lit("xml"))
           .when(F.col("_q_md"), F.lit("md")).when(F.col("_q_csv"), F.lit("csv")))
    two = first_two_lines(s)
    return (df.withColumn("_q_sample", content_sample(F.col(text_col), sample_chars))
            .withColumns({"_q_json": is_json_text(s), "_q_xml": is_xml_text(s), "_q_md": is_markdown_text(s),
                          "_q_first": two[0], "_q_second": two[1]})
            .withColumn("_q_csv", (s != "") & (_trim(second) != "")
                        & F.coalesce(F.greatest(*csv_checks), F.lit(False)))
            .withColumn("_q_fmt", fmt)
            .withColumn(name, F.struct(F.col("_q_fmt").alias("format"), _confidence(F.col("_q_fmt")).alias("confidence"),
                                       F.lit("content").alias("method")))
            .drop("_q_sample", "_q_json", "_q_xml", "_q_md", "_q_first", "_q_second", "_q_csv", "_q_fmt"))


def _confidence(fmt: Column) -> Column:
    return F.when(fmt.isin("json", "xml"), 0.9).when(fmt == "md", 0.7).when(fmt == "csv", 0.6)


def detect_by_sample(t: Column) -> Column:
    """T2 rules over an already trimmed 1 KB sample."""
    fmt = (F.when(is_json_text(t), F.lit("json")).when(is_xml_text(t), F.lit("xml"))
           .when(is_markdown_text(t), F.lit("md")).when(is_csv_text(t), F.lit("csv")))
    return F.struct(fmt.alias("format"), _confidence(fmt).alias("confidence"), F.lit("content").alias("method"))


def combine(ext: Column, content: Column) -> Column:
    """Agreement raises confidence; otherwise the strictly more confident side wins.
    Unusable content (unreadable or no pattern) counts as the extension's format at 0.5."""
    c_fmt = F.coalesce(content["format"], ext["format"])
    c_conf = F.when(content["format"].isNull(), F.lit(FALLBACK_CONFIDENCE)).otherwise(content["confidence"])
    agree = ext["format"] == c_fmt
    fmt = F.when(agree, ext["format"]).when(c_conf > ext["confidence"], c_fmt).otherwise(ext["format"])
    conf = (F.when(agree, F.least(F.lit(0.95), (ext["confidence"] + c_conf) / 2 + 0.2))
            .when(c_conf > ext["confidence"], c_conf).otherwise(ext["confidence"]))
    return F.struct(fmt.alias("format"), F.when(ext["format"].isNotNull(), conf).alias("confidence"),
                    F.lit("hybrid").alias("method"), ext["error"].alias("error"))


def detect_files(spark: SparkSession, path: str, analyze_content: bool = True,
                 sample_chars: int | None = None) -> DataFrame:
    """T1/T3 over every file under ``path``: (path, format, confidence, method, error).
    Content rules read the whole of each file, by byte ranges, or, with ``sample_chars``, its
    first bytes only, which can cut a document in two and miss its format."""
    files = list_files(spark, path)
    if not analyze_content:
        return files.select("path", detect_by_extension(F.col("path")).alias("d")).select("path", "d.*")
    if sample_chars is None:
        found = file_formats(spark, path).withColumn("_q_content", F.struct(
            "format", _confidence(F.col("format")).alias("confidence"), F.lit("content").alias("method")))
        heads = file_names(spark, path).join(found.select("file", "_q_content"), "file", "left").withColumn(
            "read_error", F.lit(None).cast("string"))
    else:
        heads = with_content_format(file_heads(files, sample_chars), "head", "_q_content")
    ext = detect_by_extension(F.col("path"))
    # content that cannot be read: the extension's answer at 0.5; content that fits no
    # pattern: counted as the extension's format at 0.5 and combined (agreement raises it)
    unreadable = F.struct(ext["format"].alias("format"),
                          F.when(ext["format"].isNotNull(), F.lit(FALLBACK_CONFIDENCE)).alias("confidence"),
                          F.lit("extension").alias("method"), ext["error"].alias("error"))
    result = F.when(F.col("read_error").isNotNull(), unreadable).otherwise(combine(ext, F.col("_q_content")))
    return heads.select("path", result.alias("d")).select("path", "d.*")


def format_suggestions(path: Column) -> Column:
    """T4: the format of every supported extension similar to the path's (one entry per
    extension, so xls and xlsx both give xlsx), else all formats."""
    ext = extension_of(path)
    bare = F.substring(ext, 2, 1 << 20)
    exts = F.array(*[F.lit(e) for e, _ in EXTENSION_FORMATS])
    similar = F.filter(exts, lambda e: e.contains(bare) | ext.contains(F.substring(e, 2, 1 << 20)))
    fmts = F.transform(similar, lambda e: format_of_extension(e))
    return F.when(F.size(similar) > 0, fmts).otherwise(F.array(*[F.lit(f) for f in SUPPORTED_FORMATS]))


def pair_warnings(source: Column, target: Column) -> Column:
    """T5: data-loss warnings for a (source format, target format) pair."""
    supported = F.array(*[F.lit(f) for f in SUPPORTED_FORMATS])
    return F.array_compact(F.array(
        F.when(~F.array_contains(supported, source), F.concat(F.lit("Source format '"), source,
                                                              F.lit("' is not supported"))),
        F.when(~F.array_contains(supported, target), F.concat(F.lit("Target format '"), target,
                                                              F.lit("' is not supported"))),
        F.when((source == "xlsx") & (target == "csv"),
               F.lit("Converting from Excel to CSV may lose formatting and multiple sheets")),
        F.when((source == "xml") & (target == "csv"), F.lit("Converting from XML to CSV may lose hierarchical structure")),
        F.when((source == "json") & (target == "csv"),
               F.lit("Converting from JSON to CSV may lose nested object structure")),
        F.when((target == "md") & ~source.isin("csv", "json"),
               F.lit("Converting to Markdown works best with tabular data"))))


def pair_suggestions(source: Column, target: Column) -> Column:
    return F.array_compact(F.array(
        F.when((source == "xlsx") & (target == "csv"), F.lit("Consider specifying which sheet to convert")),
        F.when((source == "xml") & (target == "csv"), F.lit("Ensure XML has a flat, tabular structure")),
        F.when((source == "json") & (target == "csv"), F.lit("Ensure JSON contains an array of flat objects")),
        F.when((target == "md") & ~source.isin("csv", "json"),
               F.lit("Consider converting to CSV first, then to Markdown"))))
