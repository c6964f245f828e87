"""CSV scan with delimiter sniffing and cleaning (S1, S2, S3) and the CSV sink (K1).

Files are read by byte ranges (``csv_ranges``): one pass scores the delimiters of every file over all
its lines and finds how each range starts; then the ranges are cut into records, also where cells hold
line ends, and Spark's CSV parser types and reads the records. Large files have many tasks.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jscompat import js_trim

from ..functions.jscompat import js_string
from ..session import written
from . import csv_ranges
from .csv_ranges import DELIMITERS
from .files import file_heads, list_files
from .ranges import file_names

SNIFF_BYTES = 1024
SNIFF_LINES = 5


def _line_stats(lines: Column, delimiter: str) -> Column:
    """One pass over the lines: first field count, sum, line count, all counts equal."""
    pattern = "\\Q" + delimiter + "\\E"
    init = F.struct(F.lit(-1).alias("first"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"),
                    F.lit(True).alias("same"))

    def step(acc, ln):
        c = F.size(F.split(ln, pattern, -1))
        first = F.when(acc["n"] == 0, c).otherwise(acc["first"])
        return F.struct(first.alias("first"), (acc["sum"] + c).alias("sum"), (acc["n"] + 1).alias("n"),
                        (acc["same"] & (c == first)).alias("same"))
    return F.aggregate(lines, init, step)


def _score(st: Column) -> Column:
    avg = st["sum"] / st["n"]
    return (F.when(st["n"] > 1, F.when(st["same"], avg * 2).otherwise(avg))
            .otherwise(F.when(st["n"] == 1, st["first"].cast("double")).otherwise(F.lit(0.0))))


def delimiter_scores(head: Column, sniff_chars: int | None = SNIFF_BYTES,
                     sniff_lines: int | None = SNIFF_LINES) -> Column:
    """Array of (delimiter, score) for one text: its first ``sniff_lines`` lines within the
    first ``sniff_chars`` characters, as the tool sniffs, or every line with ``None``.
    Score: mean field count, doubled when every line has the same count; each delimiter's
    statistics come from one pass over the lines."""
    text = head if sniff_chars is None else F.substring(head, 1, sniff_chars)
    # line breaks inside quoted cells are part of their cell, and empty lines say nothing
    text = F.regexp_replace(text, r'"[^"]*+"', "q")
    lines = F.filter(F.split(text, "\r?\n", -1), lambda ln: ln != "")
    if sniff_lines is not None:
        lines = F.slice(lines, 1, sniff_lines)
    out = []
    for i, d in enumerate(DELIMITERS):
        score = F.transform(F.array(_line_stats(lines, d)), _score).getItem(0)  # statistics evaluated once
        out.append(F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), score.alias("score")))
    return F.array(*out)


def best_delimiter(scores: Column) -> Column:
    """Highest score; earlier candidates win ties; comma when every score is 0."""
    best = F.aggregate(
        scores, F.struct(F.lit(-1).alias("rank"), F.lit(",").alias("delimiter"), F.lit(0.0).alias("score")),
        lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return best["delimiter"]


def delimiter_profile(spark: SparkSession, path: str, glob: str | None = None, whole: bool = True) -> DataFrame:
    """One row per (file, delimiter) with its score, and the file's chosen delimiter.

    Every line of every file is scored, range by range; ``whole=False`` scores only the first
    1 K / 5 lines, which is cheaper and can be wrong. A file without lines scores 0 throughout."""
    if whole:
        names = file_names(spark, path, glob)
        found = csv_ranges.delimiter_scores(csv_ranges.range_profile(spark, path, (), True, glob))
        empty = F.explode(F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(d == DELIMITERS[0]).alias("first"))
                                    for d in DELIMITERS]))
        every = names.select("file", "path", "length", empty.alias("d")).select("file", "path", "length", "d.*")
        return every.join(found, ["file", "delimiter"], "left").select(
            "path", "length", "delimiter", F.coalesce("score", F.lit(0.0)).alias("score"),
            F.coalesce("chosen", "first").alias("chosen"))
    heads = file_heads(list_files(spark, path, glob), SNIFF_BYTES)
    scored = heads.select("path", "length", delimiter_scores(F.coalesce("head", F.lit(""))).alias("scores"))
    scored = scored.withColumn("chosen", best_delimiter(F.col("scores")))
    return scored.select("path", "length", F.explode("scores").alias("s"), "chosen").select(
        "path", "length", "s.delimiter", "s.score", (F.col("s.delimiter") == F.col("chosen")).alias("chosen"))


def detect_delimiter_text(text: Column) -> Column:
    """S2 for a column of CSV text (e.g. payloads stored in a table); every line is scored."""
    return best_delimiter(delimiter_scores(text, None, None))


def clean_csv(df: DataFrame) -> DataFrame:
    """S3: trim text cells, '' -> null, blank header -> column_<position>."""
    out = []
    for i, f in enumerate(df.schema.fields):
        name = f.name.strip()
        if not name or (f.name == f"_c{i}"):
            name = f"column_{i}"
        c = df[f"`{f.name}`"]
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(js_trim(c), F.lit(""))
        out.append(c.alias(name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True,
             infer_schema: bool = True, schema: T.StructType | str | None = None, encoding: str = "utf-8",
             multiline: bool = True, null_value: str | None = None, timestamp_format: str | None = None,
             sampling_ratio: float | None = None, clean: bool = True) -> DataFrame:
    """Header row, trimmed headers, empty lines skipped, typed cells, BOM, quoted fields.

    ``sep=None`` scores the delimiter of every file over all its lines (S2); files that disagree are
    read per delimiter and unioned by name. Cells may hold line ends and files are still read by
    many tasks; ``multiline=False`` spares the pass that finds how ranges start, for files known to hold none.
    Only UTF-8 is split so: with another ``encoding`` each file is one task. Inference reads every row
    at any size; ``schema`` skips it, and ``sampling_ratio`` trades it for a sample at the caller's risk.
    """
    def reader(sep: str):
        r = (spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", bool(multiline and clean)))
        if null_value is not None:
            r = r.option("nullValue", null_value)
        return r.option("timestampFormat", timestamp_format) if timestamp_format else r

    def typed(r):
        if schema is not None:
            return r.schema(schema)
        return r.option("inferSchema", True).option("samplingRatio", sampling_ratio or 1.0) if infer_schema else r

    def finished(df: DataFrame) -> DataFrame:
        df = df.toDF(*[c.strip() for c in df.columns])
        return clean_csv(df) if clean else df

    if encoding.lower().replace("-", "") != "utf8" or not multiline and sep is not None:
        if sep is None:
            # delimiters and quotes are the same bytes in the encodings that extend ASCII
            chosen = delimiter_profile(spark, path).where("chosen").select("delimiter", "path")
            found = sorted(r[0] for r in chosen.select("delimiter").distinct().collect())       # four at most
            frames = [read_csv(spark, path if len(found) == 1 else [r[0] for r in chosen.where(
                F.col("delimiter") == d).select("path").collect()], d, header, infer_schema, schema, encoding, multiline,
                null_value, timestamp_format, sampling_ratio, clean) for d in found]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else \
                spark.createDataFrame([], T.StructType([]))
        r = typed(reader(sep)).option("header", header).option("encoding", encoding).option("multiLine", multiline)
        if multiline and clean:
            # lines may end in \n or \r\n, also in turns: a left-over \r is white space, which cleaning trims
            r = r.option("lineSep", "\n")
        return finished(r.csv(path))

    candidates = DELIMITERS if sep is None else (sep,)
    profile = written(csv_ranges.range_profile(spark, path, candidates, sep is None), "csv-ranges")
    files: dict[str, np.ndarray | None] = {sep: None}
    if sep is None:
        chosen = csv_ranges.delimiter_scores(profile).where("chosen").select("file", "delimiter")
        found = sorted(r[0] for r in chosen.select("delimiter").distinct().collect())       # four at most
        if not found:
            return spark.createDataFrame([], T.StructType([]))
        chosen = written(chosen, "csv-delimiters") if len(found) > 1 else chosen
        # eight bytes a file, and only where files disagree
        files = {d: None if len(found) == 1 else
                 np.array(chosen.where(F.col("delimiter") == d).select("file").toPandas()["file"], np.int64) for d in found}
    frames = []
    for d, of in files.items():
        k = candidates.index(d)
        rows = csv_ranges.records(spark, path, d, header, profile, k, of)
        fields = schema
        if fields is None:
            titles = _first_header(spark, path, profile, k, of) if header else None
            if header and titles is None:
                continue                # files without a line that is not blank have no columns
            r = typed(reader(d)).option("header", header)
            fields = _csv_of(r, titles.union(rows) if header and infer_schema else titles if header else rows).schema
        frames.append(finished(_csv_of(reader(d).schema(fields).option("header", False), rows)))
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _first_header(spark: SparkSession, path, profile: DataFrame, k: int, files: np.ndarray | None) -> DataFrame | None:
    """value: the header of the first file, by path, that has one."""
    rows = profile.where("block = 0").select("file", F.col("header")[k].alias("value")).where("value is not null")
    if files is not None:
        rows = rows.join(spark.createDataFrame([(int(f),) for f in files], "file long"), "file", "left_semi")
    first = rows.join(file_names(spark, path), "file").orderBy("path").select("value").limit(1).collect()
    return spark.createDataFrame([(first[0].value,)], "value string").coalesce(1) if first else None


def _csv_of(reader, records: DataFrame) -> DataFrame:
    """Spark's CSV parser over a column of records: its reader takes a dataset of strings on the JVM side."""
    strings = records.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return reader._df(reader._jreader.csv(getattr(records._jdf, "as")(strings)))


def csv_ready(df: DataFrame) -> DataFrame:
    """K1 value formatting: doubles and instants as the tool prints them, nested values as JSON text."""
    out = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType, T.StructType, T.ArrayType, T.MapType,
                                   T.VariantType, T.TimestampType, T.TimestampNTZType)):
            c = js_string(c, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, header: bool = True, overwrite: bool = True, single_file: bool = False,
              encoding: str = "utf-8") -> None:
    """K1: every field quoted, quotes doubled, comma, ``\\n``; one header per part file."""
    out = csv_ready(df)
    if single_file:
        out = out.coalesce(1)
    (out.write.mode("overwrite" if overwrite else "errorifexists")
     .option("header", header).option("quoteAll", True).option("quote", '"').option("escape", '"')
     .option("lineSep", "\n").option("encoding", encoding).option("emptyValue", "")
     .csv(path))


def conform(df: DataFrame, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast a read-back table to a known schema (for typed round trips)."""
    names = columns or [f.name for f in schema.fields]
    return df.select(*[df[f"`{n}`"].try_cast(schema[n].dataType).alias(n) for n in names])
