"""File listings and file heads, the inputs of sniffing, detection and file checks.

``list_files`` uses Spark's ``binaryFile`` source without its ``content`` column, so only
file metadata is read. ``file_heads`` reads the first bytes of every file inside tasks
(one pass over the listing, partitioned by Spark), never the whole file on the driver.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, modification_time, extension) of every file under ``path`` (a path or a
    list of paths)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path).select("path", "length", F.col("modificationTime").alias("modification_time"))
    return df.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def every_file(spark: SparkSession, root: str) -> DataFrame:
    """``list_files``, with the empty files that Spark's readers leave out; nothing where ``root`` does not exist."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    schema = "path string, length long, modification_time timestamp, extension string"
    if not hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
        return spark.createDataFrame([], schema)
    files = list_files(spark, root)
    # the reader's plan knows all files; names are fetched only if some are missing from the rows
    known = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if known._jdf.inputFiles().__len__() == files.count():
        return files
    names = spark.createDataFrame([(f,) for f in known.inputFiles()], "name string")
    path = F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, "^file:/{3}", "file:/")
    empty = names.select(path.alias("path")).join(files, "path", "left_anti")
    return files.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias(
        "modification_time"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension")))


def _open(path: str):
    import pyarrow.fs as pafs
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    if path.startswith("file:") and "://" not in path:
        inner = path[len("file:"):]
    return fs.open_input_stream(inner)


def read_head(path: str, nbytes: int) -> bytes:
    with _open(path) as f:
        return f.read(nbytes)


def file_heads(files: DataFrame, nbytes: int = 1024, encoding: str = "utf-8") -> DataFrame:
    """Add ``head`` (first ``nbytes`` decoded, BOM removed) and ``has_bom`` to a file listing.

    Runs as an Arrow-batched ``mapInPandas`` over the listing, so every task opens only its
    own files and reads only their first bytes (local, HDFS or object-store paths through
    ``pyarrow.fs``).
    """
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, boms, errors = [], [], []
            for p in pdf["path"]:
                try:
                    raw = read_head(p, nbytes)
                    bom = raw.startswith(b"\xef\xbb\xbf")
                    text = raw.decode(encoding, errors="replace")
                    texts.append(text.lstrip("\ufeff"))
                    boms.append(bom)
                    errors.append(None)
                except OSError as e:
                    texts.append(None)
                    boms.append(False)
                    errors.append(str(e))
            yield pdf.assign(head=texts, has_bom=boms, read_error=errors)

    schema = files.schema.simpleString()[len("struct<"):-1] + ",head:string,has_bom:boolean,read_error:string"
    return files.mapInPandas(heads, schema)


def whole_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: (path, text) with a leading BOM removed; parallel per file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.regexp_replace("value", "^\\uFEFF", "").alias("text"))


@contextmanager
def swap_in(spark: SparkSession, path: str, overwrite: bool) -> Iterator[str]:
    """A folder beside ``path`` to write to; it takes the place of ``path`` when all is written. What stood there is kept
    until then, so a plan may still read it, and a failed write leaves it as it was."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    tag = uuid.uuid4().hex[:12]
    aside, old = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{k}-{tag}") for k in ("new", "old"))
    try:
        yield aside.toString()
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(aside, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"cannot move the new files to {path}")
        if had:
            fs.delete(old, True)
    finally:
        fs.delete(aside, True)


def rename_parts(spark: SparkSession, path: str, extension: str) -> None:
    """Give the part files of a written folder a new extension (``.md`` for Markdown text).

    A metadata-only rename through the cluster's file system API; no data moves.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for status in fs.listStatus(root):
        p = status.getPath()
        name = p.getName()
        if name.startswith("part-") and not name.endswith(extension):
            stem = name.rsplit(".", 1)[0] if "." in name else name
            fs.rename(p, jvm.org.apache.hadoop.fs.Path(root, stem + extension))


def keep_only(spark: SparkSession, path: str, extension: str) -> None:
    """Delete what lies beside the files of one kind in a written folder: the success mark, and the checksums that the
    local file system adds."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs = fs.getRaw() if fs.getScheme() == "file" else fs
    for status in fs.listStatus(root):
        if not status.getPath().getName().endswith(extension):
            fs.delete(status.getPath(), True)


def write_documents(lines: DataFrame, path: str, overwrite: bool, extension: str | None, empty: str) -> None:
    """Write text lines so that every part file is a document; ``empty`` is the whole output when
    there are no lines. That is seen from the written bytes: a probe before the write would run
    the plan twice and end observations on it after a few rows.
    """
    spark = lines.sparkSession
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if empty and fs.getContentSummary(hp).getLength() == 0:
        spark.createDataFrame([(empty,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    if extension:
        rename_parts(spark, path, extension)
