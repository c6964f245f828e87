"""Byte ranges of text files with the state that each starts in: quoted CSV and JSON arrays by many tasks.

Spark splits a text file into ranges of bytes and deals them to tasks, each a run of whole pieces
between separators. Whether a range starts inside a quoted cell or a JSON string, and how deep, follows
from the ranges before it. So one pass computes for every range what it does to each possible start
state, a row a range; composed in file order these give all start states; and a second pass cuts the
pieces into records. A record that crosses ranges is put together from its fragments in a shuffle that
only fragments take part in.

The driver sees one short row per range, as it does when Spark plans the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

PIECES = "file long, block long, size long, value string"
RECORDS = "file long, block long, part int, value string"
# A record, or how a fragment lies in its record; TITLE begins one that is not wanted.
WHOLE, HEAD, MIDDLE, TAIL, TITLE = 0, 1, 2, 3, 4
# Bytes of text worked on at a time: a batch of long pieces is far larger, and each step makes copies.
PORTION = 2 << 20


def pieces(spark: SparkSession, path, separator: str = "\n", glob: str | None = None) -> DataFrame:
    """file (hash of its path), block (where its range starts), size (of the file) and value of all pieces; the pieces
    of a range are consecutive rows of one task."""
    ship_package(spark)
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.xxhash64("_metadata.file_path").alias("file"),
                                    F.col("_metadata.file_block_start").alias("block"),
                                    F.col("_metadata.file_size").alias("size"), "value")


def file_names(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """file (the hash that ``pieces`` gives), path, length of all files; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.xxhash64("_metadata.file_path").alias("file"), "path", "length")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.StringArray]]:
    """((file, block), size, values) of the stretches of each batch that lie in one range, in portions."""
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            for values in portions(b.column(3).slice(a, e - a)):
                yield (int(file[a]), int(block[a])), b.column(2)[a].as_py(), _valid(values)


def portions(values: pa.Array) -> Iterator[pa.Array]:
    """``values`` in slices of about ``PORTION`` bytes, or one value that is longer."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PORTION, "right")))
        yield values.slice(at, end - at)
        at = end


def _valid(values: pa.StringArray) -> pa.StringArray:
    """Bytes that are no UTF-8, as in files of other kinds, become replacement characters."""
    try:
        values.validate(full=True)
        return values
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values.cast(pa.binary()).to_pylist()],
                        pa.string())


def by_range(batches: Iterator[pa.RecordBatch], make: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per range: ``make(file, block, size)`` is fed the range's values and then asked for its row."""
    state, key = None, None
    for k, size, values in runs(batches):
        if k != key:
            if state is not None:
                yield pa.RecordBatch.from_pylist([state.row()], schema)
            state, key = make(*k, size), k
        state.feed(values)
    if state is not None:
        yield pa.RecordBatch.from_pylist([state.row()], schema)


class Starts:
    """Start states by (file, block) in sorted arrays; ranges without an entry start in state 0."""

    def __init__(self, rows: Sequence[tuple]):
        rows = sorted(rows)
        self.file = np.array([r[0] for r in rows], np.int64)
        self.block = np.array([r[1] for r in rows], np.int64)
        self.state = [tuple(r[2:]) for r in rows]

    def get(self, file: int, block: int):
        a, b = np.searchsorted(self.file, [file, file + 1]) if len(self.file) else (0, 0)
        i = a + int(np.searchsorted(self.block[a:b], block))
        return self.state[i] if i < b and self.block[i] == block else None


def emit(values, key: tuple[int, int] | None = None, part: int = WHOLE) -> pa.RecordBatch:
    """Records, or one fragment of the range ``key``."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
    n = len(values)
    file, block = (pa.nulls(n, pa.int64()),) * 2 if key is None else (pa.array([k] * n, pa.int64()) for k in key)
    return pa.RecordBatch.from_arrays([file, block, pa.array(np.full(n, part, np.int32)), values.cast(pa.string())],
                                      ["file", "block", "part", "value"])


def stitched(cut: DataFrame, separator: str, fragments: bool) -> DataFrame:
    """value of all records of ``cut`` (RECORDS). With ``fragments`` those of a record are joined by ``separator`` in
    order of their ranges; ranges are long, so a record has few."""
    whole = cut.where(f"part = {WHOLE}").select("value")
    if not fragments:
        return whole
    parts = cut.where(f"part <> {WHOLE}")
    order = Window.partitionBy("file").orderBy("block", "part")         # a range ends a record, then begins one
    begins = F.when(F.col("part") >= TAIL, 1).otherwise(0)
    joined = parts.withColumn("_run", F.sum(begins).over(order)).groupBy("file", "_run").agg(
        F.sort_array(F.collect_list(F.struct("block", "part", "value"))).alias("all")).where(
        ~F.exists("all", lambda s: s["part"] == TITLE))
    return whole.union(joined.select(F.array_join(F.transform("all", lambda s: s["value"]), separator)))


def matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def contains(values: pa.Array, text: str) -> np.ndarray:
    return pc.match_substring(values, text).to_numpy(zero_copy_only=False)


def count(values: pa.Array, text: str) -> np.ndarray:
    return pc.count_substring(values, text).to_numpy().astype(np.int64)
