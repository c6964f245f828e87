"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_dir, ship_package

# A word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its SQL where SQL can express it."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: the shared checkpoint folder and the package on workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later jobs do not recompute it,
    and a lost executor costs only the tasks that it ran."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete an intermediate table that nothing reads any more."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def byte_table() -> tuple[np.ndarray, np.ndarray]:
    """(lower-casing map, is-a-gap flags) over the 256 byte values."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    return low, gap


_LOW, _GAP = byte_table()
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), so that near values land far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = [_powers(64, 0x100000001B3 | 1), _powers(64, 0x9E3779B97F4A7C15)]


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) offsets of the words in a UTF-8 byte buffer."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = _GAP[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if not gap[-1]:
        edge = np.concatenate((edge, [len(buf)]))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a byte buffer, without a Python step per word.

    A word's hash mixes the sum of (byte + 1) * power[position] with its length; positions
    wrap at 64 with another factor for each further stretch of 64 bytes.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    low = _LOW[buf].astype(np.uint64) + np.uint64(1)
    at = np.arange(len(buf), dtype=np.int64)
    owner = np.zeros(len(buf), np.int64)
    owner[start] = 1
    owner = np.cumsum(owner) - 1
    inside = ~_GAP[buf]
    pos = at[inside] - start[owner[inside]]
    val = low[inside] * _POW[0][pos & 63]
    if len(pos) and pos.max() > 63:
        far = pos > 63
        val[far] = mix64(val[far] + (pos[far] >> 6).astype(np.uint64) * _MUL)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix64(np.add.reduceat(val, first) + length.astype(np.uint64) * _MUL)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of ``edges`` (columns a, b: long): (node, component).

    Each round a node takes the smallest label among its own and its neighbours' labels, then
    jumps to the label of that label, so long chains shrink by pointer doubling. Rounds are cut
    with checkpoint(); nothing but the count of changes reaches the driver. Raises if labels
    still change after ``max_rounds``.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    both = (edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .where("a != b").distinct().checkpoint())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    labels = labels.select("node", F.least("node", "component").alias("component")).checkpoint()
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        # hooking: the old label learns of the smaller one too, so whole trees move at once
        hook = step.where("mid < old").groupBy(F.col("old").alias("node")).agg(F.min("mid").alias("hook"))
        step = (step.join(hook, "node", "left")
                .select("node", "old", F.least("mid", F.coalesce("hook", "mid")).alias("mid")))
        jump = step.select(F.col("node").alias("mid"), F.col("mid").alias("next"))
        new = (step.join(jump, "mid", "left")
               .select("node", "old", F.least("mid", F.coalesce("next", "mid")).alias("component")).checkpoint())
        changed = new.where("old != component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")
