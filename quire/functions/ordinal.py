"""Row positions for order-dependent operators.

Spark rows have no order, so every positional operator takes ``order_by`` (a total order,
e.g. a key column). Positions are found on the keys alone: they are dealt by range, sorted, counted by
range, and a row's place in its range is added to the rows of the ranges before. Only keys and their
positions are written; the rows themselves meet them in one join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, written


def sort_columns(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def _value(c: Column) -> Column:
    """The column that a sort key sorts by."""
    node = c._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return c
    return F.expr(node.child().sql())


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted keys of a range, and those that are equal among themselves."""
    part, at, last, run = TaskContext.get().partitionId(), 0, None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        same = b.column(0).to_numpy()               # equal keys have equal hashes, and lie side by side
        starts = np.concatenate(([last is None or same[0] != last], same[1:] != same[:-1]))
        place = np.arange(n)
        first = np.maximum.accumulate(np.where(starts, place, -1))
        twin = np.where(first < 0, place + run + 1, place - first)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:], pa.array(np.full(n, part, np.int32)), pa.array(at + place), pa.array(twin)],
            [*b.schema.names[1:], "_q_part", "_q_row", "_q_twin"])
        at, last, run = at + n, same[-1], int(twin[-1])


def key_ordinals(df: DataFrame, order_by, num_partitions: int | None = None) -> DataFrame:
    """_q_k0, _q_k1, ... (the keys), _q_twin (which of the rows of equal keys, from 0), ordinal: a row for each of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    keys = sort_columns(order_by)
    ways = [k._jc.node() for k in keys]
    names = [f"_q_k{i}" for i in range(len(keys))]
    only = df.select(F.xxhash64(*[_value(k) for k in keys]).alias("_q_same"), *[_value(k).alias(n) for k, n in zip(keys, names)])
    way = []
    for node, n in zip(ways, names):
        down = node.getClass().getSimpleName() == "SortOrder" and "Descending" in node.sortDirection().toString()
        way.append(F.col(n).desc() if down else F.col(n).asc())
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = only.repartitionByRange(n, *way).sortWithinPartitions(*way)
    schema = T.StructType([*only.schema.fields[1:], T.StructField("_q_part", T.IntegerType()),
                           T.StructField("_q_row", T.LongType()), T.StructField("_q_twin", T.LongType())])
    placed = written(ranged.mapInArrow(_in_range, schema), "ordinals")
    before = Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)     # a row a range
    offsets = placed.groupBy("_q_part").agg(F.count(F.lit(1)).alias("_q_n")).select(
        "_q_part", F.coalesce(F.sum("_q_n").over(before), F.lit(0)).alias("_q_off"))
    return placed.join(F.broadcast(offsets), "_q_part").select(
        *names, "_q_twin", (F.col("_q_off") + F.col("_q_row")).alias("ordinal"))


def rows_at(df: DataFrame, order_by, ordinals: DataFrame, wanted: Column | None = None, name: str | None = None) -> DataFrame:
    """The rows of ``df`` at the positions for which ``wanted`` (over the column ordinal) holds, with their position as
    ``name``. Positions are chosen before the join, on the keys."""
    keys = [_value(k) for k in sort_columns(order_by)]
    cols, mine = df.columns, [f"_q_l{i}" for i in range(len(keys))]
    given = df.select(*[F.col(f"`{c}`") for c in cols], *[k.alias(m) for k, m in zip(keys, mine)])
    same = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"_q_k{i}")) for i, m in enumerate(mine)])
    if ordinals.where("_q_twin > 0").limit(1).count():
        # rows of equal keys, which a total order does not have, are told apart by number
        given = given.withColumn("_q_nth", F.row_number().over(Window.partitionBy(*mine).orderBy(*mine)) - 1)
        same = same & (F.col("_q_nth") == F.col("_q_twin"))
    found = given.join(ordinals if wanted is None else ordinals.where(wanted), same)
    return found.select(*[F.col(f"`{c}`") for c in cols], *([F.col("ordinal").alias(name)] if name else []))


def with_ordinal(df: DataFrame, order_by, name: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row under ``order_by`` (a total order; rows of equal keys
    take neighbouring positions in any order)."""
    return rows_at(df, order_by, key_ordinals(df, order_by, num_partitions), name=name)
