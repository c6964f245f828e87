"""Changes to values at any depth of a column."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holds(dt: T.DataType, kinds: tuple) -> bool:
    """Whether a type is, or holds at any depth (map keys apart), one of ``kinds``."""
    if isinstance(dt, kinds):
        return True
    if isinstance(dt, T.StructType):
        return any(holds(f.dataType, kinds) for f in dt.fields)
    if isinstance(dt, T.MapType):
        return holds(dt.valueType, kinds)
    return isinstance(dt, T.ArrayType) and holds(dt.elementType, kinds)


def map_leaves(c: Column, dt: T.DataType, kinds: tuple, fn: Callable[[Column, T.DataType], Column]) -> Column:
    """``c`` with ``fn(value, type)`` in place of every value of one of ``kinds`` inside it."""
    if not holds(dt, kinds):
        return c
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[map_leaves(c.getField(f.name), f.dataType, kinds, fn).alias(f.name)
                                                for f in dt.fields]))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: map_leaves(x, dt.elementType, kinds, fn))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: map_leaves(v, dt.valueType, kinds, fn))
    return fn(c, dt)
