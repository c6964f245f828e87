"""Column operations (P1-P9), their plan-time check (V11) and column statistics (A1).

Every operation is a projection; a chain of them collapses into one ``Project`` under
Catalyst's CollapseProject, so a long chain costs one pass.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any, Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.jscompat import js_trim
from ..functions.jscompat import js_string, js_typeof
from ..functions.ordinal import sort_columns, with_ordinal
from ..session import ship_package
from .filters import Report, has_column

OPERATION_TYPES = ("add", "remove", "rename")


@dataclass(frozen=True)
class ColumnOperation:
    type: str
    column: str
    new_name: str | None = None
    default: Any = None  # literal, Column, SQL text (``expr=True``) or callable(cols) -> Column
    expr: bool = False


def _default_column(df: DataFrame, op: ColumnOperation) -> Column:
    d = op.default
    if isinstance(d, Column):
        return d
    if callable(d):
        return d({c: df[c] for c in df.columns})
    if op.expr and isinstance(d, str):
        return F.expr(d)
    return F.lit(d)


def add_column(df: DataFrame, name: str, default: Any = None, expr: bool = False,
               row_function: Callable[[dict], Any] | None = None, return_type: T.DataType | str = "string") -> DataFrame:
    """A constant, a Column, a SQL expression, a function of the row's columns (building a
    Column), or ``row_function``: a plain Python function of the row as a dict, run as an
    Arrow-batched pandas UDF where a raising call gives null, as the tool does."""
    if not name:
        raise ValueError("Column name is required for add operation")
    if has_column(df, name):
        raise ValueError(f"Column '{name}' already exists")
    if row_function is not None:
        return df.withColumn(name, _row_udf(row_function, return_type)(F.struct(*[df[f"`{c}`"] for c in df.columns])))
    return df.withColumn(name, _default_column(df, ColumnOperation("add", name, default=default, expr=expr)))


def _row_udf(fn: Callable[[dict], Any], return_type):
    @F.pandas_udf(return_type)
    def apply(rows: pd.DataFrame) -> pd.Series:
        out = []
        for rec in rows.to_dict("records"):
            try:
                out.append(fn(rec))
            except Exception:  # noqa: BLE001 - a failing default is null
                out.append(None)
        return pd.Series(out)
    return apply


def remove_column(df: DataFrame, name: str) -> DataFrame:
    """Silent when absent."""
    return df.drop(name) if has_column(df, name) else df


def rename_column(df: DataFrame, name: str, new_name: str) -> DataFrame:
    """Keeps the column's position."""
    if not name or not new_name:
        raise ValueError("Rename operation requires a column name and newName")
    if not has_column(df, name):
        raise ValueError(f"Column '{name}' does not exist")
    if has_column(df, new_name):
        raise ValueError(f"Column '{new_name}' already exists")
    return df.withColumnRenamed(name, new_name)


def apply_operation(df: DataFrame, op: ColumnOperation) -> DataFrame:
    if op.type == "add":
        return add_column(df, op.column, op.default, op.expr)
    if op.type == "remove":
        return remove_column(df, op.column)
    if op.type == "rename":
        return rename_column(df, op.column, op.new_name)
    raise ValueError(f"Unknown operation type: {op.type}")


def column_operations(df: DataFrame, ops: Sequence[ColumnOperation]) -> DataFrame:
    """Ordered chain of add / remove / rename."""
    return reduce(apply_operation, ops, df)


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """P5: listed columns first, the rest after in their old order."""
    missing = [c for c in order if not has_column(df, c)]
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    rest = [c for c in df.columns if c not in order]
    return df.select(*[df[c] for c in list(order) + rest])


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly these columns."""
    missing = [c for c in names if not has_column(df, c)]
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    return df.select(*[df[c] for c in names])


def transform_column(df: DataFrame, name: str, fn: Column | str | Callable, order_by=None,
                     return_type: T.DataType | None = None) -> DataFrame:
    """New value from the old one.

    ``fn`` is best a function ``(value, row, index) -> Column`` or a SQL expression over
    ``value``; both stay in the JVM. A plain Python function ``value -> value``, or one of
    ``(value, row, index)`` marked by ``row_fn``, runs on Arrow batches and keeps the old value where
    it raises or gives what the column's type (``return_type``, by default the old one) cannot hold; ``row``
    is a dict of the row's values. ``index`` is the position under ``order_by``, and None without.
    """
    if not has_column(df, name):
        raise ValueError(f"Column '{name}' does not exist")
    cols = df.columns
    if isinstance(fn, str):
        # the old value is bound as a column called value; a column of that name gives way to it
        bound = df.select(*[F.col(f"`{c}`") for c in cols if c != "value"], F.col(f"`{name}`").alias("value"),
                          *([F.col("`value`").alias("_q_value")] if "value" in cols else []))
        keep = {"value": "_q_value"}
        return bound.select(*[F.expr(fn).alias(c) if c == name else F.col(f"`{keep.get(c, c)}`").alias(c) for c in cols])
    if isinstance(fn, Column):
        return df.select(*[fn.alias(c) if c == name else df[c] for c in cols])
    if getattr(fn, "_quire_column_fn", False) or _takes_columns(fn) and not getattr(fn, "_quire_row_fn", False):
        base = with_ordinal(df, order_by, "_q_idx") if order_by is not None else df
        row = {c: base[c] for c in cols}
        idx = base["_q_idx"] if order_by is not None else None
        new = fn(base[name], row, idx)
        return base.select(*[new.alias(c) if c == name else base[c] for c in cols])
    wide = getattr(fn, "_quire_row_fn", False)
    base = with_ordinal(df, order_by, "_q_idx") if wide and order_by is not None else df
    fields = [T.StructField(f.name, return_type or f.dataType) if f.name == name else f for f in df.schema.fields]
    ship_package(df.sparkSession)
    return base.mapInArrow(partial(_transformed, fn, wide, name, to_arrow_type(return_type or df.schema[name].dataType)),
                           T.StructType(fields))


def _transformed(fn: Callable, wide: bool, name: str, kind: pa.DataType, batches: Iterator[pa.RecordBatch]
                 ) -> Iterator[pa.RecordBatch]:
    """Batches with a column passed through a Python function, row by row."""
    for b in batches:
        names = [n for n in b.schema.names if n != "_q_idx"]
        index = b.column(b.schema.names.index("_q_idx")).to_pylist() if "_q_idx" in b.schema.names else [None] * b.num_rows
        rows = b.select(names).to_pylist() if wide else [None] * b.num_rows
        old, new = b.column(names.index(name)).to_pylist(), []
        for value, row, i in zip(old, rows, index):
            try:
                got = fn(value, row, i) if wide else fn(value)
                pa.scalar(got, kind)
            except Exception:  # noqa: BLE001 - the old value is kept, as the tool does
                got = _held(value, kind)
            new.append(got)
        yield pa.RecordBatch.from_arrays([pa.array(new, kind) if n == name else b.column(b.schema.names.index(n)) for n in names],
                                         names)


def _held(value: Any, kind: pa.DataType) -> Any:
    """A value if a type can hold it, as it is or as text."""
    try:
        pa.scalar(value, kind)
        return value
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return str(value) if pa.types.is_string(kind) else None


def row_fn(fn: Callable) -> Callable:
    """Mark a Python function of (value, row, index)."""
    fn._quire_row_fn = True
    return fn


def column_fn(fn: Callable) -> Callable:
    """Mark ``fn(value, row, index) -> Column`` as a native column function."""
    fn._quire_column_fn = True
    return fn


def _takes_columns(fn) -> bool:
    try:
        import inspect
        return len(inspect.signature(fn).parameters) == 3
    except (TypeError, ValueError):
        return False


def _trim_js(c: Column) -> Column:
    return js_trim(c)


def split_column(df: DataFrame, source: str, delimiter: str, new_names: Sequence[str]) -> DataFrame:
    """Literal delimiter, parts trimmed, extra parts dropped, missing parts null."""
    if not has_column(df, source):
        raise ValueError(f"Column '{source}' does not exist")
    clash = [n for n in new_names if has_column(df, n)]
    if clash:
        raise ValueError(f"Column names already exist: {', '.join(clash)}")
    src = df[source]
    if not isinstance(df.schema[source].dataType, T.StringType):
        return df.select("*", *[F.lit(None).cast("string").alias(n) for n in new_names])
    parts = F.split(src, "\\Q" + delimiter + "\\E", -1)
    valid = src.isNotNull() & (src != "")
    return df.select("*", *[F.when(valid, _trim_js(F.try_element_at(parts, F.lit(i + 1)))).alias(n)
                            for i, n in enumerate(new_names)])


def merge_columns(df: DataFrame, sources: Sequence[str], target: str, separator: str = " ") -> DataFrame:
    """Non-empty values joined by ``separator``; null when none remain."""
    missing = [c for c in sources if not has_column(df, c)]
    if missing:
        raise ValueError(f"Source columns not found: {', '.join(missing)}")
    if has_column(df, target):
        raise ValueError(f"Column '{target}' already exists")
    texts = [F.nullif(js_string(df[c], df.schema[c].dataType), F.lit("")) for c in sources]
    return df.withColumn(target, F.nullif(F.concat_ws(separator, *texts), F.lit("")))


def validate_operations(df: DataFrame, ops: Sequence[ColumnOperation]) -> Report:
    """Checks each operation against the schema as it is at that step."""
    rep = Report()
    cols = list(df.columns)
    for i, op in enumerate(ops, 1):
        p = f"Operation {i}"
        if not op.type:
            rep.errors.append(f"{p}: Missing operation type")
            continue
        if not op.column:
            rep.errors.append(f"{p}: Column name is required")
            continue
        if op.type == "remove":
            if op.column not in cols:
                rep.warnings.append(f"{p}: Column '{op.column}' does not exist")
            else:
                cols.remove(op.column)
        elif op.type == "rename":
            if op.column not in cols:
                rep.errors.append(f"{p}: Column '{op.column}' does not exist")
            if not op.new_name:
                rep.errors.append(f"{p}: Rename operation requires newName")
            elif op.new_name in cols:
                rep.errors.append(f"{p}: Target column '{op.new_name}' already exists")
            if op.column in cols and op.new_name and op.new_name not in cols:
                cols[cols.index(op.column)] = op.new_name
        elif op.type == "add":
            if op.column in cols:
                rep.errors.append(f"{p}: Column '{op.column}' already exists")
            else:
                cols.append(op.column)
        else:
            rep.errors.append(f"{p}: Unknown operation type: {op.type}")
    return rep


# ---------------------------------------------------------------------------------------
# A1 column statistics
# ---------------------------------------------------------------------------------------

LONG_KEY = 64       # bytes; longer values are told apart by their SHA-256


def _identity(c: Column, dt: T.DataType) -> Column | None:
    """Text that tells values of a type apart, where ``js_string`` may not; None where it does."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")          # one zero
    if isinstance(dt, (T.DecimalType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("string")
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return None


def _first_rows(table: pa.Table, order: list[str], texts: list[str], k: int) -> pa.Table:
    """The rows that hold one of the first ``k`` values of any column, nulls apart."""
    by = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order]).to_numpy()
    wanted = [by[np.flatnonzero(table[c].is_valid().to_numpy()[by])[:k]] for c in texts]
    return table.take(pa.array(np.unique(np.concatenate(wanted))) if wanted else pa.array([], pa.int64()))


def _column_state(places: list[str], order: list[str], texts: list[str], keys: list[str], k: int, distinct: bool,
                  batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mergeable states of all columns, in one run over a partition: each batch's values, once each; then, for the
    whole partition, the number of nulls and the first ``k`` values with their places."""
    best, nulls, place_type = None, [0] * len(texts), None

    def packed(pos, key, count, place, text):
        n = len(pos)
        return pa.RecordBatch.from_arrays(
            [pa.array(pos, pa.int32()), key if key is not None else pa.nulls(n, pa.binary()),
             count if count is not None else pa.nulls(n, pa.int64()), place if place is not None else pa.nulls(n, place_type),
             text if text is not None else pa.nulls(n, pa.string())], ["pos", "key", "nulls", "place", "text"])

    for b in batches:
        table = pa.Table.from_batches([b])
        place_type = pa.struct([b.schema.field(p) for p in places])
        for i, c in enumerate(keys):
            column = table[c].combine_chunks()
            nulls[i] += column.null_count
            if distinct:
                values = pc.unique(column.drop_null()).cast(pa.binary())
                long = pc.greater(pc.binary_length(values), LONG_KEY)
                if pc.any(long).as_py():
                    values = pa.array([b"#" + hashlib.sha256(v).digest() if len(v) > LONG_KEY else v
                                       for v in values.to_pylist()], pa.binary())
                yield packed(np.full(len(values), i), values, None, None, None)
        rows = table.select([*dict.fromkeys([*places, *order, *texts])])
        best = _first_rows(rows if best is None else pa.concat_tables([best, rows]), order, texts, k)
    if best is None:
        return
    yield packed(np.arange(len(texts)), None, pa.array(nulls, pa.int64()), None, None)
    place = pa.StructArray.from_arrays([best[p].combine_chunks() for p in places], fields=list(place_type))
    for i, c in enumerate(texts):
        at = np.flatnonzero(best[c].is_valid().to_numpy())
        if len(at):
            yield packed(np.full(len(at), i), None, None, place.take(pa.array(at)), best[c].combine_chunks().take(pa.array(at)))


def column_statistics(df: DataFrame, order_by=None, samples: int = 3, approx: bool = False) -> DataFrame:
    """One row per column: name, type, null_count, unique_count, sample_values.

    One scan, whatever the number of columns: tasks make mergeable states (each column's values once
    a batch, nulls, and the first ``samples`` values under ``order_by``, which are not null, with their places),
    equal values are combined before the shuffle, and a row a column is left. Exact distinct counts, or
    HyperLogLog++ over the same states with ``approx=True``. Values of more than 64 bytes are told apart by
    SHA-256. Without ``order_by`` the samples are the first rows of the table as it is read.
    """
    ship_package(df.sparkSession)
    fields = df.schema.fields
    row = F.monotonically_increasing_id().alias("row")
    sort = sort_columns(order_by) if order_by is not None else []
    cols = [c.alias(f"o{i}") for i, c in enumerate(sort)] + [c.isNotNull().alias(f"f{i}") for i, c in enumerate(sort)]
    texts, keys = [], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        cols.append(js_string(c, f.dataType).alias(f"t{i}"))
        texts.append(f"t{i}")
        own = _identity(c, f.dataType)
        keys.append(f"t{i}" if own is None else f"d{i}")
        cols += [] if own is None else [own.alias(f"d{i}")]
    given = df.select(row, *cols)
    places = [*(f"o{i}" for i in range(len(sort))), "row"]
    order = [*(f"{k}{i}" for i in range(len(sort)) for k in "fo"), "row"]        # nulls first, as Spark sorts
    place = T.StructType([given.schema[p] for p in places]).simpleString()
    state = given.mapInArrow(partial(_column_state, places, order, texts, keys, samples, True),
                             f"pos int, key binary, nulls long, place {place}, text string")
    if not approx:
        state = state.groupBy("pos", "key", "place", "text").agg(F.sum("nulls").alias("nulls"))
    first = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "text"))))
    found = state.groupBy("pos").agg(F.sum("nulls").alias("nulls"),
                                     (F.approx_count_distinct("key") if approx else F.count("key")).alias("n"),
                                     F.transform(F.slice(first, 1, samples), lambda s: s["text"]).alias("sample_values"))
    named = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("name"), F.lit(js_typeof(f.dataType)).alias("t"))
                      for i, f in enumerate(fields)])
    rows = df.sparkSession.range(1, numPartitions=1).select(F.explode(named).alias("s")).select("s.*")
    # typeof of the values seen; "mixed" when none was seen
    seen = F.coalesce("sample_values", F.array().cast("array<string>"))
    return (rows.join(found, "pos", "left")
            .select("pos", "name", F.when(F.size(seen) > 0, F.col("t")).otherwise(F.lit("mixed")).alias("type"),
                    F.coalesce("nulls", F.lit(0)).alias("null_count"), F.coalesce("n", F.lit(0)).alias("unique_count"),
                    seen.alias("sample_values"))
            .orderBy("pos"))
