"""Row filters, de-duplication and sampling (F1-F16), their plan-time check (V10) and
filter statistics (A2).

All predicates are built once on the driver from the schema and become one ``Filter``
node; typed comparisons stay plain comparisons so Catalyst pushes them into the scan.
Order-dependent operators take ``order_by`` (a total order) because Spark rows have none.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jscompat import (js_compare, js_compare_columns, js_compare_py, js_date_ms_py, js_number_py,
                                  js_string, js_string_py, js_trim, ms_to_iso)
from ..functions.ordinal import key_ordinals, rows_at, sort_columns

log = logging.getLogger(__name__)

COLUMN_OPERATORS = ("equals", "contains", "greaterThan", "lessThan", "between")
# Condition operators in the order they are searched for ("!==" is read as "!=").
CONDITION_OPERATORS = ("!==", ">=", "<=", "!=", "===", "==", ">", "<")


@dataclass(frozen=True)
class ColumnFilter:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class DateRange:
    column: str
    start: Any
    end: Any


@dataclass(frozen=True)
class FilterCriteria:
    column_filters: tuple = ()
    date_range: DateRange | None = None
    custom_conditions: tuple = ()


@dataclass
class Report:
    errors: list = field(default_factory=list)
    warnings: list = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def _and(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def has_column(df: DataFrame, name: str) -> bool:
    """Case-sensitive lookup (decision D31): Spark resolves names case-insensitively."""
    return name in df.columns


# ---------------------------------------------------------------------------------------
# F2-F7 column filters
# ---------------------------------------------------------------------------------------

def column_filter_predicate(df: DataFrame, flt: ColumnFilter) -> Column:
    if flt.operator not in COLUMN_OPERATORS:
        raise ValueError(f"Unknown filter operator: {flt.operator}")
    if flt.operator == "between" and (not isinstance(flt.value, (list, tuple)) or len(flt.value) != 2):
        raise ValueError("Between operator requires an array of two values")
    if not has_column(df, flt.column):
        return F.lit(False)  # D6: an unknown column keeps no rows
    c, dt = df[flt.column], _dtype(df, flt.column)
    if flt.operator == "equals":
        pred = js_compare(c, dt, flt.value, "==")
    elif flt.operator == "contains":
        pred = F.lower(js_string(c, dt)).contains(js_string_py(flt.value).lower())
    elif flt.operator == "greaterThan":
        pred = js_compare(c, dt, flt.value, ">")
    elif flt.operator == "lessThan":
        pred = js_compare(c, dt, flt.value, "<")
    else:
        lo, hi = flt.value
        pred = js_compare(c, dt, lo, ">=") & js_compare(c, dt, hi, "<=")
    return c.isNotNull() & pred  # D4: null never matches


# ---------------------------------------------------------------------------------------
# F8 date range
# ---------------------------------------------------------------------------------------

def date_range_predicate(df: DataFrame, rng: DateRange) -> Column:
    lo, hi = js_date_ms_py(rng.start), js_date_ms_py(rng.end)
    if lo is None or hi is None or rng.start in (None, "") or rng.end in (None, ""):
        raise ValueError("Invalid date format in date range filter")
    if not has_column(df, rng.column):
        return F.lit(False)
    c, dt = df[rng.column], _dtype(df, rng.column)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        target = "timestamp_ntz" if isinstance(dt, T.TimestampNTZType) else "timestamp"
        return c.isNotNull() & (c >= F.lit(ms_to_iso(lo)).cast(target)) & (c <= F.lit(ms_to_iso(hi)).cast(target))
    if isinstance(dt, T.DateType):
        ts = c.cast("timestamp")
    elif isinstance(dt, T.StringType):
        ts = js_trim(c).try_cast("timestamp")
        c = F.when(c != "", c)
    elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                         T.DecimalType)):
        ts = F.timestamp_millis(c.cast("long"))
        c = F.when(c != 0, c)
    else:
        return F.lit(False)
    lo_c, hi_c = F.lit(ms_to_iso(lo)).cast("timestamp"), F.lit(ms_to_iso(hi)).cast("timestamp")
    return c.isNotNull() & ts.isNotNull() & (ts >= lo_c) & (ts <= hi_c)


# ---------------------------------------------------------------------------------------
# F9 custom conditions
# ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Operand:
    column: str | None = None
    value: Any = None


def _resolve(token: str, columns: Sequence[str]) -> _Operand:
    """Number/boolean/null literal, column (only when unquoted, D9 fix) or text."""
    quoted = bool(re.match(r"^['\"]|.*['\"]$", token)) if token else False
    text = re.sub(r"^['\"]|['\"]$", "", token)
    num = js_number_py(text)
    if num is not None:
        return _Operand(value=num)
    if text == "true":
        return _Operand(value=True)
    if text == "false":
        return _Operand(value=False)
    if text == "null":
        return _Operand(value=None)
    if not quoted and text in columns:
        return _Operand(column=text)
    return _Operand(value=text)


def parse_condition(condition: str) -> tuple[str, str, str] | None:
    """Split ``left op right``; ``None`` when no operator or not exactly two sides."""
    if not isinstance(condition, str):
        return None
    for op in CONDITION_OPERATORS:
        if op in condition:
            parts = [p.strip() for p in condition.split(op)]
            if len(parts) != 2:
                return None
            return parts[0], ("!=" if op == "!==" else op), parts[1]
    return None


def custom_condition_predicate(df: DataFrame, condition: str) -> Column:
    parsed = parse_condition(condition)
    if parsed is None:
        log.warning("Invalid custom condition format: %r (row kept)", condition)
        return F.lit(True)  # D7
    left_s, op, right_s = parsed
    left, right = _resolve(left_s, df.columns), _resolve(right_s, df.columns)

    if right_s == "null":
        if left.column is None:
            is_null = left.value is None
            return F.lit(is_null if op in ("==", "===") else (not is_null) if op == "!=" else False)
        c = df[left.column]
        if op in ("==", "==="):
            return c.isNull()
        if op == "!=":
            return c.isNotNull()
        return F.lit(False)

    negate = op == "!="
    cmp_op = "==" if op in ("==", "===", "!=") else op

    if left.column is None and right.column is None:
        res = js_compare_py(left.value, right.value, cmp_op)
        return F.lit((not res) if negate else res)
    if left.column is not None and right.column is not None:
        pred = js_compare_columns(df[left.column], _dtype(df, left.column), df[right.column],
                                  _dtype(df, right.column), cmp_op)
        return ~pred if negate else pred
    if left.column is not None:
        col, lit_v, eff_op = left.column, right.value, cmp_op
    else:
        flip = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "==": "=="}
        col, lit_v, eff_op = right.column, left.value, flip[cmp_op]
    c, dt = df[col], _dtype(df, col)
    when_null = js_compare_py(None, lit_v, eff_op)  # D5: null is Number(null) = 0 etc.
    pred = js_compare(c, dt, lit_v, eff_op)
    if negate:
        pred, when_null = ~pred, not when_null
    return (c.isNull() | pred) if when_null else (c.isNotNull() & pred)


# ---------------------------------------------------------------------------------------
# F1 filter_data
# ---------------------------------------------------------------------------------------

def criteria_predicate(df: DataFrame, criteria: FilterCriteria) -> Column:
    preds = [column_filter_predicate(df, f) for f in criteria.column_filters]
    if criteria.date_range is not None:
        preds.append(date_range_predicate(df, criteria.date_range))
    preds += [custom_condition_predicate(df, c) for c in criteria.custom_conditions]
    return _and(preds)


def filter_data(df: DataFrame, criteria: FilterCriteria) -> DataFrame:
    """AND of column filters, date range and custom conditions as a single Filter node."""
    return df.filter(criteria_predicate(df, criteria))


# ---------------------------------------------------------------------------------------
# F10-F16
# ---------------------------------------------------------------------------------------

def _missing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if not has_column(df, n)]


def filter_null_values(df: DataFrame, columns: Sequence[str], remove_nulls: bool = True) -> DataFrame:
    """Drop rows with a null or '' in any listed column; ``remove_nulls=False`` keeps only those."""
    missing = _missing(df, columns)
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    conds = []
    for n in columns:
        c = df[n]
        conds.append(c.isNull() | (c == "") if isinstance(_dtype(df, n), T.StringType) else c.isNull())
    has_null = reduce(lambda a, b: a | b, conds) if conds else F.lit(False)
    return df.filter(~has_null if remove_nulls else has_null)


def filter_unique(df: DataFrame, column: str, order_by) -> DataFrame:
    """First row (under ``order_by``) per value of ``column``; nulls form one group.

    ``min_by`` on the order keys per group: partial aggregation runs map-side, so even a
    value holding a third of all rows reaches the shuffle as one row per map task. Only the
    keys are compared, so rows may hold columns without an order (maps, variants).
    """
    if not has_column(df, column):
        raise ValueError(f"Column '{column}' does not exist")
    keys = sort_columns(order_by)
    cols = df.columns
    order = F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    group = F.col(f"`{column}`")
    if _holds(df.schema[column].dataType, (T.MapType, T.VariantType)):
        group = _comparable(group, df.schema[column].dataType)
    return (df.groupBy(group.alias("_q_g")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), order).alias("_m"))
            .select(*[F.col("_m").getField(c).alias(c) for c in cols]))


def _holds(dt: T.DataType, kinds: tuple) -> bool:
    """Whether a type is, or holds at any depth, one of ``kinds``."""
    if isinstance(dt, kinds):
        return True
    if isinstance(dt, T.StructType):
        return any(_holds(f.dataType, kinds) for f in dt.fields)
    return isinstance(dt, T.ArrayType) and _holds(dt.elementType, kinds)


def _comparable(c: Column, dt: T.DataType) -> Column:
    """A value that can be grouped by: JSON text, with the entries of a map in the order of their keys."""
    if isinstance(dt, T.MapType):
        return F.to_json(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
            e["key"].cast("string").alias("key"), F.to_json(F.struct(e["value"].alias("v"))).alias("value")))))
    if isinstance(dt, T.VariantType):
        return F.to_json(c)
    if isinstance(dt, T.StructType) and _holds(dt, (T.MapType, T.VariantType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(*[_comparable(c.getField(f.name), f.dataType).alias(f"f{i}")
                                                          for i, f in enumerate(dt.fields)])))
    if isinstance(dt, T.ArrayType) and _holds(dt, (T.MapType, T.VariantType)):
        return F.to_json(F.transform(c, lambda x: _comparable(x, dt.elementType)))
    return c


def filter_duplicates(df: DataFrame) -> DataFrame:
    """One row per group of fully equal rows (hash aggregate with map-side combine)."""
    hashed = [f.name for f in df.schema.fields if _holds(f.dataType, (T.MapType, T.VariantType))]
    if not hashed:
        return df.dropDuplicates()
    keyed = df
    for n in hashed:
        keyed = keyed.withColumn(f"_q_h_{n}", _comparable(F.col(f"`{n}`"), df.schema[n].dataType))
    subset = [c for c in df.columns if c not in hashed] + [f"_q_h_{n}" for n in hashed]
    return keyed.dropDuplicates(subset).drop(*[f"_q_h_{n}" for n in hashed])


def sample_every_nth(df: DataFrame, n: int, order_by) -> DataFrame:
    if n == 0:
        return df.limit(0)  # index % 0 is NaN: no row qualifies
    return rows_at(df, order_by, key_ordinals(df, order_by), F.col("ordinal") % abs(n) == 0)


def sample_random(df: DataFrame, n: int, seed: int | None = None, key_columns: Sequence[str] | None = None) -> DataFrame:
    """Exactly min(n, rows) rows. With a seed the choice is the n smallest
    ``md5('<seed>:<keys>')`` (reproducible, D12); without, ``rand()``. Top-n per partition
    then a merge of at most n rows per partition (TakeOrderedAndProject)."""
    if n <= 0:
        return df.limit(0)
    if seed is None:
        return df.orderBy(F.rand()).limit(n)
    keys = [F.col(k).cast("string") for k in (key_columns or df.columns)]
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))).limit(n)


def sample_first(df: DataFrame, n: int, order_by) -> DataFrame:
    return df.orderBy(*sort_columns(order_by)).limit(max(n, 0))


def sample_last(df: DataFrame, n: int, order_by) -> DataFrame:
    """Last n rows under ``order_by`` (n = 0 gives no rows, D11)."""
    if n <= 0:
        return df.limit(0)
    keys = sort_columns(order_by)
    return df.orderBy(*[k.desc() for k in keys]).limit(n).orderBy(*keys)


def filter_sample(df: DataFrame, kind: str, count: int, order_by=None, seed: int | None = None,
                  key_columns: Sequence[str] | None = None) -> DataFrame:
    if kind == "every_nth":
        return sample_every_nth(df, count, order_by)
    if kind == "random":
        return sample_random(df, count, seed, key_columns)
    if kind == "first":
        return sample_first(df, count, order_by)
    if kind == "last":
        return sample_last(df, count, order_by)
    raise ValueError(f"Unknown sample type: {kind}")


# ---------------------------------------------------------------------------------------
# A2 filter statistics, V10 criteria check
# ---------------------------------------------------------------------------------------

def percent_round(x: Column) -> Column:
    """Math.round(x * 100) / 100."""
    return F.floor(x * 100 + 0.5) / 100


def filter_statistics(df: DataFrame, predicate: Column | FilterCriteria) -> DataFrame:
    """Original, kept and removed row counts and removal percentage in one pass."""
    pred = criteria_predicate(df, predicate) if isinstance(predicate, FilterCriteria) else predicate
    counts = df.agg(F.count(F.lit(1)).alias("original_rows"), F.count_if(pred).alias("filtered_rows"))
    removed = F.col("original_rows") - F.col("filtered_rows")
    return counts.select(
        "original_rows", "filtered_rows", removed.alias("removed_rows"),
        F.when(F.col("original_rows") > 0, percent_round(removed / F.col("original_rows") * 100))
        .otherwise(F.lit(0.0)).cast("double").alias("removal_percentage"))


def validate_filter_criteria(df: DataFrame, criteria: FilterCriteria) -> Report:
    """Plan-time check of criteria against the schema (no pass over the data)."""
    rep = Report()
    for i, f in enumerate(criteria.column_filters, 1):
        if not f.column:
            rep.errors.append(f"Column filter {i}: Column name is required")
        elif not has_column(df, f.column):
            rep.errors.append(f"Column filter {i}: Column '{f.column}' does not exist")
        if not f.operator:
            rep.errors.append(f"Column filter {i}: Operator is required")
        if f.value is None:
            rep.warnings.append(f"Column filter {i}: Filter value is undefined")
        if f.operator == "between" and (not isinstance(f.value, (list, tuple)) or len(f.value) != 2):
            rep.errors.append(f"Column filter {i}: Between operator requires an array of two values")
    r = criteria.date_range
    if r is not None:
        if not r.column:
            rep.errors.append("Date range filter: Date column is required")
        elif not has_column(df, r.column):
            rep.errors.append(f"Date range filter: Column '{r.column}' does not exist")
        if not r.start:
            rep.errors.append("Date range filter: Start date is required")
        elif js_date_ms_py(r.start) is None:
            rep.errors.append("Date range filter: Invalid start date format")
        if not r.end:
            rep.errors.append("Date range filter: End date is required")
        elif js_date_ms_py(r.end) is None:
            rep.errors.append("Date range filter: Invalid end date format")
        if r.start and r.end:
            a, b = js_date_ms_py(r.start), js_date_ms_py(r.end)
            if a is not None and b is not None and a > b:
                rep.warnings.append("Date range filter: Start date is after end date")
    for i, c in enumerate(criteria.custom_conditions, 1):
        if not c or not isinstance(c, str):
            rep.errors.append(f"Custom condition {i}: Condition must be a non-empty string")
        elif not any(op in c for op in CONDITION_OPERATORS):
            rep.warnings.append(f"Custom condition {i}: No recognized operator found in '{c}'")
        elif parse_condition(c) is None:
            rep.warnings.append(f"Custom condition {i}: Cannot be parsed into 'left op right' in '{c}'")
    return rep
