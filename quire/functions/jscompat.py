"""Loose value semantics of the source tool, as native Spark column expressions.

The tool compares untyped values: it tries a numeric comparison, then a date comparison,
then a text comparison, per pair of values. Spark columns carry one type each, so the
column's type (known when the plan is built) picks the branch. For typed columns the
comparison collapses to a plain ``col <op> literal`` that Catalyst pushes into the scan;
only string columns keep the runtime ``when`` ladder.

No Python runs per row: every helper returns a ``Column``.
"""

from __future__ import annotations

import datetime as _dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The number syntax accepted by the tool's Number(text) conversion.
DECIMAL_NUMBER_RE = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"
HEX_NUMBER_RE = r"^0[xX][0-9a-fA-F]+$"
BINARY_NUMBER_RE = r"^0[bB][01]+$"
OCTAL_NUMBER_RE = r"^0[oO][0-7]+$"
INFINITY_RE = r"^[+-]?Infinity$"
# ISO-8601 dates and date-times; the only date text accepted (decision D3).
ISO_DATE_RE = (r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
               r"(Z|[+-]\d{2}:?\d{2})?)?)?)?$")

OPS = ("==", ">", "<", ">=", "<=")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


# ---------------------------------------------------------------------------------------
# Driver-side conversions of literals (run once per plan, never per row)
# ---------------------------------------------------------------------------------------

def js_number_py(v) -> float | None:
    """Number(v) for a literal; ``None`` stands for NaN."""
    if v is None:
        return 0.0
    if isinstance(v, bool):
        return 1.0 if v else 0.0
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return float(js_date_ms_py(v))
    s = str(v).strip()
    if s == "":
        return 0.0
    if re.match(DECIMAL_NUMBER_RE, s):
        return float(s)
    if re.match(HEX_NUMBER_RE, s):
        return _int_to_double(int(s[2:], 16))
    if re.match(BINARY_NUMBER_RE, s):
        return _int_to_double(int(s[2:], 2))
    if re.match(OCTAL_NUMBER_RE, s):
        return _int_to_double(int(s[2:], 8))
    if re.match(INFINITY_RE, s):
        return -math.inf if s.startswith("-") else math.inf
    return None


def _int_to_double(n: int) -> float:
    try:
        return float(n)
    except OverflowError:
        return math.inf


def js_date_ms_py(v) -> int | None:
    """new Date(v).getTime() for a literal: numbers are epoch ms, text must be ISO-8601."""
    if v is None:
        return 0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return None if (isinstance(v, float) and (math.isnan(v) or math.isinf(v))) else int(v)
    if isinstance(v, _dt.datetime):
        if v.tzinfo is None:
            v = v.replace(tzinfo=_dt.timezone.utc)
        return int(v.timestamp() * 1000)
    if isinstance(v, _dt.date):
        return int(_dt.datetime(v.year, v.month, v.day, tzinfo=_dt.timezone.utc).timestamp() * 1000)
    m = re.match(ISO_DATE_RE, str(v).strip())
    if not m:
        return None
    y, mo, d, hh, mi, ss, frac, tz = m.groups()
    try:
        base = _dt.datetime(int(y), int(mo or 1), int(d or 1), int(hh or 0), int(mi or 0), int(ss or 0),
                            tzinfo=_dt.timezone.utc)
    except ValueError:
        return None
    ms = int(base.timestamp() * 1000) + (int((frac or "0").ljust(3, "0")[:3]) if frac else 0)
    if tz and tz != "Z":
        sign = 1 if tz[0] == "+" else -1
        digits = tz[1:].replace(":", "")
        ms -= sign * (int(digits[:2]) * 60 + int(digits[2:])) * 60_000
    return ms


def js_string_py(v) -> str:
    """String(v) for a literal."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        if v == int(v) and abs(v) < 1e21:
            return str(int(v))
        return repr(v)
    return str(v)


def ms_to_iso(ms: float) -> str:
    t = _dt.datetime(1970, 1, 1) + _dt.timedelta(milliseconds=ms)
    return t.strftime("%Y-%m-%d %H:%M:%S.%f")


# ---------------------------------------------------------------------------------------
# Column expressions
# ---------------------------------------------------------------------------------------

# The whitespace characters trimmed from text (space, tab, LF, CR, FF, VT).
WHITESPACE = " \t\n\r\f\u000b"


def js_trim(c: Column) -> Column:
    """String.prototype.trim for the ASCII whitespace set, as a native ``btrim``."""
    return F.btrim(c, F.lit(WHITESPACE))


_js_trim = js_trim


def _digits_to_double(s: Column, bits: int) -> Column:
    """The nearest double of a prefixed text of any length whose digits hold ``bits`` bits each. The first 60
    bits decide it, with their last bit set if anything follows them; the rest is a power of two."""
    digits = F.regexp_replace(s, "^0[a-zA-Z]0*", "")
    n = 60 // bits
    rest = F.substring(digits, n + 1, 1 << 30)
    lead = F.coalesce(F.conv(F.substring(digits, 1, n), 1 << bits, 10).cast("long"), F.lit(0).cast("long"))
    lead = lead.bitwiseOR(F.when(rest.rlike("[^0]"), 1).otherwise(0).cast("long"))
    return lead.cast("double") * F.pow(F.lit(2.0), F.length(rest) * bits)


def js_number(c: Column, dtype: T.DataType) -> Column:
    """Number(value) as a double column; NULL stands for NaN. A NULL input gives 0."""
    if isinstance(dtype, NUMERIC_TYPES):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    if isinstance(dtype, TIME_TYPES):
        return F.coalesce(F.unix_millis(c.cast("timestamp")).cast("double"), F.lit(0.0))
    if isinstance(dtype, T.StringType):
        s = _js_trim(c)
        return (F.when(c.isNull() | (s == ""), F.lit(0.0))
                .when(s.rlike(DECIMAL_NUMBER_RE), s.try_cast("double"))
                .when(s.rlike(HEX_NUMBER_RE), _digits_to_double(s, 4))
                .when(s.rlike(BINARY_NUMBER_RE), _digits_to_double(s, 1))
                .when(s.rlike(OCTAL_NUMBER_RE), _digits_to_double(s, 3))
                .when(s.rlike(INFINITY_RE),
                      F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))
    return F.lit(None).cast("double")


def double_to_js_string(d: Column) -> Column:
    """String(x) for doubles: shortest text, no trailing ``.0``, plain notation from 1e-6 up to
    1e21 and exponent notation outside (``1e+21``, ``1.5e-7``)."""
    fixed = d.cast("string").try_cast("decimal(38,18)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(d), F.lit("NaN"))
            .when(d == float("inf"), F.lit("Infinity"))
            .when(d == float("-inf"), F.lit("-Infinity"))
            .when(d == 0, F.lit("0"))
            .when((F.abs(d) >= 1e-6) & (F.abs(d) < 1e20), trimmed)
            .when((F.abs(d) >= 1e20) & (F.abs(d) < 1e21), d.cast("decimal(38,0)").cast("string"))
            .otherwise(_exponent_form(d.cast("string"))))


def _exponent_form(s: Column) -> Column:
    """Spark's ``1.5E21`` / ``1.0E-7`` as the tool prints them: ``1.5e+21`` / ``1e-7``."""
    s = F.regexp_replace(s, r"\.0E", "E")
    s = F.regexp_replace(s, r"E(\d)", "e+$1")
    return F.regexp_replace(s, "E-", "e-")


def iso_instant(c: Column) -> Column:
    """ISO text of an instant: three digits of a second, or six where it has microseconds. Times
    without a zone are UTC."""
    return F.concat(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "000$", ""), F.lit("Z"))


def js_string(c: Column, dtype: T.DataType) -> Column:
    """String(value) as a string column (NULL stays NULL; callers decide what null means)."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, INTEGRAL_TYPES) or isinstance(dtype, T.BooleanType):
        return c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return double_to_js_string(c.cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_instant(c)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd'T'00:00:00.000'Z'")
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def js_typeof(dtype: T.DataType) -> str:
    """typeof for the values of a column of this type."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, NUMERIC_TYPES):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "object"


def _cmp(a: Column, b, op: str) -> Column:
    if op == "==":
        return a == b
    if op == ">":
        return a > b
    if op == "<":
        return a < b
    if op == ">=":
        return a >= b
    if op == "<=":
        return a <= b
    raise ValueError(f"unknown comparison operator {op!r}")


def _ts_literal(ms: float, dtype: T.DataType) -> Column:
    target = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    return F.lit(ms_to_iso(ms)).cast(target)


def bind(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once: the ladder refers to its input many times, and
    Catalyst inlines projected expressions into filters, so the value is bound to a lambda
    variable (a one-element ``transform``) instead of being re-derived per reference."""
    return F.transform(F.array(c), fn).getItem(0)


def js_compare(c: Column, dtype: T.DataType, value, op: str) -> Column:
    """Loose ``c <op> value`` (number, then date, then text), decided per plan where possible.

    ``value`` is a Python literal. A NULL column value gives NULL, which a filter drops.
    """
    op = "==" if op in ("===", "=") else op
    if op not in OPS:
        raise ValueError(f"unknown comparison operator {op!r}")
    num = js_number_py(value)
    ms = js_date_ms_py(value)
    text = js_string_py(value)

    if isinstance(dtype, (NUMERIC_TYPES, T.BooleanType)):
        col = c.cast("int") if isinstance(dtype, T.BooleanType) else c
        if num is not None:
            return _cmp(col, F.lit(num), op)
        if ms is not None:
            return _cmp(col, F.lit(float(ms)), op)
        return _cmp(js_string(c, dtype), F.lit(text), op)

    if isinstance(dtype, TIME_TYPES):
        col = c.cast("timestamp") if isinstance(dtype, T.DateType) else c
        dt = T.TimestampType() if isinstance(dtype, T.DateType) else dtype
        if num is not None and not math.isinf(num):
            return _cmp(col, _ts_literal(num, dt), op)
        if ms is not None:
            return _cmp(col, _ts_literal(ms, dt), op)
        return _cmp(js_string(c, dtype), F.lit(text), op)

    if isinstance(dtype, T.StringType):
        if num is None and ms is None:
            return _cmp(c, F.lit(text), op)

        def ladder(v: Column) -> Column:
            n = js_number(v, dtype)
            expr = None
            if num is not None:
                expr = F.when(n.isNotNull(), _cmp(n, F.lit(num), op))
            if ms is not None:
                ts = _js_trim(v).try_cast("timestamp")
                branch = _cmp(F.unix_millis(ts), F.lit(ms), op)
                expr = F.when(ts.isNotNull(), branch) if expr is None else expr.when(ts.isNotNull(), branch)
            return expr.otherwise(_cmp(v, F.lit(text), op))
        return bind(c, ladder)

    return _cmp(js_string(c, dtype), F.lit(text), op)


def js_compare_py(a, b, op: str) -> bool:
    """Loose ``a <op> b`` for two literals (used when a condition holds no column)."""
    op = "==" if op in ("===", "=") else op
    py = {"==": lambda x, y: x == y, ">": lambda x, y: x > y, "<": lambda x, y: x < y,
          ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}[op]
    na, nb = js_number_py(a), js_number_py(b)
    if na is not None and nb is not None:
        return py(na, nb)
    da, db = js_date_ms_py(a), js_date_ms_py(b)
    if da is not None and db is not None:
        return py(da, db)
    return py(js_string_py(a), js_string_py(b))


def js_value_parts(c: Column, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """(Number(v), Date(v) in ms, String(v)) of a column, with JS null semantics."""
    num = js_number(c, dtype)
    if isinstance(dtype, (NUMERIC_TYPES, T.BooleanType)):
        ms = num
    elif isinstance(dtype, TIME_TYPES):
        ms = num
    elif isinstance(dtype, T.StringType):
        ms = F.when(c.isNull(), F.lit(0.0)).otherwise(F.unix_millis(_js_trim(c).try_cast("timestamp")).cast("double"))
    else:
        ms = F.when(c.isNull(), F.lit(0.0))
    text = F.coalesce(js_string(c, dtype), F.lit("null"))
    return num, ms, text


def js_compare_columns(a: Column, ta: T.DataType, b: Column, tb: T.DataType, op: str) -> Column:
    """Loose comparison of two columns (number, then date, then text), JS null semantics."""
    op = "==" if op in ("===", "=") else op
    na, ma, sa = js_value_parts(a, ta)
    nb, mb, sb = js_value_parts(b, tb)
    return (F.when(na.isNotNull() & nb.isNotNull(), _cmp(na, nb, op))
            .when(ma.isNotNull() & mb.isNotNull(), _cmp(ma, mb, op))
            .otherwise(_cmp(sa, sb, op)))
