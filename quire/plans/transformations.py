"""Ordered transformation lists (C1) and table conversion with change warnings.

A transformation list is folded over the DataFrame with ``df.transform``; nothing runs
until an action, so the whole list becomes one logical plan that Catalyst optimizes as a
unit (filters move below renames into the scan, projections collapse).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.columns import ColumnOperation, column_operations
from ..operators.filters import FilterCriteria, filter_data
from ..operators.keys import key_style

TRANSFORMATION_TYPES = ("keyStyle", "columnOperation", "filter")


@dataclass(frozen=True)
class KeyStyle:
    style: str
    nested: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        return key_style(df, self.style, nested=self.nested)


@dataclass(frozen=True)
class ColumnOps:
    operations: tuple

    def apply(self, df: DataFrame) -> DataFrame:
        return column_operations(df, self.operations)


@dataclass(frozen=True)
class Filter:
    criteria: FilterCriteria

    def apply(self, df: DataFrame) -> DataFrame:
        return filter_data(df, self.criteria)


def from_spec(spec: dict):
    """Build a step from ``{"type": ..., "parameters": ...}`` as the tool's requests carry them."""
    kind, params = spec.get("type"), spec.get("parameters", {}) or {}
    if kind == "keyStyle":
        return KeyStyle(params["style"])
    if kind == "columnOperation":
        ops = params.get("operations") or ([params["operation"]] if params.get("operation") else [])
        return ColumnOps(tuple(o if isinstance(o, ColumnOperation) else ColumnOperation(
            o["type"], o.get("columnName"), o.get("newName"), o.get("defaultValue")) for o in ops))
    if kind == "filter":
        from ..operators.filters import ColumnFilter, DateRange
        cf = tuple(ColumnFilter(f["columnName"], f["operator"], f.get("value")) for f in params.get("columnFilters", []))
        dr = params.get("dateRange")
        rng = DateRange(dr["dateColumn"], dr["startDate"], dr["endDate"]) if dr else None
        return Filter(FilterCriteria(cf, rng, tuple(params.get("customConditions", []))))
    raise ValueError(f"Unknown transformation type: {kind}")


def apply_transformations(df: DataFrame, steps: Sequence) -> DataFrame:
    """Apply the steps in the order given."""
    steps = [from_spec(s) if isinstance(s, dict) else s for s in steps]
    return reduce(lambda acc, step: acc.transform(step.apply), steps, df)


def conventional_order(steps: Sequence) -> list:
    """The fixed order of the convenience command: key style, column ops, filters."""
    steps = [from_spec(s) if isinstance(s, dict) else s for s in steps]
    rank = {KeyStyle: 0, ColumnOps: 1, Filter: 2}
    return sorted(steps, key=lambda s: rank.get(type(s), 3))


def conversion_delta(original: DataFrame, transformed: DataFrame) -> DataFrame:
    """A3: rows filtered out and columns removed/added, as one row of counts plus warnings.

    Both counts run in one job each; with ``convert_data`` they come from Observations
    collected while the output is written, so no extra pass is needed there.
    """
    o = original.agg(F.count(F.lit(1)).alias("original_rows"))
    t = transformed.agg(F.count(F.lit(1)).alias("transformed_rows")).scalar()  # scalar subquery
    oc, tc = len(original.columns), len(transformed.columns)
    return o.select(
        "original_rows", t.alias("transformed_rows"),
        F.lit(oc).alias("original_columns"), F.lit(tc).alias("transformed_columns"),
        delta_warnings(F.col("original_rows"), t, oc, tc).alias("warnings"))


def delta_warnings(orig_rows, new_rows, orig_cols: int, new_cols: int):
    lost = orig_rows - new_rows
    msgs = [F.when(new_rows < orig_rows, F.concat(lost.cast("string"), F.lit(" rows were filtered out during transformation")))]
    if new_cols < orig_cols:
        msgs.append(F.lit(f"{orig_cols - new_cols} columns were removed during transformation"))
    elif new_cols > orig_cols:
        msgs.append(F.lit(f"{new_cols - orig_cols} columns were added during transformation"))
    return F.array_compact(F.array(*msgs))


@dataclass
class ConvertedData:
    """C2 result: the transformed DataFrame plus observations filled in by the first action."""
    data: DataFrame
    original_columns: int
    observed_input: Observation
    observed_output: Observation
    warnings: list = field(default_factory=list)

    def collect_warnings(self) -> list[str]:
        """Call after an action on ``data`` (e.g. a write): row and column changes."""
        rows_in = self.observed_input.get.get("rows", 0)
        rows_out = self.observed_output.get.get("rows", 0)
        w = []
        if rows_out < rows_in:
            w.append(f"{rows_in - rows_out} rows were filtered out during transformation")
        oc, tc = self.original_columns, len(self.data.columns)
        if tc < oc:
            w.append(f"{oc - tc} columns were removed during transformation")
        elif tc > oc:
            w.append(f"{tc - oc} columns were added during transformation")
        self.warnings = w
        return w


def convert_data(df: DataFrame, steps: Sequence) -> ConvertedData:
    """C1 plus row/column change warnings, counted by Observations (no extra pass)."""
    obs_in, obs_out = Observation("quire_in"), Observation("quire_out")
    observed = df.observe(obs_in, F.count(F.lit(1)).alias("rows"))
    out = apply_transformations(observed, steps).observe(obs_out, F.count(F.lit(1)).alias("rows"))
    return ConvertedData(out, len(df.columns), obs_in, obs_out)


def validate_transformation(spec: dict):
    """Plan-time check of one request-style step (type, style, parameters)."""
    from ..functions.names import STYLES
    from ..operators.filters import Report
    rep = Report()
    kind, params = spec.get("type"), spec.get("parameters")
    if not kind:
        rep.errors.append("Transformation type is required")
    if not params:
        rep.errors.append("Transformation parameters are required")
        return rep
    if kind == "keyStyle":
        style = params.get("style")
        if not style:
            rep.errors.append("Key style is required for keyStyle transformation")
        elif style not in STYLES:
            rep.errors.append(f"Invalid key style: {style}")
    elif kind == "columnOperation":
        if not params.get("operations") and not params.get("operation"):
            rep.errors.append("Column operations are required for columnOperation transformation")
    elif kind == "filter":
        if not (params.get("columnFilters") or params.get("dateRange") or params.get("customConditions")):
            rep.warnings.append("No filter criteria specified")
    else:
        rep.warnings.append(f"Unknown transformation type: {kind}")
    return rep


def validate_transformations(df: DataFrame, specs: Sequence[dict]):
    """V12 for a whole list, then the column and filter checks (V10, V11) step by step on the
    schema each step produces (built lazily: no data is read)."""
    from ..operators.columns import validate_operations
    from ..operators.filters import Report, validate_filter_criteria
    rep = Report()
    current = df
    for i, spec in enumerate(specs, 1):
        r = validate_transformation(spec)
        rep.errors += [f"Transformation {i}: {e}" for e in r.errors]
        rep.warnings += [f"Transformation {i}: {w}" for w in r.warnings]
        if r.errors or spec.get("type") not in TRANSFORMATION_TYPES:
            continue
        step = from_spec(spec)
        inner = (validate_operations(current, step.operations) if isinstance(step, ColumnOps)
                 else validate_filter_criteria(current, step.criteria) if isinstance(step, Filter) else Report())
        rep.errors += [f"Transformation {i}: {e}" for e in inner.errors]
        rep.warnings += [f"Transformation {i}: {w}" for w in inner.warnings]
        if not inner.errors:
            current = step.apply(current)
    return rep
