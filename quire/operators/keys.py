"""Key restyling of DataFrames and key corpora.

Renaming top-level columns is metadata only (no pass over the data). Nested keys are
rebuilt with native ``struct`` / ``transform`` / ``transform_keys`` expressions. Key
corpora (the keys of a JSON text column) are ordinary DataFrames aggregated with
``groupBy``: distinct keys first (map-side combine), then the per-style census.
"""

from __future__ import annotations

from collections import Counter
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maps import map_last_wins
from ..functions.jscompat import js_trim

from ..functions import names as N
from .filters import Report


def _check_collisions(old: Sequence[str], new: Sequence[str], on_collision: str) -> list[int]:
    """Indexes of columns to keep; D14: raise by default, or keep the last of a clash."""
    seen: dict[str, list[int]] = {}
    for i, n in enumerate(new):
        seen.setdefault(n.lower(), []).append(i)
    clashes = {k: v for k, v in seen.items() if len(v) > 1}
    if not clashes:
        return list(range(len(new)))
    if on_collision == "last":
        drop = {i for v in clashes.values() for i in v[:-1]}
        return [i for i in range(len(new)) if i not in drop]
    detail = "; ".join(", ".join(old[i] for i in v) + " -> " + new[v[0]] for v in clashes.values())
    raise ValueError(f"Key style produces duplicate column names: {detail}")


def _restyle_value(c: Column, dt: T.DataType, name_fn: Callable[[str], str],
                   col_fn: Callable[[Column], Column]) -> Column:
    """Rebuild nested values with restyled keys (objects inside arrays too, not dates)."""
    if isinstance(dt, T.StructType):
        built = F.struct(*[_restyle_value(c.getField(f.name), f.dataType, name_fn, col_fn).alias(name_fn(f.name))
                           for f in dt.fields])
        return F.when(c.isNull(), F.lit(None)).otherwise(built)
    if isinstance(dt, T.ArrayType) and _nested(dt.elementType):
        return F.transform(c, lambda x: _restyle_value(x, dt.elementType, name_fn, col_fn))
    if isinstance(dt, T.MapType):
        out = c
        if isinstance(dt.keyType, T.StringType):    # keys that meet after restyling: the last one wins
            out = map_last_wins(F.transform(F.map_entries(c), lambda e: F.struct(
                col_fn(e["key"]).alias("key"), e["value"].alias("value"))))
        if _nested(dt.valueType):
            out = F.transform_values(out, lambda k, v: _restyle_value(v, dt.valueType, name_fn, col_fn))
        return out
    return c


def _nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StructType, T.ArrayType, T.MapType))


def key_style(df: DataFrame, style: str, nested: bool = True, on_collision: str = "raise",
              variant: str = "full") -> DataFrame:
    """P10/P11 (and P14 with ``variant="simple"``): restyle every column name and nested key."""
    if style not in N.STYLES:
        raise ValueError(f"Invalid key style: {style}")
    if variant == "simple":
        name_fn = lambda k: N.transform_key_simple(k, style)
        col_fn = lambda c: N.transform_key_simple_col(c, style)
    else:
        name_fn = lambda k: N.transform_key(k, style)
        col_fn = lambda c: N.transform_key_col(c, style)
    old = df.columns
    new = [name_fn(c) for c in old]
    keep = _check_collisions(old, new, on_collision)
    out = []
    for i in keep:
        f = df.schema.fields[i]
        c = df[f.name]
        if nested and _nested(f.dataType):
            c = _restyle_value(c, f.dataType, name_fn, col_fn)
        out.append(c.alias(new[i]))
    return df.select(*out)


def create_key_mapping(keys: Sequence[str], style: str) -> dict[str, str]:
    """Old name -> restyled name."""
    return {k: N.transform_key(k, style) for k in keys}


def apply_key_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename top-level columns; a missing or empty mapping keeps the name."""
    renames = {k: v for k, v in mapping.items() if k in df.columns and v}
    return df.withColumnsRenamed(renames) if renames else df


# ---------------------------------------------------------------------------------------
# Key corpora
# ---------------------------------------------------------------------------------------

def json_keys(df: DataFrame, json_col: str, key_name: str = "key") -> DataFrame:
    """All top-level keys of a JSON-object text column, one row per occurrence."""
    keys = F.json_object_keys(F.col(json_col))
    return df.select(F.explode(F.coalesce(keys, F.array().cast("array<string>"))).alias(key_name))


def key_style_census(keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Count distinct keys per style, with the detected majority style and confidence.

    Output: one row per style (camelCase, snake_case, lowercase, uppercase, mixed) with
    ``key_count``, ``total_keys``, ``detected_style`` and ``confidence``.
    """
    distinct = keys.select(F.col(key_col).alias("key")).where(F.col("key").isNotNull()).distinct()
    styles = list(N.STYLES) + ["mixed"]
    # one global aggregate over the distinct keys (partial counts per task, then one row)
    wide = distinct.select(N.classify_key_col(F.col("key")).alias("style")).agg(
        *[F.count_if(F.col("style") == s).alias(s) for s in styles])
    total = sum((F.col(s) for s in styles), F.lit(0))
    top = F.greatest(*[F.col(s) for s in styles])
    pick = F.when(total == 0, F.lit("unknown")).when(top / total < 0.5, F.lit("mixed"))
    for s in N.STYLES:
        pick = pick.when(F.col(s) == top, F.lit(s))
    pick = pick.otherwise(F.lit("unknown"))
    conf = F.when(total == 0, F.lit(0.0)).otherwise(top / total)
    summary = wide.select(*styles, total.alias("total_keys"), pick.alias("detected_style"), conf.alias("confidence"))
    return summary.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("style"), F.col(s).cast("long").alias("key_count")) for s in styles])).alias("x"),
        "total_keys", "detected_style", "confidence").select("x.*", F.col("total_keys").cast("long").alias("total_keys"),
                                                              "detected_style", "confidence")


def detect_key_style(keys: Sequence[str]) -> dict:
    """A6 on a name list (driver side): the same rules as the census."""
    counts = Counter(N.classify_key(k) for k in keys)
    analysis = {s: counts.get(s, 0) for s in list(N.STYLES) + ["mixed"]}
    style, conf = N.majority_style(analysis) if keys else ("unknown", 0.0)
    return {"detected_style": style, "confidence": conf, "analysis": analysis}


def key_suggestions(keys: DataFrame, key_col: str = "key", style: str | None = None) -> DataFrame:
    """Per distinct key, its issues and the result of each style that changes it;
    with ``style`` also the preview columns ``transformed`` and ``changed``."""
    k = F.col("key")
    d = keys.select(F.col(key_col).alias("key")).where(k.isNotNull()).distinct()
    issues = F.array_compact(F.array(
        F.when(k.contains(" "), F.lit("Contains spaces")),
        F.when(k.contains("-"), F.lit("Contains hyphens")),
        F.when(k.rlike(r"[^a-zA-Z0-9_\s-]"), F.lit("Contains special characters")),
        F.when(k != js_trim(k), F.lit("Has leading/trailing whitespace"))))
    sugg = F.array_compact(F.array(*[
        F.when(N.transform_key_col(k, s) != k,
               F.struct(F.lit(s).alias("style"), N.transform_key_col(k, s).alias("result"),
                        F.lit(f"Convert to {s}").alias("description")))
        for s in N.STYLES]))
    cols = [k, issues.alias("issues"), sugg.alias("suggestions")]
    if style:
        t = N.transform_key_col(k, style)
        cols += [t.alias("transformed"), (t != k).alias("changed")]
    return d.select(*cols)


def validate_key_transformation(original: Sequence[str], transformed: Sequence[str], style: str) -> Report:
    """V13 on name lists."""
    rep = Report()
    empty = [k for k in transformed if not k or not k.strip()]
    if empty:
        rep.errors.append(f"{len(empty)} keys became empty after transformation")
    dup = [k for k, n in Counter(transformed).items() if n > 1]
    if dup:
        rep.errors.append(f"{len(dup)} duplicate keys found after transformation: {', '.join(dup)}")
    bad = [k for k in transformed if not N.is_valid_for_style(k, style)]
    if bad:
        rep.errors.append(f"{len(bad)} keys don't match the expected {style} format: {', '.join(bad)}")
    return rep


def key_transformation_findings(keys: DataFrame, style: str, key_col: str = "key") -> DataFrame:
    """V13 over a key corpus: one finding per empty, duplicate or style-violating result.
    One aggregation over the distinct keys; every check is a conditional array element, so
    the corpus is read once."""
    k = F.col("key")
    d = keys.select(F.col(key_col).alias("key")).where(k.isNotNull()).distinct()
    t = d.select(N.transform_key_col(k, style).alias("new_key"))
    per_new = t.groupBy("new_key").agg(F.count(F.lit(1)).alias("n"))
    nk = F.col("new_key")

    def item(issue, cond):
        return F.when(cond, F.struct(F.lit(issue).alias("issue"), nk.alias("new_key"), F.col("n").alias("n")))
    checks = F.array_compact(F.array(
        item("empty", F.regexp_replace(F.coalesce(nk, F.lit("")), r"\s", "") == ""),
        item("duplicate", F.col("n") > 1),
        item("invalid", ~N.is_valid_for_style_col(nk, style))))
    return per_new.select(F.explode(checks).alias("f")).select("f.*")
