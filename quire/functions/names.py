"""Key (column-name) styles.

Each style exists twice: as a plain Python function for schema names (renaming columns is
metadata only, no pass over the data) and as a native ``Column`` expression for columns
whose *values* are key names (keys of JSON payloads, maps, key corpora).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("camelCase", "snake_case", "lowercase", "uppercase")

# Patterns that define the styles (decisions D15-D18 of the design notes).
CAMEL_RE = r"^[a-z][a-zA-Z0-9]*$"
HAS_UPPER_RE = r"[A-Z]"
SNAKE_RE = r"^[a-z0-9_]+$"
WORD_SPLIT_RE = r"[\s_-]+"
SPACE_HYPHEN_RE = r"[\s-]+"
CASE_BOUNDARY_RE = r"([a-z0-9])([A-Z])"
LOWER_VALID_RE = r"^[a-z0-9_]+$"
UPPER_VALID_RE = r"^[A-Z0-9_]+$"
XML_BAD_CHAR_RE = r"[^a-zA-Z0-9_\-\.]"
XML_RESERVED_PREFIXES = ("xml", "xmlns")
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------------------------------
# Driver-side name functions
# ---------------------------------------------------------------------------------------

def is_camel(key: str) -> bool:
    return bool(re.match(CAMEL_RE, key)) and bool(re.search(HAS_UPPER_RE, key))


def is_snake(key: str) -> bool:
    return bool(re.match(SNAKE_RE, key)) and not key.startswith("_") and not key.endswith("_")


def _cap(word: str) -> str:
    w = word.lower()
    return w[:1].upper() + w[1:]


def to_camel(key: str) -> str:
    if is_camel(key):
        return key
    words = [w for w in re.split(WORD_SPLIT_RE, key) if w]
    return "".join(w.lower() if i == 0 else _cap(w) for i, w in enumerate(words))


def _underscored(key: str) -> str:
    s = re.sub(SPACE_HYPHEN_RE, "_", key)
    return re.sub(CASE_BOUNDARY_RE, r"\1_\2", s)


def _tidy(s: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"_+", "_", s))


def to_snake(key: str) -> str:
    if is_snake(key):
        return key
    return _tidy(_underscored(key).lower())


def to_lower(key: str) -> str:
    return _tidy(_underscored(key).lower())


def to_upper(key: str) -> str:
    return _tidy(_underscored(key).upper())


def transform_key(key: str, style: str) -> str:
    """Restyle one key; empty keys and unknown styles leave the key unchanged."""
    if not key or not isinstance(key, str):
        return key
    fn = {"camelCase": to_camel, "snake_case": to_snake, "lowercase": to_lower, "uppercase": to_upper}.get(style)
    return fn(key) if fn else key


def transform_key_simple(key: str, style: str) -> str:
    """The inline converter's simpler styles."""
    if style == "camelCase":
        return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), key)
    if style == "snake_case":
        return re.sub(r"[A-Z]", lambda m: "_" + m.group(0).lower(), key)
    if style == "lowercase":
        return key.lower()
    if style == "uppercase":
        return key.upper()
    return key


def classify_key(key: str) -> str:
    """Style of one key: camelCase, lowercase, snake_case, uppercase or mixed (D18 order)."""
    if is_camel(key):
        return "camelCase"
    if key == key.lower() and not re.search(r"[_\s-]", key):
        return "lowercase"
    if is_snake(key):
        return "snake_case"
    if key == key.upper() and not re.search(r"[a-z]", key):
        return "uppercase"
    return "mixed"


def is_valid_for_style(key: str, style: str) -> bool:
    if style == "camelCase":
        return bool(re.match(CAMEL_RE, key))
    if style == "snake_case":
        return is_snake(key)
    if style == "lowercase":
        return bool(re.match(LOWER_VALID_RE, key))
    if style == "uppercase":
        return bool(re.match(UPPER_VALID_RE, key))
    return True


def majority_style(counts: dict) -> tuple[str, float]:
    """Detected style and confidence from per-style counts."""
    total = sum(counts.values())
    if total == 0:
        return "unknown", 0.0
    top = max(counts.values())
    confidence = top / total
    if confidence < 0.5:
        return "mixed", confidence
    for style in STYLES:
        if counts.get(style, 0) == top:
            return style, confidence
    return "unknown", confidence


def sanitize_xml_name(name: str) -> str:
    s = re.sub(XML_BAD_CHAR_RE, "_", name)
    if not re.match(r"^[a-zA-Z_]", s):
        s = "_" + s
    if any(s.lower().startswith(p) for p in XML_RESERVED_PREFIXES):
        s = "field_" + s
    return s


# ---------------------------------------------------------------------------------------
# Column versions (P12): values of ``c`` are key names
# ---------------------------------------------------------------------------------------

def is_camel_col(c: Column) -> Column:
    return c.rlike(CAMEL_RE) & c.rlike(HAS_UPPER_RE)


def is_snake_col(c: Column) -> Column:
    return c.rlike(SNAKE_RE) & ~c.startswith("_") & ~c.endswith("_")


def _tidy_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_+|_+$", "")


def _underscored_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, SPACE_HYPHEN_RE, "_"), CASE_BOUNDARY_RE, "$1_$2")


def camel_col(c: Column) -> Column:
    words = F.filter(F.split(c, WORD_SPLIT_RE), lambda w: F.length(w) > 0)
    joined = F.array_join(
        F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(
            F.concat(F.upper(F.substring(F.lower(w), 1, 1)), F.substring(F.lower(w), 2, 1 << 30)))), "")
    return F.when(is_camel_col(c), c).otherwise(joined)


def snake_col(c: Column) -> Column:
    return F.when(is_snake_col(c), c).otherwise(_tidy_col(F.lower(_underscored_col(c))))


def lower_col(c: Column) -> Column:
    return _tidy_col(F.lower(_underscored_col(c)))


def upper_col(c: Column) -> Column:
    return _tidy_col(F.upper(_underscored_col(c)))


def transform_key_col(c: Column, style: str) -> Column:
    fn = {"camelCase": camel_col, "snake_case": snake_col, "lowercase": lower_col, "uppercase": upper_col}.get(style)
    if fn is None:
        raise ValueError(f"unknown key style {style!r}")
    return F.when(c.isNull() | (c == ""), c).otherwise(fn(c))


def transform_key_simple_col(c: Column, style: str) -> Column:
    if style == "camelCase":
        parts = F.split(c, "_(?=[a-z])")
        return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))), "")
    if style == "snake_case":
        return F.translate(F.regexp_replace(c, "([A-Z])", "_$1"), ASCII_UPPER, ASCII_LOWER)
    if style == "lowercase":
        return F.lower(c)
    if style == "uppercase":
        return F.upper(c)
    return c


def classify_key_col(c: Column) -> Column:
    return (F.when(is_camel_col(c), "camelCase")
            .when((c == F.lower(c)) & ~c.rlike(r"[_\s-]"), "lowercase")
            .when(is_snake_col(c), "snake_case")
            .when((c == F.upper(c)) & ~c.rlike("[a-z]"), "uppercase")
            .otherwise("mixed"))


def is_valid_for_style_col(c: Column, style: str) -> Column:
    if style == "camelCase":
        return c.rlike(CAMEL_RE)
    if style == "snake_case":
        return is_snake_col(c)
    if style == "lowercase":
        return c.rlike(LOWER_VALID_RE)
    if style == "uppercase":
        return c.rlike(UPPER_VALID_RE)
    return F.lit(True)
