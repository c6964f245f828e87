"""Registered queries for key styles and key corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys as K
from .catalog import register, table

# --- oracle-side SQL spellings of the style rules (text of the check, not engine code) ---
_IS_CAMEL = r"(regexp_matches({k}, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches({k}, '[A-Z]'))"
_IS_SNAKE = r"(regexp_matches({k}, '^[a-z0-9_]+$') AND NOT starts_with({k}, '_') AND NOT ends_with({k}, '_'))"


def _sql_classify(k: str) -> str:
    return (f"CASE WHEN {_IS_CAMEL.format(k=k)} THEN 'camelCase' "
            rf"WHEN {k} = lower({k}) AND NOT regexp_matches({k}, '[_\s-]') THEN 'lowercase' "
            f"WHEN {_IS_SNAKE.format(k=k)} THEN 'snake_case' "
            f"WHEN {k} = upper({k}) AND NOT regexp_matches({k}, '[a-z]') THEN 'uppercase' ELSE 'mixed' END")


def _sql_tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"


def _sql_underscored(k: str) -> str:
    return rf"regexp_replace(regexp_replace({k}, '[\s-]+', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')"


def _sql_style(k: str, style: str) -> str:
    if style == "camelCase":
        words = rf"list_filter(regexp_split_to_array({k}, '[\s_-]+'), lambda w: length(w) > 0)"
        joined = (f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = 1 THEN lower(w) "
                  f"ELSE upper(lower(w)[1]) || lower(w)[2:] END), '')")
        return f"(CASE WHEN {_IS_CAMEL.format(k=k)} THEN {k} ELSE {joined} END)"
    if style == "snake_case":
        return f"(CASE WHEN {_IS_SNAKE.format(k=k)} THEN {k} ELSE {_sql_tidy('lower(' + _sql_underscored(k) + ')')} END)"
    if style == "lowercase":
        return _sql_tidy("lower(" + _sql_underscored(k) + ")")
    return _sql_tidy("upper(" + _sql_underscored(k) + ")")


@register("p10_key_style_camel", """
SELECT o_orderkey AS "oOrderkey", o_custkey AS "oCustkey", o_orderstatus AS "oOrderstatus",
       o_totalprice AS "oTotalprice", o_orderdate AS "oOrderdate", o_orderpriority AS "oOrderpriority" FROM orders
""")
def p10_camel(spark, sf_dir):
    """All column names to camelCase (P10)."""
    return K.key_style(table(spark, sf_dir, "orders"), "camelCase")


@register("p10_key_style_upper", """
SELECT o_orderkey AS "O_ORDERKEY", o_custkey AS "O_CUSTKEY", o_orderstatus AS "O_ORDERSTATUS",
       o_totalprice AS "O_TOTALPRICE", o_orderdate AS "O_ORDERDATE", o_orderpriority AS "O_ORDERPRIORITY" FROM orders
""")
def p10_upper(spark, sf_dir):
    """All column names to UPPERCASE (P10)."""
    return K.key_style(table(spark, sf_dir, "orders"), "uppercase")


@register("p10_key_style_snake_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def p10_snake_roundtrip(spark, sf_dir):
    """camelCase then snake_case gives the original snake names back."""
    return K.key_style(K.key_style(table(spark, sf_dir, "orders"), "camelCase"), "snake_case")


@register("p11_key_style_nested", """
SELECT o_orderkey AS "oOrderkey",
       CAST(to_json({'oOrderstatus': o_orderstatus, 'oOrderpriority': o_orderpriority,
                'oAmounts': [{'oTotalprice': o_totalprice}]}) AS VARCHAR) AS "oInfo"
FROM orders
""")
def p11_nested(spark, sf_dir):
    """Keys inside a struct and an array of structs restyled."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct("o_orderstatus", "o_orderpriority",
                 F.array(F.struct("o_totalprice")).alias("o_amounts")).alias("o_info"))
    out = K.key_style(o, "camelCase")
    return out.select("oOrderkey", F.to_json("oInfo").alias("oInfo"))


@register("p13_key_mapping", "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p13_key_mapping(spark, sf_dir):
    """An explicit name mapping; empty and unknown entries are ignored."""
    cu = table(spark, sf_dir, "customer")
    return K.apply_key_mapping(cu, {"c_custkey": "id", "c_name": "", "not_a_column": "x"})


@register("p13_key_mapping_style", """
SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME", c_nationkey AS "C_NATIONKEY", c_acctbal AS "C_ACCTBAL",
       c_mktsegment AS "C_MKTSEGMENT" FROM customer
""")
def p13_key_mapping_style(spark, sf_dir):
    """A mapping built from a style and applied."""
    cu = table(spark, sf_dir, "customer")
    return K.apply_key_mapping(cu, K.create_key_mapping(cu.columns, "uppercase"))


@register("p14_key_style_simple", """
SELECT s_suppkey AS "sSuppkey", s_name AS "sName", s_nationkey AS "sNationkey", s_acctbal AS "sAcctbal" FROM supplier
""")
def p14_simple(spark, sf_dir):
    """The inline converter's simpler camelCase rule."""
    return K.key_style(table(spark, sf_dir, "supplier"), "camelCase", variant="simple")


# --- key corpora: keys of JSON payloads derived from the tables -------------------------

def _corpus(spark, sf_dir):
    """Keys of events.props, of customer rows as JSON, and of orders rows restyled to camelCase."""
    ev = K.json_keys(table(spark, sf_dir, "events"), "props")
    cu = table(spark, sf_dir, "customer")
    cu_keys = K.json_keys(cu.select(F.to_json(F.struct(*cu.columns)).alias("j")), "j")
    od = K.key_style(table(spark, sf_dir, "orders"), "camelCase")
    od_keys = K.json_keys(od.select(F.to_json(F.struct(*od.columns)).alias("j")), "j")
    return ev.unionByName(cu_keys).unionByName(od_keys)


_CORPUS_SQL = """
  SELECT unnest(json_keys(props)) AS key FROM events
  UNION ALL SELECT unnest(json_keys(to_json(c))) FROM customer c
  UNION ALL SELECT unnest(json_keys(to_json({'oOrderkey': o_orderkey, 'oCustkey': o_custkey,
        'oOrderstatus': o_orderstatus, 'oTotalprice': o_totalprice, 'oOrderdate': o_orderdate,
        'oOrderpriority': o_orderpriority}))) FROM orders
"""


def _a6_sql() -> str:
    styles = ["camelCase", "snake_case", "lowercase", "uppercase", "mixed"]
    counts = ", ".join(f"count(*) FILTER (WHERE style = '{s}') AS \"{s}\"" for s in styles)
    top = "greatest(" + ", ".join(f'"{s}"' for s in styles) + ")"
    total = " + ".join(f'"{s}"' for s in styles)
    pick = (f"CASE WHEN ({total}) = 0 THEN 'unknown' WHEN {top} / ({total}) < 0.5 THEN 'mixed' "
            + " ".join(f"WHEN \"{s}\" = {top} THEN '{s}'" for s in styles[:4]) + " ELSE 'unknown' END")
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS style, \"{s}\" AS key_count, ({total}) AS total_keys, {pick} AS detected_style, "
        f"CASE WHEN ({total}) = 0 THEN 0.0 ELSE {top} / ({total}) END AS confidence FROM w" for s in styles)
    return f"""
WITH k AS (SELECT DISTINCT key FROM ({_CORPUS_SQL}) WHERE key IS NOT NULL),
     s AS (SELECT {_sql_classify('key')} AS style FROM k),
     w AS (SELECT {counts} FROM s)
{rows}
"""


@register("a6_key_census", _a6_sql())
def a6_key_census(spark, sf_dir):
    """Key-style census over the keys of three JSON corpora derived from the tables."""
    return K.key_style_census(_corpus(spark, sf_dir))


def _a7_sql() -> str:
    styles = ["camelCase", "snake_case", "lowercase", "uppercase"]
    issues = (r"list_filter([CASE WHEN contains(key, ' ') THEN 'Contains spaces' END, "
              r"CASE WHEN contains(key, '-') THEN 'Contains hyphens' END, "
              r"CASE WHEN regexp_matches(key, '[^a-zA-Z0-9_\s-]') THEN 'Contains special characters' END, "
              r"CASE WHEN key <> trim(key) THEN 'Has leading/trailing whitespace' END], lambda x: x IS NOT NULL)")
    sugg = ("list_filter([" + ", ".join(
        f"CASE WHEN {_sql_style('key', s)} <> key THEN {{'style': '{s}', 'result': {_sql_style('key', s)}, "
        f"'description': 'Convert to {s}'}} END" for s in styles) + "], lambda x: x IS NOT NULL)")
    return f"""
SELECT key, CAST(to_json({issues}) AS VARCHAR) AS issues, CAST(to_json({sugg}) AS VARCHAR) AS suggestions,
       {_sql_style('key', 'snake_case')} AS transformed, {_sql_style('key', 'snake_case')} <> key AS changed
FROM (SELECT DISTINCT key FROM ({_CORPUS_SQL}) WHERE key IS NOT NULL)
"""


@register("a7_key_suggestions", _a7_sql())
def a7_key_suggestions(spark, sf_dir):
    """Issues and per-style suggestions for every distinct key of the corpus."""
    s = K.key_suggestions(_corpus(spark, sf_dir), style="snake_case")
    return s.select("key", F.to_json("issues").alias("issues"), F.to_json("suggestions").alias("suggestions"),
                    "transformed", "changed")


@register("v13_key_findings", f"""
WITH k AS (SELECT DISTINCT key FROM ({_CORPUS_SQL} UNION ALL SELECT unnest(json_keys(to_json(o))) FROM orders o)
           WHERE key IS NOT NULL),
     t AS (SELECT {_sql_style('key', 'lowercase')} AS new_key FROM k),
     g AS (SELECT new_key, count(*) AS n FROM t GROUP BY new_key)
SELECT 'empty' AS issue, new_key, n FROM g WHERE regexp_replace(coalesce(new_key, ''), '\\s', '', 'g') = ''
UNION ALL SELECT 'duplicate', new_key, n FROM g WHERE n > 1
UNION ALL SELECT 'invalid', new_key, n FROM g WHERE NOT regexp_matches(new_key, '^[a-z0-9_]+$')
""")
def v13_key_findings(spark, sf_dir):
    """Restyling the corpus to lowercase merges oOrderkey with o_orderkey: duplicates."""
    od = table(spark, sf_dir, "orders")
    raw = K.json_keys(od.select(F.to_json(F.struct(*od.columns)).alias("j")), "j")
    return K.key_transformation_findings(_corpus(spark, sf_dir).unionByName(raw), "lowercase")
