"""Registered queries for column operations and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from .catalog import register, table


@register("p1_add_column", """
SELECT n_nationkey, n_name, n_regionkey, 'EARTH' AS planet, n_nationkey * 10 AS code FROM nation
""")
def p1_add_column(spark, sf_dir):
    """A constant column and a SQL-expression column."""
    n = table(spark, sf_dir, "nation")
    n = C.add_column(n, "planet", "EARTH")
    return C.add_column(n, "code", "n_nationkey * 10", expr=True)


@register("p2_remove_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def p2_remove_column(spark, sf_dir):
    """Removing a column, and silently an absent one."""
    cu = table(spark, sf_dir, "customer")
    return C.remove_column(C.remove_column(cu, "c_acctbal"), "no_such_column")


@register("p3_rename_column", "SELECT c_custkey AS customer_id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p3_rename_column(spark, sf_dir):
    """Renaming a column in place."""
    return C.rename_column(table(spark, sf_dir, "customer"), "c_custkey", "customer_id")


@register("p4_column_operations", """
SELECT s_suppkey AS supplier_id, s_name, s_nationkey, 'active' AS state FROM supplier
""")
def p4_column_operations(spark, sf_dir):
    """An ordered rename / remove / add chain."""
    ops = [C.ColumnOperation("rename", "s_suppkey", "supplier_id"),
           C.ColumnOperation("remove", "s_acctbal"),
           C.ColumnOperation("add", "state", default="active")]
    return C.column_operations(table(spark, sf_dir, "supplier"), ops)


@register("p5_reorder_columns", "SELECT c_mktsegment, c_name, c_custkey, c_nationkey, c_acctbal FROM customer")
def p5_reorder_columns(spark, sf_dir):
    """Listed columns first, the rest in their old order (P5)."""
    return C.reorder_columns(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"])


@register("p6_select_columns", "SELECT p_name, p_partkey FROM part")
def p6_select_columns(spark, sf_dir):
    """Exactly the listed columns; the scan reads only those."""
    return C.select_columns(table(spark, sf_dir, "part"), ["p_name", "p_partkey"])


@register("p7_transform_column", """
SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def p7_transform_column(spark, sf_dir):
    """A SQL expression over the old value."""
    return C.transform_column(table(spark, sf_dir, "customer"), "c_name", "upper(value)")


@register("p7_transform_indexed", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) * 1000 + o_custkey AS o_custkey FROM orders
""")
def p7_transform_indexed(spark, sf_dir):
    """A transform that uses the row's position (``index``) under an explicit order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return C.transform_column(orders, "o_custkey", C.column_fn(lambda v, row, i: i * 1000 + v),
                              order_by=["o_orderkey"])


def _labelled(value, row, index):
    if index % 10 == 3:
        raise ValueError("the old value is kept")
    return f"{value}-{row['c_mktsegment']}-{index}"


@register("p7_transform_rows", """
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN i % 10 = 3 THEN c_name ELSE
       c_name || '-' || c_mktsegment || '-' || i END AS c_name
FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS i FROM customer)
""")
def p7_transform_rows(spark, sf_dir):
    """A Python function of the value, its row and its position, which fails on some rows."""
    return C.transform_column(table(spark, sf_dir, "customer"), "c_name", C.row_fn(_labelled),
                              order_by=[F.col("c_acctbal").desc(), "c_custkey"])


@register("p8_split_column", """
SELECT c_custkey, c_name, trim(string_split(c_name, '#')[1]) AS name_prefix,
       trim(string_split(c_name, '#')[2]) AS name_number, trim(string_split(c_name, '#')[3]) AS name_extra
FROM customer
""")
def p8_split_column(spark, sf_dir):
    """Customer names split on '#' into three trimmed parts."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return C.split_column(cu, "c_name", "#", ["name_prefix", "name_number", "name_extra"])


@register("p9_merge_columns", """
SELECT s_suppkey, s_name, s_nationkey,
       nullif(concat_ws('-', nullif(s_name, ''), nullif(CAST(s_nationkey AS VARCHAR), '')), '') AS label
FROM supplier
""")
def p9_merge_columns(spark, sf_dir):
    """Non-empty values joined with a separator."""
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return C.merge_columns(su, ["s_name", "s_nationkey"], "label", "-")


def _a1_sql() -> str:
    cols = [("p_partkey", "number", "CAST(p_partkey AS VARCHAR)"),
            ("p_name", "string", "p_name"),
            ("p_brand", "string", "p_brand"),
            ("p_type", "string", "p_type"),
            ("p_size", "number", "CAST(p_size AS VARCHAR)"),
            ("p_retailprice", "number", "regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '')")]
    parts = []
    for i, (c, t, txt) in enumerate(cols):
        parts.append(f"""
SELECT {i} AS pos, '{c}' AS name, '{t}' AS type,
       count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count,
       (SELECT CAST(to_json(list(v ORDER BY k)) AS VARCHAR) FROM (SELECT p_partkey AS k, {txt} AS v FROM part
         WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 3)) AS sample_values
FROM part""")
    return " UNION ALL ".join(parts)


@register("a1_column_statistics", _a1_sql())
def a1_column_statistics(spark, sf_dir):
    """Type, null count, distinct count and first three values per column of part (A1)."""
    stats = C.column_statistics(table(spark, sf_dir, "part"), order_by=["p_partkey"])
    return stats.withColumn("sample_values", F.to_json("sample_values"))
