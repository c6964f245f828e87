"""Registered queries for filters, de-duplication and sampling (F1-F16, A2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators.columns import ColumnOperation
from .catalog import register, table
from .transformations import ColumnOps, Filter, KeyStyle, apply_transformations

FLAGSHIP_STEPS = [
    KeyStyle("camelCase"),
    ColumnOps((ColumnOperation("rename", "oTotalprice", "total"), ColumnOperation("add", "status", default="open"))),
    Filter(FL.FilterCriteria((FL.ColumnFilter("total", "greaterThan", 200000),),
                             FL.DateRange("oOrderdate", "1995-01-01", "1996-12-31"))),
]


def flagship(spark, sf_dir):
    """Read orders, camelCase keys, rename, add a column, filter by price and date range."""
    return apply_transformations(table(spark, sf_dir, "orders"), FLAGSHIP_STEPS)


register("f1_filter_data", """
SELECT o_orderkey AS "oOrderkey", o_custkey AS "oCustkey", o_orderstatus AS "oOrderstatus",
       o_totalprice AS total, o_orderdate AS "oOrderdate", o_orderpriority AS "oOrderpriority", 'open' AS status
FROM orders
WHERE o_totalprice > 200000
  AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00'
""")(flagship)


def _lineitem_filter(flt):
    def q(spark, sf_dir):
        """A typed column filter on lineitem (F2, F4-F6): a plain comparison pushed into the scan."""
        li = table(spark, sf_dir, "lineitem")
        return FL.filter_data(li, FL.FilterCriteria((flt,))).select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return q


_LI = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem WHERE "
register("f2_equals", _LI + "l_quantity = 10")(_lineitem_filter(FL.ColumnFilter("l_quantity", "equals", 10)))
register("f4_greater_than", _LI + "l_extendedprice > 50000")(
    _lineitem_filter(FL.ColumnFilter("l_extendedprice", "greaterThan", 50000)))
register("f5_less_than", _LI + "l_discount < 0.02")(_lineitem_filter(FL.ColumnFilter("l_discount", "lessThan", 0.02)))
register("f6_between", _LI + "l_quantity >= 10 AND l_quantity <= 20")(
    _lineitem_filter(FL.ColumnFilter("l_quantity", "between", [10, 20])))


@register("f2_equals_text", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def f2_equals_text(spark, sf_dir):
    """Text equality on the return flag (F2)."""
    li = table(spark, sf_dir, "lineitem")
    return FL.filter_data(li, FL.FilterCriteria((FL.ColumnFilter("l_returnflag", "equals", "R"),))).select(
        "l_orderkey", "l_linenumber", "l_returnflag")


@register("f3_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def f3_contains(spark, sf_dir):
    """Case-insensitive substring match on part names."""
    part = table(spark, sf_dir, "part")
    return FL.filter_data(part, FL.FilterCriteria((FL.ColumnFilter("p_name", "contains", "RING"),))).select(
        "p_partkey", "p_name")


@register("f7_string_ladder", """
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events
WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50
""")
def f7_string_ladder(spark, sf_dir):
    """A numeric filter on a text column: the runtime number/date/text ladder."""
    ev = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return FL.filter_data(ev, FL.FilterCriteria((FL.ColumnFilter("k", "greaterThan", 50),)))


@register("f8_date_range", """
SELECT event_id, ts, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-05 00:00:00'
""")
def f8_date_range(spark, sf_dir):
    """Inclusive date range on event times, pushed into the scan (F8)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return FL.filter_data(ev, FL.FilterCriteria(date_range=FL.DateRange("ts", "2024-01-02", "2024-01-05")))


@register("f9_custom", """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'
""")
def f9_custom(spark, sf_dir):
    """Custom conditions: a numeric comparison (null counts as 0) and a quoted text literal."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return FL.filter_data(cu, FL.FilterCriteria(custom_conditions=("c_acctbal >= 0", "c_mktsegment == 'BUILDING'")))


@register("f9_custom_columns", """
SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount
""")
def f9_custom_columns(spark, sf_dir):
    """Column against column in a custom condition."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return FL.filter_data(li, FL.FilterCriteria(custom_conditions=("l_tax > l_discount",)))


def _doc_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left")


@register("f10_null_values_remove", """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
""")
def f10_remove(spark, sf_dir):
    """Documents whose label is present (F10, nulls removed)."""
    return FL.filter_null_values(_doc_labels(spark, sf_dir), ["quality"], remove_nulls=True)


@register("f10_null_values_keep", """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL
""")
def f10_keep(spark, sf_dir):
    """Documents without a label (F10, only null rows kept)."""
    return FL.filter_null_values(_doc_labels(spark, sf_dir), ["quality"], remove_nulls=False)


@register("f11_unique", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1
""")
def f11_unique(spark, sf_dir):
    """First event per user under event order."""
    return FL.filter_unique(table(spark, sf_dir, "events"), "user_id", order_by=["event_id"])


@register("f12_duplicate_rows", "SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)")
def f12_duplicate_rows(spark, sf_dir):
    """All columns of lineitem, every row twice: each once again."""
    li = table(spark, sf_dir, "lineitem")
    return FL.filter_duplicates(li.union(li))


@register("f12_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def f12_duplicates(spark, sf_dir):
    """Distinct (return flag, line status) pairs of the whole lineitem table."""
    return FL.filter_duplicates(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@register("f13_every_nth", """
SELECT o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0
""")
def f13_every_nth(spark, sf_dir):
    """Every 7th order by order key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return FL.sample_every_nth(orders, 7, order_by=["o_orderkey"])


@register("f14_random", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)) LIMIT 100
""")
def f14_random(spark, sf_dir):
    """A reproducible seeded sample of 100 orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return FL.sample_random(orders, 100, seed=42, key_columns=["o_orderkey"])


@register("f15_first", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 100")
def f15_first(spark, sf_dir):
    """First 100 events by event id."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return FL.sample_first(ev, 100, order_by=["event_id"])


@register("f16_last", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def f16_last(spark, sf_dir):
    """Last 100 events by event id (F16)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return FL.sample_last(ev, 100, order_by=["event_id"])


@register("a2_filter_statistics", """
SELECT count(*) AS original_rows,
       count(*) FILTER (WHERE o_totalprice > 200000 AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'
                        AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00') AS filtered_rows,
       count(*) - count(*) FILTER (WHERE o_totalprice > 200000 AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'
                        AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00') AS removed_rows,
       floor((count(*) - count(*) FILTER (WHERE o_totalprice > 200000
                        AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'
                        AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00')) / count(*) * 100 * 100 + 0.5) / 100
         AS removal_percentage
FROM orders
""")
def a2_filter_statistics(spark, sf_dir):
    """Kept / removed counts and removal percentage of the flagship criteria (A2)."""
    orders = table(spark, sf_dir, "orders")
    crit = FL.FilterCriteria((FL.ColumnFilter("o_totalprice", "greaterThan", 200000),),
                             FL.DateRange("o_orderdate", "1995-01-01", "1996-12-31"))
    return FL.filter_statistics(orders, crit)
