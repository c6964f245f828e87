"""Filters, de-duplication and sampling (F1-F16, V10, A2) on the reference's people fixture."""
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import jscompat as J
from quire.operators import filters as FL


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_column_filter_greater_than(people):
    crit = FL.FilterCriteria((FL.ColumnFilter("age", "greaterThan", 30),))
    assert names(FL.filter_data(people, crit)) == ["Bob", "Charlie"]


def test_multiple_filters_and(people):
    crit = FL.FilterCriteria((FL.ColumnFilter("age", "greaterThan", 25), FL.ColumnFilter("active", "equals", True)))
    assert names(FL.filter_data(people, crit)) == ["Alice", "John"]


def test_date_range_on_text_dates(people):
    crit = FL.FilterCriteria(date_range=FL.DateRange("joinDate", "2023-01-01", "2023-02-28"))
    assert names(FL.filter_data(people, crit)) == ["Alice", "John"]


def test_custom_conditions(people):
    crit = FL.FilterCriteria(custom_conditions=("age >= 30", "active === true"))
    assert names(FL.filter_data(people, crit)) == ["John"]


def test_all_groups_combined(people):
    crit = FL.FilterCriteria((FL.ColumnFilter("age", "greaterThan", 20),),
                             FL.DateRange("joinDate", "2023-01-01", "2023-12-31"), ("active === true",))
    assert names(FL.filter_data(people, crit)) == ["Alice", "Jane", "John"]


def test_contains_is_case_insensitive(people):
    crit = FL.FilterCriteria((FL.ColumnFilter("email", "contains", "EXAMPLE.com"),))
    assert len(names(FL.filter_data(people, crit))) == 5


def test_between_and_errors(people):
    crit = FL.FilterCriteria((FL.ColumnFilter("age", "between", [28, 35]),))
    assert names(FL.filter_data(people, crit)) == ["Alice", "Bob", "John"]
    with pytest.raises(ValueError):
        FL.filter_data(people, FL.FilterCriteria((FL.ColumnFilter("age", "between", [1]),)))
    with pytest.raises(ValueError):
        FL.filter_data(people, FL.FilterCriteria((FL.ColumnFilter("age", "like", 1),)))


def test_unknown_column_keeps_nothing(people):
    assert FL.filter_data(people, FL.FilterCriteria((FL.ColumnFilter("nope", "equals", 1),))).count() == 0


def test_invalid_condition_keeps_rows(people):
    assert FL.filter_data(people, FL.FilterCriteria(custom_conditions=("age", "a > b > c"))).count() == 5


def test_null_semantics(spark):
    df = spark.createDataFrame([("a", None), ("b", 10), ("c", 30)], "name string, age long")
    # A column filter never matches null
    assert names(FL.filter_data(df, FL.FilterCriteria((FL.ColumnFilter("age", "lessThan", 18),)))) == ["b"]
    # A custom condition sees null as 0
    assert names(FL.filter_data(df, FL.FilterCriteria(custom_conditions=("age < 18",)))) == ["a", "b"]
    assert names(FL.filter_data(df, FL.FilterCriteria(custom_conditions=("age == null",)))) == ["a"]
    assert names(FL.filter_data(df, FL.FilterCriteria(custom_conditions=("age != null",)))) == ["b", "c"]
    # !== is read as !=
    assert names(FL.filter_data(df, FL.FilterCriteria(custom_conditions=("name !== 'a'",)))) == ["b", "c"]


def test_string_ladder(spark):
    df = spark.createDataFrame([("1", "10"), ("2", "9"), ("3", "abc"), ("4", "2024-01-02"), ("5", " 0x10 ")],
                               "name string, v string")
    got = names(FL.filter_data(df, FL.FilterCriteria((FL.ColumnFilter("v", "greaterThan", 9),))))
    # 10 > 9 and 0x10 = 16 > 9 numerically; '2024-01-02' compares as a date (ms) with new Date(9);
    # 'abc' is neither, so it is compared as text: 'abc' > '9'
    assert got == ["1", "3", "4", "5"]


def test_js_literals():
    assert J.js_number_py("") == 0.0 and J.js_number_py("0x10") == 16.0 and J.js_number_py("1d") is None
    assert J.js_string_py(1.0) == "1" and J.js_string_py(12345678.5) == "12345678.5"
    assert J.js_compare_py("10", 9, ">") and not J.js_compare_py("abc", "abd", ">")


def test_long_digit_texts_are_not_saturated(spark):
    r = random.Random(1)
    vals = ["0x0", "0x000", "0xffffffffffffffff", "0x10000000000000000", "0x10000000000000001", "0x00010", "0b" + "1" * 65,
            "0x20000000000001", "0x200000000000010000000000000000000", "0x200000000000010000000000000000001",
            "0x1fffffffffffff8", "0x" + "f" * 255, "0x" + "f" * 256, "0x" + "1" * 300, "0b1" + "0" * 1024]
    vals += [p + "".join(r.choice(d) for _ in range(n)) for p, d in (("0x", "0123456789abcdefABCDEF"), ("0b", "01"), ("0O", "01234567"))
             for n in (1, 12, 14, 15, 16, 17, 20, 21, 40, 53, 54, 60, 61, 64, 65, 90)]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [x[0] for x in df.select(J.js_number(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [J.js_number_py(v) for v in vals]
    two = spark.createDataFrame([("a", "0x" + "a" * 40), ("b", "0x" + "b" * 40)], "name string, v string")
    assert names(FL.filter_data(two, FL.FilterCriteria((FL.ColumnFilter("v", "equals", "0x" + "a" * 40),)))) == ["a"]


def test_js_string_doubles(spark):
    vals = [1.0, 12345678.5, 0.1, -2.5, 0.0, 1e20, 1e21, 1.5e-7]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(J.js_string(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == ["1", "12345678.5", "0.1", "-2.5", "0", "100000000000000000000", "1e+21", "1.5e-7"]


def test_null_values_both_ways(spark):
    df = spark.createDataFrame([("John", 30, "j@x"), ("Jane", None, "j2@x"), ("Bob", 35, ""), ("Al", 20, "a@x")],
                               "name string, age long, email string")
    assert names(FL.filter_null_values(df, ["age", "email"])) == ["Al", "John"]
    assert names(FL.filter_null_values(df, ["age", "email"], remove_nulls=False)) == ["Bob", "Jane"]
    with pytest.raises(ValueError):
        FL.filter_null_values(df, ["missing"])


def test_unique_and_duplicates(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (3, "A", "z"), (4, "C", "w")], "id int, category string, v string")
    out = FL.filter_unique(df, "category", order_by=["id"]).orderBy("id").collect()
    assert [(r.id, r.v) for r in out] == [(1, "x"), (2, "y"), (4, "w")]
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), ("c", 3)], "name string, age int")
    assert FL.filter_duplicates(d).count() == 3


def test_sampling(people):
    order = ["name"]
    assert names(FL.sample_every_nth(people, 2, order)) == ["Alice", "Charlie", "John"]
    assert names(FL.sample_first(people, 2, order)) == ["Alice", "Bob"]
    assert names(FL.sample_last(people, 2, order)) == ["Jane", "John"]
    assert FL.sample_last(people, 0, order).count() == 0  # D11 fixed
    a = names(FL.sample_random(people, 3, seed=7, key_columns=["name"]))
    assert a == names(FL.sample_random(people, 3, seed=7, key_columns=["name"])) and len(a) == 3
    assert FL.sample_random(people, 10, seed=1).count() == 5


def test_filter_statistics(people):
    row = FL.filter_statistics(people, FL.FilterCriteria((FL.ColumnFilter("age", "greaterThan", 30),))).first()
    assert (row.original_rows, row.filtered_rows, row.removed_rows, row.removal_percentage) == (5, 2, 3, 60.0)


def test_validate_filter_criteria(people):
    rep = FL.validate_filter_criteria(people, FL.FilterCriteria(
        (FL.ColumnFilter("nope", "equals", 1), FL.ColumnFilter("age", "between", 3)),
        FL.DateRange("joinDate", "2024-01-01", "bad"), ("no operator",)))
    assert not rep.is_valid
    assert any("does not exist" in e for e in rep.errors)
    assert any("Invalid end date" in e for e in rep.errors)
    assert any("No recognized operator" in w for w in rep.warnings)


def test_pushdown_survives_renames(spark, tmpdir_path):
    from quire.plans.q_filters import flagship
    plan = flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,200000.0)" in plan


def test_ladder_column_matches_literal_semantics(spark):
    """Property check: the Column ladder on a text column agrees with the literal comparison."""
    from pyspark.sql import types as T
    values = ["10", "9", " 7 ", "", "abc", "ABD", "0x1A", "1e3", "2024-01-02", "2023-12-31T10:00:00Z", "-4.5",
              "Infinity", "true", "z"]
    literals = [9, 10.5, "10", "abc", "2024-01-01", -5, 0, "", "Infinity"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for lit_v in literals:
        for op in ("==", ">", "<", ">=", "<="):
            got = [r[0] for r in df.select(J.js_compare(F.col("v"), T.StringType(), lit_v, op)).collect()]
            want = [J.js_compare_py(v, lit_v, op) for v in values]
            assert got == want, (lit_v, op, list(zip(values, got, want)))
