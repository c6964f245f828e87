"""Column operations and statistics."""
import pytest
from pyspark.sql import functions as F

from quire.operators import columns as C


@pytest.fixture
def small(spark):
    return spark.createDataFrame([("John", 30, "john@x.com"), ("Jane", 25, "jane@x.com"), ("Bob", 35, "bob@x.com")],
                                 "name string, age long, email string")


def test_add_remove_rename(small):
    out = C.add_column(small, "status", "active")
    assert out.columns[-1] == "status" and {r.status for r in out.collect()} == {"active"}
    out = C.add_column(small, "age2", lambda row: row["age"] * 2)
    assert sorted(r.age2 for r in out.collect()) == [50, 60, 70]
    with pytest.raises(ValueError):
        C.add_column(small, "name", 1)
    assert C.remove_column(small, "missing").columns == small.columns
    renamed = C.rename_column(small, "age", "years")
    assert renamed.columns == ["name", "years", "email"]  # D13: position kept
    with pytest.raises(ValueError):
        C.rename_column(small, "age", "name")


def test_operations_chain_and_validation(small):
    ops = [C.ColumnOperation("rename", "age", "years"), C.ColumnOperation("add", "x", default=1),
           C.ColumnOperation("remove", "email")]
    assert C.column_operations(small, ops).columns == ["name", "years", "x"]
    rep = C.validate_operations(small, [C.ColumnOperation("rename", "age", "years"),
                                        C.ColumnOperation("rename", "years", "age2"),
                                        C.ColumnOperation("add", "name")])
    assert rep.errors == ["Operation 3: Column 'name' already exists"]  # step-by-step schema (fix)


def test_reorder_select(small):
    assert C.reorder_columns(small, ["email"]).columns == ["email", "name", "age"]
    assert C.select_columns(small, ["age"]).columns == ["age"]
    with pytest.raises(ValueError):
        C.select_columns(small, ["zzz"])


def test_transform_column(small):
    assert sorted(r.name for r in C.transform_column(small, "name", "upper(value)").collect()) == ["BOB", "JANE", "JOHN"]
    out = C.transform_column(small, "age", lambda v: v + 1 if v < 30 else 1 / 0)  # failure keeps the value
    assert sorted(r.age for r in out.collect()) == [26, 30, 35]
    idx = C.transform_column(small, "age", C.column_fn(lambda v, row, i: i), order_by=["name"])
    assert {r.name: r.age for r in idx.collect()} == {"Bob": 0, "Jane": 1, "John": 2}


def test_split_and_merge(spark):
    full = spark.createDataFrame([("John Doe", 30), ("Jane Smith", 25), ("John", 1), (None, 2), ("", 3)],
                                 "fullName string, age long")
    out = {(r.fullName): (r.firstName, r.lastName) for r in
           C.split_column(full, "fullName", " ", ["firstName", "lastName"]).collect()}
    assert out["John Doe"] == ("John", "Doe") and out["John"] == ("John", None)
    assert out[None] == (None, None) and out[""] == (None, None)
    parts = spark.createDataFrame([("John", None, 1.0), (None, "Smith", 2.5), ("", "", None)],
                                  "firstName string, lastName string, score double")
    merged = [r.full for r in C.merge_columns(parts, ["firstName", "lastName", "score"], "full").collect()]
    assert merged == ["John 1", "Smith 2.5", None]


def test_column_statistics(spark):
    df = spark.createDataFrame([("John", None), (None, 25), ("John", 30)], "name string, age long")
    stats = {r.name: r for r in C.column_statistics(df).collect()}
    assert (stats["name"].null_count, stats["name"].unique_count, stats["name"].type) == (1, 1, "string")
    assert (stats["age"].null_count, stats["age"].unique_count, stats["age"].type) == (1, 2, "number")
    empty = spark.createDataFrame([(None,)], "x string")
    assert C.column_statistics(empty).first().type == "mixed"  # D28


def test_validate_transformations(small):
    from quire.plans.transformations import validate_transformations
    rep = validate_transformations(small, [
        {"type": "keyStyle", "parameters": {"style": "kebab"}},
        {"type": "keyStyle", "parameters": {"style": "uppercase"}},
        {"type": "columnOperation", "parameters": {"operations": [{"type": "rename", "columnName": "age",
                                                                   "newName": "AGE2"}]}},
        {"type": "filter", "parameters": {"columnFilters": [{"columnName": "age", "operator": "equals", "value": 1}]}},
        {"type": "filter", "parameters": {}},
        {"type": "sort", "parameters": {"by": "x"}}])
    assert rep.errors[0] == "Transformation 1: Invalid key style: kebab"
    assert any("Column 'age' does not exist" in e for e in rep.errors)  # names are upper case after step 2
    assert any("Transformation 5: Transformation parameters are required" == e for e in rep.errors)
    assert any("Unknown transformation type: sort" in w for w in rep.warnings)


def test_add_column_row_function(small):
    out = C.add_column(small, "greeting", row_function=lambda r: f"hi {r['name']}" if r["age"] < 35 else 1 / 0)
    got = {r.name: r.greeting for r in out.collect()}
    assert got == {"John": "hi John", "Jane": "hi Jane", "Bob": None}  # failure -> null
