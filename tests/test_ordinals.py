"""Positions found on keys, and Python functions with row and position."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.ordinal import with_ordinal
from quire.operators import columns as C
from quire.operators import filters as FL


def test_positions_under_several_keys_and_directions(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, "x" * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, s string").repartition(6)
    order = [F.col("k").desc(), "s", F.col("id")]
    got = {r.id: r.at for r in with_ordinal(df, order, "at").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(want)}
    picked = sorted(r.id for r in FL.sample_every_nth(df, 7, order).collect())
    assert picked == sorted(r[0] for r in want[::7])


def test_equal_keys_take_neighbouring_positions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")      # runs of equal keys go over batches
    try:
        nan = float("nan")
        keys = [1.0] * 30 + [nan] * 11 + [None] * 9 + [0.0, -0.0] * 5 + [2.0]
        df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k double").repartition(4)
        got = [(r.at, r.k, r.id) for r in with_ordinal(df, "k", "at").collect()]
        assert sorted(g[0] for g in got) == list(range(len(keys))) and sorted(g[2] for g in got) == list(range(len(keys)))
        by = [("null" if k is None else "nan" if k != k else k + 0.0) for _, k, _ in sorted(got, key=lambda g: g[0])]
        assert by == ["null"] * 9 + [0.0] * 10 + [1.0] * 30 + [2.0] + ["nan"] * 11
        assert len(FL.sample_every_nth(df, 10, "k").collect()) == 7
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = df.where("false")
    assert with_ordinal(none, "k").count() == 0 and FL.sample_every_nth(none, 2, "k").count() == 0


def test_python_functions_of_value_row_and_position(spark):
    df = spark.createDataFrame([("b", 2, [1]), ("a", 1, None), ("c", None, [])], "name string, n int, l array<int>")
    got = C.transform_column(df, "n", C.row_fn(lambda v, row, i: i * 10 + len(row["name"]) + v), order_by=["name"])
    assert got.columns == df.columns and {r.name: r.n for r in got.collect()} == {"a": 2, "b": 13, "c": None}
    text = C.transform_column(df, "n", C.row_fn(lambda v, row, i: f"{row['l']}{i}" if v != 1 else 1 / 0), return_type=T.StringType())
    assert {r.name: r.n for r in text.collect()} == {"a": "1", "b": "[1]None", "c": "[]None"}
    kept = C.transform_column(df, "n", lambda v: "no number")       # what the type cannot hold is a failure too
    assert {r.name: r.n for r in kept.collect()} == {"a": 1, "b": 2, "c": None}
