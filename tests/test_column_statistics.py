"""Column statistics in one scan, against counts by hand."""
import datetime as dt
import random

from pyspark.sql import functions as F

from quire.operators import columns as C


def rows(n=500):
    r = random.Random(3)
    out = []
    for i in range(n):
        out.append((i, r.choice([None, "", "a", "A", "x" * 100, "x" * 99 + "y"]), r.choice([None, 0.0, -0.0, float("nan"), 1.5, 1e-19, 2e-19]),
                    r.choice([None, dt.datetime(2024, 1, 1, 0, 0, 0, r.randrange(3))]), r.choice([None, [1], [1, None], []]),
                    r.choice([True, None]), None, r.choice([None, b"\x00", b"\xff", b""])))
    r.shuffle(out)
    return out


SCHEMA = "id long, s string, x double, t timestamp, l array<int>, b boolean, none string, raw binary"


def identity(v):
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    return tuple(v) if isinstance(v, list) else v


def test_counts_and_samples_equal_those_by_hand(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    names = df.columns
    got = {r.name: r for r in C.column_statistics(df, order_by=["id"]).collect()}
    assert [r.name for r in C.column_statistics(df, order_by=["id"]).collect()] == names
    data.sort()
    for i, c in enumerate(names):
        values = [r[i] for r in data]
        seen = [v for v in values if v is not None]
        assert got[c].null_count == len(values) - len(seen), c
        assert got[c].unique_count == len({identity(v) for v in seen}), c
        assert len(got[c].sample_values) == min(3, len(seen)), c
    assert got["id"].sample_values == ["0", "1", "2"] and got["none"].type == "mixed" and got["l"].type == "object"
    assert got["s"].sample_values == [r[1] for r in data if r[1] is not None][:3]
    again = {r.name: r for r in C.column_statistics(df, order_by=["id"], samples=5, approx=True).collect()}
    assert all(abs(again[c].unique_count - got[c].unique_count) <= 0.1 * got[c].unique_count for c in names)
    assert len(again["id"].sample_values) == 5


def test_samples_with_equal_and_null_keys_and_no_order(spark):
    df = spark.createDataFrame([(2, "c"), (None, "z"), (1, "a"), (1, "a"), (1, None)], "k int, v string").coalesce(1)
    got = {r.name: r for r in C.column_statistics(df, order_by=["k"]).collect()}
    assert got["v"].sample_values == ["z", "a", "a"] and got["k"].sample_values == ["1", "1", "1"]
    assert {r.name: r.sample_values for r in C.column_statistics(df).collect()}["v"] == ["c", "z", "a"]
    empty = {r.name: tuple(r) for r in C.column_statistics(df.where("false")).collect()}
    assert empty["v"] == (1, "v", "mixed", 0, 0, [])


def test_one_scan_at_any_number_of_columns(spark, tmpdir_path):
    spark.range(100).select("id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(60)]).write.parquet(tmpdir_path + "/t")
    stats = C.column_statistics(spark.read.parquet(tmpdir_path + "/t"), order_by=["id"])
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Expand" not in plan
    assert {r.unique_count for r in stats.where("name <> 'id'").collect()} == set(range(2, 62))
