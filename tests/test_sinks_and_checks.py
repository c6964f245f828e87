"""JSON layouts, instants with microseconds, Markdown tables inside one row, V1/V3/V9 and L4 findings."""

import datetime
import glob
import json

import pytest
from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import quality as Q
from quire.plans.pipeline import convert
from quire.sources import csv as CSV
from quire.sources import json as JS
from quire.sources import markdown as MD
from quire.sources import xml as XML


def _documents(path):
    out = []
    for f in sorted(glob.glob(f"{path}/part-*")):
        with open(f, encoding="utf-8") as fh:
            out.append(json.load(fh))
    return out


def test_json_object_layout(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1, "x}"), ("b", 2, None), ("a", 3, "z")], "k string, n int, s string")
    JS.write_json(df, f"{tmpdir_path}/o", layout="object", order_by=["n"])
    merged = {}
    for d in _documents(f"{tmpdir_path}/o"):
        assert not set(merged) & set(d)
        merged |= d
    assert merged == {"a": {"n": 3, "s": "z"}, "b": {"n": 2, "s": None}}
    JS.write_json(df.select("k", "n"), f"{tmpdir_path}/p", layout="object", order_by=["n"], single_file=True, indent=True)
    assert _documents(f"{tmpdir_path}/p") == [{"a": 3, "b": 2}]


def test_json_keyvalue_indent_and_unknown_layout(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "l1\nl2"), ("b", None)], "k string, v string").coalesce(1)
    JS.write_json(df, f"{tmpdir_path}/kv", layout="keyValue", indent=True)
    assert _documents(f"{tmpdir_path}/kv") == [[{"key": "a", "value": "l1\nl2"}, {"key": "b", "value": None}]]
    with pytest.raises(ValueError, match="unknown JSON layout"):
        JS.write_json(df, f"{tmpdir_path}/x", layout="objects")
    with pytest.raises(ValueError, match="indented"):
        JS.write_json(df, f"{tmpdir_path}/x", indent=True)


@pytest.mark.parametrize("layout,empty", [("array", []), ("object", {}), ("keyValue", [])])
def test_json_documents_without_rows(spark, tmpdir_path, layout, empty):
    JS.write_json(spark.createDataFrame([], "a string, b int"), f"{tmpdir_path}/e", layout=layout)
    assert _documents(f"{tmpdir_path}/e") == [empty]


def test_sinks_keep_microseconds(spark, tmpdir_path):
    t0, t1 = datetime.datetime(2024, 1, 2, 3, 4, 5, 123456), datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(1, t0, [t0]), (2, t1, [t1])], "id int, t timestamp, l array<timestamp>").coalesce(1)
    JS.write_json(df, f"{tmpdir_path}/j", layout="array")
    rows = {r["id"]: r for r in _documents(f"{tmpdir_path}/j")[0]}
    assert rows[1]["t"] == "2024-01-02T03:04:05.123456Z" and rows[1]["l"] == ["2024-01-02T03:04:05.123456Z"]
    assert rows[2]["t"] == "2024-01-02T03:04:05.000Z" and rows[2]["l"] == ["2024-01-02T03:04:05.000Z"]
    CSV.write_csv(df.drop("l"), f"{tmpdir_path}/c")
    XML.write_xml(df, f"{tmpdir_path}/x")
    for back in (CSV.read_csv(spark, f"{tmpdir_path}/c"), XML.read_xml(spark, f"{tmpdir_path}/x")):
        got = {r["id"]: r["t"] for r in back.select(F.col("id").cast("int").alias("id"), F.col("t").cast("timestamp").alias("t")).collect()}
        assert got == {1: t0, 2: t1}


def test_json_nested_nan_is_null(spark, tmpdir_path):
    df = spark.range(1).select(F.struct(F.lit(float("nan")).alias("x"), F.array(F.lit(1.5), F.lit(float("inf"))).alias("y")).alias("s"))
    JS.write_json(df, f"{tmpdir_path}/n", layout="array")
    assert sum(_documents(f"{tmpdir_path}/n"), []) == [{"s": {"x": None, "y": [1.5, None]}}]


def test_markdown_tables_stay_in_their_row(spark):
    text = ("intro\r\n| a | b |\r\n|---|---|\r\n| 1 | x\\|y |\r\n| 2 |\r\n\r\nno table: a|b\n\n"
            "stray | pipe\n| c | d |\n|:-:|---|\n||\n| 3 | 4 | 5 |\nend\n| lonely | header |")
    docs = spark.createDataFrame([("d", text), ("n", None), ("e", ""), ("p", "a|b\n-|-")], "path string, text string")
    lines = MD.table_lines(docs)
    got = [(r.path, r.table_index, r.row_index, r.cells) for r in
           lines.orderBy("path", "table_index", "row_index").collect()]
    assert got == [("d", 0, -1, ["a", "b"]), ("d", 0, 0, ["1", "x|y"]), ("d", 0, 1, ["2"]),
                   ("d", 1, -1, ["c", "d"]), ("d", 1, 0, [""]), ("d", 1, 1, ["3", "4", "5"])]
    rows = MD.markdown_table_rows(docs, all_tables=True)
    assert [r.cells for r in rows.orderBy("table_index", "row_index").collect()] == [
        {"a": "1", "b": "x|y"}, {"a": "2", "b": None}, {"c": None, "d": None}, {"c": "3", "d": "4"}]
    prof = {r.path: r.table_count for r in MD.structure_profile(docs).collect()}
    assert prof == {"d": 2, "n": 0, "e": 0, "p": 0}
    for df in (rows, MD.structure_profile(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_csv_row_checks(spark):
    rows = spark.createDataFrame([(2, '{"a":1}'), (1, '{"a":1,"b":2}'), (3, '{"a":1,"c":2}'), (4, None)], "id int, j string")
    named = {r.code: r.message for r in Q.csv_row_checks(rows, "j", "id").collect()}
    assert named == {"INCONSISTENT_CSV_STRUCTURE": "3 rows have inconsistent field structure"}
    counted = {r.code: r.message for r in Q.csv_row_checks(rows, "j", "id", ["a"]).collect()}
    assert counted == {"INCONSISTENT_CSV_STRUCTURE": "2 rows have inconsistent field structure",
                       "HEADER_ROW_MISMATCH": "Header count (1) doesn't match row field count (2)"}
    assert Q.csv_row_checks(rows.limit(0), "j", "id", ["a"]).count() == 0


def test_metadata_checks(spark):
    df = spark.range(3)
    assert Q.metadata_checks(df, 3, ["id"], 1).count() == 0
    assert [(r.severity, r.code) for r in Q.metadata_checks(df, -1, ["id"], 2).orderBy("severity", "message").collect()] == [
        ("error", "INVALID_COUNT"), ("warning", "METADATA_MISMATCH"), ("warning", "METADATA_MISMATCH")]


def test_content_checks_judge_whole_texts(spark):
    late = "<a>" + "x" * 5000 + "<b></a>"
    df = spark.createDataFrame([("p", late)], "path string, head string")
    assert [r.code for r in Q.content_checks(df, "xml").collect()] == ["UNBALANCED_XML_TAGS"]


def test_error_and_security_records(spark):
    e = spark.createDataFrame([("FILE_NOT_FOUND", "gone", "u"), (None, "odd", None)], "code string, message string, user_id string")
    got = A.error_audit_records(e).orderBy("user_id").collect()
    assert got[0].severity == "medium" and json.loads(got[0].details)["errorMessage"] == "odd"
    assert json.loads(got[1].details)["errorCode"] == "FILE_NOT_FOUND" and got[1].type == "ERROR_OCCURRED"
    s = spark.createDataFrame([("login", "failure", "u", "10.0.0.1", "{}")],
                              "action string, result string, user_id string, ip_address string, details string")
    assert A.security_audit_records(s).first().severity == "high"


@pytest.mark.parametrize("fmt", ["json", "md", "csv"])
def test_convert_counts_every_row_whatever_the_sink(spark, tmpdir_path, fmt):
    spark.range(0, 500, 1, 4).select("id", F.concat(F.lit("n"), "id").alias("name")).write.parquet(f"{tmpdir_path}/in")
    res = convert(spark, f"{tmpdir_path}/in", fmt, f"{tmpdir_path}/out", input_format="parquet", validate=False)
    assert (res.rows_in, res.rows_out) == (500, 500)


def test_markdown_table_without_rows(spark, tmpdir_path):
    MD.write_markdown_table(spark.createDataFrame([], "a int"), f"{tmpdir_path}/m")
    assert [r.text.strip() for r in MD.read_markdown_texts(spark, f"{tmpdir_path}/m").collect()] == ["<!-- Empty table -->"]
