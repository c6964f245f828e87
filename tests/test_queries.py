"""Every registered query against its DuckDB oracle (sf0.001), plus brute-force checks for
the queries that have no SQL form, and the driver entry point."""
import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _ = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert ok, f"{name}: {msg}"


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["oOrderkey", "oCustkey", "oOrderstatus", "total", "oOrderdate", "oOrderpriority", "status"]
    assert df.count() > 0


def test_a8_json_depth(spark):
    r = QUERIES["a8_json_depth"](spark, SF).first()
    assert r.max_depth == 5 and not r.deep_warning and r.total_bytes > 0


def test_a9_xml_schema(spark):
    got = {r.element: r for r in QUERIES["a9_xml_schema"](spark, SF).collect()}
    assert got["nation"].attributes == ["key"] and got["nation"].children == ["name", "note", "regions"]
    assert got["nation"].type == "element" and got["nation"].root_count == 25
    assert got["r"].is_array and got["r"].type == "text-element" and got["regions"].children == ["r"]
    assert got["note"].type == "text-element" and not got["name"].is_array


def test_s2_delimiter_profile(spark):
    chosen = {r.source: r.delimiter for r in QUERIES["s2_csv_delimiter_profile"](spark, SF).where("chosen").collect()}
    assert chosen == {"nation": ",", "region": ";", "supplier": "\t", "customer": "|"}


def test_t1_t3_detect_files(spark):
    t3 = {(r.extension, r.format) for r in QUERIES["t3_detect_files"](spark, SF).collect()}
    assert {(".csv", "csv"), (".json", "json"), (".xml", "xml"), (".md", "md"), (".txt", None)} <= t3
    t1 = {r.extension: r.confidence for r in QUERIES["t1_detect_extension"](spark, SF).collect()}
    assert t1[".csv"] == 0.8 and t1[".txt"] is None


def test_v8_file_checks(spark):
    codes = {(r.severity, r.code) for r in QUERIES["v8_file_checks"](spark, SF).collect()}
    assert codes == {("warning", "EXTENSION_MISMATCH")}
