"""Detection, data quality, audit analytics and profiles."""
import json

from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import detect as D
from quire.operators import profile as PR
from quire.operators import quality as Q
from quire.sources import csv as CSV


def test_detect_content(spark):
    texts = ['{"a": 1}', '[{"a": "b", "c": 1', '<?xml version="1.0"?><a/>', "<a><b>1</b></a>",
             "# Title\n\n**bold** text", "a,b,c\n1,2,3", "just words", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.f for r in df.select(D.detect_by_content(F.col("t"))["format"].alias("f")).collect()]
    assert got == ["json", "json", "xml", "xml", "md", "csv", None, None]


def test_detect_hybrid(spark):
    df = spark.createDataFrame([("x.json", '{"a":1}'), ("x.csv", '{"a":1}'), ("x.md", "plain"), ("x.txt", "a,b\n1,2")],
                               "path string, head string")
    out = df.select(D.combine(D.detect_by_extension(F.col("path")), D.detect_by_content(F.col("head"))).alias("d")) \
        .select("d.*").collect()
    assert (out[0].format, out[0].confidence) == ("json", 0.95)
    assert (out[1].format, out[1].confidence) == ("json", 0.9)  # content more confident than the extension
    assert (out[2].format, round(out[2].confidence, 2)) == ("md", 0.85)  # no pattern -> extension at 0.5, agree
    assert out[3].format is None and out[3].error == "Unsupported format: .txt"


def test_suggestions_and_pairs(spark):
    df = spark.createDataFrame([("a.xl",), ("a.zzz",)], "p string")
    got = [r[0] for r in df.select(D.format_suggestions(F.col("p"))).collect()]
    assert got[0] == ["xlsx", "xlsx"] and got[1] == ["csv", "xlsx", "json", "xml", "md"]
    w = spark.range(1).select(D.pair_warnings(F.lit("xml"), F.lit("md"))).first()[0]
    assert w == ["Converting to Markdown works best with tabular data"]


def _depth(v, d=0):
    if isinstance(v, dict):
        return max([_depth(x, d + 1) for x in v.values()], default=d)
    if isinstance(v, list):
        return max([_depth(x, d + 1) for x in v], default=d)
    return d


def test_json_depth_matches_brute_force(spark):
    docs = ['{"a": 1}', '{"a": {"b": [1, {"c": "x}]{"}]}}', '{"a": []}', "{}", '[[[]]]', '{"s": "a\\"b"}']
    df = spark.createDataFrame([(t,) for t in docs], "j string")
    got = [r[0] for r in df.select(Q.json_depth(F.col("j"))).collect()]
    assert got == [_depth(json.loads(t)) for t in docs]


def test_findings(spark):
    df = spark.createDataFrame([("a|b\nc", 1)], "s string, n int")
    codes = {r.code for r in Q.markdown_checks(df).collect()}
    assert codes == {"NEWLINES_IN_MARKDOWN", "MARKDOWN_SPECIAL_CHARACTERS"}
    bad = df.withColumnRenamed("s", "xml name")
    assert {r.code for r in Q.xml_checks(bad).collect()} == {"INVALID_XML_FIELD_NAMES", "RESERVED_XML_NAMES"}
    rows = spark.createDataFrame([(1, '{"a":1}'), (2, '{}'), (3, '{"a":1,"z":2}')], "id int, j string")
    f = {(r.code, r.row) for r in Q.structure_checks(rows, "j", "id", headers=["a"]).collect()}
    assert f == {("EMPTY_ROW", 2), ("MISSING_FIELDS", 2), ("EXTRA_FIELDS", 3)}
    rep = {(r.severity, r.code): r["count"] for r in Q.findings_report(Q.structure_checks(rows, "j", "id", ["a"])).collect()}
    assert rep[("warning", "EMPTY_ROW")] == 1


def test_error_classification(spark):
    msgs = ["ENOENT: no such file", "Unexpected token < in JSON", "invalid csv delimiter", "Permission denied",
            "JavaScript heap out of memory", "ECONNRESET socket hang up", "value is required", "???"]
    cases = [("ENOENT: no such file or directory", "The specified file could not be found"),
             ("XML parsing failed: malformed document", "Invalid XML format detected"),
             ("CSV parsing failed: invalid delimiter", "CSV format issue detected"),
             ("No space left on device", "Insufficient disk space"),
             ("Some unknown error occurred", "An unexpected error occurred")]
    um = spark.createDataFrame(cases, "m string, want string").select(
        "want", A.error_classify(F.col("m"))["user_message"].alias("got")).collect()
    assert all(r.got == r.want for r in um), um
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [(r.c.category, r.c.severity, r.c.retryable) for r in df.select(A.error_classify(F.col("m")).alias("c")).collect()]
    assert got == [("file_system", "high", False), ("format", "high", False), ("format", "medium", True),
                   ("permission", "high", False), ("resource", "critical", True), ("network", "medium", True),
                   ("validation", "medium", False), ("unknown", "medium", False)]
    attrs = spark.range(1).select(A.error_attributes(F.lit("MEMORY_ERROR")).alias("a")).first().a
    assert (attrs.severity, attrs.category, attrs.recoverable) == ("critical", "system", False)


def test_threshold_alerts(spark):
    m = spark.createDataFrame([("1", "op", 31000.0, 600 * 1024 * 1024.0, 50.0), ("2", "op", 10.0, 1.0, 0.0)],
                              "id string, operation string, duration double, heap double, throughput double")
    m = m.select("id", "operation", "duration", F.struct(F.col("heap").alias("heap_used")).alias("memory_usage"),
                 "throughput")
    got = [r.warning for r in A.threshold_alerts(m).collect()]
    assert got == ["Operation duration (31000ms) exceeded threshold (30000ms)",
                   "Memory usage (600MB) exceeded threshold (500MB)",
                   "Throughput (50 rec/s) below threshold (100 rec/s)"]


def test_json_schema_profile(spark):
    df = spark.createDataFrame([(1, '{"name":"a","age":3,"active":true}'), (2, '{"name":"b","age":4.5}'),
                                (3, '{"name":"c","age":5}')], "id int, j string")
    got = {r.key: (r.type, r.required) for r in PR.json_schema_profile(df, "j", ["id"]).collect()}
    assert got == {"name": ("string", True), "age": ("integer", True), "active": ("boolean", False)}


def test_xml_schema_profile(spark):
    df = spark.createDataFrame([('<root a="1"><item id="x"><n>1</n></item><item><n>2</n></item></root>',)], "x string")
    got = {r.element: r for r in PR.xml_schema_profile(df, "x").collect()}
    assert got["root"].attributes == ["a"] and got["root"].children == ["item"]
    assert got["item"].is_array and got["item"].attributes == ["id"] and got["n"].type == "text-element"


def test_column_forms_judge_whole_texts(spark):
    long_json = '{"a": "' + "x" * 3000 + '"}'
    df = spark.createDataFrame([(long_json, "a;b,c\n" + "x;y\n" * 400)], "t string, c string")
    assert df.select(D.detect_by_content(F.col("t"))["format"]).first()[0] == "json"
    assert D.with_content_format(df, "t").first().detected.format == "json"
    tail = ["a;b"] * 5 + ["c,d,e"] * 400
    texts = spark.createDataFrame([("\n".join(tail),)], "c string")
    got = texts.select(CSV.detect_delimiter_text(F.col("c")).alias("d"),
                       CSV.best_delimiter(CSV.delimiter_scores(F.col("c"), None, None)).alias("w"),
                       CSV.best_delimiter(CSV.delimiter_scores(F.col("c"))).alias("h")).first()
    assert got.d == got.w == "," and got.h == ";"
