"""Conversion pipeline."""
import os

from quire.plans import pipeline as P
from quire.sources import csv as CSV


def test_convert_text_column_layouts(spark):
    x = spark.createDataFrame([(1, "<row><user_name>Ann</user_name><age>3</age></row>")], "id int, x string")
    assert P.convert_text_column(x, "x", "xml", "json", key_style="camelCase").first().converted == \
        '{"userName":"Ann","age":3}'  # document order kept
    c = spark.createDataFrame([(1, "user_name,age\nAnn,3\nBo,4")], "id int, x string")
    assert P.convert_text_column(c, "x", "csv", "csv", key_style="camelCase").first().converted == \
        "userName,age\nAnn,3\nBo,4"
    j = spark.createDataFrame([(1, '{"user_name": "Ann", "tags": [{"tag_id": 1}]}')], "id int, x string")
    assert P.convert_text_column(j, "x", "json", "json", key_style="camelCase").first().converted == \
        '{"userName": "Ann", "tags": [{"tagId": 1}]}'  # text kept byte for byte apart from keys


def test_convert_files_with_warnings(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    CSV.write_csv(spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.0)], "id long, name string, v double"), src)
    res = P.convert(spark, src, "xml", os.path.join(tmpdir_path, "out"), transformations=[
        {"type": "filter", "parameters": {"customConditions": ["id > 1"]}},
        {"type": "columnOperation", "parameters": {"operation": {"type": "remove", "columnName": "v"}}}])
    assert res.input_format == "csv" and (res.rows_in, res.rows_out) == (2, 1)
    assert res.warnings == ["1 rows were filtered out during transformation",
                            "1 columns were removed during transformation"]


def test_csv_payloads_keep_every_cell(spark):
    rows = [(1, 'a,b\n"x,1","say ""hi""\nthere",more,7\n5'), (2, "a,a\n1,2"), (3, "a,b,c,d,e\n007,true,1.50,2024-01-02T03:04:05+01:00,\n"),
            (4, None), (5, ""), (6, "a_b,aB\n1,9007199254740993")]
    df = spark.createDataFrame(rows, "id int, x string")

    def run(to, **kw):
        return {r.id: r.converted for r in P.convert_text_column(df, "x", "csv", to, **kw).collect()}
    text = run("json")
    assert text[1] == '[{"a":"x,1","b":"say \\"hi\\"\\nthere","__parsed_extra":["more","7"]},{"a":"5"}]'
    assert text[2] == '[{"a":"1","a_1":"2"}]' and text[4] is None and text[5] == "[]"
    typed = run("json", typed=True, key_style="camelCase")
    assert typed[3] == '[{"a":7,"b":true,"c":1.5,"d":"2024-01-02T02:04:05.000Z","e":null}]'
    assert typed[6] == '[{"aB":1,"aB_1":"9007199254740993"}]'
    assert run("csv")[1] == 'a,b\n"x,1","say ""hi""\nthere",more,7\n5,'
    assert run("xml")[1].endswith("<__parsed_extra>more</__parsed_extra><__parsed_extra>7</__parsed_extra></item><item><a>5</a></item></root>")
