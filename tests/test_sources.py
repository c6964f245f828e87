"""Sources and sinks (S1-S18, K1-K12) on text fixtures from the reference's tests."""
import os

from pyspark.sql import functions as F

from quire.sources import csv as CSV
from quire.sources import json as JS
from quire.sources import markdown as MD
from quire.sources import xml as XML
from quire.sources import xlsx as XL


def write(path, name, text, mode="w"):
    os.makedirs(path, exist_ok=True)
    p = os.path.join(path, name)
    with open(p, mode, encoding=None if "b" in mode else "utf-8") as f:
        f.write(text)
    return p


def test_csv_typed_quoted_and_sniffed(spark, tmpdir_path):
    write(tmpdir_path, "a.csv", '﻿name;age;active;score\n"Doe; John";30;true;1.5\nJane;;false;2\n')
    df = CSV.read_csv(spark, tmpdir_path, sep=None)
    assert df.columns == ["name", "age", "active", "score"]
    rows = sorted(df.collect(), key=lambda r: r.name)
    assert rows[0].name == "Doe; John" and rows[0].age == 30 and rows[0].active is True
    assert rows[1].age is None and rows[1].score == 2.0


def test_csv_delimiter_scores(spark, tmpdir_path):
    write(tmpdir_path, "t.csv", "a\tb\tc\n1\t2\t3\n")
    prof = {r.delimiter: (r.score, r.chosen) for r in CSV.delimiter_profile(spark, tmpdir_path).collect()}
    # complete, non-empty lines count; all of them alike doubles the score
    assert prof["\t"] == (6.0, True) and prof[","] == (2.0, False)


def test_csv_sink_quotes(spark, tmpdir_path):
    df = spark.createDataFrame([('a"b', None, 1.0)], "s string, n string, d double")
    out = os.path.join(tmpdir_path, "out")
    CSV.write_csv(df, out, single_file=True)
    text = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]).read()
    assert text == '"s","n","d"\n"a""b","","1"\n'


def test_json_layouts(spark, tmpdir_path):
    write(tmpdir_path, "rows.json", '[{"b": 1, "a": "x"}, {"a": "y", "c": true}]')
    df = JS.read_json(spark, os.path.join(tmpdir_path, "rows.json"))
    assert df.columns == ["a", "b", "c"]  # sorted union of keys
    write(tmpdir_path, "idx.json", '["apple", 2, null, [1]]')
    idx = JS.read_json(spark, os.path.join(tmpdir_path, "idx.json"), layout="indexed").orderBy("index").collect()
    assert [r.type for r in idx] == ["string", "number", "object", "array"]
    write(tmpdir_path, "obj.json", '{"name": "x", "n": 3, "tags": [1, 2]}')
    ent = JS.read_json(spark, os.path.join(tmpdir_path, "obj.json"), layout="entries").orderBy("pos").collect()
    assert [(r.key, r.type) for r in ent] == [("name", "string"), ("n", "number"), ("tags", "array")]


def test_json_array_document_sink(spark, tmpdir_path):
    import json
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string").coalesce(1)
    out = os.path.join(tmpdir_path, "arr")
    JS.write_json(df, out, layout="array")
    f = [os.path.join(out, x) for x in os.listdir(out) if x.startswith("part-")][0]
    assert json.loads(open(f).read()) == [{"id": 1, "v": None}, {"id": 2, "v": "x"}]


def test_json_object_layout(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], "k string, v int, o int")
    got = {r.key: r.value.v for r in JS.to_object_layout(df, order_by=["o"]).collect()}
    assert got == {"a": 3, "b": 2}  # last duplicate wins


def test_xml_attributes_and_text(spark, tmpdir_path):
    write(tmpdir_path, "d.xml", '<?xml version="1.0"?><data><item id="1"><name lang="en">Ann</name><age>3</age></item>'
                                '<item id="2"><name lang="fr">Bo</name><age>4</age></item></data>')
    df = XML.read_xml(spark, tmpdir_path)
    assert set(df.columns) == {"id", "name", "age"}
    row = df.orderBy("id").first()
    assert row.name.text == "Ann" and row.name.lang == "en"


def test_xml_entries(spark):
    df = spark.createDataFrame([('<r><a>1</a><b x="1">t</b><c><d>2</d></c><e/><f>1</f><f>2</f></r>',)], "x string")
    got = {(r.key, r.type) for r in XML.xml_entries(df, "x").collect()}
    assert got == {("a", "string"), ("b", "text"), ("c", "object"), ("e", "null"), ("f", "array")}


def test_markdown_table_scan(spark, tmpdir_path):
    write(tmpdir_path, "t.md", "# Title\n\n| name | age | site |\n|---|---:|---|\n| **Ann** | 3 | [x](http://x) |\n"
                               "| `Bo` | -4 | |\n\nText\n\n| other | t |\n|--|--|\n| 1 | 2 |\n")
    df = MD.read_markdown_table(spark, tmpdir_path)
    assert df.columns == ["name", "age", "site"]
    rows = sorted(df.collect(), key=lambda r: r.name)
    assert (rows[0].name, rows[0].age, rows[0].site) == ("Ann", 3, "x") and (rows[1].age, rows[1].site) == (-4, None)
    both = MD.markdown_table_rows(MD.read_markdown_texts(spark, tmpdir_path), all_tables=True)
    assert both.select("table_index").distinct().count() == 2


def test_markdown_structures(spark):
    docs = spark.createDataFrame([("l", "1. one\n- a\n* b\n"), ("h", "# T\n## U\ntext"), ("p", "x\n\n\n y \n\nz")],
                                 "path string, text string")
    out = {(r["path"], r["index"]): (r["text"], r["type"], r["level"]) for r in MD.structured_content(docs).collect()}
    assert [out[("l", i)][0] for i in range(3)] == ["a", "b", "one"]  # D27
    assert out[("h", 1)] == ("U", "heading", 2)
    assert [out[("p", i)][0] for i in range(3)] == ["x", "y", "z"]
    meta, body = MD.frontmatter(F.lit('---\ntitle: "Hi"\nurl: http://a:b\n---\nBody'))
    r = spark.range(1).select(meta.alias("m"), body.alias("b")).first()
    assert r.m == {"title": "Hi", "url": "http://a:b"} and r.b == "Body"


def test_markdown_escaping(spark):
    df = spark.createDataFrame([("a|b\\c\nd",)], "v string")
    assert df.select(MD.table_line(df)).first()[0] == "| a\\|b\\\\c d |"  # D25 fixed order


def test_xlsx_roundtrip_and_inventory(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a", 1.5, True), (2, None, 2.0, False)], "id long, s string, d double, b boolean")
    out = os.path.join(tmpdir_path, "wb")
    XL.write_xlsx(df.coalesce(1), out, sheet_name="S")
    back = XL.read_xlsx(spark, out, sheet_name="S")
    assert back.columns == ["id", "s", "d", "b"]
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 1.5, True), (2, None, 2.0, False)]
    inv = XL.sheet_inventory_df(spark, out).first()
    assert (inv.sheet_name, inv.row_count, inv.column_count) == ("S", 3, 4)
    rng = XL.read_xlsx(spark, out, range_="a1:b2")  # lower-case range letters work
    assert rng.columns == ["id", "s"] and rng.count() == 1


def test_write_modes(spark, tmpdir_path):
    import pytest
    from quire.plans.pipeline import output_path, write_any
    df = spark.createDataFrame([(1,)], "a int")
    out = os.path.join(tmpdir_path, "o")
    write_any(df, out, "csv")
    write_any(df, out, "csv", overwrite=True)  # K13: overwrite by default
    with pytest.raises(Exception):
        write_any(df, out, "csv", overwrite=False)
    taken = {"/d/a_converted.json", "/d/a_converted_1.json"}
    assert output_path("/d/a.csv", "json", exists=lambda p: p in taken) == "/d/a_converted_2.json"
    assert output_path("/d/a.csv", "md", output_dir="/o", preserve_name=True) == "/o/a.md"


def test_heading_lines_fallbacks(spark):
    df = spark.createDataFrame([(0, None, "from content"), (9, "T", "c"), (None, "", "x")],
                               "level int, text string, content string")
    got = [r.value for r in MD.heading_lines(df).collect()]
    assert got == ["# from content\n", "###### T\n", "# x\n"]


def test_markdown_escapes_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a|b\\c"), (2, "plain"), (3, "x\\|y")], "id long, v string")
    out = os.path.join(tmpdir_path, "md")
    MD.write_markdown_table(df, out)
    back = sorted(MD.read_markdown_table(spark, out).collect())
    assert [(r.id, r.v) for r in back] == [(1, "a|b\\c"), (2, "plain"), (3, "x\\|y")]


def test_csv_edge_files(spark, tmpdir_path):
    hdr = os.path.join(tmpdir_path, "hdr")
    write(hdr, "h.csv", "name,age,email\n")
    df = CSV.read_csv(spark, hdr)
    assert df.columns == ["name", "age", "email"] and df.count() == 0
    mixed = os.path.join(tmpdir_path, "mixed")
    write(mixed, "m.csv", "a,b\r\n1,2\n3,4\r\n5,6\n7,8\n")
    assert sorted(tuple(r) for r in CSV.read_csv(spark, mixed).collect()) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    big = os.path.join(tmpdir_path, "big")
    write(big, "b.csv", "id,name,value\n" + "".join(f"{i},n{i},{i * 1.5}\n" for i in range(1000)))
    b = CSV.read_csv(spark, big)
    assert b.count() == 1000 and dict(b.dtypes) == {"id": "int", "name": "string", "value": "double"}


def test_json_empty_and_bom(spark, tmpdir_path):
    write(tmpdir_path, "e.json", "[]")
    assert JS.read_json(spark, os.path.join(tmpdir_path, "e.json"), layout="indexed").count() == 0
    write(tmpdir_path, "bom.json", "﻿" + '{"a": 1}')
    ent = JS.read_json(spark, os.path.join(tmpdir_path, "bom.json"), layout="entries").collect()
    assert [(r.key, r.type) for r in ent] == [("a", "number")]


def test_xlsx_commit_leaves_only_workbooks(spark, tmpdir_path):
    import pytest
    df = spark.range(0, 50).selectExpr("id", "cast(id as string) as s").repartition(3)
    out = os.path.join(tmpdir_path, "wb")
    XL.write_xlsx(df, out)
    names = sorted(os.listdir(out))
    assert "_temporary" not in names and all(n.endswith(".xlsx") for n in names) and len(names) == 3
    assert XL.read_xlsx(spark, out).count() == 50
    XL.write_xlsx(df.limit(5), out)  # overwrite replaces the folder
    assert XL.read_xlsx(spark, out).count() == 5
    with pytest.raises(FileExistsError):
        XL.write_xlsx(df, out, overwrite=False)


def test_xml_entries_by_depth(spark):
    df = spark.createDataFrame([
        (1, "<a><a>1</a></a>"), (2, "<r><a><a>1</a><a>2</a></a><b/></r>"), (3, "<r><!-- <n>1</n> --><a><![CDATA[<x>1</x>]]></a></r>"),
        (4, '<?xml version="1.0"?><r q="/>"><a t="x > y">1 &amp; 2</a><é><!-- none --></é></r>'), (5, None), (6, "<r/>"),
    ], "id long, x string")
    got = [(r.id, r.key, r.value, r.type) for r in XML.xml_entries(df, "x", keep=["id"]).orderBy("id", "pos").collect()]
    assert got == [(1, "a", "1", "string"), (2, "a", "<a>1</a><a>2</a>", "object"), (2, "b", "", "null"),
                   (3, "a", "<x>1</x>", "string"), (4, "a", "1 & 2", "text"), (4, "é", "", "null")]
