"""Default settings lose no rows, columns or values (readers, convert, payloads), and odd rows do not abort a job."""
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.maps import map_last_wins
from quire.operators import columns as COLS
from quire.operators import filters as FILT
from quire.operators import keys as KEYS
from quire.operators.quality import json_depth
from quire.plans.pipeline import convert, convert_text_column, restyle_json_text
from quire.sources import csv as CSV
from quire.sources import markdown as MD
from quire.sources import xlsx as XL
from quire.sources import xml as XML


def write(base, name, text):
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_newlines_quotes_and_late_types(spark, tmpdir_path):
    rows = [(i, f'line {i}\nsecond, "quoted"') for i in range(50)]
    df = spark.createDataFrame(rows, "id long, note string")
    CSV.write_csv(df, tmpdir_path + "/a")
    assert sorted((r.id, r.note) for r in CSV.read_csv(spark, tmpdir_path + "/a").collect()) == rows
    write(tmpdir_path + "/b", "b.csv", "k,v\n" + "".join(f"{i},{i}\n" for i in range(5000)) + "5000,late text\n")
    back = CSV.read_csv(spark, tmpdir_path + "/b")
    assert dict(back.dtypes)["v"] == "string" and back.where("v = 'late text'").count() == 1
    assert back.where("v is null").count() == 0


def test_csv_short_file_delimiter(spark, tmpdir_path):
    write(tmpdir_path, "s.csv", "a,b\n1,2\n")
    assert [tuple(r) for r in CSV.read_csv(spark, tmpdir_path).collect()] == [(1, 2)]


def test_xml_row_element_by_depth(spark, tmpdir_path):
    write(tmpdir_path + "/one", "a.xml", "<data><item><id>1</id><tag>x</tag><tag>y</tag></item></data>")
    got = XML.read_xml(spark, tmpdir_path + "/one").collect()
    assert len(got) == 1 and got[0].tag == ["x", "y"]
    # the repetition comes after 4 KB
    write(tmpdir_path + "/late", "b.xml", "<data><!-- <x/><x/> --><meta>m</meta><r><v>" + "z" * 6000
          + "</v></r><r><v>2</v></r></data>")
    assert XML.detect_row_tags(spark, tmpdir_path + "/late").first().row_tag == "r"
    assert XML.read_xml(spark, tmpdir_path + "/late").count() == 2


def test_xlsx_types_and_columns_over_all_workbooks(spark, tmpdir_path):
    XL.write_xlsx(spark.range(1500).select(F.col("id").alias("n"), F.col("id").cast("string").alias("t")).coalesce(1),
                  tmpdir_path + "/w/one")
    XL.write_xlsx(spark.createDataFrame([("late", 7)], "n string, extra long"), tmpdir_path + "/w/two")
    back = XL.read_xlsx(spark, tmpdir_path + "/w")
    assert dict(back.dtypes) == {"n": "string", "t": "string", "extra": "bigint"}
    assert back.count() == 1501 and back.where("n is null").count() == 0 and back.where("extra = 7").count() == 1


def test_xlsx_ignores_a_stale_dimension(spark, tmpdir_path):
    XL.write_xlsx(spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string").coalesce(1), tmpdir_path + "/d")
    path = next(os.path.join(d, f) for d, _, fs in os.walk(tmpdir_path + "/d") for f in fs if f.endswith(".xlsx"))
    with zipfile.ZipFile(path) as z:
        members = {n: z.read(n) for n in z.namelist()}
    sheet = next(n for n in members if n.startswith("xl/worksheets/"))
    text = members[sheet].decode()
    if "<dimension" in text:
        import re
        text = re.sub(r"<dimension[^>]*/>", '<dimension ref="A1"/>', text)
    else:
        text = text.replace("<sheetData>", '<dimension ref="A1"/><sheetData>', 1)
    members[sheet] = text.encode()
    os.makedirs(tmpdir_path + "/e")
    with zipfile.ZipFile(tmpdir_path + "/e/stale.xlsx", "w") as z:
        for n, b in members.items():
            z.writestr(n, b)
    assert XL.read_xlsx(spark, tmpdir_path + "/e").count() == 2
    inv = XL.sheet_inventory_df(spark, tmpdir_path + "/e").first()
    assert (inv.row_count, inv.column_count) == (3, 2)


def test_convert_mixed_folder_keeps_every_row(spark, tmpdir_path):
    src = tmpdir_path + "/in"
    write(src, "a.csv", "id,name\n1,x\n2,y\n")
    write(src, "b.csv", "id,name\n3,z\n")
    write(src, "c.json", json.dumps([{"id": 4, "name": "j", "extra": True}] + [
        {"id": i, "name": "n" * 40, "extra": False} for i in range(100, 140)]))
    res = convert(spark, src, "json", tmpdir_path + "/out")
    assert res.rows_in == 44 and res.input_format == "csv+json"
    back = spark.read.option("multiLine", True).json(tmpdir_path + "/out")
    assert back.count() == 44 and {r.id for r in back.where("extra is null").collect()} == {1, 2, 3}
    write(src, "d.txt", "no format here")
    with pytest.raises(ValueError, match="d.txt"):
        convert(spark, src, "json", tmpdir_path + "/out2")


def test_xml_payload_schema_covers_all_payloads(spark):
    df = spark.createDataFrame([(1, "<r><a>1</a></r>"), (2, "<r><a>2</a><b>text</b></r>"), (3, None),
                                (4, "<r><c>x</c></r>")], "id int, p string")
    got = {r.id: r.converted for r in convert_text_column(df, "p", "xml", "json").collect()}
    assert json.loads(got[2]) == {"a": 2, "b": "text"} and json.loads(got[4]) == {"c": "x"} and got[3] is None


def test_long_strings_do_not_overflow(spark):
    long_text = "x" * 1_000_000 + '\\"' * 1000
    doc = '{"aKey": "' + long_text + '", "b": [[{"c": 1}]]}'
    df = spark.createDataFrame([(doc,)], "j string")
    r = df.select(json_depth(F.col("j")).alias("d"), restyle_json_text(F.col("j"), "snake_case").alias("t")).first()
    assert r.d == 4 and '"a_key"' in r.t and long_text in r.t


@pytest.mark.parametrize("doc,depth", [("1", 0), ("{}", 0), ('{"a":1}', 1), ("[]", 0), ('{"a":{"b":[1,{"c":"[{"}]}}', 4),
                                       ("[[],[]]", 1), ('[ [ [ 1 ] , 2 ] , {"x": { } } ]', 3)])
def test_depth_of_small_documents(spark, doc, depth):
    assert spark.createDataFrame([(doc,)], "j string").select(json_depth(F.col("j"))).first()[0] == depth


def test_depth_beyond_the_threshold(spark):
    rows = [(k, "[" * k + "1" + "]" * k) for k in range(1, 25)]
    got = spark.createDataFrame(rows, "k int, j string").select("k", json_depth(F.col("j")).alias("d")).collect()
    assert all(r.k == r.d for r in got)


def test_repeated_map_keys_keep_the_last(spark):
    df = spark.createDataFrame([("| a | a |\n|---|---|\n| 1 | 2 |",)], "text string").withColumn("path", F.lit("p"))
    assert MD.markdown_table_rows(df).first().cells == {"a": "2"}
    meta, _ = MD.frontmatter(F.col("t"))
    fm = spark.createDataFrame([("---\nk: 1\nk: 2\n---\nbody",)], "t string").select(meta.alias("m")).first().m
    assert fm == {"k": "2"}
    maps = spark.createDataFrame([(1, {"first_name": "x", "firstName": "y"})], "id int, m map<string,string>")
    assert len(KEYS.key_style(maps, "camelCase").first()["m"]) == 1
    pairs = spark.sql("select array(struct('a' as key, 1 as value), struct('b' as key, 2 as value), struct('a' as key, 3 as value)) e")
    assert pairs.select(map_last_wins(F.col("e"))).first()[0] == {"b": 2, "a": 3}


def test_unique_and_duplicates_with_maps(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("g", T.StringType()),
                           T.StructField("m", T.MapType(T.StringType(), T.LongType())),
                           T.StructField("s", T.StructType([T.StructField("m", T.MapType(T.StringType(), T.LongType()))]))])
    rows = [(1, "a", {"x": 1}, ({"y": 1},)), (2, "a", {"x": 2}, ({"y": 1},)), (3, "b", None, None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in FILT.filter_unique(df, "g", ["id"]).collect()) == [1, 3]
    assert sorted(r.id for r in FILT.filter_unique(df, "s", ["id"]).collect()) == [1, 3]
    assert FILT.filter_duplicates(df.union(df)).count() == 3
    assert FILT.filter_duplicates(df.drop("id", "m").where("g = 'a'")).count() == 1


def test_transform_column_binds_the_old_value(spark):
    df = spark.createDataFrame([(1, 10, 100)], "value_id int, v int, value int")
    assert COLS.transform_column(df, "v", "value + value_id").first() == (1, 11, 100)
    assert COLS.transform_column(df, "value", "value * 2").first() == (1, 10, 200)
    assert COLS.transform_column(df, "v", "length('value')").first() == (1, 5, 100)
