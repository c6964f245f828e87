"""Workbooks: cell kinds, number formats, rich text, overwriting what is read, sheets that go on."""
import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import xlsx as XL

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, strings="", styles="", late=False):
    """A workbook from the XML of its rows."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{XL.MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(late)}"/><sheets>'
                   + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{XL.PACKAGE}">' + "".join(
            f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{XL.MAIN}">{strings}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{XL.MAIN}">{styles}</styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{XL.MAIN}"><sheetData>{rows}</sheetData></worksheet>')


STYLES = ('<numFmts><numFmt numFmtId="200" formatCode="yyyy-mm-dd"/><numFmt numFmtId="201" formatCode="[Red]0.0&quot;days&quot;"/>'
          '<numFmt numFmtId="202" formatCode="[h]:mm"/></numFmts>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/><xf numFmtId="201"/><xf numFmtId="2"/></cellXfs>')
STRINGS = ("<si><t>name</t></si><si><r><t>ri</t></r><r><rPr/><t>ch</t></r><rPh><t>no</t></rPh></si>"
           "<si><t>a_x0001_b_x005F_x0002_</t></si>")


def test_cells_of_every_kind(spark, tmpdir_path):
    rows = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="C1"><v>5</v></c>'
            '<c r="D1" t="str"><f>1</f><v>f</v></c><c r="F1" s="1"/></row>'
            '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>44927</v></c><c r="C2"><v>1.5</v></c>'
            '<c r="D2" t="b"><v>1</v></c></row>'
            '<row r="4"><c t="s"><v>2</v></c><c s="2"><v>44927.75</v></c><c s="3"><v>2</v></c><c t="b"><v>0</v></c></row>'
            '<row r="5"><c r="A5"/></row>'
            '<row r="6"><c r="A6" t="e"><v>#DIV/0!</v></c><c r="B6" t="d"><v>2023-01-02T03:04:05Z</v></c><c r="C6"><v>-3</v></c></row>')
    workbook(tmpdir_path + "/w/a.xlsx", {"S": rows}, STRINGS, STYLES)
    df = XL.read_xlsx(spark, tmpdir_path + "/w")
    assert df.dtypes == [("name", "string"), ("when", "timestamp"), ("Column3", "double"), ("f", "boolean"),
                         ("Column5", "string"), ("Column6", "string")]
    got = sorted(tuple(r)[:4] for r in df.withColumn("when", F.date_format("when", "yyyy-MM-dd HH:mm:ss")).collect())
    assert got == [("#DIV/0!", "2023-01-02 03:04:05", -3.0, None), ("a\x01b_x0002_", "2023-01-01 18:00:00", 2.0, False),
                   ("rich", "2023-01-01 00:00:00", 1.5, True)]


def test_1904_dates_mixed_columns_and_missing_titles(spark, tmpdir_path):
    workbook(tmpdir_path + "/w/a.xlsx", {"S": '<row><c t="str"><v>d</v></c></row><row><c s="1"><v>1</v></c></row>'}, "", STYLES, True)
    assert XL.read_xlsx(spark, tmpdir_path + "/w").select(F.col("d").cast("string")).first()[0] == "1904-01-02 00:00:00"
    workbook(tmpdir_path + "/w/b.xlsx", {"S": '<row><c t="str"><v>d</v></c></row><row><c><v>2.50</v></c></row><row><c t="b"><v>1</v></c>'
                                              '</row><row><c><v>12345678901234567890</v></c></row>'}, "", STYLES)
    got = sorted(r[0] for r in XL.read_xlsx(spark, tmpdir_path + "/w").collect())
    assert got == ["12345678901234567000", "1904-01-02T00:00:00.000Z", "2.5", "true"] or got[1:] == [
        "1904-01-02T00:00:00.000Z", "2.5", "true"]
    workbook(tmpdir_path + "/n/a.xlsx", {"S": '<row r="3"><c r="B3"><v>1</v></c></row><row r="4"><c r="B4"><v>2</v></c></row>'})
    bare = XL.read_xlsx(spark, tmpdir_path + "/n")
    assert bare.columns == ["Column1", "Column2"] and sorted(r.Column2 for r in bare.collect()) == [1, 2]


def test_round_trip_of_odd_values(spark, tmpdir_path):
    t = dt.datetime(2023, 5, 6, 7, 8, 9, 123456)
    rows = [(1, "a\x00\x01\x1f\r\n\tz", t, dt.date(2024, 2, 29), float("nan"), True, [1, 2]),
            (2, "_x0041_ <&> ]]> ￾😀", dt.datetime(1899, 1, 1), dt.date(1, 1, 1), 0.1, False, None),
            (2 ** 62, "  blanks  ", dt.datetime(9999, 12, 31, 23, 59, 59), dt.date(9999, 12, 31), float("-inf"), None, []),
            (None, None, dt.datetime(1900, 1, 1), None, -1e300, None, None)]
    df = spark.createDataFrame(rows, "n long, s string, ts timestamp_ntz, d date, x double, b boolean, l array<int>")
    XL.write_xlsx(df, tmpdir_path + "/o")
    back = XL.read_xlsx(spark, tmpdir_path + "/o")
    assert dict(back.dtypes) == {"n": "bigint", "s": "string", "ts": "string", "d": "string", "x": "double", "b": "boolean",
                                 "l": "string"}
    got = {r.n: r for r in back.collect()}
    assert {k: r.s for k, r in got.items()} == {r[0]: r[1] for r in rows}
    assert got[1].x is None and got[2].x == 0.1 and got[2 ** 62].x is None and got[None].x == -1e300
    assert got[1].b is True and got[2].b is False and got[1].l == "[1,2]"
    assert got[2].ts.startswith("1899-01-01") and got[2].d == "0001-01-01"      # before the first day number: text
    late = XL.read_xlsx(spark, tmpdir_path + "/o", schema="n long, ts timestamp_ntz, d date")
    late = {r.n: (r.ts, r.d) for r in late.collect()}
    assert late[1] == (t, dt.date(2024, 2, 29)) and late[2 ** 62] == (rows[2][2], rows[2][3])


def test_overwriting_the_folder_that_is_read(spark, tmpdir_path):
    out = tmpdir_path + "/o"
    XL.write_xlsx(spark.range(40).selectExpr("id", "cast(id as string) s").repartition(2), out)
    XL.write_xlsx(XL.read_xlsx(spark, out).withColumn("twice", F.col("id") * 2), out)
    back = XL.read_xlsx(spark, out)
    assert back.columns == ["id", "s", "twice"] and back.count() == 40
    with pytest.raises(Exception):
        XL.write_xlsx(back.select(F.raise_error(F.lit("broken")).alias("x")), out)
    assert XL.read_xlsx(spark, out).count() == 40       # a write that fails changes nothing
    assert os.listdir(tmpdir_path) == ["o"]
    with pytest.raises(FileExistsError):
        XL.write_xlsx(back, out, overwrite=False)


def test_sheets_that_go_on_and_empty_tables(spark, tmpdir_path):
    XL.write_xlsx(spark.range(25).coalesce(1), tmpdir_path + "/o", sheet_name='S & "q"', limit=11)
    assert sorted(r.id for r in XL.read_xlsx(spark, tmpdir_path + "/o").collect()) == list(range(25))
    inv = sorted(map(tuple, XL.sheet_inventory_df(spark, tmpdir_path + "/o").drop("path").collect()))
    assert inv == [('S & "q"', 0, 11, 1), ('S & "q"~2', 1, 11, 1), ('S & "q"~3', 2, 6, 1)]
    XL.write_xlsx(spark.createDataFrame([], "a long, b string"), tmpdir_path + "/e")
    none = XL.read_xlsx(spark, tmpdir_path + "/e")
    assert none.columns == ["a", "b"] and none.count() == 0
    for name in os.listdir(tmpdir_path + "/o"):         # the comment is part of a sound zip file
        with zipfile.ZipFile(f"{tmpdir_path}/o/{name}") as z:
            assert z.testzip() is None and z.comment == b"\n"
