"""XML texts by parser events: broken markup in linear time, trees, and payload conversions."""
import time

import pytest

from quire.plans.pipeline import convert_text_column
from quire.sources import xml_text as X


@pytest.mark.parametrize("piece", ["<!--", "<![CDATA[", "<!DOCTYPE ", "<a>", "<a ", "<?x", "&lt;", "<a b='", "]]>"])
def test_a_megabyte_of_broken_markup(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.time()
    assert isinstance(X.entries(text), list) and X.broken_place(text) is not None
    assert time.time() - start < 3


def test_entries_before_the_break_stay():
    assert X.entries("<r><a>1</a><b>2</c></r>") == [("a", "1", "string")]
    assert X.entries("") == [] and X.entries(None) == [] and X.entries("plain") == []


def test_broken_places():
    assert X.broken_place("<a>\n <b></c>\n</a>") == ("mismatched tag", 2, 7)
    assert X.broken_place("﻿<a/>") is None and X.broken_place(None) is None
    bomb = '<!DOCTYPE a [<!ENTITY x "xxxxxxxxxx">' + "".join(f'<!ENTITY x{i} "{("&x" + (str(i - 1) if i else "") + ";") * 10}">'
                                                            for i in range(12)) + "]><a>&x11;</a>"
    assert X.broken_place(bomb) is not None     # entities that blow up are refused


def converted(spark, texts, a, b, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    return [r.converted for r in convert_text_column(df, "x", a, b, **kw).orderBy("id").collect()]


def test_json_payloads(spark):
    texts = ['{"a":1,"A":2}', '[[1,"x,y"],[null,true]]', "[1,2.0,1e300]", "[]", '{"a":NaN}', "{", None, '{"b":{"c":[1]}}', '"t"']
    assert converted(spark, texts, "json", "csv") == [
        "a,A\n1,2", '1,"x,y"\n,true', "value\n1\n2\n1e+300", "", None, None, None, 'b\n"{""c"":[1]}"', "value\nt"]
    assert converted(spark, texts, "json", "xml") == [
        "<root><a>1</a><A>2</A></root>", "<root><item>1</item><item>x,y</item><item/><item>true</item></root>",
        "<root><item>1</item><item>2</item><item>1e+300</item></root>", "<root/>", None, None, None, "<b><c>1</c></b>",
        "<root>t</root>"]


def test_xml_payloads(spark):
    texts = ["<order><id>1</id></order>", "<o><r><a>1</a></r><r><a>2</a><b/></r></o>", "<a>t</a>", "<a><b></a>", None]
    assert converted(spark, texts, "xml", "json", document=True) == [
        '{"order":{"id":["1"]}}', '{"o":{"r":[{"a":["1"]},{"a":["2"],"b":[""]}]}}', '{"a":"t"}', None, None]
    assert converted(spark, texts, "xml", "csv") == ["id\n1", "a,b\n1,\n2,", "value\nt", None, None]
    assert converted(spark, texts, "xml", "xml", key_style="uppercase")[:2] == [
        "<ORDER><ID>1</ID></ORDER>", "<O><R><A>1</A></R><R><A>2</A><B/></R></O>"]
    with pytest.raises(ValueError):
        converted(spark, texts, "xml", "md")
