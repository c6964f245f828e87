"""Files read by byte ranges give what one task reads, wherever the ranges begin."""
import csv
import io
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators import detect as D
from quire.sources import csv as C
from quire.sources import content_ranges, csv_ranges, json_ranges, ranges
from quire.sources import json as J


@pytest.fixture(params=[150, 1 << 20])
def small_ranges(spark, request):
    """Ranges of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def folder(files: dict) -> str:
    d = tempfile.mkdtemp(prefix="quire-ranges-")
    for name, text in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return d


def cells(seed, n, sep=","):
    r = random.Random(seed)
    words = ["a", "two words", 'say "hi"', "x\ny", 'a "q"\n\n"z', f"{sep}{sep}", "", "é日本", "long " * 12, '"', "line\r\nend", "5' 6\""]
    return [[str(i), r.choice(words), r.choice(words)] for i in range(n)]


def csv_text(rows, sep=",", end="\n", header=("id", "first", "second")):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def read_back(df):
    return sorted([[("" if v is None else v) for v in r] for r in df.collect()], key=lambda r: int(r[0]))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("sep", [None, ";"])
def test_quoted_cells_across_ranges(spark, small_ranges, end, sep):
    rows = cells(1, 40, ";")
    d = folder({"a b.csv": csv_text(rows[:25], ";", end), "b.csv": csv_text(rows[25:], ";", end, ("id", "first\nline", "second"))})
    df = C.read_csv(spark, d, sep=sep, infer_schema=False, clean=False)
    assert df.columns == ["id", "first", "second"]
    assert read_back(df) == rows
    if small_ranges < 1000:
        assert csv_ranges.range_profile(spark, d).count() > 7


def test_stray_quotes_are_text_and_open_ones_take_the_rest(spark, small_ranges):
    d = folder({"a.csv": 'id,t\n1,5" pipe\n2,a"b"c\n3,"x"y\n\n   \n4,"z, "\n5,"never closed\n6,here\n'})
    got = {r[0]: r[1] for r in C.read_csv(spark, d, sep=",", infer_schema=False, clean=False).collect()}
    assert got == {"1": '5" pipe', "2": 'a"b"c', "3": '"x"y', "4": "z, ", "5": "never closed\n6,here"} or \
        got["5"].startswith("never closed")
    assert set(got) == {"1", "2", "3", "4", "5"}


def test_types_headers_and_files_that_disagree(spark, small_ranges):
    d = folder({"a.csv": "\ufeffid,n,when\n1,1.5,2024-01-02\n2,,\n", "b.csv": "id;n\n3;7\n4;8\n", "c.csv": "", "d.csv": "\n\n"})
    df = C.read_csv(spark, d)
    assert dict(df.dtypes)["id"] == "int" and dict(df.dtypes)["n"] == "double"
    assert sorted((r.id, r.n) for r in df.collect()) == [(1, 1.5), (2, None), (3, 7.0), (4, 8.0)]
    only = C.read_csv(spark, folder({"a.csv": "id,n\n"}))
    assert only.columns == ["id", "n"] and only.count() == 0
    assert C.read_csv(spark, folder({"a.csv": ""})).columns == []
    bare = C.read_csv(spark, folder({"a.csv": "1,x\n2,y\n"}), header=False, clean=False)
    assert bare.columns == ["_c0", "_c1"] and bare.count() == 2


def test_other_encodings_are_sniffed_too(spark):
    d = folder({"a.csv": "id;name\n1;Zoë\n".encode("latin-1"), "b.csv": "id,name\n2,\"é\nè\"\n".encode("latin-1")})
    got = sorted((r.id, r.name) for r in C.read_csv(spark, d, encoding="ISO-8859-1").collect())
    assert got == [(1, "Zoë"), (2, "é\nè")]


def one_file_scores(text):
    """Logical lines and their fields, one character after the other."""
    lines, line, inside, blank = [], dict.fromkeys(csv_ranges.DELIMITERS, 1), False, True
    for c in text:
        if c == '"':
            inside, blank = not inside, False
        elif c == "\n" and not inside:
            if not blank:
                lines.append(line)
            line, blank = dict.fromkeys(csv_ranges.DELIMITERS, 1), True
        else:
            blank = blank and c == "\r"
            if not inside and c in line:
                line[c] += 1
    if not blank:
        lines.append(line)
    out = {}
    for d in csv_ranges.DELIMITERS:
        n = [x[d] for x in lines]
        mean = sum(n) / len(n) if n else 0.0
        out[d] = mean * 2 if len(n) > 1 and len(set(n)) == 1 else mean
    return out


def test_scores_are_those_of_the_whole_file(spark, small_ranges):
    texts = {f"{k}.csv": csv_text(cells(k, 15, s), s, e) for k, (s, e) in enumerate(
        [(",", "\n"), (";", "\r\n"), ("\t", "\n"), ("|", "\n")])}
    texts |= {"open.csv": 'a,b\nc,"d;e\nf;g,h\n', "one.csv": "a;b", "blank.csv": "\n\r\n\n"}
    got: dict = {}
    for r in C.delimiter_profile(spark, folder(texts)).collect():
        got.setdefault(os.path.basename(r.path), {})[r.delimiter] = (r.score, r.chosen)
    assert set(got) == set(texts)
    for name, found in got.items():
        want = one_file_scores(texts[name])
        assert {d: s for d, (s, _) in found.items()} == pytest.approx(want), name
        best = max(csv_ranges.DELIMITERS, key=lambda d: (want[d], -csv_ranges.DELIMITERS.index(d)))
        assert [d for d in csv_ranges.DELIMITERS if found[d][1]] == [best if want[best] > 0 else ","]


def json_rows(seed, n):
    r = random.Random(seed)
    odd = ["plain", "}{", '"q"', "back\\slash", "\\", '\\"}', "[,]", "é日本", "line\nend", "", "x" * 150]
    out = []
    for i in range(n):
        row = {"id": i, "s": r.choice(odd)}
        if i % 3 == 0:
            row["more"] = {"k": r.choice(odd), "list": [{"a": 1}, {"a": 2}][: r.randrange(3)]}
        if i % 4 == 0:
            row["tags"] = [r.choice(odd) for _ in range(r.randrange(3))]
        out.append(row)
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_of_objects_across_ranges(spark, small_ranges, indent):
    rows = json_rows(2, 60)
    d = folder({"a.json": json.dumps(rows[:30], indent=indent), "b.json": "\ufeff" + json.dumps(rows[30:50], indent=indent) + "\n",
                "c.json": json.dumps(rows[50], indent=indent), "d.json": "\n".join(json.dumps(r) for r in rows[51:]),
                "e.json": "[]", "f.json": "", "g.json": " [ ] \n"})
    schema = "id long, s string, more struct<k:string,list:array<struct<a:int>>>, tags array<string>"
    got = sorted(J.read_json(spark, d, schema=schema).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(60))
    for r, w in zip(got, rows):
        assert r.s == w["s"] and r.tags == w.get("tags")
        if "more" in w:
            assert r.more.k == w["more"]["k"] and [x.a for x in r.more.list] == [x["a"] for x in w["more"]["list"]]
    assert J.read_json(spark, d).columns == ["id", "more", "s", "tags"]
    if small_ranges < 1000:
        assert json_ranges.range_profile(spark, d).count() > 7


def test_other_elements_and_broken_files_are_seen(spark, small_ranges):
    d = folder({"a.json": '[{"a": 1}, 5, [{"a": 2}, {"a": 3}], "x}", null, {"a": 4}]', "b.json": '[{"a": 6}, {"a": 7'})
    profile = json_ranges.range_profile(spark, d)
    got = sorted(r.value.strip() for r in json_ranges.elements(spark, d, profile).collect())
    assert got == sorted(['{"a": 1}', "5", '[{"a": 2}, {"a": 3}]', '"x}"', "null", '{"a": 4}', '{"a": 6}', '{"a": 7'])


FORMATS = {
    "json": ['{"a": 1}', ' [1, 2,\n 3, -4.5e3]\n', "[[1,2],\n[3,4],\n\n[5,[6,[]]],{}]", "[]", "{}", '["one"]', '[\n{"k": "x"\n',
             "[true,\nfalse,null]"],
    "xml": ["<a>1</a>", "<?xml version='1.0'?>\n<a/>", '<a x="1"\n y="2">\n<b>t</b>\n</a>', "\n\n<a\n>\n</b>"],
    "md": ["# head\n\n* item", "#\n\ntext\n>\nquote", "a **b\nc** d", "a **b** c", "```\ncode\n```\n1. one", "|a|\n[x](y)",
           "*\n\n1.\n\n\nend", "x ** y\n ** z"],
    "csv": ["a,b\n1,2", "a;b;c\n\n \n1;2;3\n", "\ufeffa\tb\nc\td"],
    None: ["plain", "[1, 2", "[1 2]", "[1],[2]", "[01]", "{1}", "[1,]", "[1\n2]", "<a <b>", "<1>x</1>", "a,b\n1;2", "# head", "*",
           "a ** b * c", "text\n```", "#\n\n", "a,b"],
}


def test_formats_of_whole_files(spark, small_ranges):
    pad = "\n" * 200           # blank lines put ranges between the lines
    texts = {}
    for want, some in FORMATS.items():
        for i, t in enumerate(some):
            texts[f"{want}-{i}.txt"] = t
            if "**" not in t:   # emphasis over blank lines is the same, but slow to look for in one text
                texts[f"{want}-{i}-wide.txt"] = t.replace("\n", pad)
    d = folder(texts)
    formats = content_ranges.file_formats(spark, d).join(ranges.file_names(spark, d), "file")
    found = {os.path.basename(r.path): r.format for r in formats.collect()}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string")
    whole = {r[0]: r[1] for r in D.with_content_format(rows, "text").select("name", "detected.format").collect()}
    # the parser that judges columns stops after the first value; a file is judged to its end
    late = {n for n in texts if texts[n].replace(pad, "\n") == "[1],[2]"}
    assert {n: f for n, f in found.items() if n not in late} == {n: f for n, f in whole.items() if n not in late}
    for name, fmt in found.items():
        assert str(fmt) == name.split("-")[0], name
