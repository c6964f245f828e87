"""Well-formedness of texts, paths that are asked for, and retention of log days."""
import os
from xml.etree import ElementTree

from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import quality as Q
from quire.sources.files import every_file

SF = "/root/testdata/sf0.001"


def test_pages_that_are_not_well_formed(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {int(r.field): r.row for r in Q.xml_text_checks(pages, "html", "page_id").collect()}
    want = {}
    for r in pages.collect():
        try:
            ElementTree.fromstring(r.html)
        except ElementTree.ParseError as e:
            want[r.page_id] = e.position[0]
    assert got == want and want
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<a/>"), (4, "<a>\n\n&</a>")], "k int, x string")
    assert {(r.field, r.row, r.code) for r in Q.xml_text_checks(odd, "x", "k").collect()} == {
        ("2", 1, "INVALID_XML"), ("4", 3, "INVALID_XML")}


def test_paths_asked_for(spark, tmpdir_path):
    os.makedirs(tmpdir_path + "/in/sub dir")
    for name, text in (("a.csv", "x"), ("sub dir/b+c%.csv", "y"), ("empty one.csv", ""), ("d.txt", "z")):
        with open(f"{tmpdir_path}/in/{name}", "w") as f:
            f.write(text)
    names = ["a.csv", "sub dir/b+c%.csv", "empty one.csv", "d.txt", "sub dir", "sub dir/", "none.csv", "a.csv/x"]
    asked = spark.createDataFrame([(f"{tmpdir_path}/in/{n}",) for n in names] + [(f"file:{tmpdir_path}/in/a.csv",)], "path string")
    got = sorted((os.path.relpath(r.field.replace("file:", ""), tmpdir_path + "/in"), r.code, r.field.endswith("/"))
                 for r in Q.path_checks(spark, asked, tmpdir_path + "/in", "csv").collect())
    assert got == [("a.csv/x", "FILE_NOT_FOUND", False), ("d.txt", "EXTENSION_MISMATCH", False), ("empty one.csv", "EMPTY_FILE", False),
                   ("none.csv", "FILE_NOT_FOUND", False), ("sub dir", "NOT_A_FILE", False), ("sub dir", "NOT_A_FILE", True)]
    nowhere = Q.path_checks(spark, asked, tmpdir_path + "/no", "csv")
    assert {r.code for r in nowhere.collect()} == {"FILE_NOT_FOUND"} and nowhere.count() == 9
    assert every_file(spark, tmpdir_path + "/in").count() == 4


def test_expired_days_go_whole(spark, tmpdir_path):
    log = tmpdir_path + "/log"
    A.append_audit_log(A.audit_events_from(spark.read.parquet(f"{SF}/events.parquet")), log)
    sizes = {d: sum(os.path.getsize(f"{log}/{d}/{f}") for f in os.listdir(f"{log}/{d}") if f.startswith("part-"))
             for d in os.listdir(log) if d.startswith("date=")}
    days = sorted(sizes)
    cut = days[len(days) // 2].partition("=")[2]
    before = spark.read.parquet(log).count()
    r = A.drop_expired(spark, log, f"{cut} 13:00:00", 0).first()
    gone = [d for d in days if d < f"date={cut}"]
    assert (r.removed_days, r.freed_bytes) == (len(gone), sum(sizes[d] for d in gone))
    left = spark.read.parquet(log)
    assert left.count() == before - r.removed_records and left.agg(F.min("date").cast("string")).first()[0] == cut
    assert tuple(A.drop_expired(spark, log, f"{cut} 13:00:00", 0).first()) == (0, 0, 0, 0)
