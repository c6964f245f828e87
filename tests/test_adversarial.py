"""Adversarial values through every writer and reader (SURVEY §5 (d)): null, '', blanks,
pipes, quotes, newlines, non-BMP text, negative numbers, 1e21."""
import os

import pytest

from quire.sources import csv as CSV
from quire.sources import json as JS
from quire.sources import markdown as MD
from quire.sources import xlsx as XL

TEXTS = [None, "", "   ", "a|b", 'q"uote', "line\nbreak", "emoji \U0001F600 ok", "-5", "1e21", "tab\there"]


@pytest.fixture(scope="module")
def adversarial(spark):
    rows = [(i, t, (-1.5 * i) if i % 3 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, s string, d double")


def _by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_csv(spark, adversarial, tmpdir_path):
    out = os.path.join(tmpdir_path, "csv")
    CSV.write_csv(adversarial, out)
    back = _by_id(CSV.read_csv(spark, out, sep=",", multiline=True, schema="id long, s string, d double"))
    for i, t in enumerate(TEXTS):
        want = None if t is None or t.strip() == "" else t.strip()  # S3 cleaning: trim, '' -> null
        assert back[i]["s"] == want, (i, t, back[i]["s"])
        assert back[i]["d"] == adversarial.collect()[i]["d"]


def test_json(spark, adversarial, tmpdir_path):
    out = os.path.join(tmpdir_path, "json")
    JS.write_json(adversarial, out, layout="array")
    back = _by_id(JS.read_json(spark, out))
    for i, t in enumerate(TEXTS):
        assert back[i]["s"] == t


def test_xlsx(spark, adversarial, tmpdir_path):
    out = os.path.join(tmpdir_path, "xlsx")
    XL.write_xlsx(adversarial, out)
    back = _by_id(XL.read_xlsx(spark, out, schema=adversarial.schema))
    for i, t in enumerate(TEXTS):
        if t in (None, ""):
            assert back[i]["s"] is None
        else:
            assert back[i]["s"] == t


def test_markdown(spark, adversarial, tmpdir_path):
    out = os.path.join(tmpdir_path, "md")
    MD.write_markdown_table(adversarial, out)
    back = _by_id(MD.read_markdown_table(spark, out))
    for i, t in enumerate(TEXTS):
        want = None if t is None or t.strip() == "" else t.replace("\n", " ").strip()  # K12: newline -> space
        assert back[i]["s"] == want, (i, t, back[i]["s"])


def test_big_and_special_doubles(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 1e21), (2, -0.0), (3, float("nan"))], "id long, d double")
    out = os.path.join(tmpdir_path, "json2")
    JS.write_json(df, out)
    back = _by_id(JS.read_json(spark, out, lines=True))
    assert back[1]["d"] == 1e21 and back[2]["d"] == 0.0 and back[3]["d"] is None  # NaN has no JSON form
