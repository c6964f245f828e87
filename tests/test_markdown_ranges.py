"""Markdown tables read by byte ranges are those that the whole text has, wherever the ranges begin."""
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.sources import markdown as MD
from quire.sources import markdown_ranges


@pytest.fixture(params=[60, 1 << 20])
def small_ranges(spark, request):
    """Ranges of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def document(seed: int) -> str:
    r = random.Random(seed)
    lines = ["| a | b | a |", "|---|---|---|", "| 1 | x\\|y | 3 |", "text | one pipe", "text", "", "a|b", "- item", "  | q | w |  ",
             "| \\\\| é |", "||", "| -5 | - | |", "日本 | 2 | -", "---", "| only \\| escaped", "| long " + "cell " * 20 + "| z |"]
    return r.choice(["", "﻿"]) + r.choice(["\n", "\r\n"]).join(r.choice(lines) for _ in range(r.randrange(1, 60))) + r.choice(["", "\n"])


def folder(texts) -> str:
    d = tempfile.mkdtemp(prefix="quire-md-")
    for i, text in enumerate(texts):
        with open(os.path.join(d, f"d {i:03d}.md"), "wb") as f:
            f.write(text.encode())
    return d


def test_tables_across_ranges(spark, small_ranges):
    d = folder(document(k) for k in range(24))
    whole = MD.table_lines(MD.read_markdown_texts(spark, d)).where("row_index >= 0")
    key = F.xxhash64("path")
    expected = sorted((r.f, r.table_index, r.row_index, r.headers, r.cells) for r in whole.select(
        key.alias("f"), "table_index", "row_index", "headers", "cells").collect())
    assert len({r[:2] for r in expected}) > 20
    profile = markdown_ranges.range_profile(spark, d)
    for all_tables in (True, False):
        lines = markdown_ranges.table_rows(spark, d, profile, all_tables)
        found = MD.range_cells(lines)
        assert sorted((r.file, r.table_index, r.row_index, r.headers, r.cells) for r in found.collect()) == [
            r for r in expected if all_tables or r[1] == 0]


def test_large_table_has_many_tasks(spark, small_ranges):
    n = 400
    text = "# title\n\n| id | name |\n| --- | --- |\n" + "".join(f"| {i} | row-{i} |\n" for i in range(n))
    df = MD.read_markdown_table(spark, folder([text]))
    assert sorted((r.id, r.name) for r in df.collect()) == [(i, f"row-{i}") for i in range(n)]
    if small_ranges < len(text):
        assert df.select(F.spark_partition_id()).distinct().count() > 10


def test_rows_do_not_carry_their_table(spark):
    """Each row once held a copy of all lines of its table, which grew with the square of the file."""
    docs = spark.createDataFrame([("p", "| a |\n|---|\n| 1 |\n")], "path string, text string")
    plan = MD.table_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate posexplode\(lines#\d+\), \[\d+\]", plan)
