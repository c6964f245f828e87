"""Lines of Markdown pipe tables from byte ranges.

Lines without a pipe separate runs of lines with one; a table goes from the first line of a run that has at
least two pipes and is followed by a line that holds a hyphen to the end of the run. What a range does to a
run that begins before it depends on that run's state only: no run, a run without a table and its last line,
or a table and its header.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import ranges as R

LINES = "file long, table_index int, row_index int, header string, line string"
_PROFILE = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("lines", pa.int64()), ("hyphen", pa.bool_()),
                      ("begun", pa.bool_()), ("breaks", pa.bool_()), ("tables", pa.int64()), ("size", pa.int64()),
                      ("header", pa.string()), ("last", pa.string())])
_PROFILE_DDL = ("file long, block long, lines long, hyphen boolean, begun boolean, breaks boolean, tables long, size long, "
                "header string, last string")


def _titles(lines: pa.Array) -> np.ndarray:
    """Lines with at least two pipes that are not escaped."""
    if R.contains(lines, "\\").any():
        lines = pc.replace_substring(pc.replace_substring(lines, "\\\\", "\u0001"), "\\|", "\u0002")
    return R.count(lines, "|") >= 2


class _Run:
    """The run that is being read: ``header`` and ``size`` (lines so far) of its table, or its ``last`` line if a table
    could begin there."""

    def __init__(self, tables: int = 0, size: int = 0, header: str | None = None, last: str | None = None):
        self.tables, self.size, self.header, self.last = tables, size, header, last

    def feed(self, lines: pa.Array) -> list[tuple[int, int, int, int, str]]:
        """(first line, end, place of the first in its table, table, header) of the stretches of ``lines`` in tables."""
        piped, found = R.contains(lines, "|"), []
        title, hyphen = _titles(lines), R.contains(lines, "-")
        starts = np.flatnonzero(title[:-1] & piped[1:] & hyphen[1:])        # headers, where no table is open
        edges = np.flatnonzero(np.diff(np.concatenate(([0], piped.astype(np.int8), [0]))))
        for a, e in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if a:
                self.size, self.header, self.last = 0, None, None
            at = a
            if self.header is None:
                i = int(np.searchsorted(starts, a))
                if self.last is not None and hyphen[a]:
                    self.header = self.last
                elif i < len(starts) and starts[i] < e - 1:
                    self.header, at = lines[int(starts[i])].as_py(), int(starts[i]) + 1
                else:
                    self.last = lines[e - 1].as_py() if title[e - 1] else None
                    continue
                self.size, self.last, self.tables = 1, None, self.tables + 1
            found.append((at, e, self.size, self.tables - 1, self.header))
            self.size += e - at
        if not piped[-1]:
            self.size, self.header, self.last = 0, None, None
        return found


class _Profile:
    """What a range does to the run before it: how many ``lines`` it adds, if the first holds a hyphen, if they begin a
    table by themselves; and if it ``breaks`` that run, the tables that come then. Also the run that it leaves."""

    def __init__(self, file: int, block: int, size: int):
        self.file, self.block = file, block
        self.hyphen, self.breaks, self.lines = None, False, 0
        self.head, self.rest = _Run(), _Run()

    def feed(self, lines: pa.Array) -> None:
        if self.hyphen is None:
            self.hyphen = "-" in lines[0].as_py()
        if not self.breaks:
            gaps = np.flatnonzero(~R.contains(lines, "|"))
            end = int(gaps[0]) if len(gaps) else len(lines)
            if end:
                self.head.feed(lines.slice(0, end))
                self.lines += end
            self.breaks, lines = bool(len(gaps)), lines.slice(end)
        if len(lines):
            self.rest.feed(lines)

    def row(self) -> dict:
        left = self.rest if self.breaks else self.head
        return {"file": self.file, "block": self.block, "lines": self.lines, "hyphen": self.hyphen,
                "begun": self.head.tables > 0, "breaks": self.breaks, "tables": self.rest.tables, "size": left.size,
                "header": left.header, "last": left.last}


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return R.by_range(batches, _Profile, _PROFILE)


def range_profile(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """One row per range of every file under ``path``: what it does to a run that begins before it."""
    return R.pieces(spark, path, "\n", glob).mapInArrow(_profile, _PROFILE_DDL)


def _states(profile: DataFrame) -> list[tuple]:
    """(file, block, and what ``_Run`` takes) at the start of the ranges that do not start their file."""
    many = profile.groupBy("file").count().where("count > 1").select("file")
    files: dict[int, list] = {}
    for r in profile.join(many, "file", "left_semi").orderBy("block").collect():
        files.setdefault(r.file, []).append(r)
    states = []
    for file, rows in files.items():
        run = _Run()
        for k, r in enumerate(rows):
            if k:
                states.append((file, r.block, run.tables, run.size, run.header, run.last))
            run = _after(run, r)
    return states


def _after(run: _Run, r) -> _Run:
    """The run that a range leaves, after the one before it."""
    if run.header is not None:
        left = _Run(run.tables, run.size + r.lines, run.header)
    elif run.last is not None and r.lines and r.hyphen:
        left = _Run(run.tables + 1, 1 + r.lines, run.last)
    elif r.lines:
        left = _Run(run.tables + r.begun, r.size, r.header, r.last)
    else:
        left = run
    return _Run(left.tables + r.tables, r.size, r.header, r.last) if r.breaks else left


def _stretches(starts: R.Starts, all_tables: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, key = None, None
    for k, _, lines in R.runs(batches):
        if k != key:
            run, key = _Run(*(starts.get(*k) or ())), k
        at, table, row, header = [], [], [], []
        for a, e, place, index, title in run.feed(lines):
            a, place = (a, place) if place > 1 else (a + 1, 2)              # the separator is no row
            if a < e and (all_tables or index == 0):
                at.append(np.arange(a, e))
                row.append(np.arange(e - a) + (place - 2))
                table.append((index, e - a))
                header.append(title)
        if not at:
            continue
        n = [size for _, size in table]
        titles = pa.array(header, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(sum(n), k[0], np.int64)), pa.array(np.repeat([i for i, _ in table], n).astype(np.int32)),
             pa.array(np.concatenate(row).astype(np.int32)), titles, lines.take(pa.array(np.concatenate(at))).cast(pa.string())],
            ["file", "table_index", "row_index", "header", "line"])


def table_rows(spark: SparkSession, path, profile: DataFrame, all_tables: bool = False, glob: str | None = None) -> DataFrame:
    """file, table_index, row_index, and the header and the line of every row of the tables under ``path``, or of the
    first table of each file."""
    starts = R.Starts(_states(profile))
    return R.pieces(spark, path, "\n", glob).mapInArrow(partial(_stretches, starts, all_tables), LINES)
