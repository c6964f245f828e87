"""CSV records and delimiter scores from byte ranges.

Records: a cell that starts with a quote goes on to the next lone quote, over line ends; any other quote
is text. A line is a step of a two-state machine, outside or inside a quoted cell, whose two answers
(from outside, from inside) compose over the lines of a range and over ranges.

Scores: a logical line ends at a line break outside quotes. A range's counts are kept for both start
states, apart for the part that ends a line begun before it, the lines it holds, and the line it leaves open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges as R

# The candidate delimiters, in the order that breaks ties.
DELIMITERS = (",", ";", "\t", "|")


def _patterns(sep: str) -> tuple[str, str]:
    """Does a line end inside a quoted cell, if it starts outside / inside one?"""
    s = re.escape(sep)
    rest = f'(?:[^"{s}][^{s}]*)?'               # what follows a closing quote, or a cell without one
    cells = f'(?:(?:{rest}|"(?:[^"]|"")*"{rest}){s})*'
    return (f'(?s)^{cells}"(?:[^"]|"")*$', f'(?s)^(?:[^"]|"")*(?:"{rest}{s}{cells}"(?:[^"]|"")*)?$')


class LineMachine:
    """What lines do to the two states, for one delimiter."""

    def __init__(self, sep: str):
        self.outside, self.inside = _patterns(sep)

    def answers(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the lines that hold a quote, their end from outside, their end from inside); lines without a
        quote change nothing."""
        at = np.flatnonzero(R.contains(lines, '"'))
        quoted = lines.take(pa.array(at)) if len(at) else lines.slice(0, 0)
        return at, R.matches(quoted, self.outside), R.matches(quoted, self.inside)

    @staticmethod
    def end(out: np.ndarray, ins: np.ndarray, state: bool) -> bool:
        """The state after lines with these answers."""
        fixed = np.flatnonzero(out == ins)          # such a line ends the same way from either state
        if len(fixed):
            state, out, ins = bool(out[fixed[-1]]), out[fixed[-1] + 1:], ins[fixed[-1] + 1:]
        return state ^ bool(np.count_nonzero(out) & 1)

    @staticmethod
    def before(out: np.ndarray, ins: np.ndarray, state: bool) -> np.ndarray:
        """The state before each of the lines with these answers, and after the last."""
        last = np.maximum.accumulate(np.where(out == ins, np.arange(1, len(out) + 1), 0)) if len(out) else np.empty(0, int)
        flips = np.concatenate(([0], np.cumsum(out & ~ins)))
        base = np.where(last > 0, out[last - 1], state) if len(out) else np.empty(0, bool)
        after = base ^ ((flips[1:] - flips[last]) & 1).astype(bool) if len(out) else base
        return np.concatenate(([state], after)).astype(bool)


class _Score:
    """Counts of the logical lines of a range that starts in a given state."""

    def __init__(self, inside: bool):
        self.state, self.head, self.headed = inside, [0] * len(DELIMITERS), not inside
        self.n, self.total = 0, np.zeros(len(DELIMITERS), np.int64)
        self.low, self.high = np.full(len(DELIMITERS), np.iinfo(np.int64).max), np.zeros(len(DELIMITERS), np.int64)
        self.open = np.zeros(len(DELIMITERS), np.int64)

    def feed(self, odd: np.ndarray, blank: np.ndarray, outside: np.ndarray, inside: np.ndarray) -> None:
        after = self.state ^ (np.cumsum(odd) & 1).astype(bool)
        before = np.concatenate(([self.state], after[:-1]))
        counts = np.where(before, inside, outside)
        ends = np.flatnonzero(~after)
        edge = np.concatenate(([0], ends + 1))
        if len(ends):
            upto = np.concatenate((np.zeros((len(DELIMITERS), 1), np.int64), np.cumsum(counts, axis=1)), axis=1)
            lines = upto[:, edge[1:]] - upto[:, edge[:-1]]
            lines[:, 0] += self.open
            keep = ~(blank[ends] & ~before[ends])
            if not self.headed:                     # the first line ends one that a range before began
                self.head, self.headed = lines[:, 0].tolist(), True
                keep[0] = False
            lines = lines[:, keep]
            if lines.shape[1]:
                self.n += lines.shape[1]
                self.total += lines.sum(axis=1)
                self.low, self.high = np.minimum(self.low, lines.min(axis=1)), np.maximum(self.high, lines.max(axis=1))
            self.open = np.zeros_like(self.open)
        self.open = self.open + counts[:, edge[-1]:].sum(axis=1)
        self.state = bool(after[-1]) if len(after) else self.state

    def row(self) -> dict:
        return {"ends_inside": self.state, "headed": self.headed, "head": self.head, "n": self.n,
                "total": self.total.tolist(), "low": self.low.tolist(), "high": self.high.tolist(), "open": self.open.tolist()}


_COUNTS = pa.list_(pa.int64())
_SCORE = pa.struct([("ends_inside", pa.bool_()), ("headed", pa.bool_()), ("head", _COUNTS), ("n", pa.int64()),
                    ("total", _COUNTS), ("low", _COUNTS), ("high", _COUNTS), ("open", _COUNTS)])
_SCORE_DDL = ("struct<ends_inside:boolean,headed:boolean,head:array<bigint>,n:bigint,total:array<bigint>,low:array<bigint>,"
              "high:array<bigint>,open:array<bigint>>")
_PROFILE = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("scores", pa.list_(_SCORE)),
                      ("outside", pa.list_(pa.bool_())), ("inside", pa.list_(pa.bool_())), ("header", pa.list_(pa.string()))])
_PROFILE_DDL = (f"file long, block long, scores array<{_SCORE_DDL}>, outside array<boolean>, inside array<boolean>, "
                "header array<string>")


class _Profile:
    """What a range does to every state, for every delimiter; of a file's first range also its first record."""

    def __init__(self, delimiters: tuple[str, ...], scored: bool, file: int, block: int, size: int):
        self.file, self.block = file, block
        self.scores = [_Score(False), _Score(True)] if scored else []
        self.machines = [LineMachine(d) for d in delimiters]
        self.states = [[False, True] for _ in delimiters]
        self.first: list[list[str]] = [[] for _ in delimiters]
        self.seeking = [block == 0] * len(delimiters)

    def feed(self, lines: pa.Array) -> None:
        if self.scores:
            quotes = R.count(lines, '"')
            odd, any_quote = quotes & 1, quotes > 0
            blank = R.matches(lines, "^\r?$")
            totals = np.stack([R.count(lines, d) for d in DELIMITERS])
            outside = totals.copy()
            if any_quote.any():
                at = np.flatnonzero(any_quote)
                bare = pc.replace_substring_regex(lines.take(pa.array(at)), '"[^"]*(?:"|$)', "")
                outside[:, at] = np.stack([R.count(bare, d) for d in DELIMITERS])
            for s in self.scores:
                s.feed(odd, blank, outside, totals - outside)
        for k, m in enumerate(self.machines):
            at, out, ins = m.answers(lines)
            if self.seeking[k]:
                self._seek(k, lines, at, out, ins)
            self.states[k] = [m.end(out, ins, s) for s in self.states[k]]

    def _seek(self, k: int, lines: pa.Array, at, out, ins) -> None:
        """The first record that is not blank: lines up to the first that ends outside a quoted cell."""
        answers = dict(zip(at.tolist(), zip(out.tolist(), ins.tolist())))
        state = self.states[k][0]
        for i in range(len(lines)):
            line = lines[i].as_py()
            a = answers.get(i, (False, True))
            state = a[1] if state else a[0]
            if line.strip() or self.first[k]:
                self.first[k].append(line)
            if not state and self.first[k]:
                self.seeking[k] = False
                return

    def row(self) -> dict:
        return {"file": self.file, "block": self.block, "scores": [s.row() for s in self.scores],
                "outside": [s[0] for s in self.states], "inside": [s[1] for s in self.states],
                "header": ["\n".join(f) if f else None for f in self.first]}


def _profile(delimiters: tuple[str, ...], scored: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return R.by_range(batches, partial(_Profile, delimiters, scored), _PROFILE)


def range_profile(spark: SparkSession, path, delimiters: tuple[str, ...] = DELIMITERS, scored: bool = True,
                  glob: str | None = None) -> DataFrame:
    """One row per range of every file under ``path``: what it does to each state of each delimiter."""
    return R.pieces(spark, path, "\n", glob).mapInArrow(partial(_profile, tuple(delimiters), scored), _PROFILE_DDL)


def _merge(rows: list) -> list[tuple[str, float]]:
    """(delimiter, score) of a file from the rows of its ranges, in order."""
    n, total = 0, [0] * len(DELIMITERS)
    low, high, left, inside = None, None, None, False

    def line(counts):
        nonlocal n, low, high
        n += 1
        for k, c in enumerate(counts):
            total[k] += c
        low = list(counts) if low is None else [min(a, b) for a, b in zip(low, counts)]
        high = list(counts) if high is None else [max(a, b) for a, b in zip(high, counts)]

    for r in rows:
        s = r[int(inside)]
        if inside and not s["headed"]:
            left = [a + b for a, b in zip(left, s["open"])]
            continue
        if inside:
            line([a + b for a, b in zip(left, s["head"])])
        if s["n"]:
            n += s["n"]
            total = [a + b for a, b in zip(total, s["total"])]
            low = list(s["low"]) if low is None else [min(a, b) for a, b in zip(low, s["low"])]
            high = list(s["high"]) if high is None else [max(a, b) for a, b in zip(high, s["high"])]
        inside, left = s["ends_inside"], list(s["open"])
    if inside:
        line(left)              # a quote that is never closed takes the rest of the file
    if not n:
        return [(d, 0.0) for d in DELIMITERS]
    fields = [(t + n) / n for t in total]
    return [(d, f * 2 if n > 1 and lo == hi else f) for d, f, lo, hi in zip(DELIMITERS, fields, low, high)]


def _scores(groups: pa.Table) -> pa.Table:
    rows = sorted(groups.to_pylist(), key=lambda r: r["block"])
    found = _merge([r["scores"] for r in rows])
    best = max(range(len(found)), key=lambda k: (found[k][1], -k))
    best = best if found[best][1] > 0 else 0
    return pa.table({"file": pa.array([rows[0]["file"]] * len(found), pa.int64()), "delimiter": [d for d, _ in found],
                     "score": pa.array([s for _, s in found], pa.float64()), "chosen": [k == best for k in range(len(found))]})


def delimiter_scores(profile: DataFrame) -> DataFrame:
    """file, delimiter, score, chosen from the rows of ``range_profile``; a file's few ranges meet in one group."""
    return profile.select("file", "block", "scores").groupBy("file").applyInArrow(
        _scores, "file long, delimiter string, score double, chosen boolean")


def start_states(profile: DataFrame, k: int) -> list[tuple[int, int]]:
    """(file, block) of the ranges that start inside a quoted cell, by the k-th delimiter."""
    rows = profile.select("file", "block", F.col("outside")[k].alias("o"), F.col("inside")[k].alias("i"))
    files = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "o", "i"))).alias("all"))
    # each range's state goes on to the next one
    walked = F.aggregate("all", F.struct(F.lit(False).alias("s"), F.array().cast("array<bigint>").alias("found")),
                         lambda acc, r: F.struct(F.when(acc["s"], r["i"]).otherwise(r["o"]).alias("s"),
                                                 F.when(acc["s"], F.array_append(acc["found"], r["block"]))
                                                 .otherwise(acc["found"]).alias("found")))
    found = files.select("file", F.explode(walked["found"]).alias("block"))
    return [(r.file, r.block) for r in found.collect()]


class _Cutter:
    """Cuts the lines of ranges into records; a range starts inside a quoted cell if ``starts`` has it, and the one
    after it goes on with what it leaves open if ``ends`` has it."""

    def __init__(self, sep: str, header: bool, starts: R.Starts, ends: R.Starts, files: np.ndarray | None):
        self.machine, self.header, self.starts, self.ends, self.files = LineMachine(sep), header, starts, ends, files
        self.key, self.state, self.crossing, self.titled, self.skip = None, False, False, True, False
        self.pending: list[str] = []

    def enter(self, key: tuple[int, int]) -> None:
        self.key, self.pending = key, []
        self.state = self.crossing = self.starts.get(*key) is not None
        self.titled = not (self.header and key[1] == 0)
        self.skip = self.files is not None and not np.isin(key[0], self.files)

    def leave(self) -> Iterator[pa.RecordBatch]:
        """What the range leaves open: the next range goes on with it, or the file ends there."""
        if self.pending and (self.crossing or self.ends.get(*self.key) is not None):
            part = R.MIDDLE if self.crossing else R.TAIL if self.titled else R.TITLE
            yield R.emit(["\n".join(self.pending)], self.key, part)
        elif self.pending and self.titled:
            yield R.emit(["\n".join(self.pending)])

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        at, out, ins = self.machine.answers(lines)
        if not self.state and self.titled and not out.any():        # no line leaves a cell open
            yield R.emit(_ended(lines))
            return
        states = self.machine.before(out, ins, self.state)
        inside = np.repeat(states, np.diff([0, *at.tolist(), len(lines)]))      # after each line
        self.state, found = bool(states[-1]), []
        for text, goes_on in zip(lines.to_pylist(), inside.tolist()):
            if goes_on:
                self.pending.append(text)
                continue
            if self.pending:
                text, self.pending = "\n".join([*self.pending, text]), []
            if self.crossing:
                self.crossing = False
                yield R.emit(_ended(pa.array([text])), self.key, R.HEAD)
            elif self.titled:
                found.append(text)
            else:
                self.titled = bool(text.strip())
        if found:
            yield R.emit(_ended(pa.array(found, pa.string())))


def _records(make: partial, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = make()
    for key, _, lines in R.runs(batches):
        if key != cutter.key:
            if cutter.key is not None:
                yield from cutter.leave()
            cutter.enter(key)
        if not cutter.skip:
            yield from cutter.feed(lines)
    if cutter.key is not None:
        yield from cutter.leave()


def _ended(lines: pa.Array) -> pa.Array:
    """Records without the carriage return of their line end."""
    return pc.replace_substring_regex(lines, "\r$", "") if R.contains(lines, "\r").any() else lines


def records(spark: SparkSession, path, sep: str, header: bool, profile: DataFrame, k: int = 0,
            files: np.ndarray | None = None, glob: str | None = None) -> DataFrame:
    """value: the records of all files under ``path`` (or of those with the given hashes), without the first of each
    file if that is a header. ``k``: the place of ``sep`` among the delimiters of the profile."""
    inside = start_states(profile, k)
    before = []
    if inside:
        blocks: dict[int, list[int]] = {}
        for r in profile.select("file", "block").orderBy("block").collect():
            blocks.setdefault(r.file, []).append(r.block)
        before = [(f, blocks[f][blocks[f].index(b) - 1], True) for f, b in inside]
    cutter = partial(_Cutter, sep, header, R.Starts([(f, b, True) for f, b in inside]), R.Starts(before), files)
    cut = R.pieces(spark, path, "\n", glob).mapInArrow(partial(_records, cutter), R.RECORDS)
    return R.stitched(cut, "\n", bool(inside))
