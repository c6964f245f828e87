"""Elements of JSON arrays from byte ranges.

Files are read in pieces that end at closing braces, so an array on one line is split as well as one on
many. A piece is a step of a machine whose state is whether a string is open and how deep the place is:
from either string state its effect is the state after it and a difference of depth, and these compose over
pieces and ranges. Elements of the array, or the objects of a file without one, are the records.
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

_PROFILE = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("array", pa.bool_()), ("bytes", pa.int64()),
                      ("size", pa.int64()), ("outside", pa.bool_()), ("outside_depth", pa.int64()), ("inside", pa.bool_()),
                      ("inside_depth", pa.int64())])
_PROFILE_DDL = ("file long, block long, array boolean, bytes long, size long, outside boolean, outside_depth long, "
                "inside boolean, inside_depth long")
_STRUCTURE = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_SPACE = " \t\r\n"


def _outside(pieces: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(is the number of quotes odd, text outside strings if the piece starts outside / inside one)."""
    plain = pc.replace_substring_regex(pieces, r"(?s)\\.", "") if R.contains(pieces, "\\").any() else pieces
    odd = (R.count(plain, '"') & 1).astype(bool)
    strings = '"[^"]*(?:"|$)'
    return (odd, pc.replace_substring_regex(plain, strings, ""),
            pc.replace_substring_regex(pc.replace_substring_regex(plain, '^[^"]*(?:"|$)', "", max_replacements=1), strings, ""))


def _depth(text: pa.Array) -> np.ndarray:
    return R.count(text, "{") + R.count(text, "[") - R.count(text, "]")


class _Profile:
    def __init__(self, file: int, block: int, size: int):
        self.file, self.block, self.size, self.bytes = file, block, size, 0
        self.array = None
        self.state, self.depth = [False, True], [0, 0]

    def feed(self, pieces: pa.Array) -> None:
        self.bytes += int(pc.sum(pc.binary_length(pieces)).as_py()) + len(pieces)
        if self.array is None and self.block == 0:
            first = next((t for p in pieces.to_pylist() if (t := p.lstrip("\ufeff" + _SPACE))), None)
            self.array = first.startswith("[") if first else None
        odd, outside, inside = _outside(pieces)
        flips = np.concatenate(([0], np.cumsum(odd)))
        deep = _depth(outside), _depth(inside)
        for s in (0, 1):
            string = ((flips + self.state[s]) & 1).astype(bool)       # before each piece, and after the last
            change = np.where(string[:-1], deep[1], deep[0])
            # the brace that ends a piece closes something unless a string is open there
            self.depth[s] += int(change.sum()) - int((~string[1:]).sum())
            self.state[s] = bool(string[-1])

    def row(self) -> dict:
        return {"file": self.file, "block": self.block, "array": self.array, "bytes": self.bytes, "size": self.size,
                "outside": self.state[0], "outside_depth": self.depth[0], "inside": self.state[1],
                "inside_depth": self.depth[1]}


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return R.by_range(batches, _Profile, _PROFILE)


def range_profile(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """One row per range of every file under ``path``: what it does to each state."""
    return R.pieces(spark, path, "}", glob).mapInArrow(_profile, _PROFILE_DDL)


def _states(profile: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """((file, block, string open, depth, array) of the ranges that do not start their file, (file, block, True) of the
    last ranges of files that break off)."""
    files: dict[int, list] = {}
    many = profile.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
                                       F.max("size").alias("size"), F.max("outside_depth").alias("depth"))
    # where no brace ends a file, its pieces seem one byte longer; all is well if that brace would be one too many
    broken = "bytes - size in (1, -2)"
    wanted = many.where(f"n > 1 or {broken} and depth <> -1").select("file", F.expr(broken).alias("broken"))
    for r in profile.join(wanted, "file").orderBy("block").collect():
        files.setdefault(r.file, []).append(r)
    starts, ends = [], []
    for file, rows in files.items():
        string, depth = False, 0
        for k, r in enumerate(rows):
            if k:
                starts.append((file, r.block, string, depth, rows[0].array is True))
            string, depth = ((r.inside, depth + r.inside_depth) if string else (r.outside, depth + r.outside_depth))
        if rows[0].broken and (string or depth != -1):
            ends.append((file, rows[-1].block, True))
    return starts, ends


class _Cutter:
    """Cuts the pieces of ranges into elements."""

    def __init__(self, starts: R.Starts, ends: R.Starts):
        self.starts, self.ends, self.key = starts, ends, None

    def enter(self, key: tuple[int, int]) -> None:
        self.key = key
        known = self.starts.get(*key)
        self.string, self.depth, array = known if known else (False, 0, None)
        self.base = None if array is None else int(array)
        self.crossing = self.string or self.base is not None and self.depth > self.base
        self.open: list[str] = []           # text of the element that is being read
        self.found: list[str] = []
        self.held: str | None = None        # a piece whose closing brace may not be there

    def _take(self, text: str) -> None:
        """Go on through ``text`` character by character, as far as structure is concerned."""
        at = since = 0
        if self.string:
            m = _REST_OF_STRING.match(text)
            self.string, at = not m.group(1), m.end()
        while at < len(text):
            m = _STRUCTURE.search(text, at)
            if m is None:
                break
            c, at = m.group()[0], m.end()
            if c == '"':
                self.string = not m.group(1)
                continue
            if self.base is None:           # the first structure of the file says what the records are
                self.base = int(c == "[")
                if c == "[":
                    self.depth, since = 1, at
                    continue
            if c in "[{":
                self.depth += 1
            elif c in "]}":
                self.depth -= 1
                if self.depth < self.base:
                    self._finish(text[since:m.start()])
                    since, self.depth = at, max(self.depth, 0)
                elif self.depth == self.base == 0:
                    self._finish(text[since:at])
                    since = at
            elif self.depth == self.base:
                self._finish(text[since:m.start()])
                since = at
        self.open.append(text[since:])

    def _finish(self, text: str) -> None:
        value = "".join([*self.open, text])
        self.open = []
        if self.crossing:                   # the range before has the first part
            self.crossing = False
            self.batches.append(R.emit([value], self.key, R.HEAD))
        elif value.strip("\ufeff" + _SPACE):
            self.found.append(value)

    def feed(self, pieces: pa.Array) -> Iterator[pa.RecordBatch]:
        self.batches: list[pa.RecordBatch] = []
        if self.held is not None:
            self._take(self.held + "}")
            self.held = None
        last, pieces = pieces[len(pieces) - 1].as_py(), pieces.slice(0, len(pieces) - 1)
        flat = _flat(pieces) if len(pieces) else np.empty(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], flat.astype(np.int8), [0]))))
        at = 0
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            for text in pieces.slice(at, a - at).to_pylist():
                self._take(text + "}")
            at = a
            # a run of objects without arrays in them, between elements: no structure to follow
            while at < b and not self._between():
                self._take(pieces[at].as_py() + "}")
                at += 1
            if at < b:
                self._finish("")
                run = pc.replace_substring_regex(pieces.slice(at, b - at), r"^[ \t\r\n]*,?", "")
                self._flush()
                self.batches.append(R.emit(pc.binary_join_element_wise(run, pa.scalar("}", run.type), "")))
                at = b
        for text in pieces.slice(at).to_pylist():
            self._take(text + "}")
        self.held = last
        self._flush()
        yield from self.batches

    def _between(self) -> bool:
        """At the end of an element of an array, all of its text read."""
        return self.base == 1 and self.depth == 1 and not self.string and not self.crossing

    def _flush(self) -> None:
        if self.found:
            self.batches.append(R.emit(self.found))
            self.found = []

    def leave(self, follows: bool) -> Iterator[pa.RecordBatch]:
        self.batches = []
        if self.held is not None:
            self._take(self.held)
            if follows or self.ends.get(*self.key) is None and (self.depth > 0 or self.string):
                self._take("}")
        rest = "".join(self.open)
        if rest.strip("\ufeff" + _SPACE) or self.crossing:
            if self.crossing:
                self.batches.append(R.emit([rest], self.key, R.MIDDLE))
            elif follows:
                self.batches.append(R.emit([rest], self.key, R.TAIL))
            else:
                self.found.append(rest)
        self._flush()
        yield from self.batches


def _flat(pieces: pa.Array) -> np.ndarray:
    """Pieces that are an object after a comma, with neither arrays nor objects in it, if read from between elements."""
    odd, outside, _ = _outside(pieces)
    return ~odd & R.matches(outside, r"^[ \t\r\n]*,[ \t\r\n]*\{[^{\[\]]*$")


def _records(make: partial, following: R.Starts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = make()
    for key, _, pieces in R.runs(batches):
        if key != cutter.key:
            if cutter.key is not None:
                yield from cutter.leave(following.get(*cutter.key) is not None)
            cutter.enter(key)
        yield from cutter.feed(pieces)
    if cutter.key is not None:
        yield from cutter.leave(following.get(*cutter.key) is not None)


def elements(spark: SparkSession, path, profile: DataFrame, glob: str | None = None) -> DataFrame:
    """value: the text of every element of the arrays under ``path``, or of every value of files that hold none."""
    starts, ends = _states(profile)
    by_file: dict[int, list[tuple]] = {}
    for s in starts:
        by_file.setdefault(s[0], [(s[0], 0)]).append(s)
    following = R.Starts([(f, a[1], True) for f, rows in by_file.items() for a, _ in zip(rows, rows[1:])])
    cut = R.pieces(spark, path, "}", glob).mapInArrow(
        partial(_records, partial(_Cutter, R.Starts(starts), R.Starts(ends)), following), R.RECORDS)
    return R.stitched(cut, "", bool(starts))
