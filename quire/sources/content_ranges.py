"""Format of whole files from byte ranges (T3): what the content rules ask of a text, range by range.

Most rules are about single lines. Those that reach over lines (a marker and text after it, emphasis, code
fences, an element and its end) become small states that ranges hand on to each other, and a text that
begins like JSON without quoted members is checked by reducing its brackets: what a range cannot match
by itself stays and meets the next range's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import ranges as R

# Line forms of the nine Markdown rules. Four are a marker and text after it, on the line or later.
MARKERS = ("#{1,6}", r"\*", r"\d+\.", ">")
LINK, TABLE_ROW = r"\[.+\]\(.+\)", r"^\|.+\|$"
# The start of an XML text, and an end tag.
XML_START, XML_DECLARATION, END_TAG = r"<[a-zA-Z_][\w\-.:]*(?:[\s>]|$)", r"(?i)<\?xml\s+version", r"</[a-zA-Z_][\w\-.:]*>"
# Delimiters of the CSV rule.
DELIMITERS = (",", ";", "\t", "|")

_EDGE = re.compile(r"^[\s\ufeff]+|[\s\ufeff]+$")
_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?'
                    r"|true|false|null|[\[\]{},]|[ \t\r\n]+")
_RULES = ((re.compile(r"\{\}|\[[vw]?\]"), "v"), (re.compile("[vw](?:,[vw])+"), "w"))


def _tokens(line: str) -> str | None:
    """A line of JSON as one letter a token, v for any scalar; None if something else is in it."""
    out, at = [], 0
    while at < len(line):
        m = _TOKEN.match(line, at)
        if m is None:
            return None
        c, at = line[at], m.end()
        if c in "[]{},":
            out.append(c)
        elif c not in " \t\r\n":
            out.append("v")
    return "".join(out)


def _reduced(tokens: str) -> str:
    """Arrays whose end is here become v, lists of values w; a whole JSON text becomes v."""
    size = -1
    while size != len(tokens):
        size = len(tokens)
        for rule, to in _RULES:
            tokens = rule.sub(to, tokens)
    return tokens


_ROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("lines", pa.list_(pa.string())), ("quote", pa.bool_()),
                  ("parts", pa.bool_()), ("json", pa.string()), ("gt", pa.bool_()), ("ends", pa.bool_()),
                  ("ends_after", pa.bool_()), ("hits", pa.list_(pa.bool_())), ("pending", pa.list_(pa.bool_())),
                  ("text", pa.bool_()), ("stars", pa.list_(pa.int64())), ("opens", pa.bool_()), ("closes", pa.bool_())])
_ROW_DDL = ("file long, block long, lines array<string>, quote boolean, parts boolean, json string, gt boolean, ends boolean, "
            "ends_after boolean, hits array<boolean>, pending array<boolean>, text boolean, stars array<bigint>, "
            "opens boolean, closes boolean")
# places in ``hits``: the four markers, then these
STRONG, EMPHASIS, LINKED, TABLE, FENCE = 4, 5, 6, 7, 8


class _Content:
    """The rules' state over the lines of one range."""

    def __init__(self, file: int, block: int, size: int):
        self.key, self.lines, self.quote, self.parts, self.json = (file, block), [], False, False, ""
        self.gt = self.ends = self.ends_after = self.text = self.opens = self.closes = False
        self.hits, self.pending = [False] * 9, [False] * 4
        self.stars: list[int] = []              # lengths of the first and the last run of asterisks, and how many

    def feed(self, lines: pa.Array) -> None:
        if R.contains(lines, "\r").any():
            lines = pc.replace_substring_regex(lines, "\r$", "")
        solid = ~R.matches(lines, r"^[\s\x0b\p{Z}\x{FEFF}]*$")
        where = np.flatnonzero(solid)
        for i in where[:2 - len(self.lines)].tolist() if len(self.lines) < 2 else ():
            self.lines.append(lines[i].as_py())
        self.quote = self.quote or bool(R.contains(lines, '"').any())
        self.parts = self.parts or bool(R.contains(lines, ":").any() or R.contains(lines, ",").any())
        self._brackets(lines)
        self._tags(lines)
        self._markers(lines, where)
        for k, rule in ((LINKED, LINK), (TABLE, TABLE_ROW)):
            self.hits[k] = self.hits[k] or bool(R.matches(lines, rule).any())
        self._fences(lines)
        self._asterisks(lines)
        self.text = self.text or bool(len(where))

    def _brackets(self, lines: pa.Array) -> None:
        if self.json is None or self.quote and self.parts:      # the quoted rule decides
            self.json = None
            return
        for line in lines.to_pylist():
            tokens = _tokens(line.lstrip("\ufeff") if not self.json else line)
            if tokens is None:
                self.json = None
                return
            self.json = _reduced(self.json + tokens) if tokens else self.json

    def _tags(self, lines: pa.Array) -> None:
        ends = R.matches(lines, END_TAG)
        if ends.any():
            self.ends = True
            if not self.ends_after:
                gts = np.flatnonzero(R.contains(lines, ">"))
                first = 0 if self.gt else int(gts[0])
                self.ends_after = bool(ends[first + (not self.gt):].any()) or not self.gt and bool(
                    re.search(END_TAG, lines[first].as_py().split(">", 1)[1]))
        self.gt = self.gt or bool(R.contains(lines, ">").any())

    def _markers(self, lines: pa.Array, solid: np.ndarray) -> None:
        for k, mark in enumerate(MARKERS):
            if self.hits[k]:
                continue
            if R.matches(lines, rf"^{mark}\s+[^\r\n]").any() or self.pending[k] and len(solid):
                self.hits[k] = True
                continue
            alone = np.flatnonzero(R.matches(lines, rf"^{mark}\s*$"))
            if len(alone):
                self.hits[k] = bool(len(solid) and solid[-1] > alone[0])
                self.pending[k] = True

    def _fences(self, lines: pa.Array) -> None:
        if self.hits[FENCE]:
            return
        opens, closes = R.matches(lines, "^```"), R.matches(lines, "```$")
        one = R.matches(lines, "^```.*```$").any()
        first, last = (np.flatnonzero(x) for x in (opens, closes))
        self.hits[FENCE] = bool(one or len(last) and (self.opens or len(first) and first[0] < last[-1]))
        self.closes = self.closes or bool(len(last))
        self.opens = self.opens or bool(len(first))

    def _asterisks(self, lines: pa.Array) -> None:
        if self.hits[STRONG]:
            return
        at = np.flatnonzero(R.contains(lines, "*"))
        for line in lines.take(pa.array(at)).to_pylist() if len(at) else ():
            for m in re.finditer(r"\*+", line):
                n = len(m.group())
                if not self.stars:
                    self.stars = [n, n, 1]
                    continue
                self.hits[EMPHASIS] = True
                self.hits[STRONG] = self.hits[STRONG] or min(self.stars[1], n) >= 2
                self.stars[1:] = [n, self.stars[2] + 1]

    def row(self) -> dict:
        return {"file": self.key[0], "block": self.key[1], "lines": self.lines, "quote": self.quote, "parts": self.parts,
                "json": self.json, "gt": self.gt, "ends": self.ends, "ends_after": self.ends_after, "hits": self.hits,
                "pending": self.pending, "text": self.text, "stars": self.stars, "opens": self.opens, "closes": self.closes}


def _format(rows: list[dict]) -> str | None:
    """The format of a file from the rows of its ranges, in order."""
    lines = [x for r in rows for x in r["lines"]][:2]
    if not lines:
        return None
    lines[0] = _EDGE.sub("", lines[0]) if len(lines) == 1 else _EDGE.sub("", lines[0] + "x")[:-1]
    head = "\n".join(lines)
    if head[0] in "{[":
        left = "" if all(r["json"] is not None for r in rows) else None
        for r in rows if left is not None else ():
            left = _reduced(left + r["json"])
        if left == "v" or any(r["quote"] for r in rows) and any(r["parts"] for r in rows):
            return "json"
    if head[0] == "<":
        seen = ended = False
        for r in rows:
            ended = ended or (r["ends"] if seen else r["ends_after"])
            seen = seen or r["gt"]
        if re.match(XML_DECLARATION, head) or ended and re.match(XML_START, head):
            return "xml"
    hits = [any(r["hits"][k] for r in rows) for k in range(9)]
    pending, opens, star = [False] * 4, False, None
    for r in rows:
        hits[:4] = [h or p and r["text"] for h, p in zip(hits, pending)]
        pending = [p or q for p, q in zip(pending, r["pending"])]
        hits[FENCE] = hits[FENCE] or opens and r["closes"]
        opens = opens or r["opens"]
        if r["stars"]:
            if star is not None:
                hits[EMPHASIS] = True
                hits[STRONG] = hits[STRONG] or min(star, r["stars"][0]) >= 2
            star = r["stars"][1]
    if sum(hits) >= 2:
        return "md"
    if len(lines) == 2 and any(a > 1 and a == b for a, b in ([x.count(d) + 1 for x in lines] for d in DELIMITERS)):
        return "csv"
    return None


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return R.by_range(batches, _Content, _ROW)


def _merge(ranges: pa.Table) -> pa.Table:
    rows = sorted(ranges.to_pylist(), key=lambda r: r["block"])
    return pa.table({"file": pa.array([rows[0]["file"]], pa.int64()), "format": pa.array([_format(rows)], pa.string())})


def file_formats(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """file (hash of its path), format (null: none fits) of every file under ``path``, by all of its content; large
    files have many tasks, and a file's few ranges meet in one group."""
    return R.pieces(spark, path, "\n", glob).mapInArrow(_profile, _ROW_DDL).groupBy("file").applyInArrow(
        _merge, "file long, format string")
