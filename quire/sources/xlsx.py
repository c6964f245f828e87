"""XLSX workbooks (S11, S12, K8) through Spark's own readers and writers.

Reading: Spark's ``binaryFile`` source hands workbooks to tasks, which run through each sheet once, by
parser events, and give its cells with their kinds (text, whole number, number, truth value, instant) to a
scratch table. Columns are typed from that table over all workbooks, and the typed rows are a projection
of it. Instants are told by the number format of a cell's style.

Writing: a task streams its rows into a zip member as they come. The bytes of the workbook leave the task
cut at line feeds, as rows of text: Spark's text sink puts the line feeds back, so its commit protocol and its
file systems serve here too; the last one is the comment that the zip format allows at its end. Folders
are written aside and then swapped in.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import partial
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jscompat import js_string
from ..session import ship_package, written
from .files import keep_only, rename_parts, swap_in

# Names of the format's parts, and its limits.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
MAX_ROWS = 1_048_576
MAX_COLUMNS = 16_384
# Numbers of the built-in number formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DAY_MICROS = 86_400_000_000
EPOCH_DAY, EPOCH_1904 = 25_569, 1_462     # 1970-01-01 as a day number, and how far the 1904 numbers are behind
LAST_DAY = 2_958_466                        # the day after 9999-12-31

TEXT, LONG, DOUBLE, BOOLEAN, INSTANT = 0, 1, 2, 3, 4
INVENTORY_SCHEMA = "path string, sheet_name string, sheet_index int, row_count long, column_count long"
_CELLS_DDL = "layout long, titles string, cells array<struct<kind:tinyint,value:string>>"
_CELL = pa.struct([("kind", pa.int8()), ("value", pa.string())])
_CELLS = pa.schema([("layout", pa.int64()), ("titles", pa.string()), ("cells", pa.list_(_CELL))])


# ---------------------------------------------------------------------------------------
# Cell references
# ---------------------------------------------------------------------------------------

def column_number(letters: str) -> int:
    """'A' -> 1, 'AB' -> 28; lower-case letters are accepted and numbered the same."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + (ord(ch) - ord("A") + 1)
    return n


def column_letters(n: int) -> str:
    s = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        s = chr(ord("A") + r) + s
    return s


def parse_range(rng: str) -> tuple[int, int, int, int]:
    """'A1:C10' -> (start_row, end_row, start_col, end_col)."""
    m = re.match(r"^([A-Za-z]+)(\d+):([A-Za-z]+)(\d+)$", rng.strip())
    if not m:
        raise ValueError(f"Invalid range format: {rng}. Expected format like 'A1:C10'")
    return int(m.group(2)), int(m.group(4)), column_number(m.group(1)), column_number(m.group(3))


_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_UNWRITABLE = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def unescape(text: str) -> str:
    """Characters that XML cannot hold stand as ``_x001F_`` in a workbook."""
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def cell_text(text: str) -> str:
    return escape(_UNWRITABLE.sub(lambda m: f"_x{ord(m.group()):04X}_", text))


# ---------------------------------------------------------------------------------------
# Reading, in tasks
# ---------------------------------------------------------------------------------------

class Workbook:
    """Parts of a workbook that all its sheets share."""

    def __init__(self, data: bytes):
        self.zf = zipfile.ZipFile(io.BytesIO(data))
        root = ET.fromstring(self.zf.read("xl/workbook.xml"))
        rels = ET.fromstring(self.zf.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target", "").lstrip("/") for r in rels.iter(f"{{{PACKAGE}}}Relationship")}
        places = [(s.get("name"), target.get(s.get(f"{{{RELATIONS}}}id"), "")) for s in root.iter(f"{{{MAIN}}}sheet")]
        self.sheets = [(n, t if t.startswith("xl/") else "xl/" + t) for n, t in places]
        about = root.find(f"{{{MAIN}}}workbookPr")
        self.late = about is not None and about.get("date1904") in ("1", "true")

    def _part(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zf.read(name)) if name in self.zf.namelist() else None

    def strings(self) -> list[str]:
        """Shared texts; of rich text the runs are joined, and readings above the characters left out."""
        root = self._part("xl/sharedStrings.xml")
        if root is None:
            return []
        return [unescape("".join(t.text or "" for t in (*si.findall(f"{{{MAIN}}}t"), *si.findall(f"{{{MAIN}}}r/{{{MAIN}}}t"))))
                for si in root.iter(f"{{{MAIN}}}si")]

    def date_styles(self) -> set[str]:
        """Numbers of the cell styles whose number format shows a date or a time."""
        root = self._part("xl/styles.xml")
        if root is None:
            return set()
        dated = set(DATE_FORMATS)
        for f in root.iter(f"{{{MAIN}}}numFmt"):
            code = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", f.get("formatCode", ""))
            if re.search("[ymdhs]", code, re.I) and "general" not in code.lower():
                dated.add(int(f.get("numFmtId")))
        xfs = root.find(f"{{{MAIN}}}cellXfs")
        return {str(i) for i, xf in enumerate(xfs if xfs is not None else ()) if int(xf.get("numFmtId", 0)) in dated}

    def pick(self, sheet_name: str | None, sheet_index: int | None) -> list[str]:
        """The member of a sheet, and those that go on with it (see the writer)."""
        if sheet_name:
            found = [s for s in self.sheets if s[0] == sheet_name]
            if not found:
                raise ValueError(f"Sheet '{sheet_name}' not found. Available sheets: {', '.join(n for n, _ in self.sheets)}")
        elif sheet_index is not None:
            if not 0 <= sheet_index < len(self.sheets):
                raise ValueError(f"Sheet at index {sheet_index} not found. Total sheets: {len(self.sheets)}")
            found = [self.sheets[sheet_index]]
        elif not self.sheets:
            raise ValueError("No worksheets found in Excel file")
        else:
            found = self.sheets[:1]
        further = re.compile(re.escape(found[0][0]) + r"~\d+")
        return [found[0][1], *[m for n, m in self.sheets if further.fullmatch(n)]]


class _Sheet:
    """Parser events of one sheet as rows (number, {column: (kind, value)}); cells without a value are None."""

    def __init__(self, book: Workbook, strings: list[str], dated: set[str]):
        self.strings, self.dated = strings, dated
        self.shift = EPOCH_DAY - (EPOCH_1904 if book.late else 0)
        self.done: list[tuple[int, dict]] = []
        self.row, self.column, self.cells, self.kind, self.style = 0, 0, {}, None, None
        self.text: list[str] | None = None
        self.said: str | None = None
        self.hidden = 0
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.parser.CharacterDataHandler = self._chars

    def _start(self, name: str, a: dict) -> None:
        name = name.rpartition(" ")[2]
        if name == "c":
            ref = a.get("r")
            self.column = column_number(ref.rstrip("0123456789")) if ref else self.column + 1
            self.kind, self.style, self.said = a.get("t"), a.get("s"), None
        elif name in ("v", "t") and not self.hidden:
            self.text = []
        elif name == "row":
            self.row = int(a["r"]) if "r" in a else self.row + 1
            self.cells, self.column = {}, 0
        elif name == "rPh":
            self.hidden += 1

    def _chars(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def _end(self, name: str) -> None:
        name = name.rpartition(" ")[2]
        if name in ("v", "t") and self.text is not None:
            self.said, self.text = (self.said or "") + "".join(self.text), None
        elif name == "c":
            self.cells[self.column] = self._value()
        elif name == "row":
            self.done.append((self.row, self.cells))
        elif name == "rPh":
            self.hidden -= 1

    def _value(self) -> tuple[int, str] | None:
        said, kind = self.said, self.kind
        if said is None:
            return None
        if kind == "s":
            said = self.strings[int(said)]
        elif kind in ("str", "inlineStr"):
            said = unescape(said)
        elif kind == "b":
            return BOOLEAN, said
        elif kind == "d":
            micros = np.datetime64(said.rstrip("Z"), "us").astype(int)
            return INSTANT, str(int(micros))
        elif kind != "e":
            if self.style in self.dated:
                return INSTANT, str(round((Decimal(said) - self.shift) * DAY_MICROS))
            whole = said.removeprefix("-").isdigit() and -1 << 63 <= int(said) < 1 << 63
            return (LONG if whole else DOUBLE), said
        return (TEXT, said) if said else None

    def rows(self, member) -> Iterator[tuple[int, dict]]:
        while block := member.read(1 << 16):
            self.parser.Parse(block)
            yield from self.done
            self.done = []
        self.parser.Parse(b"", True)
        yield from self.done


def _titles(cells: dict, first: int) -> list[str] | None:
    """Names by column of a first row that holds any text that is not blank; blank cells have none."""
    texts = {c: v[1].strip() for c, v in cells.items() if v is not None and v[0] == TEXT}
    if not any(texts.values()):
        return None
    return [texts.get(c, "") for c in range(first, max(cells) + 1)]


def _cell_rows(sheet_name, sheet_index, rng, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a sheet of every workbook, from its first column; ``layout`` numbers the titles, which stand in the
    first row of each sheet (that row has no cells)."""
    r0, r1, c0, c1 = parse_range(rng) if rng else (1, None, 1, None)
    for data in (b.column(0)[i].as_py() for b in batches for i in range(b.num_rows)):
        book = Workbook(data)
        strings, dated = book.strings(), book.date_styles()
        for place, member in enumerate(book.pick(sheet_name, sheet_index)):
            titles, layout, rows, size = None, None, [], 0
            with book.zf.open(member) as stream:
                for n, cells in _Sheet(book, strings, dated).rows(stream):
                    if n < r0 or r1 is not None and n > r1:
                        continue
                    if c0 > 1 or c1 is not None:
                        cells = {c: v for c, v in cells.items() if c >= c0 and (c1 is None or c <= c1)}
                    if layout is None:
                        titles = _titles(cells, c0) if n == r0 else None
                        said = json.dumps([c0, (c1 or 0) - c0 + 1 if c1 else 0, titles])
                        layout = int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, said).bytes[:8], "little", signed=True)
                        yield pa.RecordBatch.from_pylist([{"layout": layout, "titles": said, "cells": None}], _CELLS)
                        if titles is not None:
                            continue
                    # a row is as wide as its last cell, valued or not; rows without a value are left out
                    if any(v is not None for v in cells.values()):
                        rows.append([_pair(cells.get(c)) for c in range(c0, max(cells) + 1)])
                        size += len(rows[-1])
                        if size > 50_000:
                            yield _packed(layout, rows)
                            rows, size = [], 0
            if rows:
                yield _packed(layout, rows)


def _pair(v):
    return None if v is None else {"kind": v[0], "value": v[1]}


def _packed(layout: int, rows: list) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([layout] * n, pa.int64()), pa.nulls(n, pa.string()),
                                       pa.array(rows, pa.list_(_CELL))], schema=_CELLS)


def _workbooks(spark: SparkSession, path) -> DataFrame:
    ship_package(spark)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .where(r"lower(path) rlike '[.]xlsx?$' and not path rlike '/[~._][^/]*$'"))


# ---------------------------------------------------------------------------------------
# Reading, typed
# ---------------------------------------------------------------------------------------

def _kind_type(kinds: int) -> T.DataType:
    """The type of a column from its cells' kinds, a bit each; several kinds make text, but numbers stay numbers."""
    if kinds == 1 << BOOLEAN:
        return T.BooleanType()
    if kinds == 1 << INSTANT:
        return T.TimestampType()
    if kinds == 1 << LONG:
        return T.LongType()
    return T.DoubleType() if kinds and not kinds & ~(1 << LONG | 1 << DOUBLE) else T.StringType()


def _as(cell: Column, dt: T.DataType) -> Column:
    """A cell as a value of a type, null where it is of another kind."""
    kind, value = cell["kind"], cell["value"]
    number = kind.isin(LONG, DOUBLE)
    instant = F.when(kind == INSTANT, F.timestamp_micros(value.try_cast("long")))
    if isinstance(dt, T.StringType):
        return (F.when(kind == TEXT, value).when(kind == LONG, value).when(kind == BOOLEAN, (value == "1").cast("string"))
                .when(kind == DOUBLE, js_string(value.try_cast("double"), T.DoubleType()))
                .otherwise(js_string(instant, T.TimestampType())))
    if isinstance(dt, T.BooleanType):
        return F.when(kind == BOOLEAN, value == "1")
    if isinstance(dt, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return instant.try_cast(dt)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(kind == LONG, value.try_cast(dt)).when(number, value.try_cast("double").try_cast(dt))
    if isinstance(dt, T.NumericType):
        return F.when(number, value.try_cast(dt))
    return F.when(kind == TEXT, value).try_cast(dt)


def _names(said: str, width: int) -> list[str]:
    """Column names of a layout: titles, and ``Column<n>`` where there is none."""
    first, asked, titles = json.loads(said)
    titles = titles or []
    return [(titles[i] if i < len(titles) else "") or f"Column{first + i}" for i in range(max(width, asked, len(titles)))]


def read_xlsx(spark: SparkSession, path: str, sheet_name: str | None = None, sheet_index: int | None = None,
              range_: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of one sheet of every workbook under ``path``; each workbook is parsed once, by one task.

    The first row (of the range) is titles if it holds any text that is not blank. Columns are typed over every row of
    every workbook and put together by title, in the order of their smallest place; of titles that repeat in a sheet
    the last counts. Rows without a value are left out. Cells with a date format are instants (UTC).
    """
    if range_:
        parse_range(range_)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    cells = written(_workbooks(spark, path).select("content").mapInArrow(
        partial(_cell_rows, sheet_name, sheet_index, range_), _CELLS_DDL), "xlsx-cells")
    layouts = [(r.layout, r.titles) for r in cells.where("titles is not null").select("layout", "titles").distinct().collect()]
    # a row a column and layout: which kinds of cells it has, and how wide the sheets are
    found: dict[int, dict[int, int]] = {}
    for r in cells.where("cells is not null").select("layout", F.posexplode("cells").alias("pos", "cell")).groupBy(
            "layout", "pos").agg(F.bit_or(F.when(F.col("cell").isNotNull(), F.expr("1 << cell.kind")).otherwise(0)
                                          ).alias("kinds")).collect():
        found.setdefault(r.layout, {})[r.pos] = r.kinds
    places: dict[str, int] = {}
    kinds: dict[str, int] = {}
    named = {}
    for layout, said in layouts:
        mine = found.get(layout, {})
        names = _names(said, max(mine, default=-1) + 1)
        named[layout] = {n: i for i, n in enumerate(names)}
        for n, i in named[layout].items():
            places[n] = min(places.get(n, i), i)
            kinds[n] = kinds.get(n, 0) | mine.get(i, 0)
    if schema is None:
        if not places and not _workbooks(spark, path).select("path").limit(1).count():
            raise ValueError(f"No workbooks under {path}")
        schema = T.StructType([T.StructField(n, _kind_type(kinds[n])) for n in sorted(places, key=lambda n: (places[n], n))])
    out = None
    for layout, at in named.items():
        rows = cells.where((F.col("layout") == layout) & F.col("cells").isNotNull())
        some = rows.select(*[(_as(F.get("cells", F.lit(at[f.name])), f.dataType) if f.name in at else F.lit(None).cast(f.dataType)
                              ).alias(f.name) for f in schema.fields])
        out = some if out is None else out.union(some)
    return out if out is not None else spark.createDataFrame([], schema)


def _inventory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            book, rows = Workbook(b.column(1)[i].as_py()), []
            for k, (name, member) in enumerate(book.sheets):
                last = width = 0
                with book.zf.open(member) as stream:
                    for n, cells in _Sheet(book, _Any(), set()).rows(stream):
                        last, width = max(last, n), max(width, max(cells, default=0))
                rows.append((b.column(0)[i].as_py(), name, k, last, width))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["path", "sheet_name", "sheet_index", "row_count", "column_count"])


class _Any:
    """Stands for the shared texts where only places of cells are wanted."""

    def __getitem__(self, i: int) -> str:
        return "x"


def sheet_inventory_df(spark: SparkSession, path: str) -> DataFrame:
    """Name, index, last row and last column of every sheet of every workbook; the cells decide, since the
    extent that a sheet declares is often out of date."""
    return _workbooks(spark, path).select("path", "content").mapInArrow(_inventory, INVENTORY_SCHEMA)


# ---------------------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------------------

# The parts of a workbook beside its sheets; styles 1 to 3 are header, date, and date with time.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_STYLES = (f'{_HEAD}<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" '
           'formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss.000"/></numFmts><fonts count="2"><font/><font><b/></font></fonts>'
           '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
           '<fill><patternFill patternType="solid"><fgColor rgb="FFE0E0E0"/></patternFill></fill></fills>'
           '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/>'
           '<xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf numFmtId="14" applyNumberFormat="1"/>'
           '<xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
_ROOT_RELS = (f'{_HEAD}<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" '
              'Target="xl/workbook.xml"/></Relationships>')
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


class _Lines:
    """A write-only stream whose bytes are taken away again, cut at line feeds."""

    def __init__(self):
        self.parts: list[bytes] = []

    def write(self, data) -> int:
        self.parts.append(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass

    def take(self) -> list[bytes]:
        whole = b"".join(self.parts)
        *lines, rest = whole.split(b"\n")
        self.parts = [rest]
        return lines


class _Writer:
    """One workbook, written from front to back. A sheet that is full goes on in another, ``<name>~2``, and so on."""

    def __init__(self, names: Sequence[str], sheet_name: str, limit: int = MAX_ROWS):
        self.names, self.sheet_name, self.limit = names, sheet_name, limit
        self.letters = [column_letters(i) for i in range(1, len(names) + 1)]
        self.sink = _Lines()
        self.zf = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_DEFLATED)
        self.sheets, self.member = 0, None

    def _open(self) -> None:
        self.sheets += 1
        self.member, self.row = self.zf.open(f"xl/worksheets/sheet{self.sheets}.xml", "w", force_zip64=True), 1
        widths = "".join(f'<col min="{i}" max="{i}" width="{min(50, max(10, len(n) + 2))}" customWidth="1"/>'
                         for i, n in enumerate(self.names, 1))
        titles = "".join(f'<c r="{c}1" t="inlineStr" s="1"><is><t xml:space="preserve">{cell_text(n)}</t></is></c>'
                         for c, n in zip(self.letters, self.names))
        self._write(f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" '
                    'topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
                    f'{f"<cols>{widths}</cols>" if widths else ""}<sheetData><row r="1">{titles}</row>')

    def _write(self, text: str) -> None:
        self.member.write(text.encode())

    def _shut(self) -> None:
        last = f"{self.letters[-1]}{self.row}" if self.letters else "A1"
        self._write(f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>')
        self.member.close()
        self.member = None

    def add(self, columns: Sequence[Sequence]) -> None:
        """Rows, as columns of (attributes and body of a cell) or None."""
        out = []
        for cells in zip(*columns):
            if self.member is None or self.row == self.limit:
                if self.member is not None:
                    self._write("".join(out))
                    self._shut()
                    out = []
                self._open()
            self.row += 1
            out.append(f'<row r="{self.row}">' + "".join(
                [f'<c r="{c}{self.row}"{v}</c>' for c, v in zip(self.letters, cells) if v is not None]) + "</row>")
        if out:
            self._write("".join(out))

    def close(self) -> None:
        if self.member is None:
            self._open()
        self._shut()
        places = range(1, self.sheets + 1)
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in places)
        name = [self.sheet_name if i == 1 else f"{self.sheet_name}~{i}" for i in places]
        attribute = {'"': "&quot;"}
        parts = {
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{overrides}</Types>',
            "_rels/.rels": _ROOT_RELS,
            "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(
                f'<sheet name="{escape(n, attribute)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(places, name))
            + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{PACKAGE}">' + "".join(
                f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in places)
            + f'<Relationship Id="rId0" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": _STYLES,
        }
        for part, text in parts.items():
            self.zf.writestr(part, text)
        self.zf.comment = b"\n"         # the text sink ends the last line with it
        self.zf.close()


def _days(micros: int) -> str | None:
    """An instant as the day number of a cell, with digits enough for each microsecond; what comes before 1900 or after
    9999 has none."""
    day, rest = divmod(micros, DAY_MICROS)
    day += EPOCH_DAY
    return f"{day}.{(rest * 10 ** 13 // DAY_MICROS + 5) // 10:012d}" if 1 <= day < LAST_DAY else None


def _cells(column: pa.Array) -> list[str | None]:
    """Cells of a column: what stands between a cell's place and its end."""
    kind = column.type
    if pa.types.is_boolean(kind):
        return [None if v is None else f' t="b"><v>{int(v)}</v>' for v in column.to_pylist()]
    if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
        style = 2 if pa.types.is_date(kind) else 3
        micros = column.cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
        days = [None if v is None else _days(v) for v in micros]
        return [None if v is None else f' s="{style}"><v>{d}</v>' if d else _inline(np.datetime_as_string(
            np.datetime64(v, "us"), "D" if style == 2 else "us")) for v, d in zip(micros, days)]
    if pa.types.is_floating(kind):
        # not a number and infinities have no cell
        return [None if v is None or v - v != 0 else f"><v>{v!r}</v>" for v in column.to_pylist()]
    if pa.types.is_integer(kind) or pa.types.is_decimal(kind):
        return [None if v is None else f"><v>{v}</v>" for v in column.to_pylist()]
    return [None if v is None else _inline(v) for v in column.to_pylist()]


def _inline(text: str) -> str:
    return f' t="inlineStr"><is><t xml:space="preserve">{cell_text(text)}</t></is>'


def _workbook(names: Sequence[str], sheet_name: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    book = None
    for b in batches:
        if b.num_rows:
            book = book or _Writer(names, sheet_name, limit)
            for at in range(0, b.num_rows, 2000):
                book.add([_cells(c) for c in b.slice(at, 2000).columns])
            yield from _bytes(book.sink.take())
    if book is None and TaskContext.get().partitionId() == 0:
        book = _Writer(names, sheet_name, limit)        # Spark writes a file for the first partition even if it is empty
    if book is not None:
        book.close()
        yield from _bytes(book.sink.take())


def _bytes(lines: list[bytes]) -> Iterator[pa.RecordBatch]:
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])


def write_xlsx(df: DataFrame, path: str, sheet_name: str = "Sheet1", overwrite: bool = True, limit: int = MAX_ROWS) -> None:
    """K8: one workbook per partition, its rows streamed. Header bold on grey and frozen; numbers, truth values, dates
    and instants as such, nested values as JSON text; not a number and infinities are empty cells, characters that XML
    cannot hold are escaped as the format does. A sheet of ``limit`` rows goes on in sheets ``<name>~2``, ``~3``.

    The folder is written aside and swapped in when complete, so that ``df`` may come from the folder it replaces;
    without ``overwrite`` an existing one is an error.
    """
    if len(df.columns) > MAX_COLUMNS:
        raise ValueError(f"Data has {len(df.columns)} columns, exceeding Excel's limit of {MAX_COLUMNS}")
    if limit < 2:
        raise ValueError("a sheet needs room for its header and a row")
    spark = df.sparkSession
    ship_package(spark)
    plain = (T.StringType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    flat = df.select(*[(F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else js_string(F.col(f"`{f.name}`"), f.dataType)
                        ).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    book = flat.mapInArrow(partial(_workbook, df.columns, sheet_name, limit), "value binary")
    with swap_in(spark, path, overwrite) as aside:
        book.select(F.col("value").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(aside)
        rename_parts(spark, aside, ".xlsx")
        keep_only(spark, aside, ".xlsx")
