"""Spreadsheets (.xlsx) as a data source: ``spark.read.format("spreadsheet")`` and ``df.write.format("spreadsheet")``, after register().

Reading. ``path`` is a file, or a folder of them, in any file system that pyarrow opens. A task reads a range of ``rows_per_partition`` rows of
one file's sheet, as a stream: no sheet is held in memory, only its shared strings. Options: ``sheet`` (a name, or a number from 0), ``header`` (true: the first row of each
file names its columns), ``merged`` (``first``: a merged area's value is in its first cell; ``fill``: in all). Without a schema, columns are strings
named as the first file's header. With one, cells are turned into its types; a cell that is none of its column's type is null, as are errors and missing cells.

Rows that a sheet leaves out between others are rows of nulls. A date is a number with a date's format, in the file's date system (1900 or 1904), to the millisecond.

Writing. Each task writes files of at most ``rows_per_file`` rows beside the target; commit moves them there, abort leaves none. Numbers beyond what a
cell holds exactly are written as text, as are characters that XML forbids, by their codes. A text beyond a cell's 32,767 characters is an error.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import pairwise
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS_PER_PARTITION, ROWS_PER_FILE, CELL_CHARS, EXACT = 50_000, 1_048_575, 32_767, 1 << 53
#: Fixed values of the format: ids of built-in number formats that show dates or times.
DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_CODE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_FORBIDDEN = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
DAY = datetime.timedelta(days=1)


def files_of(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The file system, and the spreadsheets at path in the order of their names."""
    fs, place = located(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [place]
    found = fs.get_file_info(pafs.FileSelector(place))
    return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and f.extension == "xlsx" and not f.base_name.startswith(("_", ".", "~")))


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))
    return pafs.LocalFileSystem(), path


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def column_name(number: int) -> str:
    name, number = "", number + 1
    while number:
        number, k = divmod(number - 1, 26)
        name = chr(65 + k) + name
    return name


def _text(element: ElementTree.Element | None) -> str:
    """The text of a string item: its runs, but not how they are pronounced."""
    if element is None:
        return ""
    parts = [t.text or "" for child in element for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else [])]
    return _CODE.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class Workbook:
    """An open file's sheets, shared strings and formats."""

    def __init__(self, file: Any):
        self.zip = zipfile.ZipFile(file)
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name", ""): place(targets[s.get(RELATION)]) for s in book.iter(f"{MAIN}sheet")}
        about = book.find(f"{MAIN}workbookPr")
        self.from_1904 = about is not None and about.get("date1904") in ("1", "true")
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, item in ElementTree.iterparse(f):
                    if item.tag == f"{MAIN}si":
                        self.strings.append(_text(item))
                        item.clear()
        self.dates = self._date_styles(ElementTree.fromstring(self.zip.read("xl/styles.xml"))) if "xl/styles.xml" in names else []

    @staticmethod
    def _date_styles(styles: ElementTree.Element) -> list[bool]:
        """Whether each cell style shows a date."""
        plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code)
        own = {int(f.get("numFmtId", 0)): bool(re.search("[ymdhs]", plain(f.get("formatCode", "").split(";")[0]), re.I)) for f in styles.iter(f"{MAIN}numFmt")}
        styled = styles.find(f"{MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in styled] if styled is not None else []
        return [own.get(i, i in DATES) for i in ids]

    def sheet(self, name: str) -> str:
        if name in self.sheets:
            return self.sheets[name]
        if name.isdigit() and int(name) < len(self.sheets):
            return list(self.sheets.values())[int(name)]
        raise ValueError(f"no sheet {name!r} among {list(self.sheets)}")

    def last_row(self, member: str) -> int:
        """What the sheet says its last row is, or 0; the rows themselves count."""
        with self.zip.open(member) as f:
            found = re.search(rb"<(?:\w+:)?dimension[^>]*ref=[\"'][A-Z]+\d+:[A-Z]+(\d+)", f.read(4096))
        return int(found[1]) if found else 0

    def merged(self, member: str) -> list[tuple[int, int, int, int]]:
        """First row, first column, last row, last column of the merged areas."""
        out = []
        with self.zip.open(member) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}mergeCell":
                    a, _, b = e.get("ref", "").partition(":")
                    at = lambda x: (int(re.sub(r"\D", "", x)), column_number(x))
                    out.append((*at(a), *at(b or a)))
                e.clear()
        return out

    def when(self, serial: float) -> datetime.datetime | None:
        try:
            first = datetime.datetime(1904, 1, 1) if self.from_1904 else datetime.datetime(1899, 12, 30) + (DAY if serial < 60 else 0 * DAY)
            return first + datetime.timedelta(milliseconds=round(serial * 86_400_000))
        except (OverflowError, ValueError):
            return None

    def value(self, cell: ElementTree.Element) -> Any:
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return _text(cell.find(f"{MAIN}is"))
        if v is None or v.text is None:
            return "" if kind == "str" and v is not None else None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "str":
            return _CODE.sub(lambda m: chr(int(m[1], 16)), v.text)
        if kind == "b":
            return v.text.strip() in ("1", "true")
        if kind == "d":
            return moment(v.text)
        if kind == "e":
            return None
        number = float(v.text)
        style = int(cell.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return self.when(number)
        return int(number) if number.is_integer() and abs(number) < EXACT else number

    def rows(self, member: str, first: int, last: int | None) -> Iterator[tuple[int, dict[int, Any]]]:
        """(number, values by column) of the rows from first to last that the sheet has."""
        at = 0
        with self.zip.open(member) as f:
            data = None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    if e.tag == f"{MAIN}sheetData":
                        data = e
                    continue
                if e.tag != f"{MAIN}row":
                    continue
                at = int(e.get("r", at + 1))
                if last is not None and at > last:
                    return
                if at >= first:
                    out, k = {}, -1
                    for cell in e.iter(f"{MAIN}c"):
                        k = column_number(cell.get("r", "")) if cell.get("r") else k + 1
                        out[k] = self.value(cell)
                    yield at, out
                data.clear()


def moment(text: str) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromisoformat(text.strip()).replace(tzinfo=None)
    except ValueError:
        return None


def converted(v: Any, kind: T.DataType, book: Workbook) -> Any:
    """A cell's value as a column's type, or None."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        if isinstance(v, datetime.datetime):
            return v.date().isoformat() if v.time() == datetime.time() else v.isoformat(" ")
        return str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else repr(v)
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        v = moment(v) if isinstance(v, str) else book.when(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
        return v.date() if isinstance(kind, T.DateType) and isinstance(v, datetime.datetime) else v if isinstance(v, datetime.datetime) else None
    if isinstance(v, (bool, datetime.datetime)):
        return None
    try:
        exact = decimal.Decimal(v.strip() if isinstance(v, str) else repr(v))
    except decimal.InvalidOperation:
        return None
    if isinstance(kind, T.DecimalType):
        shown = exact.quantize(decimal.Decimal(1).scaleb(-kind.scale)) if exact.is_finite() and exact.adjusted() < kind.precision - kind.scale else None
        return shown
    if isinstance(kind, T.IntegralType):
        bits = {"byte": 8, "tinyint": 8, "smallint": 16, "int": 32}.get(kind.simpleString(), 64)
        return int(exact) if exact.is_finite() and exact == exact.to_integral_value() and -(1 << bits - 1) <= exact < 1 << bits - 1 else None
    return float(exact) if exact.is_finite() else None


class SheetRange(InputPartition):
    def __init__(self, path: str, file: str, first: int, last: int | None):
        self.path, self.file, self.first, self.last = path, file, first, last


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.header = options.get("header", "true").lower() == "true"

    def partitions(self) -> list[SheetRange]:
        """Ranges of rows; the last of a file has no end, as a sheet may have more rows than it says."""
        path, step = self.options["path"], int(self.options.get("rows_per_partition", ROWS_PER_PARTITION))
        fs, files = files_of(path)
        out = []
        for file in files:
            with fs.open_input_file(file) as f:
                book = Workbook(f)
                rows = book.last_row(book.sheet(self.options.get("sheet", "0")))
            edges = [*range(2 if self.header else 1, max(rows, 1) + 1, step)] or [2]
            out += [SheetRange(path, file, a, b - 1) for a, b in pairwise(edges)] + [SheetRange(path, file, edges[-1], None)]
        return out

    def read(self, partition: SheetRange) -> Iterator[tuple]:
        fs, _ = located(partition.path)
        with fs.open_input_file(partition.file) as f:
            book = Workbook(f)
            member = book.sheet(self.options.get("sheet", "0"))
            names = [c.name for c in self.schema]
            kinds = [c.dataType for c in self.schema]
            place = list(range(len(names)))
            if self.header:
                head = header_of(book, member)
                place = [head.index(n) if n in head else -1 for n in names]
            areas = book.merged(member) if self.options.get("merged", "first") == "fill" else []
            held: dict[tuple[int, int], Any] = {}
            starts = {(a, b) for a, b, _, _ in areas}
            if starts:
                last = max(a for a, _ in starts)
                held = {(r, c): v for r, row in book.rows(member, min(a for a, _ in starts), last) for c, v in row.items() if (r, c) in starts}
            empty = (None,) * len(names)
            at = partition.first
            for number, row in book.rows(member, partition.first, partition.last):
                for gap in range(at, number):
                    yield self._row(filled({}, gap, areas, held), place, kinds, book) if areas else empty
                yield self._row(filled(row, number, areas, held), place, kinds, book)
                at = number + 1
            if partition.last is not None and at <= partition.last and next(book.rows(member, partition.last + 1, None), None):
                for gap in range(at, partition.last + 1):
                    yield self._row(filled({}, gap, areas, held), place, kinds, book) if areas else empty

    @staticmethod
    def _row(row: dict[int, Any], place: list[int], kinds: list[T.DataType], book: Workbook) -> tuple:
        return tuple(converted(row.get(p), k, book) for p, k in zip(place, kinds, strict=True))


def filled(row: dict[int, Any], number: int, areas: list[tuple[int, int, int, int]], held: dict[tuple[int, int], Any]) -> dict[int, Any]:
    """The row with the values of the merged areas that it crosses."""
    for a, b, c, d in areas:
        if a <= number <= c:
            row = {**row, **{k: held.get((a, b)) for k in range(b, d + 1)}}
    return row


def header_of(book: Workbook, member: str) -> list[str]:
    """The names in the first row; an empty one is by its column, and a repeated one has its column added."""
    row = next((r for n, r in book.rows(member, 1, 1)), {})
    out: list[str] = []
    for k in range(max(row, default=-1) + 1):
        name = converted(row.get(k), T.StringType(), book) or f"_{column_name(k)}"
        out.append(f"{name}_{column_name(k)}" if name in out else name)
    return out


_SHEET_HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    # cell styles: 0 plain, 1 date, 2 date and time
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN[1:-1]}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss.000"/></numFmts><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def cell(v: Any) -> str:
    """A cell's type and content; "" for a null."""
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "" if v is None else 't="e"><v>#NUM!</v>'
    if isinstance(v, bool):
        return f't="b"><v>{int(v)}</v>'
    if isinstance(v, datetime.datetime):
        gap = v - datetime.datetime(1899, 12, 30)
        return f's="2"><v>{(gap - (DAY if v < datetime.datetime(1900, 3, 1) else 0 * DAY)) / DAY!r}</v>' if v >= datetime.datetime(1900, 1, 1) else cell(v.isoformat(" "))
    if isinstance(v, datetime.date):
        return cell(datetime.datetime.combine(v, datetime.time())).replace('s="2"', 's="1"').replace(" 00:00:00<", "<")
    if isinstance(v, (int, float)) and (isinstance(v, float) or abs(v) < 10**15):
        return f"><v>{v!r}</v>"
    if isinstance(v, decimal.Decimal) and v.is_finite() and len(v.as_tuple().digits) <= 15:
        return f"><v>{v}</v>"
    if not isinstance(v, (str, int, decimal.Decimal)):
        v = json.dumps(v.asDict(True) if isinstance(v, T.Row) else v, ensure_ascii=False, default=str)
    v = str(v)
    if len(v) > CELL_CHARS:
        raise ValueError(f"a text of {len(v)} characters; a cell holds {CELL_CHARS}")
    return f't="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", v))}</t></is>'


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class SheetWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.names = [c.name for c in schema]
        self.header = options.get("header", "true").lower() == "true"
        self.sheet = options.get("sheet", "Sheet1")
        self.rows_per_file = min(ROWS_PER_FILE, int(options.get("rows_per_file", ROWS_PER_FILE)))
        self.job = uuid.uuid4().hex
        fs, place = located(self.path)
        fs.create_dir(f"{place}/_job-{self.job}", recursive=True)

    def _write_file(self, rows: Iterator[tuple], place: str) -> bool:
        """A file of the next rows; whether there may be more."""
        fs, _ = located(self.path)
        with fs.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in _PARTS.items():
                z.writestr(name, content)
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION[1:-3]}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(_SHEET_HEAD.encode())
                at = 0
                if self.header:
                    at = 1
                    f.write(self._line(at, self.names))
                count = 0
                while count < self.rows_per_file and (row := next(rows, None)) is not None:
                    at, count = at + 1, count + 1
                    f.write(self._line(at, row))
                f.write(b"</sheetData></worksheet>")
        return count == self.rows_per_file

    @staticmethod
    def _line(at: int, values: list | tuple) -> bytes:
        cells = "".join(f'<c r="{column_name(k)}{at}" {c}</c>' for k, c in enumerate(map(cell, values)) if c)
        return f'<row r="{at}">{cells}</row>'.encode("utf-8", "surrogatepass")

    def write(self, iterator: Iterator[T.Row]) -> Written:
        from pyspark import TaskContext

        context, files = TaskContext.get(), []
        _, place = located(self.path)
        rows, more = (tuple(r) for r in iterator), True
        while more:
            files.append(f"part-{context.partitionId():05d}-{len(files):03d}-{self.job}.xlsx")
            # an attempt that fails leaves its own file, not another's
            more = self._write_file(rows, f"{place}/_job-{self.job}/{context.taskAttemptId()}-{files[-1]}")
        return Written([f"{context.taskAttemptId()}-{f}" for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = located(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(place)) if f.type == pafs.FileType.File and (f.extension == "xlsx" or f.base_name == "_SUCCESS")]
        for name in [n for m in messages if m for n in m.files]:
            fs.move(f"{place}/_job-{self.job}/{name}", f"{place}/{name.partition('-')[2]}")
        for f in old if self.overwrite else []:
            fs.delete_file(f)
        fs.delete_dir(f"{place}/_job-{self.job}")
        with fs.open_output_stream(f"{place}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = located(self.path)
        fs.delete_dir(f"{place}/_job-{self.job}")


class SheetSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> T.StructType:
        fs, files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no spreadsheet in {self.options['path']}: give a schema")
        with fs.open_input_file(files[0]) as f:
            book = Workbook(f)
            member = book.sheet(self.options.get("sheet", "0"))
            head = header_of(book, member)
            if self.options.get("header", "true").lower() != "true":
                head = [f"_{column_name(k)}" for k in range(max((max(r, default=-1) for _, r in book.rows(member, 1, None)), default=-1) + 1)]
        return T.StructType([T.StructField(n, T.StringType()) for n in head])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)


def read(spark: SparkSession, path: str, schema: str | None = None, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format("spreadsheet").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, *, append: bool = False, **options: object) -> None:
    register(df.sparkSession)
    df.write.format("spreadsheet").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).mode("append" if append else "overwrite").save(path)
