"""Spreadsheets (XLSX) as a Spark data source (S7), and a writer.

A workbook is a zip archive of XML parts. The source makes one partition for
each ``split_bytes`` of a sheet's XML; a task streams its sheet and yields the
rows that begin in its range, so a large sheet is read by many tasks and never
held whole. Only the shared strings are held (a sheet has at most 1,048,576
rows). Files are opened through Arrow file systems, so a path may be local or a
URI that Arrow knows.

    spark.read.format("workbook").option("path", "uploads/*.xlsx").load()
    file, sheet, row (1-based, as in the sheet), cells array<string>, error

A cell is text: numbers without a trailing .0, booleans as true / false, dates
as ISO text (option ``dates=serial``: as the stored number), formulas as their
stored result, blank and error cells null. An archive that cannot be read, or a
broken part of it, is one row with an ``error``, and never fails the job.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from altfinder.operators.positions import with_position

SCHEMA = "file string, sheet string, row int, cells array<string>, error string"
SPLIT_BYTES = 64 << 20
MAX_ROWS = 1_048_576  # fixed value: the rows of a sheet
# Built-in number formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ROW = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?row[\s/>]")
_END = re.compile(rb"</(?:[A-Za-z_][\w.-]*:)?sheetData")
_UNREADABLE = (zipfile.BadZipFile, zlib.error, expat.ExpatError, KeyError, ValueError, IndexError, EOFError, OSError, RuntimeError,
               NotImplementedError)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """Files of a path: a file, a folder's workbooks, or a pattern in the last part."""
    from pyarrow import fs

    system, inner = _file_system(path)
    prefix = path[:len(path) - len(inner)]
    folder, name = posixpath.split(inner)
    if any(c in name for c in "*?["):
        found = system.get_file_info(fs.FileSelector(folder or "."))
        return sorted(prefix + f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.path.lower().endswith(".xlsx"))
    return [path]


def _archive(path: str) -> zipfile.ZipFile:
    system, inner = _file_system(path)
    return zipfile.ZipFile(system.open_input_file(inner))


def _events(xml: bytes, start=None, end=None, text=None) -> None:
    """One pass over an XML text; names without their prefix."""
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def no_entities(*_):
        raise ValueError("document type definitions are not read")
    parser.StartDoctypeDeclHandler = no_entities
    bare = lambda name: name.rpartition(":")[2]
    if start:
        parser.StartElementHandler = lambda name, attrs: start(bare(name), attrs)
    if end:
        parser.EndElementHandler = lambda name: end(bare(name))
    if text:
        parser.CharacterDataHandler = text
    parser.Parse(xml, True)


def _plain(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def sheets(archive: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """((name, part) of each sheet in order, whether dates count from 1904)."""
    targets, found, since_1904 = {}, [], []

    def relation(name, attrs):
        if name == "Relationship":
            targets[attrs["Id"]] = attrs["Target"]

    def sheet(name, attrs):
        if name == "sheet":
            rid = next(v for k, v in attrs.items() if k.rpartition(":")[2] == "id" and ":" in k)
            found.append((attrs["name"], targets[rid]))
        elif name == "workbookPr" and attrs.get("date1904") in ("1", "true"):
            since_1904.append(True)
    _events(archive.read("xl/_rels/workbook.xml.rels"), relation)
    _events(archive.read("xl/workbook.xml"), sheet)
    return [(n, t[1:] if t.startswith("/") else posixpath.normpath(f"xl/{t}")) for n, t in found], bool(since_1904)


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out, parts, inside = [], [], {"t": 0, "rPh": 0}

    def start(name, attrs):
        if name == "si":
            parts.clear()
        elif name in inside:
            inside[name] += 1

    def end(name):
        if name == "si":
            out.append(_plain("".join(parts)))
        elif name in inside:
            inside[name] -= 1
    _events(archive.read("xl/sharedStrings.xml"), start, end, lambda s: parts.append(s) if inside["t"] and not inside["rPh"] else None)
    return out


def date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or a time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    dated, styles, place = set(DATE_FORMATS), set(), {"in": False, "n": 0}

    def start(name, attrs):
        if name == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", attrs["formatCode"])
            (dated.add if re.search("[ymdhsYMDHS]", code) else dated.discard)(int(attrs["numFmtId"]))
        elif name == "cellXfs":
            place["in"] = True
        elif name == "xf" and place["in"]:
            if int(attrs.get("numFmtId", 0)) in dated:
                styles.add(place["n"])
            place["n"] += 1

    def end(name):
        if name == "cellXfs":
            place["in"] = False
    _events(archive.read("xl/styles.xml"), start, end)
    return styles


def date_text(serial: float, since_1904: bool) -> str:
    """ISO text of a stored date; the 1900 calendar has a 29 February 1900."""
    if not since_1904 and serial < 60:
        serial += 1
    days, seconds = divmod(round(serial * 86400), 86400)
    time = (dt.datetime.min + dt.timedelta(seconds=seconds)).time().isoformat()
    if days == (0 if since_1904 else 1):
        return time
    day = (dt.date(1904, 1, 1) if since_1904 else dt.date(1899, 12, 30)) + dt.timedelta(days=days)
    return f"{day.isoformat()}T{time}" if seconds else day.isoformat()


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]+", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


@dataclass
class Cells:
    """How the cells of a workbook become text."""

    strings: list[str]
    dated: set[int]
    since_1904: bool

    def text(self, kind: str, style: int, value: str | None, inline: str) -> str | None:
        if kind == "inlineStr":
            return _plain(inline)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "true" if value.strip() in ("1", "true") else "false"
        if kind != "n":
            return _plain(value)
        x = float(value)
        if style in self.dated:
            return date_text(x, self.since_1904)
        return str(int(x)) if x.is_integer() and abs(x) < 1e21 else repr(x)

    def row(self, xml: bytes) -> tuple[int | None, list[str | None]]:
        """(number, cells) of one row element."""
        number, cells, at = [], [], {}

        def start(name, attrs):
            if name == "row":
                number.append(int(attrs["r"]) if "r" in attrs else None)
            elif name == "c":
                place = _column(attrs["r"]) if "r" in attrs else len(cells)
                cells.extend([None] * (place + 1 - len(cells)))
                at.update(place=place, kind=attrs.get("t", "n"), style=int(attrs.get("s", 0)), v=None, t=[], into=None, ph=0)
            elif name == "rPh":
                at["ph"] += 1
            elif name in ("v", "t") and at:
                at["into"] = name

        def end(name):
            if name == "c":
                cells[at["place"]] = self.text(at["kind"], at["style"], at["v"], "".join(at["t"]))
            elif name == "rPh":
                at["ph"] -= 1
            elif name in ("v", "t") and at:
                at["into"] = None

        def text(s):
            if at.get("into") == "v":
                at["v"] = (at["v"] or "") + s
            elif at.get("into") == "t" and not at["ph"]:
                at["t"].append(s)
        _events(xml, start, end, text)
        return number[0], cells


def row_elements(stream, lo: int, hi: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The row elements of a sheet's XML that begin at bytes [lo, hi)."""
    base, held, done = 0, b"", False
    while not done:
        more = stream.read(chunk)
        held += more
        stop = _END.search(held)
        if stop:
            held = held[:stop.start()]
        done = not more or bool(stop)
        starts = [m.start() for m in _ROW.finditer(held)]
        ends = [*starts[1:], len(held) if done else None][:len(starts)]
        for a, b in zip(starts, ends, strict=True):
            if base + a >= hi:
                return
            if b is not None and base + a >= lo:
                yield held[a:b]
        # the last row may go on; before the first one a tag may be cut
        keep = starts[-1] if starts else max(0, len(held) - 64)
        base, held = base + keep, held[keep:]


@dataclass
class Part(InputPartition):
    file: str
    sheet: str | None
    member: str | None
    lo: int
    hi: int
    error: str | None = None


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.every = options.get("sheets", "first") == "all"
        self.iso = options.get("dates", "iso") != "serial"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        """Reads the directories of the archives only."""
        out = []
        for file in _listed(self.path):
            try:
                with _archive(file) as archive:
                    named, _ = sheets(archive)
                    for name, member in named if self.every else named[:1]:
                        size = archive.getinfo(member).file_size
                        out += [Part(file, name, member, lo, lo + self.split) for lo in range(0, max(size, 1), self.split)]
            except _UNREADABLE as e:
                out.append(Part(file, None, None, 0, 0, f"{type(e).__name__}: {e}"))
        return out or [Part(self.path, None, None, 0, 0, "no workbook")]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.error:
            yield part.file, part.sheet, None, None, part.error
            return
        try:
            with _archive(part.file) as archive:
                _, since_1904 = sheets(archive)
                cells = Cells(shared_strings(archive), date_styles(archive) if self.iso else set(), since_1904)
                before = 0
                with archive.open(part.member) as stream:
                    for xml in row_elements(stream, part.lo, part.hi):
                        number, values = cells.row(xml)
                        if number is None:
                            if part.lo:
                                raise ValueError("a row without a number in a large sheet")
                            number = before + 1
                        before = number
                        yield part.file, part.sheet, number, values, None
        except _UNREADABLE as e:
            yield part.file, part.sheet, None, None, f"{type(e).__name__}: {e}"


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


def read_cells(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


# --------------------------------------------------------------------------- writer

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def letters(column: int) -> str:
    out, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(path: str, header: list[str], rows: list[list[str | None]]) -> None:
    """One workbook of one sheet; texts are shared strings, nulls no cells."""
    strings: dict[str, int] = {}

    def xml(number: int, values: list[str | None]) -> str:
        cells = "".join(f'<c r="{letters(i)}{number}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
                        for i, v in enumerate(values) if v is not None)
        return f'<row r="{number}">{cells}</row>'
    body = "".join(xml(i + 1, r) for i, r in enumerate([header, *rows]))
    kept = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType='
                               f'"application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" '
                               f'ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType='
                               f'"{kinds}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType='
                               f'"{kinds}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" '
                       f'Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/worksheet" '
                                      f'Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_DOC}/sharedStrings" '
                                      f'Target="sharedStrings.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">{kept}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
    }
    system, inner = _file_system(path)
    with system.open_output_stream(inner) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, (_XML + text).encode("utf-8"))


def write_workbooks(df: DataFrame, path: str, order: list[str], rows_per_file: int = 100_000) -> DataFrame:
    """``df`` (text columns, but for ``order``) as workbooks of at most
    ``rows_per_file`` rows under ``path``, in the order of ``order``; returns
    (file, rows). A task writes one workbook at a time; a repeated task writes
    the same file again."""
    if not 0 < rows_per_file < MAX_ROWS:
        raise ValueError(f"a sheet has at most {MAX_ROWS} rows")
    header = [c for c in df.columns if c not in order]
    system, inner = _file_system(path)
    system.create_dir(inner)
    placed = with_position(df, *[F.col(c) for c in order], name="_place")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_place")
        file = f"{path.rstrip('/')}/part-{int(key[0]):08d}.xlsx"
        write_workbook(file, header, [[None if v is None else str(v) for v in r] for r in rows[header].itertuples(index=False, name=None)])
        return pd.DataFrame({"file": [file], "rows": [len(rows)]})

    cut = placed.withColumn("_file", F.floor(F.col("_place") / rows_per_file).cast("long"))
    return cut.groupBy("_file").applyInPandas(write, "file string, rows long")
