"""Spark data source for Excel workbooks, on the standard library alone.

Reading: one task per workbook, all cells as strings, the first row as header, plus the
sheet's own row number in ``_row``. Writing: every task writes workbooks of its own into
the target directory, like any other Spark sink, so no sheet passes through the driver.
Paths are file system paths that all executors can see.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship

# --- fixed values -----------------------------------------------------------
MAX_SHEET_ROWS = 1_048_576
MAX_CELL_CHARS = 32_767
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
# ----------------------------------------------------------------------------


def _column_number(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - 64
    return number


def _column_name(number: int) -> str:
    name = ""
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        return [s.get("name") for s in root.iter(f"{_MAIN}sheet")]


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = list(root.iter(f"{_MAIN}sheet"))
    chosen = sheets[0] if sheet is None else next((s for s in sheets if s.get("name") == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet {sheet!r}; there are {[s.get('name') for s in sheets]}")
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == chosen.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root]


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    return value.text


def read_rows(path: str, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number and cells by column number, streamed from the sheet's XML."""
    with zipfile.ZipFile(path) as book:
        shared = _shared_strings(book)
        with book.open(_sheet_path(book, sheet)) as stream:
            number = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells, at = {}, 0
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else at + 1
                    text = _cell_text(cell, shared)
                    if text is not None:
                        cells[at] = text
                yield number, cells
                row.clear()


def _header(path: str, sheet: str | None) -> list[str]:
    for number, cells in read_rows(path, sheet):
        if number == 1 and cells:
            return [cells.get(i, "").strip() or f"_c{i}" for i in range(1, max(cells) + 1)]
        break
    return []


class _Workbook:
    """One workbook written row by row; a full sheet opens the next one."""

    def __init__(self, path: str, header: list[str], sheet: str):
        self.book = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        self.header, self.sheet = header, sheet
        self.sheets: list[str] = []
        self.stream = None
        self._next_sheet()

    def _next_sheet(self) -> None:
        self._end_sheet()
        number = len(self.sheets) + 1
        self.sheets.append(self.sheet[:28] if number == 1 else f"{self.sheet[:24]}_{number}")
        self.stream = self.book.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True)
        self.stream.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="'
                          + _MAIN[1:-1].encode() + b'"><sheetData>')
        self.rows = 0
        self.add(self.header)

    def _end_sheet(self) -> None:
        if self.stream is not None:
            self.stream.write(b"</sheetData></worksheet>")
            self.stream.close()

    def add(self, values) -> None:
        if self.rows >= MAX_SHEET_ROWS:
            self._next_sheet()
        self.rows += 1
        cells = []
        for i, value in enumerate(values, 1):
            if value is None:
                continue
            at = f"{_column_name(i)}{self.rows}"
            if isinstance(value, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
                cells.append(f'<c r="{at}"><v>{value!r}</v></c>')
            else:
                text = escape(_NOT_XML.sub("", str(value))[:MAX_CELL_CHARS])
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        self.stream.write(f'<row r="{self.rows}">{"".join(cells)}</row>'.encode())

    def close(self) -> None:
        self._end_sheet()
        n = range(1, len(self.sheets) + 1)
        xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        office = "http://schemas.openxmlformats.org"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        self.book.writestr("[Content_Types].xml", xml + (
            f'<Types xmlns="{office}/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>'
                      for i in n) + "</Types>"))
        rel = f"{office}/officeDocument/2006/relationships"
        self.book.writestr("_rels/.rels", xml + (
            f'<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" '
            f'Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'))
        self.book.writestr("xl/_rels/workbook.xml.rels", xml + (
            f'<Relationships xmlns="{office}/package/2006/relationships">' + "".join(
                f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>'
                for i in n) + "</Relationships>"))
        self.book.writestr("xl/workbook.xml", xml + (
            f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(
                f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>'
                for i, s in zip(n, self.sheets)) + "</sheets></workbook>"))
        self.book.close()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], sheet: str | None, schema: StructType):
        self.paths, self.sheet, self.names = paths, sheet, schema.names

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        header = _header(partition.path, self.sheet)
        at = {name: i for i, name in enumerate(header, 1)}
        for number, cells in read_rows(partition.path, self.sheet):
            if number > 1:
                yield tuple(str(number) if name == "_row" else cells.get(at.get(name, 0))
                            for name in self.names)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, sheet: str, names: list[str], overwrite: bool):
        self.path, self.sheet, self.names = path, sheet, names
        os.makedirs(path, exist_ok=True)
        if overwrite:
            for old in glob.glob(os.path.join(glob.escape(path), "part-*.xlsx")):
                os.unlink(old)

    def write(self, iterator):
        book, path = None, os.path.join(self.path, f"part-{uuid.uuid4().hex}.xlsx")
        for row in iterator:
            if book is None:
                book = _Workbook(path + ".tmp", self.names, self.sheet)
            book.add(row)
        if book is not None:
            book.close()
        return _Written(path if book is not None else None)

    def commit(self, messages):
        # Files of failed or repeated attempts keep their .tmp name and are not read.
        for message in messages:
            if message is not None and message.path:
                os.rename(message.path + ".tmp", message.path)


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("sheet", ...).load(path)``."""

    @classmethod
    def name(cls):
        return "xlsx"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        if os.path.isdir(path):
            path = os.path.join(glob.escape(path), "*.xlsx")
        found = sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def schema(self):
        names = _header(self._paths()[0], self.options.get("sheet"))
        return StructType([StructField(n, StringType()) for n in ("_row", *names)])

    def reader(self, schema):
        return _Reader(self._paths(), self.options.get("sheet"), schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("sheet", "Sheet1"), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark).dataSource.register(XlsxSource)
