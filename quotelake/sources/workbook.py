"""Workbook sheets (OOXML) as a Spark data source: a partition for each sheet and range of rows, each streaming over its sheet's XML.

A workbook is a zip of XML parts. The driver reads which sheets there are and the size each declares; a task reads the shared strings and runs through its sheet up to its last row,
holding one row at a time. Paths may be in any file system that Arrow opens; they must be reachable from all executors.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: A partition has so many rows of a sheet.
ROWS = 50_000


def _open(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(inner))


def _files(path: str) -> list[str]:
    """The workbook, or those of a folder, by name."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    base = path.rstrip("/")
    return sorted(f"{base}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.lower().endswith(".xlsx"))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _last_row(book: zipfile.ZipFile, part: str) -> int | None:
    """The last row that the sheet's head declares; None if it doesn't."""
    with book.open(part) as f:
        found = re.search(rb'<dimension[^>]*ref="(?:[A-Z]+\d+:)?[A-Z]+(\d+)"', f.read(4096))
    return int(found.group(1)) if found else None


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, element in ElementTree.iterparse(f):
            if element.tag == f"{_MAIN}si":
                out.append("".join(t.text or "" for t in element.iter(f"{_MAIN}t")))
                element.clear()
    return out


def _column(reference: str) -> int:
    """``AB12`` as 27."""
    n = 0
    for c in re.match("[A-Z]+", reference).group(0):
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, texts: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        said = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    else:
        v = cell.find(f"{_MAIN}v")
        said = None if v is None else v.text
        if kind == "s" and said is not None:
            said = texts[int(said)]
        elif kind == "b" and said is not None:
            said = "true" if said == "1" else "false"
        elif kind == "e":
            said = None
    said = (said or "").strip()
    return said or None


class _Range(InputPartition):
    def __init__(self, path: str, sheet: str, part: str, first: int, last: int | None) -> None:
        self.path, self.sheet, self.part, self.first, self.last = path, sheet, part, first, last


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.only, self.rows = options["path"], options.get("sheet"), int(options.get("rowsPerPartition", ROWS))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path):
            with _open(path) as book:
                for sheet, part in _sheets(book):
                    if self.only and sheet != self.only:
                        continue
                    last = _last_row(book, part) or 1
                    starts = range(1, last + 1, self.rows)
                    # the last range is open: a sheet may hold more rows than its head declares
                    out += [_Range(path, sheet, part, a, None if a == starts[-1] else a + self.rows - 1) for a in starts]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with _open(partition.path) as book:
            texts = _texts(book)
            with book.open(partition.part) as f:
                number = 0
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    if partition.last is not None and number > partition.last:
                        return
                    if number >= partition.first:
                        cells: list[str | None] = []
                        for cell in row.iter(f"{_MAIN}c"):
                            at = _column(cell.get("r")) if cell.get("r") else len(cells)
                            cells += [None] * (at + 1 - len(cells))
                            cells[at] = _value(cell, texts)
                        if any(c is not None for c in cells):
                            yield partition.path.rsplit("/", 1)[-1], partition.sheet, number, cells
                    row.clear()


class Workbook(DataSource):
    """Options: ``path`` (a workbook or a folder of them), ``sheet`` (all by default), ``rowsPerPartition``. Rows without any value are left out; cells are trimmed texts, numbers as
    they are stored; empty cells and errors are null."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("workbook")`` known."""
    spark.dataSource.register(Workbook)
