"""Workbooks (.xlsx, .xlsm) as rows of cells, read from any path Spark reads, a file per row of work.

Formulas give their stored value, or nothing without one. Cells with a date format give a text of
it. A file that isn't such a workbook, or passes a limit, gives one row that says so in `error`.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Limits on sheets, rows and columns, and on a file's bytes.
MAX_SHEETS, MAX_ROWS, MAX_COLUMNS, MAX_BYTES = 100, 50_000, 256, 32 << 20
# Built-in numbers of date formats.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "source_file string, source_hash string, sheet string, sheet_index int, row int, col int, text string, number double, flag boolean, error string"
_FIELDS = [("source_file", pa.string()), ("source_hash", pa.string()), ("sheet", pa.string()), ("sheet_index", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("number", pa.float64()), ("flag", pa.bool_()), ("error", pa.string())]


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)([0-9]+)", reference).groups()
    col = 0
    for letter in letters:
        col = col * 26 + ord(letter) - 64
    return int(digits) - 1, col - 1


def _plain(number: float) -> str:
    return str(int(number)) if number.is_integer() else str(number)


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(MAIN + "si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(MAIN + "numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())}
    formats = root.find(MAIN + "cellXfs")
    return {k for k, f in enumerate(formats if formats is not None else []) if int(f.get("numFmtId", 0)) in DATE_FORMATS | own}


def decode(data: bytes) -> list[tuple[str, int, int, int, str | None, float | None, bool | None]]:
    """(sheet, sheet_index, row, col, text, number, flag) of every filled cell, places from 0; an empty sheet has one row with null place."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared, dates = _texts(book), _date_styles(book)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        properties = workbook.find(MAIN + "workbookPr")
        epoch = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        sheets = list(workbook.iter(MAIN + "sheet"))
        if len(sheets) > MAX_SHEETS:
            raise ValueError(f"more than {MAX_SHEETS} sheets")
        for index, sheet in enumerate(sheets):
            target = links[sheet.get(RELATED)]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if "worksheets" not in path:
                continue
            cells = 0
            for cell in ElementTree.fromstring(book.read(path)).iter(MAIN + "c"):
                row, col = _place(cell.get("r"))
                if row >= MAX_ROWS or col >= MAX_COLUMNS:
                    raise ValueError(f"{sheet.get('name')}: more than {MAX_ROWS} rows or {MAX_COLUMNS} columns")
                kind, value = cell.get("t", "n"), cell.find(MAIN + "v")
                text, number, flag = None, None, None
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(value.text)]
                elif kind == "b":
                    flag = value.text == "1"
                    text = str(flag)
                elif kind in ("str", "e", "d"):
                    text = value.text
                else:
                    number = float(value.text)
                    if int(cell.get("s", 0)) in dates:
                        text, number = str(epoch + timedelta(days=number)), None
                    else:
                        text = _plain(number)
                out.append((sheet.get("name"), index, row, col, text, number, flag))
                cells += 1
            if not cells:
                out.append((sheet.get("name"), index, None, None, None, None, None))
    return out


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length, data in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), batch.column("content").to_pylist(), strict=True):
            name = posixpath.basename(path)
            try:
                if length > MAX_BYTES:
                    raise ValueError(f"more than {MAX_BYTES} bytes")
                if not name.lower().endswith((".xlsx", ".xlsm")):
                    raise ValueError("not an .xlsx or .xlsm file")
                cells, error = decode(data), None
            except (ValueError, KeyError, IndexError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as broken:
                cells, error = [(None,) * 7], f"{type(broken).__name__}: {broken}"
            digest = hashlib.sha256(data or b"").hexdigest()[:16]
            rows = [(name, digest, *cell, error) for cell in cells]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of every workbook under `path`: file, its digest, sheet, place (from 0), text, number, flag and error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    return files.mapInArrow(_decoded, SCHEMA)
