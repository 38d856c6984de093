"""Workbooks (.xlsx) as rows of text: every file is read by the task that holds it, row by row, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a task hands over.
BATCH = 5_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the file format that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column(reference: str) -> int:
    """The number, from 0, of the column of a cell such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The runs of a string, without its phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t"))


class Workbook:
    """A workbook's sheets in order, its shared strings and which of its cell styles show dates."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target", "") for r in self._xml("xl/_rels/workbook.xml.rels")}
        targets = [links[s.get(_LINK)] for s in book.iter(f"{_MAIN}sheet")]
        self.sheets = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in targets]
        self.first_day = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr")) else datetime(1899, 12, 30)
        self.strings = [_text(s) for s in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        self.dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))) for f in styles.iter(f"{_MAIN}numFmt")}
            self.dated = [own.get(i, i in _DATE_FORMATS) for f in styles.iter(f"{_MAIN}cellXfs") for x in f for i in [int(x.get("numFmtId", "0"))]]

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, raw = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            return next((_text(s) for s in cell.iter(f"{_MAIN}is")), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind != "n":
            return raw
        number, style = float(raw), int(cell.get("s", "0"))
        if style < len(self.dated) and self.dated[style]:
            day = self.first_day + timedelta(days=number)
            return day.date().isoformat() if number == int(number) else day.replace(microsecond=0).isoformat(" ")
        return str(int(number)) if number.is_integer() and abs(number) < 2**63 else repr(number)

    def rows(self, sheet: int = 0) -> Iterator[tuple[int, list[str | None]]]:
        """(row number from 1, values) of the rows that hold a value; cells that a row leaves out are null."""
        with self.zip.open(self.sheets[sheet]) as f:
            at, data = 0, None
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = node if node.tag == f"{_MAIN}sheetData" else data
                    continue
                if node.tag != f"{_MAIN}row":
                    continue
                at = int(node.get("r", at + 1))
                values: list[str | None] = []
                for cell in node.iter(f"{_MAIN}c"):
                    place = _column(cell.get("r", "")) if cell.get("r") else len(values)
                    values += [None] * (place - len(values))
                    values.append(self._value(cell))
                if any(v is not None and v.strip() for v in values):
                    yield at, values
                data.clear()  # rows that were read are let go


def xlsx_rows(spark: SparkSession, paths: str | list[str], sheet: int = 0) -> DataFrame:
    """(path, row, cells) of the rows of a sheet of every workbook; row counts from 1 and cells are text or null."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(path: str, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "row", "cells"])

        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                held: list = []
                for r in Workbook(content.as_py()).rows(sheet):
                    held.append(r)
                    if len(held) == BATCH:
                        yield batch(path.as_py(), held)
                        held = []
                yield batch(path.as_py(), held)

    return found.select("path", "content").mapInArrow(run, "path string, row long, cells array<string>")


def read_xlsx(spark: SparkSession, paths: str | list[str], header_row: int = 1, sheet: int = 0) -> DataFrame:
    """Rows as text below header_row, which counts from 1, with upper-case names as of the first path; see files.read_csv.

    Columns without a name are dropped. Workbooks read together share one layout.
    """
    rows = xlsx_rows(spark, paths, sheet)
    head = rows.filter(F.col("row") == header_row).agg(F.min_by("cells", "path").alias("cells")).first()["cells"] or []
    named = [(i, name.strip().upper().replace(" ", "_")) for i, name in enumerate(head) if name and name.strip()]
    return rows.filter(F.col("row") > header_row).select(*[F.get("cells", F.lit(i)).alias(name) for i, name in named])
