"""Sheets of workbooks (zipped XML) as rows of texts; workbooks are rows of Spark's binary file source, so tasks parse them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Number formats of the file format that mean dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _text(node) -> str:
    """The text of a string item, without its phonetic hints."""
    return "".join(t.text or "" for part in node for t in ([part] if _local(part.tag) == "t" else part.iter() if _local(part.tag) == "r" else []) if _local(t.tag) == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for node in root.iter():
        if _local(node.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", "").lower())):
            dates.add(int(node.get("numFmtId")))
    styles = next((n for n in root if _local(n.tag) == "cellXfs"), [])
    return {i for i, s in enumerate(styles) if int(s.get("numFmtId", 0)) in dates}


def read_book(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet, rows of texts) of each sheet, in order. Empty cells are empty texts; rows without any text are left out, as are sheets without rows."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    dates = _date_styles(book)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(node.tag) != "sheet":
            continue
        target = next(targets[v] for k, v in node.attrib.items() if _local(k) == "id")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for _, row in ElementTree.iterparse(io.BytesIO(book.read(path))):
            if _local(row.tag) != "row":
                continue
            cells: dict[int, str] = {}
            for i, c in enumerate(row):
                kind, value = c.get("t", "n"), next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                if kind == "s" and value:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(_text(v) for v in c if _local(v.tag) == "is")
                elif kind == "n" and value and int(c.get("s", 0)) in dates:
                    value = str((_EPOCH + timedelta(days=float(value))).replace(microsecond=0))
                cells[_column(c.get("r")) if c.get("r") else i] = value
            if any(cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            row.clear()
        if rows:
            yield node.get("name", ""), rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            for sheet, rows in read_book(data):
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([f"{path}::{sheet}"] * n), pa.array([path] * n), pa.array(range(n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["_src", "_file", "row", "cells"])


def sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_src, _file, row, cells) of all sheets; row 0 is the header."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_parse, "_src string, _file string, row long, cells array<string>")
