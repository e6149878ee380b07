"""Scan of spreadsheet workbooks (xlsx, xlsm): one row for each sheet, or one with an error for a file."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_HEADERS = 12
SCHEMA = "path string, sheet_index int, sheet_name string, num_rows long, num_cols long, headers array<string>, error string"
_ENCRYPTED = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"  # fixed value: an OLE container holds the locked package


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n


def _sheet(z: zipfile.ZipFile, name: str, shared: list[str]) -> tuple[int, int, list[str]]:
    """(rows, columns, headers): the last row and column used, and the first row's texts that aren't blank. Rows are
    streamed, so a sheet of any length takes little memory."""
    rows = cols = at = 0
    headers: dict[int, str] = {}
    with z.open(name) as f:
        for _, row in ElementTree.iterparse(f):
            if _tag(row) != "row":
                continue
            at = int(row.get("r") or at + 1)
            place = 0
            for cell in row:
                place = _column(cell.get("r") or "") or place + 1
                cols, rows = max(cols, place), max(rows, at)
                if at == 1 and place <= MOST_HEADERS:
                    value = next((v.text or "" for v in cell if _tag(v) == "v"), "")
                    kind = cell.get("t")
                    headers[place] = (shared[int(value)] if kind == "s" and value else _text(cell) if kind == "inlineStr" else value).strip()
            row.clear()
    return rows, cols, [headers[i] for i in sorted(headers) if headers[i]]


def parsed(path: str, content: bytes) -> list[tuple]:
    """The rows of SCHEMA for one file."""
    if content.startswith(_ENCRYPTED):
        return [(path, None, None, None, None, None, "encrypted")]
    if not path.lower().endswith((".xlsx", ".xlsm")):
        return [(path, None, None, None, None, None, "unsupported")]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            out = []
            for x in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(x) == "sheet"):
                link = next(v for k, v in x.attrib.items() if k.endswith("}id"))
                rows, cols, headers = _sheet(z, posixpath.normpath(posixpath.join("xl", targets[link])).lstrip("/"), shared)
                out.append((path, len(out), x.get("name"), rows, cols, headers, None))
            return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, ValueError, IndexError):
        return [(path, None, None, None, None, None, "corrupt")]


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row of SCHEMA per sheet of each workbook under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = pd.DataFrame(parsed(p, content), columns=["path", "sheet_index", "sheet_name", "num_rows", "num_cols", "headers", "error"])
                yield rows.astype({"sheet_index": "Int32", "num_rows": "Int64", "num_cols": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
