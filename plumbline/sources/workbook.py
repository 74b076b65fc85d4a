"""The first sheet of an xlsx workbook as a Spark data source of text columns.

A workbook is a zip of XML that only reads as a whole, so it is one partition, read row by row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _bytes(path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return f.read()


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as texts (booleans as true and false), None where a cell is empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{MAIN}sheets")[0].get(LINK)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[first].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for place, c in enumerate(row.iter(f"{MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else place
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}[v.text] if kind == "b" else v.text
                yield cells
                row.clear()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        head = next(sheet_rows(_bytes(self.options["path"])), [])
        return StructType([StructField(name or f"Unnamed: {k}", StringType()) for k, name in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(self.options["path"], len(schema))


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def read(self, partition) -> Iterator[tuple]:
        rows = sheet_rows(_bytes(self.path))
        next(rows, None)
        for cells in rows:
            if any(c is not None for c in cells):
                yield tuple((cells + [None] * self.width)[: self.width])
