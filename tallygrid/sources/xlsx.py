"""Workbooks: a Python data source for sheets (S3) and a writer of small tables (K2, K3).

A workbook is one zip file, so it is read by one task; it holds about a million rows at most.
Files are opened through Spark's ``binaryFile`` reader, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

from tallygrid.functions.text import unique_names

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
SPREADSHEET, OFFICE, PACKAGE = NS["m"], NS["r"], "http://schemas.openxmlformats.org/package/2006"


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet (by default the first) as text cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {x.get("name"): links[x.get(f"{{{OFFICE}}}id")] for x in book.find("m:sheets", NS)}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}: {', '.join(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{{{SPREADSHEET}}}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in ElementTree.fromstring(z.read(path)).iter(f"{{{SPREADSHEET}}}row"):
            cells: list[str | None] = []
            for cell in row:
                at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                value = cell.find("m:v", NS)
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{{{SPREADSHEET}}}t"))
                elif value is None or value.text is None:
                    text = None
                elif cell.get("t") == "s":
                    text = shared[int(value.text)]
                else:
                    text = value.text
                cells.append(text)
            yield cells


def column_number(reference: str) -> int:
    """Position from 0 of a cell reference such as ``AB12``."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def header_type(header: Sequence[str | None]) -> StructType:
    return StructType([StructField(h or f"column_{i + 1}", StringType()) for i, h in enumerate(header)])


def kept_rows(rows: Iterator[list[str | None]], width: int) -> Iterator[tuple]:
    """The rows behind the header that are not blank, all of one width."""
    next(rows)
    for cells in rows:
        if any(c not in (None, "") for c in cells):
            yield tuple((cells + [None] * width)[:width])


class XlsxSource(DataSource):
    """``spark.read.format("tallygrid_xlsx").option("sheet", name).load(path)``: text columns. For
    files that driver and executors reach as a path; :func:`read_sheet` reads any store."""

    @classmethod
    def name(cls) -> str:
        return "tallygrid_xlsx"

    def rows(self) -> Iterator[list[str | None]]:
        with open(self.options["path"].removeprefix("file:"), "rb") as f:
            yield from sheet_rows(f.read(), self.options.get("sheet"))

    def schema(self) -> StructType:
        return header_type(next(self.rows()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self, len(schema.fields))


#: Rows of a sheet handed over at a time.
SHEET_ROWS = 10_000


class XlsxReader(DataSourceReader):
    def __init__(self, source: XlsxSource, width: int):
        self.source, self.width = source, width

    def read(self, partition) -> Iterator[tuple]:
        yield from kept_rows(self.source.rows(), self.width)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of the workbooks at a path in any store: text columns, named by the header of the
    first. Workbooks are parsed in tasks, one each; only the header reaches the driver."""
    books = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": [next(sheet_rows(bytes(book), sheet)) for book in batch["content"]]})

    shape = header_type(books.limit(1).mapInPandas(headers, "h array<string>").first()[0])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book in batch["content"]:
                kept = kept_rows(sheet_rows(bytes(book), sheet), len(shape))
                while some := list(islice(kept, SHEET_ROWS)):
                    yield pd.DataFrame(some, columns=shape.names, dtype=object)

    return books.mapInPandas(rows, shape)


def _cell(value: object, style: int, at: str) -> str:
    if value is None:
        return f'<c r="{at}" s="{style}"/>'
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


#: Styles: plain, bold centred header with lines above and below, last row with a line below, note in italics.
STYLES = (
    f'<styleSheet xmlns="{SPREADSHEET}"><fonts count="3"><font/><font><b/></font><font><i/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="3"><border/><border><top style="medium"/><bottom style="thin"/></border><border><bottom style="medium"/></border></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" borderId="1" applyFont="1" applyBorder="1" applyAlignment="1">'
    '<alignment horizontal="center"/></xf><xf borderId="2" applyBorder="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>'
)


def _sheet(header: Sequence[str], rows: Sequence[Sequence[object]], note: str | None, widest: int) -> str:
    widths = [min(widest, max(len(str(x)) for x in [h, *(r[i] for r in rows)]) + 2) for i, h in enumerate(header)]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    lines = []
    for k, row in enumerate([header, *rows]):
        style = 1 if k == 0 else 2 if k == len(rows) else 0
        lines.append(f'<row r="{k + 1}">' + "".join(_cell(v, style, f"{_letters(i)}{k + 1}") for i, v in enumerate(row)) + "</row>")
    if note:
        lines.append(f'<row r="{len(rows) + 2}">{_cell(note, 3, f"A{len(rows) + 2}")}</row>')
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    return f'<worksheet xmlns="{SPREADSHEET}">{pane}<cols>{cols}</cols><sheetData>{"".join(lines)}</sheetData></worksheet>'


def workbook(tables: Mapping[str, tuple[Sequence[str], Sequence[Sequence[object]]]], note: str | None = None, widest: int = 40) -> bytes:
    """A workbook of small tables (header, rows), one sheet each; empty tables are left out."""
    kept = {n: t for n, t in tables.items() if t[1]}
    names = unique_names([re.sub(r"[\[\]:*?/\\]", "_", n) for n in kept])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{main}.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SPREADSHEET}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="s" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        for i, (header, rows) in enumerate(kept.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", _sheet(list(header), [list(r) for r in rows], note, widest))
    return out.getvalue()
