"""Workbooks as a Spark data source, `docloom-xlsx`.

    spark.read.format("docloom-xlsx").load(path)                    # cells: one row for each cell
    spark.read.format("docloom-xlsx").schema("a long, b string").load(path)   # a table: rows under a header row
    df.write.format("docloom-xlsx").mode("overwrite").save(path)    # a workbook for each task

Reading takes one partition for each sheet (for each file, with the option files = "whole" or over `MOST_OPENED` files,
so that the driver does not open them all), and streams the sheet's rows: a task holds a batch, whatever the sheet's
length, and a workbook's shared texts. The option sheets = "list" gives a row for each sheet instead of its cells. A file that
cannot be read is a row with its error (a table read under a schema fails instead). Writing streams too; a sheet that
is full is followed by the next. Empty cells are null; texts keep what XML cannot hold as _xHHHH_, whole numbers all
their digits, dates and times their ISO form. Text that begins with "=" stays text unless the option formulas is "true".
"""

from __future__ import annotations

import datetime
import decimal
import math
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.session import ship
from docloom.sources.media import is_encrypted
from docloom.sources.storage import Job, Written, listed, located

#: The format's name spaces, part types and limits.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
PART = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SHEET_ROWS, SHEET_COLUMNS, CELL_CHARS = 1_048_576, 16_384, 32_767

CELLS = "path string, sheet_ix int, sheet string, row int, col int, kind string, v string, formula string, error string"
SHEETS = "path string, sheet_ix int, sheet string, error string"
ENDINGS = (".xlsx", ".xlsm", ".xls", ".xlsb")
#: Files that the driver opens to plan a partition for each sheet; rows of a batch.
MOST_OPENED, BATCH = 1_000, 10_000
_KINDS = {"s": "string", "str": "string", "inlineStr": "string", "b": "boolean", "e": "error"}
_UNSAID = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_SAID = re.compile(r"_x([0-9A-Fa-f]{4})_")


def said(text: str) -> str:
    """Text as a sheet's XML holds it."""
    return escape(_UNSAID.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def unsaid(text: str) -> str:
    return _SAID.sub(lambda m: chr(int(m[1], 16)), text)


def letters(n: int) -> str:
    """The letters of a column, from one."""
    return "" if n < 1 else letters((n - 1) // 26) + chr(65 + (n - 1) % 26)


def place(ref: str) -> tuple[int, int]:
    """Row and column of a reference like B12."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    n = 0
    for c in m[1]:
        n = n * 26 + ord(c) - 64
    return int(m[2]), n


# --- reading -----------------------------------------------------------------------------------------------------


@dataclass
class SheetPart(InputPartition):
    path: str
    index: int | None = None
    sheet: str | None = None
    member: str | None = None
    error: str | None = None


def refused(path: str, head: bytes) -> str | None:
    if is_encrypted(head) and not path.lower().endswith(".xls"):
        return "PASSWORD_REQUIRED"
    return "UNSUPPORTED_FORMAT" if path.lower().rsplit(".", 1)[-1] in ("xls", "xlsb") else None


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of each sheet, in order."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), links[s.get(f"{{{OFFICE}}}id")]) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]
    return [(n, m if m.startswith("xl/") else f"xl/{m}") for n, m in found]


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ET.iterparse(f):
            if e.tag == f"{{{MAIN}}}si":
                out.append(unsaid("".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t"))))
                e.clear()
    return out


def sheet_rows(z: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[list[tuple]]:
    """(row, col, kind, v, formula) of the cells of each row, a row at a time."""
    tag = lambda n: f"{{{MAIN}}}{n}"
    with z.open(member) as f:
        for _, e in ET.iterparse(f):
            if e.tag != tag("row"):
                continue
            cells = []
            for c in e.iter(tag("c")):
                kind, v, formula = c.get("t", "n"), c.findtext(tag("v")), c.findtext(tag("f"))
                if kind == "s" and v is not None:
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = unsaid("".join(t.text or "" for t in c.iter(tag("t"))))
                elif kind == "str" and v is not None:
                    v = unsaid(v)
                if v is not None or formula is not None:
                    cells.append((*place(c.get("r")), "formula" if formula is not None else _KINDS.get(kind, "number"), v, formula))
            yield cells
            e.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.whole = options.get("files") == "whole"
        self.listing = options.get("sheets") == "list"
        self.names = schema.fieldNames()
        self.cells = self.names == [x.split()[0] for x in CELLS.split(", ")]

    def partitions(self) -> Sequence[InputPartition]:
        paths = listed(self.path, ENDINGS)
        if self.whole or self.listing or len(paths) > MOST_OPENED:
            return [SheetPart(p) for p in paths]
        return [part for p in paths for part in self._sheets(p)]

    def _open(self, path: str):
        return located(self.path)[0].open_input_file(path)

    def _sheets(self, path: str) -> list[SheetPart]:
        try:
            with self._open(path) as f:
                if code := refused(path, f.read(8)):
                    return [SheetPart(path, error=code)]
                f.seek(0)
                with zipfile.ZipFile(f) as z:
                    return [SheetPart(path, i, n, m) for i, (n, m) in enumerate(sheets(z))]
        except Exception as e:  # a file's fault is its own row
            return [SheetPart(path, error=f"READ_FAILED: {e}")]

    def read(self, partition: SheetPart) -> Iterator[pa.RecordBatch]:
        for part in [partition] if partition.member or partition.error else self._sheets(partition.path):
            if self.listing:
                yield self._batch([(part.path, part.index, part.sheet, part.error)])
            elif not self.cells:
                if part.error:
                    raise ValueError(f"{part.path}: {part.error}")
                yield from self._table(part)
            else:
                yield from self._cells(part)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(list(x), k.type) for x, k in zip(zip(*rows), kinds)], schema=kinds)

    def _cells(self, part: SheetPart) -> Iterator[pa.RecordBatch]:
        error = part.error
        if not error:
            held: list[tuple] = []
            try:
                with self._open(part.path) as f, zipfile.ZipFile(f) as z:
                    for cells in sheet_rows(z, part.member, shared_texts(z)):
                        held += [(part.path, part.index, part.sheet, *c, None) for c in cells]
                        if len(held) >= BATCH:
                            yield self._batch(held)
                            held = []
            except Exception as e:
                error = f"READ_FAILED: {e}"
            if held:
                yield self._batch(held)
        if error:
            yield self._batch([(part.path, part.index, part.sheet, *[None] * 5, error)])

    def _table(self, part: SheetPart) -> Iterator[pa.RecordBatch]:
        """The rows below the header row, by the header's names; a name without a column is null."""
        kinds = to_arrow_schema(self.schema)
        with self._open(part.path) as f, zipfile.ZipFile(f) as z:
            at: dict[int, int] | None = None
            held: list[dict[int, str]] = []
            for cells in sheet_rows(z, part.member, shared_texts(z)):
                row = {c: v for _, c, _, v, _ in cells}
                if at is None:
                    at = {c: self.names.index(v) for c, v in row.items() if v in self.names}
                    continue
                held.append({at[c]: v for c, v in row.items() if c in at})
                if len(held) >= BATCH:
                    yield typed(held, kinds)
                    held = []
            if held:
                yield typed(held, kinds)


def typed(rows: list[dict[int, str]], kinds: pa.Schema) -> pa.RecordBatch:
    """Texts as the columns' types."""
    out = []
    for k, f in enumerate(kinds):
        texts = pa.array([r.get(k) for r in rows], pa.string())
        if pa.types.is_timestamp(f.type) and f.type.tz:
            out.append(pc.assume_timezone(texts.cast(pa.timestamp("us")), "UTC").cast(f.type))
        elif pa.types.is_decimal(f.type):
            out.append(pa.array([None if x is None else decimal.Decimal(x) for x in texts.to_pylist()], f.type))
        else:
            out.append(texts.cast(f.type))
    return pa.RecordBatch.from_arrays(out, schema=kinds)


# --- writing -----------------------------------------------------------------------------------------------------


def cell(ref: str, v, formulas: bool = False) -> str:
    """A value as a sheet's XML."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | decimal.Decimal) or isinstance(v, float) and math.isfinite(v):
        return f'<c r="{ref}"><v>{v!r}</v></c>' if not isinstance(v, decimal.Decimal) else f'<c r="{ref}"><v>{v}</v></c>'
    if isinstance(v, datetime.datetime):
        v = (v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v).isoformat(" ")
    text = v if isinstance(v, str) else v.isoformat() if isinstance(v, datetime.date) else str(v)
    if formulas and text.startswith("="):
        return f'<c r="{ref}"><f>{said(text[1:])}</f></c>'
    if len(text) > CELL_CHARS:
        raise ValueError(f"a cell holds {CELL_CHARS} characters")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{said(text)}</t></is></c>'


class WorkbookFile:
    """A workbook that is written row by row to a stream; nothing but the row at hand is held."""

    def __init__(self, stream, title: str, header: list[str] | None, formulas: bool, most: int = SHEET_ROWS):
        self.z = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.title, self.header, self.formulas, self.most = title, header, formulas, most
        self.n, self.row, self.sheet = 0, 0, None

    def add(self, values: Sequence) -> None:
        if self.sheet is None or self.row >= self.most:
            self._end()
            self.n += 1
            self.sheet = self.z.open(f"xl/worksheets/sheet{self.n}.xml", "w", force_zip64=True)
            self.sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            self.row = 0
            if self.header:
                self._put(self.header)
        self._put(values)

    def _put(self, values: Sequence) -> None:
        self.row += 1
        cells = "".join(cell(f"{letters(c)}{self.row}", v, self.formulas) for c, v in enumerate(values, 1))
        self.sheet.write(f'<row r="{self.row}">{cells}</row>'.encode("utf-8", "surrogatepass"))

    def _end(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()

    def close(self) -> None:
        self._end()
        numbers = range(1, self.n + 1)
        links = [("workbook.xml", "officeDocument")], [(f"worksheets/sheet{i}.xml", "worksheet") for i in numbers]
        related = lambda own, start: f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{OFFICE}/{kind}" Target="{start}{to}"/>' for i, (to, kind) in enumerate(own, 1)) + "</Relationships>"
        kinds = [("workbook.xml", "sheet.main"), *[(to, "worksheet") for to, _ in links[1]]]
        names = [self.title if i == 1 else f"{self.title[:25]} {i}" for i in numbers]
        parts = {
            "xl/_rels/workbook.xml.rels": related(links[1], ""),
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + '</sheets><calcPr fullCalcOnLoad="1"/></workbook>',
            "_rels/.rels": related(links[0], "xl/"),
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(f'<Override PartName="/xl/{to}" ContentType="{PART}.{kind}+xml"/>' for to, kind in kinds) + "</Types>",
        }
        for name, text in parts.items():
            self.z.writestr(name, text)
        self.z.close()


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if len(schema) > SHEET_COLUMNS:
            raise ValueError(f"a sheet holds {SHEET_COLUMNS} columns")
        self.job = Job(options["path"], overwrite)
        self.names, self.title = schema.fieldNames(), options.get("sheet", "Sheet1")[:31]
        self.header = options.get("header", "true") == "true"
        self.formulas = options.get("formulas", "false") == "true"
        self.most = min(SHEET_ROWS, int(options.get("rows", SHEET_ROWS)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, book, stream = self.job.task_name(".xlsx"), None, None
        for batch in iterator:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if book is None:
                    stream = self.job.stream(name)
                    book = WorkbookFile(stream, self.title, self.names if self.header else None, self.formulas, self.most)
                book.add(row)
        if book is None:
            return Written()
        book.close()
        stream.close()
        return Written([(name, name)])

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.abort()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom-xlsx"

    def schema(self) -> str:
        return SHEETS if self.options.get("sheets") == "list" else CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes `docloom-xlsx` known to the session."""
    ship(spark)
    spark.dataSource.register(WorkbookSource)
