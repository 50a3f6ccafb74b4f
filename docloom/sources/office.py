"""Workbooks (XLSX, XLSM) as cell tables and word documents (DOCX) as paragraph records.

Readers take `binaryFile` rows. A file that cannot be read gives one row with its error and never fails the
job; binary and encrypted workbooks are recognised and refused.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.session import ship
from docloom.sources import docx, xlsx
from docloom.sources.media import is_encrypted

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "path string, sheet_ix int, sheet string, row int, col int, kind string, v string, formula string, error string"
PARAGRAPHS = "path string, section string, pos int, text string, list_level int, table_ix int, row_ix int, col_ix int, error string"
MAX_ROWS = 1_048_576


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n - 1, 26)
        out = chr(65 + d) + out
    return out


def workbook_cells(data: bytes) -> Iterator[tuple]:
    """(sheet_ix, sheet, row, col, kind, v, formula) of every cell with a value or formula."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = xlsx.shared_texts(z)
        for ix, (name, member) in enumerate(xlsx.sheets(z)):
            for cells in xlsx.sheet_rows(z, member, shared):
                yield from ((ix, name, *c) for c in cells)


def document_paragraphs(data: bytes) -> Iterator[tuple]:
    """(section, pos, text, list_level, table_ix, row_ix, col_ix): body, then headers, footers, notes and comments."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for section, member in docx.text_parts(z.namelist()):
            with z.open(member) as part:
                yield from ((section, *row[:6]) for row in docx.paragraphs(part))


def _read(files: DataFrame, f, schema: str) -> DataFrame:
    ship(files.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = [pa.int32() if x.strip().endswith(" int") else pa.string() for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    if is_encrypted(data):
                        raise ValueError("PASSWORD_REQUIRED")
                    if path.lower().rsplit(".", 1)[-1] in ("xls", "xlsb", "doc", "hwp"):
                        raise ValueError("UNSUPPORTED_FORMAT")
                    rows = [(path, *x, None) for x in f(data)]
                except Exception as e:  # a file's fault is its own row
                    code = str(e) if str(e) in ("PASSWORD_REQUIRED", "UNSUPPORTED_FORMAT") else f"READ_FAILED: {e}"
                    rows = [(path, *[None] * (len(names) - 2), code)]
                for a in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows[a : a + 20_000]), kinds)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def read_workbooks(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> cells."""
    return _read(files, workbook_cells, CELLS)


def read_documents(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> paragraphs."""
    return _read(files, document_paragraphs, PARAGRAPHS)


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An XLSX file from rows of values; text starting with "=" is a formula. For results of bounded size."""
    out = io.BytesIO()
    main, rel = _S[1:-1], _R[1:-1]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets><calcPr fullCalcOnLoad="1"/></workbook>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            if len(rows) > MAX_ROWS:
                raise ValueError("a sheet holds 1,048,576 rows")
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f'<c r="{ref}"><v>{v}</v></c>'
    if v.startswith("="):
        return f'<c r="{ref}"><f>{escape(v[1:])}</f></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
