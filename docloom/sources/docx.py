"""Word documents as a Spark data source, `docloom-docx`.

    spark.read.format("docloom-docx").load(path)    # a row for each paragraph; see `PARAGRAPHS`
    write_documents(df, path)                       # df: document, page, title, lines
    write_revisions(df, path)                       # df: document, step, side, place, kind, text

Reading takes a partition for each part of a document that holds text (body, headers, footers, notes,
comments), or for several small ones; small documents are opened by the tasks that read them. Revisions are read as accepted, or as rejected with option `revisions` = `rejected`; a paragraph whose mark
is gone goes on in the next one of its cell, note or part. Writing makes a document for each name: a titled section for
each page, which begins on a new page, and a paragraph for each line; or pieces of text that are kept, deleted or added, as
tracked changes (options `revisions` = `tracked`, `author`, `date`), a line feed being a paragraph's mark. Characters
that XML cannot hold are left out.
"""

from __future__ import annotations

import functools
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.session import ship
from docloom.sources.media import is_encrypted
from docloom.sources.storage import Job, Written, located, sizes

#: The format's name spaces and the parts that hold text.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
PARTS = (("body", r"word/document\.xml"), ("headerFooter", r"word/(?:header|footer)\d*\.xml"), ("note", r"word/(?:foot|end)notes\.xml"), ("comment", r"word/comments\.xml"))
PARAGRAPHS = "path string, section string, part string, pos int, text string, list_level int, table_ix int, row_ix int, col_ix int, author string, error string"
#: What stands in a paragraph for a tab and a line break.
MARKS = {f"{{{W}}}tab": "\t", f"{{{W}}}br": "\n", f"{{{W}}}cr": "\n"}
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
BATCH = 5_000
#: Bytes of XML that one task reads, if it reads several parts, and what a part counts at least.
TASK, OPEN = 4 << 20, 128 << 10
#: Bytes of a file that a task opens to find its parts, and how much XML a file is taken to hold for each of its bytes.
SMALL, INFLATED = 64 << 10, 8
#: The elements of revisions.
REVISIONS = {"deleted": "del", "added": "ins"}


@dataclass
class TextPart:
    """A part of a document; without member or error, a document whose parts are still to be found."""

    path: str
    section: str | None = None
    member: str | None = None
    error: str | None = None
    size: int = 0


@dataclass
class TextParts(InputPartition):
    parts: list[TextPart]


def bundled(parts: Sequence[TextPart], most: int) -> list[TextParts]:
    """Parts in order, as many to a task as have `most` bytes together (each counts as `OPEN` at least)."""
    out, full = [], 0
    for p in parts:
        own = max(OPEN, p.size)
        if not out or full + own > most:
            out.append(TextParts([]))
            full = 0
        out[-1].parts.append(p)
        full += own
    return out


def text_parts(names: Sequence[str]) -> list[tuple[str, str]]:
    """(section, member) of the parts that hold text, body first."""
    return [(section, n) for section, pattern in PARTS for n in sorted(names) if re.fullmatch(pattern, n)]


#: Elements of what is gone once revisions are accepted or rejected, and those that a paragraph cannot leave.
GONE = {"accepted": ("del", "moveFrom"), "rejected": ("ins", "moveTo")}
ROOMS = ("tc", "footnote", "endnote", "comment", "body", "hdr", "ftr")


@functools.cache
def _tag(name: str) -> str:
    return f"{{{W}}}{name}"


def paragraphs(stream, view: str = "accepted") -> Iterator[tuple]:
    """(pos, text, list_level, table_ix, row_ix, col_ix, author) of a part's paragraphs, while it is being parsed.

    What a revision has deleted or moved away (rejected: added or moved here) is not text; separators between notes are not notes.
    """
    tag = _tag
    level_of, marks = f"{tag('pPr')}/{tag('numPr')}/{tag('ilvl')}", [f"{tag('pPr')}/{tag('rPr')}/{tag(n)}" for n in GONE[view]]
    gone, rooms = {tag(n) for n in GONE[view]}, {tag(n) for n in ROOMS}
    texts = {tag("t"), tag("delText")}
    tables, inside, hidden, author, pos = -1, [], 0, None, 0
    begun: tuple | None = None  # the paragraph whose mark is gone, so far
    for event, e in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            if e.tag in gone or e.tag in (tag("footnote"), tag("endnote")) and int(e.get(tag("id"), "0")) < 0:
                hidden += 1
            elif e.tag == tag("comment"):
                author = e.get(tag("author"))
            elif e.tag == tag("tbl"):
                tables += 1
                inside.append([tables, -1, -1])
            elif e.tag == tag("tr") and inside:
                inside[-1][1:] = inside[-1][1] + 1, -1
            elif e.tag == tag("tc") and inside:
                inside[-1][2] += 1
            continue
        if e.tag in rooms and begun:  # no paragraph follows
            if begun[0]:
                yield pos, *begun
                pos += 1
            begun = None
        if e.tag in gone or e.tag in (tag("footnote"), tag("endnote")) and int(e.get(tag("id"), "0")) < 0:
            hidden -= 1
            e.clear()
        elif e.tag == tag("comment"):
            author = None
        elif e.tag == tag("tbl"):
            inside.pop()
            e.clear()
        elif e.tag == tag("p") and not hidden:
            level = e.find(level_of)
            text = "".join(MARKS.get(x.tag) or (x.text or "" if x.tag in texts else "") for x in e.iter())
            here = (None if level is None else int(level.get(tag("val"))), *(inside[-1] if inside else (None, None, None)), author)
            whole = (begun[0] + text, *(begun[1:] if begun[0] else here)) if begun else (text, *here)
            begun = None
            if any(e.find(m) is not None for m in marks):
                begun = whole
            else:
                yield pos, *whole
                pos += 1
            e.clear()


class DocumentReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.kinds, self.view = options["path"], to_arrow_schema(schema), options.get("revisions", "accepted")
        if self.view not in GONE:
            raise ValueError(f"revisions are read as {' or '.join(GONE)}, not {self.view}")

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for p, size in sizes(self.path, (".docx", ".docm", ".doc")):
            out += [TextPart(p, size=size * INFLATED)] if size <= SMALL else self._parts(p)
        return bundled(out, TASK)

    def _parts(self, p: str) -> list[TextPart]:
        try:
            with located(self.path)[0].open_input_file(p) as f:
                head = f.read(8)
                if is_encrypted(head) or p.lower().endswith(".doc"):
                    return [TextPart(p, error="UNSUPPORTED_FORMAT" if p.lower().endswith(".doc") else "PASSWORD_REQUIRED")]
                f.seek(0)
                with zipfile.ZipFile(f) as z:
                    return [TextPart(p, s, m, size=z.getinfo(m).file_size) for s, m in text_parts(z.namelist())]
        except Exception as e:  # a file's fault is its own row
            return [TextPart(p, error=f"READ_FAILED: {e}")]

    def read(self, partition: TextParts) -> Iterator[pa.RecordBatch]:
        held = []
        for whole in partition.parts:
            for p in [whole] if whole.member or whole.error else self._parts(whole.path):
                for row in self._rows(p):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    def _rows(self, p: TextPart) -> Iterator[tuple]:
        error = p.error
        if not error:
            try:
                with located(self.path)[0].open_input_file(p.path) as f, zipfile.ZipFile(f) as z, z.open(p.member) as part:
                    for row in paragraphs(part, self.view):
                        yield p.path, p.section, p.member, *row, None
            except Exception as e:
                error = f"READ_FAILED: {e}"
        if error:
            yield p.path, p.section, p.member, *[None] * 7, error

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), k.type) for x, k in zip(zip(*rows), self.kinds)], schema=self.kinds)


class DocumentFile:
    """A word document that is written page by page, or piece by piece, to a stream."""

    def __init__(self, stream, author: str = "", date: str = ""):
        self.by = f" w:author={quoteattr(author)}" + (f" w:date={quoteattr(date)}" if date else "")
        self.runs, self.revision = [], 0
        self.z = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self._part("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships">', f'<Relationship Id="body" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>')
        self._part("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types">', '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>', f'<Override PartName="/word/document.xml" ContentType="{KIND}"/></Types>')
        self.body = self.z.open("word/document.xml", "w", force_zip64=True)
        self.body.write(f'<w:document xmlns:w="{W}"><w:body>'.encode())
        self.pages = 0

    def _part(self, name: str, *text: str) -> None:
        self.z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "".join(text))

    def page(self, title: str, lines: Sequence[str]) -> None:
        """A page: its title, in the outline and large, then its lines."""
        above = '<w:pageBreakBefore/>' if self.pages else ""
        self._paragraph(title, f'<w:keepNext/>{above}<w:spacing w:after="200"/><w:outlineLvl w:val="0"/>', '<w:sz w:val="36"/>')
        for line in lines:
            self._paragraph(line)
        self.pages += 1

    def _paragraph(self, text: str, own: str = "", run: str = "") -> None:
        run = f"<w:rPr>{run}</w:rPr>" if run else ""
        own = f"<w:pPr>{own}</w:pPr>" if own else ""
        self.body.write(f'<w:p>{own}<w:r>{run}<w:t xml:space="preserve">{escape(_NOT_XML.sub("", text or ""), {chr(13): "&#13;"})}</w:t></w:r></w:p>'.encode())

    def piece(self, kind: str, text: str) -> None:
        """What is kept, deleted or added next; a line feed ends a paragraph, and its mark is of that kind."""
        first, *more = (text or "").split("\n")
        self._run(kind, first)
        for line in more:
            self._end(kind)
            self._run(kind, line)

    def _run(self, kind: str, text: str) -> None:
        if text and self.runs and self.runs[-1][0] == kind:
            self.runs[-1][1].append(text)
        elif text:
            self.runs.append((kind, [text]))

    def _revised(self, kind: str) -> str:
        self.revision += 1
        return f'w:{REVISIONS[kind]} w:id="{self.revision}"{self.by}'

    def _end(self, kind: str) -> None:
        mark = f"<w:pPr><w:rPr><{self._revised(kind)}/></w:rPr></w:pPr>" if kind in REVISIONS else ""
        out = [f"<w:p>{mark}"]
        for own, texts in self.runs:
            name = "delText" if own == "deleted" else "t"
            run = f'<w:r><w:{name} xml:space="preserve">{escape(_NOT_XML.sub("", "".join(texts)), {chr(13): "&#13;"})}</w:{name}></w:r>'
            out.append(f"<{self._revised(own)}>{run}</w:{REVISIONS[own]}>" if own in REVISIONS else run)
        self.body.write("".join([*out, "</w:p>"]).encode())
        self.runs = []

    def close(self) -> None:
        if self.runs:
            self._end("equal")
        self.body.write(b"</w:body></w:document>")
        self.body.close()
        self.z.close()


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.job, self.tracked = Job(options["path"], overwrite), options.get("revisions") == "tracked"
        self.author, self.date = options.get("author", ""), options.get("date", "")
        self.columns = ("document", "kind", "text") if self.tracked else ("document", "title", "lines")
        if missing := set(self.columns) - set(schema.fieldNames()):
            raise ValueError(f"no columns {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, now, book, stream = Written(), None, None, None
        for batch in iterator:
            for document, first, second in zip(*[batch.column(n).to_pylist() for n in self.columns]):
                if book is None or document != now:
                    if book:
                        book.close()
                        stream.close()
                    now, made = document, self.job.task_name(".docx")
                    stream = self.job.stream(made)
                    book = DocumentFile(stream, self.author, self.date)
                    out.names.append((made, f"{re.sub(r'[^\w.-]', '_', str(document))}.docx"))
                if self.tracked:
                    book.piece(first, second)
                else:
                    book.page(first or "", second or [])
        if book:
            book.close()
            stream.close()
        return out

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.abort()


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom-docx"

    def schema(self) -> str:
        return PARAGRAPHS

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(DocumentSource)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df(document, page, title, lines): a document for each name, its pages in order, made by one task."""
    register(df.sparkSession)
    df.repartition("document").sortWithinPartitions("document", "page").write.format("docloom-docx").mode(mode).save(path)


def write_revisions(df: DataFrame, path: str, author: str = "", date: str = "", mode: str = "overwrite") -> None:
    """df(document, step, side, place, kind, text), as `operators.revisions.tracked` makes it: a document of tracked changes for each name."""
    register(df.sparkSession)
    rows = df.repartition("document").sortWithinPartitions("document", "step", "side", "place").select("document", "kind", "text")
    rows.write.format("docloom-docx").options(revisions="tracked", author=author, date=date).mode(mode).save(path)
