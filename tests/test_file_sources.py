"""Workbooks, word documents and audio as Spark data sources."""

import datetime
import json
import zipfile
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.sources import docx, storage, wav, xlsx
from docloom.sources.office import workbook

WHEN = datetime.datetime(2024, 2, 29, 1, 2, 3, 456789)
KINDS = "a long, b string, c double, d boolean, e date, f timestamp_ntz, g decimal(20,4), h timestamp"
ROWS = [
    (2**62, " a <&> \"b\"\r\n\x07_x0007_ =1+1 ", 0.1, True, WHEN.date(), WHEN, Decimal("12345678901234.5678"), WHEN),
    (None, None, None, None, None, None, None, None), (-1, "", float("nan"), False, None, None, Decimal("-0.0001"), None), (0, "=SUM(A1)", float("-inf"), None, None, None, None, None), (7, "한글 😀", 1e300, None, None, None, None, None),
]


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    for source in (xlsx, docx, wav):
        source.register(spark)


def rows(df):
    return sorted(map(str, df.collect()))


def test_workbook_round_trip(spark, tmp_path):
    d = spark.createDataFrame(ROWS, KINDS).repartition(3)
    path = str(tmp_path / "t")
    d.write.format("docloom-xlsx").mode("overwrite").save(path)
    back = spark.read.format("docloom-xlsx").schema(KINDS).load(path)
    assert rows(back) == rows(d)
    d.write.format("docloom-xlsx").mode("append").save(path)
    assert spark.read.format("docloom-xlsx").schema(KINDS).load(path).count() == 10
    d.limit(1).write.format("docloom-xlsx").mode("overwrite").save(path)
    assert spark.read.format("docloom-xlsx").schema(KINDS).load(path).count() == 1
    assert len(list(Path(path).glob("*.xlsx"))) == 1 and not list(Path(path).glob("_temp*"))
    less = spark.read.format("docloom-xlsx").schema("d boolean, nothing string, a long").load(f"{path}/*.xlsx")
    assert less.columns == ["d", "nothing", "a"] and less.where("nothing IS NULL").count() == 1


def test_sheets_are_rolled_and_read_each_by_a_task(spark, tmp_path):
    d = spark.range(25).select("id", F.concat(F.lit("v"), "id").alias("v")).coalesce(1)
    d.write.format("docloom-xlsx").options(rows="11", sheet="Tall & wide").mode("overwrite").save(str(tmp_path / "t"))
    listed = spark.read.format("docloom-xlsx").option("sheets", "list").load(str(tmp_path / "t"))
    assert [(r["sheet_ix"], r["sheet"]) for r in listed.collect()] == [(0, "Tall & wide"), (1, "Tall & wide 2"), (2, "Tall & wide 3")]
    back = spark.read.format("docloom-xlsx").schema("id long, v string").load(str(tmp_path / "t"))
    assert rows(back) == rows(d) and back.rdd.getNumPartitions() == 3
    whole = spark.read.format("docloom-xlsx").schema("id long, v string").option("files", "whole").load(str(tmp_path / "t"))
    assert rows(whole) == rows(d) and whole.rdd.getNumPartitions() == 1


def test_faulty_workbooks_are_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"One": [[1, "x"], ["=A1"]], "Two": []}))
    (tmp_path / "b.xlsx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"..")
    (tmp_path / "c.xls").write_bytes(b"old")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z, zipfile.ZipFile(tmp_path / "a.xlsx") as a:
        for n in a.namelist():
            z.writestr(n, a.read(n)[:150] if "sheet1" in n else a.read(n))
    found = spark.read.format("docloom-xlsx").load(str(tmp_path)).collect()
    assert {(r["sheet"], r["row"], r["col"], r["kind"], r["v"], r["formula"]) for r in found if r["path"].endswith("a.xlsx")} == {("One", 1, 1, "number", "1", None), ("One", 1, 2, "string", "x", None), ("One", 2, 1, "formula", None, "A1")}
    assert {(r["path"][-6:], r["error"].split(":")[0]) for r in found if r["error"]} == {("b.xlsx", "PASSWORD_REQUIRED"), ("/c.xls", "UNSUPPORTED_FORMAT"), ("d.xlsx", "READ_FAILED"), ("e.xlsx", "READ_FAILED")}
    with pytest.raises(Exception, match="READ_FAILED"):
        spark.read.format("docloom-xlsx").schema("x string").load(str(tmp_path / "d.xlsx")).collect()


def test_a_lost_task_leaves_nothing_that_is_read(spark, tmp_path):
    path = tmp_path / "t"
    d = spark.range(100).repartition(4)
    d.write.format("docloom-xlsx").mode("overwrite").save(str(path))

    def failing(batches):
        for i, b in enumerate(batches):
            yield b
            if i == 0 and b.num_rows and b.column(0)[0].as_py() % 2 == 0:
                raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        d.mapInArrow(failing, "id long").write.format("docloom-xlsx").mode("append").save(str(path))
    (path / "part-99999-lost.xlsx").write_bytes(b"half a file")
    (path / "_temporary-x").mkdir()
    (path / "_temporary-x" / "part-00000-other.xlsx").write_bytes(b"half a file")
    back = spark.read.format("docloom-xlsx").schema("id long").load(str(path))
    assert sorted(r[0] for r in back.collect()) == list(range(100))
    assert len(json.loads((path / storage.MANIFEST).read_text())) == len(list(path.glob("part-0000*.xlsx")))


def test_two_attempts_of_a_task_count_once(tmp_path):
    """Only what the driver is told of is moved."""
    job = storage.Job(str(tmp_path / "t"), False)
    names = [job.task_name(".x") for _ in range(2)]
    for n in names:
        with job.stream(n) as f:
            f.write(b"1")
    job.commit([storage.Written([(names[1], "a.x")]), None])
    assert storage.listed(str(tmp_path / "t"), (".x",)) == [f"{tmp_path}/t/a.x"]


def test_documents(spark, tmp_path):
    d = spark.createDataFrame([("a b/c", 2, "Second", ["x", "", "y\x07 <&>\tz"]), ("a b/c", 1, "First", ["one\r", "é"]), ("d", 1, None, None)], "document string, page int, title string, lines array<string>")
    docx.write_documents(d, str(tmp_path / "t"))
    found = spark.read.format("docloom-docx").load(str(tmp_path / "t")).orderBy("path", "pos").collect()
    assert [(Path(r["path"]).name, r["section"], r["pos"], r["text"]) for r in found] == [("a_b_c.docx", "body", i, t) for i, t in enumerate(["First", "one\r", "é", "Second", "x", "", "y <&>\tz"])] + [("d.docx", "body", 0, "")]


def test_parts_of_a_document(spark, tmp_path):
    w = f'xmlns:w="{docx.W}"'
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = lambda *own: "<w:tr>" + "".join(f"<w:tc>{run(c)}</w:tc>" for c in own) + "</w:tr>"
    body = f"<w:document {w}><w:body><w:p><w:pPr><w:numPr><w:ilvl w:val=\"2\"/></w:numPr></w:pPr><w:r><w:t>kept</w:t><w:tab/></w:r><w:ins><w:r><w:t>new</w:t><w:br/></w:r></w:ins><w:del><w:r><w:t>old</w:t></w:r></w:del></w:p><w:tbl>{cells('p', 'q')}{cells('r')}</w:tbl><w:moveFrom>{run('away')}</w:moveFrom>{run('end')}</w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/footer2.xml", f"<w:ftr {w}>{run('foot')}</w:ftr>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="-1">{run("line")}</w:footnote><w:footnote w:id="3">{run("note")}</w:footnote></w:footnotes>')
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment w:id="0" w:author="Ann">{run("why?")}</w:comment></w:comments>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.doc").write_bytes(b"old")
    read = spark.read.format("docloom-docx").load(str(tmp_path))
    got = [(r["section"], r["pos"], r["text"], r["list_level"], r["table_ix"], r["row_ix"], r["col_ix"], r["author"]) for r in read.where("error IS NULL").orderBy("part", "pos").collect()]
    assert got == [("comment", 0, "why?", None, None, None, None, "Ann"), ("body", 0, "kept\tnew\n", 2, None, None, None, None), ("body", 1, "p", None, 0, 0, 0, None), ("body", 2, "q", None, 0, 0, 1, None), ("body", 3, "r", None, 0, 1, 0, None), ("body", 4, "end", None, None, None, None, None), ("headerFooter", 0, "foot", None, None, None, None, None), ("note", 0, "note", None, None, None, None, None)]
    assert {(r["path"][-6:], r["error"].split(":")[0]) for r in read.where("error IS NOT NULL").collect()} == {("b.docx", "READ_FAILED"), ("/c.doc", "UNSUPPORTED_FORMAT")}


def test_audio(spark, tmp_path):
    d = spark.createDataFrame([("b", 8000, 2, 1, [0.5, -0.5]), ("b", 8000, 2, 0, [1.0, -1.0, 2.0, -2.0]), ("a", 44100, 1, 0, [0.0, float("nan")]), ("none", 8000, 1, 0, [])], "name string, rate int, channels int, start long, samples array<double>")
    wav.write_wav(d, str(tmp_path / "t"))
    (tmp_path / "t" / "lost.wav").write_bytes(b"RIFF")
    read = spark.read.format("docloom-wav").option("frames", 2).load(str(tmp_path / "t"))
    pcm = {(Path(r["path"]).stem, r["rate"], r["channels"], r["start"]): [round(x * 32768) for x in r["samples"]] for r in read.collect()}
    assert pcm == {("b", 8000, 2, 0): [32767, -32768, 32767, -32768], ("b", 8000, 2, 2): [16383, -16384], ("a", 44100, 1, 0): [0, 0]}
    faulty = spark.read.format("docloom-wav").load(str(tmp_path / "t" / "lost.wav")).collect()
    assert faulty[0]["error"] and faulty[0]["samples"] is None


def test_short_audio_files_share_a_task_and_long_ones_are_split(spark, tmp_path, monkeypatch):
    d = spark.range(300).select(F.col("id").cast("string").alias("name"), F.lit(8_000).alias("rate"), F.lit(1).alias("channels"), F.lit(0).alias("start"), F.array_repeat((F.col("id") / 300).cast("double"), 5).alias("samples"))
    wav.write_wav(d, str(tmp_path / "t"))
    read = spark.read.format("docloom-wav").option("frames", 2).load(str(tmp_path / "t"))
    assert read.rdd.getNumPartitions() <= 3
    found = {(int(Path(r["path"]).stem), r["start"]): [round(x * 32768) for x in r["samples"]] for r in read.collect()}
    assert found == {(i, a): [int(i / 300 * 32767)] * n for i in range(300) for a, n in ((0, 2), (2, 2), (4, 1))}
    monkeypatch.setattr(wav, "TASK", 16)
    tasks = wav.WavReader({"path": str(tmp_path / "t"), "frames": "2"}).partitions()
    assert [(x.first, x.last) for t in tasks for x in t.frames[:300]][:1] == [(0, 5)] and len(tasks) == 300  # eight frames to a task


def test_a_commit_of_many_files_is_linear(tmp_path):
    job = storage.Job(str(tmp_path / "t"), True)
    looked = []

    class Name(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            looked.append(1)
            return str.__eq__(self, other)

    (tmp_path / "t" / f"_temporary-{job.id}").mkdir(parents=True)
    names = [(f"m{i}", Name(f"n{i}")) for i in range(300)]
    for made, _ in names:
        (tmp_path / "t" / f"_temporary-{job.id}" / made).touch()
    job.commit([storage.Written(names)])
    assert len(looked) < 3_000 and storage.listed(str(tmp_path / "t"), ("",))[:2] == [f"{tmp_path}/t/n0", f"{tmp_path}/t/n1"]
