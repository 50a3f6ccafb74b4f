"""Readers, writers, formatters and alignment."""

import io
import struct
import zipfile

import numpy as np
import pytest

from docloom.functions import align, formats
from docloom.sources import media, office


def test_sample_rates():
    wav = media.wav([[0.0, -1.0, 1.0, 2.0]], 44_100)
    assert media.sample_rate(wav) == 44_100 and struct.unpack("<4h", wav[44:]) == (0, -32768, 32767, 32767)
    junk = b"RIFF" + bytes(4) + b"WAVE" + b"JUNK" + struct.pack("<I", 4) + bytes(4) + b"fmt " + struct.pack("<IHHI", 16, 1, 1, 96_000) + bytes(8)
    assert media.sample_rate(junk) == 96_000 and media.sample_rate(junk[:39]) is None
    assert media.sample_rate(bytes.fromhex("FFFB9400")) == 48_000
    assert media.sample_rate(b"ID3\4\0\0\0\0\0\5" + bytes(5) + bytes.fromhex("FFFB9000")) == 44_100


def test_text_and_types():
    assert media.decode_text("할수".encode("cp949")) == media.decode_text("할수".encode()) == "할수"
    with pytest.raises(UnicodeDecodeError):
        media.decode_text("할수".encode("cp949"), "utf-8")
    assert media.image_type(b"\x89PNG\r\n\x1a\n..") == "png" and media.image_type(b"x") is None
    log = "Duration: 00:01:02.50, start\n Stream #0:0: Video: h264, 1920x1080, 29.97 fps\n rotation of -90.00 degrees"
    assert media.probe_log(log) == {"duration": 62.5, "width": 1080, "height": 1920, "fps": 29.97}


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(office.workbook({"First": [[1, "x"], [None, True], ["=SUM(A1:A2)"]], "둘째": [["<&>"]]}))
    (tmp_path / "b.xlsx").write_bytes(media.ENCRYPTED + b"...")
    (tmp_path / "c.xls").write_bytes(b"old")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    rows = office.read_workbooks(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    cells = {(r["sheet"], r["row"], r["col"]): (r["kind"], r["v"], r["formula"]) for r in rows if not r["error"]}
    assert cells == {("First", 1, 1): ("number", "1", None), ("First", 1, 2): ("string", "x", None), ("First", 2, 2): ("boolean", "1", None), ("First", 3, 1): ("formula", None, "SUM(A1:A2)"), ("둘째", 1, 1): ("string", "<&>", None)}
    errors = {r["path"][-6:]: r["error"].split(":")[0] for r in rows if r["error"]}
    assert errors == {"b.xlsx": "PASSWORD_REQUIRED", "/c.xls": "UNSUPPORTED_FORMAT", "d.xlsx": "READ_FAILED"}


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>")
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    rows = office.read_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r["section"], r["pos"], r["text"], r["table_ix"]) for r in rows] == [("body", 0, "one", None), ("body", 1, "cell", 0), ("headerFooter", 0, "top", None)]


def test_formats():
    assert formats.sql_minify("SELECT a -- explanation\nFROM records") == "SELECT a /* explanation */ FROM records"
    assert formats.sql_minify("SELECT  'a  ''b' ,  f ( x )\n FROM t . u") == "SELECT 'a  ''b', f(x ) FROM t .u"
    assert formats.sql_pretty("select a from t where b = 'from x'") == "SELECT a\nFROM t\nWHERE b = 'from x'"
    assert formats.json_text('{"b": 9007199254740993, "a": [1]}', None) == '{"b":9007199254740993,"a":[1]}'
    xml = '<shelf id="07"><size>012</size><mark>0b1</mark><note><![CDATA[ 1 < 2 ]]></note><said>one <i>two</i> three</said></shelf>'
    assert formats.xml_text(xml, None) == xml
    assert '<size>012</size>\n  <mark>0b1</mark>' in formats.xml_text(xml, 2) and "<said>one <i>two</i> three</said>" in formats.xml_text(xml, 2)
    with pytest.raises(formats.XmlError, match="line 1"):
        formats.xml_text("<a><b></a>", 2)


def test_alignment():
    for method in ("ratio", "ngram"):
        for a, b in (("the quick brown fox", "the quick red fox jumps"), ("", "x"), ("same", "same"), ("a b", "")):
            parts = align.diff_tokens(a, b, method)
            assert "".join(t for k, t in parts if k != "added") == a and "".join(t for k, t in parts if k != "deleted") == b
        assert align.align(["alpha beta", "gone entirely"], ["alpha beta!", "zzz"], method)[0] == (0, 0)
        pairs = align.align([], ["x", "y"], method)
        assert pairs == [(None, 0), (None, 1)]
    assert align.align(["abcdefgh"], ["zzzzzzzzz"], "ratio") == [(0, None), (None, 0)]
    whole = "The river rose for three days. On the fourth the bridge was gone."
    one, two = "The river rose for three days. Nobody slept.", "On the fourth the bridge was gone."
    assert [k for k, *_ in align.compare([whole], [one, two])] == ["changed"]
    assert [k for k, *_ in align.compare(["a", "b", "c"], ["a", "x long other", "c"])] == ["unchanged", "deleted", "added", "unchanged"]


def test_long_sequences_are_exact():
    """Beyond what a table in memory holds: a path of most gain, and a longest common subsequence."""
    rng = np.random.default_rng(2)
    gain = rng.normal(size=(70, 55))
    total = np.zeros((71, 56))
    total[0], total[:, 0] = -0.5 * np.arange(56), -0.5 * np.arange(71)
    for i in range(70):
        for j in range(55):
            total[i + 1, j + 1] = max(total[i, j] + gain[i, j], total[i, j + 1] - 0.5, total[i + 1, j] - 0.5)
    path = align.best_path(lambda i: gain[i], 70, 55, 0.5)
    assert sum(-0.5 if None in x else gain[x] for x in path) == pytest.approx(total[-1, -1])
    a = [f"t{i}" for i in rng.integers(0, 400, 1500)]
    b = [x if rng.random() < 0.8 else "new" for x in a if rng.random() < 0.9]
    parts = align.diff_tokens(" ".join(a), " ".join(b), "ngram")
    assert (2 * len(a)) * (2 * len(b)) > align.MOST_DIFF_CELLS
    assert "".join(t for k, t in parts if k != "added") == " ".join(a) and "".join(t for k, t in parts if k != "deleted") == " ".join(b)
    row = np.zeros(len(b) + 1, int)
    for t in a:
        row = np.maximum.accumulate(np.maximum(row, np.concatenate(([0], np.where(np.array(b) == t, row[:-1] + 1, 0)))))
    assert sum(len(t.split()) for k, t in parts if k == "equal") >= row[-1]
    assert align.diff_tokens(" ".join(a), " ".join(b), "ngram", align.MOST_DIFF_CELLS) == [("deleted", " ".join(a)), ("added", " ".join(b))]
