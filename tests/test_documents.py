"""Documents, tables, comments, page layout, list labels, CSV texts: values that must come out."""

import difflib
import random
import zipfile
from io import BytesIO

import pytest

from docloom.functions import align
from docloom.functions import documents as C
from docloom.operators import document_queries as Q
from docloom.operators import page_queries as P
from docloom.operators import sheet_queries as S


def test_table_with_a_new_row_and_column():
    before = [["h1", "h2", "h3"], ["a1", "a2", "a3"], ["b1", "b2", "b3"], ["c1", "c2", "c3"]]
    after = [["h1", "h2", "new", "h3"], ["a1", "a2", "x", "a3"], ["n1", "n2", "n3", "n4"], ["b1", "b2", "x", "B3"], ["c1", "c2", "x", "c3"]]
    got = C.compare_tables(before, after)
    kinds = [k for k, *_ in got]
    assert {k: kinds.count(k) for k in set(kinds)} == {"unchanged": 11, "changed": 1, "added": 8}
    assert ("changed", 2, 2, 3, 3, "b3", "B3") in got
    assert C.compare_tables([], [["x"]]) == [("added", None, None, 0, 0, None, "x")] and C.compare_tables([["x"], ["y", "z"]], []) == [("deleted", 0, 0, None, None, "x", None), ("deleted", 1, 0, None, None, "y", None), ("deleted", 1, 1, None, None, "z", None)]


def test_tables_pair_by_first_row():
    t = lambda *first: [list(first), ["v"] * len(first)]
    assert C.pair_tables([t("a"), t("b", "c"), t("d")], [t("b", "c"), t("e"), t("f")]) == [(0, None), (1, 0), (2, 1), (None, 2)]


def test_comments():
    before = [("1", "ann", "see the budget"), ("2", "bob", "typo here"), ("3", "", "gone for good")]
    after = [("9", "bob", "typo here!"), ("1", "eve", "another text"), ("8", "x", "unlike all")]
    assert C.match_comments(before, after) == [(0, 1), (1, 0), (2, None), (None, 2)]
    assert C.match_comments([("", "", "same")], [("", "", "same"), ("", "", "same")]) == [(0, 1), (None, 0)]


def test_documents(spark):
    table = [["h1", "h2"], ["a", "b"]]
    wider = [["h1", "h2", "h3"], ["a", "b", "c"]]
    whole = "이 문단은 두 개로 나뉘는 긴 문단입니다. 여기부터 둘째 문단이 시작됩니다."
    one, two = "이 문단은 두 개로 나뉘는 긴 문단입니다. 추가된 문장.", "여기부터 둘째 문단이 시작됩니다."
    before = [(1, 0, "first", None), (1, 1, None, table), (1, 2, whole, None), (2, 0, "only before", None), (4, 0, None, [])]
    after = [(1, 0, "first", None), (1, 1, None, wider), (1, 2, one, None), (1, 3, two, None), (3, 0, "only after", None)]
    schema = "id int, " + Q.BLOCKS
    got = Q.document_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "id").orderBy("id", "seq").collect()
    assert [(r["id"], r["section"], r["kind"]) for r in got] == [(1, "body", "unchanged"), *[(1, "table", "unchanged")] * 4, *[(1, "table", "added")] * 2, (1, "body", "changed"), (2, "body", "deleted"), (3, "body", "added")]
    assert got[7]["after"] == f"{one}\n{two}"
    changes = spark.createDataFrame([("body", "p1", "x", "y", "changed"), ("table", "t1", "x", None, "deleted"), ("body", "p2", "z", "z", "unchanged")], "section string, location string, before string, after string, kind string")
    data = Q.report_workbook(changes, "a.docx", "b.docx")
    with zipfile.ZipFile(BytesIO(data)) as z:
        first, second = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    assert "a.docx" in first and "p1" in second and "t1" not in second and "p2" not in second


def test_page_layout(spark):
    """Three lines of a page of 400 x 600, and one of the next; cells part at wide gaps, columns are shared by lines."""
    items = [(1, "Title", 48.0, 520.0, 60.0, 18.0), (1, "world", 90.0, 480.5, 30.0, 12.0), (1, "Hello", 48.0, 480.0, 36.0, 12.0), (1, "far", 300.0, 479.0, 20.0, 12.0), (1, " ", 0.0, 470.0, 9.0, 9.0), (1, "third", 50.0, 458.0, 30.0, 12.0), (1, "too", 304.0, 458.0, 30.0, 12.0), (2, "next", 48.0, 300.0, 30.0, 12.0)]
    got = P.laid_out(spark.createDataFrame(items, "page int, text string, x double, y double, width double, height double"), "page").orderBy("page", "line").collect()
    assert [(r["page"], r["text"], r["row"]) for r in got] == [(1, "Title", ["Title", ""]), (1, "Hello world far", ["Hello world", "far"]), (1, "third too", ["third", "too"]), (2, "next", ["next"])]
    assert P.columns([10, 28, 46, 47, 80]) == [19.0, 46.5, 80.0]
    words = spark.createDataFrame([(1, 0, "a", 0.0, 10.0), (1, 0, "b", 15.0, 20.0), (1, 0, "c", 60.0, 70.0)], "page int, line int, text string, x0 double, x1 double")
    assert [tuple(r) for r in P.recognised_lines(words, ["page", "line"]).collect()] == [(1, 0, "a b c", ["a b", "c"])]


def test_csv_texts(spark):
    assert S.csv_table("name,value\nvalid,1") == (["name", "value"], [["valid", "1"]], 0)
    assert S.csv_table(" a ,,b\n\n ,\t\n1,2\n1,2,3,4\n") == (["a", "Column 2", "b"], [["1", "2", ""], ["1", "2", "3"]], 2) and S.csv_table("") == ([], [], 0)
    bad = spark.createDataFrame([(1, 'name,value\nvalid,1\n"unterminated,2'), (2, 'a,b\n"x"y,2'), (3, None)], "k int, t string")
    got = S.read_csv_texts(bad, "k", "t").collect()
    assert [(r["k"], r["v"], bool(r["error"])) for r in got] == [(1, None, True), (2, None, True)]


def test_archive_names(spark):
    files = ["a.csv", "A.csv", "a.csv", "a-2.csv", "a.csv", ".env", ".env", "noext", "noext"]
    d = spark.createDataFrame([(1, i, f) for i, f in enumerate(files)], "bundle int, ord int, file string")
    assert [r["name"] for r in S.archive_names(d, "bundle", "ord", "file").orderBy("ord").collect()] == ["a.csv", "A.csv", "a-2.csv", "a-2-2.csv", "a-3.csv", ".env", ".env-2", "noext", "noext-2"]


@pytest.mark.parametrize("skip,rows,cols,want", [(0, 10, 10, (1, 1, 3, 3)), (1, 10, 10, None), (0, 2, 2, (1, 1, 2, 2)), (0, 0, 5, None)])
def test_shifted_ranges(spark, skip, rows, cols, want):
    from pyspark.sql import functions as F

    out = S.shifted_ranges(*(F.lit(x) for x in (skip, rows, cols, 0, 0)))
    r = spark.createDataFrame([(0, 0, 2, 2)], "r0 int, c0 int, r1 int, c1 int").select(*[c.alias(n) for n, c in out.items()]).first()
    assert (tuple(r)[1:] if r["kept"] else None) == want


def test_ratio_is_difflibs():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc d") for _ in range(r.randint(0, 25))) for _ in range(2))
        b = b if r.random() < 0.6 else "".join(x for x in a if r.random() < 0.8)
        assert align.sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_comments_with_a_partner_of_their_id_are_not_compared(monkeypatch):
    looked = []
    monkeypatch.setattr(align, "sequence_ratio", lambda a, b: looked.append((a, b)) or 0.9, raising=False)
    before = [(str(i), "x", f"text {i}") for i in range(30)]
    after = [(str(i) if i else "", "x", f"other {i}") for i in range(30)]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert C.match_comments(before, after)[1] == (1, 1) and len(looked) == 31


def test_texts_are_folded_once_not_for_every_pair(monkeypatch):
    looked, plain = [], align.folded
    monkeypatch.setattr(align, "folded", lambda t: looked.append(t) or plain(t))
    before, after = [f"line {i} of  Text" for i in range(20)], [f"Line {i} of text!" for i in range(20)]
    assert align.align(before, after) == [(i, i) for i in range(20)] and len(looked) == 40
