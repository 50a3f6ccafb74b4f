"""Tracked changes: both versions come back, what is kept is a longest common part, and Word's elements are as they should be."""

import random
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from docloom.functions.lcs import common_lines
from docloom.operators import revisions as R
from docloom.operators.compare_files import CompareOptions, compare_folders
from docloom.sources import docx

#: key -> both versions, as lists of paragraphs.
CASES = {
    1: (["one two three"], ["one", "two three"]), 2: (["one", "two three"], ["one two three"]), 3: (["a", "b", "c"], ["a", "c"]), 4: (["a", "c"], ["a", "c", "d e"]),
    5: ([""], ["x", "", "y"]), 6: (["x", "", "y"], [""]), 7: (["same", "", "same"], ["same", "", "same"]), 8: (["a b", "k", "a b"], ["a  b!", "k", "b a"]), 9: (["x\ty <&> \"q\"", "한글 텍스트 😀"], ["x\ty <&> 'q'", "한글은 텍스트 😀😀"]),
    10: ([None, "gone"], ["", "come"]), 11: ([], ["only after"]), 12: (["only before", "two"], []),
}


def lines(spark, side, cases):
    return spark.createDataFrame([(k, i, x) for k, v in cases.items() for i, x in enumerate(v[side])], "key long, pos long, line string")


@pytest.fixture(scope="module")
def cases():
    r = random.Random(5)
    word = lambda: r.choice(["the", "a", "dog", "runs", "to", "be", "x9", "--"])
    text = lambda: [" ".join(word() for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 9))]
    return CASES | {100 + i: (text(), text()) for i in range(30)}


@pytest.fixture(scope="module")
def pieces(spark, cases):
    d = R.tracked(lines(spark, 0, cases), lines(spark, 1, cases))
    return d.cache()


def test_both_versions_come_back(pieces, cases):
    for side, accepted in ((0, False), (1, True)):
        found = {r["key"]: r["text"] for r in R.version(pieces, accepted).collect()}
        assert found == {k: "".join(f"{x or ''}\n" for x in v[side]) for k, v in cases.items() if v[side]}


def test_split_and_joined_paragraphs_are_marks(pieces):
    own = {k: [(r["kind"], r["text"]) for r in pieces.where(F.col("key") == k).orderBy(*R.ORDER).collect()] for k in (1, 2)}
    assert [x for x in own[1] if x[0] != "equal"] == [("deleted", " "), ("added", "\n")]
    assert [x for x in own[2] if x[0] != "equal"] == [("deleted", "\n"), ("added", " ")]


def test_whole_paragraphs_are_a_longest_common_part(pieces, cases):
    """What is kept, as paragraphs that neither side changed, is no less than unique anchors and exact gaps give."""
    kept = {r["key"]: r["n"] for r in pieces.where("kind = 'equal'").groupBy("key").agg(F.sum(F.endswith("text", F.lit("\n")).cast("long")).alias("n")).collect()}
    for k in (3, 4, 7):
        b, a = cases[k]
        assert kept[k] == len(common_lines(b, a))


def test_documents_of_tracked_changes(spark, pieces, cases, tmp_path):
    docx.write_revisions(pieces.withColumn("document", F.col("key").cast("string")), str(tmp_path / "t"), 'Ann "A" <b>', "2024-01-01T00:00:00Z")
    for side, view in ((0, "rejected"), (1, "accepted")):
        read = spark.read.format("docloom-docx").option("revisions", view).load(str(tmp_path / "t"))
        found: dict = {}
        for r in read.orderBy("path", "pos").collect():
            assert r["error"] is None
            found.setdefault(int(r["path"].rsplit("/", 1)[1][:-5]), []).append(r["text"])
        assert found == {k: [x or "" for x in v[side]] for k, v in cases.items() if v[side]}
    with zipfile.ZipFile(tmp_path / "t" / "100.docx") as z:
        body = ET.fromstring(z.read("word/document.xml"))
    made = [e for e in body.iter() if e.tag in (f"{{{docx.W}}}ins", f"{{{docx.W}}}del")]
    assert [e.get(f"{{{docx.W}}}id") for e in made] == sorted({e.get(f"{{{docx.W}}}id") for e in made}, key=int) and made
    assert {(e.get(f"{{{docx.W}}}author"), e.get(f"{{{docx.W}}}date")) for e in made} == {('Ann "A" <b>', "2024-01-01T00:00:00Z")}
    assert not [t for e in made if e.tag.endswith("}del") for t in e.iter(f"{{{docx.W}}}t")]
    with pytest.raises(Exception, match="accepted or rejected"):
        spark.read.format("docloom-docx").option("revisions", "none").load(str(tmp_path / "t")).collect()


def test_deleted_marks_join_within_their_cell(spark, tmp_path):
    w = f'xmlns:w="{docx.W}"'
    gone = '<w:pPr><w:rPr><w:del w:id="1"/></w:rPr></w:pPr>'
    run = lambda t, own="": f"<w:p>{own}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f"<w:document {w}><w:body><w:tbl><w:tr><w:tc>{run('p', gone)}{run('q')}</w:tc><w:tc>{run('r', gone)}</w:tc></w:tr></w:tbl>{run('s', gone)}{run('t')}{run('', gone)}</w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    read = lambda v: [(r["text"], r["col_ix"]) for r in spark.read.format("docloom-docx").option("revisions", v).load(str(tmp_path)).orderBy("pos").collect()]
    assert read("accepted") == [("pq", 0), ("r", 1), ("st", None)]
    assert read("rejected") == [("p", 0), ("q", 0), ("r", 1), ("s", None), ("t", None), ("", None)]


def test_no_texts(spark):
    none = spark.createDataFrame([], "key long, pos long, line string")
    assert R.tracked(none, none).count() == 0


def test_folders_of_documents(spark, tmp_path):
    made = lambda name, *docs: docx.write_documents(spark.createDataFrame([(n, 1, "T", lines) for n, lines in docs], "document string, page int, title string, lines array<string>"), str(tmp_path / name))
    made("before", ("a", ["x", "y z"]), ("gone", ["p"]), ("bad", ["q"]))
    made("after", ("a", ["x", "y w", "v"]), ("new", ["r"]), ("bad", ["q"]))
    (tmp_path / "after" / "bad.docx").write_bytes(b"no zip")
    changes, errors = compare_folders(spark, str(tmp_path / "before"), str(tmp_path / "after"), CompareOptions(tracked=str(tmp_path / "out"), author="me"))
    assert sorted((r["document"], r["kind"], r["before"], r["after"], r["before_at"]) for r in changes.collect()) == [("a.docx", "changed", "y z", "y w\nv", "2"), ("gone.docx", "deleted", "T\np", None, "0~1"), ("new.docx", "added", None, "T\nr", None)]
    assert [(r["document"], r["side"]) for r in errors.collect()] == [("bad.docx", "after")]
    read = spark.read.format("docloom-docx").load(str(tmp_path / "out"))
    assert read.rdd.getNumPartitions() == 1
    assert sorted((r["path"].rsplit("/", 1)[1], r["pos"], r["text"]) for r in read.collect()) == [("a.docx", 0, "T"), ("a.docx", 1, "x"), ("a.docx", 2, "y w"), ("a.docx", 3, "v"), ("new.docx", 0, "T"), ("new.docx", 1, "r")]


def test_small_parts_share_a_task():
    parts = [docx.TextPart(str(i), size=n) for i, n in enumerate((10, 10, 5 << 20, 10))]
    assert [[p.path for p in t.parts] for t in docx.bundled(parts, docx.TASK)] == [["0", "1"], ["2"], ["3"]]
    assert docx.bundled([], docx.TASK) == []


def test_short_texts_take_few_stages(spark, cases):
    found = []
    for most in (R.SHORT, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(R, "SHORT", most)
            m.setattr(R, "DIRECT", 4_096 if most else 0)
            spark.sparkContext.setJobGroup(f"short-{most}", "tracked")
            d = R.tracked(lines(spark, 0, cases), lines(spark, 1, cases))
            totals = {r["key"]: r["text"] for accepted in (True,) for r in R.version(d, accepted).collect()}
            tracker = spark.sparkContext.statusTracker()
            found.append((totals, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"short-{most}"))))
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0][0] == found[1][0] and found[0][1] < min(found[1][1], 90)


def test_small_documents_are_opened_by_tasks(spark, tmp_path, monkeypatch):
    d = spark.range(40).select(F.col("id").cast("string").alias("document"), F.lit(1).alias("page"), F.lit("T").alias("title"), F.array(F.lit("x"), F.col("id").cast("string")).alias("lines"))
    docx.write_documents(d, str(tmp_path / "t"))
    schema = spark.read.format("docloom-docx").load(str(tmp_path / "t")).schema
    with monkeypatch.context() as m:
        m.setattr(docx.zipfile, "ZipFile", None)
        reader = docx.DocumentReader(schema, {"path": str(tmp_path / "t")})
        assert sorted(p.path.rsplit("/", 1)[1] for t in reader.partitions() for p in t.parts if not p.error) == sorted(f"{i}.docx" for i in range(40))
