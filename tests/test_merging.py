"""Merging by options, and messages in two languages."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.messages import localised
from docloom.operators.merging import MERGED, MergeOptions, combine

CELLS = "sheet string, row long, col long, v string, formula string"


@pytest.fixture(scope="module")
def book(spark):
    rows = [("a", 1, 1, "head", None), ("a", 2, 1, "x", None), ("a", 5, 1, None, "B!A2+a!A1"), ("B", 1, 1, "head", None), ("B", 2, 1, "y", None), ("B", 6, 3, "", None), ("c", 1, 1, "head", None), ("c", 5, 2, "z", None)]
    return spark.createDataFrame(rows, CELLS), spark.createDataFrame([("a", 0, "f.xlsx"), ("B", 1, "f.xlsx"), ("c", 2, None), ("none", 3, "g.xlsx")], "sheet string, ix int, file string")


def found(d):
    return sorted(map(tuple, d.collect()), key=str)


def test_below_each_other(book):
    cells, warnings = combine(*book, MergeOptions("vertical", trim_edges=True, skip_rows=1))
    assert found(cells) == sorted([(MERGED, 1, 1, "head", None), (MERGED, 2, 1, "x", None), (MERGED, 5, 1, None, "'Merged'!A6+'Merged'!A1"), (MERGED, 6, 1, "y", None), (MERGED, 10, 2, "z", None)], key=str)
    assert found(warnings) == []


def test_empty_ends_count_unless_trimmed(book):
    cells, _ = combine(*book, MergeOptions("vertical", values_only=True))
    assert [(r["row"], r["v"]) for r in cells.orderBy("row").collect()] == [(1, "head"), (2, "x"), (6, "head"), (7, "y"), (12, "head"), (16, "z")]
    beside, _ = combine(*book, MergeOptions("horizontal", values_only=True))
    assert {(r["col"], r["v"]) for r in beside.collect()} == {(1, "head"), (1, "x"), (2, "head"), (2, "y"), (5, "head"), (6, "z")}


def test_side_by_side_with_gaps_trimmed(book):
    cells, warnings = combine(*book, MergeOptions(trim_rows=True, trim_columns=True, threshold=3))
    assert found(cells.where("target = '_c'")) == [("_c", 1, 1, "head", None), ("_c", 2, 2, "z", None)]
    assert [r["formula"] for r in cells.where("formula IS NOT NULL").collect()] == ["'f_B'!A2+'f_a'!A1"]
    assert found(warnings) == sorted([("f_a", "TRIM_SKIPPED_FORMULA", None), ("f_B", "TRIM_SKIPPED_REFERENCED", None)], key=str)


def test_no_cells_and_wrong_options(spark, book):
    none, _ = combine(spark.createDataFrame([], CELLS).drop("formula"), book[1], MergeOptions("vertical", trim_rows=True))
    assert none.count() == 0
    with pytest.raises(ValueError):
        MergeOptions("diagonal")


def test_messages(spark):
    d = spark.createDataFrame([("NO_SHEETS", "en", "a{{file}}.xlsx"), ("NO_SHEETS", "ko", None), ("NO_FILES", None, "x"), ("ODD", "en", "x"), (None, "en", "x")], "code string, lang string, file string")
    got = [r[0] for r in d.select(localised(F.col("code"), F.create_map(F.lit("file"), F.col("file")), F.col("lang"))).collect()]
    assert got == ["No sheet of a{{file}}.xlsx was chosen.", "에서 선택한 시트가 없습니다.", "병합할 파일이 없습니다.", "ODD", None]
