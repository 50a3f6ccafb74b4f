"""Values that the operators must give."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docloom.functions import calendar as C
from docloom.functions import layout as L
from docloom.functions import payroll as P
from docloom.functions import text as T
from docloom.operators import workbook as W


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_holidays(spark):
    by = {}
    for r in C.holidays(spark, 2025, 2030).collect():
        by.setdefault(r["date"], []).append(r)
    for d in (date(2025, 1, 29), date(2026, 2, 17), date(2026, 6, 3), date(2027, 2, 7), date(2028, 1, 27), date(2030, 2, 3)):
        assert d in by
    may = [d for d, rs in by.items() if d.year == 2025 and d.month == 5 and any(r["substitute"] for r in rs)]
    assert may == [date(2025, 5, 6)]


def test_annual_leave(spark):
    for hire, as_of, days in ((date(2026, 1, 31), date(2026, 2, 1), 0), (date(2026, 1, 31), date(2026, 2, 28), 1), (date(2026, 1, 1), date(2026, 11, 15), 10)):
        assert one(spark, d=C.annual_leave(F.lit(hire), F.lit(as_of), "hire"))["d"] == days
    with pytest.raises(ValueError):
        C.annual_leave(F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 2)), "other")


def test_payroll(spark):
    pay = one(spark, **P.net_pay(F.lit(3_000_000.0), F.lit(1), F.lit(0)))
    assert pay == {"pension": 142500, "health": 107850, "long_term_care": 14170, "employment": 26990, "income_tax": 55330, "local_tax": 5530, "deductions": 352370, "net": 2647630}
    assert one(spark, t=P.monthly_income_tax(F.lit(3_000_000.0), F.lit(1), F.lit(0)))["t"] == pytest.approx(55333.333333333336)
    assert one(spark, **P.weekly_allowance(F.lit(14.99), F.lit(10000.0)))["allowance"] == 0
    assert one(spark, **P.weekly_allowance(F.lit(40.0), F.lit(10000.0)))["allowance"] == 80000
    s = one(spark, **P.severance(F.lit(date(2024, 1, 1)), F.lit(date(2025, 1, 1)), F.lit(9e6), F.lit(0.0), F.lit(0.0), F.lit(92), F.lit(14)))
    assert (s["eligible"], s["severance"]) == (False, 0)


def test_white_space(spark):
    odd = "﻿  x　"
    assert one(spark, t=T.trim(F.lit(odd)))["t"] == "x"
    assert one(spark, t=T.collapse_spaces(F.lit("할수  있습니다\n할수  있습니다 ")))["t"] == "할수 있습니다\n할수 있습니다"
    assert one(spark, t=T.dedupe_lines(F.lit("a\n\n a\n\nb")))["t"] == "a\n\n\nb"


def test_references(spark):
    sheets = spark.createDataFrame([("원본 자료",), ("Summary",), ("Isolated",), ("팀's 자료",)], "sheet string")
    formulas = spark.createDataFrame([("Summary", "'원본 자료'!A1+Summary!B2"), ("Isolated", "'팀''s 자료'!A1+SUMMARY!A1"), ("Isolated", "Isolated!A1")], "sheet string, formula string")
    assert {r[0] for r in W.referenced_sheets(formulas, sheets).collect()} == {"원본 자료", "Summary", "팀's 자료"}


def test_positions(spark):
    for text, want in (("2", [2]), ("-2", [1, 2]), ("3-", [3, 4]), ("4-2, 3, x, 9", [4, 3, 2]), ("", [])):
        assert one(spark, p=W.parse_positions(F.lit(text), F.lit(4)))["p"] == want


def test_sheet_trim(spark):
    """Rows 1, 4 and 8 hold values: the gap of two stays, the gap of three goes; white space does not count."""
    cells = spark.createDataFrame([("s", 1, 1, "a"), ("s", 2, 2, " "), ("s", 3, 6, "\t"), ("s", 4, 4, "d"), ("s", 8, 8, "h")], "sheet string, row int, col int, v string")
    rows = {(r["row"], r["v"]) for r in W.trim_gaps(cells, "row", 3).collect()}
    assert rows == {(1, "a"), (4, "d"), (5, "h")}


def test_output_sizes(spark):
    w, h = L.output_size(F.lit(1920), F.lit(1080), "9:16", "1080")
    assert one(spark, w=w, h=h) == {"w": 1080, "h": 1920}
    w, h = L.output_size(F.lit(640), F.lit(360), "source", "1080")
    assert one(spark, w=w, h=h) == {"w": 640, "h": 360}
    rates = [8_000, 11_025, 12_000, 16_000, 22_050, 24_000, 32_000, 44_100, 48_000, 64_000, 88_200, 96_000]
    assert one(spark, a=L.nearest(F.lit(45_000), rates), b=L.nearest(F.lit(70_000), rates)) == {"a": 44_100, "b": 64_000}


def test_errors(spark):
    assert one(spark, c=T.classify_error(F.lit("Aborted(OOM)")))["c"] == "OUT_OF_MEMORY"
    assert one(spark, c=T.classify_error(F.lit("Unknown encoder 'libx265'")))["c"] == "CODEC_UNAVAILABLE"
    assert one(spark, c=T.classify_error(F.lit("zoom")))["c"] == "VIDEO_PROCESSING_ERROR"
