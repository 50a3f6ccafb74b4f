"""Queries over all rows against brute force, on small tables of odd shape."""

import re
import time
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from docloom.functions import calendar
from docloom.functions import text as T
from docloom.functions.zones import CITIES
from docloom.operators import catalogue
from docloom.operators.text_queries import unique_names


def test_zone_convert_all(spark, tmp_path):
    """No event is left out, whatever its type and id."""
    rows = [(i, ("view", "purchase", "click", None)[i % 4], datetime(2024, 3, 9, 23, 30) + timedelta(hours=7 * i)) for i in range(1, 60)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_id"], r["id"]): r for r in catalogue.queries()["zone_convert_all"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) * len(CITIES)
    for i, _, ts in rows:
        for city, zone in CITIES:
            local = ts.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
            r = got[i, city]
            assert (r["local_time"], r["shift"], r["works"]) == (local, (local.date() - ts.date()).days, 9 <= local.hour + local.minute / 60 < 18)


def test_dedupe_of_a_long_text(spark):
    """20,000 lines in well under a minute, and trims as for short texts."""
    rows = ["  a ", "a", "", "\tb", "", "b ", "a\r", "c"]
    text = "\n".join(rows + [f" line {i % 7000}  " for i in range(20_000)])
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(T.dedupe_lines(F.col("t"))).first()[0].split("\n")
    assert got == ["  a ", "", "\tb", "", "c"] + [f" line {i}  " for i in range(7000)]
    assert time.time() - began < 30


def test_trim_lines_in_one_pass(spark):
    odd = " \t a \r\n\n \n\n\u3000 b  c \x0b\n d\u00a0"
    want = "a\n\nb  c\nd"
    assert spark.createDataFrame([(odd,), ("   ",), ("",), (" " * 50_000 + "x" + " " * 50_000 + "y",)], "t string").select(T.trim_lines(F.col("t"))).collect() == [(want,), ("",), ("",), ("x" + " " * 50_000 + "y",)]


def test_business_days_of_any_year(spark, tmp_path):
    days = [datetime(1987, 12, 30), datetime(2024, 2, 29), datetime(2031, 5, 5), None]
    spark.createDataFrame(list(enumerate(days, 29)), "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    off = {r["date"] for r in calendar.holidays(spark, 1987, 2032).collect()}
    got = {r["o_orderkey"]: (r["total"], r["business"]) for r in catalogue.queries()["business_days"](spark, str(tmp_path)).collect()}
    want = {}
    for k, d in enumerate(days, 29):
        span = [d.date() + timedelta(i) for i in range(k % 30 + 1)] if d else []
        want[k] = (len(span), sum(x.weekday() < 5 and x not in off for x in span)) if d else (None, None)
    assert got == want


def test_leave_of_a_leap_day(spark):
    """A year is complete on 1 March where the year has no 29 February; a month on its last day."""
    ask = lambda hire, as_of: spark.range(1).select(calendar.annual_leave(F.lit(hire), F.lit(as_of), "hire")).first()[0]
    assert ask(date(2024, 2, 29), date(2025, 2, 28)) == 11 and ask(date(2024, 2, 29), date(2025, 3, 1)) == 15
    assert ask(date(2024, 2, 29), date(2024, 3, 28)) == 0 and ask(date(2024, 2, 29), date(2024, 3, 29)) == 1


def test_sheet_names_are_unique(spark):
    bases = ["same", "SAME", "same (2)", "same", "x" * 31, "x" * 27 + "abcd", "x" * 31, "x" * 27 + "abcd", "x" * 26 + " (2)"] + ["y" * 31] * 12 + [f"{'y' * 26}{i:05d}" for i in range(20)] * 2
    d = spark.createDataFrame([(1, i, b) for i, b in enumerate(bases)], "book int, ord int, base string")
    got = [r["name"] for r in unique_names(d, "book", "ord", "base").orderBy("ord").collect()]
    used, want = set(), []
    for b in bases:
        n, name = 1, b
        while name.lower() in used:
            n += 1
            name = b[: 31 - len(f" ({n})")] + f" ({n})"
        used.add(name.lower())
        want.append(name)
    assert got == want and max(map(len, got)) <= 31
    names = catalogue.queries()["sheet_names"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").selectExpr("page_id", "floor(page_id / 500) AS book"), "page_id")
    assert names.groupBy("book", F.lower("sheet")).count().where("count > 1").count() == 0


def test_ordinals(spark):
    """Places by key over ranges of a skewed order, with a null key and few values."""
    from docloom.functions.ranges import bounded, ordinals

    rows = [(("a", "b", None)[i % 3], i * i * i) for i in range(700)] + [("hot", i) for i in range(900)]
    got = {(r["key"], r["v"]): r["n"] for r in ordinals(spark.createDataFrame(rows, "key string, v long").repartition(5), "key", "v", parts=16).collect()}
    want = {}
    for k in ("a", "b", None, "hot"):
        want |= {(k, v): n for n, v in enumerate(sorted(v for x, v in rows if x == k), 1)}
    assert got == want
    with pytest.raises(ValueError, match="more than 3 rows"):
        bounded(spark.range(4), 3, "rows")


def test_lint_finds_the_same_with_and_without_a_quick_look():
    from docloom.operators import lint
    from docloom.operators.diff_queries import SAID

    for text in (*SAID, "\n".join(SAID), "일동안 년동안 하지 못하는 못하면 결재 카드 할수도 할수, 사용할때", "plain"):
        slow: dict = {}
        for pattern, replacement in lint.RULES:
            if hits := [m.group() for m in re.finditer(pattern, text)]:
                slow[hits[0], re.sub(pattern, replacement, hits[0])] = len(hits)
        assert dict(lint.find_all([text])).get(0, []) == [(a, b, n) for (a, b), n in slow.items()]
    found = dict(lint.find_all(SAID))
    assert 4 not in found and [x[0] for x in found[1]] == ["할수", "볼때", "먹을만큼"]
