"""Line diff, lint, list numbers, runs of equal neighbours and free days against plain one-pass versions."""

import datetime
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import calendar as C
from docloom.functions.lcs import common_lines
from docloom.operators import line_diff as LD
from docloom.operators import lint, scans


def lcs_length(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        above, row = row, [0]
        for j, b in enumerate(y):
            row.append(above[j] + 1 if a == b else max(row[-1], above[j + 1]))
    return row[-1]


def lines(spark, texts):
    return spark.createDataFrame([(k, i, t) for k, own in texts.items() for i, t in enumerate(own)], "key long, pos long, line string")


def checked(rows, before, after):
    """The diff tells both texts, in order; the number of equal lines of each."""
    equal = {}
    for k in before.keys() | after.keys():
        own = [r for r in rows if r["key"] == k]
        for side, text, gone in (("before_pos", before, "added"), ("after_pos", after, "deleted")):
            assert [r["line"] for r in sorted((r for r in own if r["kind"] != gone), key=lambda r: r[side])] == text.get(k, [])
        pairs = sorted((r["before_pos"], r["after_pos"]) for r in own if r["kind"] == "equal")
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        equal[k] = len(pairs)
    return equal


def test_common_lines_are_longest():
    rng = np.random.default_rng(1)
    for _ in range(400):
        x, y = (rng.integers(0, int(rng.integers(1, 8)), int(rng.integers(0, 40))).tolist() for _ in range(2))
        found = common_lines(x, y)
        assert all(x[i] == y[j] for i, j in found) and all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
        assert len(found) == lcs_length(x, y)


def test_heaviest_chain():
    rng = np.random.default_rng(2)
    for _ in range(200):
        m = int(rng.integers(1, 9))
        b, a, n = rng.permutation(m), rng.permutation(m), rng.integers(1, 5, m)
        best = max(sum(n[list(s)]) for s in ([i for i in range(m) if mask >> i & 1] for mask in range(1, 1 << m)) if all((b[i] < b[j]) == (a[i] < a[j]) for i in s for j in s))
        got = LD.heaviest_chain(b, a, n)
        assert n[got].sum() == best and (np.diff(b[got]) > 0).all() and (np.diff(a[got]) > 0).all()


def test_line_diff_of_small_texts(spark, monkeypatch):
    """Without rounds of anchors the diff is exact; with them exact where lines are unique, and always a diff."""
    monkeypatch.setattr(LD, "RANGE", 4)
    rng = np.random.default_rng(3)
    before, after = {}, {}
    for k in range(40):
        n = int(rng.integers(0, 30))
        unique = k % 2 == 0
        before[k] = [f"l{x}" for x in (rng.permutation(60)[:n] if unique else rng.integers(0, 9, n))]
        after[k] = [x if rng.random() < 0.8 else f"new{k}-{i}" for i, x in enumerate(before[k]) if rng.random() < 0.85]
        if k % 5 == 0 and len(after[k]) > 3:
            after[k] = after[k][3:] + after[k][:3]
    before[100], after[101] = ["only before"], ["only", "after", ""]
    for rounds in (0, 3):
        got = checked(LD.line_diff(lines(spark, before), lines(spark, after), rounds).collect(), before, after)
        for k, n in got.items():
            want = lcs_length(before.get(k, []), after.get(k, []))
            assert n == want if rounds == 0 or k % 2 == 0 else n <= want


def test_line_diff_of_one_long_text(spark):
    """200,000 lines, some of them common, moved or lost: no task gets both texts."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random(200_000) < 0.1, "", [f"line {i}" for i in range(200_000)]).tolist()
    y = [t + "!" if rng.random() < 0.002 else t for t in x if rng.random() > 0.002]
    y = y[:50_000] + y[60_000:80_000] + y[50_000:60_000] + y[80_000:]
    frames = [spark.createDataFrame(pd.DataFrame({"key": 7, "pos": range(len(t)), "line": t})) for t in (x, y)]
    got = checked(LD.line_diff(*frames).collect(), {7: x}, {7: y})
    assert got[7] >= len(y) - 10_000 - 1_500


def test_line_diff_reads_what_its_steps_have_written(spark):
    """Joins in the result, and texts made anew for every round, made plans that the driver could not hold."""
    before, after = {1: ["a", "b", "c"], 2: ["x"]}, {1: ["a", "B", "c", "c"], 2: ["x", "y"]}
    got = LD.line_diff(lines(spark, before), lines(spark, after))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    checked(got.collect(), before, after)


def test_combined_changes_take_few_stages(spark):
    text = {1: [f"line {i}" for i in range(3_000)]}
    edited = {1: [x + "!" if i % 97 == 1 else x for i, x in enumerate(text[1]) if i % 97 != 3]}
    spark.sparkContext.setJobGroup("few-stages", "combined")
    try:
        assert LD.combined(LD.line_diff(lines(spark, text), lines(spark, edited))).count() == 62
        tracker = spark.sparkContext.statusTracker()
        assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("few-stages")) < 120
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_combined_changes(spark):
    before, after = {1: ["a", "b", "c", "d", "e"], 2: ["x"], 3: []}, {1: ["a", "B", "C", "d", "new", "e", "end"], 2: [], 3: ["y", "z"]}
    got = LD.combined(LD.line_diff(lines(spark, before), lines(spark, after))).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, 1, "changed", "b\nc", "B\nC", "1~2", "1~2"), (1, 2, "added", None, "new", None, "4"), (1, 3, "added", None, "end", None, "6"),
        (2, 0, "deleted", "x", None, "0", None), (3, 0, "added", None, "y\nz", None, "0~1"),
    ]


def test_common_ends(spark):
    rng = np.random.default_rng(5)
    before = {k: rng.integers(0, 2, int(rng.integers(1, 8))).astype(str).tolist() for k in range(60)}
    after = {k: rng.integers(0, 2, int(rng.integers(1, 8))).astype(str).tolist() for k in range(60)}
    want = []
    for k in before:
        x, y = before[k], after[k]
        p = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        s = next((i for i in range(min(len(x), len(y)) - p) if x[-1 - i] != y[-1 - i]), min(len(x), len(y)) - p)
        want.append((k, p, s))
    assert sorted(tuple(r) for r in LD.common_ends(lines(spark, before), lines(spark, after)).collect()) == want


def plain_findings(text):
    """Every rule over the whole text."""
    found = {}
    for pattern, replacement in lint.RULES:
        if hits := [m.group() for m in re.finditer(pattern, text)]:
            found[hits[0], re.sub(pattern, replacement, hits[0])] = len(hits)
    return [(a, b, n) for (a, b), n in found.items()]


def test_lint_equals_a_pass_for_each_rule():
    rng = np.random.default_rng(6)
    words = ["할수", "할것", "하기때문", "못하는", "지 못하면", "못하", "몇번", "몇일동안", "개월동안", "년동안일동안", "완료후작업전", "어떻해", "비률역활", "결재 \n 금액", "결재수단", "결재", "다운로드할만큼", "될수", ",", " ", "\n", ".", "x", "할", "수", "동안", "일", "😀", "후후"]
    texts = ["".join(rng.choice(words, int(rng.integers(0, 25)))) for _ in range(3000)] + [""]
    got = dict(lint.find_all(texts))
    assert {i: plain_findings(t) for i, t in enumerate(texts) if plain_findings(t)} == got and len(got) > 1000


def test_lint_walks_each_text_once():
    """Letters that the automaton looks at, against a pass for every rule."""
    text = ("이 문단은 규칙에 걸리지 않는 보통의 글입니다. 작업후 확인할수 있습니다. " * 200 + "plain words in Latin letters. ") * 5
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    places, looked = lint.AUTOMATON.hits(codes)
    assert len(places) >= 2000 and looked < 1.5 * len(codes) and len(lint.RULES) == 253


def plain_labels(levels, formats, legal, number):
    now, out = [None] * len(formats), []
    for level in levels:
        for k in range(level):
            now[k] = formats[k][2] if now[k] is None else now[k]
        now[level] = formats[level][2] if now[level] is None else now[level] + 1
        now[level + 1 :] = [None] * (len(formats) - level - 1)
        values = [formats[k][2] if v is None else v for k, v in enumerate(now)]
        out.append(re.sub(r"%(\d)", lambda m: number(values[int(m[1]) - 1], "decimal" if level in legal else formats[int(m[1]) - 1][1]), formats[level][0]))
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_list_labels(spark, parts):
    """Lists over many ranges, one of them with half of all items."""
    rng = np.random.default_rng(parts)
    formats = [("%1.", "decimalZero", 0), ("%1-%2", "lowerLetter", 3), ("(%2.%3)", "decimal", 1), ("%4 of %1", "upperRoman", 1)]
    number = lambda n, kind: {"decimalZero": f"{n:02d}", "decimal": str(n), "lowerLetter": ("" if n <= 26 else chr(96 + (n - 1) // 26)) + chr(97 + (n - 1) % 26), "upperRoman": ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV"][n] if n < 16 else str(n)}[kind]
    lists = {k: rng.choice(4, n, p=[0.1, 0.3, 0.3, 0.3]).tolist() for k, n in ((1, 300), (2, 100), (3, 1), (4, 100), (5, 99))}
    rows = [(k, i * 3 + k, level) for k, own in lists.items() for i, level in enumerate(own)]
    got = {(r["list"], r["pos"]): r["label"] for r in scans.list_labels(spark.createDataFrame(rows, "list long, pos long, level int"), formats, frozenset({2}), parts).collect()}
    want = {(k, i * 3 + k): t for k, own in lists.items() for i, t in enumerate(plain_labels(own, formats, {2}, number))}
    assert got == want


def test_list_numbers(spark):
    kinds = {"decimalEnclosedCircle": {0: "⓪", 1: "①", 20: "⑳", 21: "(21)"}, "upperRoman": {0: "0", 4: "IV", 1999: "MCMXCIX"}, "lowerLetter": {1: "a", 27: "aa", 703: "aaa"}, "ganada": {1: "가", 14: "하", 15: "가가"}, "chosung": {2: "ㄴ"}, "decimalZero": {5: "05", 12: "12"}, "unknown": {7: "7"}}
    for kind, want in kinds.items():
        d = spark.createDataFrame([(n,) for n in want], "n int").select("n", scans.list_number(F.col("n"), kind).alias("t"))
        assert {r["n"]: r["t"] for r in d.collect()} == want


@pytest.mark.parametrize("parts", [1, 16, 64])
def test_coalesced(spark, parts):
    """Neighbours over many ranges, also ranges that are one island; nulls are equal."""
    rng = np.random.default_rng(parts)
    rows = []
    for key, n, many in ((None, 100, 3), (1, 400, 2), (2, 50, 1), (3, 1, 1)):
        value = None
        for i in range(n):
            if rng.random() < (0.1 if key == 1 else 0.5):
                value = [None, "a", "b", "c"][rng.integers(0, many + 1)]
            rows.append((key, i * 7 + n, value))
    want, last = [], {}
    for key, pos, value in rows:
        if key in last and last[key][3] == value:
            last[key][2], last[key][4] = pos, last[key][4] + 1
        else:
            want.append(last.setdefault(key, None) or [key, pos, pos, value, 1])
            want[-1] = last[key] = [key, pos, pos, value, 1]
    got = scans.coalesced(spark.createDataFrame(rows, "k long, at long, v string"), "k", "at", "v", parts).select("key", "first", "last", "value", "n").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(map(tuple, want), key=str)


def test_excluded_days(spark):
    rng = np.random.default_rng(7)
    day = datetime.date(2024, 1, 1)
    custom = {datetime.date(2024, 7, 3): "Own day", datetime.date(2024, 8, 15): "Own name"}
    free = C.free_days(spark, 2024, 2026, custom)
    reasons = {r["day"]: r["reason"] for r in free.collect()}
    assert reasons[datetime.date(2024, 8, 15)] == "Own name" and reasons[datetime.date(2024, 7, 6)] == "Weekend" and reasons[datetime.date(2025, 1, 1)] == "New Year's Day"
    ranges = [(i, day + datetime.timedelta(int(a)), day + datetime.timedelta(int(a + b))) for i, (a, b) in enumerate(zip(rng.integers(0, 600, 50), rng.integers(-3, 200, 50)))] + [(50, None, day), (51, day, None)]
    want = {(i, d, reasons[d]) for i, a, b in ranges if a and b for d in (a + datetime.timedelta(k) for k in range((b - a).days + 1)) if d in reasons}
    got = C.excluded_days(spark.createDataFrame(ranges, "id int, first date, last date"), free)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
