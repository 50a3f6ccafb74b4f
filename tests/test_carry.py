"""JSON of any shape, formulas, numbering, notes, formats and logs against plain versions and stated values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import carry, formulas
from docloom.sources import json_tables as J


def test_json_tables(spark):
    texts = ['[{"b":1,"a":"x"},{"c":{"z":1,"y":[1,null]},"a":null,"q\\"r":true}]', '{"d":1.5,"b":""}', "[]", "[[1,[2]],[]]", "nope", None, '"text"', "[1]", "{}"]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    t = J.json_table(d, "k", "t")
    assert t.columns == ["_key", "_item", "b", "a", "c", 'q"r', "d", "Column 1", "Column 2", "_error"]
    got = {(r["_key"], r["_item"]): tuple(r)[2:] for r in t.collect()}
    assert got == {
        (0, 0): ("1", "x", "", "", "", "", "", None), (0, 1): ("", "", '{"y":[1,null],"z":1}', "true", "", "", "", None), (1, 0): ("", "", "", "", "1.5", "", "", None),
        (3, 0): ("", "", "", "", "", "1", "[2]", None), (3, 1): ("", "", "", "", "", "", "", None), (4, 0): ("",) * 7 + ("INVALID_JSON",), (5, 0): ("",) * 7 + ("INVALID_JSON",),
        (6, 0): ("",) * 7 + ("NOT_AN_OBJECT",), (7, 0): ("",) * 7 + ("NOT_AN_OBJECT",), (8, 0): ("",) * 7 + (None,),
    }
    empty = J.json_table(spark.createDataFrame([(1, "[]")], "k int, t string"), "k", "t")
    assert empty.columns == ["_key", "_item", "_error"] and empty.count() == 0
    assert "a" in J.schema(spark.createDataFrame([('{"a":1}',), ('{"a":"x","b":[1]}',)], "t string"), "t")


def test_formula_pieces(spark):
    said = {
        "SUM(A1:A2)": "SUM(A4:A5)", "\"A1\"&First!$B$2&'Other'!C3+A1": "\"A1\"&'One'!$B$2&'Other'!C3+A4", "LOG10(B1)+A1B+x.A1+A1(": "LOG10(B4)+A1B+x.A1+A1(", "'fIrSt'!A1:B2": "'One'!A1:B2",
        "A1 : B2": "A4:B5", "$A$1:C$3": "$A$4:C$6", "Second!A1:First!B2": "'It''s'!A4:'One'!B2", "\"un\"\"A1\"&Z99": "\"un\"\"A1\"&Z102", "'It''s gone'!A1": "'It''s gone'!A1", "": "",
    }
    cells = spark.createDataFrame([("Second", i, 1, f) for i, f in enumerate(said)], "sheet string, row long, col int, formula string")
    plan = spark.createDataFrame([("First", "One", 0, 0), ("Second", "It's", 3, 0)], "sheet string, target string, rows int, cols int")
    got = {r["row"]: (r["formula"], r["excluded"]) for r in formulas.shifted(cells.where("formula <> ''"), plan).collect()}
    for i, (f, want) in enumerate(said.items()):
        if f:
            assert got[i] == (want, ["Other"] if "Other" in f else ["It's gone"] if "gone" in f else []), f


def test_dependents(spark):
    rng = random.Random(3)
    n, reads = 60, {}
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(3)):
            a, c = rng.randrange(n), rng.randrange(1, 3)
            b, d = min(n - 1, a + rng.randrange(3)), min(2, c + rng.randrange(2))
            other = rng.random() < 0.3
            parts.append(("'T'!" if other else "") + f"${'AB'[c - 1]}{a}:{'AB'[d - 1]}{b}")
            reads.setdefault(("S", i), []).append(("T" if other else "S", a, b, c, d))
        rows.append(("S", i, 1 + i % 2, "+".join(parts) or "1"))
    cells = spark.createDataFrame(rows, "sheet string, row long, col int, formula string")
    place = {(s, r): c for s, r, c, _ in rows}
    reads_cell = lambda to, at: any(s == at[0] and a <= at[1] <= b and c <= place.get(at, 1) <= d for s, a, b, c, d in reads.get(to, []))
    want = set()
    sources = [("S", i) for i in range(0, n, 7)] + [("T", 5)]
    for source in sources:
        front, seen = [source], set()
        while front:
            at = front.pop()
            for to in place:
                if to not in seen and reads_cell(to, at):
                    seen.add(to)
                    front.append(to)
        want |= {(*source, *to, source == to) for to in seen}
    changed = spark.createDataFrame([(s, r, place.get((s, r), 1)) for s, r in sources], "sheet string, row long, col int")
    got = {(r["source_sheet"], r["source_row"], r["sheet"], r["row"], r["cyclic"]) for r in formulas.dependents(cells, changed).collect()}
    assert got == want and any(x[-1] for x in want)


def test_numbering(spark):
    links = [(1, 5), (2, 6), (5, 9), (6, 5), (7, None), (9, 1), (4, 100)]
    d = spark.createDataFrame(links, "id long, to long")
    used = spark.createDataFrame([(2,), (7,), (4,), (None,), (77,)], "id long")
    got = sorted(tuple(r) for r in carry.merged_ids(d, used, spark.createDataFrame([(3,), (40,)], "id long")).collect())
    assert got == [(1, 41, 44), (2, 42, 45), (4, 43, None), (5, 44, 47), (6, 45, 44), (7, 46, None), (9, 47, 41)]
    nothing = carry.merged_ids(d, used.limit(0), spark.createDataFrame([], "id long"))
    assert nothing.count() == 0


def test_visible_format(spark):
    alike = [({"color": "auto", "lang": "en"}, {"color": "000000"}), ({"color": "ff0000"}, {"color": "FF0000", "rsid": "1"}), ({}, {"w": "100", "highlight": "None", "kern": "0"}), ({"b": "1", "i": "1"}, {"i": "1", "b": "1"})]
    apart = [({"b": "1"}, {}), ({"color": "111111"}, {}), ({"spacing": "2"}, {"spacing": "0"}), ({"u": "single;v=1"}, {"u": "single", "vanish": "1"})]
    pair = "a map<string,string>, b map<string,string>"
    for pairs, same in ((alike, True), (apart, False)):
        rows = spark.createDataFrame(pairs, pair).select((carry.visible_format(F.col("a")) == carry.visible_format(F.col("b"))).alias("same")).collect()
        assert all(r["same"] == same for r in rows)


def test_run_signatures(spark):
    kind = "paragraph long, pos long, text string, properties map<string,string>"
    bold = {"b": "1"}
    rows = [(1, 0, "one ", bold), (1, 1, "two", {}), (2, 0, "on", bold), (2, 1, "", {"i": "1"}), (2, 2, "e ", bold), (2, 3, "two", None), (3, 0, "one", bold), (3, 1, " two", {}), (4, 0, "one two", {})]
    got = {r["paragraph"]: (r["text"], r["signature"]) for r in carry.run_signatures(spark.createDataFrame(rows, kind)).collect()}
    assert {t for t, _ in got.values()} == {"one two"} and got[1] == got[2] and len({s for _, s in got.values()}) == 3


@pytest.mark.parametrize("n", [0, 5000])
def test_compaction(spark, n):
    """Against the log applied in order; a key with half of all entries."""
    rng = random.Random(n)
    log = [(None if rng.random() < 0.02 else 0 if rng.random() < 0.5 else rng.randrange(400), v, "delete" if rng.random() < 0.05 else None if rng.random() < 0.1 else "set", *[rng.choice([None, None, str(v)]) for _ in range(2)]) for v in range(n)]
    rows: dict = {}
    for key, _, op, a, b in log:
        if op == "delete":
            rows.pop(key, None)
        else:
            own = rows.setdefault(key, {"a": None, "b": None})
            own |= {k: x for k, x in (("a", a), ("b", b)) if x is not None}
    rng.shuffle(log)
    got = carry.compact(spark.createDataFrame(log, "k int, v int, op string, a string, b string"), "k", "v", "op", ["a", "b"])
    assert {r["k"]: {"a": r["a"], "b": r["b"]} for r in got.collect()} == rows
    nulls = spark.createDataFrame([(1, 1, "set", "x"), (1, 2, "set", None)], "k int, v int, op string, a string")
    assert carry.compact(nulls, "k", "v", "op", ["a"], {"a": F.lit(True)}).first()["a"] is None
    assert json.dumps(carry.compact(nulls, "k", "v", "op", ["a"]).first().asDict()) == '{"k": 1, "a": "x"}'
