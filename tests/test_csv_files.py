"""CSV in parallel splits against the csv module on the whole file."""

import csv
import io

import numpy as np
import pytest

from docloom.sources import csv_files as C

ALPHABET = ["a", "b", ",", '"', '""', "\n", "\r\n", ",\"", "\",", "é", " ", "word"]


def whole(text):
    """Records of a file's text, without faults."""
    return [r or [""] for r in csv.reader(io.StringIO(text, newline=""), strict=True)]


def written(rng, rows):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
    made = [["".join(rng.choice(["x", ",", '"', "\n", "\r\n", "é", " ", "long" * 20], int(rng.integers(0, 6)))) for _ in range(int(rng.integers(1, 5)))] for _ in range(rows)]
    w.writerows(made)
    return made, out.getvalue()


@pytest.mark.parametrize("split", [64, 200, 1000, 1 << 20])
def test_records_equal_the_whole_file(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    want = {}
    for i in range(3):
        made, text = written(rng, 150)
        (tmp_path / f"f{i}.csv").write_text(text, newline="")
        want[f"f{i}.csv"] = made
    (tmp_path / "empty.csv").write_text("")
    got = C.csv_records(spark, str(tmp_path), split_bytes=split).collect()
    assert all(r["fault"] is None for r in got)
    for name, rows in want.items():
        own = sorted((r["row"], r["fields"]) for r in got if r["file"].endswith(name))
        assert [f for _, f in own] == rows and [i for i, _ in own] == list(range(len(rows)))
    if split < 1000:
        assert len({(r["file"], r["split"]) for r in got}) > 30


def test_one_field_over_many_splits(spark, tmp_path):
    rows = [["a", "b"], ["1", "x\n" * 5000 + '"'], ["2", "y"]]
    with open(tmp_path / "f.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\r\n").writerows(rows)
    table, report = C.read_csv(spark, str(tmp_path / "f.csv"), split_bytes=500)
    assert [(r["_row"], r["a"], r["b"]) for r in table.orderBy("_row").collect()] == [(1, "1", rows[1][1]), (2, "2", "y")]
    assert sum(r["records"] for r in report.collect()) == 2


def test_states_compose(spark):
    """A line's effect on either state against a scan of its characters; summaries' composition against one scan."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        line = "".join(rng.choice([a for a in ALPHABET if "\n" not in a], int(rng.integers(0, 9))))
        for inside in (False, True):
            state = "in" if inside else "start"
            i = 0
            while i < len(line):
                c = line[i]
                if state == "in":
                    if c == '"':
                        if line[i + 1 : i + 2] == '"':
                            i += 1
                        else:
                            state = "field"
                elif c == ",":
                    state = "start"
                elif c == '"' and state == "start":
                    state = "in"
                else:
                    state = "field"
                i += 1
            assert C.inside_after(line, inside) == (state == "in"), (line, inside)
    maps = rng.integers(0, 2, (60, 2)).tolist()
    n = rng.integers(0, 5, (60, 2)).tolist()
    splits = spark.createDataFrame([("f", i * 10, a, b, x, y, 1) for i, ((a, b), (x, y)) in enumerate(zip(maps, n))], C._SUMMARY)
    state = base = 0
    want = []
    for (a, b), own in zip(maps, n):
        want.append((state, base))
        base += own[state]
        state = (a, b)[state]
    assert [(r["entry"], r["base"]) for r in C.entered(splits).orderBy("split").collect()] == want


def test_table_semantics(spark, tmp_path):
    text = '\ufeff\n  ,\n name ,,name,"q,""x"""\n1,2\n\n"a\r\nb",x,y,z,more\n , \n'
    (tmp_path / "f.csv").write_bytes(text.encode())
    table, report = C.read_csv(spark, str(tmp_path))
    assert table.columns == ["_file", "_row", "name", "Column 2", "name_1", 'q,"x"']
    assert [tuple(r)[2:] for r in table.orderBy("_row").collect()] == [("1", "2", "", ""), ("a\r\nb", "x", "y", "z")]
    assert [tuple(r)[1:] for r in report.collect()] == [(0, 2, 2, 0)]


def test_faults(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n"x"y,1\n2,3\n4,"never closed\n5,6\n')
    with pytest.raises(ValueError, match="expected after"):
        C.read_csv(spark, str(tmp_path))
    table, report = C.read_csv(spark, str(tmp_path), split_bytes=6, faults="keep")
    assert [tuple(r)[1:] for r in table.orderBy("_row").collect()] == [(1, "xy", "1"), (2, "2", "3"), (3, "4", "never closed\n5,6")]
    assert sum(r["faults"] for r in report.collect()) == 2
    (tmp_path / "g.csv").write_text("other\n")
    with pytest.raises(ValueError, match="different header"):
        C.read_csv(spark, str(tmp_path))


def test_nothing(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\n \n")
    table, report = C.read_csv(spark, str(tmp_path))
    assert table.columns == ["_file", "_row"] and table.count() == 0 and report.count() == 0
