"""Whitening, fill-in-middle and near vectors against brute force, with odd inputs."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import fill_middle, near_vectors, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"
WIDE = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


# --- whitening ---------------------------------------------------------------------------------------------------


def brute_whiten(rows, most=32):
    """By id: n, exact deviation, whitened and explained, from fractions."""
    good = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(good), [x for _, x in good]
    d = len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    y = [[n * r[k] - s[k] for k in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:most], p[:, ::-1][:, :most]
    w = np.array([[float(Fraction(c, n)) for c in r] for r in y]) @ p / np.sqrt(e)
    return {i: (n, sum(c * c for c in r), w[k], e / np.trace(v)) for k, (i, r) in enumerate(zip([i for i, _ in good], y))}


def same_whitening(got, want, components):
    assert {r["vec_id"] for r in got} == set(want) and len(got) == len(want) * components
    signs = {}
    for r in got:
        n, deviation, w, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, deviation, deviation)
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        if abs(w[k]) > 1e-3:
            assert signs.setdefault(k, np.sign(w[k] * r["whitened"])) == np.sign(w[k] * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(w[k]), abs=1e-7)
        assert r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    from docloom.llm.queries import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_whitening(queries()["op11_whitening"](spark, SF).collect(), brute_whiten(rows), 32)


def test_whitening_keeps_small_spreads_on_large_values(spark):
    """Values of 1e9 that differ by some hundredths: products that aren't centred exactly would lose the spread."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in 1e9 + rng.normal(0, 3, 5) * (1, 2, 3, 4, 50)]) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1) for r in rows], WIDE)).collect()
    same_whitening(got, brute_whiten(rows), 5)


def test_whitening_beyond_64_bits(spark):
    """Entries near the bound, and products that need Python's integers."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3) * (1e16, 1e10, 1e3)]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1) for r in rows], WIDE)).collect()
    want = brute_whiten(rows)
    assert {r["vec_id"]: (r["deviation"], r["deviation_exact"]) for r in got} == {i: (None, None if x[1] >= 10**38 else x[1]) for i, x in want.items()}


def test_gram_is_exact():
    rng = np.random.default_rng(3)
    for most in (3, 2**15, 2**16, 2**31, 2**47, 2**61):
        y = rng.integers(-most, most + 1, (40, 6))
        g = whitening.Gram(6)
        g.add(y[:25])
        g.add(y[25:])
        assert g.flush().tolist() == (y.astype(object).T @ y.astype(object)).tolist()


def test_gram_flushes_in_time(monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    y = np.random.default_rng(4).integers(-(2**40), 2**40, (400, 3))
    g = whitening.Gram(3)
    for i in range(0, 400, 30):
        g.add(y[i : i + 30])
    assert g.flush().tolist() == (y.astype(object).T @ y.astype(object)).tolist()


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [3.0, 2.5], 1), (2, None, 1), (3, [1.0, None], 1), (4, [NAN, 1.0], 1), (5, [INF, 1.0], 1), (6, [], 1), (7, [2.0, 9.0], None), (8, [5.0, 5.0, 5.0], 2)]
    table = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("v", "d", "n", "w", "k")])
    got = whitening.whiten(table).collect()
    two = [r for r in got if r["vec_id"] != 8]
    assert sorted(str(r["vec_id"]) for r in two) == ["1"] * 4 + ["7"] * 2 + ["None"] * 2 and {r["n"] for r in two} == {4}
    w = np.array([r["whitened"] for r in sorted(two, key=lambda r: (r["component"], str(r["vec_id"])))]).reshape(2, 4)
    assert np.allclose(w @ w.T / 4, np.eye(2)) and np.allclose(w.sum(1), 0)
    alone = [r for r in got if r["vec_id"] == 8]
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_without_full_rank(spark):
    """A column that repeats another: its direction has no variance, the others are whitened."""
    rng = np.random.default_rng(5)
    rows = [(i, [a, a, b], 1) for i, (a, b) in enumerate(rng.normal(0, 1, (50, 2)).tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, WIDE)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) and r["identity_error"] < 1e-9 for r in got)


# --- fill in the middle ------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fill(i, text):
    text = text or ""
    t = TOKEN.findall(text)
    assert "".join(t) == text
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    rng = np.random.default_rng(6)
    letters = ["a", "<", "P", "S", "M", ">", " ", "\n", "é", "😀", "\x1c", " "]
    texts = ["", None, " ", "\t\r\n ", "x", " x", "x ", "<P>", "a <S>b", "<M", "<<P>", "<P<S", "P>", "ab " * 4000, "x" * 9000, " " * 5000, "é" * 70_000 + " z", "<P" + "y" * 70_000 + ">"]
    return texts + ["".join(rng.choice(letters, int(rng.integers(1, 60)), p=[0.2] + [0.05] * 5 + [0.25, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(400)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 64, fill_middle.CHUNK])
def test_fill_in_middle(spark, chunk):
    rows = [*enumerate(odd_texts()), (3, "one id twice"), (3, "one id twice"), (None, "no id at all"), (None, " <S")]
    if chunk < 5:
        rows = [r for r in rows if len(r[1] or "") < 100]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, h1 long").withColumn("marks", F.lit(0))
    made = fill_middle.fill_in_middle(table, chunk).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *brute_fill(i, t), t or "") for i, t in rows), key=str)
    assert sorted((tuple(r) for r in made), key=str) == want
    assert {r["form"] for r in made} == {"plain", "spm", "psm"}


def test_summaries_compose():
    """Any split of a text has the same composed summary, from every first state."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        raw = bytes(rng.choice(list(b"a< PSM>\xc3\xa9"), int(rng.integers(2, 30))))
        cuts = sorted(rng.integers(0, len(raw) + 1, 4).tolist())
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        whole, total = fill_middle.summary(raw), None
        for p in parts:
            if p:
                total = fill_middle.summary(p) if total is None else total + fill_middle.summary(p)
        assert all(np.array_equal(a, b) for a, b in zip(whole, total))
        for s in fill_middle.STATES:
            state, ends, marks = s, 0, 0
            for k in fill_middle.CLASS[np.frombuffer(raw, np.uint8)]:
                ends += state > 0 and k == 0
                marks += state == 3 and k == 3
                state = fill_middle.NEXT[state, k]
            assert (whole.state[s], whole.ends[s], whole.marks[s]) == (state, ends, marks)


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- near vectors ------------------------------------------------------------------------------------------------


def brute_near(rows, least=0.98):
    """For each row n_links and component, over all pairs."""
    ok = lambda v, k: k is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    of = {}
    for a, (_, v, k) in enumerate(rows):
        if ok(v, k):
            of.setdefault((k, len(v)), []).append(a)
    for (_, d), own in of.items():
        x = np.array([rows[a][1] for a in own], np.float64)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        norm = np.sqrt((x * x).sum(1))
        for i, j in zip(*np.nonzero(np.triu((x @ x.T) / np.outer(norm, norm) >= least, 1))):
            a, b = own[i], own[j]
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    least_id = {}
    for a, (i, _, _) in enumerate(rows):
        r = root(a)
        least_id[r] = min((x for x in (i, least_id.get(r)) if x is not None), default=None)
    return [(i, links[a], least_id[root(a)], i == least_id[root(a)]) for a, (i, _, _) in enumerate(rows)]


def near_groups(rng, groups, d=64, spread=(0.02, 0.09)):
    """Rows (id, vector, label): groups of near copies of random vectors."""
    rows = []
    for label, many in groups:
        base = rng.normal(0, 1, d)
        base /= np.linalg.norm(base)
        width = rng.uniform(*spread)
        for _ in range(many):
            rows.append((len(rows), [float(c) for c in base + rng.normal(0, width / np.sqrt(d), d)], label))
    return rows


def test_near_vectors_exact_where_a_block_holds_all(spark):
    rng = np.random.default_rng(8)
    rows = near_groups(rng, [(int(k), int(m)) for k, m in zip(rng.integers(0, 3, 60), rng.integers(1, 12, 60))])
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(40)]
    rows += [(None, rows[0][1], rows[0][2]), (2000, rows[0][1], None), (2001, None, 1), (2002, [0.0] * 64, 1), (2003, [0.0] * 64, 1), (2004, [NAN] * 64, 1), (2005, [None, 1.0], 1), (2006, [], 1), (2007, [], 1), (2008, [-0.0, 1.0], 1), (2009, [0.0, 2.0], 1), (2009, [0.0, 2.0], 1), (2010, [1e300, 1e300], 1), (2011, [1e-300, 1e-300], 1), (2012, [1.0, INF], 1), (None, [7.0, -7.0, 0.0], 2)]
    table = spark.createDataFrame(rows, WIDE).select("*", *[F.lit(1).alias(c) for c in ("v", "d", "node", "run", "links")])
    got = near_vectors.near_vectors(table).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_near(rows), key=str)
    assert near_vectors.near_vectors(spark.createDataFrame([], WIDE)).count() == 0


def test_near_vectors_threshold(spark):
    """A cosine of exactly 0.98 links, one below does not."""
    a, b, c = [1.0] * 100 + [0.0] * 3, [0.0] * 2 + [1.0] * 100 + [0.0], [0.0] * 3 + [1.0] * 100
    got = near_vectors.near_vectors(spark.createDataFrame([(1, a, 1), (2, b, 1), (3, c, 1)], WIDE)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_near_vectors_recall_with_narrow_windows(spark):
    """Blocks of 32 among 6,000 vectors: the order has to bring near ones together."""
    rng = np.random.default_rng(9)
    rows = near_groups(rng, [(1, int(m)) for m in rng.integers(1, 12, 1000)], spread=(0.05, 0.14))
    want = {r[0]: r for r in brute_near(rows)}
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, WIDE), block=32).collect()}
    found, all_links = sum(r["n_links"] for r in got.values()), sum(r[1] for r in want.values())
    assert all(got[i]["n_links"] <= want[i][1] for i in want) and all_links > 10_000
    assert found > 0.97 * all_links
    assert np.mean([got[i]["component_id"] == want[i][2] for i in want]) > 0.98


def test_near_vectors_large_group(spark):
    """A group of near copies over many blocks stays one component, with links to its neighbours in each pass."""
    rng = np.random.default_rng(10)
    rows = near_groups(rng, [(1, 900), *[(1, 1)] * 300, (1, 2)], spread=(0.02, 0.03))
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, WIDE), block=64).collect()}
    want = {r[0]: r for r in brute_near(rows)}
    assert [got[i]["component_id"] for i in want] == [want[i][2] for i in want]
    assert all(got[i]["n_links"] <= want[i][1] for i in want) and min(got[i]["n_links"] for i in range(900)) >= 64
