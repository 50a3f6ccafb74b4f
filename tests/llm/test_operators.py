"""The training-data operators against brute force, round trips and held-out labels, with odd inputs."""

import collections
import contextlib
import hashlib
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ngram_join, packing, simple8b, suffix_dedup
from docloom.llm.common import configured

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, an empty-handed row, one long text."""
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n\r ", None, "a", 5), (4, "one", "de", "b", 3), (5, "one", "de", "b", 3), (5, "one", "de", "b", 3),
        (6, "one two", None, None, 7), (7, "é́ ΣΑΣ <|endoftext|> \x1c 1234", "es", "c", None), (8, "ab " * 2000, "en", "a", 6000), (9, "ab " * 2000, "en", "a", 6000),
        (10, "x" * 5000, "en", "a", 5000), (11, "😀 " * 50, "fr", "😀", 100), (None, "no id at all", None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, p, q):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and len(x & y) * q >= p * len(x | y):
                m, n = sorted((root(i), root(j)))
                up[n] = m
    return {i: (len(x), root(i)) for i, x in sets}


def copies(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k,p,q", [(3, 9, 10), (5, 8, 10)])
def test_ngram_join(spark, docs, odd, k, p, q):
    rng = np.random.default_rng(k)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    base = rows[0][1]
    rows += [(1000 + i, copies(base, rng, i % 9)) for i in range(40)] + [(1100 + i, " ".join(base.split()[:n])) for i, n in enumerate((1, 2, 3, 4, 12, 13, 30, 31))]
    rows += [(2000 + (r["doc_id"] or 500), r["text"]) for r in odd.collect() if r["doc_id"] != 5]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k, p, q).collect()}
    assert got == brute_components(rows, k, p, q)


def test_ngram_join_blocks(spark, docs, monkeypatch):
    """Groups over several blocks give the same components."""
    rng = np.random.default_rng(5)
    base = docs.select("text").first()[0][:1500]
    rows = [(i, copies(base, rng, i % 12)) for i in range(120)]
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_ngram_join_isolated_pairs(spark):
    """Pairs that share nothing with other documents, of sizes where one side needs common probes and the other none."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        n, like = int(rng.integers(10, 200)), rng.uniform(0.78, 0.95)
        own = [f"p{i}w{j}" for j in range(n + 4)]
        longer = own + [f"p{i}x{j}" for j in range(round(n * (1 / like - 1)))]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(longer))]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 10).collect()}
    want = brute_components(rows, 5, 8, 10)
    assert sum(c % 2 == 0 and c != i for i, (_, c) in want.items()) > 400
    assert got == want


def test_ngram_join_rows_are_known_by_id_and_text(spark):
    """One id with two texts, and rows without an id, lose no link."""
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    near = lambda t: copies(t, rng, 1)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (8, near(c)), (7, near(c)), (None, "all alone here"), (9, None)]
    got = sorted((tuple(r) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()), key=str)
    want = [(1, 118, 1), (1, 118, 1), (2, 118, 1), (3, 118, 1), (7, 118, 7), (8, 118, 7), (None, 118, 7), (None, 1, None), (9, 0, 9)]
    assert got == sorted(want, key=str)
    kept = ngram_join.keep_first(spark.createDataFrame([*rows, (7, rows[6][1]), (9, None)], "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), rows[6], (None, "all alone here"), (9, None), (9, None)], key=str)


def test_ngram_join_members_outside_the_largest_component(spark, monkeypatch):
    """A group over several blocks that holds components of several sizes."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i, edits in enumerate([2] * 40 + [14] * 60 + [20] * 40):
        rows.append((i, copies(" ".join(base), rng, edits)))
        if edits == 20 and i % 3 == 0:
            rows.append((1000 + i, copies(rows[-1][1], rng, 1)))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 9)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_components(spark):
    """Chains, stars, cycles and random graphs against union-find."""
    from docloom.llm.components import components

    rng = np.random.default_rng(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    edges += [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 300, (260, 2))]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        m, n = sorted((root(a), root(b)))
        up[n] = m
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first(spark, odd, none):
    kept = ngram_join.keep_first(odd.withColumn("extra", F.lit(1)))
    assert kept.columns == [*odd.columns, "extra"]
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 6, 7, 8, 10, 11]
    assert ngram_join.keep_first(none).count() == 0


def test_simple8b():
    rng = np.random.default_rng(0)
    for high in (1, 2, 16, 50257, 2**31, 2**60, 2**63):
        for n in (0, 1, 2, 59, 60, 61, 1000):
            v = rng.integers(0, high, n, dtype=np.uint64)
            assert (simple8b.decode(simple8b.encode(v), n) == v).all()
    mixed = np.array([0] * 70 + [2**64 - 1, 5, 2**62, 2**63, 1] + [3] * 33, np.uint64)
    assert (simple8b.decode(simple8b.encode(mixed), len(mixed)) == mixed).all()
    assert len(simple8b.encode(np.zeros(600, np.uint64))) == 10


def encode_all(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "words")])
def test_encoder_equals_whole_texts(docs, odd, name, mode):
    from docloom.llm.encoder import Encoder
    from docloom.llm.queries import tokenizer_path

    texts = [r["text"] for r in docs.select("text").limit(60).collect()] + [r["text"] for r in odd.collect()]
    texts += ["  a  b ", "a\n  b\n c \n\n d  ", "x \t y", "I'm 's  they're\r\n ok ", "  ", "\n", " a", "a ", "1234 56,78!? --- \x1c a \x1c\x1d b", "a b　c", "Straße ÉTÉ, naïve."]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(tokenizer_path(name), mode).encode(texts)]
    assert got == encode_all(name, texts)


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "words")])
def test_encoder_with_special_tokens_and_random_texts(name, mode):
    """Special tokens at the start, in the middle, at the end, doubled, cut short and next to spaces; 20,000 random texts."""
    from docloom.llm.encoder import Encoder
    from docloom.llm.queries import tokenizer_path

    rng = np.random.default_rng(17)
    e, s = "<|endoftext|>", "<|startoftext|>"
    texts = [t.replace("E", x) for x in (e, s, e.upper(), e[:-1]) for t in ("E", "xEy", "x Ey", "xE y", "x E y", " E", "E ", "  E  ", "EE", "E E", "x.E.", "E.", "a\nE\nb", "a,E", "é E é", "<E>", "<|endofE")]
    parts = np.array([e, s, "<|", "|>", " ", "  ", "\n", "a", "Word", "don't", "é", "ß", "42", ".", ",", "!?", "--", "\t", "한글", "😀", "x" * 30, "\x1c", "\u3000", "×"])
    texts += ["".join(parts[rng.integers(0, len(parts), int(rng.integers(0, 12)))]) for _ in range(20_000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(tokenizer_path(name), mode).encode(texts)]
    assert got == encode_all(name, texts)


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "words")])
def test_encoder_at_white_space_signs_and_long_pieces(name, mode):
    """Every white space of Unicode and its neighbours next to spaces and line feeds, long runs of punctuation, pieces too long to be joined."""
    from docloom.llm.encoder import Encoder
    from docloom.llm.queries import tokenizer_path

    rng = np.random.default_rng(23)
    spaces = [chr(x) for x in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0xFEFF)]
    parts = np.array([*spaces, *[" "] * 20, *["\n"] * 20, "Word", "naïve", "×", "a÷b", "İ", "–", "。", "…", "!" * 40, "it's", "'s", "x" * 64, "y" * 65, "é" * 40, "9" * 70, "<|endoftext|>", "end.", "a,b;", "😀"])
    texts = ["".join(parts[rng.integers(0, len(parts), int(rng.integers(0, 14)))]) for _ in range(20_000)]
    encoder = Encoder(tokenizer_path(name), mode)
    want = encode_all(name, texts)
    for _ in range(2):  # pieces are new, then in the table
        got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 256) for x in encoder.encode(texts[i : i + 256])]
        assert got == want


def test_encoder_calls_the_tokenizer_for_many_new_words_at_once():
    from docloom.llm.encoder import GROUP, Encoder
    from docloom.llm.queries import tokenizer_path

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"), "byte_level")
    encoder.plain = counted = Counted(encoder.plain)
    words = ["".join("aeioulnr"[int(x)] for x in f"{i:o}") for i in range(6400)]
    first, lines = " ".join(words), "\n".join(words)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([first, first])]
    assert got == encode_all("byte_bpe_50k.json", [first] * 2) and counted.texts <= 6400 // GROUP + 2
    counted.texts = 0
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([lines, lines])] == encode_all("byte_bpe_50k.json", [lines] * 2)
    assert counted.texts <= 6400 // GROUP + 3  # words after a line feed, not pairs of words around one
    # a vocabulary that has no ids for some bytes: pieces go one by one
    from tokenizers import Tokenizer, models, pre_tokenizers

    small = Tokenizer(models.BPE({"Ġ": 0, "a": 1, "b": 2, "Ġa": 3}, [("Ġ", "a")]))
    small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        small.save(f.name)
        got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(f.name, "byte_level").encode(["ab a\nb aé", "é", None])]
    assert got == [small.encode(x).ids for x in ("ab a\nb aé", "é", "")]


def test_token_files(spark, docs, odd, none):
    from docloom.llm.queries import tokenizer_path
    from docloom.llm.token_files import token_files

    path = tokenizer_path("byte_bpe_50k.json")
    both = docs.union(odd.withColumn("doc_id", F.col("doc_id") + 10_000)).union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted(((r["doc_id"], r["text"]) for r in both.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()), key=lambda x: (x[0] is not None, x))
    want, start = [], 0
    for (i, _), ids in zip(rows, encode_all("byte_bpe_50k.json", [t for _, t in rows])):
        ids = ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_files(both.withColumn("start", F.lit(1)), path).collect()), key=lambda x: x[1]) == want
    assert token_files(none, path).count() == 0


def test_top_k(spark):
    from docloom.llm.topk import top_k

    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = [(1000, None), (1001, [None] + [0.1] * 63), (1002, [float("nan")] * 64), (1003, [float("inf")] * 64), (1050, [0.5] * 3), (1051, [0.25] * 3), (None, [0.1] * 64)]
    e = e.union(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in top_k(e, F.col("vec_id") % 50 == 0).collect())
    rows = [(r[0], np.floor(256 * np.array(r[1], np.float32).astype(np.float64)).astype(int)) for r in e.collect() if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    want = []
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted(((-int(x @ y), i) for i, y in rows if i != q and len(y) == len(x)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    clash = [F.lit(1).alias(c) for c in ("v", "d", "cutoff", "score", "query_id")]
    assert top_k(e.select("*", *clash).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert sorted(tuple(r) for r in top_k(e.select("*", *clash), F.col("vec_id") % 50 == 0).collect()) == got


def test_top_k_saves_products(monkeypatch):
    """Phases over blocks give brute force's rows with fewer products than it takes; large components stay exact."""
    from docloom.llm import topk

    rng = np.random.default_rng(7)
    weight = np.repeat([10, 3, 1, 1], 16)  # as where the first components tell most
    centres = rng.integers(-90, 90, (40, 64)) * weight // 10
    for scale in (1, 2**21):
        vectors = (centres[rng.integers(0, 40, 2400)] + rng.integers(-9, 9, (2400, 64)) * weight // 3) * scale
        vectors = vectors.astype(np.float64) if scale == 1 else vectors.astype(np.int64)
        ids = np.arange(2400)
        work, k, blocks = collections.Counter(), 5, [topk.Block(ids[a : a + 800], vectors[a : a + 800]) for a in (0, 800, 1600)]
        q = np.arange(0, 2400, 50)
        first = [topk.leaders(topk.Block(ids[q], vectors[q]), b, k, work) for b in blocks]
        score, of = (np.concatenate([f[i] for f in first]) for i in (2, 0))
        cutoff = np.array([np.sort(score[of == x])[-k] for x in q], np.float64)
        last = [topk.resolved(topk.Block(ids[q], vectors[q], cutoff), b, k, work) for b in blocks]
        of, row, score = (np.concatenate([f[i] for f in last]) for i in range(3))
        exact = vectors.astype(object) if scale > 1 else vectors.astype(np.int64)
        for x in q.tolist():
            full = (exact @ exact[x]).astype(object)
            want = sorted((-int(full[i]), i) for i in range(2400) if i != x)[:k]
            mine = np.flatnonzero(of == x)
            assert sorted((-int(score[i]), int(row[i])) for i in mine)[:k] == want
        assert work["products"] < 0.8 * len(q) * 2400 * 64, work["products"] / (len(q) * 2400 * 64)


def test_quality(spark, docs, odd, none):
    from docloom.llm.quality import BIT, ablation, judge, ledger

    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 10_000))
    got = {r["doc_id"]: r for r in judge(both.select("*", *[F.lit(1).alias(c) for c in ("failed", "n_words", "kept")])).collect()}
    for r in both.collect():
        t = r["text"] or ""
        w = [x.decode() for x in WORD.findall(t.encode())]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = collections.Counter(windows)
        marked = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line.encode()):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked))
        x = got[r["doc_id"]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, r["doc_id"]
        assert x["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (x["kept"] and x["base_failed"])
    rows = ledger(both)
    by = {r["rule"]: r for r in ablation(rows, "web-2").collect()}
    assert by["few_words"]["failed"] == rows.where(F.col("failed").bitwiseAND(F.lit(BIT["few_words"])) != 0).count()
    assert ledger(none).count() == 0


def test_warc(spark, tmp_path):
    from docloom.llm.warc import archive, write_archives

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = [(1001, None, None), (1002, "http://a\r\nb", ""), (1003, "u", "same"), (1004, "u", "same"), (1005, "u", "same")]
    pages = pages.union(spark.createDataFrame(more, pages.schema))
    got = {r["page_id"]: r for r in archive(pages, roll=4096).collect()}
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    last = {}
    for i, x in rows:
        last[x] = max(i, last.get(x, i))
    import base64

    assert len(got) == len(rows)
    for i, x in rows:
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[x] == i else ("revisit", last[x]))
    assert archive(pages.limit(0)).count() == 0
    names = [sorted(r["name"] for r in write_archives(p.withColumn("refers_to", F.lit(1)), f"{tmp_path}/{i}", roll=4096).collect()) for i, p in enumerate((pages, pages.repartition(7), pages.repartition(3)))]
    assert names[0] == names[1] == names[2] and len(names[0]) > 8
    odd = spark.createDataFrame([(None, "u", "x"), (7, "a", "x"), (7, "b", "y"), (2**62, "c", "x"), (-(2**62), "d", None)], pages.schema)
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in archive(odd).collect()), key=str)
    assert rows == sorted([(None, "revisit", 2**62), (7, "revisit", 2**62), (7, "response", None), (2**62, "response", None), (-(2**62), "response", None)], key=str)


def test_range_bounds(spark):
    from docloom.llm.common import range_bounds, range_of

    for ids in (list(range(1000)), [5] * 50 + [6] * 3 + list(range(10**12, 10**12 + 900)) + [2**63 - 1, -(2**63)], [3], []):
        d = spark.createDataFrame([(i,) for i in ids] + [(None,)], "k long")
        bounds = range_bounds(d, "k", 8)
        assert bounds == range_bounds(d.repartition(5), "k", 8) == sorted(set(bounds))
        got = d.select("k", range_of(F.col("k"), bounds).alias("r")).collect()
        assert all(r["r"] == (0 if r["k"] is None else sum(b <= r["k"] for b in bounds)) for r in got)
        most = max(collections.Counter(r["r"] for r in got if r["k"] is not None).values(), default=0)
        assert most <= max(2 * -(-len(ids) // 8), max(collections.Counter(ids).values(), default=0))


def test_mixing(spark, docs, odd, none):
    from docloom.llm.mixing import mix, plan_mix

    both = docs.union(odd)
    rows = plan_mix(both).collect()
    assert len(rows) == both.count()
    size, names = collections.Counter(), sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
    for r in rows:
        size[r["source"]] += r["size"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, sum(size.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s] + 1e-9}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else share[s]
            left -= target[s]
        free -= over or free
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, plan_mix(both.repartition(5)).collect()))
    clash = [F.lit(i).alias(c) for i, c in enumerate(("size", "target", "rate", "copies", "copy", "row", "rank", "its_source"))]
    mixed = mix(both.select("*", *clash))
    assert mixed.columns[:5] == both.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert all(tuple(r)[5:] == tuple(range(8)) for r in mixed.collect())
    # what each source takes comes near its target: within five standard deviations of its draws
    taken, spread = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        f = r["rate"] % 1
        spread[r["source"]] += f * (1 - f) * r["size"] ** 2
    assert all(abs(taken[s] - target[s]) <= 5 * spread[s] ** 0.5 + 1e-6 for s in names)
    assert plan_mix(none).count() == 0 and mix(none).count() == 0


def test_mixing_rows_without_ids_and_equal_rows(spark, monkeypatch):
    """Each row is a draw of its own: with no id, with one id for all, and with equal texts too."""
    from docloom.llm import mixing

    for same_id, same_text in ((None, False), (7, False), (None, True), (7, True)):
        rows = [(same_id, "w " * 5 if same_text else f"w{i} w w w w", "ab"[i % 3 > 1], i % 2) for i in range(1200)]
        d = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
        plan = [r for r in mixing.plan_mix(d).collect()]
        assert len(plan) == 1200
        for s in "ab":
            own = [r for r in plan if r["source"] == s]
            f = own[0]["rate"] % 1
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5 * (len(own) * f * (1 - f) * 25) ** 0.5 + 1e-6
        count = lambda x: collections.Counter(tuple(r) for r in x.collect())
        once = count(mixing.mix(d))
        assert once == count(mixing.mix(d.repartition(7)))
        monkeypatch.setattr(mixing, "BROADCAST_KEYS", 0)
        assert once == count(mixing.mix(d))
        monkeypatch.undo()


def test_mixing_many_sources(spark, monkeypatch):
    """Ranks over partitions, and targets as rounds of resharing give them."""
    from docloom.llm import mixing

    rows = [(i, "w " * (i % 50), f"s{i % 97:02d}" if i % 97 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: r for r in mixing.plan_mix(d).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    got = {r["source"]: r for r in mixing.plan_mix(d).collect()}
    assert len(got) == 97 and all(got[s]["target"] == pytest.approx(want[s]["target"]) for s in want)


def test_packing_plan():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 3000):
        lengths = rng.integers(1, 4097, n)
        counts = collections.Counter(lengths.tolist())
        used = collections.Counter()
        plan = packing.plan_packing(dict(counts), 4096)
        for pattern, times in plan:
            assert sum(pattern) <= 4096
            for x in pattern:
                used[x] += times
        assert used == counts
        if n:
            assert sum(t for _, t in plan) <= 1.3 * -(-int(lengths.sum()) // 4096) + 1


def test_packing(spark, docs, odd, none):
    from docloom.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    both = docs.union(odd)
    rows = packing.pack(both.select("*", *[F.lit(1).alias(c) for c in ("length", "piece", "_slice", "_rank")]), path, capacity=64).collect()
    texts = [(r["doc_id"], r["text"]) for r in both.collect()]
    want = collections.Counter()
    for (i, _), ids in zip(texts, encode_all("word_bpe_49k.json", [t for _, t in texts])):
        ids = [*ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            x = np.array(ids[at : at + 64], "<u4")
            want[i, k, at, len(x), zlib.crc32(x.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(none, path).count() == 0


def brute_repeats(rows, width):
    times = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        times.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            if times[b[j : j + width]] > 1:
                gone[j : j + width] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_copies_of_one_text_are_dealt_to_many_tasks(spark):
    """Half of the rows are one text: the join that finds its copies is split at it, as nothing is aggregated between shuffle and join."""
    text = "one very common text " * 30
    rows = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.concat(F.lit(text), F.col("id").cast("string"))).alias("text"))
    profile = suffix_dedup.store(suffix_dedup._profile(rows.select(*suffix_dedup.keyed(F.col("id"), F.col("text")), "text"), 400), "profile")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    held |= {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "16k"}
    with contextlib.ExitStack() as stack:
        for key, value in held.items():
            stack.enter_context(configured(spark, key, value))
        marked = suffix_dedup._marked(profile, suffix_dedup._copies(profile, 400))
        got = marked.select("doc_id", "copy", "takes_part", F.spark_partition_id().alias("task"))
        found = got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["copy"], r["takes_part"]) for r in found} == {(i, i % 2 == 0, i % 2 == 1 or i == 0) for i in range(8000)}
    assert max(collections.Counter(r["task"] for r in found).values()) < 3000


def test_suffix_dedup(spark, docs, odd, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    base = rows[0][1]
    rows += [(5000 + i, f"{i} begins " + base[100 + 7 * i : 700 + 9 * i] + f" ends {i}") for i in range(12)] + [(6000, "y" * 400), (6001, "y" * 401), (6002, "z" * 400)]
    rows += [(None, "no id " + base[200:1300]), (None, "nor here " + base[700:1500]), (-1, "below " + base[150:1000])]
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 200)  # many boundaries
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 400)


def test_planted_passages_go_from_400_bytes_on(spark, tmp_path):
    """Passages of over 50 words go whole from all their documents if they have 400 bytes, and stay below; what is around them, and documents without one, stay."""
    from docloom.llm.queries import op9_suffix_dedup

    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    rows, expected = [], {}
    for size in (306, 399, 400, 401, 700):
        passage = words(130)[: size - 1] + "."
        assert len(passage) == size and len(passage.split()) > 50
        for i, (before, after) in enumerate(((0, 90), (90, 0), (90, 90))):  # a digit on either side ends the match
            text = f"{words(before)}{i}", f"{i}{words(after)}"
            rows.append((len(rows), text[0] + passage + text[1]))
            gone = size if size >= 400 else 0
            kept = "".join(text) if gone else rows[-1][1]
            expected[rows[-1][0]] = (len(rows[-1][1]), gone, int(gone > 0), hashlib.sha256(kept.encode()).hexdigest())
    for n in (1, 60, 300):
        rows.append((len(rows), words(n)))
        expected[rows[-1][0]] = (len(rows[-1][1]), 0, 0, hashlib.sha256(rows[-1][1].encode()).hexdigest())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(got) == len(rows) and {r[0]: tuple(r)[1:] for r in got} == expected


def test_strip_repeats(spark, odd, none):
    clash = ["_id", "_t", "kept", "t", "own_0", "row"]
    kept = suffix_dedup.strip_repeats(odd.select("*", *[F.lit(1).alias(c) for c in clash]), 200)
    assert kept.columns == [*odd.columns, *clash]
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 8 not in left and 9 not in left and left[7].startswith("é") and left[1] is None
    assert suffix_dedup.strip_repeats(none).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 20_000):
        a, b = rng.integers(-9, 9, n), rng.integers(-(2**62), 2**62, n)
        order = suffix_dedup.multikey_quicksort([a, b], leaf=16)
        assert (order.size == n) and sorted(zip(a, b)) == list(zip(a[order], b[order]))


def test_language(spark, odd, none):
    from docloom.llm.langid import identify

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    small = {r["doc_id"]: r for r in identify(odd).collect()}
    assert len(small) == 12 and small[1]["lang_pred"] == small[2]["lang_pred"] == small[3]["lang_pred"] == "und"
    assert identify(none.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(1))).count() == 0


def test_language_masks_of_many_languages(spark):
    """More than 64 languages, each learned; counts equal brute force up to the filters' false positives."""
    from docloom.llm import langid

    rng = np.random.default_rng(11)
    words = {f"l{i:02d}": ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(30)] for i in range(70)}
    rows = [(100 * i + j, " ".join(rng.choice(w, 40)), name) for i, (name, w) in enumerate(words.items()) for j in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 0.99 * len(rows)
    model = langid.fit(d)
    learned = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, text, lang in rows:
        for g in langid.grams([text.encode()])[0].tolist():
            learned[g][lang].add(i)
    h, of = langid.grams([t.encode() for _, t, _ in rows[:50]])
    hits = model.hits(h, of, 50)
    for k, name in enumerate(model.languages):
        share = [len(learned[g].get(name, ())) / 12 for g in h.tolist()]
        top = [max(len(x) for x in learned[g].values()) / 12 for g in h.tolist()]
        want = np.bincount(of, weights=[s >= max(langid.COMMON, langid.RATIO * t) for s, t in zip(share, top)], minlength=50)
        assert (hits[:, k] >= want).all() and (hits[:, k] - want).sum() <= 3 + 2 * model.wrong[k] * len(h)


def test_toxicity(spark, odd, none):
    from docloom.llm.toxicity import toxicity

    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity(d, labels, spans=True).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert any(r["spans"] for r in got if r["predicted"])
    few = spark.createDataFrame([(4, 1, None), (5, 0, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity(odd.select("*", *[F.lit(1).alias(c) for c in ("score", "predicted", "toxic", "n")]), few).count() == odd.count()
    assert toxicity(none, few).count() == 0


def test_toxicity_sample_keeps_both_classes(spark, monkeypatch):
    """Neither a very long document early in the order nor rare labels take the toxic documents' place."""
    from docloom.llm import toxicity
    from docloom.llm.langid import held_out

    ids = spark.range(1, 601).withColumnRenamed("id", "doc_id").where(~held_out()).orderBy(F.xxhash64(F.lit(3), "doc_id")).collect()
    ids = [r["doc_id"] for r in ids]
    toxic = set(ids[5::40])
    rng = np.random.default_rng(6)
    text = {i: " ".join(f"{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}plain" for x in rng.integers(0, 17_576, 60)) + " vilest" * (i in toxic) for i in ids}
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int")
    seen = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda texts, y: seen.append((sum(map(len, texts)), int(y.sum()), int((~y).sum()))) or learn(texts, y))

    with monkeypatch.context() as m:
        m.setattr(toxicity, "FIT_BYTES", 60_000)
        toxicity.fit(spark.createDataFrame(list(text.items()), "doc_id long, text string"), labels)
    size, n_toxic, n_clean = seen.pop()
    assert n_toxic == len(toxic) and n_clean > 60 and size <= 60_000

    text[ids[0]] = "plain " * (toxicity.FIT_BYTES // 5)
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    assert seen.pop()[1:] == (len(toxic), len(ids) - len(toxic) - 1)
    got = toxicity.keep_clean(docs, model).select("doc_id").collect()
    assert {r["doc_id"] for r in got} == set(ids) - toxic


def test_toxicity_learns_in_little_memory(monkeypatch):
    """The driver holds a few numbers for each token it learns from; slices and blocks leave the model as it is."""
    import tracemalloc

    from docloom.llm import toxicity

    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, n)) for n in rng.integers(3, 10, 3_000)]
    texts = [" ".join(words[x] for x in rng.integers(0, len(words), 500)) for _ in range(800)]
    toxic = np.arange(len(texts)) % 4 == 0
    texts = [(t + " vilest words" if bad else t).encode() for t, bad in zip(texts, toxic)]
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        model = toxicity.learn(texts, toxic, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 11 * size, peak / size  # 20 where all tokens' features and all chains' marginals were held at once
    whole = toxicity.learn(texts, toxic)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 70_000)
    monkeypatch.setattr(toxicity, "BLOCK_CHAINS", 61)
    cut = toxicity.learn(texts, toxic)
    assert (cut.keys == whole.keys).all() and np.allclose(cut.weights, whole.weights, atol=1e-8) and np.allclose(cut.link, whole.link, atol=1e-8)
    _, _, of, keys = toxicity.tokens(texts)
    assert ((cut.scores(of, cut.marginals(of, keys), len(texts)) > 0.5) == toxic).all()
    assert not len(toxicity.learn([b"no word twice", b""], np.array([True, False])).keys)  # failed where no key was repeated


def test_field_marginals_by_enumeration():
    from itertools import product

    from docloom.llm.toxicity import forward_backward

    rng = np.random.default_rng(4)
    unary, trans = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weight, mass = np.zeros(5), 0.0
    for y in product((0, 1), repeat=5):
        w = np.exp(sum(u * k for u, k in zip(unary[0], y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        mass += w
        weight += w * np.array(y)
    got, pairs = forward_backward(unary, trans, np.array([5]))
    assert got[0] == pytest.approx(weight / mass) and pairs.sum() == pytest.approx(4)


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_warc", "op6_mix_sources", "op12_fill_in_middle", "op13_near_vectors"])
def test_query_matches_sql(spark, name):
    from pathlib import Path

    import duckdb

    from docloom.llm import queries

    db = duckdb.connect()
    for p in Path("/root/testdata/sf0.01").glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)


def test_pipeline(spark, docs, odd, none):
    """Every stage keeps the columns, also with odd rows and names; empty tables stay empty."""
    import corpus_pipeline
    from docloom.llm.common import clean, store

    d = docs.union(odd).select("*", *[F.lit(i).alias(c) for i, c in enumerate(("t", "copy", "kept", "row", "size", "id"))])
    for name, stage in corpus_pipeline.STAGES:
        columns = d.columns
        d = store(stage(spark, d, SF), name)
        assert d.count() and (name == "best_fit_packing" or d.columns == columns)
        assert stage(spark, none, SF).count() == 0
    assert {"doc_id", "sequence_id", "offset"} <= set(d.columns)
    clean(spark)


def test_pipeline_by_brute_force(spark, docs):
    """What each filtering stage keeps of its own input, and what the last stages do with it."""
    import corpus_pipeline
    from docloom.llm.common import store
    from docloom.llm.mixing import plan_mix

    stages, texts = dict(corpus_pipeline.STAGES), lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    d = store(stages["toxicity"](spark, docs, SF), "t")
    before = texts(d)
    groups = brute_components(list(before.items()), 5, 8, 10)
    d = store(stages["ngram_jaccard_join"](spark, d, SF), "t")
    kept = texts(d)
    assert kept == {i: t for i, t in before.items() if groups[i][1] == i}
    d = store(stages["suffix_array_dedup"](spark, d, SF), "t")
    width, times = corpus_pipeline.PASSAGE_BYTES, collections.Counter()
    for t in kept.values():
        b = (t or "").encode()
        times.update(b[i : i + width] for i in range(len(b) - width + 1))
    want = {}
    for i, t in kept.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            if times[b[j : j + width]] > 1:
                gone[j : j + width] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else t
        if not gone.any() or WORD.search(left.encode()):
            want[i] = left
    assert texts(d) == want
    plan = {r["doc_id"]: r["copies"] for r in plan_mix(d).collect()}
    mixed = store(stages["mixing"](spark, d, SF), "t")
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert got == collections.Counter({i: n for i, n in plan.items() if n})
    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == got
