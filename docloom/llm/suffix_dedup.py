"""Removal of repeated byte strings by a distributed suffix sort.

Every byte that lies in a string of `width` bytes which also starts elsewhere goes. In suffix terms: suffix
i is repeated if it shares `width` leading bytes with a neighbour in sorted order.

Suffixes travel in families, not one by one. Each window of `width` bytes has an anchor, its least hashed
gram; windows with equal bytes have equal anchors at equal distances. Families are the up to `FAMILY`
successive suffixes with one anchor, aligned by their distance from it. Suffixes whose anchor occurs once
in the corpus are unique and drop out by a count. A family has two tokens: the bytes that all its suffixes
share (core), and all of its bytes (whole), hashed.

* Sampled splitters range-partition the families by (core, whole, place), so that even a passage which a
  third of all documents share is spread over many buckets.
* Buckets sort locally by multikey quicksort over the tokens and compare neighbours; first and last rows of
  adjacent buckets, two per bucket, are compared across the boundaries.
* A family with an equal neighbour is repeated throughout; one whose core stands alone not at all. Where
  neighbours share only the core (at the ends of a match), both are taken apart into single suffixes with
  two hashed tokens of `width` bytes, which are sorted in the same way. Every different family of a core
  has such a neighbour, so each takes part there.

Matches are judged on the input, never cross documents, and may overlap, also within a document. Tokens are
128 bits in all where they decide. Copies of a whole document are found by their fingerprint and take part
once.

Rows are known by their id and the hash of their text, whose last bit says whether there is an id.

Nulls and edge cases: null text counts as empty; texts under `width` bytes keep all; repeated rows are
copies of each other; rows without an id take part like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import hashing
from docloom.llm.common import binary_list, chunks, drop, lean, list_array, partitions_of, ready, store

U = np.uint64
GRAM = 64
FAMILY = 64
#: Rows of a bucket: more rows, more buckets.
BUCKET_ROWS = 1_000_000
#: Up to so many documents are picked out by broadcasting their ids; more by a shuffle.
BROADCAST_IDS = 200_000
#: A text is hashed in stretches of so many bytes.
STRETCH = 1 << 19
_PLACE = (1 << 24) - 1


def _windows_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Runs:
    """Texts one after another, and the runs of window starts that have the same anchor."""

    def __init__(self, texts: list[bytes], width: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.pre = hashing.prefix(self.data)
        starts = np.maximum(sizes - width + 1, 0)
        self.doc = self.anchor = self.low = self.high = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        if not starts.sum():
            return
        at = np.arange(len(self.data) - GRAM + 1)
        grams = hashing.spans(self.pre, at, at + GRAM)
        found = _windows_min((grams & ~U(_PLACE)) | at.astype(np.uint64), width - GRAM + 1)
        first = np.cumsum(starts) - starts
        doc = np.repeat(np.arange(len(texts)), starts)
        start = np.arange(len(doc)) - first[doc] + self.begin[doc]
        anchor = (found[start] & U(_PLACE)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
        tail = np.concatenate((head[1:], [len(doc)])) - 1
        self.doc, self.anchor, self.low, self.high = doc[head], anchor[head], start[head], start[tail]
        self.gram = grams[self.anchor]


def _stretches(text: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """Overlapping parts of a long text: every window lies in one."""
    for a in range(0, max(1, len(text) - width + 1), STRETCH):
        yield a, text[a : a + STRETCH + width - 1]


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, t, text) -> doc_id, t, n_bytes, f1, f2, sha256, anchors (hashes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in binary_list(batch.column(2))]
            for a, b in chunks([len(t) for t in texts]):
                own = texts[a:b]
                parts, of = [], []
                for i, t in enumerate(own):
                    for _, x in _stretches(t, width):
                        parts.append(x)
                        of.append(i)
                doc, gram = [], []
                for c, d in chunks([len(x) for x in parts], 2 * STRETCH):
                    r = Runs(parts[c:d], width)
                    doc.append(np.array(of[c:d], np.int64)[r.doc])
                    gram.append(r.gram)
                counts = np.bincount(np.concatenate(doc), minlength=len(own))
                digests = [hashlib.sha256(t) for t in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(t) for t in own], pa.int64())]
                    + [pa.array([int.from_bytes(x.digest()[k : k + 8], "little", signed=True) for x in digests], pa.int64()) for k in (0, 8)]
                    + [pa.array([x.hexdigest() for x in digests]), list_array(np.concatenate(gram).view(np.int64), counts)],
                    ["doc_id", "t", "n_bytes", "f1", "f2", "sha256", "anchors"],
                )

    return docs.mapInArrow(lean(make), "doc_id long, t long, n_bytes long, f1 long, f2 long, sha256 string, anchors array<long>")


_ROWS = "doc_id long, t long, at long, many int, t1 long, t2 long"


def _rows(doc_id, t, at, many, t1, t2) -> pa.RecordBatch:
    arrays = [pa.array(doc_id, pa.int64()), pa.array(t, pa.int64()), pa.array(at), pa.array(many, pa.int32()), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "t", "at", "many", "t1", "t2"])


def _families(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, t, text, shared: anchors) -> families of suffixes that have a shared anchor."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_list(batch.column(2))
            shared = [np.array(x, np.int64).view(np.uint64) for x in batch.column(3).to_pylist()]
            parts = [(i, a, x) for i, text in enumerate(texts) for a, x in _stretches(text or b"", width)]
            for c, d in chunks([len(x[2]) for x in parts]):
                own = parts[c:d]
                r = Runs([x[2] for x in own], width)
                row = np.array([x[0] for x in own], np.int64)[r.doc]
                keep = np.zeros(len(r.doc), bool)
                edge = hashing.runs(row)
                for a, b in zip(edge, [*edge[1:], len(row)]):
                    keep[a:b] = np.isin(r.gram[a:b], shared[row[a]])
                doc, anchor, low, high = r.doc[keep], r.anchor[keep], r.low[keep], r.high[keep]
                if not len(doc):
                    continue
                first, last = (anchor - high) // FAMILY, (anchor - low) // FAMILY
                n = last - first + 1
                doc, anchor, low, high = (np.repeat(x, n) for x in (doc, anchor, low, high))
                b = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                start, end = np.maximum(anchor - FAMILY * b - FAMILY + 1, low), np.minimum(anchor - FAMILY * b, high)
                core = anchor - FAMILY * b
                t1 = hashing.mix(hashing.spans(r.pre, core, core + width - FAMILY + 1) + b.astype(np.uint64))
                t2 = hashing.mix(hashing.spans(r.pre, start, end + width) + hashing.mix(((core - start) * 4096 + end - start).astype(np.uint64)))
                of = [own[x] for x in doc.tolist()]
                at = start - r.begin[doc] + np.array([x[1] for x in of])
                yield _rows([ids[x[0]] for x in of], [ts[x[0]] for x in of], at, end - start + 1, t1, t2)

    return docs.mapInArrow(lean(make), _ROWS)


def _single(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, t, text, spans: array<struct<at, many>>) -> one row for each suffix of the spans."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, t, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_list(batch.column(2)), batch.column(3).to_pylist()):
                for begin, part in _stretches(text, width):
                    mine = [(x["at"] - begin, x["many"]) for x in spans if begin <= x["at"] < begin + STRETCH]
                    if not mine:
                        continue
                    at = np.concatenate([np.arange(a, a + n) for a, n in mine])
                    data = np.frombuffer(part, np.uint8)
                    tokens = [hashing.spans(hashing.prefix(data, table), at, at + width) for table in (hashing.BYTE, hashing.BYTE_2)]
                    yield _rows([doc_id] * len(at), [t] * len(at), at + begin, np.ones(len(at), np.int32), *tokens)

    return docs.mapInArrow(lean(make), _ROWS)


def multikey_quicksort(columns: list[np.ndarray], leaf: int = 4096) -> np.ndarray:
    """The order of rows by their tokens: three-way partitions on one token, the equal part on the next."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(columns):
            continue
        own = order[a:b]
        if b - a <= leaf:
            order[a:b] = own[np.lexsort([c[own] for c in columns[depth:][::-1]])]
            continue
        key = columns[depth][own]
        pivot = np.partition(key[:: max(1, len(key) // 63)], 31)[31] if len(key) > 63 else key[len(key) // 2]
        less, more = key < pivot, key > pivot
        n, m = int(less.sum()), int(more.sum())
        order[a:b] = np.concatenate((own[less], own[~(less | more)], own[more]))
        todo += [(a, a + n, depth), (a + n, b - m, depth + 1), (b - m, b, depth)]
    return order


def sort_suffixes(rows: DataFrame, tag: str) -> DataFrame:
    """rows (stored) -> doc_id, t, at, many, same, turn; stored.

    same: a neighbour has the same t1 and t2; turn: a neighbour has the same t1 and another t2.
    """
    n = max(partitions_of(rows), -(-rows.count() // BUCKET_ROWS))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        t1, t2 = (table.column(c).to_numpy() for c in ("t1", "t2"))
        order = multikey_quicksort([t1, t2])
        t1, t2 = t1[order], t2[order]
        next1 = t1[1:] == t1[:-1]
        next2 = next1 & (t2[1:] == t2[:-1])
        turn, same = (np.concatenate((x, [False])) | np.concatenate(([False], x)) for x in (next1 & ~next2, next2))
        edge = np.zeros(len(t1), np.int32)
        edge[0] += 1
        edge[-1] += 2
        table = table.take(pa.array(order))
        out = table.select(["doc_id", "t", "at", "many", "t1", "t2"]).append_column("turn", pa.array(turn)).append_column("same", pa.array(same))
        out = out.append_column("edge", pa.array(edge)).append_column("bucket", pa.array(np.full(len(t1), TaskContext.get().partitionId(), np.int32)))
        yield from out.to_batches(max_chunksize=50_000)

    done = store(rows.repartitionByRange(n, "t1", "t2", "doc_id", "at").mapInArrow(lean(bucket), _ROWS + ", turn boolean, same boolean, edge int, bucket int"), tag)
    # two rows a bucket at most: the last of one bucket against the first of the next that has rows
    ends = done.where("edge > 0").withColumn("_e", F.explode(F.expr("CASE edge WHEN 3 THEN array(1, 2) ELSE array(edge) END")))
    by_place = Window.orderBy("bucket", "_e")
    other = lambda f: [f(c).over(by_place) for c in ("t1", "t2", "_e")]
    (p1, p2, pe), (n1, n2, ne) = other(F.lag), other(F.lead)
    back, ahead = (F.col("_e") == 1) & (pe == 2), (F.col("_e") == 2) & (ne == 1)
    ends = ends.select("doc_id", "t", "at", "bucket", ((back & (p1 == F.col("t1")) & (p2 != F.col("t2"))) | (ahead & (n1 == F.col("t1")) & (n2 != F.col("t2")))).alias("b1"), ((back & (p1 == F.col("t1")) & (p2 == F.col("t2"))) | (ahead & (n1 == F.col("t1")) & (n2 == F.col("t2")))).alias("b2"))
    ends = ends.groupBy(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "t", "at", "bucket")]).agg(F.max("b1").alias("b1"), F.max("b2").alias("b2"))
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t") == F.col("_t")) & (F.col("at") == F.col("_at")) & (F.col("bucket") == F.col("_bucket"))
    joined = done.join(F.broadcast(ends), on, "left")
    out = joined.select("doc_id", "t", "at", "many", (F.col("turn") | F.coalesce("b1", F.lit(False))).alias("turn"), (F.col("same") | F.coalesce("b2", F.lit(False))).alias("same"))
    out._docloom_path = done._docloom_path
    return out


def _with_text(docs: DataFrame, per: DataFrame, value: str) -> DataFrame:
    """docs(doc_id, t, text) joined with a stored per(doc_id, t, value)."""
    keys = per.select("doc_id", "t")
    if per.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(keys), ["doc_id", "t"], "left_semi")
    return docs.dropDuplicates(["doc_id", "t"]).join(per, ["doc_id", "t"]).select("doc_id", "t", "text", value)


_WHOLE = ["f1", "f2", "n_bytes"]


def _copies(profile: DataFrame, width: int) -> DataFrame:
    """The fingerprints that several documents have. Stored, so that the join with them begins with a scan and can be split at a hot one."""
    return store(profile.where(F.col("n_bytes") >= width).groupBy(*_WHOLE).agg(F.count("*").alias("c"), F.min("doc_id").alias("rep")).where("c > 1"), "copies")


def _marked(profile: DataFrame, copies: DataFrame) -> DataFrame:
    """The profile with copy, and whether the document takes part: one of each group of copies does."""
    marked = profile.join(copies, _WHOLE, "left").withColumn("copy", F.col("c").isNotNull())
    return marked.select("doc_id", "t", "n_bytes", "sha256", "copy", (~F.col("copy") | F.col("doc_id").eqNullSafe(F.col("rep"))).alias("takes_part"), "anchors")


def repeated_spans(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, t, text) -> the documents' profile with `copy`, and doc_id, t, spans of repeated starts. Stored."""
    profile = store(_profile(docs, width), "profile")
    copies = _copies(profile, width)
    marked_s = store(_marked(profile, copies), "marked")
    drop(profile, copies)
    anchors = marked_s.where("takes_part").select("doc_id", "t", F.explode("anchors").alias("h"))
    shared = store(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "anchors")  # the join can be split at hot anchors
    per = store(anchors.join(shared, "h").groupBy("doc_id", "t").agg(F.collect_set("h").alias("shared")), "shared")
    families = store(_families(_with_text(docs, per, "shared"), width), "families")
    sorted_1 = sort_suffixes(families, "sorted")
    mixed = store(sorted_1.where("turn").groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "many")).alias("spans")), "mixed")
    single = store(_single(_with_text(docs, mixed, "spans"), width), "suffixes")
    sorted_2 = sort_suffixes(single, "sorted")
    found = sorted_1.where("same").select("doc_id", "t", "at", "many").union(sorted_2.where("same").select("doc_id", "t", "at", "many"))
    spans = store(found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "many")).alias("spans")), "spans")
    drop(shared, per, families, sorted_1, mixed, single, sorted_2)
    return marked_s, spans


def keyed(doc_id: Column, text: Column) -> list[Column]:
    """doc_id (-1 for none) and t, neither null, by which a row is known; t is odd where there is no id."""
    t = F.shiftleft(F.xxhash64(text), 1).bitwiseOR(doc_id.isNull().cast("long"))
    return [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("doc_id"), t.alias("t")]


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """docs(doc_id, text) -> doc_id, t (see `keyed`), n_bytes, n_removed, n_spans, kept_sha256, kept (the text left, without characters that lost a byte; null where all or nothing went). Stored.
    """
    ready(docs.sparkSession)
    docs = docs.select(*keyed(F.col("doc_id"), F.col("text")), "text")
    marked, spans = repeated_spans(docs, width)
    empty = hashlib.sha256().hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, t, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_list(batch.column(2)), batch.column(3).to_pylist()):
                step = np.zeros(len(text) + 1, np.int32)
                low = np.array([x["at"] for x in own])
                np.add.at(step, low, 1)
                np.add.at(step, low + np.array([x["many"] for x in own]) - 1 + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for to, x in zip(out, (doc_id, t, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                    to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "t", "removed", "runs", "sha", "kept"])

    done = _with_text(docs, spans, "spans").mapInArrow(lean(cut), "doc_id long, t long, removed long, runs long, sha string, kept string")
    joined = marked.join(done, ["doc_id", "t"], "left")
    count = lambda whole, part: F.when(F.col("copy"), whole).otherwise(F.coalesce(part, F.lit(0))).cast("long")
    out = store(
        joined.select(
            F.when(F.col("t") % 2 == 0, F.col("doc_id")).alias("doc_id"), "t", "n_bytes",
            count(F.col("n_bytes"), F.col("removed")).alias("n_removed"),
            count(F.lit(1), F.col("runs")).alias("n_spans"),
            F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("sha", "sha256")).alias("kept_sha256"),
            F.when(~F.col("copy"), F.col("kept")).alias("kept"),
        ),
        "kept",
    )
    drop(marked, spans)
    return out


def strip_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """The documents, with all their columns, without repeated strings; n_chars follows where there is one.

    A character that loses a byte goes as a whole. Documents that keep no word, and had one, go.
    """
    done = remove_repeats(docs, width).where("n_removed > 0")
    rest = done.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "t").agg(F.coalesce(F.first("kept"), F.lit("")).alias("kept"))
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(f"own_{i}") for i, c in enumerate(keyed(F.col("doc_id"), F.col("text")))])
    joined = rows.join(rest, (F.col("own_0") == F.col("doc_id")) & (F.col("own_1") == F.col("t")), "left")
    joined = joined.where("kept IS NULL OR kept RLIKE '[^ \\t-\\r]'")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    old = lambda c: F.col("row").getField(c)
    return joined.select(*[(F.when(F.col("kept").isNotNull(), new[c]).otherwise(old(c)) if c in new else old(c)).alias(c) for c in docs.columns])
