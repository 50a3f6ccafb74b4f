"""Fill-in-middle transformation by a parallel automaton scan.

A text is cut into n tokens (`[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, from the left); two hashed draws
choose where prefix and middle end. A small automaton over bytes knows whether it stands in a word, and how much
of a mark `<P>`, `<S>` or `<M>` it has just read. A chunk of text is summarised, for every state it might begin in, as
the state it ends in, the tokens that end within it and the marks it completes. Such summaries compose
associatively, so a running composition over a text's chunks gives each its true first state and the tokens before it; then
each chunk that holds a cut finds it on its own. A text of at most `CHUNK` bytes is one chunk and is resolved
where it lies. A longer one is split: its chunks are scanned by any tasks, only summaries are grouped by text, and only the
chunks with cuts are opened again. Of a non-empty text, one token more ends than the scan counts: the last.

Nulls and edge cases: a null text is empty, and an empty one plain with n = 0; a null id is hashed as nothing; rows
that repeat are alike; texts without words are one token; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import binary_list, chunks, lean, ready, store
from docloom.llm.hashing import SPACE

#: Bytes of a chunk; a longer text is split.
CHUNK = 1 << 16
#: Fixed values of the contract: the marks' second bytes, the seed, and per cent of texts cut and of suffix-first order.
MARKS, SEED, CUT_PERCENT, SPM_PERCENT = b"PSM", 42, 50, 80
#: States: after white space or at the start, in a word, after `<`, after `<` and one of `MARKS`.
STATES = range(4)
#: The classes of bytes: white space, `<`, one of `MARKS`, `>`, others; and the state that follows each state and class.
CLASS = np.full(256, 4, np.uint8)
CLASS[SPACE], CLASS[ord("<")], CLASS[[*MARKS]], CLASS[ord(">")] = 0, 1, 2, 3
NEXT = np.array([[0, 2, 1, 1, 1], [0, 2, 1, 1, 1], [0, 2, 3, 1, 1], [0, 2, 1, 1, 1]])


class Summary(NamedTuple):
    """Of a chunk, by the state it begins in: the last state, tokens that end, marks; and its code points."""

    state: np.ndarray
    ends: np.ndarray
    marks: np.ndarray
    points: int

    def __add__(self, after: Summary) -> Summary:
        """This chunk and the one after it as one."""
        return Summary(after.state[self.state], self.ends + after.ends[self.state], self.marks + after.marks[self.state], self.points + after.points)


def token_ends(data: np.ndarray, state: int) -> np.ndarray:
    """Where, within a chunk that begins in this state, a token ends: at white space after a word."""
    space = SPACE[data]
    inner = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.concatenate(([0], inner)) if len(data) and space[0] and state else inner


def summary(chunk: bytes) -> Summary:
    """The chunk's summary. Beyond two bytes the automaton has forgotten where it began."""
    data = np.frombuffer(chunk, np.uint8)
    kind = CLASS[data]
    inner, marks = len(token_ends(data, 0)), int((kind[:-2] == 1) @ ((kind[1:-1] == 2) & (kind[2:] == 3)).astype(np.int64)) if len(data) > 2 else 0
    last, ends, seen = [], [], []
    for s in STATES:
        first, state = 0, s
        for k in kind[:2]:  # what the bytes before still matter to
            first += state == 3 and k == 3
            state = NEXT[state, k]
        if len(kind) > 2:
            state = 0
            for k in kind[-2:]:
                state = NEXT[state, k]
        last.append(int(state))
        ends.append(inner + int(len(kind) > 0 and kind[0] == 0 and s > 0))
        seen.append(marks + first)
    return Summary(np.array(last), np.array(ends), np.array(seen), int(((data & 0xC0) != 0x80).sum()))


def draws(doc_id: Column) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def units(h1, h2, n):
    """The tokens of the prefix, and of prefix and middle."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk each: n, marks, and the code points before the two cuts."""
    for batch in batches:
        raw = [b or b"" for b in binary_list(batch.column("text"))]
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        out = [[] for _ in range(4)]
        for i, j in chunks([len(b) for b in raw]):
            data = np.frombuffer(b"".join(raw[i:j]), np.uint8)
            edge = np.cumsum([0, *map(len, raw[i:j])])
            begin, end = edge[:-1], edge[1:]
            ends = token_ends(data, 0)
            ends = ends[~np.isin(ends, begin)]
            low, high = np.searchsorted(ends, begin), np.searchsorted(ends, end)
            n = np.where(end > begin, high - low + 1, 0)
            kind = CLASS[data]
            at = np.flatnonzero((kind[:-2] == 1) & (kind[1:-1] == 2) & (kind[2:] == 3)) if len(data) > 2 else np.zeros(0, int)
            of = np.searchsorted(edge, at, "right") - 1
            marks = np.bincount(of[at + 3 <= edge[of + 1]], minlength=j - i)
            upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            padded = np.append(ends, 0)
            out[0].append(n)
            out[1].append(marks)
            for k, u in enumerate(units(h1[i:j], h2[i:j], n)):
                place = np.where(u == 0, begin, np.where(u == n, end, padded[np.minimum(low + u - 1, len(ends))]))
                out[2 + k].append(upto[place] - upto[begin])
        columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("h3"), batch.column("h4"), *columns], ["doc_id", "text", "h3", "h4", "n", "marks", "cut1", "cut2"])


def _split(most: int) -> Callable:
    """Long texts to chunks of at most so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, h1, h2, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "h1", "h2")], binary_list(batch.column("text")), strict=True):
                for no in range(0, len(raw), most * 64):  # a bounded number of chunks at a time
                    parts = [raw[a : a + most] for a in range(no, min(len(raw), no + most * 64), most)]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts)), pa.array([h1] * len(parts), pa.int64()), pa.array([h2] * len(parts), pa.int64()), pa.array(range(no // most, no // most + len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["key", "h1", "h2", "no", "chunk"])

    return run


_SUMMED = "key string, h1 long, h2 long, no long, state array<long>, ends array<long>, marks array<long>, points long"
_CUTS = "key string, n long, marks long, cut int, no long, nth long, state long, before long"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [summary(b) for b in binary_list(batch.column("chunk"))]
        lists = [pa.array([getattr(s, c) for s in made], pa.list_(pa.int64())) for c in ("state", "ends", "marks")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "h1", "h2", "no")], *lists, pa.array([s.points for s in made], pa.int64())], ["key", "h1", "h2", "no", "state", "ends", "marks", "points"])


def _composed(own: pd.DataFrame) -> pd.DataFrame:
    """Of one text's summaries: n, marks, and for each cut its chunk, which token's end it is there, and what comes before.

    nth is null where the cut is at the text's start or end and `before` its place.
    """
    own = own.sort_values("no").drop_duplicates("no")
    total = Summary(np.array(STATES), np.zeros(len(STATES), int), np.zeros(len(STATES), int), 0)
    state, before, points = [], [], []
    for r in own.itertuples():
        state.append(int(total.state[0]))
        before.append(int(total.ends[0]))
        points.append(total.points)
        total = total + Summary(np.asarray(r.state), np.asarray(r.ends), np.asarray(r.marks), r.points)
    n = int(total.ends[0]) + 1
    rows = []
    for k, u in enumerate(int(x) for x in units(int(own["h1"].iloc[0]), int(own["h2"].iloc[0]), n)):
        i = int(np.searchsorted(before, u, "left")) - 1
        inside = 0 < u < n
        rows.append((own["key"].iloc[0], n, int(total.marks[0]), k, int(own["no"].iloc[i]) if inside else None, u - before[i] if inside else None, state[i] if inside else None, points[i] if inside else 0 if u == 0 else total.points))
    return pd.DataFrame(rows, columns=["key", "n", "marks", "cut", "no", "nth", "state", "before"]).astype({"no": "Int64", "nth": "Int64", "state": "Int64"})


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The code points before each cut, found in its chunk."""
    for batch in batches:
        at = []
        for chunk, nth, state, before in zip(binary_list(batch.column("chunk")), *[batch.column(c).to_pylist() for c in ("nth", "state", "before")], strict=True):
            data = np.frombuffer(chunk, np.uint8)
            at.append(before + int(((data[: token_ends(data, state)[nth - 1]] & 0xC0) != 0x80).sum()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "n", "marks", "cut")], pa.array(at, pa.int64())], ["key", "n", "marks", "cut", "at"])


def _long(long: DataFrame, chunk: int) -> DataFrame:
    """Texts of several chunks each: as `_resolved`."""
    parts = store(long.select("key", "h1", "h2", "text").mapInArrow(lean(_split(chunk)), "key string, h1 long, h2 long, no long, chunk binary"), "chunks")
    if parts.limit(1).count() == 0:
        return long.selectExpr("doc_id", "text", "h3", "h4", "CAST(NULL AS LONG) n", "CAST(NULL AS LONG) marks", "CAST(NULL AS LONG) cut1", "CAST(NULL AS LONG) cut2").limit(0)
    cuts = store(parts.mapInArrow(lean(_scanned), _SUMMED).groupBy("key").applyInPandas(_composed, _CUTS), "cuts")
    edges = cuts.where("nth IS NULL").select("key", "n", "marks", "cut", F.col("before").alias("at"))
    opened = parts.select("key", "no", "chunk").join(cuts.where("nth IS NOT NULL"), ["key", "no"]).mapInArrow(lean(_selected), "key string, n long, marks long, cut int, at long")
    each = edges.union(opened).groupBy("key").agg(F.max("n").alias("n"), F.max("marks").alias("marks"), *[F.max(F.when(F.col("cut") == k, F.col("at"))).alias(f"cut{k + 1}") for k in (0, 1)])
    return long.join(store(each, "cut-places"), "key").select("doc_id", "text", "h3", "h4", "n", "marks", "cut1", "cut2")


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output."""
    ready(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id")))
    size = F.octet_length("text")
    kind = dict(rows.dtypes)["doc_id"]
    short = rows.where(size <= chunk).mapInArrow(lean(_resolved), f"doc_id {kind}, text string, h3 long, h4 long, n long, marks long, cut1 long, cut2 long")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"), size.cast("string"))
    cut = short.union(_long(rows.where(size > chunk).withColumn("key", key), chunk))
    plain = (F.col("text") == "") | (F.col("marks") > 0) | (F.col("h3") % 100 >= CUT_PERCENT)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_PERCENT, "spm").otherwise("psm")
    one, two = F.col("cut1").cast("int"), F.col("cut2").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), one), F.substring("text", one + 1, two - one), F.substring("text", two + 1, F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)).otherwise(F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
    formed = cut.withColumn("form", form)
    return formed.select("doc_id", "n", "form", *[F.when(F.col("form") != "plain", x).alias(name) for name, x in (("prefix_chars", F.col("cut1")), ("middle_chars", F.col("cut2") - F.col("cut1")))], output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: the marks occur nowhere in a text that is cut."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
