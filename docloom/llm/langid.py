"""Language identification by bit-sliced Bloom filters of n-grams.

Each language has a filter of the n-grams that are common in it. The filters are sliced by language: a slot
holds one bit per language, so a lookup returns, as one mask, all languages that contain an n-gram. A
document's n-grams are counted per language, each count is corrected by that filter's rate of false
positives, and the largest corrected share decides.

Learning takes up to `FIT_DOCS` labelled documents, the ones with the least hash of their id, and at least
`FIT_LEAST` of each language that has as many, so it costs the same at any size; a gram belongs to a language
if it is in at least `COMMON` of its documents and its share there is at least `RATIO` of its largest share.
A mask has a word of 64 bits for each 64 languages.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0; with no language learned
all are; a text of which no gram is known gets the most frequent language with score 0. Of languages with equal
corrected counts the first by code point is taken. Repeated rows are predicted one by one; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import hashing
from docloom.llm.common import binary_list, chunks, lean, ready

FIT_DOCS, FIT_LEAST = 20_000, 200
GRAMS = (3, 5)
COMMON, RATIO = 0.01, 0.25
SLOTS_LOG2, HASHES, WORD = 22, 3, 64
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case; other ASCII characters are gaps.
_FOLD = bytes(i if 97 <= i < 123 or i >= 128 else i + 32 if 65 <= i < 91 else 32 for i in range(256))
U = np.uint64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each text, none across its end, and the text's index."""
    data = np.frombuffer(b" ".join(t.translate(_FOLD) for t in texts), np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    end = begin + [len(t) for t in texts]
    pre = hashing.prefix(data)
    gap = np.concatenate(([0], np.cumsum(data == 32)))
    out, of = [], []
    for n in GRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        at = at[gap[at + n] - gap[at] <= 1]  # at most one gap
        own = np.searchsorted(begin, at, "right") - 1
        within = at + n <= end[own]
        at, own = at[within], own[within]
        out.append(hashing.spans(pre, at, at + n))
        of.append(own)
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Model:
    languages: list[str]
    slots: list[np.ndarray]  # a mask of languages each, for every word of languages
    wrong: np.ndarray  # rate of false positives by language
    frequent: int

    def hits(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """How many grams of each of n texts each language contains: the languages of a gram come as one mask."""
        out = []
        for slots in self.slots:
            found = slots[_places(h, 0)]
            for i in range(1, HASHES):
                found = found & slots[_places(h, i)]
            one = found.dtype.type(1)
            for i in range(min(WORD, len(self.languages) - len(out))):
                out.append(np.bincount(of[(found >> found.dtype.type(i) & one).astype(bool)], minlength=n))
        return np.stack(out, 1)


def _places(h: np.ndarray, i: int) -> np.ndarray:
    size = U((1 << SLOTS_LOG2) - 1)
    return h & size if not i else (h >> U(21 * i)) * U(2 * i + 1) + h & size


def build(languages: list[str], counts: dict[str, int], h: np.ndarray, member: np.ndarray) -> Model:
    """h: gram hashes; member: a row of masks for each, a word for every 64 languages."""
    slots, fill = [], []
    for w in range(-(-len(languages) // WORD)):
        own = languages[w * WORD : w * WORD + WORD]
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(own) <= np.dtype(t).itemsize * 8)
        slots.append(np.zeros(1 << SLOTS_LOG2, kind))
        for i in range(HASHES):
            np.bitwise_or.at(slots[w], _places(h, i), member[:, w].astype(kind))
        fill += [(slots[w] >> kind(i) & kind(1)).mean() for i in range(len(own))]
    return Model(languages, slots, np.array(fill) ** HASHES, int(np.argmax([counts[x] for x in languages])) if languages else 0)


def fit(docs: DataFrame, most: int = FIT_DOCS) -> Model:
    """Learns from docs(doc_id, text, lang) without nulls."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    total = sum(sizes.values())
    # the least hashes of each language, about as many as the bound
    part = {x: min(1.0, max(most / total, FIT_LEAST / n)) for x, n in sizes.items()}
    bound = [F.lit(x) for k, v in part.items() if v < 1 for x in (k, int(-(2**63) + 2**64 * v))]
    own = labelled.where(F.col("h") < F.coalesce(F.try_element_at(F.create_map(*bound), F.col("lang")), F.lit(2**63 - 1))) if bound else labelled
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counts = {x: counts.get(x, 0) for x in languages}
    at = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = binary_list(batch.column(0)), batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                h, of = grams(texts[a:b])
                lang = np.array([at.get(x, -1) for x in langs[a:b]])
                order = np.lexsort((of, h))  # once per document
                g, d = h[order], of[order]
                edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))) if len(g) else order
                g, x = g[edge], lang[d[edge]]
                order = np.lexsort((x, g))
                g, x = g[order], x[order]
                edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))) if len(g) else order
                n = np.diff(np.concatenate((edge, [len(g)])))
                yield pa.RecordBatch.from_arrays([pa.array(g[edge].view(np.int64)), pa.array(x[edge], pa.int32()), pa.array(n)], ["g", "l", "n"])

    if not languages:
        return build([], {}, np.zeros(0, np.uint64), np.zeros((0, 0), np.uint64))
    rows = own.select("text", "lang").mapInArrow(lean(count), "g long, l int, n long")
    # a row for each gram and language: shares, and of each gram those that count
    per = rows.groupBy("g", "l").agg(F.sum("n").alias("n"))
    size = F.element_at(F.array(*[F.lit(float(max(1, counts[x]))) for x in languages]), F.col("l") + 1)
    per = per.withColumn("s", F.col("n") / size).where(F.col("s") >= COMMON)
    listed = per.groupBy("g").agg(F.max("s").alias("top"), F.collect_list(F.struct("l", "s")).alias("e"))  # at most one entry a language
    kept = F.transform(F.filter("e", lambda x: x["s"] >= RATIO * F.col("top")), lambda x: x["l"])
    # grams of at least COMMON of a language's documents: their number is bounded by grams of a document / COMMON
    chosen = listed.select("g", kept.alias("k")).toArrow()
    k = chosen.column("k").combine_chunks()
    l = k.flatten().to_numpy().astype(np.int64)  # noqa: E741
    member = np.zeros((len(k), -(-len(languages) // WORD)), np.uint64)
    np.bitwise_or.at(member, (np.repeat(np.arange(len(k)), k.value_lengths().to_numpy()), l // WORD), U(1) << (l % WORD).astype(np.uint64))
    return build(languages, counts, chosen.column("g").to_numpy().view(np.uint64), member)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for batch in batches:
            strings = batch.column(1).to_pylist()
            texts = [(t or "").lower().encode() for t in strings]
            for a, b in chunks([len(t) for t in texts], 1 << 18):
                lang, score = ["und"] * (b - a), np.zeros(b - a)
                letters = np.array([t is not None and _LETTER.search(t) is not None for t in strings[a:b]])
                if k and letters.any():
                    h, of = grams(texts[a:b])
                    n = np.bincount(of, minlength=b - a)
                    hits = model.hits(h, of, b - a)
                    right = np.maximum(0, (hits - n[:, None] * model.wrong) / (1 - model.wrong + 1e-12))
                    total = right.sum(1)
                    best = np.where(total > 0, right.argmax(1), model.frequent)
                    score = np.where(letters & (total > 0), right[np.arange(b - a), best] / np.maximum(total, 1e-12), 0.0)
                    lang = [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(make), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the id, as text, divisible by five. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score; learns from what is not held out."""
    ready(docs.sparkSession)
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
