"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters; chains are up to `CHAIN` successive tokens of a document. The field has two labels,
features of the token (the word and its beginnings) and transitions; forward-backward gives each token's
marginal. Offsets of tokens with a marginal of at least `SPAN` are reported, and a document's score comes
from its marginals by a logistic function fitted on the learning documents.

Labelled tokens are needed, but documents are labelled: a token of a toxic document is labelled toxic if it
has one of the words or word beginnings that several toxic documents have and clean documents hardly have.
Near copies among the toxic documents count as one there, so that the other words of a toxic text with many
copies do not get in.

Learning takes up to `FIT_TOXIC` toxic and `FIT_CLEAN` other labelled documents, those with the least hash of
their id, on the driver, of `FIT_BYTES` of text at most; the bounds hold at any size. The driver goes over the
texts a slice at a time and the chains a block at a time, and holds a few numbers for each token of the chains it
learns from. A class has the share of
the bytes that it has of the documents, and what the other class leaves; a document that does not fit is passed
over and the next is tried, so one over its class's bytes is not learned from. Everything else runs over all
documents.

Nulls and edge cases: a text that is null or has no letter has no tokens and gets the score of such a text;
without labels of both kinds every score is the share of toxic labels (0 without any). Labels that are null
do not count; repeated labels of a document count once, toxic if one is. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import hashing
from docloom.llm.common import chunks, lean, ready, trim
from docloom.llm.langid import held_out

FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 800, 2_400, 7 << 20
CHAIN, SPAN = 64, 0.5
#: Bytes of text that are cut into tokens at once; chains whose marginals the learning finds at once.
SLICE_BYTES, BLOCK_CHAINS = 1 << 18, 512
CHANCE = 1e-5
#: Lengths in bytes of the word beginnings that serve as features, besides the whole word.
STEMS = (4, 5, 6, 7, 8)
U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in the joined texts) and text of each run of letters; and its features, one row each (0: none)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    of = np.searchsorted(begin, start, "right") - 1
    keys = np.zeros((len(start), 1 + len(STEMS)), np.uint64)
    keys[:, 0] = hashing.mix(hashing.span_hashes(data, start, end) + U(1))
    for i, n in enumerate(STEMS, 1):
        long = np.flatnonzero(end - start >= n)
        keys[long, i] = hashing.span_hashes(data, start[long], start[long] + n)
    return start - begin[of], end - begin[of], of, keys


def chains(of: np.ndarray) -> np.ndarray:
    """The place of each token: chain * CHAIN + position."""
    head = hashing.runs(of)
    n = np.diff(np.concatenate((head, [len(of)])))
    within = np.arange(len(of)) - np.repeat(head, n)
    per = -(-n // CHAIN)
    first = np.cumsum(per) - per
    return (np.repeat(first, n) + within // CHAIN) * CHAIN + within % CHAIN


def forward_backward(unary: np.ndarray, trans: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 (chains x positions), and expected transitions summed over the chains.

    unary: the score of label 1 over label 0; trans: 2x2 scores; length: of each chain.
    """
    s, t = unary.shape
    at = np.exp(np.clip(np.stack([np.zeros_like(unary), unary], 2), -30, 30))
    e = np.exp(trans)
    ahead, back = np.empty((s, t, 2)), np.ones((s, t, 2))
    ahead[:, 0] = at[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        ahead[:, i] = (ahead[:, i - 1] @ e) * at[:, i]
        ahead[:, i] /= ahead[:, i].sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (at[:, i + 1] * back[:, i + 1]) @ e.T
        x /= x.sum(1, keepdims=True)
        back[:, i] = np.where((i + 1 < length)[:, None], x, 1.0)
    both = ahead * back
    marginal = both[:, :, 1] / both.sum(2)
    pair = ahead[:, :-1, :, None] * e * (at[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    live = np.arange(1, t)[None, :] < length[:, None]
    return marginal, (pair * live[:, :, None, None]).sum((0, 1))


@dataclass
class Model:
    keys: np.ndarray  # ascending
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    link: np.ndarray  # constant, of the largest marginal's log odds, of the log of the sum
    seen: np.ndarray  # a bit table that passes all keys

    def unary(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.bias)
        for column in keys.T:
            maybe = np.flatnonzero(self.seen[column & U(len(self.seen) - 1)])
            at = np.minimum(np.searchsorted(self.keys, column[maybe]), max(0, len(self.keys) - 1))
            if len(self.keys):
                hit = self.keys[at] == column[maybe]
                np.add.at(out, maybe[hit], self.weights[at[hit]])
        return out

    def marginals(self, of: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(of):
            return np.zeros(0)
        place = chains(of)
        n = int(place[-1]) // CHAIN + 1
        unary = np.zeros(n * CHAIN)
        unary[place] = self.unary(keys)
        length = np.bincount(place // CHAIN, minlength=n)
        return forward_backward(unary.reshape(n, CHAIN), self.trans, length)[0].ravel()[place]

    def scores(self, of: np.ndarray, marginal: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregate(of, marginal, n) @ self.link, -30, 30)))


def aggregate(of: np.ndarray, marginal: np.ndarray, n: int) -> np.ndarray:
    """What a document's score is made of: 1, the log odds of the largest marginal, log(1 + sum)."""
    most = np.full(n, 1e-6)
    np.maximum.at(most, of, marginal)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    total = np.bincount(of, weights=marginal, minlength=n)
    return np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total)], 1)


def alike(docs: list[np.ndarray], sketch: int = 32) -> np.ndarray:
    """A group number for each document: documents that share half of their least hashed keys count as one."""
    group, leaders = np.arange(len(docs)), defaultdict(list)
    for i, keys in enumerate(docs):
        own = np.sort(hashing.mix(keys))[:sketch].tolist()
        votes = Counter(j for k in own for j in leaders[k])
        best, n = max(votes.items(), key=lambda x: (x[1], -x[0]), default=(i, 0))
        if n >= max(1, len(own) // 2):
            group[i] = best
        else:
            for k in own:
                leaders[k].append(i)
    return group


def slices(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of the texts with their tokens: the text of each token (0: the range's first), and its features."""
    for a, b in chunks([len(t) for t in texts], SLICE_BYTES):
        yield a, b, *tokens(texts[a:b])[2:]


def distinct(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct keys of each text, ascending."""
    for a, b, of, keys in slices(texts):
        edge = np.searchsorted(of, np.arange(b - a + 1))
        for low, high in zip(edge[:-1], edge[1:]):
            yield np.setdiff1d(np.unique(keys[low:high]), [U(0)])


def explain(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Feature keys that mark toxic documents.

    Near copies among the toxic documents count as one, so the other words of a text with copies don't get in.
    """
    own = list(distinct([texts[i] for i in np.flatnonzero(toxic)]))
    group = alike(own)
    each = [np.unique(np.concatenate([own[j] for j in np.flatnonzero(group == g)])) for g in np.unique(group)]
    keys, n1 = np.unique(np.concatenate(each), return_counts=True)
    # so many that chance alone, at the sample's share of toxic texts, would not bring them all
    least = max(4, 0.002 * len(each), np.log(CHANCE) / np.log(max(1e-9, toxic.mean())))
    keys, n1 = keys[n1 >= least], n1[n1 >= least]
    n0 = np.zeros(len(keys))
    for clean in distinct([texts[i] for i in np.flatnonzero(~toxic)]):
        n0 += np.isin(keys, clean, assume_unique=True)
    # as many in clean documents as labels may be wrong, at the sample's odds
    odds = max(1.0, (~toxic).sum() / max(1, toxic.sum()))
    return keys[n0 <= 0.05 * n1 * odds]


def chosen_chains(texts: list[bytes], toxic: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Whether each chain is learned from: all with a toxic token, and as many others as keep the sum bounded."""
    has = np.concatenate([np.bincount(chains(of) // CHAIN, weights=np.isin(keys, stems).any(1) & toxic[a + of]) > 0 for a, _, of, keys in slices(texts)])
    other = np.flatnonzero(~has)
    has[other[np.argsort(hashing.mix(other.astype(np.uint64)))][: max(2000, 2 * int(has.sum()))]] = True
    return has


def chosen_tokens(texts: list[bytes], use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of the chosen chains, a slice at a time: places among these chains, texts, features."""
    number, first = np.cumsum(use) - 1, 0
    for a, _, of, keys in slices(texts):
        place = chains(of)
        chain = first + place // CHAIN
        first = int(chain[-1]) + 1 if len(chain) else first
        keep = use[chain]
        yield number[chain[keep]] * CHAIN + place[keep] % CHAIN, a + of[keep], keys[keep]


def repeated_keys(texts: list[bytes], use: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys that the tokens of the chosen chains have twice or more, ascending, and how many tokens there are."""
    known, again, n = np.zeros(0, np.uint64), np.zeros(0, bool), 0
    for place, _, keys in chosen_tokens(texts, use):
        n += len(place)
        more, times = np.unique(keys[keys != 0], return_counts=True)
        known, again = np.concatenate((known, more)), np.concatenate((again, times > 1))
        order = np.argsort(known, kind="stable")
        known, again = known[order], again[order]
        head = hashing.runs(known)
        if len(head):
            again = np.logical_or.reduceat(again, head) | (np.diff(np.append(head, len(known))) > 1)
        known = known[head]
    return known[again], n


def learn(texts: list[bytes], toxic: np.ndarray, rounds: int = 30) -> Model:
    """Fits the field and the link on labelled documents."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not toxic.any() or toxic.all():
        odds = np.log(max(share, 1e-13) / max(1 - share, 1e-13))
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros((2, 2)), np.array([odds, 0.0, 0.0]), np.zeros(8, bool))
    stems = explain(texts, toxic)
    use = chosen_chains(texts, toxic, stems)
    known, n = repeated_keys(texts, use)
    # of each token: the places of its keys among the known (their number: none), its own place, its label
    at, place, label, done = np.empty((n, 1 + len(STEMS)), np.int32), np.empty(n, np.int32), np.empty(n, bool), 0
    for own, of, keys in chosen_tokens(texts, use):
        part = slice(done, done := done + len(own))
        place[part], label[part] = own, np.isin(keys, stems).any(1) & toxic[of]
        i = np.searchsorted(known, keys)
        if len(known):
            i[known[np.minimum(i, len(known) - 1)] != keys] = len(known)
        at[part] = i
    chain = place // CHAIN
    length = np.bincount(chain, minlength=int(use.sum()))
    follows = 2 * label[:-1].astype(np.int8) + label[1:]
    wanted = np.bincount(follows[chain[1:] == chain[:-1]], minlength=4).reshape(2, 2).astype(float)
    heads = [*range(0, len(length), BLOCK_CHAINS), len(length)]
    blocks = [(a, b, *np.searchsorted(chain, (a, b)).tolist()) for a, b in zip(heads[:-1], heads[1:])]
    del chain, follows
    w, trans, bias, miss = np.zeros(len(known) + 1), np.zeros((2, 2)), -4.0, np.empty(n)
    sums = [np.full_like(w, 1e-3), np.full((2, 2), 1e-3), 1e-3]
    for _ in range(rounds):  # full-batch AdaGrad on the log likelihood with an L2 penalty
        w[-1] = 0
        pairs = np.zeros((2, 2))
        for a, b, low, high in blocks:
            unary = np.zeros((b - a) * CHAIN)
            own = place[low:high] - a * CHAIN
            unary[own] = w[at[low:high]].sum(1) + bias
            marginal, some = forward_backward(unary.reshape(b - a, CHAIN), trans, length[a:b])
            miss[low:high] = label[low:high] - marginal.ravel()[own]
            pairs += some
        grad = [sum(np.bincount(column, weights=miss, minlength=len(w)) for column in at.T) - 0.02 * w, wanted - pairs - 0.02 * trans, miss.sum()]
        sums = [s + x * x for s, x in zip(sums, grad)]
        step = [0.7 * x / np.sqrt(s) for x, s in zip(grad, sums)]
        w, trans, bias = w + step[0], trans + step[1], bias + float(step[2])
    heavy = np.flatnonzero(np.abs(w[:-1]) > 0.05)
    seen = np.zeros(1 << 20, bool)
    seen[known[heavy] & U(len(seen) - 1)] = True
    model = Model(known[heavy], w[heavy], bias, trans, np.zeros(3), seen)
    del at, place, label, miss
    made = [aggregate(of, model.marginals(of, keys), b - a) for a, b, of, keys in slices(texts)]
    model.link = _logistic(np.concatenate(made), toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton steps with a small penalty."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def sample(order: list[tuple[int, int, int]]) -> list[int]:
    """(id, bytes, toxic) in order of choice -> the ids to learn from, within each class's part of `FIT_BYTES`."""
    clean = sum(n for _, n, toxic in order if not toxic)
    left = {1: max(FIT_BYTES * FIT_TOXIC // (FIT_TOXIC + FIT_CLEAN), FIT_BYTES - clean)}
    took = []
    for kind in (1, 0):
        used = 0
        for k, n, toxic in order:
            if toxic == kind and used + n <= left[kind]:
                used += n
                took.append(k)
        left[0] = FIT_BYTES - used
    return took


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> a model from documents that are not held out."""
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids: dict[int, int] = {}
    for toxic, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        rows = own.where(F.col("toxic") == toxic).select("doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most).collect()
        ids |= {r["doc_id"]: toxic for r in rows}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    pick = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id").withColumn("n", F.octet_length("text"))
    sizes = pick.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").collect()
    took = [(k,) for k in sample([(r["doc_id"], r["n"], ids[r["doc_id"]]) for r in sizes])]
    rows = pick.join(F.broadcast(spark.createDataFrame(took, "doc_id long")), "doc_id").select("doc_id", "text").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "text").collect() if took else []
    texts, toxic = [r["text"].lower().encode() for r in rows], np.array([ids[r["doc_id"]] == 1 for r in rows], bool)
    del rows
    model = learn(texts, toxic)
    del texts
    trim()
    return model


def tag(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score and, on request, spans (start and end in the lower-cased UTF-8 bytes, marginal)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode() for t in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], 1 << 18):
                start, end, of, keys = tokens(texts[a:b])
                marginal = model.marginals(of, keys)
                out = [batch.column(0).slice(a, b - a), pa.array(model.scores(of, marginal, b - a))]
                if spans:
                    lists: list[list] = [[] for _ in range(b - a)]
                    for i in np.flatnonzero(marginal >= SPAN).tolist():
                        lists[of[i]].append({"start": int(start[i]), "end": int(end[i]), "marginal": float(marginal[i])})
                    out.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "spans"][: len(out)])

    schema = "doc_id long, score double" + ", spans array<struct<start: int, end: int, marginal: double>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(make), schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is under the threshold."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = np.zeros(len(texts), bool)
            for a, b in chunks([len(t) for t in texts], 1 << 18):
                _, _, of, keys = tokens(texts[a:b])
                keep[a:b] = model.scores(of, model.marginals(of, keys), b - a) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(make), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ready(docs.sparkSession)
    out = tag(docs, fit(docs, labels), spans)
    more = ["spans"] * spans
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)
