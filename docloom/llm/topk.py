"""Exact top-k search by a three-phase uniform threshold.

Vectors are cut into slices of dimensions; a slice's inner products with a query are its score list, and a
candidate's score is the sum over the lists. Rows stay where they are: each task holds a block of rows and
streams the stored queries past it, so nothing is copied for every pair of blocks.

1. Every block of rows finds, for each query, the leaders of its first list and scores these in full. The k-th
   best of all is a safe cutoff for the query: its true k-th score is no less.
2. The cutoffs, stored with the queries, go to all blocks. A block adds list after list; what a row can still
   gain is bounded by the norms of the slices left (Cauchy-Schwarz), and the cutoff less that bound is the
   threshold its sum must reach. Rows that no query of a block of queries needs any more drop out.
3. Once the pairs that reach the threshold are few, they are scored in full one by one; a block's k best go to
   the last ranking.

Scores are integers: components become floor(scale * x) in double precision. Products run in float64 while
they are exact there, else in 64-bit integers; bounds have a margin for rounding.

Nulls and edge cases: vectors that are null, or hold null or non-finite components, take no part; vectors of
another length than the query's are no candidates; a query with fewer than k candidates gets all; of repeated
query ids one (the least vector) asks, and no row with the query's id answers it; rows that repeat an id are
candidates of their own. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop, lean, partitions_of, ready, store
from docloom.llm.token_files import filesystem

#: Slices of the dimensions, and rows and queries of a block: 16,384 vectors of 64 dimensions take 8 MB.
SLICES, ROWS, QUERIES = 4, 16_384, 256
#: With fewer pairs left than one in so many, what is left of their products is computed pair by pair.
FEW = 16
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Block:
    """Vectors of one length: ids, components, and the norm of what is left after each slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cutoff: np.ndarray | None = None):
        self.ids, self.cutoff, self.most = ids, cutoff, float(np.abs(vectors).max(initial=0)) + 1
        self.cut = np.linspace(0, vectors.shape[1], SLICES + 1).astype(int)
        self.vectors = vectors
        rest = [(vectors[:, j:].astype(np.float64) ** 2).sum(1) for j in self.cut[1:]]
        self.rest = [np.sqrt(x) * (1 + 1e-9) for x in rest]

    def exact(self, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """Both blocks' components, as floats where their products are exact so."""
        kind = np.float64 if self.most * other.most * max(1, self.vectors.shape[1]) < 2**53 else np.int64
        return self.vectors.astype(kind, copy=False), other.vectors.astype(kind, copy=False)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query, larger scores and then smaller ids first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def leaders(queries: Block, rows: Block, k: int, work: Counter) -> Pairs:
    """The first phase: query id, row id and full score of each query's leaders in the first list."""
    a, b = queries.exact(rows)
    j = queries.cut[1]
    part = a[:, :j] @ b[:, :j].T
    work["products"] += part.size * j
    own = queries.ids[:, None] == rows.ids[None, :]
    part = np.where(own, np.iinfo(np.int64).min if part.dtype == np.int64 else -np.inf, part)
    n = min(k, part.shape[1])
    at = np.argpartition(part, part.shape[1] - n, 1)[:, part.shape[1] - n :] if n else np.zeros((len(a), 0), int)
    q = np.repeat(np.arange(len(a)), n)
    at = at.ravel()
    keep = ~own[q, at]
    q, at = q[keep], at[keep]
    work["products"] += len(q) * a.shape[1]
    return queries.ids[q], rows.ids[at], np.einsum("ij,ij->i", a[q], b[at]).astype(np.int64)


def resolved(queries: Block, rows: Block, k: int, work: Counter) -> Pairs:
    """The second and third phase: the k best of the rows that reach the cutoffs. Cutoffs are -inf where there are none."""
    a, b = queries.exact(rows)
    live, i = np.arange(len(b)), 0
    total = np.zeros((len(a), len(b)), a.dtype)
    reach = queries.ids[:, None] != rows.ids[None, :]
    for s in range(SLICES):
        if s and FEW * np.count_nonzero(reach) <= reach.size:
            break
        i, j = queries.cut[s], queries.cut[s + 1]
        total = total + a[:, i:j] @ b[live, i:j].T
        work["products"] += total.size * (j - i)
        bound = total + queries.rest[s][:, None] * rows.rest[s][live][None, :]
        reach &= bound >= (queries.cutoff - 1e-6 * np.abs(queries.cutoff))[:, None]
        needed = reach.any(0)
        live, total, reach, i = live[needed], total[:, needed], reach[:, needed], j
    q, at = np.nonzero(reach)
    score = total[q, at] + np.einsum("ij,ij->i", a[q, i:], b[live[at], i:])
    work["products"] += len(q) * (a.shape[1] - i)
    score, row_ids = score.astype(np.int64), rows.ids[live[at]]
    edge = np.searchsorted(q, np.arange(len(a) + 1))
    keep = np.concatenate([np.zeros(0, int), *[x + best(score[x:y], row_ids[x:y], k) for x, y in zip(edge, edge[1:])]])
    return queries.ids[q[keep]], row_ids[keep], score[keep]


def _blocks(batch: pa.RecordBatch | pa.Table, scale: float) -> Iterator[Block]:
    """The vectors (vec_id, v, cutoff or none) by their length."""
    table = pa.table(batch) if isinstance(batch, pa.RecordBatch) else batch
    size = pc.list_value_length(table.column("v")).to_numpy()
    for d in np.unique(size):
        own = table.filter(pa.array(size == d))
        flat = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = np.floor(scale * flat).reshape(own.num_rows, int(d))
        if np.abs(vectors).max(initial=0) >= 2**53:
            vectors = vectors.astype(np.int64)
        cutoff = own.column("cutoff").to_pandas().to_numpy(np.float64) if "cutoff" in own.column_names else None
        yield Block(own.column("vec_id").to_numpy(), vectors, None if cutoff is None else np.nan_to_num(cutoff, nan=-np.inf))


def _asked(folder: str, scale: float) -> Iterator[Block]:
    """The stored queries, a block at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, root = filesystem(folder)
    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")):
        with files.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(QUERIES):
                yield from _blocks(batch, scale)


def _met(rows: DataFrame, asks: DataFrame, phase: Callable[[Block, Block, int, Counter], Pairs], k: int, scale: float) -> DataFrame:
    """query_id, vec_id, score that a phase gives for every block of rows with every block of queries."""
    folder = asks._docloom_path
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {b.vectors.shape[1]: b for b in _blocks(pa.Table.from_batches(held), scale)}
            for queries in _asked(folder, scale):
                if (rows := own.get(queries.vectors.shape[1])) is not None:
                    found = phase(queries, rows, k, Counter())
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield from meet(held)
                held, n = [], 0
        if n:
            yield from meet(held)

    return rows.select("vec_id", "v").mapInArrow(lean(run), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors(vec_id, embedding); query: which rows ask -> query_id, rank, vec_id, score."""
    ready(vectors.sparkSession)
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = vectors.select("vec_id", "embedding", query.alias("asks")).where(F.col("vec_id").isNotNull() & fine)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), "asks")
    asks = store(good.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = max(partitions_of(vectors), -(-good.count() // ROWS))
    rows = store(good.drop("asks").repartition(n), "vectors")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    place = F.row_number().over(ranked)
    cutoff = _met(rows, asks, leaders, k, scale).withColumn("r", place).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    asked = store(asks.join(cutoff, "vec_id", "left"), "asked")
    found = _met(rows, asked, resolved, k, scale)
    out = store(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    drop(asks, rows, asked)
    return out
