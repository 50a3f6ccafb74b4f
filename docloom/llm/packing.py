"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length matters for the plan, and there are at most `capacity` lengths, so
the driver plans over a histogram of bounded size. The plan is a list of patterns (lengths that share a
sequence, and how many sequences use it): for the longest length left the gap is looked up in an index of
single, pair and triple sums of lengths still available; if none fills it exactly, the best fit goes in and
the rest of the gap is treated alike. Each pattern uses up at least one length, so there are at most `capacity`
patterns. Pieces find their place by their rank among pieces of their length.

Null text is empty; a document is its ids and the end id, so there is always a piece. Documents with the
same id are packed as separate ones. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop, lean, partitions_of, ready, store


class Sums:
    """Index of available lengths by the sums that one, two or three of them make.

    Lengths only ever run out, so a pair that is gone stays gone: each sum's pairs are listed once, the larger
    first, and each list and each sum's largest of three only move on.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        self.pairs: dict[int, tuple[np.ndarray, int]] = {}
        self.largest: dict[int, int] = {}

    def pair(self, total: int, most: int) -> list[int]:
        """Two available lengths of at most `most` that add up to the total; the larger as large as can be."""
        have = self.have
        if total not in self.pairs:
            a = np.arange(min(total, len(have)) - 1, (total - 1) // 2, -1)
            self.pairs[total] = (a[(have[a] > 0) & (have[total - a] > 0)].astype(np.int16), 0)
        own, at = self.pairs[total]
        while at < len(own) and not (have[own[at]] and have[total - own[at]]):
            at += 1
        self.pairs[total] = (own, at)
        for a in own[at:].tolist():
            b = total - a
            if a <= most and have[a] > (a == b) and have[b]:
                return [a, b]
        return []

    def exact(self, gap: int) -> list[int]:
        """One, two or three available lengths that fill the gap; longer pieces first."""
        have = self.have
        if have[gap]:
            return [gap]
        if pair := self.pair(gap, gap):
            return pair
        top = self.largest.get(gap, gap - 2)
        while 3 * top >= gap and not have[top]:
            top -= 1
        self.largest[gap] = top
        for c in range(top, (gap - 1) // 3, -1):
            if have[c]:
                have[c] -= 1
                pair = self.pair(gap - c, c)
                have[c] += 1
                if pair:
                    return [c, *pair]
        return []


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their number of sequences, using every piece once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length}")
        have[length] = n
    sums, out = Sums(have), []
    for top in range(capacity, 0, -1):
        while have[top]:
            pattern = [top]
            have[top] -= 1  # what the pattern holds counts as taken while it is built
            gap = capacity - top
            while gap:
                found = sums.exact(gap)
                if found:
                    pattern += found
                    np.subtract.at(have, found, 1)
                    break
                left = np.flatnonzero(have[1 : gap + 1])
                if not len(left):
                    break
                best = int(left[-1]) + 1
                pattern.append(best)
                have[best] -= 1
                gap -= best
            need = {x: pattern.count(x) for x in set(pattern)}
            times = 1 + min(int(have[x]) // n for x, n in need.items())
            for x, n in need.items():
                have[x] -= (times - 1) * n
            out.append((tuple(pattern), times))
    return out


def pieces(docs: DataFrame, tokenizer: str, mode: str, end_id: int, capacity: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32."""
    ready(docs.sparkSession)
    tail = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.encoder import encoder

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(tokenizer, mode).encode(part.column(1).to_pylist())):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(lean(cut, "docloom.llm.encoder"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces; `cut` must be a stored table.

    Ranks within a length come from counts per (slice, length) and their running sums, so a length that very
    many pieces share is never sorted in one task.
    """
    spark = cut.sparkSession
    n_slices = 4 * partitions_of(cut)
    # the row's place in its file, so that equal rows are not one slice's alone
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_metadata.row_index"), F.lit(n_slices)).cast("int"))
    per = sliced.groupBy("_slice", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("_slice", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan_packing(counts, capacity):
        offset = 0
        for length, many in Counter(pattern).items():  # as many pieces of a length as stand together in a sequence
            rows.append((length, used[length], used[length] + times * many, sequence, offset, many))
            used[length] += times * many
            offset += length * many
        sequence += times
    # a row for each pattern and length in it: lengths of a sequence that differ add up to at most the capacity,
    # so there are at most sqrt(2 capacity) of them, and 4096 patterns have under 370,000 rows in any case
    schema = "length long, _from long, _to long, _sequence long, offset long, _many long"
    ranges = spark.createDataFrame(rows, schema)
    within = Window.partitionBy("_slice", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("_r", F.row_number().over(within) - 1)
        .join(bases, ["_slice", "length"])
        .withColumn("_rank", F.col("_r") + F.col("_base"))
        .drop("_r", "_base", "_slice")
    )
    by_length = ranges.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_sequence", "offset", "_many"))).alias("_ranges"))
    # ranges of a length follow each other: by bisection, the last that begins at the rank or before
    steps = F.array(*[F.lit(1 << i) for i in range(18, -1, -1)])
    reached = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("_ranges")) & (F.get("_ranges", at + step - 1)["_from"] <= F.col("_rank")), at + step).otherwise(at))
    return (
        ranked.join(F.broadcast(by_length), "length")  # at most `capacity` rows
        .withColumn("_at", F.get("_ranges", reached - 1))
        .withColumn("_k", F.col("_rank") - F.col("_at._from"))
        .withColumn("sequence_id", F.col("_at._sequence") + F.floor(F.col("_k") / F.col("_at._many")))
        .withColumn("offset", F.col("_at.offset") + F.col("_k") % F.col("_at._many") * F.col("length"))
        .drop("_ranges", "_at", "_rank", "_k")
    )


def pack(docs: DataFrame, tokenizer: str, mode: str = "words", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = store(pieces(docs, tokenizer, mode, end_id, capacity), "pieces")
    out = store(place(cut, capacity), "packed")
    drop(cut)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
