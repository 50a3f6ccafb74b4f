"""Line diff of texts of any length, by joins: unique lines as anchors, a longest chain of runs, gaps on their own.

Lines that occur once in either text pair up by an equi-join. Pairs that follow each other in both texts are one
run, found by joins too, so what is left to order is a row for each run and no text. The heaviest chain of
runs that ascend in both texts (the longest increasing subsequence of the lines' places) is kept; it cuts the texts into gaps,
which are texts of their own for the next round, where more lines are unique. After the rounds, what is left in a gap
on both sides is compared exactly, each gap by any task. Where all lines are unique the equal lines are a longest common
subsequence, and in a gap always.

Texts come as (key, pos, line), places from zero. Both are stored as one table, `side` 0 and 1. Running values over a
text's places are taken within ranges of `RANGE` places and carried from range to range, so no text is one task's.
Each step is written and read again: plans stay small, and with them what the driver holds of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.lcs import common_lines
from docloom.session import ship
from docloom.sources.storage import scratch, stored

#: Places of a range, and rounds of anchors before the rest is compared.
RANGE, ROUNDS = 8_192, 3
_GAP = ["key", "gap"]
_SIDE = ["side", *_GAP]


def counted(df: DataFrame, keys: list[str], pos: str, flag: Column, name: str, short: bool = False) -> DataFrame:
    """df with `name`: how many rows before this one have the flag. short: no key has more rows than a task may sort."""
    if short:
        upto = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_flag", flag.cast("long")).withColumn(name, F.sum("_flag").over(upto) - F.col("_flag")).drop("_flag")
    df = df.withColumns({"_flag": flag.cast("long"), "_range": F.floor(F.col(pos) / RANGE)})
    upto = Window.partitionBy(*keys, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, "_range").agg(F.sum("_flag").alias("_n"))
    base = per.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = df.withColumn("_own", F.sum("_flag").over(upto) - F.col("_flag")).join(base, [*keys, "_range"])
    return own.withColumn(name, F.col("_own") + F.col("_base")).drop("_flag", "_range", "_own", "_base")


def common(lines: DataFrame) -> DataFrame:
    """key, gap, b, a, once: the first places of each line that both texts of a gap have, and whether either has it once."""
    own = lambda side: F.col("side") == side
    met = lines.groupBy(*_GAP, "line").agg(F.count_if(own(0)).alias("_b"), F.count_if(own(1)).alias("_a"), F.min(F.when(own(0), F.col("pos"))).alias("b"), F.min(F.when(own(1), F.col("pos"))).alias("a"))
    return met.where("_b > 0 AND _a > 0").select(*_GAP, "b", "a", F.expr("_b = 1 AND _a = 1").alias("once"))


def runs(pairs: DataFrame) -> DataFrame:
    """key, gap, b, a, n: pairs of places that follow each other in both texts, as one row. Found within ranges, which then meet."""
    near = pairs.select(*_GAP, "b", (F.col("a") - F.col("b")).alias("_d"), F.floor(F.col("b") / RANGE).alias("_range"))
    within = Window.partitionBy(*_GAP, "_d", "_range").orderBy("b")
    parts = near.withColumn("_i", F.col("b") - F.row_number().over(within)).groupBy(*_GAP, "_d", "_range", "_i").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    diagonal = Window.partitionBy(*_GAP, "_d").orderBy("b")  # a row a range and run
    marked = parts.withColumn("_new", F.coalesce(F.lag(F.col("b") + F.col("n")).over(diagonal) != F.col("b"), F.lit(True)).cast("long"))
    met = marked.withColumn("_run", F.sum("_new").over(diagonal.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*_GAP, "_d", "_run").agg(F.min("b").alias("b"), F.sum("n").alias("n"))
    return met.select(*_GAP, "b", (F.col("b") + F.col("_d")).alias("a"), "n")


def heaviest_chain(b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of the runs of most lines that ascend in both; a tree of best chains by rank in the second text."""
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(a, kind="stable")] = np.arange(len(a))
    best, above, tree = [0] * len(a), [-1] * len(a), [(0, -1)] * (len(a) + 1)
    for i in order.tolist():
        most = (0, -1)
        k = int(rank[i])
        while k > 0:
            most = max(most, tree[k])
            k &= k - 1
        best[i], above[i] = most[0] + int(n[i]), most[1]
        k = int(rank[i]) + 1
        while k <= len(a):
            tree[k] = max(tree[k], (best[i], i))
            k += k & -k
    out, i = [], int(np.argmax(best)) if len(a) else -1
    while i >= 0:
        out.append(i)
        i = above[i]
    return np.array(out[::-1], np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole gaps and where each of these begins; rows come by gap. Many small gaps are one table, a long one is its own."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(batch.schema.get_field_index(c)) for c in _GAP]
        new = np.zeros(batch.num_rows, bool)
        for c in own:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        new[0] = not held or any(held[-1].column(c)[-1] != x[0] for c, x in zip(_GAP, own))
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        first, last = int(starts[0]), int(starts[-1])
        if held:
            yield pa.Table.from_batches([*held, batch.slice(0, first)]), np.zeros(1, np.int64)
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)]), starts[:-1] - first
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def kept(found: DataFrame) -> DataFrame:
    """The runs of each gap's heaviest chain, numbered from one. A task holds a gap's runs: places, no lines."""
    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches):
            b, a, n = (t.column(c).to_numpy() for c in ("b", "a", "n"))
            ends = np.append(starts[1:], len(b))
            falls = np.append(0, np.cumsum(np.diff(a, prepend=a[0]) < 0))  # where nothing falls, all runs are the chain
            at, k = [], []
            for i, j in zip(starts.tolist(), ends.tolist()):
                own = np.arange(i, j) if falls[j] == falls[i + 1] else i + heaviest_chain(b[i:j], a[i:j], n[i:j])
                at.append(own)
                k.append(np.arange(1, len(own) + 1))
            yield from t.take(pa.array(np.concatenate(at))).append_column("k", pa.array(np.concatenate(k))).combine_chunks().to_batches()

    placed = found.repartition(*_GAP).sortWithinPartitions(*_GAP, "b")
    return placed.mapInArrow(chains, "key long, gap string, b long, a long, n long, k long")


def _placed(lines: DataFrame, chain: DataFrame) -> DataFrame:
    """Both texts' lines with their new gap and, where a kept run has them, the other text's place: the last run that begins up to a line tells."""
    run, at = F.struct("k", "b", "a", "n"), F.floor(F.col("pos") / RANGE).alias("_range")
    marks = chain.select(F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("pos")) for i, c in enumerate("ba")])), *_GAP, run.alias("_run")).select(*_SIDE, at, "pos", "_run")
    kind = marks.schema["_run"].dataType
    none = F.lit(None).cast(kind).alias("_run")
    firsts = lines.groupBy(*_SIDE, at).agg(F.min("pos").alias("pos"))  # a row a range
    before = Window.partitionBy(*_SIDE).orderBy("pos", F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = firsts.select(*_SIDE, "_range", "pos", none, F.lit(True).alias("_first")).union(marks.withColumn("_first", F.lit(False)))
    begun = met.withColumn("_run", F.last("_run", ignorenulls=True).over(before)).where("_first AND _run IS NOT NULL").drop("_first")
    rows = lines.select(*_SIDE, at, "pos", none, "line").union(marks.union(begun).withColumn("line", F.lit(None).cast("string")))
    upto = Window.partitionBy(*_SIDE, "_range").orderBy("pos", F.col("line").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_at", F.last("_run", ignorenulls=True).over(upto)).where("line IS NOT NULL")
    here, there = (F.when(F.col("side") == i, F.col("_at.b")).otherwise(F.col("_at.a")) for i in (0, 1))
    far = F.col("pos") - here
    gap = F.concat_ws(".", "gap", F.coalesce("_at.k", F.lit(0))).alias("gap")
    return own.select("side", "key", gap, "pos", "line", F.when(far < F.col("_at.n"), there + far).alias("other")).where("side = 0 OR other IS NULL")


def _compared(lines: DataFrame) -> DataFrame:
    """key, kind, before_pos, after_pos, line: gaps that have lines in common, exactly. A task holds a gap."""
    schema = "key long, kind string, before_pos long, after_pos long, line string"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches):
            side, pos, line, key = t.column("side").to_numpy(), t.column("pos").to_pylist(), t.column("line").to_pylist(), t.column("key").to_pylist()
            out = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(pos)]):
                m = i + int((side[i:j] == 0).sum())
                found = common_lines(line[i:m], line[m:j])
                out += [(key[i], "equal", pos[i + x], pos[m + y], line[i + x]) for x, y in found]
                for kind, first, end, met in (("deleted", i, m, {x for x, _ in found}), ("added", m, j, {y for _, y in found})):
                    places = (lambda p: (p, None)) if kind == "deleted" else (lambda p: (None, p))
                    out += [(key[i], kind, *places(pos[r]), line[r]) for r in range(first, end) if r - first not in met]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[x.strip().split(" ")[0] for x in schema.split(",")])

    return lines.repartition(*_GAP).sortWithinPartitions(*_GAP, "side", "pos").mapInArrow(match, schema)


def line_diff(before: DataFrame, after: DataFrame, rounds: int = ROUNDS, direct: int = 0) -> DataFrame:
    """(key long, pos long, line) of both texts -> key, kind, before_pos, after_pos, line. A null line is empty.

    Texts that come with a gap (a string) are compared within gaps of one name only, which stand in the same order in both.
    direct: where no gap has more lines than that, all are compared at once, exactly, each by any task.
    What comes out is read from files, so it costs little to use it several times.
    """
    spark = before.sparkSession
    ship(spark)
    folder = scratch(spark, "lines")
    gap = lambda d: F.col("gap") if "gap" in d.columns else F.lit("")
    text = lambda d, side: d.select(F.lit(side).alias("side"), F.col("key").cast("long").alias("key"), gap(d).alias("gap"), F.col("pos").cast("long").alias("pos"), F.coalesce("line", F.lit("")).alias("line"))
    left = stored(text(before, 0).union(text(after, 1)), f"{folder}/texts")
    out = []
    if direct and (left.groupBy(*_GAP).count().agg(F.max("count")).first()[0] or 0) <= direct:
        return stored(_compared(left), f"{folder}/compared")
    for r in range(rounds + 1):
        shared = stored(common(left), f"{folder}/common-{r}")
        many, once = shared.agg(F.count("*"), F.count_if("once")).first()
        if r == rounds or not once:
            break
        chain = stored(kept(runs(shared.where("once"))), f"{folder}/chain-{r}")
        placed = stored(_placed(left, chain), f"{folder}/placed-{r}")
        out.append(placed.where("other IS NOT NULL").select("key", F.lit("equal").alias("kind"), F.col("pos").alias("before_pos"), F.col("other").alias("after_pos"), "line"))
        left = placed.where("other IS NULL").drop("other")
    alone = left
    if many:
        gaps = shared.select(*_GAP).distinct()
        alone = left.join(gaps, _GAP, "left_anti")
        out.append(stored(_compared(left.join(gaps, _GAP, "left_semi")), f"{folder}/compared"))
        alone = stored(alone, f"{folder}/alone")
    mine = lambda side: F.when(F.col("side") == side, F.col("pos"))
    out.append(alone.select("key", F.when(F.col("side") == 0, "deleted").otherwise("added").alias("kind"), mine(0).alias("before_pos"), mine(1).alias("after_pos"), "line"))
    return reduce(DataFrame.union, out)


def combined(diff: DataFrame) -> DataFrame:
    """A diff's lines between two equal ones as one change: key, hunk, kind, before, after (joined by line feeds), and where (`first~last`)."""
    sides = []
    for own, gone in (("before_pos", "deleted"), ("after_pos", "added")):
        mine = diff.where(F.col("kind").isin("equal", gone)).select("key", "kind", own, F.when(F.col("kind") == gone, F.col("line")).alias("line"))
        side = counted(mine, ["key"], own, F.col("kind") == "equal", "hunk").where(F.col("kind") == gone)
        listed = side.groupBy("key", "hunk").agg(F.array_sort(F.collect_list(F.struct(F.col(own).alias("pos"), "line"))).alias("l"))
        name = own.split("_")[0]
        at = lambda i: F.element_at("l", i)["pos"].cast("string")
        where = F.when(F.size("l") == 1, at(1)).otherwise(F.concat(at(1), F.lit("~"), at(-1)))
        sides.append(listed.select("key", "hunk", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias(name), where.alias(f"{name}_at")))
    joined = sides[0].join(sides[1], ["key", "hunk"], "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("changed")
    return joined.select("key", "hunk", kind.alias("kind"), "before", "after", "before_at", "after_at")


def common_ends(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, prefix, suffix: how many lines two texts begin and end with in common; no line counts twice."""
    sizes = before.groupBy("key").agg(F.count("*").alias("n_b")).join(after.groupBy("key").agg(F.count("*").alias("n_a")), "key", "full").fillna(0, ["n_b", "n_a"])
    joined = before.select("key", "pos", F.col("line").alias("x")).join(after.select("key", "pos", F.col("line").alias("y")), ["key", "pos"])
    prefix = joined.where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("key").agg(F.min("pos").alias("differ"))
    left = sizes.join(prefix, "key", "left").withColumn("prefix", F.coalesce("differ", F.least("n_b", "n_a")))
    back = lambda d, n, name: d.join(left.select("key", n), "key").select("key", (F.col(n) - 1 - F.col("pos")).alias("pos"), F.col("line").alias(name))
    ends = back(before, "n_b", "x").join(back(after, "n_a", "y"), ["key", "pos"]).where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("key").agg(F.min("pos").alias("apart"))
    room = F.least("n_b", "n_a") - F.col("prefix")
    return left.join(ends, "key", "left").select("key", F.col("prefix").cast("long").alias("prefix"), F.least(F.coalesce("apart", room), room).cast("long").alias("suffix"))


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """A text for each key as (key, pos, line)."""
    return df.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))

