"""Near copies among embeddings by sorted projection passes.

Vectors with the same label and components are one class, which stands for them. Each pass hashes every class by
several random projections (the signed axis nearest to a randomly projected vector, a byte each), orders classes
lexicographically by label and concatenated hashes, and numbers them. A block of `BLOCK` places is compared with itself and
with the block before it by one float64 matrix product, so each class meets at least `BLOCK` neighbours to
either side. Pairs that reach the cosine count for both classes, unless an earlier pass has compared them already:
every class knows its places in all passes. What a block puts out is one row a class, its links and its root
among the block's pairs, never pairs; the roots of all passes are united by connected components.

Cost is linear in the rows, whatever the size of a group of near copies: places are numbers, so no group
is a task's alone. Pairs are missed that no pass brings within a window; a test with blocks of 32 among 6,000 vectors
of one label holds the passes to 97 % of the links. Of a group of very many near copies that are not equal, components
stay whole, as neighbouring windows overlap, but a member's n_links counts the links found, not all.

Nulls and edge cases: vectors that are null, zero, empty, or hold null or non-finite components, and those without a
label, link with nothing and are their own component; vectors of different lengths don't link; rows that repeat,
also with one id, are vectors of their own; a row without an id is kept only if no row of its component has one. An empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop, lean, partitions_of, ready, store
from docloom.llm.components import components

#: Places of a block, blocks that one task takes in a row, passes, hashes of a pass, and axes of a hash.
BLOCK, RUN, PASSES, HASHES, AXES = 1024, 8, 8, 6, 64
COSINE = 0.98


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, so that squares neither overflow nor vanish; cosines stay the same."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def keys(v: np.ndarray, number: int) -> np.ndarray:
    """The concatenated hashes of a pass, a row of bytes for each vector."""
    d, out = v.shape[1], []
    for j in range(HASHES):
        axes = np.random.default_rng((d, number, j)).standard_normal((d, min(d, AXES)))
        p = v @ axes
        at = np.abs(p).argmax(1)
        out.append(at * 2 + (p[np.arange(len(p)), at] > 0))
    return np.stack(out, 1).astype(np.uint8)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return scaled(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d))


def _hashed(passes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                at = pa.array(np.flatnonzero(size == d))
                own = batch.take(at)
                v = _matrix(own.column("v"), int(d))
                made = [[k.tobytes() for k in keys(v, p)] for p in range(passes)]
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array([*zip(*made, strict=True)], pa.list_(pa.binary()))], ["node", "keys"])

    return run


def placed(classes: DataFrame, passes: int) -> DataFrame:
    """classes with `places`: for each pass the class's place in the order. Stored."""
    hashed = classes.select("node", "d", "v").mapInArrow(lean(_hashed(passes)), "node string, keys array<binary>")
    order = ["pass", "label", "d", "key", "node"]
    long = hashed.join(classes.select("node", "label", "d"), "node").select("node", "label", "d", F.posexplode("keys").alias("pass", "key"))
    n = partitions_of(classes)
    ordered = store(long.repartitionByRange(n, *order).sortWithinPartitions(*order).select("node", "pass", F.monotonically_increasing_id().alias("at")), "order")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("many")).select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
    numbered = ordered.withColumn("part", part).join(F.broadcast(base), "part").select("node", "pass", place.alias("place"))  # base: a row a partition
    each = numbered.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda x: x["place"]).alias("places"))
    out = store(classes.join(each, "node"), "placed")
    drop(ordered)
    return out


class Roots:
    """Which rows hang together, by pairs given in blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r, s = self.root[a], self.root[b]
            apart = r != s
            a, b, r, s = a[apart], b[apart], r[apart], s[apart]
            np.minimum.at(self.root, np.maximum(r, s), np.minimum(r, s))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def compared(v: np.ndarray, kind: np.ndarray, many: np.ndarray, places: np.ndarray, number: int, least: float, block: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found and roots, for rows in the order of a pass.

    kind: equal where rows may link; many: the vectors that a row stands for; places: of each row in every pass; blocks
    below `first` belong to the run before and are not compared among themselves.
    """
    blocks = places // block
    own = blocks[:, number]
    links, roots = np.zeros(len(v), np.int64), Roots(len(v))
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    edge = np.searchsorted(own, np.arange(max(first, int(own[0])), int(own[-1]) + 2)) if len(own) else []
    for i, j in zip(edge, edge[1:]):
        start = int(np.searchsorted(own, own[i] - 1)) if j > i else i
        for k in np.unique(kind[i:j]):
            a, b = i + np.flatnonzero(kind[i:j] == k), start + np.flatnonzero(kind[start:j] == k)
            cosine = (v[a] @ v[b].T) / (norm[a][:, None] * norm[b])
            x, y = np.nonzero(cosine >= least)
            x, y = a[x], b[y]
            keep = (x > y) & ~(np.abs(blocks[x, :number] - blocks[y, :number]) <= 1).any(1)
            x, y = x[keep], y[keep]
            links += (np.bincount(x, many[y], len(v)) + np.bincount(y, many[x], len(v))).astype(np.int64)
            roots.join(x, y)
    return links, roots.root


def _windows(number: int, least: float, block: int) -> Callable:
    """The rows of each run of blocks, in order, to links and roots by node."""

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        size = t.column("d").to_numpy()
        places = np.array(t.column("places").to_pylist())
        labels: dict = {}
        kind = np.array([labels.setdefault(x, len(labels)) for x in zip(t.column("label").to_pylist(), size.tolist(), strict=True)])
        many, node = t.column("many").to_numpy(), t.column("node").to_pylist()
        first = int(t.column("run")[0].as_py()) * RUN
        lists = t.column("v").combine_chunks()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            links, root = compared(_matrix(lists.take(pa.array(at)), int(d)), kind[at], many[at], places[at], number, least, block, first)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([node[at[i]] for i in hit], pa.string()), pa.array(links[hit]), pa.array([node[at[root[i]]] for i in hit], pa.string())], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            runs = batch.column("run").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for i, j in zip(edge, edge[1:]):
                if j > i:
                    if held and runs[i] != now:
                        yield from found(held)
                        held = []
                    now = runs[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield from found(held)

    return run


def near_vectors(vectors: DataFrame, least: float = COSINE, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    ready(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # one zero
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    node = F.when(fine, F.md5(F.to_json(F.struct("label", "v"))))
    known = rows.withColumn("node", node)
    grouped = known.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("many"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = store(grouped.withColumn("d", F.size("v")), "classes")
    places = placed(classes, passes)
    found = []
    for p in range(passes):
        place = F.get("places", F.lit(p))
        at, of = F.floor(place / block).cast("long"), F.floor(place / (block * RUN)).cast("long")
        runs = F.explode(F.when(at % RUN == RUN - 1, F.array(of, of + 1)).otherwise(F.array(of)))
        dealt = places.select("node", "label", "d", "many", "v", "places", place.alias("place"), runs.alias("run")).repartition("run").sortWithinPartitions("run", "place")
        found.append(store(dealt.drop("place").mapInArrow(lean(_windows(p, least, block)), "node string, links long, root string"), "links"))
    drop(places)
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    edges = union.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    of = store(components(edges), "of")
    ids = classes.select("node", "least_id").join(of, "node")
    least_of = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    links = union.groupBy("node").agg(F.sum("links").alias("links"))
    per = store(classes.select("node", "many", "least_id").join(links, "node", "left").join(of.join(least_of, "component").select("node", "component_id"), "node", "left"), "classes")
    drop(classes, of, *found)
    out = known.select("vec_id", "node").join(per, "node", "left")
    n_links = F.coalesce(F.col("many") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.when(F.col("links") > 0, F.col("component_id")).otherwise(F.col("least_id")))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), own.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
