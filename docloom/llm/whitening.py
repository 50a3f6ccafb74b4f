"""Whitening of embeddings from an exact covariance, by a digit-slice matrix product.

Components become integers x = floor(64 c) + 1,000,000. With n vectors and sums S, the centred integers
y = n x - S are split into limbs of 16 bits, so that the products of two limbs, summed over 2**20 rows, stay below
2**53: one float64 BLAS product of all limbs is exact. Each task recombines its limbs as big integers, tasks' rows
of the matrix are added up in two levels, and the driver, which gets a matrix whose size depends on the number
of dimensions alone, finds the eigenvectors of sum(y y') / n**3. The rows are scanned for the sums, for the
products, for the whitened columns' own covariance and for the result; nothing but sums is shuffled.

Nulls and edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped; an empty vector
has no components. Vectors of each length are a fit list of their own. Entries beyond 2**62 / 64 count as that
bound. A direction without variance (within rounding of the largest eigenvalue) has whitened null; with no
variance at all explained and identity_error are null too. `deviation` is null where it exceeds 64 bits, and
`deviation_exact` holds it up to 38 digits. Rows that repeat, or have no id, are rows of their own; an empty
table gives no rows, and other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import lean, list_array, partitions_of, ready

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Bits of a limb, and rows whose limbs' products stay exact in a float64 sum.
LIMB, ROWS = 16, 1 << 20
_MOST = 1 << 62
_PARTIAL = "d int, i int, n long, top long, numbers array<string>"


class Fit(NamedTuple):
    """What the rows of one length share: n, S, the projection (d x r, over n sqrt(e)), and e / trace."""

    n: int
    sums: np.ndarray
    project: np.ndarray
    explained: list[float | None]


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each length, and their x."""
    size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        if d:
            at = np.flatnonzero(size == d)
            flat = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(SCALE * flat), -float(_MOST), float(_MOST - 1024)).astype(np.int64)
            yield at, x.reshape(len(at), int(d)) + SHIFT


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S: 64-bit integers where they fit, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < _MOST:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def limbs(y: np.ndarray) -> np.ndarray:
    """The columns' limbs side by side, lowest first; the highest has the sign."""
    most = max(int(abs(y.max(initial=0))), int(abs(y.min(initial=0))))
    many = most.bit_length() // LIMB + 1
    low = [((y >> LIMB * k) & ((1 << LIMB) - 1)).astype(np.float64) for k in range(many - 1)]
    return np.hstack([*low, (y >> LIMB * (many - 1)).astype(np.float64)])


def recombined(products: np.ndarray, d: int) -> np.ndarray:
    """The matrix of big integers that the limbs' products stand for."""
    out = np.zeros((d, d), object)
    for k in range(len(products) // d):
        for m in range(len(products) // d):
            out += products[k * d : k * d + d, m * d : m * d + d].astype(np.int64).astype(object) << LIMB * (k + m)
    return out


class Gram:
    """sum(y y') of the blocks it is given, exactly."""

    def __init__(self, d: int):
        self.d, self.total, self.held = d, np.zeros((d, d), object), {}

    def add(self, y: np.ndarray) -> None:
        z = limbs(y)
        rows, products = self.held.get(z.shape[1], (0, 0.0))
        if rows + len(z) > ROWS:
            self.flush()
            rows, products = 0, 0.0
        self.held[z.shape[1]] = rows + len(z), products + z.T @ z

    def flush(self) -> np.ndarray:
        for _, products in self.held.values():
            self.total = self.total + recombined(products, self.d)
        self.held = {}
        return self.total


def _texts(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.array([[str(x) for x in r] for r in rows], pa.list_(pa.string()))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length: the number of vectors, the largest absolute x, and S."""
    held: dict[int, tuple[int, int, np.ndarray]] = {}
    for batch in batches:
        for _, x in integers(batch):
            n, top, s = held.get(x.shape[1], (0, 0, np.zeros(x.shape[1], object)))
            high, low = (x >> 32).sum(0).astype(object), (x & 0xFFFFFFFF).sum(0).astype(object)
            held[x.shape[1]] = n + len(x), max(top, int(np.abs(x).max())), s + (high << 32) + low
    if held:
        columns = [pa.array([*held], pa.int32()), pa.array([0] * len(held), pa.int32()), *[pa.array([h[k] for h in held.values()], pa.int64()) for k in (0, 1)], _texts([h[2] for h in held.values()])]
        yield pa.RecordBatch.from_arrays(columns, ["d", "i", "n", "top", "numbers"])


def _products(sums: dict[int, tuple[int, np.ndarray]]) -> Callable:
    """Of each length the rows i of the upper half of sum(y y')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}
        for batch in batches:
            for _, x in integers(batch):
                held.setdefault(x.shape[1], Gram(x.shape[1])).add(centred(x, *sums[x.shape[1]]))
        for d, gram in held.items():
            c = gram.flush()
            columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([0] * d, pa.int64()), pa.array([0] * d, pa.int64()), _texts([c[i, i:] for i in range(d)])]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "n", "top", "numbers"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial rows of the same (d, i) as one."""
    held: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            n, top, s = held.get((r["d"], r["i"]), (0, 0, 0))
            held[r["d"], r["i"]] = n + r["n"], max(top, r["top"]), s + np.array([int(x) for x in r["numbers"]], object)
    if held:
        columns = [*[pa.array([k[j] for k in held], pa.int32()) for j in (0, 1)], *[pa.array([h[k] for h in held.values()], pa.int64()) for k in (0, 1)], _texts([h[2] for h in held.values()])]
        yield pa.RecordBatch.from_arrays(columns, ["d", "i", "n", "top", "numbers"])


def _merged(partials: DataFrame) -> list:
    """The tasks' partial rows added up in two levels: no task gets a row of every task."""
    ways = math.isqrt(partitions_of(partials)) + 1
    spread = partials.withColumn("way", F.spark_partition_id() % ways).repartition("d", "i", "way")
    return spread.drop("way").mapInArrow(lean(_added), _PARTIAL).repartition("d", "i").mapInArrow(lean(_added), _PARTIAL).collect()


def eigen(c: np.ndarray, n: int, most: int) -> tuple[np.ndarray, list[float | None]]:
    """Unit eigenvectors of c / n**3 over n sqrt(e), by falling e, and e over the trace."""
    trace = sum(c.diagonal()) / n**3
    e, vectors = np.linalg.eigh(np.array([[x / n**3 for x in row] for row in c], np.float64))
    e, vectors = e[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    flat = e <= e.max(initial=0) * len(c) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        project = np.where(flat, np.nan, vectors / (n * np.sqrt(np.maximum(e, 0))))
    return project, [float(x / trace) if trace else None for x in np.maximum(e, 0)]


def fit(good: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """good(v) -> for each length of vectors its fit."""
    sums = {r["d"]: (r["n"], np.array([int(x) for x in r["numbers"]], object)) for r in _merged(good.mapInArrow(lean(_sums), _PARTIAL))}
    upper: dict[int, np.ndarray] = {d: np.zeros((d, d), object) for d in sums}
    for r in _merged(good.mapInArrow(lean(_products(sums)), _PARTIAL)):
        c, i = upper[r["d"]], r["i"]
        c[i, i:] = c[i:, i] = [int(x) for x in r["numbers"]]
    return {d: Fit(*sums[d], *eigen(upper[d], sums[d][0], most)) for d in sums}


def whitened(y: np.ndarray, own: Fit) -> np.ndarray:
    return y.astype(np.float64) @ own.project


class Spread:
    """Count, mean and centred products of blocks; each is centred by its own mean before multiplying."""

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, w: np.ndarray) -> Spread:
        mean = w.mean(0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def __add__(self, other: Spread) -> Spread:
        n, gap = self.n + other.n, other.mean - self.mean
        return Spread(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))


_SPREAD = "d int, n long, mean array<double>, products array<double>"


def _spreads(held: dict[int, Spread]) -> Iterator[pa.RecordBatch]:
    if held:
        made = [*held.values()]
        columns = [pa.array([*held], pa.int32()), pa.array([int(s.n) for s in made], pa.int64()), *[pa.array([getattr(s, k).ravel() for s in made], pa.list_(pa.float64())) for k in ("mean", "products")]]
        yield pa.RecordBatch.from_arrays(columns, ["d", "n", "mean", "products"])


def _identity(good: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Of each length the largest absolute entry of the whitened columns' covariance less the identity."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Spread] = {}
        for batch in batches:
            for _, x in integers(batch):
                own = fits[d := x.shape[1]]
                new = Spread.of(whitened(centred(x, own.n, own.sums), own)[:, ~np.isnan(own.project[0])])
                held[d] = held[d] + new if d in held else new
        yield from _spreads(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Spread] = {}
        for batch in batches:
            for r in batch.to_pylist():
                k = len(r["mean"])
                new = Spread(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k))
                held[r["d"]] = held[r["d"]] + new if r["d"] in held else new
        yield from _spreads(held)

    ways = math.isqrt(partitions_of(good)) + 1
    parts = good.mapInArrow(lean(made), _SPREAD).withColumn("way", F.spark_partition_id() % ways).repartition(ways, "way").drop("way").mapInArrow(lean(joined), _SPREAD)
    held: dict[int, Spread] = {}
    for r in parts.collect():  # a row for each way and length: the root of the number of tasks
        k = len(r["mean"])
        new = Spread(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k))
        held[r["d"]] = held[r["d"]] + new if r["d"] in held else new
    return {d: float(np.abs(s.products / s.n - np.eye(len(s.mean))).max()) if len(s.mean) else None for d, s in held.items()}


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    ready(vectors.sparkSession)
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(fine)
    fits = fit(good.select("v"), components)
    errors = _identity(good.select("v"), fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch):
                own = fits[d := x.shape[1]]
                y = centred(x, own.n, own.sums)
                most = max(int(abs(y.max())), int(abs(y.min())))
                wide = y if most * most * d < 1 << 63 else y.astype(object)
                deviation = pa.array([str(s) for s in (wide * wide).sum(1)], pa.string())
                w = whitened(y, own)
                lists = list_array(w.ravel(), np.full(len(w), w.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), deviation, lists], ["vec_id", "d", "digits", "w"])

    made = good.mapInArrow(lean(run), "vec_id long, d int, digits string, w array<double>")

    def by_length(values: dict, kind: str):
        out = F.lit(None).cast(kind)
        for d, x in values.items():
            out = F.when(F.col("d") == d, x).otherwise(out)
        return out

    explained = by_length({d: F.array(*[F.lit(x).cast("double") for x in f.explained]) for d, f in fits.items()}, "array<double>")
    rows = made.select("*", F.posexplode("w").alias("k", "value"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        by_length({d: F.lit(f.n) for d, f in fits.items()}, "long").alias("n"),
        F.col("digits").try_cast("long").alias("deviation"),
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        F.get(explained, F.col("k")).alias("explained"),
        by_length({d: F.lit(x) for d, x in errors.items()}, "double").alias("identity_error"),
        F.col("digits").try_cast("decimal(38,0)").alias("deviation_exact"),
    )
