"""Shared ground of the training-data operators: shared-folder tables, shipping code, Arrow helpers.

Every table that cuts lineage is written under the folder in ``spark.checkpoint.dir``, which the driver
and all executors see, so a lost executor costs a re-read and never the job.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the vectorised kernels take at once; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Bytes of a Parquet row group, which a writing task holds in memory.
ROW_GROUP = 16 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Lets the workers import this package, and has Arrow batches small enough for long texts.

    Batches are made smaller only, never larger than the session asks for: later queries' results don't
    depend on it.
    """
    for key, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def trim() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(kernel: Callable, keeps: str = "") -> Callable:
    """The kernel of a mapInArrow, made to begin and end with little memory: workers are used again for other stages.

    keeps: the module whose cache the kernel works with; other operators' tasks drop it.
    """

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = sys.modules.get("docloom.llm.encoder")
        if cached is not None and keeps != cached.__name__:
            cached.release()
        try:
            yield from kernel(batches)
        finally:
            trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; only a session on one machine may do without, in its temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "docloom-shared")
        own = f"{top}/docloom/{spark.sparkContext.applicationId}"
        if own not in _shipped:
            _shipped.add(own)
            atexit.register(shutil.rmtree, own, True)
        base = f"file://{top}"
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has stored, results that have not been read yet included."""
    remove(spark, f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows starts from files, so Spark deletes the
    shuffle files of the writing when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_docloom_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions_of(df: DataFrame) -> int:
    """Shuffle partitions for explicit repartitioning: the session's number."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """Values that cut the integer key into about n ranges of as many rows, ascending.

    They come from exact counts, so the same rows give the same ranges, however they are partitioned. Intervals
    that hold too many rows are counted anew in finer steps; a single value is never cut.
    """
    low, high, total = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not total:
        return []
    goal, bins = -(-total // n), 4096
    parts = [(low, high, total)]
    for _ in range(6):  # 4096 ** 6 is more than there are integers
        large = [(a, b) for a, b, c in parts if c > goal and a < b]
        if not large:
            break
        wide = [-(-(b - a + 1) // bins) for a, b in large]
        k = F.col(key).cast("decimal(20,0)")
        at = F.lit(None).cast("long")
        for i, ((a, b), w) in enumerate(zip(large, wide)):
            at = F.when(F.col(key).between(a, b), F.floor((k - F.lit(a).cast("decimal(20,0)")) / F.lit(w).cast("decimal(20,0)")).cast("long") + i * bins).otherwise(at)
        counts = df.select(at.alias("at")).where("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("c")).collect()  # bins for each of at most n intervals
        fine = [(large[r["at"] // bins][0] + r["at"] % bins * wide[r["at"] // bins], r["at"] // bins, r["c"]) for r in counts]
        parts = [x for x in parts if x[2] <= goal or x[0] == x[1]] + [(a, min(a + wide[i] - 1, large[i][1]), c) for a, i, c in fine]
    bounds, held = [], 0
    for a, _, c in sorted(parts):
        if held and held + c > goal:
            bounds.append(a)
            held = 0
        held += c
    return bounds


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds a value has reached, by bisection; zero for null."""
    if not bounds:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at))


def binary_list(col: pa.Array) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return (col.cast(pa.binary()) if pa.types.is_string(col.type) else col.cast(pa.large_binary())).to_pylist()


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to at most `most`, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Arrow lists from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
