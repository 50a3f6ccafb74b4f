"""Audio as a Spark data source, `docloom-wav`: 16-bit PCM in WAV files.

    spark.read.format("docloom-wav").load(path)             # path, rate, channels, start, samples, error
    write_wav(df, path)                                     # df: name, rate, channels, start, samples

A row is a block of frames from `start`, its samples interleaved, each a number from -1 to 1. A long file is
read in ranges of frames by several tasks, many short files by one, which reads their headers too. When writing, the blocks of one name make one file, in order of start. A file that
is no such WAV is a row with its error.
"""

from __future__ import annotations

import contextlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from docloom.session import ship
from docloom.sources.storage import Job, Written, located, sizes

SCHEMA = "path string, rate int, channels int, start long, samples array<float>, error string"
#: Frames of a row and of a range, at whose ends rows end.
BLOCK, RANGE = 65_536, 1 << 22
#: Bytes that one task reads, if it reads several ranges or files, what a file counts at least, and samples of an Arrow batch.
TASK, OPEN, BATCH = 4 << 20, 32 << 10, 1 << 18
_ARROW = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


@dataclass
class Frames:
    """Frames of a file, of all of it without `last`."""

    path: str
    first: int = 0
    last: int | None = None
    error: str | None = None


@dataclass
class Several(InputPartition):
    frames: list[Frames]


def header(f) -> tuple[int, int, int, int]:
    """Rate, channels, where the samples begin and how many bytes they take; chunks of other kinds are passed over."""
    size = f.size()
    if (head := f.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    form = None
    while len(chunk := f.read(8)) == 8:
        kind, n = chunk[:4], int.from_bytes(chunk[4:], "little")
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", f.read(16))
            f.seek(f.tell() + n + n % 2 - 16)
        elif kind == b"data":
            if form is None or form[0] not in (1, 0xFFFE) or form[5] != 16 or not form[1]:
                raise ValueError("UNSUPPORTED_FORMAT")
            return form[2], form[1], f.tell(), min(n, size - f.tell())
        else:
            f.seek(f.tell() + n + n % 2)
    raise ValueError("no samples")


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("frames", RANGE))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Several] = []
        full = TASK
        files = located(self.path)[0]
        for p, size in sizes(self.path, (".wav",)):
            if size > TASK:
                out += [Several([x]) for x in self._ranges(files, p)]
                full = TASK
                continue
            own = max(OPEN, size)
            if full + own > TASK:
                out.append(Several([]))
                full = 0
            out[-1].frames.append(Frames(p))
            full += own
        return out

    def _ranges(self, files, path: str) -> list[Frames]:
        try:
            with files.open_input_file(path) as f:
                _, channels, _, n = header(f)
            frames = n // (2 * channels)
            step = self.range * max(1, TASK // (self.range * 2 * channels))
            return [Frames(path, a, min(frames, a + step)) for a in range(0, max(1, frames), step)]
        except Exception as e:  # a file's fault is its own row
            return [Frames(path, error=str(e))]

    def read(self, partition: Several) -> Iterator[pa.RecordBatch]:
        files, held, many = located(self.path)[0], [], 0
        for p in partition.frames:
            for row in self._rows(files, p):
                held.append(row)
                many += 0 if row[4] is None else len(row[4])
                if many >= BATCH or len(held) >= BATCH:
                    yield self._batch(held)
                    held, many = [], 0
        if held:
            yield self._batch(held)

    def _rows(self, files, p: Frames) -> Iterator[tuple]:
        if p.error:
            yield p.path, None, None, None, None, p.error
            return
        with contextlib.ExitStack() as opened:
            try:
                f = opened.enter_context(files.open_input_file(p.path))
                rate, channels, data, n = header(f)
            except Exception as e:  # a file's fault is its own row
                yield p.path, None, None, None, None, str(e)
                return
            last = n // (2 * channels) if p.last is None else p.last
            f.seek(data + p.first * 2 * channels)
            a = p.first
            while a < last:
                end = min(last, a + BLOCK, a - a % self.range + self.range)
                raw = f.read((end - a) * 2 * channels)
                yield p.path, rate, channels, a, np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32768), None
                a = end

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def pcm(samples: np.ndarray) -> bytes:
    """Numbers from -1 to 1 as 16-bit samples: beyond that cut off, towards zero, one more step below zero than above."""
    x = np.clip(np.nan_to_num(samples), -1, 1)
    return np.trunc(np.where(x < 0, x * 32768, x * 32767)).astype("<i2").tobytes()


class WavWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.job, self.names = Job(options["path"], overwrite), schema.fieldNames()
        if missing := {"name", "rate", "channels", "samples"} - set(self.names):
            raise ValueError(f"no columns {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, now, form, body = Written(), None, (0, 0), []

        def end() -> None:
            if now is None:
                return
            n = sum(map(len, body))
            if n > 0xFFFFFFFF - 36:
                raise ValueError(f"{now}: a WAV file holds 4 GB")
            made = self.job.task_name(".wav")
            with self.job.stream(made) as f:
                rate, channels = form
                f.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", n))
                for b in body:
                    f.write(b)
            out.names.append((made, f"{now}.wav"))

        for batch in iterator:
            columns = {n: batch.column(n) for n in self.names}
            for i, name in enumerate(columns["name"].to_pylist()):
                if name != now:
                    end()
                    now, form, body = name, (columns["rate"][i].as_py(), columns["channels"][i].as_py()), []
                samples = columns["samples"][i].values
                body.append(pcm(samples.to_numpy(zero_copy_only=False).astype(np.float64)) if samples is not None else b"")
        end()
        return out

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.abort()


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom-wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WavSource)


def write_wav(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df(name, rate, channels, start, samples): a file for each name, made by one task."""
    register(df.sparkSession)
    df.repartition("name").sortWithinPartitions("name", "start").write.format("docloom-wav").mode(mode).save(path)
