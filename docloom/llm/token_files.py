"""Token-ID files: Simple-8b blocks behind an index, written as shards with manifests and read back.

A shard holds documents in ascending id order::

    magic "S8BTOK2\\n" | blocks | index | footer (index offset, lengths; 40 bytes)

A block holds up to `BLOCK` ids of the concatenated documents, and the index has every block's offset and
number of words, and every document's id, number of ids and whether it has an id. A shard is written under a temporary name,
renamed when whole, and named in the manifest only then; a task that is run again writes a new name, so a
lost executor leaves at most a file that no manifest names.

Null text counts as empty; an empty document is its end id alone; repeated doc_ids stay separate documents
(in the order of their ids' bytes); documents without a doc_id come first. An empty table gives no shard rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import simple8b
from docloom.llm.common import lean, new_path, partitions_of, ready, store

MAGIC = b"S8BTOK2\n"
BLOCK = 1 << 16
_FOOTER = struct.Struct("<QQQQ8s")


def filesystem(uri: str):
    """The file system of a shared folder, by its URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Streams one shard; holds one block of ids and the index."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        sink.write(MAGIC)
        self.pending: list[bytes] = []
        self.held = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.docs = array("q")  # id, ids, whether it has an id

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.extend((doc_id or 0, len(ids) // 4, doc_id is not None))
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(data) if last else len(data) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            part = data[i : min(i + BLOCK, end)]
            words = simple8b.encode(part).astype("<u8").tobytes()
            self.sink.write(words)
            self.blocks.append((self.at, len(words) // 8, len(part)))
            self.at += len(words)
        self.pending, self.held = [data[end:].tobytes()], len(data) - end

    def close(self) -> None:
        self.flush(True)
        blocks, docs = np.array(self.blocks, "<i8").reshape(-1, 3), np.array(self.docs, "<i8").reshape(-1, 3)
        self.sink.write(blocks.tobytes())
        self.sink.write(docs.tobytes())
        self.sink.write(_FOOTER.pack(self.at, len(blocks), len(docs), int(docs[:, 1].sum()), MAGIC))


def read_shard(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of every document of a shard, a block at a time."""
    size = source.size()
    source.seek(size - _FOOTER.size)
    at, n_blocks, n_docs, _, magic = _FOOTER.unpack(source.read(_FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(at)
    blocks = np.frombuffer(source.read(24 * n_blocks), "<i8").reshape(-1, 3)
    docs = np.frombuffer(source.read(24 * n_docs), "<i8").reshape(-1, 3)
    have, held, b = [], 0, 0
    for doc_id, n, known in docs.tolist():
        while held < n:
            offset, words, count = blocks[b].tolist()
            source.seek(offset)
            have.append(simple8b.decode(np.frombuffer(source.read(8 * words), "<u8"), count).astype("<u4"))
            held, b = held + count, b + 1
        data = have[0] if len(have) == 1 else np.concatenate(have) if have else np.zeros(0, "<u4")
        yield doc_id if known else None, data[:n].tobytes()
        have, held = [data[n:]], held - n


def write_token_files(docs: DataFrame, tokenizer: str, mode: str, end_id: int, folder: str) -> DataFrame:
    """docs(doc_id, text) -> manifest rows (shard, path, first_doc, n_docs, n_tokens), stored."""
    spark = docs.sparkSession
    ready(spark)
    tail = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from docloom.llm.encoder import encoder

        shard = TaskContext.get().partitionId()
        out, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files, base = filesystem(folder)
                files.create_dir(base, recursive=True)
                name = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.s8b"
                sink = files.open_output_stream(f"{name}.tmp", compression=None)
                out, first = Writer(sink), batch.column(0)[0].as_py()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(tokenizer, mode).encode(texts)):
                    out.add(doc_id, ids + tail)
        if out is not None:
            out.close()
            sink.close()
            files.move(f"{name}.tmp", name)
            n = sum(out.docs[1::3])
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name.rsplit("/", 1)[1]], "first_doc": pa.array([first], pa.int64()), "n_docs": [len(out.docs) // 3], "n_tokens": [n]})

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions_of(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(lean(write, "docloom.llm.encoder"), "shard long, name string, first_doc long, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    spark = manifest.sparkSession
    ready(spark)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    listed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).select("name", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, root = filesystem(folder)
                rows: tuple[list, list, list, list] = ([], [], [], [])
                with files.open_input_file(f"{root}/{name}") as source:
                    for doc_id, ids in read_shard(source):
                        for to, x in zip(rows, (doc_id, base, len(ids) // 4, zlib.crc32(ids))):
                            to.append(x)
                        base += len(ids) // 4
                        if len(rows[0]) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one shard a task: reading is spread as widely as writing was
    spread = listed.repartition(max(1, min(partitions_of(manifest), 100_000)), "name")
    return spread.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, mode: str = "byte_level", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the token files and reads them back."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, mode, end_id, folder), folder)
