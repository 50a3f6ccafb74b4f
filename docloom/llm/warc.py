"""Web archives: a deterministic sharded WARC writer and a reader.

Pages are range-sorted by id into shards, whose bounds come from exact counts; a shard's files roll over at a
compressed size, every record a gzip member of its own. Headers and digests are made anew from the payload. Of
pages with equal payloads that with the largest id is a response and the others revisit it. A file is written
under a temporary name and, when whole, renamed by its shard, its place in it and the digest of its bytes. So the
same pages give the same files, and a task that runs twice, or a whole run that is repeated, writes over its own.
Files count only if the manifest (a table that Spark commits) names them.

Nulls and edge cases: null html is an empty payload; a null url becomes ``urn:page:<id>``; line ends in urls
are escaped; rows that repeat the largest id of a payload are all responses; a page without an id revisits one with
an id, and is a response where none has. An empty table gives no file; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import lean, new_path, partitions_of, range_bounds, range_of, ready, store
from docloom.llm.token_files import filesystem

ROLL_BYTES = 64 << 20
#: Up to so many repeated payloads (about 90 bytes each) are looked up by broadcast; more by a shuffle on the digest.
BROADCAST_PAYLOADS = 200_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; refers_to: the response's page for a revisit."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def members(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out = zlib.decompressobj(31), []
    while data := source.read(size):
        while data:
            out.append(z.decompress(data))
            if not z.eof:
                break
            yield b"".join(out)
            data, z, out = z.unused_data, zlib.decompressobj(31), []
    if b"".join(out):
        raise ValueError("truncated archive")


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html) -> manifest rows (name, bytes, records, first_page, last_page), stored."""
    ready(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("d"))
    same = own.where(F.octet_length("html") >= least).groupBy("d").agg(F.count("*").alias("c"), F.max("page_id").alias("last")).where("c > 1").select("d", "last")
    same = store(same, "payloads")
    few = same.count() <= BROADCAST_PAYLOADS
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    dealt = own.join(F.broadcast(same) if few else same, "d", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        sink, now, part = None, None, 0
        done: list[tuple] = []

        def put(data: bytes) -> int:
            sink.write(data)
            whole.update(data)
            return len(data)

        def close() -> None:
            sink.close()
            name = f"{title}-{whole.hexdigest()[:12]}.warc.gz"
            files.move(f"{base}/{temporary}", f"{base}/{name}")
            done.append((name, held, records, first, last))

        for batch in batches:
            for page_id, url, text, refers_to, shard in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if sink is not None and (held >= roll or shard != now):
                    close()
                    sink, part = None, part + 1
                if sink is None:
                    if now is None:
                        files.create_dir(base, recursive=True)
                    now, part = shard, part if shard == now else 0
                    title, temporary, whole = f"pages-{shard:06d}-{part:04d}", f"{uuid.uuid4().hex}.tmp", hashlib.sha1()
                    sink = files.open_output_stream(f"{base}/{temporary}", compression=None)
                    held, records, first = put(member(info_record(title, date))), 0, page_id
                held += put(member(record(page_id, url, text.encode(), refers_to, date)))
                records, last = records + 1, page_id
        if sink is not None:
            close()
        if done:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*done), kinds)], ["name", "bytes", "records", "first_page", "last_page"])

    n = partitions_of(pages)
    dealt = dealt.withColumn("shard", range_of(F.col("page_id"), range_bounds(own, "page_id", n)))
    sorted_pages = dealt.repartitionByRange(n, "shard").sortWithinPartitions("shard", "page_id", "url", "html")
    return store(sorted_pages.mapInArrow(lean(write), "name string, bytes long, records long, first_page long, last_page long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in the manifest's files.

    The digests of responses are computed anew from the payload; one that differs from its header is an error.
    """
    ready(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        whole = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for data in members(source):
                        headers, block = parse(data)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        n = int(http.rpartition(b":")[2])
                        if headers["warc-type"] == "response" and (digest32(payload), len(payload)) != (digest, n):
                            raise ValueError(f"{name}: payload digest of page {headers['warc-page-id']}")
                        rows.append((whole(headers["warc-page-id"]), headers["warc-target-uri"], n, digest, headers["warc-type"], whole(headers.get("warc-refers-to-page-id"))))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)

    spread = manifest.select("name").repartition(partitions_of(manifest), "name")
    return spread.mapInArrow(lean(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Writes the pages' archives and reads them back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **settings), folder)
