"""Packages: ZIP bundles, word documents from pages of lines, and what EXIF tells of an image. Standard library only."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.session import ship
from docloom.sources.docx import DocumentFile

#: A fixed time, so that equal files give equal archives.
_WHEN = (1980, 1, 1, 0, 0, 0)


def zipped(files: Sequence[tuple[str, bytes]], deflate: bool = True) -> bytes:
    """A ZIP of named contents, deflated (level 6) or stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED, compresslevel=6) as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, _WHEN)
            info.compress_type = z.compression
            z.writestr(info, data)
    return out.getvalue()


def bundles(df: DataFrame, bundle: str, order: str, name: str, content: str, deflate: bool = True) -> DataFrame:
    """df(bundle, order, name, content as binary) -> bundle, files, archive. A bundle is one archive, made by one task."""
    ship(df.sparkSession)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        names = [n or f"file-{i}" for i, n in enumerate(group.column(name).to_pylist(), 1)]
        data = zipped(list(zip(names, (x or b"" for x in group.column(content).to_pylist()))), deflate)
        return pa.table({bundle: group.column(bundle).slice(0, 1), "files": pa.array([group.num_rows], pa.int64()), "archive": pa.array([data], pa.binary())})

    kind = dict(df.dtypes)[bundle]
    return df.select(bundle, order, name, content).groupBy(bundle).applyInArrow(pack, f"`{bundle}` {kind}, files long, archive binary")


def docx(pages: Sequence[tuple[str, Sequence[str]]], empty: str = "") -> bytes:
    """A word document in memory: a titled section for each page, a paragraph for each line (`empty` for a page without any)."""
    out = io.BytesIO()
    book = DocumentFile(out)
    for title, lines in pages:
        book.page(title, lines or [empty])
    book.close()
    return out.getvalue()


#: EXIF tags of the image, of the EXIF part and of the GPS part.
MAKE, MODEL, ORIENTATION, SOFTWARE, TIME, EXIF_PART, GPS_PART = 0x010F, 0x0110, 0x0112, 0x0131, 0x0132, 0x8769, 0x8825
TAKEN, LAT_REF, LAT, LON_REF, LON = 0x9003, 1, 2, 3, 4
#: Bytes of a value by its type: byte, text, short, long, rational, signed byte, undefined, signed short, long, rational.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}


def _segments(jpeg: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of a JPEG's segments before the picture."""
    source = io.BytesIO(jpeg[2:])
    while len(head := source.read(4)) == 4 and head[0] == 0xFF and head[1] != 0xDA:
        yield head[1], source.read(max(0, int.from_bytes(head[2:], "big") - 2))


def _entries(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """A directory's tags; values outside the file are left out."""
    if not 0 < at <= len(tiff) - 2:
        return {}
    (n,) = struct.unpack_from(order + "H", tiff, at)
    found: dict[int, object] = {}
    for raw in (tiff[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)):
        if len(raw) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", raw[:8])
        size = _SIZE.get(kind, 0) * count
        start = struct.unpack(order + "I", raw[8:])[0]
        data = raw[8 : 8 + size] if size <= 4 else tiff[start : start + size]
        if not size or len(data) < size:
            continue
        if kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data)
            found[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        elif kind in (3, 4, 8, 9):
            found[tag] = list(struct.unpack(f"{order}{count}{dict(((3, 'H'), (4, 'I'), (8, 'h'), (9, 'i')))[kind]}", data))
        else:
            found[tag] = data.split(b"\0")[0].decode("utf-8", "replace").strip() if kind == 2 else data
    return found


def exif(data: bytes) -> dict:
    """make, model, software, date_time, latitude, longitude (six decimals, no zeros at the end), orientation, tags."""
    tiff = next((b[6:] for m, b in _segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), b"") if data[:2] == b"\xff\xd8" else b""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2], "")
    image = _entries(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order) if order and len(tiff) >= 8 else {}
    part = lambda tag: _entries(tiff, image[tag][0], order) if isinstance(image.get(tag), list) else {}
    taken, gps = part(EXIF_PART), part(GPS_PART)

    def place(ref: int, tag: int) -> str:
        v = gps.get(tag)
        if not isinstance(v, list) or len(v) != 3:
            return ""
        degrees = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if gps.get(ref) in ("S", "W") else 1)
        return f"{degrees:.6f}".rstrip("0").rstrip(".")

    said = lambda tag: str(image.get(tag, ""))
    return {
        "make": said(MAKE), "model": said(MODEL), "software": said(SOFTWARE), "date_time": str(taken.get(TAKEN) or image.get(TIME, "")),
        "latitude": place(LAT_REF, LAT), "longitude": place(LON_REF, LON), "orientation": str(image[ORIENTATION][0]) if ORIENTATION in image else "",
        "tags": len(image) + len(taken) + len(gps),
    }
