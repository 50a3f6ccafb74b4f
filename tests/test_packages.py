"""Archives, word documents, EXIF, passwords."""

import struct
import zipfile
from io import BytesIO

from docloom.functions import security
from docloom.sources import packages
from docloom.sources.office import document_paragraphs


def test_bundles(spark):
    d = spark.createDataFrame([(1, 2, "b.txt", b"two"), (1, 1, "a.txt", b"one"), (2, 1, "x", None)], "bundle int, ord int, name string, content binary")
    got = {r["bundle"]: (r["files"], r["archive"]) for r in packages.bundles(d, "bundle", "ord", "name", "content").collect()}
    with zipfile.ZipFile(BytesIO(got[1][1])) as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"two" and got[1][0] == 2
    with zipfile.ZipFile(BytesIO(got[2][1])) as z:
        assert z.read("x") == b""
    assert packages.zipped([("a", b"x" * 999)]) == packages.zipped([("a", b"x" * 999)]) and len(packages.zipped([("a", b"x" * 999)], False)) > 999


def test_docx_reads_back():
    data = packages.docx([("Page 1", ["one <&>", "two\x07"]), ("Page 2", [])], "nothing")
    assert [t for _, _, t, *_ in document_paragraphs(data)] == ["Page 1", "one <&>", "two", "Page 2", "nothing"]


def jpeg(order):
    """An image with make, orientation and time, an EXIF part with the time taken, and a GPS part."""
    text = lambda s: s.encode() + b"\0"
    tail, entries, base = b"", {}, 8
    parts = {
        "image": [(0x010F, 2, text("Maker")), (0x0112, 3, struct.pack(order + "H", 6)), (0x0132, 2, text("2020:01:01 00:00:00")), (0x8769, 4, "exif"), (0x8825, 4, "gps")],
        "exif": [(0x9003, 2, text("2024:05:06 07:08:09")), (0x9209, 3, struct.pack(order + "H", 0))],
        "gps": [(1, 2, text("S")), (2, 5, struct.pack(order + "6I", 33, 1, 30, 1, 0, 1)), (3, 2, text("E")), (4, 5, struct.pack(order + "6I", 151, 1, 12, 1, 36, 1))],
    }
    size = lambda p: 2 + 12 * len(p) + 4
    for name, p in parts.items():
        entries[name] = base
        base += size(p)
    out = b""
    for p in parts.values():
        out += struct.pack(order + "H", len(p))
        for tag, kind, value in p:
            if isinstance(value, str):
                value = struct.pack(order + "I", entries[value])
            count = len(value) // {2: 1, 3: 2, 4: 4, 5: 8}[kind]
            inline = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", base + len(tail))
            tail += b"" if len(value) <= 4 else value
            out += struct.pack(order + "HHI", tag, kind, count) + inline
        out += bytes(4)
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + out + tail
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


def test_exif():
    want = {"make": "Maker", "model": "", "software": "", "date_time": "2024:05:06 07:08:09", "latitude": "-33.5", "longitude": "151.21", "orientation": "6", "tags": 11}
    assert packages.exif(jpeg("<")) == packages.exif(jpeg(">")) == want
    nothing = {**dict.fromkeys(want, ""), "tags": 0}
    for data in (b"", b"\xff\xd8", b"\x89PNG", jpeg("<")[:20], jpeg(">")[:9]):
        assert packages.exif(data) == nothing


def test_passwords():
    groups = list(security.GROUPS.values())
    made = security.generate(24, groups)
    assert len(made) == 24 and all(set(made) & set(g) for g in groups) and security.generate(5, []) == "" and len(security.generate(2, groups)) == 2
    assert security.strength("password123")["score"] <= 1 and security.strength("") == {"bits": 0.0, "score": 0}
    assert security.strength("aaaaaaaaaaaa")["score"] <= 1 and security.strength(made)["score"] == 4
    assert [security.crack_time(x)[0] for x in (0.5, 5, 600, 9_000, 90_000, 4e7, 1e12)] == ["under a second", "seconds", "minutes", "hours", "days", "years", "century"]
