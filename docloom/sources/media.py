"""What a file's first bytes tell: text encoding, image type, sample rate, encrypted containers."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

ENCRYPTED = bytes.fromhex("D0CF11E0A1B11AE1")
#: Sample rates by MPEG version bits.
_MPEG_RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
_DURATION = re.compile(r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)")


def decode_text(data: bytes, encoding: str | None = None) -> str:
    """By the stated encoding, strictly; else UTF-8, else Windows-949."""
    if encoding:
        return data.decode({"euc-kr": "cp949"}.get(encoding.lower(), encoding))
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp949")


def image_type(data: bytes) -> str | None:
    return "png" if data.startswith(b"\x89PNG\r\n\x1a\n") else "jpeg" if data.startswith(b"\xff\xd8\xff") else None


def is_encrypted(data: bytes) -> bool:
    return data.startswith(ENCRYPTED)


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) of a RIFF file's chunks, as far as they are there; bodies are padded to even length."""
    source = io.BytesIO(data[12:])
    while len(head := source.read(8)) == 8:
        size = int.from_bytes(head[4:], "little")
        yield head[:4], source.read(size + size % 2)[:size]


#: A frame of MPEG audio: eleven set bits, the version (not 1), the layer (not 0), a bitrate, the rate's place (not 3).
_FRAME = re.compile(rb"(?=\xff([\xe2-\xe7\xf2-\xff])([\x00-\xff])[\x00-\xff])")


def sample_rate(data: bytes, name: str = "") -> int | None:
    """From a WAV or MP3 header; None if there is none."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        form = next((body for name, body in riff_chunks(data) if name == b"fmt "), b"")
        # tag, channels, rate, bytes a second, block, bits: sixteen bytes
        rate = struct.unpack("<HHIIHH", form[:16])[2] if len(form) >= 16 else 0
        if 3_000 <= rate <= 384_000:
            return rate
    tagged = data[:3] == b"ID3"
    if not (tagged or name.lower().endswith(".mp3") or data[:2] >= b"\xff\xe0"):
        return None
    # a tag's size has seven bits a byte
    skip = 10 + sum((b & 0x7F) << 7 * k for k, b in enumerate(data[9:5:-1])) if tagged else 0
    for m in _FRAME.finditer(data, skip):
        version, layer, place = m[1][0] >> 3 & 3, m[1][0] >> 1 & 3, m[2][0] >> 2 & 3
        if layer and place < 3 and version in _MPEG_RATES:
            return _MPEG_RATES[version][place]
    return None


def probe_log(text: str) -> dict:
    """Duration, size and frame rate from an encoder's log; rotated by a quarter, width and height swap."""
    out: dict = {}
    if m := _DURATION.search(text):
        out["duration"] = int(m[1]) * 3600 + int(m[2]) * 60 + float(m[3])
    line = next((x for x in text.splitlines() if "Video:" in x and "attached pic" not in x), "")
    if m := re.search(r"\b(\d{2,5})x(\d{2,5})\b", line):
        out["width"], out["height"] = int(m[1]), int(m[2])
    if m := re.search(r"(\d+(?:\.\d+)?)\s*(?:fps|tbr)", line):
        out["fps"] = float(m[1])
    if (m := re.search(r"rotat\w*(?:\s*of)?\s*:?\s*(-?\d+(?:\.\d+)?)", text)) and round(float(m[1]) / 90) % 2 and "width" in out:
        out["width"], out["height"] = out["height"], out["width"]
    return out


def wav(samples: list[list[float]], rate: int) -> bytes:
    """Channels of equal length as 16-bit PCM."""
    frames = [max(-1.0, min(1.0, x)) for frame in zip(*samples, strict=True) for x in frame]
    body = struct.pack(f"<{len(frames)}h", *[int(x * (32768 if x < 0 else 32767)) for x in frames])
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * 2, n * 2, 16, b"data", len(body)) + body
