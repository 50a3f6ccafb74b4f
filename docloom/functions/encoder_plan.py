"""Argument lists of a media encoder, planned as expressions: what is run for a clip follows from its columns alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.layout import even, nearest

#: The encoder's codec names, sample rates by codec, and the file size from which nothing is moved to the front.
VIDEO_CODECS = {"h264": "libx264", "hevc": "libx265", "vp9": "libvpx-vp9"}
OPUS_RATES = [8_000, 12_000, 16_000, 24_000, 48_000]
AAC_RATES = [8_000, 11_025, 12_000, 16_000, 22_050, 24_000, 32_000, 44_100, 48_000, 64_000, 88_200, 96_000]
FRONT_BYTES = 512 * 1024 * 1024
TURNS = {90: ["transpose=1"], 180: ["hflip", "vflip"], 270: ["transpose=2"]}
THREADS = 4


def words(*parts: str | Column) -> Column:
    """A list of arguments; null if one is."""
    return F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def only(condition: Column, *parts: str | Column) -> Column:
    return F.when(condition, words(*parts)).otherwise(F.array().cast("array<string>"))


def cut(start: Column, end: Column, name: Column) -> Column:
    """The part of a file from start to end, of a twentieth of a second at least."""
    return words("-ss", F.format_string("%.3f", start), "-i", name, "-t", F.format_string("%.3f", F.greatest(F.lit(0.05), end - start)))


def rate_control(codec: Column, bitrate: Column, crf: Column) -> Column:
    """By quality where the bitrate is 0, else with a buffer of twice the rate."""
    number, unit = F.regexp_extract(bitrate, r"^(\d+(?:\.\d+)?)[kKmM]$", 1), F.upper(F.regexp_extract(bitrate, "([kKmM])$", 1))
    twice = F.when(number == "", bitrate).otherwise(F.concat(F.regexp_replace((number.try_cast("double") * 2).cast("string"), r"\.0$", ""), unit))
    return F.when(codec == "vp9", words("-b:v", F.when(bitrate == "", "0").otherwise(bitrate), "-crf", crf, "-row-mt", "1")).when(bitrate == "0", words("-preset", "veryfast", "-crf", crf)).otherwise(words("-preset", "veryfast", "-b:v", bitrate, "-maxrate", bitrate, "-bufsize", twice))


def sample_rate(rate: Column, codec: Column) -> Column:
    """The arguments for a sample rate that the codec has; none where the source's is kept (null)."""
    known = F.when(codec == "opus", nearest(rate, OPUS_RATES)).when(codec == "mp3", F.least(rate, F.lit(48_000))).otherwise(nearest(rate, AAC_RATES))
    return only(rate.isNotNull(), "-ar", known)


def picture(aspect: Column, resolution: Column, rotation: Column, flipped: Column) -> Column:
    """The filter for cutting to an aspect, or for a smaller short side, and for turning; the empty text if there is nothing to do."""
    short = F.coalesce(resolution.try_cast("int"), F.lit(1080))
    long = even(short * 16 / 9)
    short = even(short.cast("double"))
    w = F.when(aspect == "16:9", long).otherwise(short).cast("string")
    h = F.when(aspect == "9:16", long).otherwise(short).cast("string")
    join = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    cropped = join("crop=min(iw\\,ih*", w, "/", h, "):min(ih\\,iw*", h, "/", w, "),scale=", w, ":", h, ":flags=lanczos,setsar=1")
    smaller = join("scale=w='if(lte(iw\\,ih)\\,min(iw\\,", resolution, ")\\,-2)':h='if(gt(iw\\,ih)\\,min(ih\\,", resolution, ")\\,-2)':flags=lanczos")
    sized = F.when(aspect != "source", F.array(cropped)).when(resolution != "source", F.array(smaller)).otherwise(F.array().cast("array<string>"))
    turned = F.array().cast("array<string>")
    for degrees, filters in TURNS.items():
        turned = F.when(rotation == degrees, words(*filters)).otherwise(turned)
    return F.array_join(F.concat(sized, turned, only(flipped, "hflip")), ",")


def sound(mode: Column, container: Column, bitrate: Column, rate: Column) -> Column:
    """The first sound track: removed, copied, or encoded as the container asks for."""
    opus = container == "webm"
    made = F.concat(words("-map", "0:a:0?", "-c:a", F.when(opus, "libopus").otherwise("aac"), "-b:a", bitrate), sample_rate(rate, F.when(opus, "opus").otherwise("aac")))
    return F.when(mode == "remove", words("-an")).when(mode == "copy", words("-map", "0:a:0?", "-c:a", "copy")).otherwise(made)


def encode(c: dict[str, Column]) -> Column:
    """A clip encoded anew, or only cut where the bitrate is `copy`."""
    front = only((c["container"] == "mp4") & (c["bytes"] < FRONT_BYTES), "-movflags", "+faststart")
    tracks = sound(c["audio_mode"], c["container"], c["audio_bitrate"], c["audio_rate"])
    filters = picture(c["aspect"], c["resolution"], c["rotation"], c["flipped"])
    codec = F.lit(VIDEO_CODECS["vp9"])
    for name in ("h264", "hevc"):
        codec = F.when(c["codec"] == name, VIDEO_CODECS[name]).otherwise(codec)
    begin = F.concat(cut(c["start"], c["end"], c["input"]), words("-map", "0:v:0"))
    kept = F.concat(begin, words("-c:v", "copy"), tracks, words("-avoid_negative_ts", "make_zero"), front, words(c["output"]))
    made = F.concat(begin, only(filters != "", "-vf", filters), words("-c:v", codec), rate_control(c["codec"], c["bitrate"], c["crf"]), words("-threads", str(THREADS)), only((c["codec"] == "hevc") & (c["container"] == "mp4"), "-tag:v", "hvc1"), tracks, front, words(c["output"]))
    return F.when(c["bitrate"] == "copy", kept).otherwise(made)


def animation(c: dict[str, Column]) -> Column:
    """A clip as a GIF of at most a width, with a palette of its own."""
    graph = F.concat(F.lit("fps="), c["fps"].cast("string"), F.lit(",scale=min("), c["width"].cast("string"), F.lit("\\,iw):-2:flags=lanczos,split[s0][s1];[s0]palettegen=max_colors=192[p];[s1][p]paletteuse=dither=sierra2_4a"))
    return F.concat(cut(c["start"], c["end"], c["input"]), words("-filter_complex", graph, "-loop", "0", c["output"]))


def audio(c: dict[str, Column]) -> Column:
    """The first sound track alone, as MP3 or AAC."""
    mp3 = c["format"] == "mp3"
    return F.concat(cut(c["start"], c["end"], c["input"]), words("-map", "0:a:0", "-vn", "-c:a", F.when(mp3, "libmp3lame").otherwise("aac"), "-b:a", c["audio_bitrate"]), sample_rate(c["audio_rate"], F.when(mp3, "mp3").otherwise("aac")), words(c["output"]))
