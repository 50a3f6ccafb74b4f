"""Geometry and planning expressions: collage, fit, output sizes, affine maps, pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import round_half_up


def even(x: Column) -> Column:
    r = F.greatest(F.lit(2), round_half_up(x))
    return (r - r % 2).cast("long")


def output_size(width: Column, height: Column, aspect: str, resolution: str) -> tuple[Column, Column]:
    """Short side by resolution, never larger than the source; sides are even."""
    short = F.least(width, height)
    short = even(short if resolution == "source" else F.least(short, F.lit(int(resolution))))
    long = even(short * 16.0 / 9.0)
    if aspect == "9:16":
        return short, long
    if aspect == "1:1":
        return short, short
    if aspect == "16:9":
        return long, short
    return F.when(width <= height, short).otherwise(even(short * width / height)), F.when(width <= height, even(short * height / width)).otherwise(short)


def contain(w: Column, h: Column, width: float, height: float) -> dict[str, Column]:
    scale = F.least(F.lit(float(width)) / w, F.lit(float(height)) / h)
    return {"dest_x": (width - w * scale) / 2.0, "dest_y": (height - h * scale) / 2.0, "dest_w": w * scale, "dest_h": h * scale}


def cover(w: Column, h: Column, width: float, height: float) -> dict[str, Column]:
    ratio = width / height
    wide = w / h > ratio
    cw, ch = F.when(wide, h * ratio).otherwise(w.cast("double")), F.when(wide, h.cast("double")).otherwise(w / ratio)
    return {"source_x": (w - cw) / 2.0, "source_y": (h - ch) / 2.0, "crop_w": cw, "crop_h": ch}


def nearest(value: Column, candidates: list[int]) -> Column:
    """The closest candidate; the earlier of two as close, the first for null."""
    apart = [F.struct(F.abs(F.lit(x) - value).alias("by"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(candidates)]
    return F.array_min(F.array(*apart))["x"]


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def affine_bounds(m: tuple[Column, ...], x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """The box around a rectangle under (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f."""
    a, b, c, d, e, f = m
    corners = [(x, y), (x + w, y), (x, y + h), (x + w, y + h)]
    xs, ys = [a * i + c * j + e for i, j in corners], [b * i + d * j + f for i, j in corners]
    known = (x + y + w + h + a + b + c + d + e + f).isNotNull()
    return {n: F.when(known, v) for n, v in (("left", F.least(*xs)), ("top", F.least(*ys)), ("right", F.greatest(*xs)), ("bottom", F.greatest(*ys)))}


def page_fit(w: Column, h: Column, margin: float = 28.0) -> dict[str, Column]:
    """An image on A4, upright or lying by its shape, never enlarged beyond 0.75 points a pixel."""
    pw, ph = F.when(w > h, 841.89).otherwise(595.28), F.when(w > h, 595.28).otherwise(841.89)
    scale = F.least(F.lit(1.0), (pw - 2 * margin) / (w * 0.75), (ph - 2 * margin) / (h * 0.75))
    dw, dh = w * 0.75 * scale, h * 0.75 * scale
    return {"page_w": pw, "page_h": ph, "x": (pw - dw) / 2.0, "y": (ph - dh) / 2.0, "w": dw, "h": dh}


def selection_after(command: Column, start: Column, end: Column, cursor: Column, pasted: Column, length: Column, in_place: tuple[str, ...], shortest: float) -> dict[str, Column]:
    """start, until of the selection (start, end; null: none) after an edit of a clip that is now `length` seconds long."""
    fallback = F.least(F.coalesce(start, F.lit(0.0)), F.greatest(F.lit(0.0), length - shortest))
    wanted = F.when(command.isin(*in_place), F.when(start.isNotNull(), F.struct(start.alias("a"), end.alias("b")))).when(command == "PASTE", F.struct(cursor.alias("a"), (cursor + pasted).alias("b")))
    wanted = wanted.when(command == "TRIM", F.struct(F.lit(0.0).alias("a"), length.alias("b"))).otherwise(F.struct(fallback.alias("a"), F.least(length, fallback + 1.0).alias("b")))
    first = F.greatest(F.lit(0.0), F.least(wanted["a"], length - shortest))
    there = wanted.isNotNull() & (length >= shortest)
    return {"start": F.when(there, first), "until": F.when(there, F.greatest(first + shortest, F.least(wanted["b"], length)))}


def inverse(m: tuple[Column, ...]) -> tuple[tuple[Column, ...], Column]:
    """The map that undoes (a, b, c, d, e, f), and its determinant; null entries where it is zero."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    by = F.when(F.abs(det) >= 2.0**-52, det)
    return (d / by, -b / by, -c / by, a / by, (c * f - d * e) / by, (b * e - a * f) / by), det


def image_region(m: tuple[Column, ...], selection: tuple[Column, ...], crop: tuple[Column, Column], size: tuple[Column, Column], source: tuple[Column, Column]) -> dict[str, Column]:
    """A selection (left, top, width, height) on a canvas as whole pixels of an image: error, left_, top_, width, height."""
    back, _ = inverse(m)
    box = affine_bounds(back, *selection)
    near = lambda x: F.round(x, 6)  # noqa: E731  what is a whole pixel but for rounding stays one
    at = lambda name, k: box[name] + crop[k] + size[k] / 2.0
    left, top = (F.greatest(F.lit(0), F.floor(near(at(n, k))).cast("long")) for k, n in enumerate(("left", "top")))
    right, bottom = (F.least(source[k].cast("long"), F.ceil(near(at(n, k))).cast("long")) for k, n in enumerate(("right", "bottom")))
    singular = box["left"].isNull()
    empty = (right <= left) | (bottom <= top)
    fine = ~singular & ~empty
    return {"error": F.when(singular, "INVALID_TRANSFORM").when(empty, "NO_OVERLAP"), "left_": F.when(fine, left), "top_": F.when(fine, top), "width": F.when(fine, right - left), "height": F.when(fine, bottom - top)}
