"""Edits of sample arrays: higher-order functions, no shuffle. Positions count from zero, ends are exclusive."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def selection(seconds: Column, rate: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n, F.floor(seconds * rate + 0.5))).cast("int")


def within(v: Column, start: Column, end: Column, f) -> Column:
    """f(sample, index in the selection) inside the selection, the sample elsewhere."""
    return F.transform(v, lambda x, i: F.when((i >= start) & (i < end), f(x, i - start)).otherwise(x))


def mute(v: Column, start: Column, end: Column) -> Column:
    return within(v, start, end, lambda x, i: F.lit(0.0))


def copy(v: Column, start: Column, end: Column) -> Column:
    return F.slice(v, start + 1, end - start)


def delete(v: Column, start: Column, end: Column) -> Column:
    return F.concat(F.slice(v, F.lit(1), start), F.slice(v, end + 1, F.greatest(F.size(v) - end, F.lit(0))))


def paste(v: Column, at: Column, clip: Column) -> Column:
    return F.concat(F.slice(v, F.lit(1), at), clip, F.slice(v, at + 1, F.greatest(F.size(v) - at, F.lit(0))))


def fade(v: Column, start: Column, end: Column, into: bool) -> Column:
    steps = F.greatest(F.lit(1), end - start - 1)
    return within(v, start, end, lambda x, i: x * (i / steps if into else 1.0 - i / steps))


def gain(v: Column, start: Column, end: Column, by: Column) -> Column:
    by = F.when(by.isNull() | F.isnan(by), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(4.0), by)))
    return within(v, start, end, lambda x, i: clamp(x * by))


def peak(v: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(copy(v, start, end), lambda x: F.abs(x))), F.lit(0.0))


def normalize(v: Column, start: Column, end: Column, peak: Column) -> Column:
    """peak: over all channels of the clip."""
    by = F.when(peak > 0, F.least(F.lit(16.0), 0.98 / peak)).otherwise(1.0)
    return within(v, start, end, lambda x, i: clamp(x * by))


def robot(v: Column, rate: Column) -> Column:
    return F.transform(v, lambda x, i: clamp(x * (0.18 + 0.82 * F.sin(F.lit(2 * math.pi * 55.0) * i / rate))))


def resample(v: Column, n: Column) -> Column:
    """Linear interpolation to n samples, the ends in place."""
    last = F.size(v) - 1

    def at(i: Column) -> Column:
        place = F.when(n > 1, i * last / (n - 1)).otherwise(0.0)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, last)
        a, b = F.get(v, low), F.get(v, high)
        return a + (b - a) * (place - low)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def crossfade(v: Column, start: Column, wet: Column, ramp: Column) -> Column:
    """Replaces what lies under `wet` with it, blended over `ramp` samples at both ends."""
    n = F.size(wet)
    ramp = F.greatest(F.lit(1), F.least(ramp, F.floor(n / 2.0).cast("int")))

    def blend(x: Column, i: Column) -> Column:
        mix = F.least(F.lit(1.0), i / ramp, (n - 1 - i) / ramp)
        return x * (1.0 - mix) + F.get(wet, i) * mix

    return within(v, start, start + n, blend)


def pcm16(v: Column) -> Column:
    """Samples as 16-bit integers; negative ones reach one further."""
    return F.transform(v, lambda x: (clamp(x) * F.when(x < 0, 32768.0).otherwise(32767.0)).cast("int"))


def interleave(channels: Column) -> Column:
    """Equal channels to frames one after another."""
    n = F.size(F.get(channels, F.lit(0)))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(channels, lambda c: F.get(c, i))))


def history_limit(bytes_: Column) -> Column:
    """Undo states that 128 MiB hold: one to twelve."""
    return F.greatest(F.lit(1), F.least(F.lit(12), F.floor(F.lit(134217728.0) / F.greatest(bytes_, F.lit(1))))).cast("long")
