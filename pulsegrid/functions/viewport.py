"""Viewport arithmetic over sampled signals: structs of lo and hi, in the units of the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZOOM_STEP = 1.2
KEY_STEP = 0.1
MIN_SPAN_MS = 500
MIN_PERCENT = 0.5


def span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def clamp(lo: Column, hi: Column, low: Column, high: Column) -> Column:
    """Move a range into its bounds and keep its span; a range as wide as the bounds becomes the bounds."""
    width = hi - lo
    return F.when(width >= high - low, span(low, high)).when(lo < low, span(low, low + width)).when(hi > high, span(high - width, high)).otherwise(span(lo, hi))


def duration_s(samples: Column, rate: Column) -> Column:
    return samples / rate


def end_ms(start_ms: Column, samples: Column, rate: Column) -> Column:
    return start_ms + duration_s(samples, rate) * 1000


def initial(duration: Column, window: float = 10.0, asked_lo: Column | None = None, asked_hi: Column | None = None) -> Column:
    """The last ``window`` seconds, or all of a shorter signal; an asked range, cut to the signal, if it is one."""
    if asked_lo is not None and asked_hi is not None:
        lo, hi = F.greatest(F.lit(0.0), asked_lo), F.least(duration, asked_hi)
        return F.when(hi > lo, span(lo, hi)).otherwise(span(F.lit(0.0), duration))
    return span(duration - F.least(F.lit(window), duration), duration)


def zoom_to(start_ms: Column, stop_ms: Column, signal_start_ms: Column, duration: Column) -> Column:
    return clamp((start_ms - signal_start_ms) / 1000, (stop_ms - signal_start_ms) / 1000, F.lit(0.0), duration)


def jump_to(at_ms: Column, signal_start_ms: Column, lo: Column, hi: Column, duration: Column) -> Column:
    """Centre on a time and keep the span."""
    centre, half = (at_ms - signal_start_ms) / 1000, (hi - lo) / 2
    return clamp(centre - half, centre + half, F.lit(0.0), duration)


def zoom_about(cursor: Column, lo: Column, hi: Column, duration: Column, *, out: bool) -> Column:
    factor = ZOOM_STEP if out else 1 / ZOOM_STEP
    return clamp(cursor - (cursor - lo) * factor, cursor + (hi - cursor) * factor, F.lit(0.0), duration)


def pan_pixels(pixels: Column, width: Column, lo: Column, hi: Column, duration: Column) -> Column:
    by = -(pixels / width) * (hi - lo)
    return clamp(lo + by, hi + by, F.lit(0.0), duration)


def pan_key(lo: Column, hi: Column, duration: Column, *, right: bool) -> Column:
    by = (hi - lo) * (KEY_STEP if right else -KEY_STEP)
    return clamp(lo + by, hi + by, F.lit(0.0), duration)


def zoom_in(lo_ms: Column, hi_ms: Column) -> Column:
    centre, width = (lo_ms + hi_ms) / 2, F.greatest(F.lit(float(MIN_SPAN_MS)), (hi_ms - lo_ms) / 2)
    return span(centre - width / 2, centre + width / 2)


def zoom_out(lo_ms: Column, hi_ms: Column, full_ms: Column) -> Column:
    centre, width = (lo_ms + hi_ms) / 2, F.least(full_ms, (hi_ms - lo_ms) * 2)
    return span(centre - width / 2, centre + width / 2)


def percents(lo_ms: Column, hi_ms: Column, signal_start_ms: Column, duration: Column) -> Column:
    """struct(left, width) of a viewport on the overview, in percent."""
    part = lambda x: x / 1000 / duration * 100
    left = F.greatest(F.lit(0.0), F.least(F.lit(100.0), part(lo_ms - signal_start_ms)))
    width = F.greatest(F.lit(MIN_PERCENT), F.least(F.lit(100.0), part(hi_ms - lo_ms)))
    return F.struct(left.alias("left"), width.alias("width"))


def reset(duration: Column) -> Column:
    return span(F.lit(0.0), duration)
