"""Column expressions: angles, dates, coordinates, names, mode counts. All run inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def angle_mod(degrees: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def angle_diff(start: Column, end: Column) -> Column:
    """The shortest signed arc from start to end, in [-180, 180)."""
    return F.pmod(end - start + 180.0, F.lit(360.0)) - 180.0


def derotation(angle: Column, scale: float = 1.0, constant: float = 0.0) -> Column:
    """Radians in [0, 2 pi): counter-clockwise."""
    return F.radians(angle_mod(angle * scale + constant))


def mjd(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp")) / F.lit(86400e6) + F.lit(40587.0)


def mjd_to_timestamp(value: Column) -> Column:
    return F.timestamp_micros(F.round((value - 40587.0) * 86400e6).cast("long"))


def numeric_card(header: Column, keyword: str) -> Column:
    """A header card as a number; null where it is missing or no number."""
    return F.trim(header[keyword]).try_cast("double")


def signal_x(separation: Column, position_angle: Column, center: float) -> Column:
    return F.lit(center) - separation * F.sin(F.radians(position_angle))


def signal_y(separation: Column, position_angle: Column, center: float) -> Column:
    return F.lit(center) + separation * F.cos(F.radians(position_angle))


def trial_offsets(separation: Column, position_angle: Column) -> tuple[Column, Column]:
    """(row, col) offset of a source at (separation, position angle)."""
    a = F.radians(-position_angle)
    return separation * F.sin(a), separation * F.cos(a)


def trial_polar(row: Column, col: Column) -> tuple[Column, Column]:
    """The inverse: a zero offset has position angle 0."""
    sep = F.hypot(row, col)
    return sep, F.when(sep == 0, 0.0).otherwise(angle_mod(-F.degrees(F.atan2(row, col))))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def frame_name(index: Column, prefix: str = "im_", width: int = 6, extension: str = ".fits") -> Column:
    return F.concat(F.lit(prefix), F.lpad(index.cast("string"), width, "0"), F.lit(extension))


def number_list(text: Column) -> Column:
    """A comma-separated list of numbers."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))


def keys_weight(x: Column) -> Column:
    """Cubic convolution (Keys 1981) with a = -1/2."""
    d = F.abs(x)
    inner = (F.lit(1.5) * d - 2.5) * d * d + 1.0
    outer = ((F.lit(-0.5) * d + 2.5) * d - 4.0) * d + 2.0
    return F.when(d <= 1, inner).when(d < 2, outer).otherwise(0.0)


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def degrees_of_freedom(frames: int, predictors: int, centred: bool) -> int:
    return max(0, min(frames - int(centred), predictors))


def mode_count(fraction: float, freedom: int) -> int:
    """Modes for a fraction of the degrees of freedom; at least one."""
    return max(1, math.floor(fraction * freedom))


def reflect(value: float, low: float, high: float) -> float:
    """``value`` folded into [low, high] by a triangle wave."""
    span = high - low
    if span <= 0:
        return low
    t = (value - low) % (2 * span)
    return min(high, max(low, low + (t if t <= span else 2 * span - t)))


def parity_crop(full: int, least: int) -> int:
    """The smallest crop of at least ``least`` pixels with the parity of ``full``."""
    return min(full, least + (full - least) % 2)


def stamp_size(stamp: int, support: int) -> int:
    """A stamp padded by an interpolation's support on both sides."""
    return stamp + 2 * support


def pixel_fit_bytes(frames: int, predictors: int, modes: int, order: int) -> int:
    """What one per-pixel fit holds: predictors, modes, two Gram matrices and work space."""
    n = min(frames, predictors) if order <= 0 else order
    return int(1.25 * 8 * (frames * predictors + frames * modes + 2 * n * n + 5 * frames + 2 * predictors + 70 * n)) + (1 << 20)
