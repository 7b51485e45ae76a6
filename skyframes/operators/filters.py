"""Radial statistics and spatial filters on long pixels.

A filter sends each pixel to the positions it weighs on and sums there, so one shuffle by frame and position suffices.
Whole-image kernels for large frames are in ``kernels.filters2d``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ["seq", "frame_idx"]
CELL = [*FRAME, "row", "col"]
#: FWHM of a Gaussian in units of its sigma.
FWHM_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))


def with_bins(pixels: DataFrame, geo: DataFrame) -> DataFrame:
    """Unit-width radial bins."""
    return pixels.join(F.broadcast(geo.select("row", "col", F.floor("r").cast("int").alias("bin"))), ["row", "col"])


def radial_profile(pixels: DataFrame, geo: DataFrame) -> DataFrame:
    return with_bins(pixels, geo).groupBy(*FRAME, "bin").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def subtract_profile(pixels: DataFrame, geo: DataFrame) -> DataFrame:
    """Subtract each frame's median of the radial bin."""
    profile = radial_profile(pixels, geo).select(*FRAME, "bin", "median")
    return with_bins(pixels, geo).join(profile, [*FRAME, "bin"]).select(*CELL, (F.col("value") - F.col("median")).alias("value"))


def radial_snr(pixels: DataFrame, geo: DataFrame, noise: DataFrame | None = None, rmin: float = 0.0, rmax: float = math.inf) -> DataFrame:
    """Value over the standard deviation of its radial bin; ``noise`` holds the pixels that the deviation may use."""
    dev = radial_profile(pixels if noise is None else noise, geo).select(*FRAME, "bin", "std")
    near = geo.filter((F.col("r") >= rmin) & (F.col("r") < rmax))
    return with_bins(pixels, near).join(dev, [*FRAME, "bin"], "left").select(*CELL, F.when(F.col("std") > 0, F.col("value") / F.col("std")).alias("snr"))


def _spread(pixels: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """(cell, weight, x): each value at the positions that it weighs on."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in offsets)))
    sent = pixels.select(*FRAME, "row", "col", "value", steps.alias("s"))
    return sent.select(*FRAME, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("s.w").alias("w"), F.col("value").alias("x"))


def median_unsharp(pixels: DataFrame, width: int) -> DataFrame:
    """Subtract the median of a square of ``width``; zero where the square leaves the image."""
    before = width // 2
    after = width - before - 1
    offsets = [(-a, -b, 1.0) for a in range(-before, after + 1) for b in range(-before, after + 1)]
    local = _spread(pixels, offsets).groupBy(*CELL).agg(F.median("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return pixels.join(local, CELL, "left").select(*CELL, F.when(F.col("n") == width * width, F.col("value") - F.col("m")).otherwise(0.0).alias("value"))


def gauss_offsets(fwhm: float, width: float | None = None) -> list[tuple[int, int, float]]:
    """A normalised Gaussian; its width is int(2 fwhm), made odd, at least 3."""
    size = max(3, int(width if width is not None else 2 * fwhm))
    half = (size + (size % 2 == 0)) // 2
    sigma = fwhm / FWHM_SIGMA
    raw = [(a, b, math.exp(-(a * a + b * b) / (2 * sigma * sigma))) for a in range(-half, half + 1) for b in range(-half, half + 1)]
    total = sum(w for _, _, w in raw)
    return [(a, b, w / total) for a, b, w in raw]


def smooth(pixels: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """Weighted means over the valid pixels in reach, with the weights that are left normalised."""
    x = _spread(pixels, offsets).filter("x is not null").groupBy(*CELL).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("smooth"))
    return pixels.join(x, CELL, "left")


def gauss_unsharp(pixels: DataFrame, fwhm: float) -> DataFrame:
    return smooth(pixels, gauss_offsets(fwhm)).select(*CELL, (F.col("value") - F.col("smooth")).alias("value"))


def masked_gauss(pixels: DataFrame, high: float = 0.0, low: float = 0.0) -> DataFrame:
    """High pass (kernel of two widths), then low pass (four widths); invalid pixels stay invalid."""
    if high > 0:
        pixels = smooth(pixels, gauss_offsets(high, 2 * high)).select(*CELL, (F.col("value") - F.col("smooth")).alias("value"))
    if low > 0:
        pixels = smooth(pixels, gauss_offsets(low, 4 * low)).select(*CELL, F.when(F.col("value").isNotNull(), F.col("smooth")).alias("value"))
    return pixels


def azimuthal_unsharp(pixels: DataFrame, geo: DataFrame, rad_half: float, az_half: float, max_az: float = 45.0) -> DataFrame:
    """Subtract the median over a polar box: radii within ``rad_half``, arc length within ``az_half`` capped at ``max_az`` degrees.

    Neighbour pairs depend on positions only, so their list is bounded by the image and broadcast.
    """
    a, b = geo.alias("a"), geo.alias("b")
    arc = F.least(F.lit(max_az), F.degrees(F.lit(az_half) / F.greatest(F.col("a.r"), F.lit(1e-9)))) if max_az > 0 else F.degrees(F.lit(az_half) / F.greatest(F.col("a.r"), F.lit(1e-9)))
    apart = F.abs(F.pmod(F.col("b.theta") - F.col("a.theta") + 180.0, F.lit(360.0)) - 180.0)
    pairs = a.join(F.broadcast(b), (F.abs(F.col("a.r") - F.col("b.r")) <= rad_half + 1e-9) & (apart <= arc + 1e-9)).select(F.col("b.row").alias("row"), F.col("b.col").alias("col"), F.col("a.row").alias("to_row"), F.col("a.col").alias("to_col"))
    local = pixels.join(F.broadcast(pairs), ["row", "col"]).groupBy(*FRAME, F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.median("value").alias("m"))
    return pixels.join(local, CELL).select(*CELL, (F.col("value") - F.col("m")).alias("value"))
