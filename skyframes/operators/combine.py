"""Combining a stack over time, with validity, weights and clipping; centring and normalising a stack.

Null is invalid throughout. ``good`` columns (a common mask) and ``valid`` columns (per value) turn values to null
before anything is summed; validity takes precedence over the mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["seq", "row", "col"]


def effective(value: str = "value", valid: str | None = None, good: str | None = None) -> Column:
    marks = [F.col(x) for x in (valid, good) if x]
    return F.when(F.coalesce(*marks, F.lit(True)), F.col(value)) if marks else F.col(value)


def _gate(result: Column, min_good: float) -> Column:
    return F.when((F.count("value") > 0) & (F.count("value") / F.count(F.lit(1)) >= min_good), result)


def combine(pixels: DataFrame, method: str = "mean", keys: list[str] | None = None, weight: str | None = None, sigma: float = 0.0, min_good: float = 0.0) -> DataFrame:
    """(keys..., value, n_good, n_total). Methods: mean, weighted, median, sigma_mean.

    A mean uses weights whenever they are given; the median ignores them. Clipping is one pass about the median in
    units of the population standard deviation; a threshold of 0 or less doesn't clip. A pixel with too few good values is
    null. Partial sums per task make the mean a narrow shuffle of one row per pixel and task.
    """
    keys = keys or PIXEL
    if method not in ("mean", "weighted", "median", "sigma_mean"):
        raise ValueError(f"unknown method {method}")
    if method == "weighted" and not weight:
        raise ValueError("weighted needs weights")
    n = [F.count("value").alias("n_good"), F.count(F.lit(1)).alias("n_total")]
    if method == "median":
        return pixels.groupBy(*keys).agg(_gate(F.median("value"), min_good).alias("value"), *n)
    w = F.col(weight) if weight else F.lit(1.0)
    if method == "sigma_mean" and sigma > 0:
        stats = pixels.groupBy(*keys).agg(F.median("value").alias("__mid"), F.stddev_pop("value").alias("__dev"))
        pixels = pixels.join(stats, keys).withColumn("__kept", F.abs(F.col("value") - F.col("__mid")) <= sigma * F.col("__dev") + 1e-12)
        kept = F.when(F.col("__kept"), F.col("value"))
        mean = F.sum(w * kept) / F.sum(F.when(kept.isNotNull(), w))
        return pixels.groupBy(*keys).agg(_gate(mean, min_good).alias("value"), *n)
    mean = F.sum(w * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), w)) if weight else F.avg("value")
    return pixels.groupBy(*keys).agg(_gate(mean, min_good).alias("value"), *n)


def subtract_image(pixels: DataFrame, method: str = "mean") -> DataFrame:
    """Subtract each pixel's mean or median over its sequence.

    The image has a row per position and is joined back, so a long sequence isn't sorted in one task.
    """
    stat = {"mean": F.avg, "median": F.median}[method]("value")
    image = pixels.groupBy(*PIXEL).agg(stat.alias("__image"))
    return pixels.join(image, PIXEL).withColumn("value", F.col("value") - F.col("__image")).drop("__image")


def subtract_level(pixels: DataFrame, method: str = "mean", keys: tuple[str, ...] = ("seq", "frame_idx")) -> DataFrame:
    """Subtract each frame's own mean or median; a frame's pixels are a bounded group."""
    stat = {"mean": F.avg, "median": F.median}[method]("value")
    return pixels.withColumn("value", F.col("value") - stat.over(Window.partitionBy(*keys)))


def pixel_rms(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def normalize_rms(pixels: DataFrame, rms: DataFrame | None = None, low: str = "skip", epsilon: float = 0.0) -> DataFrame:
    """Divide by each pixel's RMS about zero; an RMS of ``epsilon`` or less leaves (skip) or zeroes the pixel."""
    ok = F.col("rms").isNotNull() & (F.col("rms") > epsilon) & ~F.isnan("rms")
    out = F.when(ok, F.col("value") / F.col("rms")).otherwise(F.col("value") if low == "skip" else F.lit(0.0))
    return pixels.join(pixel_rms(pixels) if rms is None else rms, PIXEL).withColumn("value", out).drop("rms")


def frame_norms(pixels: DataFrame, keys: tuple[str, ...] = ("seq", "frame_idx")) -> DataFrame:
    """Root of the summed squares about the frame's mean."""
    return pixels.groupBy(*keys).agg(F.sqrt(F.count("value") * F.var_pop("value")).alias("norm"))


def median_residual(pixels: DataFrame) -> DataFrame:
    """Subtract the temporal median before derotation; where it is invalid, so are all frames."""
    return subtract_image(pixels, "median")
