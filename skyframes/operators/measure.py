"""Apertures, signals, signal-to-noise tables, PSF filter, jackknife, local predictor geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import angle_diff, signal_x, signal_y


def place_signals(signals: DataFrame, size: int) -> DataFrame:
    """Pixel coordinates of (separation, position_angle)."""
    c = (size - 1) / 2
    return signals.withColumns({"x": signal_x(F.col("separation"), F.col("position_angle"), c), "y": signal_y(F.col("separation"), F.col("position_angle"), c)})


def in_circle(x: Column, y: Column, radius: float | Column) -> Column:
    return F.pow(F.col("row") - x, 2) + F.pow(F.col("col") - y, 2) <= radius * radius


def aperture_cells(geo: DataFrame, signals: DataFrame, radius: float | Column) -> DataFrame:
    """(signal, row, col): the range join of image positions and apertures, bounded by image size times signals."""
    return geo.join(F.broadcast(signals), in_circle(F.col("x"), F.col("y"), radius)).select("signal", "row", "col")


def aperture_maximum(pixels: DataFrame, cells: DataFrame, keys: list[str], value: str = "snr") -> DataFrame:
    return pixels.join(F.broadcast(cells), ["row", "col"]).groupBy(*keys, "signal").agg(F.max(value).alias(value))


def aperture_mean_square(pixels: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal, merit): null unless every pixel of the aperture is there and valid."""
    n = cells.groupBy("signal").agg(F.count(F.lit(1)).alias("__n"))
    sums = pixels.join(F.broadcast(cells), ["row", "col"]).groupBy(*keys, "signal").agg(F.avg(F.col("value") * F.col("value")).alias("m"), F.count("value").alias("k"))
    return sums.join(F.broadcast(n), "signal").select(*keys, "signal", F.when(F.col("k") == F.col("__n"), F.col("m")).alias("merit"))


def outside_signals(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Pixels in no signal's exclusion circle."""
    return pixels.join(F.broadcast(cells.select("row", "col").distinct()), ["row", "col"], "left_anti")


def psf_amplitude(pixels: DataFrame, stamp: DataFrame, keys: list[str], min_good: float = 0.0) -> DataFrame:
    """Least-squares amplitude of a response stamp (d_row, d_col, h) at each pixel: sum(h x) / sum(h h) over valid samples.

    Null where fewer than ``min_good`` of the stamp's samples are valid. The stamp is small and broadcast.
    """
    total = stamp.select(F.count(F.lit(1)).alias("__total"))
    sent = pixels.filter("value is not null").join(F.broadcast(stamp)).select(*keys, (F.col("row") - F.col("d_row")).alias("row"), (F.col("col") - F.col("d_col")).alias("col"), "h", "value")
    sums = sent.groupBy(*keys, "row", "col").agg(F.sum(F.col("h") * F.col("value")).alias("a"), F.sum(F.col("h") * F.col("h")).alias("b"), F.count(F.lit(1)).alias("n"))
    fit = sums.join(F.broadcast(total)).select(*keys, "row", "col", F.when((F.col("n") / F.col("__total") >= min_good) & (F.col("b") > 0), F.col("a") / F.col("b")).alias("amplitude"), F.col("n").alias("n_support"))
    return fit.join(pixels.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


def jackknife(values: DataFrame, block: Column, n_blocks: int, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, block, means...): the mean of each value without the block's rows.

    Sums by block come first, so the rows aren't multiplied by the number of blocks.
    """
    sums = values.withColumn("block", block).groupBy(*keys, "block").agg(*(F.sum(c).alias(f"s_{c}") for c in names), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(*keys).agg(*(F.sum(f"s_{c}").alias(f"t_{c}") for c in names), F.sum("n").alias("t_n"))
    return sums.join(total, keys).select(*keys, "block", *(((F.col(f"t_{c}") - F.col(f"s_{c}")) / (F.col("t_n") - F.col("n"))).alias(c) for c in names))


def jackknife_covariance(estimates: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Means, covariance and standard errors over deleted blocks: (B - 1) times the population covariance."""
    n = F.count(F.lit(1))
    return estimates.groupBy(*keys).agg(F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"), ((n - 1) * F.covar_pop(a, b)).alias("covariance"), F.sqrt((n - 1) * F.var_pop(a)).alias(f"error_{a}"), F.sqrt((n - 1) * F.var_pop(b)).alias(f"error_{b}"), n.alias("n_blocks"))


def contiguous_block(index: Column, count: Column, blocks: int) -> Column:
    """The block b with b n / B <= index < (b + 1) n / B in integers."""
    return F.floor(((index + 1) * blocks - 1) / count).cast("int")


def predictor_wedge(geo: DataFrame, r_inner: float, r_outer: float, half_angle: float, center_angle: float = 0.0) -> DataFrame:
    """Positions within the buffered radii and the half angle about a direction."""
    apart = F.abs(angle_diff(F.lit(center_angle), F.col("theta")))
    return geo.filter((F.col("r") >= r_inner - 0.5) & (F.col("r") <= r_outer + 0.5) & (apart <= half_angle + 1e-9))


def half_angle(arc: float, r_mid: float, cap: float) -> float:
    """Half opening, in degrees, of an arc length at a radius."""
    return min(cap, arc / (2 * math.pi * r_mid) * 360.0)


def exclude_center(predictors: DataFrame, targets: DataFrame, radius: float, policy: str = "sample_center") -> DataFrame:
    """(t_row, t_col, row, col): predictors that stay for each target.

    ``sample_center`` drops predictors within ``radius`` of the target; ``kernel_support`` drops those any pixel of whose
    4 x 4 footprint (from one pixel before to two behind) is.
    """
    pairs = targets.select(F.col("row").alias("t_row"), F.col("col").alias("t_col")).join(F.broadcast(predictors.select("row", "col")))
    dr, dc = F.col("row") - F.col("t_row"), F.col("col") - F.col("t_col")
    if policy == "sample_center":
        return pairs.filter(F.hypot(dr, dc) > radius)
    near = lambda d: F.when(d > 1, d - 1).when(d < -2, -d - 2).otherwise(0)  # noqa: E731  the footprint's closest step to the target
    return pairs.filter(F.hypot(near(dr), near(dc)) > radius)
