"""Frames, pixels, geometry, regions and masks as relations.

A frame holds its pixels as one array in column-major order; the long form has a row per pixel, where a null value is an
invalid pixel. ``seq`` names the sequence a frame belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import angle_mod, not_finite


def explode_frames(frames: DataFrame, n_rows: int, pixels: str = "pixels", keep: tuple[str, ...] = ("seq", "frame_idx")) -> DataFrame:
    """(keep..., row, col, value): one narrow generate, no shuffle."""
    return frames.select(*keep, F.posexplode(pixels).alias("p", "v")).select(*keep, (F.col("p") % n_rows).cast("int").alias("row"), F.floor(F.col("p") / n_rows).cast("int").alias("col"), F.col("v").cast("double").alias("value"))


def to_series(pixels: DataFrame) -> DataFrame:
    """(seq, row, col, values): a pixel's values in frame order."""
    pairs = F.array_sort(F.collect_list(F.struct("frame_idx", "value")))
    return pixels.groupBy("seq", "row", "col").agg(F.transform(pairs, lambda x: x["value"]).alias("values"))


def to_frames(pixels: DataFrame) -> DataFrame:
    """(seq, frame_idx, pixels): back to column-major arrays."""
    cells = F.array_sort(F.collect_list(F.struct("col", "row", "value")))
    return pixels.groupBy("seq", "frame_idx").agg(F.transform(cells, lambda x: x["value"]).alias("pixels"))


def geometry(spark: SparkSession, n_rows: int, n_cols: int) -> DataFrame:
    """(row, col, r, theta): polar coordinates about the image centre; bounded by the image size, so it may be broadcast."""
    p = spark.range(n_rows * n_cols).select((F.col("id") % n_rows).cast("int").alias("row"), F.floor(F.col("id") / n_rows).cast("int").alias("col"))
    dr, dc = F.col("row") - (n_rows - 1) / 2, F.col("col") - (n_cols - 1) / 2
    return p.select("row", "col", F.hypot(dr, dc).alias("r"), angle_mod(F.degrees(F.atan2(dc, dr))).alias("theta"))


def regions(spark: SparkSession, rmin: list[float], rmax: list[float], qmin: list[float] | None = None, qmax: list[float] | None = None, n_wedges: int = 0) -> DataFrame:
    """(region_id, rmin, rmax, qmin, qmax); ``n_wedges`` splits each annulus into equal wedges."""
    if len(rmin) != len(rmax) or any(not 0 <= a < b for a, b in zip(rmin, rmax, strict=True)):
        raise ValueError("each region needs 0 <= rmin < rmax")
    if n_wedges:
        rows = [(a, b, i * 360.0 / n_wedges, (i + 1) * 360.0 / n_wedges) for a, b in zip(rmin, rmax, strict=True) for i in range(n_wedges)]
    else:
        if bool(qmin) != bool(qmax) or qmin and not len(qmin) == len(qmax) == len(rmin):
            raise ValueError("angles must match radii")
        rows = [(a, b, c, d) for a, b, c, d in zip(rmin, rmax, qmin or [0.0] * len(rmin), qmax or [360.0] * len(rmin), strict=True)]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "region_id int, rmin double, rmax double, qmin double, qmax double")


def region_pixels(geo: DataFrame, wanted: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(region_id, row, col): half-open in radius and angle; masked pixels (``good`` false) left out."""
    inside = (F.col("r") >= F.col("rmin")) & (F.col("r") < F.col("rmax")) & (F.col("theta") >= F.col("qmin")) & (F.col("theta") < F.col("qmax"))
    out = geo.join(F.broadcast(wanted), inside).select("region_id", "row", "col")
    return out if mask is None else out.join(F.broadcast(mask.filter("good")), ["row", "col"]).select("region_id", "row", "col")


def select_region(pixels: DataFrame, geo: DataFrame, wanted: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The range join of pixels and regions, as an equi-join: the range test runs once per image position.

    The list of positions is bounded by image size times regions and broadcast; the frames aren't shuffled.
    """
    return pixels.join(F.broadcast(region_pixels(geo, wanted, mask)), ["row", "col"])


def disk_mask(geo: DataFrame, radius: float) -> DataFrame:
    return geo.select("row", "col", (F.col("r") < radius).alias("good"))


def zero_nan(value: Column) -> Column:
    return F.when(value.isNull() | not_finite(value), 0.0).otherwise(value)


def apply_mask(pixels: DataFrame, mask: DataFrame, otherwise: float | None = 0.0) -> DataFrame:
    """Masked pixels become ``otherwise`` (None: invalid)."""
    return pixels.join(F.broadcast(mask), ["row", "col"]).withColumn("value", F.when(F.col("good"), F.col("value")).otherwise(F.lit(otherwise).cast("double"))).drop("good")


def require_finite(pixels: DataFrame) -> DataFrame:
    """Fails the job on a NaN or an infinity."""
    bad = F.col("value").isNotNull() & not_finite(F.col("value"))
    return pixels.withColumn("value", F.when(bad, F.raise_error(F.lit("pixel is not finite")).cast("double")).otherwise(F.col("value")))


def region_statistics(selected: DataFrame) -> DataFrame:
    """Counts and moments of each region and frame."""
    return selected.groupBy("seq", "frame_idx", "region_id").agg(F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("n_total"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


def check_ownership(owned: DataFrame) -> DataFrame:
    """(row, col, region_id), failing where two regions own a pixel."""
    one = owned.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.min("region_id").alias("region_id"))
    return one.select("row", "col", F.when(F.col("n") > 1, F.raise_error(F.lit("regions overlap")).cast("int")).otherwise(F.col("region_id")).alias("region_id"))
