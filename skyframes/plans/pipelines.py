"""End-to-end reductions: preprocess, co-add, model, finalise, measure."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import derotation
from ..operators import coadd, combine, filters, frames, measure, references, resample
from . import models


@dataclass
class Preprocess:
    """Steps in their fixed order; the mask is applied first and again after each step."""

    mask: bool = True
    profile: bool = False
    median_width: int = 0
    gauss_fwhm: float = 0.0
    az_rad_half: float = 0.0
    az_half: float = 0.0
    az_max: float = 45.0
    subtract: str = "none"
    normalize: str = "none"
    skip: bool = False

    def __post_init__(self) -> None:
        if self.subtract not in ("none", "mean", "median"):
            raise ValueError(f"unknown subtraction {self.subtract}")
        if self.normalize == "sigma_clip":
            raise NotImplementedError("sigma-clipped normalisation is not implemented")
        if self.normalize not in ("none", "rms"):
            raise ValueError(f"unknown normalisation {self.normalize}")


def preprocess(pixels: DataFrame, geo: DataFrame, steps: Preprocess, mask: DataFrame | None = None) -> DataFrame:
    if steps.skip:
        return pixels
    masked = (lambda p: frames.apply_mask(p, mask)) if mask is not None and steps.mask else (lambda p: p)
    pixels = masked(pixels)
    if steps.profile:
        pixels = masked(filters.subtract_profile(pixels, geo))
    if steps.median_width:
        pixels = masked(filters.median_unsharp(pixels, steps.median_width))
    if steps.gauss_fwhm:
        pixels = masked(filters.gauss_unsharp(pixels, steps.gauss_fwhm))
    if steps.az_half and steps.az_rad_half:
        pixels = masked(filters.azimuthal_unsharp(pixels, geo, steps.az_rad_half, steps.az_half, steps.az_max))
    if steps.subtract != "none":
        pixels = masked(combine.subtract_image(pixels, steps.subtract))
    if steps.normalize == "rms":
        pixels = combine.normalize_rms(pixels)
    return pixels


@dataclass
class Finish:
    post_median: bool = False
    derotate: bool = True
    method: str = "mean"
    sigma: float = 0.0
    min_good: float = 0.0


def finalize(residual: DataFrame, angles: DataFrame, geo: DataFrame, size: int, how: Finish, weights: DataFrame | None = None) -> DataFrame:
    """(seq, mode_idx, row, col, value, n_good, n_total) from residuals (seq, mode_idx, frame_idx, row, col, value).

    ``weights`` (seq, frame_idx, weight) make means weighted. Positions that no frame covers are absent; a frame that doesn't reach a covered position counts as invalid there.
    """
    keyed = residual.select(F.struct("seq", "mode_idx").alias("seq"), "frame_idx", "row", "col", "value")
    if how.post_median:
        keyed = combine.median_residual(keyed)
    if how.method == "none":
        return keyed.select("seq.seq", "seq.mode_idx", "frame_idx", "row", "col", "value")
    w = weights.select(F.col("seq").alias("__ws"), F.col("frame_idx").alias("__wf"), "weight", F.lit(True).alias("__weighed")) if weights is not None else None
    weighed = lambda df: (df["seq"] == F.col("__ws")) & (df["frame_idx"] == F.col("__wf"))
    if how.derotate:
        turns = angles.select(F.col("seq").alias("seq"), F.col("frame_idx").alias("frame_idx"), "derot")
        turns = turns.join(w, weighed(turns), "left").drop("__ws", "__wf") if w is not None else turns
        keyed = resample.derotate_frames(keyed.select("seq.seq", "seq.mode_idx", "frame_idx", "row", "col", "value"), turns, size)
        keyed = (keyed.filter("__weighed or row < 0") if w is not None else keyed).withColumn("seq", F.struct("seq", "mode_idx"))
    elif w is not None:
        keyed = keyed.join(w, (F.col("seq.seq") == F.col("__ws")) & (F.col("frame_idx") == F.col("__wf"))).drop("__ws", "__wf")
    done = combine.combine(keyed, how.method, weight="weight" if weights is not None else None, sigma=how.sigma)
    if how.derotate:
        frames_of = F.max(F.when(F.col("row") < 0, F.col("n_total"))).over(Window.partitionBy("seq"))
        done = done.withColumn("n_total", frames_of).filter("row >= 0")
    done = done.withColumn("value", F.when(F.col("n_good") / F.col("n_total") >= how.min_good, F.col("value")))
    return done.select("seq.seq", "seq.mode_idx", "row", "col", "value", "n_good", "n_total")


def region_frames(inside: DataFrame, stack: DataFrame, centring: str, normalize: bool = False) -> DataFrame:
    """(seq, frame_idx, angle, mjd, v, norm): each region's pixels as a model sees them, as an array a frame; seq holds the region, too."""
    px = inside.select(F.struct("seq", "region_id").alias("seq"), "frame_idx", "row", "col", "value")
    if centring.startswith("image_"):
        px = combine.subtract_level(px, centring[6:])
    elif centring != "none":
        px = combine.subtract_image(px, centring[: centring.index("_")])
    if normalize:
        px = combine.normalize_rms(px, low="zero", epsilon=2.220446049250313e-16)
    arrays = px.groupBy("seq", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")))), lambda x: x["value"]).alias("v"))
    known = stack.select(F.col("seq").alias("__s"), F.col("frame_idx").alias("__f"), "angle", "mjd")
    out = arrays.join(known, (F.col("seq.seq") == F.col("__s")) & (F.col("frame_idx") == F.col("__f"))).drop("__s", "__f")
    return out.withColumn("norm", F.sqrt(references.dot(F.col("v"), F.col("v"))))


def principal_residuals(spark: SparkSession, pixels: DataFrame, stack: DataFrame, size: int, wanted: DataFrame, modes: list[int], centring: str = "image_mean", exclude: str = "none", least: float = 0.0, exclude_max: str = "none", most: float = 0.0, include: str = "all", n_references: int = 0, mask: DataFrame | None = None, library: DataFrame | None = None, exclude_radius: float = 0.0, normalize: bool = False) -> DataFrame:
    """Residuals of preprocessed pixels by region; ``stack`` (seq, frame_idx, angle, mjd) and the region's own pixels serve to choose references.

    The exclusion window is set by region, as motion in pixels is at the region's inner radius. A plane has the whole image, with zeros
    where no region is: a rotated sample near a region's edge needs them, and a narrow annulus has no sample without.
    """
    geo = frames.geometry(spark, size, size)
    owned = [tuple(r) for r in frames.region_pixels(geo, wanted, mask).collect()]
    taken = {(row, col) for _, row, col in owned}
    outside = (min(owned)[0], [(row, col) for row in range(size) for col in range(size) if (row, col) not in taken]) if owned else None
    inside = frames.select_region(pixels, geo, wanted, mask)
    allowed = refs = window = None
    if library is not None:
        refs = frames.select_region(library, geo, wanted, mask)
    elif include != "all" and n_references:
        allowed = region_references(inside, stack, wanted, centring, exclude, least, exclude_max, most, include, n_references, normalize)
    elif exclude != "none" or exclude_max != "none":
        window = (stack.crossJoin(F.broadcast(wanted.select("region_id", "rmin"))), exclude, least, exclude_max, most)
    return models.kl_subtract(inside, modes, centring, allowed, refs, exclude_radius, normalize, window, outside)


def region_references(inside: DataFrame, stack: DataFrame, wanted: DataFrame, centring: str, exclude: str = "none", least: float = 0.0, exclude_max: str = "none", most: float = 0.0, include: str = "all", n_references: int = 0, normalize: bool = False) -> DataFrame:
    """(seq, region_id, target, reference, score, rank) of the references that each target may have in each region."""
    if include == "corr" and n_references:
        arrays, columns = region_frames(inside, stack, centring, normalize), ["frame_idx", "angle", "mjd", "v", "norm"]
    else:
        places = inside.select("seq", "region_id").distinct()
        arrays, columns = stack.join(places, "seq").select(F.struct("seq", "region_id").alias("seq"), "frame_idx", "angle", "mjd"), ["frame_idx", "angle", "mjd"]
    edge = F.broadcast(wanted.select(F.col("region_id").alias("__r"), F.col("rmin").alias("__rmin")))
    pairs = references.frame_pairs(arrays, columns).join(edge, F.col("seq.region_id") == F.col("__r")).filter(references.window(exclude, least, exclude_max, most, F.col("__rmin")))
    ranked = references.rank_references(pairs, include if n_references else "all", n_references if include != "all" else 0)
    return ranked.select("seq.seq", "seq.region_id", "target", "reference", "score", "rank")


def principal_reduction(spark: SparkSession, stack: DataFrame, size: int, rmin: list[float], rmax: list[float], modes: list[int], steps: Preprocess | None = None, finish: Finish | None = None, mask: DataFrame | None = None, library: DataFrame | None = None, **choice) -> DataFrame:
    """Frames (seq, frame_idx, pixels, angle degrees) to final images after principal-component subtraction by region."""
    geo, steps = frames.geometry(spark, size, size), steps or Preprocess()
    stack = stack if "mjd" in stack.columns else stack.withColumn("mjd", F.col("frame_idx").cast("double"))
    pixels = preprocess(frames.explode_frames(stack, size), geo, steps, mask)
    refs = preprocess(frames.explode_frames(library, size), geo, steps, mask) if library is not None else None
    residual = principal_residuals(spark, pixels, stack, size, frames.regions(spark, rmin, rmax), modes, mask=mask, library=refs, **choice)
    return finalize(residual, stack.select("seq", "frame_idx", derotation(F.col("angle")).alias("derot")), geo, size, finish or Finish())


def realised_modes(fractions: list[float], freedom: int, region: int) -> list[int]:
    """Numbers of modes of increasing fractions of a region's degrees of freedom; none and repeated ones are errors."""
    modes = [math.floor(f * freedom) for f in fractions]
    if any(m <= 0 for m in modes):
        raise ValueError(f"a mode fraction gives no modes in region {region}")
    if any(b <= a for a, b in zip(modes, modes[1:], strict=False)):
        raise ValueError(f"mode fractions give the same number of modes in region {region}")
    return modes


def pixel_residuals(spark: SparkSession, pixels: DataFrame, stack: DataFrame, size: int, rmin: list[float], rmax: list[float], modes: list[list[int]], wedge: dict, rank_tolerance: float = 1e-12, rotated: bool = False) -> DataFrame:
    """Residuals of the regressions of all annuli, each with its own numbers of modes; annuli don't overlap, so a pixel has one.

    ``rotated`` fits series of sky pixels that all frames cover, on centred series; the residuals are in the sky's orientation then.
    """
    geo = frames.geometry(spark, size, size)
    if rotated:
        angles = stack.select("seq", "frame_idx", derotation(F.col("angle")).alias("derot"))
        sky = resample.derotate(pixels, angles, geo, size)
        n = angles.groupBy("seq").agg(F.count(F.lit(1)).alias("__n"))
        whole = sky.groupBy("seq", "row", "col").agg(F.count("value").alias("__k")).join(n, "seq").filter("__k = __n").select("seq", "row", "col")
        pixels = sky.join(whole, ["seq", "row", "col"], "left_semi")
    fits = [models.pixel_models(pixels, models.local_predictors(geo, a, b, **wedge), m, rank_tolerance, centred=rotated) for a, b, m in zip(rmin, rmax, modes, strict=True)]
    order = stack.groupBy("seq").agg(F.array_sort(F.collect_list("frame_idx")).alias("__order"))
    return reduce(DataFrame.unionByName, fits).join(order, "seq").select("seq", "mode_idx", F.get("__order", F.col("frame_no")).alias("frame_idx"), F.col("t_row").alias("row"), F.col("t_col").alias("col"), "value")


def pixel_reduction(spark: SparkSession, stack: DataFrame, size: int, rmin: float, rmax: float, modes: list[int], wedge: dict, steps: Preprocess | None = None, finish: Finish | None = None) -> DataFrame:
    """Frames to final images after a regression of every pixel of an annulus on its neighbourhood."""
    geo = frames.geometry(spark, size, size)
    pixels = preprocess(frames.explode_frames(stack, size), geo, steps or Preprocess())
    residual = pixel_residuals(spark, pixels, stack, size, [rmin], [rmax], [modes], wedge)
    return finalize(residual, stack.select("seq", "frame_idx", derotation(F.col("angle")).alias("derot")), geo, size, finish or Finish())


@dataclass
class Analysis:
    signals: list[tuple[float, float, float]] = field(default_factory=list)  # separation, position angle, exclusion radius
    rmin: float = 0.0
    rmax: float = float("inf")
    aperture: float = 1.0
    high: float = 0.0
    low: float = 0.0


def analyze(spark: SparkSession, cube: DataFrame, size: int, how: Analysis) -> DataFrame:
    """(plane, mode, signal, separation, position_angle, contrast, snr) of planes (plane, mode, row, col, value)."""
    if not how.signals:
        raise ValueError("no signal to measure")
    geo = frames.geometry(spark, size, size)
    signals = measure.place_signals(spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(how.signals)], "signal int, separation double, position_angle double, exclusion double"), size)
    pixels = cube.select(F.lit(0).alias("seq"), F.col("plane").alias("frame_idx"), "row", "col", frames.zero_nan(F.col("value")).alias("value"))
    pixels = filters.masked_gauss(pixels, how.high, how.low)
    noise = measure.outside_signals(pixels, measure.aperture_cells(geo, signals, F.col("exclusion")))
    snr = filters.radial_snr(pixels, geo, noise, how.rmin, how.rmax)
    cells = measure.aperture_cells(geo, signals, how.aperture)
    best = measure.aperture_maximum(snr, cells, ["frame_idx"])
    names = cube.select(F.col("plane").alias("frame_idx"), "mode").distinct()
    return best.join(names, "frame_idx").join(F.broadcast(signals), "signal").select(F.col("frame_idx").alias("plane"), "mode", "signal", "separation", "position_angle", F.lit(None).cast("double").alias("contrast"), "snr")


def coadd_stack(stack: DataFrame, pixels: DataFrame, method: str, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Co-added pixels (seq, frame_idx = group, row, col, value) and their frames (mean t, mean unwrapped angle modulo 360)."""
    grouped = coadd.greedy(stack, **limits)
    out = coadd.coadd_pixels(pixels, grouped, method).withColumnRenamed("grp", "frame_idx")
    turned = coadd.unwrap(grouped.withColumn("seq0", F.col("seq")).withColumn("seq", F.struct("seq0", "grp")))
    heads = turned.groupBy("seq0", "grp").agg(F.avg("t").alias("t"), F.pmod(F.avg("theta"), F.lit(360.0)).alias("angle"), F.count(F.lit(1)).alias("n")).select(F.col("seq0").alias("seq"), F.col("grp").alias("frame_idx"), "t", "angle", "n")
    return out, heads
