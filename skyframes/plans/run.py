"""Reductions from option files: read FITS sequences, reduce or analyse, write products."""

from __future__ import annotations

import os
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import expressions as ex
from ..operators import frames, resample, selection
from ..sources import fits, tables
from . import local, pipelines

SUBTRACT = {"none": "none", "meanImage": "mean", "medianImage": "median"}
CENTRING = {"none": "none", "imageMean": "image_mean", "imageMedian": "image_median", "meanImage": "mean_image", "medianImage": "median_image"}
METHOD = {"mean": "mean", "median": "median", "weighted": "weighted", "sigmaMean": "sigma_mean", "none": "none"}


def read_sequence(spark: SparkSession, o: dict[str, Any], section: str = "input") -> DataFrame:
    """(seq, frame_idx, basename, header, pixels, n_rows, angle, mjd, t): trimmed and quality-selected frames in order.

    Trimming acts on the listing. A quality file is joined before any pixel is used.
    """
    g = lambda k: o[f"{section}.{k}"]
    wanted = ",".join(k for k in (o["input.angleKeyword"], g("dateKeyword"), *o["coadd.keywords"]) if k)
    df = fits.read(spark, g("directory"), prefix=g("prefix"), extension=g("extension"), list=g("fileList"), delete_front=g("deleteFront"), delete_back=g("deleteBack"), size=o["input.imSize"], keywords=wanted)
    df = df.filter("plane = 0").select(F.lit(0).alias("seq"), F.col("frame_idx").cast("long").alias("frame_idx"), "basename", "header", "pixels", "n_rows")
    if g("qualityThreshold") > 0:
        df = selection.quality_select(df, tables.read_columns(spark, g("qualityFile"), "quality"), g("qualityThreshold")).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    key = o["input.angleKeyword"]
    number = ex.numeric_card(F.col("header"), key) * o["input.angleScale"] + o["input.angleConstant"] if key else F.lit(0.0)
    angle = F.coalesce(number, F.raise_error(F.concat(F.lit(f"{key} is no number in "), "basename")).cast("double")) if key else number
    date = F.col("header")[g("dateKeyword")]
    mjd = ex.mjd(F.try_to_timestamp(date)) if g("dateIsISO8601") else date.try_cast("double") * g("dateUnit")
    df = df.withColumns({"angle": angle, "mjd": F.coalesce(mjd, F.col("frame_idx").cast("double"))})
    return df.withColumn("t", F.col("mjd") * 86400.0)


def read_mask(spark: SparkSession, path: str, size: int) -> DataFrame | None:
    if not path:
        return None
    m = fits.read_image(path, size)[1][0]
    return spark.createDataFrame([(r, c, bool(m[r, c] != 0)) for r in range(m.shape[0]) for c in range(m.shape[1])], "row int, col int, good boolean")


def steps_of(o: dict[str, Any]) -> pipelines.Preprocess:
    return pipelines.Preprocess(
        mask=o["preProcess.mask"], profile=o["preProcess.subradprof"], median_width=o["preProcess.medianUSM_fwhm"], gauss_fwhm=o["preProcess.gaussUSM_fwhm"], az_rad_half=o["preProcess.azUSM_radHalfWidth"] or o["preProcess.azUSM_radW"],
        az_half=o["preProcess.azUSM_azHalfWidth"] or o["preProcess.azUSM_azW"], az_max=o["preProcess.azUSM_maxAz"], subtract=SUBTRACT[o["preProcess.meanSubMethod"]], normalize=o["preProcess.pixelTSNormMethod"], skip=o["preProcess.skip"],
    )


def finish_of(o: dict[str, Any]) -> pipelines.Finish:
    return pipelines.Finish(o["adi.postMedSub"], bool(o["input.angleKeyword"]) and not o["combine.noDerotate"], METHOD[o["combine.method"]], o["combine.sigmaThreshold"], o["combine.minGoodFract"])


def sized(template: np.ndarray, size: int) -> np.ndarray:
    """A template padded with zeros, or cut, to the frames' size."""
    pad = size - template.shape[0]
    if pad % 2:
        raise ValueError("the template's size must have the frames' parity")
    return np.pad(template, pad // 2) if pad >= 0 else template[-pad // 2 : pad // 2, -pad // 2 : pad // 2]


def with_sources(spark: SparkSession, stack: DataFrame, o: dict[str, Any], size: int) -> DataFrame:
    if not o["fake.sep"] or not o["fake.fileName"]:
        return stack
    scaled = selection.lookup(stack, tables.read_columns(spark, o["fake.scaleFileName"], "scale"), "scale", last_wins=True) if o["fake.scaleFileName"] else stack.withColumn("scale", F.lit(1.0))
    sources = list(zip(o["fake.sep"], o["fake.PA"], o["fake.contrast"], strict=True))
    scaled = scaled.withColumn("derot", ex.derotation(F.col("angle")))
    if o["fake.method"] == "single":
        return resample.inject_template(scaled, sized(fits.read_image(o["fake.fileName"])[1][0], size), sources, size).drop("scale", "derot")
    # a list names a template for each frame, in the frames' order
    each = fits.read(spark, "", list=o["fake.fileName"]).filter("plane = 0").select(F.col("frame_idx").cast("long").alias("__n"), F.col("pixels").alias("template"), F.col("n_rows").alias("template_rows"))
    places = stack.groupBy("seq").agg(F.array_sort(F.collect_list("frame_idx")).alias("__order"))
    numbered = scaled.join(places, "seq").withColumn("__n", F.array_position("__order", F.col("frame_idx")) - 1).drop("__order")
    if each.count() != stack.count():
        raise ValueError("the list of templates must have one for each frame")
    return resample.inject_templates(numbered.join(each, "__n").drop("__n"), sources, size).drop("scale", "derot", "template", "template_rows")


def prepared(spark: SparkSession, o: dict[str, Any], section: str = "input") -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """(preprocessed pixels, their frames, size, mask), co-added where asked for, before or after preprocessing."""
    stack = read_sequence(spark, o, section)
    head = stack.select("n_rows").first()
    if head is None:
        raise ValueError("no frame is left to reduce")
    size = head[0]
    if section == "input":
        stack = with_sources(spark, stack, o, size)
    path = o["input.maskFile"] if section == "input" or o["rdi.useInputMask"] else o["rdi.maskFile"]
    mask, geo, steps = read_mask(spark, path, size), frames.geometry(spark, size, size), steps_of(o)
    pixels = frames.explode_frames(stack, size).withColumn("value", frames.zero_nan(F.col("value")))
    if o["preProcess.beforeCoadd"]:
        pixels = pipelines.preprocess(pixels, geo, steps, mask)
    if o["coadd.method"] != "none" and not steps.skip:
        observed = stack.select("seq", "frame_idx", "t", "angle")
        pixels, heads = pipelines.coadd_stack(observed, pixels, o["coadd.method"], max_count=o["coadd.maxImno"], max_time=o["coadd.maxTime"], max_angle=o["coadd.maxAngle"])
        stack = frames.to_frames(pixels).join(heads.withColumn("mjd", F.col("t") / 86400.0), ["seq", "frame_idx"])
    if not o["preProcess.beforeCoadd"]:
        pixels = pipelines.preprocess(pixels, geo, steps, mask)
    return pixels, stack, size, mask


#: Options that name steps which ``reduce`` doesn't run; a file that sets one would get a smaller reduction.
UNSUPPORTED = (
    "fake.RDIFluxScale", "fake.RDISepScale", "klip.writeDiagnostics", "klip.diagnosticDirectory", "klip.pixelTSSigma", "preProcess.pixelTSSigma", "p4.memoryFraction", "p4.numberImages", "p4.localStampSize", "p4.psfFile", "p4.psfStampSize", "p4.outputPSFModels", "p4.psfFilter",
    "p4.psfFilterMinGoodFract", "p4.psfOutputPrefix", "p4.writeDiagnostics", "p4.diagnosticDirectory", "showTiming", "diagnostics",
)


def refuse_unsupported(kind: str, o: dict[str, Any]) -> None:
    if found := [k for k, (_, default) in config.SCHEMAS[kind].items() if k.startswith(UNSUPPORTED) and o[k] != default]:
        raise NotImplementedError(f"options that aren't supported: {', '.join(found)}")


def reduce(spark: SparkSession, kind: str, o: dict[str, Any]) -> DataFrame:
    """The reduction that the options describe: its final images (or what an early stop leaves); products are written if a directory is set."""
    refuse_unsupported(kind, o)
    if o["input.thresholdOnly"]:
        return read_sequence(spark, o).select("frame_idx", "basename").orderBy("frame_idx")
    finish, cards = finish_of(o), {}
    if o["mode"] == "postprocess":
        saved = tables.read_residuals(spark, o["postprocess.directory"], o["postprocess.prefix"], o["postprocess.extension"])
        head = saved.select("n_rows", "header").first()
        size, planes = head["n_rows"], saved.agg(F.max("mode_idx")).first()[0] + 1
        modes = tables.read_list(head["header"], "NMODES")
        if len(modes) != planes:
            raise ValueError("saved residuals need an NMODES card with a number for each reduction")
        cards = {k: v for k, v in head["header"].items() if k.split(" ")[0] in ("NMODES", "REGMINR", "REGMAXR", "FAKESEP", "FAKEPA", "FAKECONT")}
        residual = frames.explode_frames(saved.withColumns({"seq": F.lit(0), "frame_idx": F.col("frame_idx").cast("long")}), size, keep=("seq", "mode_idx", "frame_idx"))
        stack = read_sequence(spark, o) if o["input.directory"] else residual.select("seq", "frame_idx").distinct().withColumn("angle", F.lit(0.0))
    else:
        pixels, stack, size, mask = prepared(spark, o)
        if o["preProcess.only"]:
            if o["preProcess.outputPrefix"]:
                folder, prefix = os.path.split(o["preProcess.outputPrefix"])
                ready = frames.to_frames(pixels).select("frame_idx", F.lit(0).alias("plane"), F.create_map().cast("map<string,string>").alias("header"), F.lit(size).alias("n_rows"), F.lit(size).alias("n_cols"), "pixels")
                ready.write.format("fits").mode("append").option("prefix", prefix).save(folder or ".")
            return pixels
        if kind == "principal":
            wanted = frames.regions(spark, o["geom.minRadius"], o["geom.maxRadius"], o["geom.minAngle"] or None, o["geom.maxAngle"] or None, o["geom.nWedges"])
            library = None
            if o["rdi.directory"] or o["rdi.fileList"]:
                library, _, other, _ = prepared(spark, o, "rdi")
                if other != size:
                    raise ValueError(f"the reference frames have {other} rows, the targets {size}")
            modes = [int(n) for n in o["klip.Nmodes"]]
            residual = pipelines.principal_residuals(
                spark, pixels, stack, size, wanted, modes, CENTRING[o["klip.meanSubMethod"]], o["adi.excludeMethod"], o["adi.minDPx"], o["adi.excludeMethodMax"], o["adi.maxDPx"],
                o["klip.includeMethod"], o["klip.includeRefNum"], mask, library, o["klip.rrRadius"] if o["klip.rightReason"] else 0.0, o["klip.pixelTSNormMethod"] == "rms",
            )
        else:
            rotated = o["p4.regressionFrame"] == "rotated"
            pixels = frames.require_finite(pixels)
            wedge = {"delta_in": o["p4.orDeltaRadiusInner"], "delta_out": o["p4.orDeltaRadiusOuter"], "arc": o["p4.orArcHalfWidth"], "max_half_angle": o["p4.orMaxHalfAngle"], "radius": o["p4.psfRadius"] + o["p4.exclusionRadiusBuffer"], "policy": "kernel_support" if o["p4.exclusionPolicy"] == "kernelSupport" else "sample_center"}
            count, by_region = stack.count(), []
            for region, (a, b) in enumerate(zip(o["geom.minRadius"], o["geom.maxRadius"], strict=True)):
                near = pipelines.models.local_predictors(frames.geometry(spark, size, size), a, b, **wedge)
                least = near.groupBy("t_row", "t_col").count().agg(F.min("count")).first()[0]
                by_region.append(pipelines.realised_modes(o["p4.modeFractions"], ex.degrees_of_freedom(count, least or 0, rotated), region))
            if o["p4Optimize.enabled"]:
                return optimize(spark, o, stack, size, wedge, by_region)
            modes = by_region[0]
            residual = pipelines.pixel_residuals(spark, pixels, stack, size, o["geom.minRadius"], o["geom.maxRadius"], by_region, wedge, o["p4.rankTolerance"], rotated)
            finish.derotate = finish.derotate and not rotated
        cards = tables.list_cards("NMODES", modes) | tables.list_cards("REGMINR", o["geom.minRadius"]) | tables.list_cards("REGMAXR", o["geom.maxRadius"])
        if o["fake.sep"]:
            cards |= tables.list_cards("FAKESEP", o["fake.sep"]) | tables.list_cards("FAKEPA", o["fake.PA"]) | tables.list_cards("FAKECONT", o["fake.contrast"])
    weights = None
    if o["combine.weightFile"]:
        weights = selection.normalized_weights(selection.lookup(stack, tables.read_columns(spark, o["combine.weightFile"], "weight"), "weight")).select("seq", "frame_idx", "weight")
    if o["output.outputPSFSub"]:
        known = {r["frame_idx"]: r["weight"] for r in weights.collect()} if weights is not None else None  # a number a frame
        tables.write_residuals(residual, o["output.directory"] or ".", o["output.psfSubPrefix"] or "residual", size, known, cards)
    angles = stack.select("seq", "frame_idx", ex.derotation(F.col("angle")).alias("derot"))
    final = pipelines.finalize(residual, angles, frames.geometry(spark, size, size), size, finish, weights)
    if o["output.directory"] and finish.method != "none":
        tables.write_final(final, tables.next_path(o["output.directory"], o["output.fileName"], o["output.exactFName"]), size, tables.provenance({k: v for k, v in o.items() if v not in ("", [], None)}) | cards)
    return final


def optimize(spark: SparkSession, o: dict[str, Any], stack: DataFrame, size: int, wedge: dict[str, Any], modes: list[list[int]]) -> DataFrame:
    """(trial, row, col, contrast, merit) of a fit of one source, whose template is taken out of the frames; tables go to the output prefix.

    The fit acts on frames as they are read, so a run that preprocesses them is refused.
    """
    if not steps_of(o).skip and steps_of(o) != pipelines.Preprocess():
        raise NotImplementedError("a fit takes no preprocessing steps")
    if len(o["fake.sep"]) != 1 or not o["fake.fileName"] or o["fake.method"] != "single":
        raise ValueError("a fit needs one source with a template")
    inside = [i for i, (a, b) in enumerate(zip(o["geom.minRadius"], o["geom.maxRadius"], strict=True)) if a <= o["fake.sep"][0] < b]
    if not inside:
        raise ValueError("the source lies in no region")
    fraction = o["p4Optimize.modeFraction"] or o["p4.modeFractions"][0]
    if fraction not in o["p4.modeFractions"]:
        raise ValueError("p4Optimize.modeFraction must be one of p4.modeFractions")
    here = inside[0]
    region = local.Region(o["geom.minRadius"][here], o["geom.maxRadius"][here], modes=modes[here][o["p4.modeFractions"].index(fraction)], **wedge)
    at, bounds, template = (o["fake.sep"][0], o["fake.PA"][0]), (o["p4Optimize.contrastLower"], o["p4Optimize.contrastUpper"]), sized(fits.read_image(o["fake.fileName"])[1][0], size)
    raw, aperture = stack.select("seq", "frame_idx", "pixels", "angle"), o["p4Optimize.apertureRadius"] or 1.0
    limits = {"samples": o["p4Optimize.validationSamples"], "tolerance": o["p4Optimize.parameterTolerance"]}
    if o["p4Optimize.fitPosition"]:
        more = {"position_tolerance": o["p4Optimize.positionTolerance"], "merit_tolerance": o["p4Optimize.meritTolerance"], "most": o["p4Optimize.maxEvaluations"]}
        search = local.fit_position(spark, raw, size, region, at, bounds, o["p4Optimize.positionBound"], aperture, template, **limits, **more)
    else:
        search = local.fit_contrast(spark, raw, size, region, at, bounds, aperture, template, most=o["p4Optimize.maxEvaluations"], **limits)
    if o["p4Optimize.outputPrefix"]:
        tables.write_search(search, o["p4Optimize.outputPrefix"])
    if o["p4Optimize.uncertaintyBlocks"]:
        found, error = local.jackknife_contrast(spark, raw, size, region, at, bounds, aperture, template, o["p4Optimize.uncertaintyBlocks"], most=o["p4Optimize.maxEvaluations"], **limits)
        if o["p4Optimize.outputPrefix"]:
            tables.write_jackknife(found, error, o["p4Optimize.outputPrefix"])
    rows = [(i, *((None, None, float(x[0])) if len(x) == 1 else map(float, x)), float(m)) for i, (x, m) in enumerate(search.samples)]
    return spark.createDataFrame(rows, "trial int, row double, col double, contrast double, merit double")


def analyze(spark: SparkSession, o: dict[str, Any]) -> DataFrame:
    """The signal-to-noise table of a file of final images."""
    refuse_unsupported("analysis", o)
    cube = fits.read(spark, o["file"])
    head = cube.select("header", "n_rows").first()
    size, header = head["n_rows"], head["header"]
    names = ("planet.sep", "planet.PA", "planet.R") if o["planet.sep"] else ("fake.sep", "fake.PA", "fake.R")
    seps, pas, radii = (o[n] for n in names)
    if not seps:
        seps, pas = tables.read_list(header, "FAKESEP"), tables.read_list(header, "FAKEPA")
    radii = radii or [o["snr.apertureR"] * 2] * len(seps)
    edge = lambda f, *keys: next((f(found) for k in keys if (found := tables.read_list(header, k))), None)
    rmin = o["snr.minRad"] or edge(min, "REGMINR", "P4 MIN RADIUS", "P4MINR") or 0.0
    rmax = o["snr.maxRad"] or edge(max, "REGMAXR", "P4 MAX RADIUS", "P4MAXR") or float("inf")
    modes = tables.read_list(header, "NMODES")
    planes = frames.explode_frames(cube, size, keep=("plane",))
    mode = F.element_at(F.array(*map(F.lit, modes)), F.col("plane") + 1) if modes else F.col("plane").cast("double")
    how = pipelines.Analysis(list(zip(seps, pas, radii if len(radii) == len(seps) else radii * len(seps), strict=True)), rmin, rmax, o["snr.apertureR"], o["filter.hpfGaussFW"], o["filter.lpfGaussFW"])
    return pipelines.analyze(spark, planes.withColumn("mode", mode), size, how)
