"""Resampling by sparse taps: shifts, rotations, source injection, cropping.

A tap list holds the 16 input pixels and weights of each output pixel. A sample is valid only if all of its taps are.
Tap lists that are the same for all frames are bounded by the image and broadcast; rotations have taps per frame, made
from the frame's angle where its pixels are. ``kernels.cubic`` has the same arithmetic for whole stacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import derotation, keys_weight

FRAME = ["seq", "frame_idx"]
TAPS = 16


def _footprint(rows: DataFrame, x: Column, y: Column, keep: list[str]) -> DataFrame:
    """Expand fractional input coordinates (x, y) of output pixels to taps (in_row, in_col, w)."""
    at = rows.select(*keep, F.floor(x).alias("__a"), F.floor(y).alias("__b"), (x - F.floor(x)).alias("__u"), (y - F.floor(y)).alias("__v"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)))
    t = at.select("*", F.explode(steps).alias("__s"))
    w = keys_weight(F.col("__s.i") - F.col("__u")) * keys_weight(F.col("__s.j") - F.col("__v"))
    return t.select(*keep, (F.col("__a") + F.col("__s.i")).cast("int").alias("in_row"), (F.col("__b") + F.col("__s.j")).cast("int").alias("in_col"), w.alias("w"))


def inside(size: int) -> Column:
    return F.col("in_row").between(0, size - 1) & F.col("in_col").between(0, size - 1)


def rotation_taps(angles: DataFrame, geo: DataFrame, size: int, angle: str = "derot") -> DataFrame:
    """(seq, frame_idx, row, col, in_row, in_col, w): about the image centre, counter-clockwise by ``angle`` radians."""
    c = (size - 1) / 2
    at = angles.crossJoin(F.broadcast(geo.select("row", "col")))
    dr, dc, s, k = F.col("row") - c, F.col("col") - c, F.sin(angle), F.cos(angle)
    return _footprint(at, dr * k + dc * s + c, -dr * s + dc * k + c, [*FRAME, "row", "col"])


def shift_taps(geo: DataFrame, d_row: float, d_col: float) -> DataFrame:
    """(row, col, in_row, in_col, w) of a shift by (d_row, d_col) pixels."""
    return _footprint(geo, F.col("row") - F.lit(float(d_row)), F.col("col") - F.lit(float(d_col)), ["row", "col"])


def resample(pixels: DataFrame, taps: DataFrame, per_frame: bool) -> DataFrame:
    """(seq, frame_idx, row, col, value); incomplete footprints give no row."""
    source = pixels.select(*FRAME, F.col("row").alias("in_row"), F.col("col").alias("in_col"), F.col("value").alias("x"))
    joined = source.join(taps, [*FRAME, "in_row", "in_col"]) if per_frame else source.join(F.broadcast(taps), ["in_row", "in_col"])
    return joined.groupBy(*FRAME, "row", "col").agg(F.count("x").alias("n"), F.sum(F.col("w") * F.col("x")).alias("value")).filter(F.col("n") == TAPS).drop("n")


def shift(pixels: DataFrame, geo: DataFrame, d_row: float, d_col: float) -> DataFrame:
    return resample(pixels, shift_taps(geo, d_row, d_col), per_frame=False)


def derotate(pixels: DataFrame, angles: DataFrame, geo: DataFrame, size: int) -> DataFrame:
    """Rotate every frame; frames whose angle is exactly 0 stay as they are, edges included."""
    still = pixels.join(angles.filter("derot = 0").select(*FRAME), FRAME, "left_semi").select(*FRAME, "row", "col", "value")
    return resample(pixels, rotation_taps(angles.filter("derot <> 0"), geo, size), per_frame=True).union(still)


def derotate_frames(pixels: DataFrame, angles: DataFrame, size: int) -> DataFrame:
    """``derotate`` of planes (seq, mode_idx, frame_idx, row, col, value) over the whole image, in one pass and without a row per tap.

    Pixels are shuffled once, by frame, and turned where their frame is. ``angles`` (seq, frame_idx, derot, ...) may have more columns, which
    the result has, too. It has the covered positions, and a row and column of -1 with a null value for each plane.
    """
    import numpy as np
    import pyarrow as pa

    from ..kernels import images

    more = [c for c in angles.columns if c not in (*FRAME, "derot")]
    cells = pixels.groupBy(F.col("seq").alias("__s"), F.col("frame_idx").alias("__f")).agg(F.collect_list(F.struct("mode_idx", "row", "col", "value")).alias("cells"))
    turned = cells.join(angles, (F.col("__s") == F.col("seq")) & (F.col("__f") == F.col("frame_idx")))
    turned = turned.select("seq", "frame_idx", "cells", (F.col("derot") == 0).alias("still"), F.sin("derot").alias("s"), F.cos("derot").alias("k"), *more)

    def run(batches):
        for batch in batches:
            lists = batch.column("cells")
            ends = lists.offsets.to_numpy()
            start = 0
            while start < batch.num_rows:  # frames of about a million pixels at a time
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 20), "right")) - 1)
                part = batch.slice(start, stop - start)
                flat = part.column("cells").flatten()
                mode, row, col = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mode_idx", "row", "col"))
                missing = flat.field("value").is_null().to_numpy(zero_copy_only=False)
                value = flat.field("value").fill_null(0.0).to_numpy(zero_copy_only=False)
                frame = np.repeat(np.arange(part.num_rows), np.diff(ends[start : stop + 1]))
                angle = [part.column(c).fill_null(v).to_numpy(zero_copy_only=False) for c, v in (("still", False), ("s", np.nan), ("k", np.nan))]
                at, kind, y, x, out, null = images.rotate_planes(frame, mode, row, col, value, missing, *angle, size)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("seq").take(rows), pa.array(kind, pa.int32()), part.column("frame_idx").take(rows), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(out, mask=null), *(part.column(c).take(rows) for c in more)],
                    ["seq", "mode_idx", "frame_idx", "row", "col", "value", *more],
                )
                start = stop

    seq, frame, *rest = (f"{c} {angles.schema[c].dataType.simpleString()}" for c in [*FRAME, *more])
    return turned.mapInArrow(run, ", ".join([seq, "mode_idx int", frame, "row int", "col int", "value double", *rest]))


def rotate_mask(mask: DataFrame, angles: DataFrame, geo: DataFrame, size: int) -> DataFrame:
    """(seq, frame_idx, row, col, good): the nearest input pixel decides; outside the image is bad."""
    c = (size - 1) / 2
    at = angles.crossJoin(F.broadcast(geo.select("row", "col")))
    dr, dc, s, k = F.col("row") - c, F.col("col") - c, F.sin("derot"), F.cos("derot")
    near = at.select(*FRAME, "row", "col", F.floor(dr * k + dc * s + c + 0.5).cast("int").alias("in_row"), F.floor(-dr * s + dc * k + c + 0.5).cast("int").alias("in_col"))
    good = mask.select(F.col("row").alias("in_row"), F.col("col").alias("in_col"), "good")
    return near.join(F.broadcast(good), ["in_row", "in_col"], "left").select(*FRAME, "row", "col", F.coalesce("good", F.lit(False)).alias("good"))


def dependency_frames(taps: DataFrame, stamp: Column) -> DataFrame:
    """The frames whose fit each detector pixel takes part in, for output pixels in ``stamp``."""
    wanted = taps.filter(stamp)
    whole = wanted.groupBy(*FRAME, "row", "col").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == TAPS).drop("n")
    return wanted.join(whole, [*FRAME, "row", "col"], "left_semi").groupBy("seq", "in_row", "in_col").agg(F.array_sort(F.collect_set("frame_idx")).alias("frames"))


def footprint_reasons(taps: DataFrame, mask: DataFrame, size: int) -> DataFrame:
    """(row, col, reasons) over all frames: bit 1 a footprint leaves the image, bit 2 a masked tap."""
    good = mask.select(F.col("row").alias("in_row"), F.col("col").alias("in_col"), "good")
    bit = F.when(~inside(size), 1).when(~F.coalesce("good", F.lit(False)), 2).otherwise(0)
    return taps.join(F.broadcast(good), ["in_row", "in_col"], "left").groupBy("seq", "row", "col").agg(F.bit_or(bit).alias("reasons"))


def source_frames(angles: DataFrame, sources: DataFrame, geo: DataFrame, size: int, fwhm: float) -> DataFrame:
    """(seq, frame_idx, row, col, added): Gaussian sources at fixed sky positions, as the detector saw them.

    ``sources`` has separation, position_angle, contrast (a short list, broadcast); ``angles`` may have ``scale``. Sources add.
    """
    c, sigma = (size - 1) / 2, fwhm / 2.3548200450309493
    scale = F.col("scale") if "scale" in angles.columns else F.lit(1.0)
    at = angles.crossJoin(F.broadcast(sources)).select(*FRAME, (scale * F.col("contrast")).alias("__k"), (F.lit(c) + F.col("separation") * F.sin(F.col("derot") - F.radians("position_angle"))).alias("__x"), (F.lit(c) + F.col("separation") * F.cos(F.col("derot") - F.radians("position_angle"))).alias("__y"))
    d2 = F.pow(F.col("row") - F.col("__x"), 2) + F.pow(F.col("col") - F.col("__y"), 2)
    return at.crossJoin(F.broadcast(geo.select("row", "col"))).groupBy(*FRAME, "row", "col").agg(F.sum(F.col("__k") * F.exp(-d2 / (2 * sigma * sigma))).alias("added"))


def inject(pixels: DataFrame, angles: DataFrame, sources: DataFrame, geo: DataFrame, size: int, fwhm: float) -> DataFrame:
    added = source_frames(angles, sources, geo, size, fwhm)
    return pixels.join(added, [*FRAME, "row", "col"], "left").withColumn("value", F.col("value") + F.coalesce("added", F.lit(0.0))).drop("added")


def pad_or_cut(pixels: DataFrame, old: int, new: int) -> DataFrame:
    """A centred crop or a frame of zeros to pad with; sizes must have the same parity."""
    if (old - new) % 2:
        raise ValueError("sizes must have the same parity")
    d = (new - old) // 2
    moved = pixels.withColumns({"row": F.col("row") + d, "col": F.col("col") + d})
    if new > old:
        spark = pixels.sparkSession
        ring = spark.range(new * new).select((F.col("id") % new).cast("int").alias("row"), F.floor(F.col("id") / new).cast("int").alias("col")).filter(~(F.col("row").between(d, d + old - 1) & F.col("col").between(d, d + old - 1)))
        others = [c for c in pixels.columns if c not in ("row", "col", "value")]
        return moved.unionByName(pixels.select(*others).distinct().crossJoin(F.broadcast(ring)).withColumn("value", F.lit(0.0)))
    return moved.filter(F.col("row").between(0, new - 1) & F.col("col").between(0, new - 1))


def inject_template(stack: DataFrame, template, sources: list[tuple[float, float, float]], size: int) -> DataFrame:
    """Add a template image, moved to each (separation, position angle, contrast), to frames (frame_idx, derot, scale, pixels, ...).

    Whole frames pass through a numpy kernel, one Arrow batch at a time; outside the template's footprint nothing is added.
    """
    import numpy as np

    from ..kernels import images

    def run(batches):
        for p in batches:
            out = []
            for values, derot, scale in zip(p["pixels"], p["derot"], p["scale"], strict=True):
                frame = np.array(values, float).reshape(size, size).T.copy()
                for sep, pa, contrast in sources:
                    a = derot - np.radians(pa)
                    frame += scale * contrast * np.nan_to_num(images.shift(template, sep * np.sin(a), sep * np.cos(a)))
                out.append(frame.T.ravel())
            yield p.assign(pixels=out)

    return stack.mapInPandas(run, stack.schema)


def inject_templates(stack: DataFrame, sources: list[tuple[float, float, float]], size: int) -> DataFrame:
    """Like ``inject_template``, each frame with a template of its own (columns template, template_rows; not larger than the frame)."""
    import numpy as np

    from ..kernels import images

    def run(batches):
        for p in batches:
            out = []
            for values, derot, scale, template, n in zip(p["pixels"], p["derot"], p["scale"], p["template"], p["template_rows"], strict=True):
                pad = size - n
                if pad < 0 or pad % 2:
                    raise ValueError("a template's size must have the frames' parity and not exceed theirs")
                source = np.pad(np.array(template, float).reshape(n, n).T, pad // 2)
                frame = np.array(values, float).reshape(size, size).T.copy()
                for sep, pa, contrast in sources:
                    a = derot - np.radians(pa)
                    frame += scale * contrast * np.nan_to_num(images.shift(source, sep * np.sin(a), sep * np.cos(a)))
                out.append(frame.T.ravel())
            yield p.assign(pixels=out)

    return stack.mapInPandas(run, stack.schema)


def trial_frames(stack: DataFrame, template, trials: list[tuple[float, float, float]], size: int) -> DataFrame:
    """(.., trial): each frame (derot, pixels, ...) once for each trial, less the template moved to the trial's (separation, position angle, contrast)."""
    import numpy as np

    from ..kernels import images

    def run(batches):
        for p in batches:
            for i, (sep, pa, contrast) in enumerate(trials):
                out = []
                for values, derot in zip(p["pixels"], p["derot"], strict=True):
                    a = derot - np.radians(pa)
                    frame = np.array(values, float).reshape(size, size).T - contrast * np.nan_to_num(images.shift(template, sep * np.sin(a), sep * np.cos(a)))
                    out.append(frame.T.ravel())
                yield p.assign(pixels=out, trial=i)

    return stack.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stack.schema.fields) + ", trial int")
