"""Co-adding: consecutive frames in groups by count, elapsed time or angle span."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import angle_diff


def by_count(frames: DataFrame, most: int) -> DataFrame:
    return frames.withColumn("grp", F.floor(F.col("frame_idx") / most).cast("long"))


def _scan(max_count: int, max_time: float, max_angle: float):
    """Greedy groups over rows sorted by (seq, order): the state is one row, whatever a sequence's length."""
    over = lambda x, limit: limit > 0 and x - limit > 1e-6 * max(1.0, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, grp, n, start, low, high, last = object(), -1, 0, 0.0, 0.0, 0.0, 0.0
        for batch in batches:
            out = []
            for s, t, a in zip(batch.column("seq").to_pylist(), batch.column("t").to_pylist(), batch.column("angle").to_pylist(), strict=True):
                new = s != seq
                if new:
                    seq, grp = s, -1
                else:
                    theta = last + ((a - last + 180.0) % 360.0 - 180.0)
                    new = bool(max_count and n >= max_count) or over(t - start, max_time) or over(max(high, theta) - min(low, theta), max_angle)
                if new:
                    grp, n, start, low, high, last = grp + 1, 0, t, a, a, a
                else:
                    low, high, last = min(low, theta), max(high, theta), theta
                n += 1
                out.append(grp)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns)), pa.array(out, pa.int64())], [*batch.schema.names, "grp"])

    return run


def greedy(frames: DataFrame, max_count: int = 0, max_time: float = 0.0, max_angle: float = 0.0, order: str = "frame_idx") -> DataFrame:
    """``frames`` (seq, order, t seconds, angle degrees, ...) with ``grp``: any active limit closes a group.

    Times are measured from the group's first frame, so this isn't a session window. Frames are dealt by sequence and sorted;
    a task streams through its sequences and holds one batch.
    """
    if not (max_count or max_time > 0 or max_angle > 0):
        return frames.withColumn("grp", F.row_number().over(Window.partitionBy("seq").orderBy(order)).cast("long") - 1)
    ordered = frames.repartition("seq").sortWithinPartitions("seq", order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return ordered.mapInArrow(_scan(max_count, max_time, max_angle), schema + ", grp long")


def coadd_pixels(pixels: DataFrame, groups: DataFrame, method: str = "mean") -> DataFrame:
    """(seq, grp, row, col, value)."""
    stat = {"mean": F.avg, "median": F.median}[method]("value")
    return pixels.join(groups.select("seq", "frame_idx", "grp"), ["seq", "frame_idx"]).groupBy("seq", "grp", "row", "col").agg(stat.alias("value"))


def unwrap(frames: DataFrame, angle: str = "angle") -> DataFrame:
    """``theta``: the first angle plus the shortest arcs since; ``path``: the summed arc lengths."""
    w = Window.partitionBy("seq").orderBy("frame_idx")
    step = F.coalesce(angle_diff(F.lag(angle).over(w), F.col(angle)), F.lit(0.0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = frames.withColumn("__step", step)
    return out.withColumns({"theta": F.first(angle).over(run) + F.sum("__step").over(run), "path": F.sum(F.abs("__step")).over(run)}).drop("__step")


def header_means(frames: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Mean, first, last and difference of a card over groups of frames."""
    at = F.col("frame_idx")
    rows = frames.withColumn("__v", value)
    return rows.groupBy(*keys).agg(F.avg("__v").alias(name), F.min_by("__v", at).alias(f"start_{name}"), F.max_by("__v", at).alias(f"end_{name}"), (F.max_by("__v", at) - F.min_by("__v", at)).alias(f"delta_{name}"), F.count(F.lit(1)).alias("n"))
