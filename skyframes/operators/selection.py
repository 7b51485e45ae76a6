"""Choosing frames: trimming, quality, lookups by basename, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindex(frames: DataFrame, order: str = "frame_idx") -> DataFrame:
    """Consecutive indices in each sequence."""
    return frames.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("seq").orderBy(order)) - 1).cast("int"))


def trim(frames: DataFrame, front: int = 0, back: int = 0) -> DataFrame:
    """Drop the first and last frames of each sequence; what is dropped must leave something."""
    if front < 0 or back < 0:
        raise ValueError("counts must not be negative")
    n = F.count(F.lit(1)).over(Window.partitionBy("seq"))
    at = F.row_number().over(Window.partitionBy("seq").orderBy("frame_idx"))
    marked = frames.withColumn("__at", at).withColumn("__n", n)
    bad = F.when(F.col("__n") <= front + back, F.raise_error(F.lit("trimming leaves no frame")).cast("boolean")).otherwise((F.col("__at") > front) & (F.col("__at") <= F.col("__n") - back))
    return reindex(marked.filter(bad).drop("__at", "__n"))


def lookup(frames: DataFrame, table: DataFrame, value: str, required: bool = True, last_wins: bool = False) -> DataFrame:
    """``value`` by basename. Missing entries fail the job if required; duplicates fail it unless the last wins.

    The table has a row per frame, so it may be as large as the listing: the engine chooses how to join it.
    """
    found = table.groupBy("basename").agg(F.max_by(value, "line").alias(value), F.count(F.lit(1)).alias("__n"))
    if not last_wins:
        found = found.withColumn(value, F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate entry")).cast("double")).otherwise(F.col(value)))
    out = frames.join(found.drop("__n"), "basename", "left")
    return out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("no entry for "), "basename")).cast("double"))) if required else out


def quality_select(frames: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Keep frames with quality at the threshold or above; a threshold of 0 or less keeps all."""
    return frames if threshold <= 0 else reindex(lookup(frames, table, "quality").filter(F.col("quality") >= threshold))


def surviving_names(frames: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    return quality_select(frames, table, threshold).select("seq", "frame_idx", "basename")


def normalized_weights(frames: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights over their sum by sequence; a sum that is zero or not finite fails the job."""
    total = F.sum(weight).over(Window.partitionBy("seq"))
    bad = total.isNull() | (total == 0) | F.isnan(total) | (F.abs(total) == float("inf"))
    return frames.withColumn(weight, F.when(bad, F.raise_error(F.lit("weights don't sum to a usable number")).cast("double")).otherwise(F.col(weight) / total))


def missing_cells(found: DataFrame, modes: DataFrame, frames: DataFrame) -> DataFrame:
    """(mode_idx, frame_idx) that a saved collection lacks."""
    return modes.crossJoin(frames).join(found, ["mode_idx", "frame_idx"], "left_anti")


def bad_cards(frames: DataFrame, number: Column) -> DataFrame:
    """Frames whose card is no number."""
    return frames.filter(number.isNull())
