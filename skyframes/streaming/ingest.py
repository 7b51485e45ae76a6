"""Frames as a stream: arriving observations update running sums per pixel; combined images follow from the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import frames


def frame_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of frame files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def running_combination(stream: DataFrame, n_rows: int) -> DataFrame:
    """(seq, row, col, value, n_good, rms): the mean so far; state is one row per pixel, not per frame."""
    px = frames.explode_frames(stream, n_rows)
    return px.groupBy("seq", "row", "col").agg(F.avg("value").alias("value"), F.count("value").alias("n_good"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def windowed_levels(stream: DataFrame, n_rows: int, time: str, width: str, late: str) -> DataFrame:
    """Mean level per sequence and time window; frames later than ``late`` are left out."""
    px = frames.explode_frames(stream.withWatermark(time, late), n_rows, keep=("seq", "frame_idx", time))
    return px.groupBy("seq", F.window(time, width).alias("window")).agg(F.avg("value").alias("level"), F.count("value").alias("n"))


def start(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
