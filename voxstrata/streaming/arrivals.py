"""Volumes that arrive as files: pointwise operators and per-plane sums on a stream.

The reference engine is batch only; this is an extension.  Pointwise operators
are the batch functions, as they need no neighbour.  Per-plane sums carry a
watermark on the arrival time, so state for old windows is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXEL_SCHEMA = "volume_id string, z int, y int, x int, v double, arrived timestamp"


def read_arrivals(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(VOXEL_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def plane_sums(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, volume_id, z, voxels, foreground, total) of voxels that arrive within a window."""
    grouped = stream.withWatermark("arrived", late).groupBy(F.window("arrived", window).alias("window"), "volume_id", "z")
    return grouped.agg(F.count(F.lit(1)).alias("voxels"), F.sum((F.col("v") > 0).cast("long")).alias("foreground"), F.sum("v").alias("total"))
