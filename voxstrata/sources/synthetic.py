"""Deterministic test volumes as relations: ``spark.range`` and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid, InvalidArgument


def coordinates(spark: SparkSession, grid: Grid, volume_id: str, channels: bool = False) -> DataFrame:
    n = grid.voxels * (grid.channels if channels else 1)
    i = F.col("id")
    plane = grid.width * grid.height
    columns = [F.lit(volume_id).alias("volume_id")]
    if channels:
        columns.append(F.floor(i / grid.voxels).cast("int").alias("c"))
    columns += [(F.floor(i / plane) % grid.depth).cast("int").alias("z"), (F.floor(i / grid.width) % grid.height).cast("int").alias("y"), (i % grid.width).cast("int").alias("x")]
    return spark.range(n).select(*columns)


def _field(spark: SparkSession, grid: Grid, name: str, value: Column, channels: bool = False) -> DataFrame:
    return coordinates(spark, grid, name, channels).withColumn("v", value.cast("float").cast("double"))


def impulse(spark: SparkSession, width: int = 9, height: int = 9, depth: int = 9) -> tuple[DataFrame, Grid]:
    grid = Grid(width, height, depth)
    here = (F.col("x") == width // 2) & (F.col("y") == height // 2) & (F.col("z") == depth // 2)
    return _field(spark, grid, "impulse", F.when(here, 1.0).otherwise(0.0)), grid


def ramp(spark: SparkSession, width: int = 16, height: int = 8, depth: int = 6) -> tuple[DataFrame, Grid]:
    return _field(spark, Grid(width, height, depth), "ramp", (F.col("x") + F.col("y") + F.col("z")) / F.lit(float(width + height + depth - 3))), Grid(width, height, depth)


def sphere(spark: SparkSession, width: int = 96, height: int = 96, depth: int = 48, radius: float = 24, channels: int = 1) -> tuple[DataFrame, Grid]:
    """A ball of which z counts double; channel c is scaled by 1 - 0.2 c."""
    if radius <= 0:
        raise InvalidArgument("the radius must be positive")
    grid = Grid(width, height, depth, channels, spacing=(1.0, 1.0, 2.0), calibrated=True)
    far = sum((((F.col(a) - (n - 1) / 2) * s) ** 2 for a, n, s in (("x", width, 1), ("y", height, 1), ("z", depth, 2))), F.lit(0.0))
    return _field(spark, grid, "sphere", F.when(far <= radius * radius, 1 - F.col("c") * 0.2).otherwise(0.0), channels=True), grid


def touching(spark: SparkSession) -> tuple[DataFrame, Grid]:
    grid = Grid(9, 9, 9)
    spots = [(2, 2, 2), (3, 2, 2), (6, 6, 6)]
    here = F.lit(False)
    for x, y, z in spots:
        here = here | ((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z))
    return _field(spark, grid, "touching", F.when(here, 1.0).otherwise(0.0)), grid


def shell(spark: SparkSession, size: int = 33, inner: float = 8, outer: float = 12) -> tuple[DataFrame, Grid]:
    if inner <= 0 or outer <= inner:
        raise InvalidArgument("the radii must be positive and ordered")
    far = sum((((F.col(a) - (size - 1) / 2) ** 2) for a in "xyz"), F.lit(0.0))
    return _field(spark, Grid(size, size, size), "shell", F.when(far.between(inner * inner, outer * outer), 1.0).otherwise(0.0)), Grid(size, size, size)


def noise(spark: SparkSession, width: int = 32, height: int = 24, depth: int = 12, seed: int = 310) -> tuple[DataFrame, Grid]:
    """Uniform values by hash of the coordinate."""
    grid = Grid(width, height, depth)
    return _field(spark, grid, "noise", F.pmod(F.xxhash64(F.lit(seed), grid.index()), F.lit(1 << 24)) / F.lit(float(1 << 24))), grid


def composite(spark: SparkSession, width: int = 12, height: int = 10, depth: int = 8) -> tuple[DataFrame, Grid]:
    """Three channels: ramps along x, y and z."""
    grid = Grid(width, height, depth, 3, spacing=(1.0, 1.0, 2.5), calibrated=True)
    value = F.when(F.col("c") == 0, F.col("x") / max(1, width - 1)).when(F.col("c") == 1, F.col("y") / max(1, height - 1)).otherwise(F.col("z") / max(1, depth - 1))
    return _field(spark, grid, "composite", value, channels=True), grid
