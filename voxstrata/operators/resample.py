"""Depth resampling and orthogonal planes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import lanczos_weight
from ..model import Grid, InvalidArgument


def resampled_depth(grid: Grid, target: float) -> int:
    if not target > 0:
        raise InvalidArgument("the target spacing must be positive")
    return max(1, math.floor(grid.depth * grid.spacing[2] / target + 0.5))


def area_taps(depth: int, out: int) -> list[tuple[int, int, float]]:
    """(output plane, input plane, weight), weights summing to 1."""
    scale, taps = depth / out, []
    for oz in range(out):
        begin, end = oz * scale, (oz + 1) * scale
        raw = [(min(max(iz, 0), depth - 1), max(0.0, min(end, iz + 1.0) - max(begin, iz))) for iz in range(math.floor(begin), math.ceil(end))]
        total = sum(w for _, w in raw)
        taps += [(oz, iz, w / total) for iz, w in raw if total and w]
    return taps


def lanczos_taps(depth: int, out: int, order: int) -> list[tuple[int, int, float]]:
    if order not in (2, 3):
        raise InvalidArgument("the Lanczos order is 2 or 3")
    scale, taps = depth / out, []
    for oz in range(out):
        centre = (oz + 0.5) * scale - 0.5
        near = range(math.floor(centre) - order + 1, math.floor(centre) + order + 1)
        raw = [(min(max(iz, 0), depth - 1), lanczos_weight(centre - iz, order)) for iz in near]
        total = sum(w for _, w in raw)
        taps += [(oz, iz, w / total) for iz, w in raw if total and w]
    return taps


def resample_z(field: DataFrame, grid: Grid, target: float, order: int | None = None) -> tuple[DataFrame, Grid]:
    """Overlap-weighted mean (order None) or Lanczos; the index scale is depth / new depth.

    Each voxel goes to the few planes it has a weight in, found in an array that
    its z selects, and the parts of an output voxel are added in one order.
    """
    out = resampled_depth(grid, target)
    taps = area_taps(grid.depth, out) if order is None else lanczos_taps(grid.depth, out, order)
    by_plane: dict[int, list[tuple[int, int, float]]] = {}
    for k, (oz, iz, w) in enumerate(taps):
        by_plane.setdefault(iz, []).append((oz, k, w))
    spark = field.sparkSession
    # at most (2 * order, or scale + 2) * depth rows of four numbers: a bounded driver table
    table = spark.createDataFrame([(iz, oz, k, w) for iz, ts in by_plane.items() for oz, k, w in ts], "z int, oz int, k int, w double")
    parts = field.join(F.broadcast(table), "z").groupBy("volume_id", F.col("oz").alias("z"), "y", "x").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("v") * F.col("w")).alias("p")))).alias("ps"))
    value = F.aggregate("ps", F.lit(0.0), lambda acc, s: acc + s["p"]).cast("float").cast("double")
    sx, sy, _ = grid.spacing
    return parts.select("volume_id", "z", "y", "x", value.alias("v")), grid.resized(depth=out, spacing=(sx, sy, float(target)))


def _plane(field: DataFrame, axis: str, index: int, extent: int) -> DataFrame:
    if not 0 <= index < extent:
        raise InvalidArgument("the slice index is out of range")
    return field.where(F.col(axis) == index)


def extract_xy(field: DataFrame, grid: Grid, z: int) -> DataFrame:
    return _plane(field, "z", z, grid.depth).select("volume_id", "y", "x", "v")


def extract_yz(field: DataFrame, grid: Grid, x: int) -> DataFrame:
    """The image is as wide as the volume is deep."""
    return _plane(field, "x", x, grid.width).select("volume_id", "y", F.col("z").alias("x"), "v")


def extract_zx(field: DataFrame, grid: Grid, y: int) -> DataFrame:
    return _plane(field, "y", y, grid.height).select("volume_id", F.col("z").alias("y"), "x", "v")
