"""Minimum and maximum filters over cubes and balls.

At the edge the window is cut off, which for extremes equals clamped
coordinates.  A cube is three passes of framed windows.  A ball of radius r is
the union of runs along x, one for each (dy, dz) with dy**2 + dz**2 <= r**2.
Small balls stay on rows: a framed window gives every run of a half-width once,
the runs are moved by (dy, dz), and moved runs are combined by an aggregate that
is partial before its shuffle.  That is some pi r**2 rows for each voxel, so
larger balls run on tiles with a halo of r, where a voxel is sent a few times.
"""

from __future__ import annotations

from collections import defaultdict
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Grid, InvalidArgument
from . import dense
from .stencil import extreme_axis
from .volumes import per_tile

#: Balls up to this radius, of 13 moved runs at most, stay on rows.
ROWS_RADIUS = 2


def _radius(radius: int, top: int = 64) -> None:
    if not 0 <= radius <= top:
        raise InvalidArgument(f"radius must be between 0 and {top}")


def cube(field: DataFrame, radius: int, dilate: bool) -> DataFrame:
    _radius(radius)
    if radius:
        for axis in ("x", "y", "z"):
            field = extreme_axis(field, axis, radius, dilate)
    return field


def _tile_kernel(radius: int, dilate: bool):
    """NaN is above all numbers, as in Spark's minimum and maximum."""

    def run(a: np.ndarray) -> np.ndarray:
        odd = np.isnan(a)
        if dilate or not odd.any():
            return dense.ball(a, radius, dilate)
        out = dense.ball(np.where(odd, np.inf, a), radius, False)
        return np.where(dense.ball(odd.astype(np.float32), radius, False) > 0, np.nan, out)

    return run


def ball(field: DataFrame, grid: Grid, radius: int, dilate: bool, keys: tuple[str, ...] = (), engine: str = "auto") -> DataFrame:
    """``keys`` are further columns that part the field, such as a component's number.  Engines: "rows", "tiles"."""
    _radius(radius)
    if radius == 0:
        return field
    if not keys and (engine == "tiles" or engine == "auto" and radius > ROWS_RADIUS):
        return per_tile(field, grid, radius, _tile_kernel(radius, dilate))
    pick = F.max if dilate else F.min
    by_width: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for dz in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            if (left := radius * radius - dy * dy - dz * dz) >= 0:
                by_width[isqrt(left)].append((dy, dz))
    line = Window.partitionBy("volume_id", *keys, "z", "y").orderBy("x")
    runs = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), pick("v").over(line.rowsBetween(-half, half)).alias("m")) for half, moves in sorted(by_width.items()) for dy, dz in moves])
    moved = field.withColumn("run", runs).select("volume_id", *keys, "z", "y", "x", F.explode("run").alias("r"))
    moved = moved.select("volume_id", *keys, (F.col("z") + F.col("r.dz")).alias("z"), (F.col("y") + F.col("r.dy")).alias("y"), "x", F.col("r.m").alias("m"))
    inside = F.col("z").between(0, grid.depth - 1) & F.col("y").between(0, grid.height - 1)
    return moved.where(inside).groupBy("volume_id", *keys, "z", "y", "x").agg(pick("m").alias("v"))


def closing(field: DataFrame, grid: Grid, radius: int) -> DataFrame:
    return ball(ball(field, grid, radius, True), grid, radius, False)


def chunked(field: DataFrame, grid: Grid, radius: int, opening: bool) -> DataFrame:
    """Opening or closing by balls of radius 4 at most, one after the other; not the same as one ball."""
    if radius < 0:
        raise InvalidArgument("radius must not be negative")
    for dilate in (not opening, opening):
        left = radius
        while left > 0:
            field = ball(field, grid, min(left, 4), dilate)
            left -= 4
    return field
