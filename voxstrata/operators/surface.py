"""Height surfaces, distances to them, and projections along them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.weights import line_weights
from ..model import Grid, InvalidArgument, Kernel, Projection
from .envelope import min_plus
from .stencil import convolve_axis, trilinear


def height_map(field: DataFrame, grid: Grid, *, xy_radius: int = 0, z_radius: int = 4, kernel: Kernel = Kernel.GAUSSIAN, smooth: int = 1, level: float = 0.5) -> DataFrame:
    """Image of the first z at which the Z-smoothed field exceeds level, between samples.

    0 if the first sample does, depth - 1 if none does; then ``smooth`` rounds
    of X and Y smoothing.
    """
    if not (0 <= xy_radius <= 64 and 0 <= z_radius <= 64):
        raise InvalidArgument("radii must be between 0 and 64")
    if not 0 <= smooth <= 10:
        raise InvalidArgument("the smooth level must be between 0 and 10")
    if not math.isfinite(level):
        raise InvalidArgument("the surface level must be finite")
    gaussian = kernel == Kernel.GAUSSIAN
    filtered = convolve_axis(field, "z", line_weights(z_radius, gaussian))
    column = Window.partitionBy("volume_id", "y", "x").orderBy("z")
    before = filtered.withColumn("p", F.lag("v").over(column))
    crossing = F.when((F.col("v") > float(level)) & ~F.isnan("v"), F.struct("z", "v", "p"))
    first = before.groupBy("volume_id", "y", "x").agg(F.min(crossing).alias("f"))
    z, v, p = F.col("f.z"), F.col("f.v"), F.col("f.p")
    between = F.when(v - p == 0, z - 1.0).otherwise(z - 1.0 + (F.lit(float(level)) - p) / F.when(v - p != 0, v - p))
    surface = first.select("volume_id", "y", "x", F.when(F.col("f").isNull(), F.lit(grid.depth - 1.0)).when(z == 0, F.lit(0.0)).otherwise(between).cast("float").cast("double").alias("v"))
    for _ in range(smooth):
        for axis in ("x", "y"):
            surface = _convolve_image(surface, axis, line_weights(xy_radius, gaussian))
    return surface


def _convolve_image(image: DataFrame, axis: str, weights: list[float]) -> DataFrame:
    if len(weights) == 1:
        return image
    plane = convolve_axis(image.withColumn("z", F.lit(0)), axis, weights)
    return plane.select("volume_id", "y", "x", "v")


def depth_map(field: DataFrame, grid: Grid, **surface) -> DataFrame:
    """For z above the surface, the least distance in voxels to any surface point; else 0.

    The squared distance to all points (hx, hy, H) parts into a pass over x and
    a pass over y, each the lower envelope of a line's parabolas.
    """
    top = height_map(field, grid, **surface)
    planes = top.select("volume_id", "y", "x", F.col("v").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(grid.depth - 1))).alias("z"))
    squares = planes.select("volume_id", "z", "y", "x", ((F.col("z") - F.col("h")) * (F.col("z") - F.col("h"))).alias("v"))
    for axis in ("x", "y"):
        squares = min_plus(squares, axis)
    far = squares.join(top.withColumnRenamed("v", "h"), ["volume_id", "y", "x"])
    return far.select("volume_id", "z", "y", "x", F.when(F.col("z") > F.col("h"), F.sqrt("v")).otherwise(F.lit(0.0)).alias("v"))


def surface_normals(surface: DataFrame, grid: Grid) -> DataFrame:
    """(volume_id, y, x, h, nx, ny, nz): mean of the normals of the four neighbouring patches."""
    row = Window.partitionBy("volume_id", "y").orderBy("x")
    column = Window.partitionBy("volume_id", "x").orderBy("y")
    near = surface.select("volume_id", "y", "x", F.col("v").alias("h"))
    near = near.withColumns({"l": F.lag("h").over(row), "r": F.lead("h").over(row)}).withColumns({"u": F.lag("h").over(column), "d": F.lead("h").over(column)})
    zero = F.lit(0.0)

    def slope(a, b, sign_a):
        """x part of a patch that has both neighbours."""
        return F.when(a.isNotNull() & b.isNotNull(), sign_a * (a - F.col("h"))).otherwise(zero)

    left, right, up, down = (F.col(c) for c in "lrud")
    sx = slope(right, down, -1) + slope(left, down, 1) + slope(left, up, 1) + slope(right, up, 1)
    sy = slope(down, right, -1) + slope(down, left, -1) + slope(up, left, 1) + slope(up, right, 1)
    patches = sum(((a.isNotNull() & b.isNotNull()).cast("int") for a, b in ((right, down), (left, down), (left, up), (right, up))), F.lit(0))
    summed = near.select("volume_id", "y", "x", "h", sx.alias("sx"), sy.alias("sy"), patches.cast("double").alias("sz"))
    length = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    safe = F.when(length > 0, length)
    return summed.select("volume_id", "y", "x", "h", F.coalesce(F.col("sx") / safe, zero).alias("nx"), F.coalesce(F.col("sy") / safe, zero).alias("ny"), F.coalesce(F.col("sz") / safe, F.lit(1.0)).alias("nz"))


def height_projection(field: DataFrame, grid: Grid, *, mode: Projection = Projection.NORMAL, reach: int = 0, offset: float = 0.0, start: float = 0.0, level: float = 0.0, surface_level: float = 0.5, **surface) -> DataFrame:
    """Image of the greatest sample on a ray of ``reach`` + 1 steps from the surface.

    A ray ends where it leaves the volume (along Z, steps above the volume are
    passed over).  Normal rays with level > 0 give 1 if a sample exceeds it,
    else 0; Z rays give 0 if the greatest sample is below level.
    """
    if reach < 0:
        raise InvalidArgument("the range must not be negative")
    if not all(map(math.isfinite, (offset, start, level))):
        raise InvalidArgument("projection parameters must be finite")
    top = height_map(field, grid, level=surface_level, **surface)
    base = surface_normals(top, grid) if mode == Projection.NORMAL else top.select("volume_id", "y", "x", F.col("v").alias("h"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    step = F.sequence(F.lit(0), F.lit(reach))

    def at(t):
        distance = t + F.lit(float(start))
        px, py, pz = F.col("x") + F.col("nx") * distance, F.col("y") + F.col("ny") * distance, F.col("h") + F.col("nz") * distance + F.lit(float(offset))
        out = (px < 0) | (py < 0) | (pz < 0) | (px > grid.width - 1) | (py > grid.height - 1) | (pz > grid.depth - 1)
        above = out & (pz < 0) if mode == Projection.Z else F.lit(False)
        return F.struct(t.alias("step"), px.alias("px"), py.alias("py"), pz.alias("pz"), out.alias("out"), (out & ~above).alias("ends"))

    # a ray is one short array, cut at the first step that ends it
    rays = base.select("volume_id", "y", "x", F.transform(step, at).alias("ray"))
    ended = F.array_position(F.transform("ray", lambda p: p["ends"]), F.lit(True)).cast("int")
    alive = F.filter(F.when(ended > 0, F.slice("ray", F.lit(1), ended - 1)).otherwise(F.col("ray")), lambda p: ~p["out"])
    points = rays.select("volume_id", "y", "x", F.explode(alive).alias("p")).select("volume_id", F.struct("y", "x", F.col("p.step").alias("step")).alias("point_id"), "p.px", "p.py", "p.pz")
    samples = trilinear(field, grid, points).select("volume_id", "point_id.*", "v")
    # every place of the image has a 0, so rays without a sample need no join
    floor = field.select("volume_id", "y", "x", F.lit(0.0).alias("v"))
    shape = samples.select("volume_id", "y", "x", "v").unionByName(floor).groupBy("volume_id", "y", "x").agg(F.max("v").alias("m"))
    m = F.col("m")
    if mode == Projection.NORMAL and level > 0:
        value = F.when(m > float(level), F.lit(1.0)).otherwise(F.lit(0.0))
    elif mode == Projection.Z:
        value = F.when(m < float(level), F.lit(0.0)).otherwise(m)
    else:
        value = m
    return shape.select("volume_id", "y", "x", value.alias("v"))
