"""Direction-aware local threshold: the least mean over lines in many directions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import direction_alpha, directions, enforce, estimate, line_weights
from ..model import MASK, Grid, InvalidArgument, Kernel
from . import dense
from .volumes import per_slab


def response(field: DataFrame, grid: Grid, radius: int, level: int, kernel: Kernel, engine: str = "kernel") -> DataFrame:
    """(volume_id, z, y, x, v, least, alpha); v is rounded to float32.  Engine "kernel" runs on slabs with a halo of ``radius``, "rows" on joins."""
    enforce(estimate(grid.width, grid.height, grid.depth, radius, level))
    if engine == "rows":
        return _response_rows(field, grid, radius, level, kernel)
    gaussian, depth = kernel == Kernel.GAUSSIAN, grid.depth

    def run(planes: np.ndarray, first: int, last: int, base: int) -> dict[str, np.ndarray]:
        least, alpha = dense.response(planes, radius, level, gaussian, first, last, base, depth)
        own = planes[first - base : last - base]
        return {"v": own.astype(np.float64), "least": least.astype(np.float64), "alpha": alpha.astype(np.float64)}

    return per_slab(field, grid, radius + 1, run, "v double, least double, alpha double")


def _response_rows(field: DataFrame, grid: Grid, radius: int, level: int, kernel: Kernel) -> DataFrame:
    """The same by rows: voxels x line samples x corners, joined on coordinates.  For small radii."""
    spark = field.sparkSession
    vectors = directions(level)
    taps = [
        (r, d, k, float(vx * k), float(vy * k), float(vz * k), float(w), float(a))
        for r in range(radius, 0, -1)
        for d, ((vx, vy, vz), a) in enumerate(zip(vectors, direction_alpha(vectors), strict=True))
        for k, w in zip(range(-r, r + 1), line_weights(r, kernel == Kernel.GAUSSIAN), strict=True)
    ]
    # radius * (radius + 2) samples of at most 5121 directions: bounded by the parameters
    table = spark.createDataFrame(taps, "r int, d int, k int, dx double, dy double, dz double, w double, alpha double")
    rays = field.select("volume_id", "z", "y", "x").join(F.broadcast(table))

    def corner(axis: str, extent: int):
        p = F.least(F.greatest(F.col(axis) + F.col(f"d{axis}"), F.lit(0.0)), F.lit(float(extent - 1)))
        low = F.floor(p).cast("int")
        return low, F.least(low + 1, F.lit(extent - 1)), p - low

    (x0, x1, fx), (y0, y1, fy), (z0, z1, fz) = (corner(a, grid.extent(a)) for a in "xyz")
    corners = [
        F.struct((z1 if j & 4 else z0).alias("qz"), (y1 if j & 2 else y0).alias("qy"), (x1 if j & 1 else x0).alias("qx"), ((fx if j & 1 else 1 - fx) * (fy if j & 2 else 1 - fy) * (fz if j & 4 else 1 - fz) * F.col("w")).alias("cw"))
        for j in range(8)
    ]
    wanted = rays.select("volume_id", "z", "y", "x", "r", "d", "alpha", F.explode(F.array(*corners)).alias("q")).select("volume_id", "z", "y", "x", "r", "d", "alpha", "q.*").where("cw > 0")
    values = field.select("volume_id", F.col("z").alias("qz"), F.col("y").alias("qy"), F.col("x").alias("qx"), "v")
    sums = wanted.join(values, ["volume_id", "qz", "qy", "qx"]).groupBy("volume_id", "z", "y", "x", "r", "d", "alpha").agg(F.sum(F.col("cw") * F.col("v")).alias("s"))
    least = sums.groupBy("volume_id", "z", "y", "x").agg(F.min(F.struct(F.round("s", 9).alias("s"), (-F.col("r")).alias("r"), "d", "alpha")).alias("m"))
    found = least.select("volume_id", "z", "y", "x", F.col("m.s").alias("least"), F.col("m.alpha").alias("alpha"))
    return field.join(found, ["volume_id", "z", "y", "x"]).select("volume_id", "z", "y", "x", "v", "least", "alpha")


def apply_response(found: DataFrame, constant: float, z_factor: float) -> DataFrame:
    """MASK where v > least - (C (1 - alpha) + C z_factor alpha), else 0."""
    if z_factor < 0:
        raise InvalidArgument("the Z factor must not be negative")
    correction = F.lit(float(constant)) * (1 - F.col("alpha")) + F.lit(float(constant * z_factor)) * F.col("alpha")
    return found.select("volume_id", "z", "y", "x", F.when(F.col("v") > F.col("least") - correction, F.lit(MASK)).otherwise(F.lit(0.0)).alias("v"))


def directional_threshold(field: DataFrame, grid: Grid, *, radius: int, level: int = 2, kernel: Kernel = Kernel.GAUSSIAN, constant: float = 0.0, z_factor: float = 0.2, engine: str = "kernel") -> DataFrame:
    return apply_response(response(field, grid, radius, level, kernel, engine), constant, z_factor)
