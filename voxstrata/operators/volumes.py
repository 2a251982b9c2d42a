"""Running a NumPy kernel on each volume of a relation, or on slabs of it.

A volume becomes one Arrow group; the groups of many volumes run in parallel.
Kernels that read a bounded neighbourhood run on slabs of planes instead: each
plane goes to every slab whose halo needs it, so one large volume is spread over
the cluster.  ``MAX_VOXELS`` bounds what one task is given.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Grid, ResourceLimit

MAX_VOXELS = 1 << 27
SLAB_VOXELS = 1 << 22
#: What a tile with its halo has at most, unless a halo alone is more.
TILE_VOXELS = 1 << 23


def to_array(table: pa.Table, grid: Grid, column: str, kind, first: int = 0, planes: int | None = None) -> np.ndarray:
    out = np.zeros((grid.depth if planes is None else planes, grid.height, grid.width), kind)
    out[table.column("z").to_numpy() - first, table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column(column).to_numpy()
    return out


def from_arrays(volume_id: str, arrays: dict[str, np.ndarray], first: int = 0) -> pa.Table:
    shape = next(iter(arrays.values())).shape
    z, y, x = (a.ravel() for a in np.indices(shape, np.int32))
    # one name for all rows, in pieces whose bytes an Arrow string column can address
    piece = max(1, (1 << 30) // max(1, len(volume_id.encode())))
    names = pa.chunked_array([pa.repeat(pa.scalar(volume_id, pa.string()), min(piece, len(z) - a)) for a in range(0, len(z), piece)], pa.string())
    return pa.table({"volume_id": names, "z": z + np.int32(first), "y": y, "x": x, **{k: a.ravel() for k, a in arrays.items()}})


def per_volume(rows: DataFrame, grid: Grid, kernel: Callable[[str, pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """kernel(volume_id, rows of the volume) to named arrays; schema names their columns and types."""
    if grid.voxels > MAX_VOXELS:
        raise ResourceLimit(f"a volume of {grid.voxels} voxels is above {MAX_VOXELS} for a kernel that needs it whole")

    def run(table: pa.Table) -> pa.Table:
        name = table.column("volume_id")[0].as_py()
        return from_arrays(name, kernel(name, table))

    return rows.groupBy("volume_id").applyInArrow(run, f"volume_id string, z int, y int, x int, {schema}")


def per_slab(field: DataFrame, grid: Grid, halo: int, kernel: Callable[[np.ndarray, int, int, int], dict[str, np.ndarray]], schema: str, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """kernel(planes, first plane wanted, last + 1, number of the first plane given) to named arrays."""
    thick = max(1, min(grid.depth, slab_voxels // (grid.width * grid.height)))
    last = (grid.depth - 1) // thick
    lo = F.greatest(F.floor((F.col("z") - halo) / thick).cast("int"), F.lit(0))
    hi = F.least(F.floor((F.col("z") + halo) / thick).cast("int"), F.lit(last))
    dealt = field.withColumn("slab", F.explode(F.sequence(lo, hi)))

    def run(table: pa.Table) -> pa.Table:
        name, slab = table.column("volume_id")[0].as_py(), table.column("slab")[0].as_py()
        first, end = slab * thick, min((slab + 1) * thick, grid.depth)
        base, top = max(0, first - halo), min(grid.depth, end + halo)
        planes = to_array(table, grid, "v", np.float32, base, top - base)
        return from_arrays(name, kernel(planes, first, end, base), first)

    return dealt.groupBy("volume_id", "slab").applyInArrow(run, f"volume_id string, z int, y int, x int, {schema}")


def tile_sides(grid: Grid, halo: int, voxels: int = TILE_VOXELS) -> tuple[int, int]:
    """(planes, rows) of a tile: whole planes if some fit with their halo, else pieces of planes."""
    whole = voxels // (grid.width * grid.height) - 2 * halo
    if whole >= 1 or grid.voxels <= voxels:
        return max(1, min(grid.depth, whole if whole >= 1 else grid.depth)), grid.height
    side = max(int((voxels / grid.width) ** 0.5) - 2 * halo, halo, 1)
    return min(side, grid.depth), min(side, grid.height)


def per_tile(field: DataFrame, grid: Grid, halo: int, kernel: Callable[[np.ndarray], np.ndarray], voxels: int = TILE_VOXELS) -> DataFrame:
    """kernel(v with a halo, cut off at the volume's edge) to an array of that shape, whose inner part is kept.

    A row goes to every tile of planes and rows whose halo needs it; a tile
    spans the whole width.
    """
    sides = tile_sides(grid, halo, voxels)

    def reach(axis: str, side: int, extent: int):
        lo = F.greatest(F.floor((F.col(axis) - halo) / side).cast("int"), F.lit(0))
        return F.explode(F.sequence(lo, F.least(F.floor((F.col(axis) + halo) / side).cast("int"), F.lit((extent - 1) // side))))

    dealt = field.select("volume_id", "z", "y", "x", "v").withColumn("tz", reach("z", sides[0], grid.depth)).withColumn("ty", reach("y", sides[1], grid.height))

    def run(table: pa.Table) -> pa.Table:
        name = table.column("volume_id")[0].as_py()
        spans = []
        for column, side, extent in (("tz", sides[0], grid.depth), ("ty", sides[1], grid.height)):
            first = table.column(column)[0].as_py() * side
            end = min(first + side, extent)
            spans.append((first, end, max(0, first - halo), min(extent, end + halo)))
        (z0, z1, za, zb), (y0, y1, ya, yb) = spans
        a = np.zeros((zb - za, yb - ya, grid.width))
        a[table.column("z").to_numpy() - za, table.column("y").to_numpy() - ya, table.column("x").to_numpy()] = table.column("v").to_numpy()
        out = from_arrays(name, {"v": kernel(a)[z0 - za : z1 - za, y0 - ya : y1 - ya].astype(np.float64)}, z0)
        return out.set_column(2, "y", pa.array(out.column("y").to_numpy() + np.int32(y0)))

    return dealt.groupBy("volume_id", "tz", "ty").applyInArrow(run, "volume_id string, z int, y int, x int, v double")
