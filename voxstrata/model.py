"""Volumes as relations.

A *collection* is a relation (volume_id, c, z, y, x, v); a *field* is one channel
of it, (volume_id, z, y, x, v).  Fields are dense: every coordinate of the grid
has a row.  Labels are (volume_id, z, y, x, label) with -1 for background, and
images are (volume_id, y, x, v).  All volumes of a relation have one ``Grid``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed mask values: global threshold gives 0 or FULL, local and iterative masks 0 or MASK.
FULL, MASK, LOW = 1.0, 0.8, 0.1
BACKGROUND = -1
AXES = ("x", "y", "z")


class EngineError(Exception):
    """Base of all errors; raised before a plan is built wherever that is possible."""


class InvalidArgument(EngineError, ValueError):
    pass


class InvalidState(EngineError):
    pass


class ResourceLimit(EngineError):
    pass


class Cancelled(EngineError):
    pass


class Kernel(IntEnum):
    GAUSSIAN = 0
    MEAN = 1


class Projection(IntEnum):
    NORMAL = 0
    Z = 1


class VoxelType(IntEnum):
    UINT8 = 0
    UINT16 = 1
    INT16 = 2
    UINT32 = 3
    INT32 = 4
    FLOAT32 = 5


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    depth: int
    channels: int = 1
    selected_channel: int = 0
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    calibrated: bool = False
    unit: str = "pixel"

    def __post_init__(self):
        if min(self.width, self.height, self.depth, self.channels) <= 0:
            raise InvalidArgument("extents and channels must be positive")
        if not 0 <= self.selected_channel < self.channels:
            raise InvalidArgument("the selected channel is out of range")
        if not all(s > 0 for s in self.spacing):
            raise InvalidArgument("spacing must be positive")

    @property
    def voxels(self) -> int:
        return self.width * self.height * self.depth

    def extent(self, axis: str) -> int:
        return {"x": self.width, "y": self.height, "z": self.depth}[axis]

    def index(self) -> Column:
        """The linear index of a coordinate, x fastest: the order of labels and exports."""
        return (F.col("z").cast("long") * self.height + F.col("y")) * self.width + F.col("x")

    def resized(self, **extents) -> Grid:
        return replace(self, **extents)


@dataclass(frozen=True)
class Crop:
    """Inclusive depth bounds, absolute or relative to a height map (volume_id, y, x, v)."""

    upper: int
    lower: int
    border_xy: int = 0
    height_map: DataFrame | None = None

    def __post_init__(self):
        if self.upper > self.lower or self.border_xy < 0:
            raise InvalidArgument("crop bounds are not valid")


def coordinates(*, without: str = "") -> list[str]:
    return ["volume_id", *(a for a in ("z", "y", "x") if a != without)]


def validate_volume(field: DataFrame, grid: Grid, value: str = "v") -> None:
    """One row per coordinate and volume, all inside the grid, all finite."""
    inside = F.col("x").between(0, grid.width - 1) & F.col("y").between(0, grid.height - 1) & F.col("z").between(0, grid.depth - 1)
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    facts = field.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(grid.index()).alias("d"), F.sum((~inside).cast("int")).alias("out"), F.sum((~finite).cast("int")).alias("bad"))
    wrong = facts.where((F.col("n") != grid.voxels) | (F.col("d") != grid.voxels) | (F.col("out") > 0) | (F.col("bad") > 0)).first()
    if wrong is not None:
        raise InvalidArgument(f"volume {wrong['volume_id']}: {wrong['n']} rows for {grid.voxels} voxels, {wrong['out']} outside, {wrong['bad']} not finite")
