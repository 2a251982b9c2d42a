"""Weighted neighbourhoods along axes.

A pass over an axis collects each line of voxels into a sorted array (one
shuffle on the two other coordinates), correlates it with the weights in a fixed
order, so that results don't depend on the partitioning, and spreads it again.
Coordinates beyond the ends are clamped.  A line is bounded by the extent of the
grid.  Separable windows take one pass per axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.weights import box_weights, line_weights
from ..model import MASK, Grid, InvalidArgument, Kernel, coordinates


def _others(axis: str) -> list[str]:
    return coordinates(without=axis)


def lines(field: DataFrame, axis: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line along an axis: the other coordinates, ``vs`` in order, and columns to keep likewise."""
    gathered = field.groupBy(*_others(axis)).agg(F.array_sort(F.collect_list(F.struct(axis, "v", *keep))).alias("vs"))

    def part(name: str) -> Column:
        return F.transform("vs", lambda p: p[name])

    return gathered.withColumns({name: part(name) for name in keep}).withColumn("vs", part("v"))


def spread(lined: DataFrame, axis: str, keep: Sequence[str] = ()) -> DataFrame:
    if not keep:
        rows = lined.select(*_others(axis), F.posexplode("vs").alias(axis, "v"))
    else:
        rows = lined.select(*_others(axis), F.posexplode(F.arrays_zip(F.col("vs").alias("v"), *keep)).alias(axis, "p"))
        rows = rows.select("*", "p.*").drop("p")
    return rows.select("volume_id", *(c for c in ("z", "y", "x") if c in rows.columns), "v", *keep)


def correlate(values: Column, weights: Sequence[float], single: bool = True) -> Column:
    """sum of w[k] * values[clamp(i + k)], k ascending, rounded to float32 if ``single``."""
    r = len(weights) // 2
    last = F.size(values) - 1
    taps = F.array(*[F.struct(F.lit(k - r).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])

    def at(i: Column) -> Column:
        total = F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["w"] * F.get(values, F.least(F.greatest(i + t["k"], F.lit(0)), last)))
        return total.cast("float").cast("double") if single else total

    return F.transform(F.sequence(F.lit(0), last), at)


def convolve_axis(field: DataFrame, axis: str, weights: Sequence[float], single: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Correlation along an axis; columns in ``keep`` go along unchanged."""
    if len(weights) % 2 != 1:
        raise InvalidArgument("an axis kernel has an odd number of weights")
    if len(weights) == 1 and weights[0] == 1.0:
        return field
    return spread(lines(field, axis, keep).withColumn("vs", correlate(F.col("vs"), weights, single)), axis, keep)


def smooth(field: DataFrame, radius: int, kernel: Kernel) -> DataFrame:
    """Mean or Gaussian over a clamped cube of 2r + 1 voxels a side, axis by axis."""
    if not 0 <= radius <= 64:
        raise InvalidArgument("radius must be between 0 and 64")
    if radius == 0:
        return field
    weights = box_weights(radius, kernel == Kernel.GAUSSIAN)
    for axis in ("x", "y", "z"):
        field = convolve_axis(field, axis, weights, single=False)
    return field.withColumn("v", F.col("v").cast("float").cast("double"))


def local_level(field: DataFrame, radius: int, kernel: Kernel, axes: str, keep: Sequence[str] = ()) -> DataFrame:
    weights = line_weights(radius, kernel == Kernel.GAUSSIAN)
    for axis in axes:
        field = convolve_axis(field, axis, weights, keep=keep)
    return field


def adaptive_threshold(field: DataFrame, radius: int, kernel: Kernel, constant: float, axes: str = "xy") -> DataFrame:
    """MASK where v > local level - constant, else 0; axes "xy" (planar) or "xyz".

    A voxel's own value goes along the passes, so no join brings it back.
    """
    if not 0 <= radius <= 100:
        raise InvalidArgument("radius must be between 0 and 100")
    level = local_level(field.select("volume_id", "z", "y", "x", "v", F.col("v").alias("own")), radius, kernel, axes, ["own"])
    return level.select("volume_id", "z", "y", "x", F.when(F.col("own") > F.col("v") - float(constant), F.lit(MASK)).otherwise(F.lit(0.0)).alias("v"))


#: Up to this radius a framed window, which reads the whole frame for each row, is the cheaper way.
FRAME_RADIUS = 4


def extreme_axis(field: DataFrame, axis: str, radius: int, largest: bool, engine: str = "auto") -> DataFrame:
    """Maximum or minimum over 2r + 1 voxels of a line; beyond the ends there is nothing.

    Engine "frame" is a framed window.  Engine "scans", for larger radii, costs the
    same for all of them: a line is parted into blocks of 2r + 1, and any window is
    the end of one block and the beginning of the next, so it needs a running extreme
    in each direction.  Both, and the line they are read along, share one shuffle.
    """
    others, extreme = _others(axis), F.max if largest else F.min
    line = Window.partitionBy(*others)
    if engine == "frame" or (engine == "auto" and radius <= FRAME_RADIUS):
        return field.withColumn("v", extreme("v").over(line.orderBy(axis).rowsBetween(-radius, radius)))
    columns, width = field.columns, 2 * radius + 1
    placed = field.withColumn("_at", F.row_number().over(line.orderBy(axis)) - 1)
    blocks = placed.withColumn("_block", F.floor(F.col("_at") / width).cast("int"))
    block = Window.partitionBy(*others, "_block")
    running = (Window.unboundedPreceding, Window.currentRow)
    ends = blocks.withColumn("_to_end", extreme("v").over(block.orderBy(F.desc("_at")).rowsBetween(*running)))
    both = ends.withColumn("_from_start", extreme("v").over(block.orderBy("_at").rowsBetween(*running)))
    along = line.orderBy("_block", "_at")
    read = both.withColumns(
        {
            "_low": F.lag("_to_end", radius).over(along),
            "_high": F.lead("_from_start", radius).over(along),
            "_last": F.last(F.struct("_at", "_block", F.col("_from_start").alias("v"))).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    # beyond the line's end the last block counts as a whole, unless the window begins in it
    whole = F.when(F.floor((F.col("_at") - radius) / width) != F.col("_last._block"), F.col("_last.v"))
    high = F.when(F.col("_at") + radius <= F.col("_last._at"), F.col("_high")).otherwise(whole)
    return read.withColumn("v", (F.greatest if largest else F.least)("_low", high)).select(*columns)


#: A tile of samples has this many voxels a side, and one more it shares with the next.
SAMPLE_TILE = 8


def trilinear(field: DataFrame, grid: Grid, points: DataFrame) -> DataFrame:
    """points(volume_id, point_id, px, py, pz) with ``v``: the weighted sum of eight clamped corners.

    The field becomes one array per tile, which holds the first planes of the next
    tiles too, so a point finds all its corners in the tile of the lowest one: one
    join of points with tiles, where a hot tile's points can be split.  A missing
    voxel adds nothing; a point whose corners are all missing has no row.
    """
    side = SAMPLE_TILE
    extents = {"z": grid.depth, "y": grid.height, "x": grid.width}

    dealt = field.select("volume_id", "z", "y", "x", "v")
    for axis in extents:  # a voxel that begins a tile goes to the one before as well
        own = F.floor(F.col(axis) / side).cast("int")
        before = F.greatest(F.floor((F.col(axis) - 1) / side).cast("int"), F.lit(0))
        dealt = dealt.withColumn(f"t{axis}", F.explode(F.array_distinct(F.array(before, own))))

    def across(axis: str) -> Column:
        """What a tile has along an axis."""
        return F.least(F.lit(side + 1), F.lit(extents[axis]) - F.col(f"t{axis}") * side)

    def local(z: Column, y: Column, x: Column) -> Column:
        return ((z - F.col("tz") * side) * across("y") + y - F.col("ty") * side) * across("x") + x - F.col("tx") * side

    keys = ["volume_id", "tz", "ty", "tx"]
    spot = F.struct(local(F.col("z"), F.col("y"), F.col("x")).alias("i"), "v")
    tiles = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(spot)).alias("spots"))
    full = F.size("spots") == across("z") * across("y") * across("x")
    # places are kept only where voxels are missing
    tiles = tiles.select(*keys, F.transform("spots", lambda s: s["v"]).alias("vs"), F.when(~full, F.transform("spots", lambda s: s["i"])).alias("places"))

    def corner(name: str, axis: str) -> list[Column]:
        p = F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(float(extents[axis] - 1)))
        low = F.floor(p).cast("int")
        return [low.alias(f"{axis}0"), (p - low).alias(f"f{axis}"), F.floor(low / side).cast("int").alias(f"t{axis}")]

    asked = points.select("volume_id", "point_id", *corner("px", "x"), *corner("py", "y"), *corner("pz", "z"))
    met = asked.join(tiles, keys)

    def term(k: int) -> Column:
        ends, weight = {}, F.lit(1.0)
        for axis, bit in (("x", 1), ("y", 2), ("z", 4)):
            low, f = F.col(f"{axis}0"), F.col(f"f{axis}")
            ends[axis] = F.least(low + 1, F.lit(extents[axis] - 1)) if k & bit else low
            weight = weight * (f if k & bit else 1 - f)
        i = local(ends["z"], ends["y"], ends["x"])
        found = F.when(F.col("places").isNull(), F.get("vs", i)).otherwise(F.get("vs", F.array_position("places", i).cast("int") - 1))
        return weight * found

    terms = met.select("volume_id", "point_id", *[term(k).alias(f"c{k}") for k in range(8)])
    total = F.coalesce("c0", F.lit(0.0))
    for k in range(1, 8):
        total = total + F.coalesce(f"c{k}", F.lit(0.0))
    return terms.where(F.coalesce(*[f"c{k}" for k in range(8)]).isNotNull()).select("volume_id", "point_id", total.alias("v"))
