"""Pointwise operators: projections and filters on voxels.  No shuffle, except for the joins named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FULL, Crop, Grid, InvalidArgument


def select_channel(collection: DataFrame, channel: int) -> DataFrame:
    """One channel as a field; prunes partitions of tables written by channel."""
    return collection.where(F.col("c") == channel).drop("c")


def copy(field: DataFrame) -> DataFrame:
    return field.select("volume_id", "z", "y", "x", "v")


def window_level(field: DataFrame, low: float, high: float) -> DataFrame:
    """(v - low) / (high - low), clamped to 0..1; NaN stays NaN."""
    if not high > low:
        raise InvalidArgument("the window's maximum must be above its minimum")
    scaled = (F.col("v") - F.lit(float(low))) * F.lit(1.0 / (high - low))
    return field.withColumn("v", F.when(F.isnan("v"), F.col("v")).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))))


def threshold(field: DataFrame, level: float, full: float = FULL) -> DataFrame:
    """full where v >= level, else 0; NaN gives 0.  The planar and the volume form are one."""
    return field.withColumn("v", F.when((F.col("v") >= float(level)) & ~F.isnan("v"), F.lit(full)).otherwise(F.lit(0.0)))


threshold_2d = threshold
threshold_3d = threshold


def outside_crop(grid: Grid, crop: Crop, surface: Column | None = None) -> Column:
    b = crop.border_xy
    if b >= grid.width or b >= grid.height:
        return F.lit(True)
    border = (F.col("x") < b) | (F.col("x") >= grid.width - b) | (F.col("y") < b) | (F.col("y") >= grid.height - b)
    upper, lower = (F.lit(crop.upper), F.lit(crop.lower)) if surface is None else (surface + crop.upper, surface + crop.lower)
    return border | (F.col("z") < upper) | (F.col("z") > lower)


def crop_mask(field: DataFrame, grid: Grid, crop: Crop | None, outside: float) -> DataFrame:
    """v is ``outside`` out of the crop.  A height map is joined on its (volume_id, y, x)."""
    if crop is None:
        return field
    if crop.height_map is None:
        return field.withColumn("v", F.when(outside_crop(grid, crop), F.lit(float(outside))).otherwise(F.col("v")))
    surface = crop.height_map.select("volume_id", "y", "x", F.col("v").cast("float").cast("double").alias("_h"))
    joined = field.join(surface, ["volume_id", "y", "x"])
    value = F.when(outside_crop(grid, crop, F.col("_h")), F.lit(float(outside))).otherwise(F.col("v"))
    return joined.select("volume_id", "z", "y", "x", value.alias("v"))


def exclude_labelled(field: DataFrame, labels: DataFrame, value: float = 0.0) -> DataFrame:
    """v is ``value`` where a voxel has a label >= 0."""
    marked = labels.where("label >= 0").select("volume_id", "z", "y", "x", F.lit(True).alias("_m"))
    return field.join(marked, ["volume_id", "z", "y", "x"], "left").select("volume_id", "z", "y", "x", F.when(F.col("_m"), F.lit(value)).otherwise(F.col("v")).alias("v"))


def normalise_channels(collection: DataFrame) -> DataFrame:
    """Each channel divided by its greatest |v|; a channel of zeros stays.

    The maxima are aggregated before they are joined back, so a huge channel
    isn't brought into one task as a window over it would do.
    """
    peaks = collection.groupBy("volume_id", "c").agg(F.max(F.abs("v")).alias("_m"))
    return collection.join(peaks, ["volume_id", "c"]).withColumn("v", F.when(F.col("_m") > 0, F.col("v") / F.col("_m")).otherwise(F.col("v"))).select("volume_id", "c", "z", "y", "x", "v")


def non_finite(field: DataFrame) -> DataFrame:
    """(volume_id, n_nan, n_infinite): zero for a volume that may be loaded."""
    return field.groupBy("volume_id").agg(F.sum(F.isnan("v").cast("long")).alias("n_nan"), F.sum((F.abs("v") == float("inf")).cast("long")).alias("n_infinite"))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Voxel by voxel: or, and, add, subtract, divide, least, greatest, differs (1 or 0)."""
    x, y = F.col("v"), F.col("_w")
    forms = {
        "or": F.when((x > 0) | (y > 0), F.greatest(x, y)).otherwise(F.lit(0.0)),
        "and": F.when((x > 0) & (y > 0), F.greatest(x, y)).otherwise(F.lit(0.0)),
        "add": x + y,
        "subtract": x - y,
        "divide": F.when(y != 0, x / y).otherwise(F.lit(0.0)),
        "least": F.least(x, y),
        "greatest": F.greatest(x, y),
        "differs": F.when(x != y, F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    if how not in forms:
        raise InvalidArgument(f"no way to combine: {how}")
    other = b.select("volume_id", "z", "y", "x", F.col("v").alias("_w"))
    return a.join(other, ["volume_id", "z", "y", "x"]).select("volume_id", "z", "y", "x", forms[how].alias("v"))


def in_box(lo: tuple[int, int, int], hi: tuple[int, int, int]) -> Column:
    """Inside an (x, y, z) box with inclusive ends."""
    return F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1]) & F.col("z").between(lo[2], hi[2])


def fill(field: DataFrame, value: float, where: Column | None = None) -> DataFrame:
    return field.withColumn("v", F.lit(float(value)) if where is None else F.when(where, F.lit(float(value))).otherwise(F.col("v")))


def add_scalar(field: DataFrame, value: float) -> DataFrame:
    return field.withColumn("v", F.col("v") + float(value))


def floor_to(field: DataFrame, value: float) -> DataFrame:
    return field.withColumn("v", F.greatest("v", F.lit(float(value))))


def invert(field: DataFrame, top: float = 1.0) -> DataFrame:
    return field.withColumn("v", F.lit(float(top)) - F.col("v"))


def sub_volume(field: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """The box as a volume of its own, with its corner at the origin."""
    return field.where(in_box(lo, hi)).withColumns({"x": F.col("x") - lo[0], "y": F.col("y") - lo[1], "z": F.col("z") - lo[2]})


def intensity_profile(field: DataFrame, axis: str, **at: int) -> DataFrame:
    """v along an axis through a point given by the two other coordinates."""
    picked = field
    for name, value in at.items():
        picked = picked.where(F.col(name) == value)
    return picked.select("volume_id", F.col(axis).alias("position"), "v")


def render_plane(image: DataFrame, low: float, high: float) -> DataFrame:
    """A byte 0..255 for each pixel: (v - low) / (high - low) with a least width of 1e-6."""
    width = max(1e-6, float(high) - float(low))
    unit = F.least(F.greatest((F.col("v") - F.lit(float(low))) / F.lit(width), F.lit(0.0)), F.lit(1.0))
    return image.withColumn("v", F.round(unit * 255).cast("int"))


def overwrite(field: DataFrame, mask: DataFrame, value: float) -> DataFrame:
    """value where the mask isn't 0."""
    keys = ["volume_id", "z", "y", "x"]
    marks = mask.select(*keys, F.col("v").alias("_m"))
    return field.join(marks, keys, "left").withColumn("v", F.when(F.col("_m") != 0, F.lit(float(value))).otherwise(F.col("v"))).drop("_m")
