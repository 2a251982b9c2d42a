"""Agreement of two label volumes: overlap, objects, volumes and surface distance."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Grid, InvalidArgument
from .components import equal_components
from .envelope import min_plus

KEYS = ["volume_id", "z", "y", "x"]


@dataclass(frozen=True)
class Thresholds:
    dice: float = 0.995
    volume_difference: float = 0.005
    hausdorff95: float = 1.0

    def __post_init__(self):
        if not (0 <= self.dice <= 1 and self.volume_difference >= 0 and self.hausdorff95 >= 0):
            raise InvalidArgument("thresholds are out of range")


def overlap(reference: DataFrame, candidate: DataFrame, reference_background: int = 0, candidate_background: int = 0) -> DataFrame:
    """(volume_id, reference_count, candidate_count, common, dice, volume_difference)."""
    other = candidate.select(*KEYS, F.col("label").alias("other"))
    met = reference.join(other, KEYS, "full")
    a = F.coalesce(F.col("label") != reference_background, F.lit(False)).cast("long")
    b = F.coalesce(F.col("other") != candidate_background, F.lit(False)).cast("long")
    sums = met.groupBy("volume_id").agg(F.sum(a).alias("reference_count"), F.sum(b).alias("candidate_count"), F.sum(a * b).alias("common"))
    r, c = F.col("reference_count"), F.col("candidate_count")
    dice = F.when(r + c == 0, F.lit(1.0)).otherwise(2.0 * F.col("common") / F.when(r + c > 0, r + c))
    difference = F.when(r > 0, F.abs(c - r) / F.when(r > 0, r)).otherwise(F.when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return sums.withColumns({"dice": dice, "volume_difference": difference})


def object_count(labels: DataFrame, grid: Grid, connectivity: int = 26, background: int = 0) -> DataFrame:
    """(volume_id, objects): components of equal labels other than the background."""
    kept = labels.where(F.col("label") != background)
    return equal_components(kept, grid, connectivity).groupBy("volume_id").agg(F.count_distinct("root").alias("objects"))


def surface(labels: DataFrame, grid: Grid, background: int = 0) -> DataFrame:
    """Foreground voxels on the box or with a background face neighbour."""
    front = labels.where(F.col("label") != background).select(*KEYS)
    moves = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    near = front.select("volume_id", "z", "y", "x", F.explode(moves).alias("d")).select("volume_id", (F.col("z") + F.col("d.z")).alias("z"), (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"))
    faces = near.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("faces"))
    return front.join(faces, KEYS, "left").where(F.coalesce("faces", F.lit(0)) < 6).select(*KEYS)


def hausdorff95(reference: DataFrame, candidate: DataFrame, grid: Grid, reference_background: int = 0, candidate_background: int = 0) -> DataFrame:
    """(volume_id, hausdorff95) in voxels: 0 if both are empty, null if one is.

    The greater of the two nearest-rank 95th percentiles of the distances from
    one surface to the other.  The distances to both surfaces take the same
    three passes, in which marks of the surfaces go along.
    """
    far = F.lit(float("inf"))
    marks = reference.select(*KEYS, F.lit(False).alias("a"), F.lit(False).alias("b"))
    for mark, labels, background in (("a", reference, reference_background), ("b", candidate, candidate_background)):
        marks = marks.unionByName(surface(labels, grid, background).select(*KEYS, F.lit(mark == "a").alias("a"), F.lit(mark == "b").alias("b")))
    both = marks.groupBy(*KEYS).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    squares = both.select(*KEYS, F.when(F.col("a"), 0.0).otherwise(far).alias("v"), F.when(F.col("b"), 0.0).otherwise(far).alias("to_b"), "a", "b")
    for axis in ("x", "y", "z"):
        squares = min_plus(squares, axis, also=["to_b"], keep=["a", "b"])
    nearest = "percentile_disc(0.95) WITHIN GROUP (ORDER BY {0}) FILTER (WHERE {1})"
    found = squares.where("a OR b").groupBy("volume_id").agg(F.sqrt(F.expr(nearest.format("to_b", "a"))).alias("there"), F.sqrt(F.expr(nearest.format("v", "b"))).alias("back"))
    value = F.when(F.col("there").isNotNull() & F.col("back").isNotNull(), F.greatest("there", "back"))
    volumes = reference.select("volume_id").distinct()
    return volumes.join(found.select("volume_id", value.alias("d"), F.lit(True).alias("_any")), "volume_id", "left").select("volume_id", F.when(F.col("_any").isNull(), 0.0).otherwise(F.col("d")).alias("hausdorff95"))


def evaluate(reference: DataFrame, candidate: DataFrame, grid: Grid, *, reference_background: int = 0, candidate_background: int = 0, connectivity: int = 26, thresholds: Thresholds | None = None) -> DataFrame:
    """One row per volume with all metrics, calibrated volumes, ``passed`` and ``failures``."""
    t = thresholds or Thresholds()
    facts = overlap(reference, candidate, reference_background, candidate_background)
    for side, labels, background in (("reference", reference, reference_background), ("candidate", candidate, candidate_background)):
        facts = facts.join(object_count(labels, grid, connectivity, background).withColumnRenamed("objects", f"{side}_objects"), "volume_id", "left").fillna(0, [f"{side}_objects"])
    facts = facts.join(hausdorff95(reference, candidate, grid, reference_background, candidate_background), "volume_id")
    unit = math.prod(grid.spacing)
    failures = F.array_compact(
        F.array(
            F.when(F.col("dice") < t.dice, F.lit("dice")),
            F.when(F.col("reference_objects") != F.col("candidate_objects"), F.lit("object count")),
            F.when(F.col("volume_difference") > t.volume_difference, F.lit("volume difference")),
            F.when(F.col("hausdorff95").isNull(), F.lit("surface distance undefined")).when(F.col("hausdorff95") > t.hausdorff95, F.lit("surface distance")),
        )
    )
    return facts.withColumns(
        {"reference_volume": F.col("reference_count") * F.lit(unit), "candidate_volume": F.col("candidate_count") * F.lit(unit), "unit": F.lit(f"{grid.unit if grid.calibrated else 'voxel'}^3"), "failures": failures}
    ).withColumn("passed", F.size("failures") == 0)
