"""Editing of label volumes.

Every edit is a function of a label relation and a small list of selected ids;
``LabelSession`` keeps immutable snapshots for undo.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import BACKGROUND, Grid, InvalidArgument, InvalidState
from ..plans.durable import durable
from ..plans.progress import report
from .components import half_neighbours, label_components
from .morphology import ball

KEYS = ["volume_id", "z", "y", "x"]


def present(labels: DataFrame, ids: Iterable[int]) -> list[int]:
    """Those of ids that occur; absent and negative ones are left out."""
    wanted = sorted({i for i in ids if i >= 0})
    if not wanted:
        return []
    return sorted(r.label for r in labels.where(F.col("label").isin(wanted)).select("label").distinct().collect())


def label_at(labels: DataFrame, x: int, y: int, z: int) -> int | None:
    row = labels.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z) & (F.col("label") >= 0)).select("label").first()
    return None if row is None else row.label


def merge(labels: DataFrame, selected: list[int], into: int | None = None) -> DataFrame:
    if not selected:
        raise InvalidState("nothing is selected")
    into = min(selected) if into is None else into
    if into not in selected:
        raise InvalidArgument("the target of a merge must be selected")
    return labels.withColumn("label", F.when(F.col("label").isin(selected), F.lit(into)).otherwise(F.col("label")).cast("int"))


def split(labels: DataFrame, grid: Grid, selected: list[int], connectivity: int = 6) -> DataFrame:
    """The first component of each selected label keeps its id, the others get new ones in (label, scan) order."""
    rooted = durable(label_components(labels.where(F.col("label").isin(selected)), grid, connectivity), "split")
    parts = rooted.groupBy("volume_id", "label", "root").agg(F.count(F.lit(1)).alias("n"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("volume_id", "label").orderBy("root"))).where("rank > 1")
    top = labels.groupBy("volume_id").agg(F.max("label").alias("top"))
    fresh = ranked.join(top, "volume_id").withColumn("new", F.col("top") + F.row_number().over(Window.partitionBy("volume_id").orderBy("label", "root"))).select("volume_id", "label", "root", "new")
    moved = rooted.join(fresh, ["volume_id", "label", "root"]).select(*KEYS, "new")
    return labels.join(moved, KEYS, "left").select(*KEYS, F.coalesce("new", "label").cast("int").alias("label"))


def _near(rows: DataFrame, connectivity: int) -> DataFrame:
    """One row per voxel and neighbour position of it: the voxel's label as ``near``."""
    half = half_neighbours(connectivity)
    moves = F.array(*[F.struct(F.lit(s * a).alias("z"), F.lit(s * b).alias("y"), F.lit(s * c).alias("x")) for a, b, c in half for s in (1, -1)])
    out = rows.select("volume_id", "z", "y", "x", F.col("label").alias("near"), F.explode(moves).alias("d"))
    return out.select("volume_id", (F.col("z") + F.col("d.z")).alias("z"), (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"), "near")


def _iterations(n: int) -> None:
    if not 1 <= n <= 64:
        raise InvalidArgument("iterations are 1 to 64")


def dilate(labels: DataFrame, selected: list[int], iterations: int = 1, connectivity: int = 6) -> DataFrame:
    """Background voxels take the least selected label beside them, all at once."""
    _iterations(iterations)
    for done in range(iterations):
        least = _near(labels.where(F.col("label").isin(selected)), connectivity).groupBy(*KEYS).agg(F.min("near").alias("near"))
        labels = labels.join(least, KEYS, "left").select(*KEYS, F.when(F.col("label") < 0, F.coalesce("near", "label")).otherwise(F.col("label")).cast("int").alias("label"))
        labels = durable(labels, "labels") if iterations > 1 else labels
        report("dilate", done + 1, iterations)
    return labels


def erode(labels: DataFrame, selected: list[int], iterations: int = 1, connectivity: int = 6) -> DataFrame:
    """Selected voxels with a neighbour outside the volume or of another label become background."""
    _iterations(iterations)
    for done in range(iterations):
        chosen = labels.where(F.col("label").isin(selected))
        same = _near(chosen, connectivity).join(chosen, KEYS).where("near = label").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("same"))
        edge = F.col("label").isin(selected) & (F.coalesce("same", F.lit(0)) < connectivity)
        labels = labels.join(same, KEYS, "left").select(*KEYS, F.when(edge, F.lit(BACKGROUND)).otherwise(F.col("label")).cast("int").alias("label"))
        labels = durable(labels, "labels") if iterations > 1 else labels
        report("erode", done + 1, iterations)
    return labels


def ball_dilate(labels: DataFrame, grid: Grid, selected: list[int], radius: int) -> DataFrame:
    """Background voxels within a ball of a selected label take the least such label."""
    if not selected:
        raise InvalidState("nothing is selected")
    # ids from the least up, far ones for what isn't selected
    far = float(2**31)
    field = labels.select(*KEYS, F.when(F.col("label").isin(selected), F.col("label").cast("double")).otherwise(F.lit(far)).alias("v"))
    least = ball(field, grid, radius, False).select(*KEYS, F.col("v").alias("near"))
    taken = (F.col("label") < 0) & (F.col("near") < far)
    return labels.join(least, KEYS).select(*KEYS, F.when(taken, F.col("near")).otherwise(F.col("label")).cast("int").alias("label"))


def ball_erode(labels: DataFrame, grid: Grid, selected: list[int], radius: int) -> DataFrame:
    """Selected voxels with another label, or background, within a ball become background; the volume's edge doesn't count."""
    if not selected:
        raise InvalidState("nothing is selected")
    field = labels.select(*KEYS, F.col("label").cast("double").alias("v"))
    low = ball(field, grid, radius, False).select(*KEYS, F.col("v").alias("low"))
    high = ball(field, grid, radius, True).select(*KEYS, F.col("v").alias("high"))
    edge = F.col("label").isin(selected) & (F.col("low") != F.col("high"))
    return labels.join(low, KEYS).join(high, KEYS).select(*KEYS, F.when(edge, F.lit(BACKGROUND)).otherwise(F.col("label")).cast("int").alias("label"))


def copy_segments(labels: DataFrame, grid: Grid, selected: list[int], offset: tuple[int, int, int]) -> DataFrame:
    """Selected labels stay and are written again, moved by (dx, dy, dz), over what is there; what leaves the grid is cut off."""
    moved = labels.where(F.col("label").isin(selected)).select("volume_id", *((F.col(a) + d).cast("int").alias(a) for a, d in zip("zyx", reversed(offset), strict=True)), F.col("label").alias("copy"))
    return labels.join(moved, KEYS, "left").select(*KEYS, F.coalesce("copy", "label").alias("label"))


def bounding_box(labels: DataFrame, selected: list[int]) -> DataFrame:
    chosen = labels.where(F.col("label").isin(selected))
    return chosen.groupBy("volume_id").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def crop_to_selection(labels: DataFrame, grid: Grid, selected: list[int]) -> tuple[DataFrame, Grid, tuple[int, int, int]]:
    """The selection's box as a volume of its own (others are background), its grid and origin.

    All volumes are cropped to the common box, so that they keep one grid.
    """
    box = labels.where(F.col("label").isin(selected)).agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lox"] is None:
        raise InvalidState("nothing is selected")
    origin = (box["lox"], box["loy"], box["loz"])
    inside = labels.where(F.col("x").between(box["lox"], box["hix"]) & F.col("y").between(box["loy"], box["hiy"]) & F.col("z").between(box["loz"], box["hiz"]))
    moved = inside.select("volume_id", *((F.col(a) - o).cast("int").alias(a) for a, o in zip("zyx", reversed(origin), strict=True)), F.when(F.col("label").isin(selected), F.col("label")).otherwise(F.lit(BACKGROUND)).alias("label"))
    return moved, grid.resized(width=box["hix"] - origin[0] + 1, height=box["hiy"] - origin[1] + 1, depth=box["hiz"] - origin[2] + 1), origin


def select_by_mean(labels: DataFrame, field: DataFrame, level: float) -> DataFrame:
    """(volume_id, label) of labels whose mean of v is at least level."""
    return labels.where("label >= 0").join(field, KEYS).groupBy("volume_id", "label").agg(F.avg("v").alias("mean")).where(F.col("mean") >= float(level)).select("volume_id", "label")


def render_labels(labels: DataFrame, selected: list[int]) -> DataFrame:
    """(…, red, green, blue) 0..255: a colour from the id, one for the selection, black for background."""
    # Start and step of each colour by id, and the colour of the selection.
    colours = {"red": (53, 97, 255), "green": (151, 57, 218), "blue": (211, 31, 74)}

    def channel(start: int, step: int, chosen: int):
        own = F.pmod(F.lit(start) + F.col("label") * step, F.lit(256))
        return F.when(F.col("label") < 0, F.lit(0)).when(F.col("label").isin(selected or [-2]), F.lit(chosen)).otherwise(own).cast("int")

    return labels.withColumns({name: channel(*parts) for name, parts in colours.items()})


class LabelSession:
    """A label volume under edit: a selection, edits, and an undo stack of ``DEPTH`` snapshots."""

    DEPTH = 32

    def __init__(self, labels: DataFrame, grid: Grid):
        self.labels, self.grid, self.selection, self.origin = labels, grid, [], (0, 0, 0)
        self.history: list[str] = []
        self._undo: list[tuple] = []

    def select(self, ids: Iterable[int], replace: bool = True) -> list[int]:
        found = present(self.labels, ids)
        self.selection = found if replace else sorted({*self.selection, *found})
        return self.selection

    def select_at(self, x: int, y: int, z: int) -> list[int]:
        found = label_at(self.labels, x, y, z)
        return self.selection if found is None else self.select([found])

    def clear_selection(self) -> None:
        self.selection = []

    def _need(self) -> list[int]:
        if not self.selection:
            raise InvalidState("nothing is selected")
        return self.selection

    def _push(self, name: str, labels: DataFrame) -> None:
        self._undo = [*self._undo, (self.labels, self.grid, list(self.selection), self.origin)][-self.DEPTH :]
        self.labels = durable(labels, "labels")
        self.history.append(name)

    def merge(self, into: int | None = None) -> None:
        chosen = self._need()
        self._push("merge", merge(self.labels, chosen, into))
        self.selection = [min(chosen) if into is None else into]

    def split(self, connectivity: int = 6) -> int:
        before = self.labels.where("label >= 0").select("label").distinct().count()
        self._push("split", split(self.labels, self.grid, self._need(), connectivity))
        return self.labels.where("label >= 0").select("label").distinct().count() - before

    def dilate(self, iterations: int = 1, connectivity: int = 6) -> None:
        self._push("dilate", dilate(self.labels, self._need(), iterations, connectivity))

    def erode(self, iterations: int = 1, connectivity: int = 6) -> None:
        self._push("erode", erode(self.labels, self._need(), iterations, connectivity))
        self.selection = present(self.labels, self.selection)

    def crop(self) -> tuple[int, int, int]:
        labels, grid, origin = crop_to_selection(self.labels, self.grid, self._need())
        self._push("crop", labels)
        self.grid, self.origin = grid, tuple(a + b for a, b in zip(self.origin, origin, strict=True))
        return origin

    def replace(self, labels: DataFrame) -> None:
        if labels.where("label < -1").limit(1).count() or labels.count() != self.labels.count():
            raise InvalidArgument("new labels need the same size and ids of -1 or more")
        self._push("replace", labels)
        self.selection = present(self.labels, self.selection)

    def undo(self) -> bool:
        if not self._undo:
            return False
        self.labels, self.grid, self.selection, self.origin = self._undo.pop()
        self.history.append("undo")
        return True
