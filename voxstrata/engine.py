"""The engine's front door: a volume, its state, and a closed set of operations.

``Engine`` holds immutable state (a collection, a crop, labels and a selection);
``run`` builds a plan and returns it with what it is.  State is replaced whole
or not at all: a failing setter or operation leaves the last valid state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import weights
from .model import Cancelled, Crop, Grid, InvalidArgument, InvalidState, Kernel, validate_volume
from .operators import components, directional, morphology, pointwise, resample, segmentation, stencil, surface
from .plans.progress import Callback, listening


class Operation(IntEnum):
    # Operation numbers that stored requests use.
    COPY = 0
    WINDOW_LEVEL = 1
    THRESHOLD_2D = 2
    THRESHOLD_3D = 3
    SMOOTH_MEAN = 4
    SMOOTH_GAUSSIAN = 5
    DILATE_CUBE = 6
    ERODE_CUBE = 7
    DILATE_SPHERE = 8
    ERODE_SPHERE = 9
    CONNECTED_COMPONENTS = 10
    HEIGHT_MAP = 11
    DEPTH_MAP = 12
    RESAMPLE_AREA = 13
    RESAMPLE_LANCZOS = 14
    EXTRACT_XY = 15
    EXTRACT_YZ = 16
    EXTRACT_ZX = 17
    THRESHOLD_SWEEP = 18
    DIRECTIONAL_THRESHOLD = 19
    DIRECTIONAL_SEGMENTATION = 20
    ADAPTIVE_2D = 21
    ADAPTIVE_3D = 22
    H_MINIMA = 23
    WATERSHED = 24
    HEIGHT_PROJECTION = 25


class Output(IntEnum):
    VOLUME = 1
    LABELS = 2
    IMAGE = 3


@dataclass(frozen=True)
class Result:
    data: DataFrame
    kind: Output
    grid: Grid

    def component_count(self) -> DataFrame:
        """(volume_id, components) of a label result."""
        if self.kind != Output.LABELS:
            raise InvalidState("only labels have components")
        return self.data.where("label >= 0").groupBy("volume_id").agg(F.count_distinct("label").alias("components"))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._volume: DataFrame | None = None
        self._grid: Grid | None = None
        self._crop: Crop | None = None
        self._labels: DataFrame | None = None
        self._selection: list[int] = []

    def set_volume(self, collection: DataFrame, grid: Grid, validate: bool = True) -> None:
        """A collection (volume_id, c, z, y, x, v); clears crop, labels and selection."""
        missing = {"volume_id", "c", "z", "y", "x", "v"} - set(collection.columns)
        if missing:
            raise InvalidArgument(f"the collection lacks {sorted(missing)}")
        if validate:
            validate_volume(pointwise.select_channel(collection, grid.selected_channel), grid)
        self._volume, self._grid, self._crop, self._labels, self._selection = collection, grid, None, None, []

    def set_crop(self, crop: Crop | None) -> None:
        self._crop = crop

    def set_labels(self, labels: DataFrame, selection: Iterable[int]) -> None:
        chosen = sorted(set(selection))
        segmentation.require_labels(labels)
        found = {r.label for r in labels.where(F.col("label").isin(chosen or [-2])).select("label").distinct().collect()}
        if set(chosen) - found:
            raise InvalidArgument("a selected label isn't in the volume")
        self._labels, self._selection = labels, chosen

    @property
    def grid(self) -> Grid:
        if self._grid is None:
            raise InvalidState("no volume is set")
        return self._grid

    def field(self) -> DataFrame:
        grid = self.grid
        return pointwise.select_channel(self._volume, grid.selected_channel)

    def estimate(self, *, radius: int, level: int, low: float | None = None, high: float | None = None, step: float | None = None) -> dict:
        schedule = None if low is None else weights.ascending_schedule(low, high, step)
        g = self.grid
        return weights.estimate(g.width, g.height, g.depth, radius, level, schedule)

    def backend(self) -> dict:
        context = self.spark.sparkContext
        return {"name": "spark", "version": self.spark.version, "master": context.master, "parallelism": context.defaultParallelism}

    def run(self, operation: Operation, progress: Callback | None = None, **parameters) -> Result:
        """The operation's plan.  Operators that run in rounds report them to ``progress``, which can end them (``plans.progress``)."""
        try:
            make = _FORMS[Operation(operation)]
        except ValueError as error:
            raise InvalidArgument(f"no operation {operation}") from error
        with listening(progress):
            return make(self, self.field(), self.grid, parameters)

    @contextmanager
    def cancellable(self, tag: str):
        """Jobs started inside can be ended from another thread by ``cancel(tag)``."""
        self.spark.addTag(tag)
        try:
            yield
        except Exception as error:
            if "cancelled" in str(error).lower():
                raise Cancelled(tag) from error
            raise
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)


def _volume(f: Callable) -> Callable:
    return lambda engine, field, grid, p: Result(f(field, grid, **p), Output.VOLUME, grid)


def _labels(f: Callable) -> Callable:
    return lambda engine, field, grid, p: Result(f(field, grid, **({"crop": engine._crop} if f is not _components else {}), **p), Output.LABELS, grid)


def _components(field: DataFrame, grid: Grid, *, threshold: float = 0.5, connectivity: int = 6, minimum_size: int = 1) -> DataFrame:
    return components.connected(field, grid, threshold, connectivity, minimum_size)


def _image(f: Callable, shape: Callable[[Grid], dict]) -> Callable:
    return lambda engine, field, grid, p: Result(f(field, grid, **p), Output.IMAGE, grid.resized(depth=1, **shape(grid)))


def _resample(order: bool) -> Callable:
    def make(engine: Engine, field: DataFrame, grid: Grid, p: dict) -> Result:
        data, finer = resample.resample_z(field, grid, p["target_spacing"], p.get("order", 3) if order else None)
        return Result(data, Output.VOLUME, finer)

    return make


def _watershed(engine: Engine, field: DataFrame, grid: Grid, p: dict) -> Result:
    if engine._labels is None or not engine._selection:
        raise InvalidState("a watershed needs labels and a selection")
    chosen = engine._labels.where(F.col("label").isin(engine._selection)).select("volume_id", "label").distinct()
    return Result(segmentation.watershed(field, engine._labels, grid, chosen, least_seed=p.get("minimum_seed_size", 0), crop=engine._crop), Output.LABELS, grid)


def _plain(_: Grid) -> dict:
    return {}


_FORMS: dict[Operation, Callable[[Engine, DataFrame, Grid, dict], Result]] = {
    Operation.COPY: _volume(lambda f, g: pointwise.copy(f)),
    Operation.WINDOW_LEVEL: _volume(lambda f, g, low=0.0, high=1.0: pointwise.window_level(f, low, high)),
    Operation.THRESHOLD_2D: _volume(lambda f, g, threshold=0.5: pointwise.threshold_2d(f, threshold)),
    Operation.THRESHOLD_3D: _volume(lambda f, g, threshold=0.5: pointwise.threshold_3d(f, threshold)),
    Operation.SMOOTH_MEAN: _volume(lambda f, g, radius=1: stencil.smooth(f, radius, Kernel.MEAN)),
    Operation.SMOOTH_GAUSSIAN: _volume(lambda f, g, radius=1: stencil.smooth(f, radius, Kernel.GAUSSIAN)),
    Operation.DILATE_CUBE: _volume(lambda f, g, radius=1: morphology.cube(f, radius, True)),
    Operation.ERODE_CUBE: _volume(lambda f, g, radius=1: morphology.cube(f, radius, False)),
    Operation.DILATE_SPHERE: _volume(lambda f, g, radius=1: morphology.ball(f, g, radius, True)),
    Operation.ERODE_SPHERE: _volume(lambda f, g, radius=1: morphology.ball(f, g, radius, False)),
    Operation.CONNECTED_COMPONENTS: _labels(_components),
    Operation.HEIGHT_MAP: _image(surface.height_map, _plain),
    Operation.DEPTH_MAP: _volume(surface.depth_map),
    Operation.RESAMPLE_AREA: _resample(False),
    Operation.RESAMPLE_LANCZOS: _resample(True),
    Operation.EXTRACT_XY: _image(lambda f, g, index: resample.extract_xy(f, g, index), _plain),
    Operation.EXTRACT_YZ: _image(lambda f, g, index: resample.extract_yz(f, g, index), lambda g: {"width": g.depth}),
    Operation.EXTRACT_ZX: _image(lambda f, g, index: resample.extract_zx(f, g, index), lambda g: {"height": g.depth}),
    Operation.THRESHOLD_SWEEP: _labels(segmentation.threshold_sweep),
    Operation.DIRECTIONAL_THRESHOLD: _volume(directional.directional_threshold),
    Operation.DIRECTIONAL_SEGMENTATION: _labels(segmentation.directional_segmentation),
    Operation.ADAPTIVE_2D: _volume(lambda f, g, radius=1, kernel=Kernel.GAUSSIAN, constant=0.0: stencil.adaptive_threshold(f, radius, kernel, constant, "xy")),
    Operation.ADAPTIVE_3D: _volume(lambda f, g, radius=1, kernel=Kernel.GAUSSIAN, constant=0.0: stencil.adaptive_threshold(f, radius, kernel, constant, "xyz")),
    Operation.H_MINIMA: _volume(lambda f, g, h=0.1, check_interval=50: segmentation.h_minima(f, g, h, check_interval)),
    Operation.WATERSHED: _watershed,
    Operation.HEIGHT_PROJECTION: _image(surface.height_projection, _plain),
}
