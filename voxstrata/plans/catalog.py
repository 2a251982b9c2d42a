"""Named queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import weights as W
from ..model import MASK, Crop, Grid, Kernel, Projection
from ..operators import components, directional, labels, metrics, morphology, pointwise, resample, segmentation, stencil, surface
from ..sources import adapters, packages, synthetic, tiff
from .durable import durable

G = adapters.LINEITEM_GRID
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.lineitem_volume(spark, sf_dir)


def middle(field: DataFrame) -> float:
    """A threshold that follows the data: the mean, rounded up."""
    return float(field.agg(F.ceil(F.avg("v"))).first()[0])


def out(df: DataFrame, digits: int | None = None) -> DataFrame:
    value = F.col("v") if digits is None else F.round("v", digits)
    return df.select(*(c for c in ("c", "z", "y", "x") if c in df.columns), value.alias("v"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label volume: ten columns of x per label where the count is at least the mean."""
    field = volume(spark, sf_dir)
    return field.select("volume_id", "z", "y", "x", F.when(F.col("v") >= middle(field), F.floor(F.col("x") / 10)).otherwise(-1).cast("int").alias("label"))


def show(label_volume: DataFrame) -> DataFrame:
    return label_volume.select("z", "y", "x", "label")


# pointwise


@query
def copy_channel(spark, sf_dir):
    return out(pointwise.copy(volume(spark, sf_dir)))


@query
def select_channel(spark, sf_dir):
    return out(pointwise.select_channel(adapters.event_volume(spark, sf_dir), 2))


@query
def embedding_plane(spark, sf_dir):
    return out(resample.extract_xy(adapters.embedding_volume(spark, sf_dir), Grid(64, 25, 20), 3), 6)


@query
def window_level(spark, sf_dir):
    field = volume(spark, sf_dir)
    return out(pointwise.window_level(field, 1.0, 1.0 + middle(field)), 6)


@query
def threshold_2d(spark, sf_dir):
    field = volume(spark, sf_dir)
    return out(pointwise.threshold_2d(field, middle(field)))


@query
def threshold_3d(spark, sf_dir):
    """Foreground per plane: the first end-to-end query."""
    field = volume(spark, sf_dir)
    return pointwise.threshold_3d(field, middle(field)).groupBy("z").agg(F.sum("v").alias("foreground"), F.count(F.lit(1)).alias("voxels"))


@query
def crop_absolute(spark, sf_dir):
    return out(pointwise.crop_mask(volume(spark, sf_dir), G, Crop(1, 4, 2), 0.0))


@query
def crop_to_surface(spark, sf_dir):
    field = volume(spark, sf_dir)
    surface_image = field.where("z = 0").select("volume_id", "y", "x", (F.col("v") % 3 + 0.5).alias("v"))
    return out(pointwise.crop_mask(field, G, Crop(-1, 2, 0, surface_image), -1.0))


@query
def exclude_labelled(spark, sf_dir):
    return out(pointwise.exclude_labelled(volume(spark, sf_dir), columns(spark, sf_dir)))


@query
def normalise_channels(spark, sf_dir):
    return out(pointwise.normalise_channels(adapters.event_volume(spark, sf_dir)), 6)


@query
def finite_check(spark, sf_dir):
    return pointwise.non_finite(volume(spark, sf_dir)).select("n_nan", "n_infinite")


@query
def combine_masks(spark, sf_dir):
    field = volume(spark, sf_dir)
    a, b = pointwise.threshold(field, middle(field)), pointwise.threshold(field, middle(field) + 1)
    parts = [pointwise.combine(a, b, how).select("z", "y", "x", F.lit(how).alias("how"), "v") for how in ("or", "and", "differs", "subtract")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query
def elementwise_arithmetic(spark, sf_dir):
    field = volume(spark, sf_dir)
    filled = pointwise.fill(field, 9.0, pointwise.in_box((5, 2, 1), (20, 6, 3)))
    return out(pointwise.invert(pointwise.floor_to(pointwise.add_scalar(filled, -2.0), 0.0), 100.0))


@query
def sub_volume(spark, sf_dir):
    return out(pointwise.sub_volume(volume(spark, sf_dir), (10, 2, 1), (29, 8, 5)))


@query
def intensity_profile(spark, sf_dir):
    return pointwise.intensity_profile(volume(spark, sf_dir), "x", y=5, z=3).select("position", "v")


@query
def render_plane(spark, sf_dir):
    field = volume(spark, sf_dir)
    return pointwise.render_plane(resample.extract_xy(field, G, 2), 0.0, 2 * middle(field)).select("y", "x", "v")


# neighbourhoods


@query
def smooth_mean(spark, sf_dir):
    return out(stencil.smooth(volume(spark, sf_dir), 1, Kernel.MEAN), 3)


@query
def smooth_gaussian(spark, sf_dir):
    return out(stencil.smooth(volume(spark, sf_dir), 2, Kernel.GAUSSIAN), 3)


@query
def convolve_axis(spark, sf_dir):
    return out(stencil.convolve_axis(volume(spark, sf_dir), "x", W.line_weights(3, True)), 4)


@query
def dilate_cube(spark, sf_dir):
    return out(morphology.cube(volume(spark, sf_dir), 2, True))


@query
def erode_cube(spark, sf_dir):
    return out(morphology.cube(volume(spark, sf_dir), 1, False))


@query
def dilate_cube_wide(spark, sf_dir):
    return out(morphology.cube(volume(spark, sf_dir), 5, True))


@query
def erode_cube_wide(spark, sf_dir):
    return out(morphology.cube(volume(spark, sf_dir), 7, False))


@query
def dilate_sphere(spark, sf_dir):
    return out(morphology.ball(volume(spark, sf_dir), G, 2, True))


@query
def erode_sphere(spark, sf_dir):
    return out(morphology.ball(volume(spark, sf_dir), G, 2, False))


@query
def spherical_closing(spark, sf_dir):
    return out(morphology.closing(volume(spark, sf_dir), G, 1))


@query
def chunked_opening(spark, sf_dir):
    return out(morphology.chunked(volume(spark, sf_dir), G, 1, True))


@query
def minimum_axis(spark, sf_dir):
    return out(stencil.extreme_axis(volume(spark, sf_dir), "y", 1, False))


@query
def adaptive_threshold_2d(spark, sf_dir):
    return out(stencil.adaptive_threshold(volume(spark, sf_dir), 1, Kernel.MEAN, 0.5, "xy"))


@query
def adaptive_threshold_3d(spark, sf_dir):
    return out(stencil.adaptive_threshold(volume(spark, sf_dir), 1, Kernel.MEAN, 0.5, "xyz"))


@query
def trilinear_samples(spark, sf_dir):
    field = volume(spark, sf_dir)
    points = field.where("z = 2").select("volume_id", G.index().alias("point_id"), (F.col("x") + 0.75).alias("px"), (F.col("y") - 0.25).alias("py"), (F.col("z") + F.col("x") / 16.0).alias("pz"))
    return stencil.trilinear(field, G, points).select("point_id", F.round("v", 6).alias("v"))


@query
def h_minima(spark, sf_dir):
    scaled = volume(spark, sf_dir).withColumn("v", F.col("v") / 256)
    return out(segmentation.h_minima(scaled, G, 6 / 256))


# directional family


@query
def direction_counts(spark, sf_dir):
    return spark.createDataFrame([(level, len(W.directions(level))) for level in (1, 2, 3)], "level int, n long")


@query
def line_weights(spark, sf_dir):
    rows = [(r, k, round(w, 6)) for r in (0, 1, 2, 14) for k, w in enumerate(W.line_weights(r, True))]
    return spark.createDataFrame(rows, "radius int, k int, w double")


@query
def pass_schedule(spark, sf_dir):
    return spark.createDataFrame([(i, c) for i, c in enumerate(W.ascending_schedule(0.0, 1.0, 0.25))], "i int, c double")


@query
def sweep_schedule(spark, sf_dir):
    return spark.createDataFrame([(i, c) for i, c in enumerate(W.descending_schedule(0.5, 3.0, 0.75))], "i int, c double")


@query
def work_estimate(spark, sf_dir):
    work = W.estimate(G.width, G.height, G.depth, 4, 2)
    return spark.createDataFrame([tuple(work[k] for k in ("voxels", "directions", "line_samples", "work_items", "host_bytes", "passes"))], "voxels long, directions long, line_samples long, work_items long, host_bytes long, passes long")


@query
def directional_threshold(spark, sf_dir):
    return out(directional.directional_threshold(volume(spark, sf_dir), G, radius=1, level=1, kernel=Kernel.MEAN, constant=0.4, z_factor=0.5))


@query
def directional_response(spark, sf_dir):
    found = directional.response(volume(spark, sf_dir), G, 1, 1, Kernel.MEAN)
    return found.select("z", "y", "x", F.round("least", 2).alias("least"))


@query
def directional_segmentation(spark, sf_dir):
    field = volume(spark, sf_dir)
    found = segmentation.directional_segmentation(field, G, radius=2, level=1, kernel=Kernel.MEAN, low=-4.0, high=0.0, step=2.0, closing=1, min_size=3, min_invalid_area=50.0)
    return found.select("z", "y", "x", "label", "passes")


@query
def threshold_sweep(spark, sf_dir):
    field = volume(spark, sf_dir)
    t = middle(field)
    return segmentation.threshold_sweep(field, G, t - 1, t + 1, 1.0, closing=1, min_size=3, min_invalid_area=20.0).select("z", "y", "x", "label", "passes")


@query
def threshold_sweep_final(spark, sf_dir):
    """A sweep of one pass, which takes every component."""
    field = volume(spark, sf_dir)
    t = middle(field)
    return show(segmentation.threshold_sweep(field, G, t - 1, t - 1, 1.0, closing=1, min_size=1, min_invalid_area=0.0, crop=Crop(1, 5, 1)))


@query
def directional_segmentation_final(spark, sf_dir):
    field = volume(spark, sf_dir)
    return show(segmentation.directional_segmentation(field, G, radius=1, level=1, kernel=Kernel.MEAN, low=0.4, high=0.4, step=1.0, z_factor=0.5, closing=0, min_size=2))


@query
def wall_thickness(spark, sf_dir):
    field = volume(spark, sf_dir)
    return segmentation.wall_thickness(pointwise.threshold(field, middle(field)), G).select("thickness")


# components and watershed


@query
def components_6(spark, sf_dir):
    field = volume(spark, sf_dir)
    return show(components.connected(field, G, middle(field), 6))


@query
def components_18(spark, sf_dir):
    field = volume(spark, sf_dir)
    return show(components.connected(field, G, middle(field) + 2, 18, 2))


@query
def components_26(spark, sf_dir):
    field = volume(spark, sf_dir)
    return show(components.connected(field, G, middle(field) + 3, 26, 3))


@query
def components_low(spark, sf_dir):
    field = volume(spark, sf_dir)
    walls = field.select("volume_id", "z", "y", "x", F.when(F.col("x") % 7 == 0, 1).otherwise(-1).alias("label"))
    return show(components.connected_low(field, G, middle(field) - 2, 2, walls))


@query
def component_table(spark, sf_dir):
    field = volume(spark, sf_dir)
    found = components.connected(field, G, middle(field), 6)
    return components.component_table(found, field).select("label", "size", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", F.round("mean", 6).alias("mean"))


@query
def watershed(spark, sf_dir):
    field = volume(spark, sf_dir)
    scaled = field.withColumn("v", F.col("v") / 256)
    seeds = field.select("volume_id", "z", "y", "x", F.when((F.col("x") % 10 == 5) & (F.col("y") == 5) & (F.col("z") == 3), F.floor(F.col("x") / 10)).otherwise(-1).cast("int").alias("label"))
    chosen = spark.createDataFrame([("lineitem", i) for i in range(5)], "volume_id string, label int")
    return show(segmentation.watershed(scaled, seeds, G, chosen))


@query
def threshold_sweep_passes(spark, sf_dir):
    """Three passes: components wait while their closing isn't dark enough."""
    return _sweep_passes(volume(spark, sf_dir), "kernel")


def _sweep_passes(field: DataFrame, engine: str) -> DataFrame:
    t = middle(field)
    return segmentation.threshold_sweep(field, G, t + 1, t + 3, 1.0, closing=1, min_size=30, min_invalid_area=10.0, engine=engine, side=TILE).select("z", "y", "x", "label", "passes")


@query
def watershed_blocks(spark, sf_dir):
    """Seeds of 27 voxels, flooded in eight levels."""
    return _watershed_blocks(spark, volume(spark, sf_dir), "kernel")


def _watershed_blocks(spark: SparkSession, field: DataFrame, engine: str) -> DataFrame:
    inside = (F.abs(F.col("x") % 10 - 5) <= 1) & (F.abs(F.col("y") - 5) <= 1) & (F.abs(F.col("z") - 3) <= 1)
    seeds = field.select("volume_id", "z", "y", "x", F.when(inside, F.floor(F.col("x") / 10)).otherwise(-1).cast("int").alias("label"))
    chosen = seeds.where("label >= 0").select("volume_id", "label").distinct()
    return show(segmentation.watershed(field.withColumn("v", F.col("v") / 64), seeds, G, chosen, levels=8, engine=engine, side=TILE))


# the same on tiles: eight of the volume, none of which any task sees with more than its halo

TILE = (4, 6, 25)


@query
def h_minima_tiles(spark, sf_dir):
    scaled = volume(spark, sf_dir).withColumn("v", F.col("v") / 256)
    return out(segmentation.h_minima(scaled, G, 6 / 256, engine="tiles", side=TILE))


@query
def components_26_tiles(spark, sf_dir):
    field = volume(spark, sf_dir)
    return show(components.connected(field, G, middle(field) + 3, 26, 3, engine="tiles", side=TILE))


@query
def wall_thickness_tiles(spark, sf_dir):
    field = volume(spark, sf_dir)
    return segmentation.wall_thickness(pointwise.threshold(field, middle(field)), G, engine="tiles", side=TILE).select("thickness")


@query
def watershed_tiles(spark, sf_dir):
    return _watershed_blocks(spark, volume(spark, sf_dir), "tiles")


@query
def threshold_sweep_tiles(spark, sf_dir):
    return _sweep_passes(volume(spark, sf_dir), "tiles")


# surfaces and resampling

SURFACE = {"xy_radius": 1, "z_radius": 1, "kernel": Kernel.MEAN, "smooth": 1}


@query
def height_map(spark, sf_dir):
    field = volume(spark, sf_dir)
    return surface.height_map(field, G, level=middle(field) + 0.3, **SURFACE).select("y", "x", F.round("v", 4).alias("v"))


@query
def depth_map(spark, sf_dir):
    field = volume(spark, sf_dir)
    return out(surface.depth_map(field, G, level=middle(field) + 0.3, **SURFACE), 4)


@query
def projection_z(spark, sf_dir):
    field = volume(spark, sf_dir)
    return _projection(field, middle(field), Projection.Z)


@query
def projection_normal(spark, sf_dir):
    field = volume(spark, sf_dir)
    return _projection(field, middle(field), Projection.NORMAL)


def _projection(field: DataFrame, t: float, mode: Projection) -> DataFrame:
    top = {"xy_radius": 1, "z_radius": 1, "kernel": Kernel.MEAN, "smooth": 1}
    return surface.height_projection(field, G, mode=mode, reach=2, start=0.25, offset=0.0, level=t - 2 if mode == Projection.Z else 0.0, surface_level=t + 0.3, **top).select("y", "x", F.round("v", 3).alias("v"))


DEEP = Grid(50, 11, 7, spacing=(1.0, 1.0, 2.0))


@query
def resample_area(spark, sf_dir):
    return out(resample.resample_z(volume(spark, sf_dir), DEEP, 1.25)[0], 3)


@query
def resample_lanczos2(spark, sf_dir):
    return out(resample.resample_z(volume(spark, sf_dir), DEEP, 1.0, 2)[0], 3)


@query
def resample_lanczos3(spark, sf_dir):
    return out(resample.resample_z(volume(spark, sf_dir), DEEP, 3.0, 3)[0], 3)


@query
def extract_xy(spark, sf_dir):
    return out(resample.extract_xy(volume(spark, sf_dir), G, 3))


@query
def extract_yz(spark, sf_dir):
    return out(resample.extract_yz(volume(spark, sf_dir), G, 20))


@query
def extract_zx(spark, sf_dir):
    return out(resample.extract_zx(volume(spark, sf_dir), G, 4))


# labels


@query
def label_select(spark, sf_dir):
    found = labels.present(columns(spark, sf_dir), [0, 2, 9, -1])
    return spark.createDataFrame([(i,) for i in found], "label int")


@query
def label_merge(spark, sf_dir):
    return show(labels.merge(columns(spark, sf_dir), [1, 3, 4], 3))


@query
def label_split(spark, sf_dir):
    return show(labels.split(columns(spark, sf_dir), G, [0, 2], 6))


@query
def label_dilate(spark, sf_dir):
    return show(labels.dilate(columns(spark, sf_dir), [1, 3], 1, 6))


@query
def label_erode(spark, sf_dir):
    return show(labels.erode(columns(spark, sf_dir), [0, 2], 1, 6))


@query
def label_crop(spark, sf_dir):
    return show(labels.crop_to_selection(columns(spark, sf_dir), G, [1, 2])[0])


@query
def label_select_by_mean(spark, sf_dir):
    field = volume(spark, sf_dir)
    return labels.select_by_mean(columns(spark, sf_dir), field, middle(field) + 2).select("label")


@query
def label_render(spark, sf_dir):
    return labels.render_labels(columns(spark, sf_dir), [2]).select("z", "y", "x", "red", "green", "blue")


@query
def label_select_at(spark, sf_dir):
    """The label under a cursor, for every tenth position of a row; -1 where nothing is selected."""
    session = labels.LabelSession(columns(spark, sf_dir), G)
    found = [(x, (session.clear_selection(), session.select_at(x, 5, 3))[1]) for x in range(0, G.width, 10)]
    return spark.createDataFrame([(x, chosen[0] if chosen else -1) for x, chosen in found], "x int, label int")


@query
def label_session_crop(spark, sf_dir):
    """Select, merge and crop in a session; the crop's origin goes with the voxels."""
    session = labels.LabelSession(columns(spark, sf_dir), G)
    session.select([1, 3])
    session.merge()
    origin = session.crop()
    return session.labels.select(*((F.col(a) + o).cast("int").alias(a) for a, o in zip("zyx", reversed(origin), strict=True)), "label")


@query
def label_session_undo(spark, sf_dir):
    """Merge, dilate, crop, and undo the last two."""
    session = labels.LabelSession(columns(spark, sf_dir), G)
    session.select([0, 2])
    session.merge(2)
    session.dilate()
    session.crop()
    assert session.undo() and session.undo() and session.grid == G
    return show(session.labels)


@query
def label_session_replace(spark, sf_dir):
    """Labels replaced by others; of the selection what is still there stays."""
    session = labels.LabelSession(columns(spark, sf_dir), G)
    session.select([0, 1, 4])
    session.replace(session.labels.withColumn("label", F.when(F.col("label") == 1, -1).otherwise(F.col("label")).cast("int")))
    chosen = session.selection
    return show(session.labels).withColumn("selected", F.col("label").isin(chosen))


@query
def label_ball_dilate(spark, sf_dir):
    """Background within a ball of radius 2 of the selected labels takes the least of them."""
    return show(labels.ball_dilate(columns(spark, sf_dir), G, [1, 3], 2))


@query
def label_ball_erode(spark, sf_dir):
    """Selected voxels with another label within a ball of radius 1 become background."""
    return show(labels.ball_erode(columns(spark, sf_dir), G, [0, 2], 1))


@query
def copy_segments(spark, sf_dir):
    """Selected labels copied to another place: five to the right, one row down."""
    return show(labels.copy_segments(columns(spark, sf_dir), G, [0, 2], (5, 1, 0)))


@query
def overwrite_by_mask(spark, sf_dir):
    field = volume(spark, sf_dir)
    return out(pointwise.overwrite(field, pointwise.threshold(field, middle(field) + 1), 99.0))


# agreement, export, sources


def _two_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    field = volume(spark, sf_dir)
    t = middle(field)
    a, b = (field.select("volume_id", "z", "y", "x", (F.col("v") >= t + k).cast("int").alias("label")) for k in (2, 3))
    return a, b


@query
def metric_overlap(spark, sf_dir):
    a, b = _two_masks(spark, sf_dir)
    return metrics.overlap(a, b).select("reference_count", "candidate_count", "common", F.round("dice", 9).alias("dice"), F.round("volume_difference", 9).alias("volume_difference"))


@query
def metric_objects(spark, sf_dir):
    a, _ = _two_masks(spark, sf_dir)
    return metrics.object_count(a, G, 26).select("objects")


@query
def metric_hausdorff95(spark, sf_dir):
    a, b = _two_masks(spark, sf_dir)
    return metrics.hausdorff95(a, b, G).select(F.round("hausdorff95", 9).alias("hausdorff95"))


@query
def metric_report(spark, sf_dir):
    a, b = _two_masks(spark, sf_dir)
    found = metrics.evaluate(a, b, G).drop("volume_id")
    return found.withColumns({"failures": F.array_join("failures", ", "), **{c: F.round(c, 9) for c in ("dice", "volume_difference", "hausdorff95")}})


@query
def export_labels(spark, sf_dir):
    return packages.export(columns(spark, sf_dir), G, "label").select("volume_id", "kind", "payload_sha256", "label_bits", F.octet_length("payload").alias("payload_bytes"))


@query
def label_stack_round_trip(spark, sf_dir):
    """Labels written as a stack of 16-bit planes and decoded from its bytes."""
    stacks = packages.export(columns(spark, sf_dir), G, "label", (0.25, 0.5, 1.75))
    return tiff.decode_label_stacks(stacks.select("volume_id", F.col("label_tiff").alias("content"))).select("z", "y", "x", "label", "bits", "sz")


@query
def synthetic_sphere(spark, sf_dir):
    return out(synthetic.sphere(spark, 24, 20, 12, 6, 2)[0], 6)


@query
def synthetic_ramp(spark, sf_dir):
    return out(synthetic.ramp(spark)[0], 6)


@query
def flagship(spark, sf_dir):
    """Events per channel: smoothed, locally thresholded, closed, labelled and measured."""
    g = adapters.event_grid(spark, sf_dir)
    events = adapters.event_volume(spark, sf_dir, grid=g)
    field = durable(events.select(F.concat("volume_id", F.lit("/"), "c").alias("volume_id"), "z", "y", "x", "v"), "events")
    smooth = durable(stencil.smooth(field, 1, Kernel.GAUSSIAN), "smooth")
    mask = morphology.closing(stencil.adaptive_threshold(smooth, 3, Kernel.GAUSSIAN, 0.0, "xyz"), g, 1)
    found = components.connected(durable(mask, "mask"), g, MASK, 26, 2)
    return components.component_table(found, field).select("volume_id", "label", "size", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", F.round("mean", 6).alias("mean"))
