"""Operators on tiles give what the kernels give on whole volumes."""

import numpy as np
import pytest
from tests.volumes import array_of, field_of, grid_of

from voxstrata.operators import components, dense, segmentation, tiles


def test_tiles_part_a_grid():
    from voxstrata.model import Grid

    for shape, side, halo in (((7, 11, 50), 4, 2), ((1, 1, 9), 4, 1), ((5, 3, 2), 1, 1), ((9, 9, 9), (9, 4, 2), 3)):
        t = tiles.Tiling.of(Grid(shape[2], shape[1], shape[0]), halo, side)
        seen = np.zeros(shape, int)
        for k in range(t.count):
            seen[tuple(slice(a, b) for a, b in t.box(k))] += 1
        assert (seen == 1).all() and all(b - a >= min(halo, n) for k in range(t.count) for (a, b), n in zip(t.box(k), shape, strict=True))


@pytest.mark.parametrize("shape,side", [((6, 9, 20), 5), ((1, 8, 8), 4), ((4, 4, 4), 2)])
def test_h_minima(spark, shape, side):
    rng = np.random.default_rng(sum(shape))
    a = rng.integers(0, 12, shape).astype(np.float32) / 16
    got = array_of(segmentation.h_minima(field_of(spark, a), grid_of(a), 0.3, engine="tiles", side=side), a.shape)
    assert ((got > 0) == (dense.reconstruct_minima(a, 0.3, 50) > 0)).all()


def test_h_minima_through_a_winding_channel(spark):
    a = np.ones((3, 16, 16), np.float32)
    for k in range(0, 16, 2):  # a low path that crosses tiles many times
        a[1, k, :] = 0.2
        a[1, min(k + 1, 15), 15 if k % 4 == 0 else 0] = 0.2
    a[1, 0, 0] = 0.0
    got = array_of(segmentation.h_minima(field_of(spark, a), grid_of(a), 0.15, engine="tiles", side=4), a.shape)
    assert ((got > 0) == (dense.reconstruct_minima(a, 0.15, 50) > 0)).all()


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    for shape, share in (((6, 9, 20), {6: 0.55, 18: 0.8, 26: 0.88}[connectivity]), ((5, 5, 5), 0.5)):
        a = (rng.random(shape) > share).astype(float)
        run = lambda engine, a=a: array_of(components.connected(field_of(spark, a), grid_of(a), 0.5, connectivity, 2, engine=engine, side=4), a.shape, "label")
        assert (run("tiles") == run("kernel")).all()


def test_components_of_equal_labels_in_two_volumes(spark):
    rng = np.random.default_rng(2)
    volumes = {name: rng.integers(-1, 3, (4, 6, 10)) for name in ("a", "b")}
    rows = field_of(spark, volumes["a"], "label").union(field_of(spark, volumes["b"], "label", "b"))
    grid = grid_of(volumes["a"])
    run = lambda engine: sorted(map(tuple, components.label_components(rows, grid, 6, engine=engine, side=3).select("volume_id", "z", "y", "x", "label", "idx", "root").collect()))
    assert run("tiles") == run("kernel")


def test_one_long_component(spark):
    a = np.zeros((2, 12, 12))
    for k in range(0, 12, 2):
        a[0, k, :] = 1
        a[0, min(k + 1, 11), 11 if k % 4 == 0 else 0] = 1
    got = array_of(components.connected(field_of(spark, a), grid_of(a), 0.5, 6, engine="tiles", side=(1, 3, 3)), a.shape, "label")
    assert (got == np.where(a > 0, 0, -1)).all()
    empty = array_of(components.connected(field_of(spark, 0 * a), grid_of(a), 0.5, 6, engine="tiles", side=4), a.shape, "label")
    assert (empty == -1).all()


@pytest.mark.parametrize("shape,side,levels", [((6, 9, 20), 5, 5), ((1, 12, 12), 4, 4), ((5, 5, 8), (2, 5, 4), 3)])
def test_watershed(spark, shape, side, levels):
    rng = np.random.default_rng(sum(shape))
    level, seeds = rng.random(shape).astype(np.float32) * 0.9, np.full(shape, -1)
    for k in range(6):
        at = tuple(rng.integers(0, n) for n in shape)
        seeds[tuple(slice(max(0, p - 1), p + 2) for p in at)] = k
    chosen = spark.createDataFrame([("a", int(i)) for i in np.unique(seeds[seeds >= 0])], "volume_id string, label int")
    got = array_of(segmentation.watershed(field_of(spark, level), field_of(spark, seeds, "label"), grid_of(level), chosen, levels=levels, engine="tiles", side=side), shape, "label")
    assert (got == dense.watershed(level, seeds, levels)).all()


def test_wall_thickness(spark):
    plate = np.zeros((9, 20, 20), np.float32)
    plate[2:7, 3:17, 3:17] = 0.8
    noise = (np.random.default_rng(1).random((9, 20, 20)) > 0.7).astype(np.float32) * 0.8
    rows = field_of(spark, plate).union(field_of(spark, noise, volume_id="b")).union(field_of(spark, 0 * noise, volume_id="c")).union(field_of(spark, 0 * noise + 0.8, volume_id="d"))
    got = dict(map(tuple, segmentation.wall_thickness(rows, grid_of(plate), engine="tiles", side=6).collect()))
    assert got == {k: dense.wall_thickness(a, 1) for k, a in (("a", plate), ("b", noise), ("c", 0 * noise), ("d", 0 * noise + 0.8))}


def whole_passes(masks, shape, options, outside=None):
    return dense.staged_segmentation([lambda m=m: m for m in masks], shape, outside=outside, **options)


def shell():
    """A hollow shell, whose closing fills the hole."""
    z, y, x = np.indices((22, 22, 22)) - 10.5
    far = np.sqrt(z * z + y * y + x * x)
    return np.where((far > 6) & (far < 9.5), 0.1, 0.9).astype(np.float32)


@pytest.mark.parametrize("area", [10.0, 50.0, 250.0])
def test_threshold_sweep_of_a_shell(spark, area):
    a = shell()
    options = {"closing_radius": 1, "more_than": 2, "invalid_area": area}
    masks = [np.where(a >= np.float32(t), np.float32(0.8), np.float32(0)) for t in (0.8, 0.5, 0.2)]
    labels, count, passes = whole_passes(masks, a.shape, options)
    df = segmentation.threshold_sweep(field_of(spark, a), grid_of(a), 0.2, 0.8, 0.3, closing=1, min_size=2, min_invalid_area=area, engine="tiles", side=11)
    assert (array_of(df, a.shape, "label") == labels).all() and (array_of(df, a.shape, "passes") == passes).all()


def test_threshold_sweep_of_several_volumes(spark):
    rng = np.random.default_rng(9)
    volumes = {k: rng.random((5, 10, 14)).astype(np.float32) for k in "ab"}
    volumes["c"] = np.full((5, 10, 14), 0.95, np.float32)
    rows = field_of(spark, volumes["a"]).union(field_of(spark, volumes["b"], volume_id="b")).union(field_of(spark, volumes["c"], volume_id="c"))
    df = segmentation.threshold_sweep(rows, grid_of(volumes["a"]), 0.3, 0.7, 0.2, closing=0, min_size=1, min_invalid_area=3.0, engine="tiles", side=5).cache()
    for name, a in volumes.items():
        masks = [np.where(a >= np.float32(t), np.float32(0.8), np.float32(0)) for t in (0.7, 0.5, 0.3)]
        labels, _, passes = whole_passes(masks, a.shape, {"closing_radius": 0, "more_than": 1, "invalid_area": 3.0})
        own = df.where(f"volume_id = '{name}'")
        assert (array_of(own, a.shape, "label") == labels).all() and (array_of(own, a.shape, "passes") == passes).all()


def test_directional_segmentation_with_a_crop(spark):
    from voxstrata.model import Crop, Kernel

    a = np.random.default_rng(4).random((6, 9, 12)).astype(np.float32)
    run = lambda engine: segmentation.directional_segmentation(
        field_of(spark, a), grid_of(a), radius=1, level=1, kernel=Kernel.MEAN, low=-0.4, high=0.0, step=0.2, closing=1, min_invalid_area=4.0, crop=Crop(1, 4, 1), engine=engine, side=5
    )
    left, right = run("tiles"), run("kernel")
    for column in ("label", "passes"):
        assert (array_of(left, a.shape, column) == array_of(right, a.shape, column)).all()
