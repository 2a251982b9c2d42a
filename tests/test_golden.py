"""Hand-computed results of the volume operators."""

import numpy as np
import pytest
from tests.volumes import array_of, field_of, grid_of

from voxstrata.functions import weights as W
from voxstrata.model import Crop, Grid, InvalidArgument, Kernel, Projection, ResourceLimit, validate_volume
from voxstrata.operators import components, dense, directional, morphology, pointwise, resample, segmentation, stencil, surface
from voxstrata.operators.envelope import lower_envelope


def line(*values):
    return np.array(values, float).reshape(1, 1, -1)


def column(*values):
    return np.array(values, float).reshape(-1, 1, 1)


def test_directions_are_counted_unit_vectors_without_opposites():
    for level, n in ((1, 21), (2, 81), (3, 321), (4, 1281), (5, 5121)):
        v = W.directions(level)
        assert len(v) == n
        assert np.allclose((v.astype(float) ** 2).sum(axis=1), 1, atol=1e-5)
        if level <= 2:
            assert np.abs(v[:, None] + v[None]).max(axis=2).min() > 1e-6
    with pytest.raises(InvalidArgument):
        W.directions(6)


def test_line_weights_sum_to_one():
    for r in (0, 1, 2, 14):
        for gaussian in (True, False):
            assert sum(W.line_weights(r, gaussian)) == pytest.approx(1, abs=1e-6)
    raw = [np.exp(-(k * k) / (2 * 1.1**2)) for k in range(-2, 3)]
    assert W.line_weights(2, True) == pytest.approx([w / sum(raw) for w in raw], abs=1e-6)


def test_estimates():
    one = W.estimate(1, 1, 1, 2, 1)
    assert (one["directions"], one["line_samples"], one["work_items"], one["host_bytes"]) == (21, 8, 168, 268)
    three = W.estimate(3, 3, 3, 1, 1, W.ascending_schedule(0, 0, 0.1))
    assert (three["line_samples"], three["work_items"], three["host_bytes"], three["passes"]) == (3, 1701, 1548, 1)
    big = W.estimate(2048, 2048, 2048, 14, 5)
    assert big["directions"] == 5121 and not big["within_limits"]
    with pytest.raises(ResourceLimit):
        W.enforce(big)


def test_schedules_end_at_their_bound():
    assert W.ascending_schedule(0, 1, 0.4) == pytest.approx([0, 0.4, 0.8, 1])
    assert W.descending_schedule(0.4, 0.8, 0.4) == pytest.approx([0.8, 0.4])
    with pytest.raises(InvalidArgument):
        W.ascending_schedule(0, 1, 1e-6)
    with pytest.raises(InvalidArgument):
        W.ascending_schedule(1, 0, 0.1)


def test_trilinear(spark):
    a = np.fromfunction(lambda z, y, x: x + 2 * y + 4 * z, (3, 3, 3))
    points = spark.createDataFrame([("a", 1, 0.25, 0.5, 0.75), ("a", 2, -1.0, 0.5, 5.0)], "volume_id string, point_id int, px double, py double, pz double")
    got = {r.point_id: r.v for r in stencil.trilinear(field_of(spark, a), grid_of(a), points).collect()}
    assert got == {1: 4.25, 2: 9.0}


@pytest.mark.parametrize("engine", ["kernel", "rows"])
def test_response_of_a_constant(spark, engine):
    a = np.full((3, 3, 3), 0.5)
    got = directional.response(field_of(spark, a), grid_of(a), 2, 1, Kernel.MEAN, engine)
    assert array_of(got, a.shape, "least") == pytest.approx(a, abs=1e-6)
    if engine == "rows":
        return  # sums of equal terms differ in their last digits there
    assert array_of(got, a.shape, "alpha") == pytest.approx(np.ones(a.shape))


@pytest.mark.parametrize("kernel", list(Kernel))
def test_response_engines_agree_on_ramps(spark, kernel):
    a = np.fromfunction(lambda z, y, x: x + 2 * y + 3 * z + (x * y) % 3, (4, 4, 4))
    field, grid = field_of(spark, a), grid_of(a)
    got = [array_of(directional.response(field, grid, 1, 1, kernel, e), a.shape, "least") for e in ("kernel", "rows")]
    assert got[0] == pytest.approx(got[1], abs=1e-5)


def test_response_slabs_agree_with_the_whole(spark):
    from voxstrata.operators.volumes import per_slab

    a = np.random.default_rng(1).random((9, 4, 5))
    whole, _ = dense.response(a, 2, 1, True, 0, 9, 0, 9)
    run = lambda p, first, last, base: {"least": dense.response(p, 2, 1, True, first, last, base, 9)[0].astype(float)}
    slabs = per_slab(field_of(spark, a), grid_of(a), 3, run, "least double", slab_voxels=40)
    assert array_of(slabs, a.shape, "least") == pytest.approx(whole, abs=1e-6)


def test_directional_threshold_is_strict(spark):
    a = np.full((3, 3, 3), 0.5)
    field, grid = field_of(spark, a), grid_of(a)
    run = lambda c: array_of(directional.directional_threshold(field, grid, radius=1, level=1, kernel=Kernel.MEAN, constant=c), a.shape)
    assert (run(0.1) == 0.8).all()
    assert (run(-0.1) == 0).all()


def test_closing_fills_a_hole(spark):
    a = np.full((5, 5, 5), 0.8)
    a[2, 2, 2] = 0
    assert (array_of(morphology.closing(field_of(spark, a), grid_of(a), 1), a.shape) == 0.8).all()


def test_ball_of_an_impulse(spark):
    a = np.zeros((3, 5, 5))
    a[1, 2, 2] = 1
    assert array_of(morphology.ball(field_of(spark, a), grid_of(a), 1, True), a.shape).sum() == 7


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_morphology_agrees_with_the_kernel(spark, radius):
    a = np.random.default_rng(radius).random((5, 6, 7))
    for dilate in (True, False):
        got = array_of(morphology.ball(field_of(spark, a), grid_of(a), radius, dilate), a.shape)
        assert (got == dense.ball(a, radius, dilate)).all()


def test_chunked_balls_are_not_one_ball(spark):
    a = np.zeros((13, 13, 13))
    a[6, 6, 6] = 1
    got = array_of(morphology.chunked(field_of(spark, a), grid_of(a), 5, False), a.shape)
    assert (got == dense.chunked(a, 5, False)).all()
    assert dense.ball(dense.ball(a, 4, True), 1, True).sum() != dense.ball(a, 5, True).sum()


def test_low_components_with_a_strict_size(spark):
    a = line(0, 0, 0.8, 0, 0.8)
    got = components.connected_low(field_of(spark, a), grid_of(a), 0.1, 1)
    assert array_of(got, a.shape, "label").ravel().tolist() == [0, 0, -1, -1, -1]


SPOTS = [(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 2, 1), (0, 3, 1), (0, 3, 2)]


@pytest.mark.parametrize(("connectivity", "n"), [(6, 4), (18, 3), (26, 2)])
@pytest.mark.parametrize("engine", ["kernel", "rows"])
def test_components(spark, connectivity, n, engine):
    a = np.zeros((3, 4, 4))
    for x, y, z in SPOTS:
        a[z, y, x] = 1
    got = array_of(components.connected(field_of(spark, a), grid_of(a), 0.5, connectivity, engine=engine), a.shape, "label")
    assert got.max() + 1 == n == len(set(dense.components(a > 0, connectivity).ravel()) - {-1})
    assert got[0, 0, 0] == 0


def test_components_of_a_nan_level(spark):
    a = np.zeros((1, 2, 3))
    got = array_of(components.connected(field_of(spark, a), grid_of(a), float("nan"), 26), a.shape, "label")
    assert got.ravel().tolist() == [0, 1, 2, 3, 4, 5]


RING = [(4, 1), (5, 1), (6, 1), (4, 2), (6, 2), (4, 3), (5, 3), (6, 3)]


def test_threshold_sweep_waits_for_the_ring(spark):
    a = np.ones((1, 5, 9))
    a[0, 2, 0] = 0
    for x, y in RING:
        a[0, y, x] = 0
    got = segmentation.threshold_sweep(field_of(spark, a), grid_of(a), 0.4, 0.8, 0.4, closing=0, min_size=0, min_invalid_area=0)
    found = array_of(got, a.shape, "label")
    assert found[0, 2, 0] == 0 and all(found[0, y, x] == 1 for x, y in RING) and found[0, 2, 5] == -1
    assert got.select("passes").distinct().collect()[0].passes == 2


def test_directional_sweep_from_a_response(spark):
    a, least = np.zeros((1, 5, 9)), np.full((1, 5, 9), -1.0)
    least[0, 2, 0] = 1
    for x, y in RING:
        least[0, y, x] = 1
    found = field_of(spark, least).withColumnRenamed("v", "least").selectExpr("*", "0D AS alpha", "0D AS v")
    options = {"closing_radius": 0, "more_than": 0, "invalid_area": 0.0}
    got = segmentation.segmentation_from_response(found, grid_of(a), W.ascending_schedule(0, 0.1, 0.1), 0.2, options)
    labels = array_of(got, a.shape, "label")
    assert labels[0, 2, 0] == 0 and all(labels[0, y, x] == 1 for x, y in RING) and labels[0, 2, 5] == -1


def test_segmentation_with_a_crop(spark):
    a = np.full((3, 3, 3), 0.5)
    ones = field_of(spark, np.ones((1, 3, 3))).select("volume_id", "y", "x", "v")
    got = segmentation.directional_segmentation(field_of(spark, a), grid_of(a), radius=1, level=1, kernel=Kernel.MEAN, low=-0.1, high=-0.1, step=0.1, closing=0, min_invalid_area=0, crop=Crop(0, 0, 1, ones))
    labels = array_of(got, a.shape, "label")
    assert (labels >= 0).sum() == 1 and labels[1, 1, 1] == 0


def test_adaptive_threshold(spark):
    a = column(0, 1, 0)
    field = field_of(spark, a)
    assert array_of(stencil.adaptive_threshold(field, 1, Kernel.MEAN, 0.0, "xy"), a.shape).ravel().tolist() == [0, 0, 0]
    assert array_of(stencil.adaptive_threshold(field, 1, Kernel.MEAN, 0.0, "xyz"), a.shape).ravel().tolist() == [0, 0.8, 0]
    assert array_of(stencil.adaptive_threshold(field, 0, Kernel.MEAN, 0.0, "xyz"), a.shape).sum() == 0


@pytest.mark.parametrize("engine", ["kernel", "rows"])
@pytest.mark.parametrize(("values", "h", "expected"), [((1, 0, 1), 0.5, [0.8, 0, 0.8]), ((1, 0, 1), 0.0, [0.8, 0.8, 0.8]), ((1, 0.8, 1), 0.3, [0, 0, 0])])
def test_h_minima(spark, engine, values, h, expected):
    a = line(*values)
    assert array_of(segmentation.h_minima(field_of(spark, a), grid_of(a), h, engine=engine), a.shape).ravel().tolist() == expected


def test_h_minima_of_a_cube(spark):
    a = np.ones((3, 3, 3))
    a[1, 1, 1] = 0
    got = array_of(segmentation.h_minima(field_of(spark, a), grid_of(a), 0.5), a.shape)
    assert got[1, 1, 1] == 0 and (got == 0.8).sum() == 26


def test_watershed(spark):
    a, seeds = line(0, 0, 0, 0, 0), line(10, -1, -1, -1, 20)
    run = lambda ids, least=0: array_of(segmentation.watershed(field_of(spark, a), field_of(spark, seeds, "label"), grid_of(a), spark.createDataFrame([("a", i) for i in ids], "volume_id string, label int"), least_seed=least), a.shape, "label").ravel().tolist()
    assert run([10, 20]) == [10, 10, 10, 20, 20]
    assert run([10]) == [10] * 5
    with pytest.raises(InvalidArgument):
        run([10, 20], 2)


def height(spark, a, **options):
    options = {"z_radius": 0, "xy_radius": 0, "smooth": 0, "kernel": Kernel.MEAN, "level": 0.5} | options
    return array_of(surface.height_map(field_of(spark, a), grid_of(a), **options), a.shape[1:])


def test_height_map(spark):
    assert height(spark, column(0, 0, 0.25, 0.75, 1)).tolist() == [[2.5]]
    assert height(spark, column(0, 0, 0, 0, 0)).tolist() == [[4.0]]
    stairs = np.array([[1, 0, 0], [1, 1, 0], [1, 1, 1]], float).reshape(3, 1, 3)
    assert height(spark, stairs, xy_radius=1, smooth=1)[0] == pytest.approx([1 / 6, 2 / 3, 7 / 6], abs=1e-6)


def test_depth_map(spark):
    a = np.array([[1, 0, 1], [0, 0, 0], [0, 0, 0]], float).reshape(3, 1, 3)
    got = array_of(surface.depth_map(field_of(spark, a), grid_of(a), z_radius=0, xy_radius=0, smooth=0, level=0.5), a.shape)
    assert (got[1, 0, 0], got[2, 0, 0], got[2, 0, 2], got[2, 0, 1]) == (1, 1, 1, 0)


@pytest.mark.parametrize(("mode", "level", "expected"), [(Projection.Z, 0.0, 0.8), (Projection.NORMAL, 0.0, 0.8), (Projection.NORMAL, 0.5, 1.0), (Projection.Z, 0.9, 0.0)])
def test_projection(spark, mode, level, expected):
    a = column(1, 0.2, 0.8, 0.4)
    got = surface.height_projection(field_of(spark, a), grid_of(a), mode=mode, start=1.0, reach=2, level=level, surface_level=0.5, z_radius=0, xy_radius=0, smooth=0)
    assert array_of(got, (1, 1))[0, 0] == pytest.approx(expected)


def test_resampling_changes_depth(spark):
    a = np.fromfunction(lambda z, y, x: 100 * z + 10 * y + x, (4, 2, 3))
    grid = Grid(3, 2, 4, spacing=(1.0, 1.0, 2.0))
    for order in (None, 2, 3):
        got, finer = resample.resample_z(field_of(spark, a), grid, 1.0, order)
        assert finer.depth == 8
        assert array_of(got, (8, 2, 3)).shape == (8, 2, 3)
    assert resample.resampled_depth(Grid(5, 5, 3, spacing=(1, 1, 2.0)), 1.0) == 6
    with pytest.raises(InvalidArgument):
        resample.resampled_depth(grid, 0.0)


def test_planes(spark):
    a = np.fromfunction(lambda z, y, x: 100 * z + 10 * y + x, (4, 2, 3))
    field, grid = field_of(spark, a), grid_of(a)
    assert (array_of(resample.extract_yz(field, grid, 1), (2, 4)) == a[:, :, 1].T).all()
    assert (array_of(resample.extract_zx(field, grid, 1), (4, 3)) == a[:, 1, :]).all()
    assert (array_of(resample.extract_xy(field, grid, 2), (2, 3)) == a[2]).all()
    with pytest.raises(InvalidArgument):
        resample.extract_xy(field, grid, 4)


def test_pointwise_edges(spark):
    a = line(float("nan"), -1, 0.25, 2)
    field = field_of(spark, a)
    assert [r.v for r in pointwise.threshold(field, 0.25).orderBy("x").collect()] == [0, 0, 1, 1]
    window = [r.v for r in pointwise.window_level(field, -0.25, 1.0).orderBy("x").collect()]
    assert np.isnan(window[0]) and window[1:] == pytest.approx([0, 0.4, 1])
    with pytest.raises(InvalidArgument):
        pointwise.window_level(field, 1, 1)
    with pytest.raises(InvalidArgument):
        validate_volume(field, grid_of(a))


def test_crop_wider_than_the_volume_is_all_outside(spark):
    a = np.ones((1, 2, 2))
    assert array_of(pointwise.crop_mask(field_of(spark, a), grid_of(a), Crop(0, 0, 2), 0.0), a.shape).sum() == 0


def test_smoothing_is_the_window_mean(spark):
    a = np.random.default_rng(2).random((4, 3, 5))
    p = np.pad(a, 1, mode="edge")
    expected = sum(p[i : i + 4, j : j + 3, k : k + 5] for i in range(3) for j in range(3) for k in range(3)) / 27
    assert array_of(stencil.smooth(field_of(spark, a), 1, Kernel.MEAN), a.shape) == pytest.approx(expected, abs=1e-5)


def test_wall_thickness(spark):
    a = np.zeros((7, 7, 7))
    a[3] = 1  # a plane one voxel thick is gone after the first opening
    run = lambda m, start=1: segmentation.wall_thickness(field_of(spark, m), grid_of(m), start).first().thickness
    assert run(a) == 2 and run(np.ones((3, 3, 3))) == 6 and run(np.zeros((3, 3, 3)), 2) == 4


def test_watershed_against_a_scalar_version():
    rng = np.random.default_rng(4)
    level = (rng.integers(0, 257, (3, 5, 6)) / 256).astype(np.float32)
    seeds = np.full(level.shape, -1, np.int32)
    seeds[0, 0, 0], seeds[2, 4, 5], seeds[1, 2, 2] = 3, 5, 9
    order = ((-1, 0, 0), (0, 0, -1), (0, -1, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0))

    def near(labels, p):
        for d in order:
            q = tuple(i + j for i, j in zip(p, d, strict=True))
            if all(0 <= i < n for i, n in zip(q, labels.shape, strict=True)):
                yield labels[q]

    def grow(labels, top):
        out = labels.copy()
        for p in np.ndindex(labels.shape):
            if labels[p] < 0 and level[p] <= top:
                out[p] = next((v for v in near(labels, p) if v >= 0), -1)
        return out

    labels = seeds
    for i in range(1, 257):
        while True:
            grown = grow(labels, np.float32(i / 256))
            if (grown == labels).all():
                break
            labels = grown
        opened = labels.copy()
        for p in np.ndindex(labels.shape):
            if labels[p] >= 0 and any(v != labels[p] for v in near(labels, p)):
                opened[p] = -1
        labels = grow(opened, np.float32(np.inf))
    assert (dense.watershed(level, seeds) == labels).all()


@pytest.mark.parametrize("radius", [3, 5])
def test_balls_on_tiles_agree_with_rows(spark, radius):
    from voxstrata.operators import volumes

    a = np.random.default_rng(radius).random((9, 11, 7))
    field, grid = field_of(spark, a), grid_of(a)
    for dilate in (True, False):
        rows = array_of(morphology.ball(field, grid, radius, dilate, engine="rows"), a.shape)
        assert np.array_equal(array_of(morphology.ball(field, grid, radius, dilate), a.shape), rows)
        tiled = volumes.per_tile(field, grid, radius, morphology._tile_kernel(radius, dilate), voxels=100)
        assert volumes.tile_sides(grid, radius, 100) == (radius, radius)
        assert np.array_equal(array_of(tiled, a.shape), rows)


def test_nan_is_above_all_numbers_in_tiles():
    a = np.array([[[1.0, np.nan, np.nan, np.nan, 2.0]]])
    assert np.array_equal(morphology._tile_kernel(1, False)(a), [[[1, 1, np.nan, 2, 2]]], equal_nan=True)
    assert np.array_equal(morphology._tile_kernel(1, True)(a), [[[np.nan] * 5]], equal_nan=True)


def test_component_boxes():
    labels = np.full((4, 5, 6), -1)
    labels[1, 2, 3:5] = 0
    labels[0:3, 4, 0] = 1
    assert dense.label_boxes(labels) == [(slice(1, 2), slice(2, 3), slice(3, 5)), (slice(0, 3), slice(4, 5), slice(0, 1))]


# linear scans, against brute force


def test_lower_envelope_is_the_least_parabola():
    rng = np.random.default_rng(1)
    for trial in range(200):
        length, n = rng.integers(1, 14), rng.integers(1, 6)
        f = rng.integers(0, 40, (length, n)).astype(float) if trial % 2 else rng.random((length, n)) * 30
        f[rng.random((length, n)) < 0.4] = np.inf
        square = (1.0, 2.25)[trial % 2]
        q = np.arange(length)
        every = square * (q[:, None, None] - q[None, :, None]) ** 2 + f[None]
        assert lower_envelope(f, square) == pytest.approx(every.min(axis=1), abs=1e-9)


def test_lower_envelope_of_odd_lines():
    f = np.array([[np.nan, np.inf, np.nan, 1e12], [np.nan, np.nan, 5.0, 0.0]])
    got = lower_envelope(f)
    assert np.isnan(got[:, 0]).all() and np.isinf(got[:, 1]).all() and got[:, 2].tolist() == [6, 5] and got[:, 3].tolist() == [1, 0]


def test_depth_map_is_the_least_distance(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((6, 7, 9)) > 0.6).astype(float)
    top = height(spark, a)
    got = array_of(surface.depth_map(field_of(spark, a), grid_of(a), z_radius=0, xy_radius=0, smooth=0, level=0.5, kernel=Kernel.MEAN), a.shape)
    z, y, x = np.indices(a.shape)
    hy, hx = np.indices(top.shape)
    every = np.sqrt((z[..., None, None] - top) ** 2 + (y[..., None, None] - hy) ** 2 + (x[..., None, None] - hx) ** 2).min(axis=(3, 4))
    assert got == pytest.approx(np.where(z > top, every, 0), abs=1e-9)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("radius", [1, 2, 5, 9, 30])
def test_running_extremes_by_scans(spark, radius, largest):
    rng = np.random.default_rng(radius)
    a = rng.random((2, 3, 23))
    a[0, 0, 4] = np.nan
    field = field_of(spark, a).where("x > 0 OR y > 0")  # one line begins at 1
    got, want = (stencil.extreme_axis(field, "x", radius, largest, engine).orderBy("z", "y", "x").toPandas() for engine in ("scans", "frame"))
    assert got.columns.tolist() == want.columns.tolist() and np.array_equal(got.v, want.v, equal_nan=True) and len(got) == len(want)


def test_trilinear_across_tiles(spark):
    rng = np.random.default_rng(3)
    a = rng.random((9, 17, 20))
    p = rng.random((300, 3)) * [22, 19, 11] - 1
    p[:20] = np.round(p[:20])
    points = spark.createDataFrame([("a", i, *map(float, q)) for i, q in enumerate(p)], "volume_id string, point_id int, px double, py double, pz double")
    got = {r.point_id: r.v for r in stencil.trilinear(field_of(spark, a), grid_of(a), points).collect()}
    for i, q in enumerate(p):
        c = [min(max(v, 0.0), e - 1.0) for v, e in zip(q[::-1], a.shape, strict=True)]
        low = [int(v) for v in c]
        high = [min(v + 1, e - 1) for v, e in zip(low, a.shape, strict=True)]
        f = [v - w for v, w in zip(c, low, strict=True)]
        want = sum(a[tuple(high[d] if k >> d & 1 else low[d] for d in range(3))] * np.prod([f[d] if k >> d & 1 else 1 - f[d] for d in range(3)]) for k in range(8))
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_trilinear_of_a_field_with_gaps(spark):
    a = np.arange(27.0).reshape(3, 3, 3)
    field = field_of(spark, a).where("x < 2 AND NOT (z = 0 AND y = 0 AND x = 1)")
    points = spark.createDataFrame([("a", 1, 0.5, 0.0, 0.0), ("a", 2, 0.5, 1.0, 0.0), ("a", 3, 2.0, 1.0, 1.0)], "volume_id string, point_id int, px double, py double, pz double")
    got = {r.point_id: r.v for r in stencil.trilinear(field, grid_of(a), points).collect()}
    assert got == {1: 0.0, 2: 3.5}
