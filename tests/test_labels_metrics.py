"""Label editing and agreement metrics."""

import math

import numpy as np
import pytest
from tests.volumes import array_of, field_of, grid_of

from voxstrata.model import Grid, InvalidState
from voxstrata.operators import labels, metrics


def test_split_merge_undo(spark):
    a = np.full((1, 3, 5), -1)
    a.ravel()[[0, 1, 14]] = 4
    session = labels.LabelSession(field_of(spark, a, "label"), grid_of(a))
    assert session.select([4, 9, -1]) == [4]
    assert session.split() == 1
    session.select([4, 5])
    session.merge()
    assert session.selection == [4] and session.labels.where("label >= 0").select("label").distinct().count() == 1
    assert session.undo() and session.labels.where("label >= 0").select("label").distinct().count() == 2
    session.clear_selection()
    with pytest.raises(InvalidState):
        session.merge()


def test_dilate_then_erode(spark):
    a = np.full((3, 3, 3), -1)
    a[1, 1, 1] = 2
    session = labels.LabelSession(field_of(spark, a, "label"), grid_of(a))
    session.select_at(1, 1, 1)
    session.dilate()
    assert session.labels.where("label = 2").count() == 7
    session.erode()
    assert session.labels.where("label = 2").count() == 1


def test_crop_and_undo(spark):
    a = np.full((3, 5, 5), -1)
    a[1:3, 2:4, 1:3] = 7
    a[0, 0, 0] = 3
    session = labels.LabelSession(field_of(spark, a, "label"), grid_of(a))
    session.select([7])
    assert session.crop() == (1, 2, 1)
    assert (session.grid.width, session.grid.height, session.grid.depth) == (2, 2, 2)
    session.undo()
    assert (array_of(session.labels, a.shape, "label") == a).all()


def report(spark, a, b, **options):
    return metrics.evaluate(field_of(spark, a, "label"), field_of(spark, b, "label"), grid_of(a), **options).collect()[0]


def test_identical_objects_with_other_ids(spark):
    a = np.zeros((3, 5, 5), int)
    a[0, 0, 0:2], a[2, 4, 3:5] = 1, 2
    got = report(spark, a, np.where(a > 0, a + 7, 0))
    assert (got.dice, got.reference_objects, got.candidate_objects, got.hausdorff95, got.passed) == (1, 2, 2, 0, True)


@pytest.mark.parametrize("shift", [1, 2])
def test_shifted_objects(spark, shift):
    a = np.zeros((3, 3, 7), int)
    a[1, 1, 1] = 1
    assert report(spark, a, np.roll(a, shift, axis=2)).hausdorff95 == shift


@pytest.mark.parametrize(("connectivity", "n"), [(6, 2), (18, 2), (26, 1)])
def test_object_connectivity(spark, connectivity, n):
    a = np.zeros((2, 2, 2), int)
    a[0, 0, 0] = a[1, 1, 1] = 1
    assert metrics.object_count(field_of(spark, a, "label"), grid_of(a), connectivity).collect()[0].objects == n


def test_empty_masks(spark):
    none, one = np.zeros((3, 3, 3), int), np.zeros((3, 3, 3), int)
    one[1, 1, 1] = 1
    both = report(spark, none, none)
    assert (both.dice, both.hausdorff95, both.passed) == (1, 0, True)
    half = report(spark, none, one)
    assert half.hausdorff95 is None and half.volume_difference == 1 and not half.passed


def test_calibrated_volume(spark):
    a = np.array([[[-1, 2], [2, -1]]])
    grid = Grid(2, 2, 1, spacing=(2.0, 3.0, 4.0), calibrated=True, unit="um")
    f = field_of(spark, a, "label")
    got = metrics.evaluate(f, f, grid, reference_background=-1, candidate_background=-1).collect()[0]
    assert (got.reference_volume, got.unit) == (48, "um^3")


def brute_hausdorff(a, b):
    def surface(m):
        p = np.pad(m, 1)
        core = np.ones(m.shape, bool)
        for axis in range(3):
            for d in (-1, 1):
                core &= np.roll(p, d, axis)[1:-1, 1:-1, 1:-1]
        return np.argwhere(m & ~core)

    s, t = surface(a > 0), surface(b > 0)
    if not len(s) and not len(t):
        return 0.0
    if not len(s) or not len(t):
        return None
    d = np.sqrt(((s[:, None] - t[None]) ** 2).sum(axis=2))
    rank = lambda v: np.sort(v)[max(0, math.ceil(len(v) * 0.95) - 1)]
    return max(rank(d.min(axis=1)), rank(d.min(axis=0)))


def test_hausdorff_against_brute_force(spark):
    rng = np.random.default_rng(7319)
    for _ in range(5):
        a, b = ((rng.random((3, 4, 5)) < 0.18).astype(int) for _ in range(2))
        got = metrics.hausdorff95(field_of(spark, a, "label"), field_of(spark, b, "label"), grid_of(a)).collect()[0].hausdorff95
        expected = brute_hausdorff(a, b)
        assert got == (None if expected is None else pytest.approx(expected))


def test_objects_of_any_labels(spark):
    """Labels of any size and sign; touching ones of different labels are two objects."""
    a = np.zeros((1, 1, 8), np.int64)
    a[0, 0, :] = [0, -2_000_000_000, 2_000_000_000, 2_000_000_000, -1, 0, 5, -5]
    got = metrics.object_count(field_of(spark, a, "label"), grid_of(a), 26).first().objects
    assert got == 5
