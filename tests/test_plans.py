import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.volumes import field_of, grid_of

from voxstrata.model import Cancelled, Crop, Grid
from voxstrata.operators import labels, pointwise, resample, segmentation
from voxstrata.plans.components import connected_components
from voxstrata.plans.durable import DurableTable, shared_root
from voxstrata.plans.progress import listening
from voxstrata.sources import store, synthetic


def brute(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)] + [(3, 3), (None, 4), (5, None)],
        "path": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 500)] + [(1000, 999), (999, 1000)],
        "none": [],
    }[shape]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)


def test_durable_tables(spark):
    table = DurableTable(spark.range(10), "t")
    assert table.path.startswith(shared_root(spark)) and table.df.count() == 10
    table.drop()
    with pytest.raises(Exception):  # noqa: B017
        table.df.count()


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from voxstrata.model import InvalidState

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_root(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert shared_root(session("local[2]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(InvalidState):
            shared_root(session(master))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_channels_and_planes_are_pruned(spark, tmp_path):
    volume, grid = synthetic.composite(spark)
    store.write_collection(volume, str(tmp_path / "c"))
    collection = store.read_collection(spark, str(tmp_path / "c"), "voxels_view")
    assert sorted(map(tuple, collection.collect())) == sorted(map(tuple, volume.select("volume_id", "c", "z", "y", "x", "v").collect()))
    text = plan(resample.extract_xy(pointwise.select_channel(collection, 1), grid, 3))
    assert "PartitionFilters: [isnotnull(c" in text and "EqualTo(z,3)" in text and "Exchange" not in text
    assert spark.sql("SELECT count(*) FROM voxels_view WHERE c = 2").first()[0] == grid.voxels


def test_pointwise_operators_do_not_shuffle(spark, tmp_path):
    volume, grid = synthetic.ramp(spark)
    volume.write.parquet(str(tmp_path / "r"))
    field = spark.read.parquet(str(tmp_path / "r"))
    for made in (pointwise.window_level(field, 0, 1), pointwise.threshold(field, 0.5), pointwise.crop_mask(field, grid, Crop(1, 2), 0.0)):
        assert "Exchange" not in plan(made)


def test_one_shuffle_an_axis(spark, tmp_path):
    from voxstrata.operators.stencil import convolve_axis, extreme_axis

    synthetic.ramp(spark)[0].write.parquet(str(tmp_path / "r"))
    field = spark.read.parquet(str(tmp_path / "r"))
    for made in (convolve_axis(field, "x", [0.25, 0.5, 0.25]), extreme_axis(field, "z", 1, True)):
        assert plan(made).count("Exchange hashpartitioning") == 1


def test_grids():
    with pytest.raises(ValueError):
        Grid(0, 1, 1)
    with pytest.raises(ValueError):
        Grid(1, 1, 1, spacing=(1.0, 0.0, 1.0))
    assert Grid(2, 3, 4).voxels == 24 and F is not None


def test_rounds_are_reported_and_can_be_cancelled(spark):
    labels_ = field_of(spark, np.array([[[1, -1, -1, -1]]]), "label")
    heard = []
    with listening(lambda *said: heard.append(said)):
        labels.dilate(labels_, [1], 3)
    assert heard == [("dilate", 1, 3), ("dilate", 2, 3), ("dilate", 3, 3)]
    heard.clear()
    with pytest.raises(Cancelled), listening(lambda *said: heard.append(said) or said[1] == 2):
        labels.dilate(labels_, [1], 3)
    assert heard == [("dilate", 1, 3), ("dilate", 2, 3)]
    labels.dilate(labels_, [1], 2)
    assert len(heard) == 2


def test_watershed_on_tiles_reports_levels_and_exchanges(spark):
    a, seeds = np.zeros((1, 1, 8)), np.array([[[5, -1, -1, -1, -1, -1, -1, 6]]])
    chosen, heard = spark.createDataFrame([("a", 5), ("a", 6)], "volume_id string, label int"), []
    with listening(lambda *said: heard.append(said)):
        segmentation.watershed(field_of(spark, a), field_of(spark, seeds, "label"), grid_of(a), chosen, levels=3, engine="tiles", side=4)
    assert {stage for stage, _, _ in heard} == {"watershed"} and any(total == 3 for _, _, total in heard) and any(total is None for _, _, total in heard)
