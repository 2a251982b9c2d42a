import hashlib
import json

import numpy as np
import pytest
from tests.volumes import array_of, field_of, grid_of

from voxstrata.engine import Engine, Operation, Output
from voxstrata.model import Crop, Grid, InvalidArgument, InvalidState, Kernel
from voxstrata.sources import cohort, packages, tiff


@pytest.fixture
def engine(spark):
    a = np.fromfunction(lambda z, y, x: (3 * x + 5 * y + 7 * z) % 11 / 10, (3, 4, 5))
    e = Engine(spark)
    e.set_volume(field_of(spark, a).selectExpr("*", "0 AS c"), grid_of(a))
    return e


PARAMETERS = {
    Operation.EXTRACT_XY: {"index": 1}, Operation.EXTRACT_YZ: {"index": 1}, Operation.EXTRACT_ZX: {"index": 1},
    Operation.RESAMPLE_AREA: {"target_spacing": 0.5}, Operation.RESAMPLE_LANCZOS: {"target_spacing": 0.5, "order": 2},
    Operation.THRESHOLD_SWEEP: {"low": 0.4, "high": 0.8, "step": 0.4, "closing": 0}, Operation.DIRECTIONAL_THRESHOLD: {"radius": 1, "level": 1},
    Operation.DIRECTIONAL_SEGMENTATION: {"radius": 1, "level": 1, "low": -0.1, "high": 0.0, "step": 0.1, "closing": 0},
}


@pytest.mark.parametrize("operation", list(Operation))
def test_every_operation_runs(spark, engine, operation):
    if operation == Operation.WATERSHED:
        with pytest.raises(InvalidState):
            engine.run(operation)
        seeds = np.full((3, 4, 5), -1)
        seeds[0, 0, 0], seeds[2, 3, 4] = 1, 2
        engine.set_labels(field_of(spark, seeds, "label"), [1, 2])
    got = engine.run(operation, **PARAMETERS.get(operation, {}))
    size = got.grid.width * got.grid.height * (1 if got.kind == Output.IMAGE else got.grid.depth)
    assert got.data.count() == size


def test_state_is_checked_and_kept(spark, engine):
    before = engine.grid
    with pytest.raises(InvalidArgument):
        engine.set_volume(field_of(spark, np.ones((1, 2, 2))).selectExpr("*", "0 AS c"), Grid(3, 3, 3))
    with pytest.raises(InvalidArgument):
        engine.set_labels(field_of(spark, np.full((3, 4, 5), -1), "label"), [4])
    with pytest.raises(InvalidArgument):
        engine.run(99)
    with pytest.raises(InvalidState):
        Engine(spark).run(Operation.COPY)
    assert engine.grid is before and engine.backend()["name"] == "spark"
    assert engine.estimate(radius=2, level=1)["directions"] == 21


def test_crop_reaches_segmentations(spark, engine):
    engine.set_crop(Crop(1, 1, 1))
    labels = array_of(engine.run(Operation.THRESHOLD_SWEEP, low=0.4, high=0.4, step=0.4, closing=0).data, (3, 4, 5), "label")
    assert (labels[0] == -1).all() and (labels[:, 0] == -1).all()


def test_components_and_tags(engine):
    with engine.cancellable("t"):
        got = engine.run(Operation.CONNECTED_COMPONENTS, threshold=0.9, connectivity=26)
        assert got.component_count().first().components > 0
    with pytest.raises(InvalidArgument):
        engine.run(Operation.ADAPTIVE_2D, radius=101, kernel=Kernel.MEAN)


def test_cohort_of_label_stacks(spark, tmp_path):
    kinds, cases = ["uint8", "uint16", "float32", "uint8", "float32"], []
    for i in range(5):
        labels = np.zeros((2, 3, 4), int)
        labels[0, 1, 1:3] = 1
        spacing = (1.0, 1.0, 1.0 + i % 2)
        raw, _ = tiff.write_labels(labels, spacing, "um")
        for side in ("reference", "candidate"):
            (tmp_path / side).mkdir(exist_ok=True)
            (tmp_path / side / f"{i}.tif").write_bytes(raw)
        digest = hashlib.sha256(raw).hexdigest()
        cases.append({"id": f"c{i}", "acquisitionId": f"a{i}", "channels": 1 + i % 2, "voxelType": kinds[i], "container": "tiff", "spacingZ": spacing[2], "referenceLabelsPath": f"reference/{i}.tif", "referenceLabelsSha256": digest, "candidateLabelsPath": f"candidate/{i}.tif", "candidateLabelsSha256": digest})
    manifest = {"schemaVersion": 1, "datasetName": "d", "cases": cases}
    good = cohort.validate_cohort(spark, json.dumps(manifest), str(tmp_path))
    assert good["passed"], good
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert cohort.main([str(tmp_path / "m.json")], spark) == 0 and json.loads((tmp_path / "m.report.json").read_text())["passed"]
    # another content under the same base name is another file
    other = np.zeros((2, 3, 4), int)
    other[1, 2, 3] = 7
    raw, _ = tiff.write_labels(other, (1.0, 1.0, 1.0), "um")
    (tmp_path / "candidate/0.tif").write_bytes(raw)
    kept, cases[0]["candidateLabelsSha256"] = cases[0]["candidateLabelsSha256"], hashlib.sha256(raw).hexdigest()
    worse = cohort.validate_cohort(spark, json.dumps(manifest), str(tmp_path))["cases"]
    assert [c["passed"] for c in worse] == [False, True, True, True, True] and "dice" in worse[0]["failures"]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert cohort.main([str(tmp_path / "m.json"), "--output", str(tmp_path / "out/r.json")], spark) == 1 and (tmp_path / "out/r.json").exists()
    assert cohort.main([], spark) == 2 and cohort.main([str(tmp_path / "none.json")], spark) == 2 and cohort.main([str(tmp_path / "m.json"), "--output", str(tmp_path / "m.json")], spark) == 2
    cases[0]["candidateLabelsPath"] = "candidate/none.tif"
    assert cohort.validate_cohort(spark, json.dumps(manifest), str(tmp_path))["cases"][0]["failures"] == ["candidate labels can't be read"]
    cases[0]["candidateLabelsPath"] = "reference/0.tif"
    cases[0]["candidateLabelsSha256"] = "0" * 64
    bad = cohort.validate_cohort(spark, json.dumps(manifest), str(tmp_path))
    assert not bad["passed"] and bad["cases"][0]["failures"] == ["candidate labels have another hash"]
    for wrong in ({**manifest, "schemaVersion": 3}, {**manifest, "schemaVersion": 2, "candidateSourceCommit": "x"}, {**manifest, "datasetName": " "}):
        with pytest.raises(InvalidArgument):
            cohort.validate_cohort(spark, json.dumps(wrong), str(tmp_path))


def test_package_files(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4) % 5 - 1
    labels, field, grid = field_of(spark, a, "label"), field_of(spark, a), grid_of(a)
    exported = packages.export(labels, grid, "label")
    records = packages.provenance(exported, field, grid, {"operation": "components"})
    packages.write_package(exported, records, f"file://{tmp_path}/p").collect()
    assert (np.fromfile(tmp_path / "p/a.i32.raw", "<i4").reshape(a.shape) == a).all()
    assert json.loads((tmp_path / "p/a.json").read_text())["outputSha256"] == packages.payload_hash(a.astype(np.int32))
    assert (tiff.read_labels((tmp_path / "p/a.labels.tif").read_bytes())[0] == a).all()
