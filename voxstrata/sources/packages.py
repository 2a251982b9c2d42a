"""Result packages: raw payload, label stack and a provenance record for each volume.

A volume's planes are gathered in order in one task, which hashes and writes
them through Hadoop-independent file APIs of the sink given by the caller.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Grid, InvalidArgument
from ..operators.volumes import to_array
from .tiff import write_labels

SCHEMA_VERSION = "1.8"


def payload(array: np.ndarray) -> bytes:
    """Little-endian float32 or int32, x fastest."""
    return array.astype("<f4" if array.dtype.kind == "f" else "<i4").tobytes()


def payload_hash(array: np.ndarray) -> str:
    return hashlib.sha256(payload(array)).hexdigest()


def export(rows: DataFrame, grid: Grid, value: str, spacing: tuple[float, float, float] | None = None) -> DataFrame:
    """(volume_id, kind, payload binary, payload_sha256, label_tiff binary, label_bits) per volume."""
    labels = value == "label"

    def run(table: pa.Table) -> pa.Table:
        array = to_array(table, grid, value, np.int32 if labels else np.float32)
        tiff, bits = write_labels(array, spacing or grid.spacing, grid.unit) if labels else (None, None)
        return pa.table(
            {"volume_id": pa.array([table.column("volume_id")[0].as_py()]), "kind": pa.array(["i32" if labels else "f32"]), "payload": pa.array([payload(array)], pa.binary()), "payload_sha256": pa.array([payload_hash(array)]), "label_tiff": pa.array([tiff], pa.binary()), "label_bits": pa.array([bits], pa.int32())}
        )

    return rows.select("volume_id", "z", "y", "x", value).groupBy("volume_id").applyInArrow(run, "volume_id string, kind string, payload binary, payload_sha256 string, label_tiff binary, label_bits int")


def provenance(exported: DataFrame, source: DataFrame, grid: Grid, operation: dict, *, component_count: int = 0, source_commit: str = "unavailable", container: str = "memory-float32", voxel_type: str = "Float32", edits: Iterable[str] = (), origin: tuple[int, int, int] = (0, 0, 0), output_grid: Grid | None = None) -> DataFrame:
    """(volume_id, record): a JSON text per volume with hashes of its input and output."""
    out = output_grid or grid
    inputs = export(source, grid, "v").select("volume_id", F.col("payload_sha256").alias("input_sha256"))
    fixed = {
        "schemaVersion": SCHEMA_VERSION, "validationLevel": "synthetic-data-validated", "sourceCommit": source_commit, "createdAtUtc": datetime.now(UTC).isoformat(),
        "inputWidth": grid.width, "inputHeight": grid.height, "inputDepth": grid.depth, "inputChannels": grid.channels, "inputVoxelType": voxel_type, "inputContainer": container,
        "calibration": {"spacingX": grid.spacing[0], "spacingY": grid.spacing[1], "spacingZ": grid.spacing[2], "isCalibrated": grid.calibrated, "unitName": grid.unit},
        "operation": operation, "usedBackend": "spark", "outputWidth": out.width, "outputHeight": out.height, "outputDepth": out.depth,
        "outputOriginX": origin[0], "outputOriginY": origin[1], "outputOriginZ": origin[2], "componentCount": component_count, "editHistory": list(edits),
    }
    head = json.dumps(fixed)[:-1]
    body = F.concat(
        F.lit(head), F.lit(', "inputSha256": "'), "input_sha256", F.lit('", "outputSha256": "'), "payload_sha256", F.lit('", "outputKind": "'), F.when(F.col("kind") == "i32", "LabelsInt32").otherwise("VolumeFloat32"),
        F.lit('", "labelTiffEncoding": '), F.when(F.col("label_bits").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"SignedInt'), F.col("label_bits").cast("string"), F.lit('"'))), F.lit("}"),
    )
    return exported.join(inputs, "volume_id").select("volume_id", body.alias("record"))


def coverage(cases: DataFrame) -> dict:
    """What a validation cohort covers, and what it lacks.

    cases(case_id, acquisition_id, channels, voxel_type, container, spacing_z).
    """
    types = ("float32", "uint16", "uint8")
    need = {"case_id", "acquisition_id", "channels", "voxel_type", "spacing_z"} - set(cases.columns)
    if need:
        raise InvalidArgument(f"the cohort lacks columns {sorted(need)}")
    row = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct(F.when(F.trim("acquisition_id") != "", F.lower("acquisition_id"))).alias("acquisitions"),
        F.coalesce(F.max((F.col("channels") == 1).cast("int")), F.lit(0)).alias("single"), F.coalesce(F.max((F.col("channels") > 1).cast("int")), F.lit(0)).alias("multiple"),
        F.sort_array(F.collect_set(F.when(F.lower("voxel_type").isin(*types), F.lower("voxel_type")))).alias("types"), F.count_distinct(F.when(F.col("spacing_z") > 0, F.round("spacing_z", 9))).alias("spacings"),
    ).first()
    failures = []
    if row.cases < 5:
        failures.append("fewer than five cases")
    if row.acquisitions < 5:
        failures.append("fewer than five acquisitions")
    if not row.single:
        failures.append("no case with one channel")
    if not row.multiple:
        failures.append("no case with several channels")
    failures += [f"no {t} case" for t in types if t not in row.types]
    if row.spacings < 2:
        failures.append("fewer than two Z spacings")
    return {**row.asDict(), "passed": not failures, "failures": failures}


def write_package(exported: DataFrame, records: DataFrame, directory: str) -> DataFrame:
    """Writes <volume>.f32.raw or .i32.raw, a label stack and <volume>.json; returns (volume_id, path, bytes).

    ``directory`` is a URI that every executor reaches; each volume is written by
    one task, under a temporary name that is moved at the end, so a task that is
    run again leaves whole files only.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            store, root = fs.FileSystem.from_uri(directory)
            store.create_dir(root, recursive=True)
            rows = []
            for row in batch.to_pylist():
                stem = row["volume_id"].replace("/", "_")
                files = {f"{stem}.{row['kind']}.raw": row["payload"], f"{stem}.json": row["record"].encode()}
                if row["label_tiff"] is not None:
                    files[f"{stem}.labels.tif"] = row["label_tiff"]
                for name, body in files.items():
                    with store.open_output_stream(f"{root}/.{name}.part") as out:
                        out.write(body)
                    store.move(f"{root}/.{name}.part", f"{root}/{name}")
                    rows.append((row["volume_id"], f"{root}/{name}", len(body)))
            ids, paths, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["volume_id", "path", "bytes"])

    return exported.join(records, "volume_id").mapInArrow(run, "volume_id string, path string, bytes long")
