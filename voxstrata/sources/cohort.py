"""Validation of a cohort: a manifest of cases, their files' hashes, and their agreement.

The manifest is JSON with a list of cases; files are read by Spark's binary
source, so any path that Spark reads will do.  Cases run as rows: one task hashes
and decodes a file, and metrics are computed over all cases of one grid at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError, Grid, InvalidArgument
from ..operators import metrics
from ..operators.volumes import from_arrays
from ..plans.durable import DurableTable
from .packages import coverage
from .tiff import MalformedFile, read_labels

_CASE = "case_id string, acquisition_id string, reference_kind string, channels int, voxel_type string, container string, spacing_z double, reference_path string, reference_sha256 string, candidate_path string, candidate_sha256 string, provenance string, input_sha256 string, reference_background int, candidate_background int, connectivity int"


def read_manifest(text: str) -> tuple[dict, list[tuple]]:
    """The manifest's head, and its cases in the order of ``_CASE``."""
    data = {k.lower(): v for k, v in json.loads(text).items()}
    version, commit = data.get("schemaversion"), data.get("candidatesourcecommit", "")
    if version not in (1, 2):
        raise InvalidArgument(f"no manifest schema {version}")
    if version == 2 and not re.fullmatch("[0-9a-fA-F]{40}", commit or ""):
        raise InvalidArgument("a schema-2 manifest names a whole commit")
    if not str(data.get("datasetname") or "").strip() or not isinstance(data.get("cases"), list):
        raise InvalidArgument("a manifest has a dataset name and cases")
    rows = []
    for case in data["cases"]:
        c = {k.lower(): v for k, v in case.items()}
        rows.append(
            (c.get("id", ""), c.get("acquisitionid", ""), c.get("referencekind", ""), int(c.get("channels", 0)), c.get("voxeltype", ""), c.get("container", ""), float(c.get("spacingz", 0)), c.get("referencelabelspath", ""), c.get("referencelabelssha256", "").lower(),
             c.get("candidatelabelspath", ""), c.get("candidatelabelssha256", "").lower(), c.get("candidateprovenance", ""), c.get("inputdecodedsha256", "").lower(), int(c.get("referencebackgroundlabel", 0)), int(c.get("candidatebackgroundlabel", 0)), int(c.get("objectconnectivity", 26)))
        )
    return {"dataset": data["datasetname"], "schema": version, "commit": commit}, rows


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, width, height, depth, sz, labels binary, error) of label stacks."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = raw.as_py()
                digest, row = hashlib.sha256(body).hexdigest(), [None] * 5
                try:
                    labels, stack = read_labels(body)
                    row = [stack.grid.width, stack.grid.height, stack.grid.depth, float(stack.grid.spacing[2]), labels.astype("<i4").tobytes()]
                    error = None
                except MalformedFile as problem:
                    error = str(problem)
                types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest]), *(pa.array([v], t) for v, t in zip(row, types, strict=True)), pa.array([error], pa.string())], names=["path", "sha256", "width", "height", "depth", "sz", "labels", "error"])

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.mapInArrow(run, "path string, sha256 string, width int, height int, depth int, sz double, labels binary, error string")


def _located(spark: SparkSession, base: str, wanted: list[str]) -> dict[str, str]:
    """Each path of the manifest that exists, by the name that Spark's file source gives it."""
    found, conf = {}, spark.sparkContext._jsc.hadoopConfiguration()
    for path in wanted:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{path}")
        store = where.getFileSystem(conf)
        if store.exists(where):
            found[store.makeQualified(where).toString()] = path
    return found


def _voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(case_id, labels, height, width) to (volume_id, z, y, x, label), a plane a batch."""
    import numpy as np

    for batch in batches:
        for row in batch.to_pylist():
            planes = np.frombuffer(row["labels"], "<i4").reshape(-1, row["height"], row["width"])
            for z in range(len(planes)):
                table = from_arrays(row["case_id"], {"label": planes[z : z + 1]}, z)
                yield from table.combine_chunks().to_batches()


def validate_cohort(spark: SparkSession, manifest: str, base: str, thresholds: metrics.Thresholds | None = None) -> dict:
    """{"passed", "coverage", "cases": [{case_id, passed, failures, metrics}]} for a manifest's text.

    Files are found by their path under ``base``.  The driver gets hashes,
    sizes and metrics; labels stay with the executors, and all cases of one
    size and one set of options are compared at once.
    """
    head, rows = read_manifest(manifest)
    cases = spark.createDataFrame(rows, _CASE)
    names = [r[0].lower() for r in rows]
    located = _located(spark, base, sorted({p for r in rows for p in (r[7], r[9]) if p}))
    stored = DurableTable(_files(spark, sorted(located)), "cohort") if located else None
    facts = stored.df.select("path", "sha256", "width", "height", "depth", "sz", "error", F.sha2("labels", 256).alias("payload_sha256")).collect() if stored else []
    files = {located[f.path]: f for f in facts}
    problems, groups = [], {}
    for number, r in enumerate(rows):
        failures = ["case id is repeated"] if names.count(r[0].lower()) > 1 else []
        pair = []
        for side, path, digest in (("reference", r[7], r[8]), ("candidate", r[9], r[10])):
            row = files.get(path)
            if row is None or row.error:
                failures.append(f"{side} labels can't be read")
                continue
            if row.sha256 != digest:
                failures.append(f"{side} labels have another hash")
            if abs(row.sz - r[6]) > 1e-6 * max(1, abs(r[6])):
                failures.append(f"{side} labels have another Z spacing")
            pair.append(row)
        failures += _provenance_failures(r, head["commit"], pair[1] if len(pair) == 2 else None)
        if len(pair) == 2:
            shapes = [(p.width, p.height, p.depth) for p in pair]
            if shapes[0] != shapes[1]:
                failures.append("label dimensions differ")
            else:
                groups.setdefault((*shapes[0], *r[13:16]), []).append((str(number), pair[0].path, pair[1].path))
        problems.append(failures)
    found = {}
    for (width, height, depth, reference_background, candidate_background, connectivity), members in groups.items():
        sides = []
        for side in (1, 2):
            named = spark.createDataFrame([(m[0], m[side]) for m in members], "case_id string, path string")
            # a row of two strings for each case of the manifest
            held = stored.df.join(F.broadcast(named), "path").select("case_id", "labels", "height", "width")
            sides.append(held.mapInArrow(_voxels, "volume_id string, z int, y int, x int, label int"))
        report = metrics.evaluate(*sides, Grid(width, height, depth), reference_background=reference_background, candidate_background=candidate_background, connectivity=connectivity, thresholds=thresholds)
        found |= {int(m.volume_id): m.asDict() for m in report.collect()}
    if stored:
        stored.drop()
    results = []
    for number, (r, failures) in enumerate(zip(rows, problems, strict=True)):
        own = found.get(number)
        failures = failures + (own["failures"] if own else [])
        results.append({"case_id": r[0], "passed": not failures, "failures": failures, "metrics": {**own, "volume_id": r[0]} if own else None})
    covered = coverage(cases)
    return {**head, "coverage": covered, "cases": results, "passed": covered["passed"] and all(c["passed"] for c in results)}


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """<manifest.json> [--output <report.json>]: writes a report; 0 if the gate is passed, 1 if not, 2 if it couldn't run."""
    if len(arguments) not in (1, 3) or len(arguments) == 3 and arguments[1].lower() != "--output":
        print("usage: python -m voxstrata.sources.cohort <manifest.json> [--output <report.json>]", file=sys.stderr)
        return 2
    try:
        manifest = Path(arguments[0]).resolve()
        target = Path(arguments[2]).resolve() if len(arguments) == 3 else manifest.with_suffix(".report.json")
        if target == manifest:
            raise InvalidArgument("the report must not overwrite the manifest")
        report = validate_cohort(spark or SparkSession.builder.getOrCreate(), manifest.read_text(), f"file://{manifest.parent}")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(report, indent=2, default=str))
    except (OSError, ValueError, TypeError, EngineError) as problem:
        print(f"validation could not run: {problem}", file=sys.stderr)
        return 2
    for case in report["cases"]:
        m = case["metrics"]
        told = f"dice={m['dice']:.6f}, objects={m['candidate_objects']}/{m['reference_objects']}, hd95={m['hausdorff95']}" if m else "metrics unavailable"
        print(f"[{'PASS' if case['passed'] else 'FAIL'}] {case['case_id']}: {told}", *(f"  - {f}" for f in case["failures"]), sep="\n")
    for failure in report["coverage"]["failures"]:
        print(f"coverage: {failure}")
    print("gate passed" if report["passed"] else "gate failed")
    return 0 if report["passed"] else 1


def _provenance_failures(case: tuple, commit: str, candidate) -> list[str]:
    if not case[11]:
        return []
    record, out = json.loads(case[11]) if isinstance(case[11], str) else case[11], []
    if record.get("schemaVersion") not in ("1.5", "1.6", "1.7", "1.8"):
        out.append("provenance has another schema")
    if commit and (record.get("schemaVersion") != "1.8" or str(record.get("sourceCommit", "")).lower() != commit.lower()):
        out.append("provenance is of another commit")
    if record.get("validationLevel") != "synthetic-data-validated":
        out.append("provenance has no validation level")
    if str(record.get("inputSha256", "")).lower() != case[12]:
        out.append("provenance is of another input")
    if record.get("inputChannels") != case[3] or str(record.get("inputVoxelType", "")).lower() != case[4].lower() or str(record.get("inputContainer", "")).lower() != case[5].lower():
        out.append("provenance has another input format")
    if candidate is not None:
        if (record.get("outputWidth"), record.get("outputHeight"), record.get("outputDepth")) != (candidate.width, candidate.height, candidate.depth):
            out.append("provenance has other output dimensions")
        if record.get("outputSha256") != candidate.payload_sha256:
            out.append("provenance is of another output")
    return out


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
