"""Stack decoding, label stacks, packages, cohorts and streams."""

import json
import struct
import zlib

import numpy as np
import pytest

from tests.volumes import field_of, grid_of
from voxstrata.sources import adapters, packages, synthetic, tiff
from voxstrata.streaming import arrivals


def lzw(data: bytes) -> bytes:
    """Single-byte codes with a clear code before the width would grow."""
    bits, n = [], 0
    for i, byte in enumerate(data):
        if i % 200 == 0:
            bits.append(256)
        bits.append(byte)
    bits.append(257)
    text = "".join(f"{c:09b}" for c in bits)
    text += "0" * (-len(text) % 8)
    del n
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def packbits(data: bytes) -> bytes:
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([len(part) - 1]) + part
    return out


def stack(pages, *, order="<", bits=16, form=1, compression=1, pack=lambda b: b, description=b"", photometric=1, predictor=1, extra=()):
    """A TIFF file of one-strip pages; extra: (page, tag, type, count, bytes)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    kind = np.dtype({(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4"}[bits, form]).newbyteorder(order)
    for n, page in enumerate(pages):
        page = np.asarray(page)
        data = pack(page.astype(kind).tobytes())
        own = [(tag, kind_, count, value) for p, tag, kind_, count, value in extra if p == n]
        entries = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, bits), (259, 3, 1, compression), (262, 3, 1, photometric), (273, 4, 1, None), (277, 3, 1, 1), (278, 4, 1, page.shape[0]), (279, 4, 1, len(data)), (317, 3, 1, predictor), (339, 3, 1, form)]
        if n == 0 and description:
            own.append((270, 2, len(description), description))
        at = len(out) + 2 + 12 * (len(entries) + len(own)) + 4
        blobs = b""
        rows = []
        for tag, kind_, count, value in own:
            if isinstance(value, bytes):
                rows.append((tag, kind_, count, at + len(blobs)))
                blobs += value
            else:
                rows.append((tag, kind_, count, value))
        rows += [(t, k, c, at + len(blobs) if v is None else v) for t, k, c, v in entries]
        out += struct.pack(order + "H", len(rows))
        for t, k, c, v in sorted(rows):
            out += struct.pack(order + "HHI", t, k, c) + (struct.pack(order + "HH", v, 0) if k == 3 and c == 1 else struct.pack(order + "I", v))
        end = at + len(blobs) + len(data)
        out += struct.pack(order + "I", end if n + 1 < len(pages) else 0) + blobs + data
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("bits", "form"), list(tiff.SAMPLES))
def test_sample_types(order, bits, form):
    pages = [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]
    got = tiff.read_stack(stack(pages, order=order, bits=bits, form=form))
    assert got.samples.tolist() == [pages] and got.voxel_type == tiff.SAMPLES[bits, form][0]


@pytest.mark.parametrize(("code", "pack"), [(5, lzw), (8, zlib.compress), (32946, zlib.compress), (8, lambda b: zlib.compress(b)[2:-4]), (32773, packbits)])
def test_compressions(code, pack):
    page = np.arange(-60, 60).reshape(10, 12) * 1000
    for order in "<>":
        assert (tiff.read_stack(stack([page], order=order, bits=32, form=2, compression=code, pack=pack)).samples[0, 0] == page).all()
    with pytest.raises(tiff.MalformedFile):
        tiff.read_stack(stack([page], bits=32, form=2, compression=code, pack=lambda b: pack(b[:-4])))


def test_predictor_and_inversion():
    page = np.array([[5, 7, 4], [1, 1, 9]])
    coded = np.diff(page, axis=1, prepend=0).astype("u2")
    assert (tiff.read_stack(stack([coded], predictor=2)).samples[0, 0] == page).all()
    assert (tiff.read_stack(stack([page], bits=8, photometric=0)).samples[0, 0] == 255 - page).all()


def test_image_description_orders_channels_first():
    text = b"ImageJ=1.53\nimages=4\nchannels=2\nslices=2\nspacing=1.5\nunit=um\npixel_width=0.25\npixel_height=0.5\n\0"
    got = tiff.read_stack(stack([[[10]], [[100]], [[20]], [[200]]], description=text))
    assert got.samples.ravel().tolist() == [10, 20, 100, 200]
    assert tiff.normalised(got).ravel().tolist() == [0.5, 1, 0.5, 1]
    assert got.grid.spacing == (0.25, 0.5, 1.5) and got.grid.unit == "um"
    with pytest.raises(tiff.MalformedFile):
        tiff.read_stack(stack([[[1]]], description=b"ImageJ=1\nframes=2\n\0"))


def test_microscope_block():
    block = struct.pack("<I", tiff.LSM_MAGICS[1]) + struct.pack("<i", 0) + struct.pack("<5i", 1, 1, 2, 2, 1) + b"\0" * 12 + struct.pack("<3d", 2e-7, 3e-7, 1e-6)
    thumbs = [(n, 254, 4, 1, 1) for n in (1, 3)]
    raw = stack([[[10]], [[9]], [[100]], [[9]], [[20]], [[200]]], extra=[(0, tiff.LSM_TAG, 7, len(block), block), *thumbs])
    got = tiff.read_stack(raw)
    assert got.container == "lsm" and got.samples.ravel().tolist() == [10, 20, 100, 200]
    assert got.grid.spacing == pytest.approx((0.2, 0.3, 1.0))


@pytest.mark.parametrize("raw", [b"", b"II*\0", b"XX*\0\x08\0\0\0", struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 0) + struct.pack("<I", 8)])
def test_malformed_files(raw):
    with pytest.raises(tiff.MalformedFile):
        tiff.read_stack(raw)


@pytest.mark.parametrize(("top", "bits"), [(32767, 16), (32768, 32), (1_000_000, 32)])
def test_label_stack_round_trip(top, bits):
    labels = np.arange(24).reshape(2, 3, 4) - 1
    labels[1, 2, 3] = top
    raw, used = tiff.write_labels(labels, (0.25, 0.5, 1.75), "um")
    got, info = tiff.read_labels(raw)
    assert used == bits and (got == labels).all()
    assert info.grid.spacing == (0.25, 0.5, 1.75) and info.grid.unit == "um"


def test_scan(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(stack([[[1, 2], [3, 4]], [[5, 6], [7, 8]]]))
    planes = tiff.scan_stacks(spark, str(tmp_path))
    got = tiff.planes_to_voxels(planes).orderBy("z", "y", "x").collect()
    assert [r.v for r in got] == pytest.approx([k / 8 for k in range(1, 9)])


def test_package_and_provenance(spark):
    a = np.arange(24).reshape(2, 3, 4) % 5 - 1
    labels, field, grid = field_of(spark, a, "label"), field_of(spark, a), grid_of(a)
    exported = packages.export(labels, grid, "label")
    row = exported.collect()[0]
    assert (np.frombuffer(row.payload, "<i4").reshape(a.shape) == a).all()
    assert (tiff.read_labels(bytes(row.label_tiff))[0] == a).all()
    record = json.loads(packages.provenance(exported, field, grid, {"operation": "components"}, component_count=5).collect()[0].record)
    assert record["outputSha256"] == row.payload_sha256 and record["labelTiffEncoding"] == "SignedInt16" and record["schemaVersion"] == "1.8"


def test_cohort_coverage(spark):
    kinds = ["uint8", "uint16", "float32", "uint8", "float32"]
    cases = [(f"c{i}", f"a{i}", 1 + i % 2, kinds[i], "tiff", 1.0 + i % 2) for i in range(5)]
    columns = "case_id string, acquisition_id string, channels int, voxel_type string, container string, spacing_z double"
    assert packages.coverage(spark.createDataFrame(cases, columns))["passed"]
    assert len(packages.coverage(spark.createDataFrame(cases[:1], columns))["failures"]) == 6


def test_synthetic_volumes(spark):
    assert synthetic.impulse(spark)[0].where("v > 0").count() == 1
    assert synthetic.touching(spark)[0].where("v > 0").count() == 3
    assert synthetic.noise(spark)[0].count() == 32 * 24 * 12
    assert synthetic.shell(spark)[0].where("v > 0").count() > 0
    assert synthetic.composite(spark)[0].groupBy("c").max("v").count() == 3


def test_stream_of_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 0, 1, 0.0), ("a", 1, 0, 0, 2.0)], "volume_id string, z int, y int, x int, v double").selectExpr("*", "TIMESTAMP '2024-01-01 00:00:00' AS arrived")
    rows.write.parquet(str(tmp_path / "in"))
    stream = arrivals.plane_sums(arrivals.read_arrivals(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("planes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.z, r.voxels, r.foreground, r.total) for r in spark.table("planes").collect()) == [(0, 2, 1, 1.0), (1, 1, 1, 2.0)]


def test_events_grid_follows_the_table(spark, tmp_path):
    inside = [(f"k{i}", i, f"2024-01-{i + 1:02d} 05:00:00") for i in range(5)]
    more = {"in": ([], 30, 5), "day": ([("k0", -1, "2024-01-31 05:00:00")], 31, 5), "type": ([("k9", 1, "2024-01-02 05:00:00")], 30, 6)}
    for name, (rows, days, kinds) in more.items():
        table = spark.createDataFrame(inside + rows, "event_type string, user_id long, ts string")
        table.selectExpr("event_type", "user_id", "cast(ts as timestamp) AS ts").write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = adapters.event_volume(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == 24 * days * 8 * kinds and sum(r.v for r in got) == 5 + len(rows)


@pytest.mark.parametrize("row", [(None, 1, "2024-01-02 05:00:00"), ("k0", None, "2024-01-02 05:00:00"), ("k0", 1, None)])
def test_events_with_nulls_are_an_error(spark, tmp_path, row):
    table = spark.createDataFrame([("k0", 1, "2024-01-02 05:00:00"), row], "event_type string, user_id long, ts string")
    table.selectExpr("event_type", "user_id", "cast(ts as timestamp) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(Exception, match="outside the grid"):
        adapters.event_volume(spark, str(tmp_path)).collect()
