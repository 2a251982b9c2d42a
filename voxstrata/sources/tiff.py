"""Classic TIFF stacks: metadata, sample decoding, label volumes.

One file is one task.  ``read_stack`` decodes a file's pages to a planar array;
``scan_stacks`` is the Spark source, ``write_labels`` makes a label stack that
``read_labels`` and image tools read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError, Grid, InvalidArgument

MAX_FIELDS = 4096
MAX_PAGES = 1_000_000
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: (bits, sample format) to the name and NumPy kind of a sample.
SAMPLES = {(8, 1): ("uint8", "u1"), (16, 1): ("uint16", "u2"), (16, 2): ("int16", "i2"), (32, 1): ("uint32", "u4"), (32, 2): ("int32", "i4"), (32, 3): ("float32", "f4")}
LSM_TAG = 34412
#: The two numbers that open the metadata block of an LSM file.
LSM_MAGICS = (0x00300494C, 0x00400494C)


class MalformedFile(EngineError, OSError):
    pass


@dataclass
class Page:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        value = self.tags.get(tag)
        if not value:
            if default is None:
                raise MalformedFile(f"tag {tag} is missing")
            return default
        return value[0]


def _take(raw: bytes, at: int, size: int) -> bytes:
    if at < 0 or at + size > len(raw):
        raise MalformedFile("the file ends too early")
    return raw[at : at + size]


def pages(raw: bytes) -> list[Page]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", _take(raw, 2, 2))[0] != 42:
        raise MalformedFile("not a classic TIFF file")
    at = struct.unpack(order + "I", _take(raw, 4, 4))[0]
    seen, out = set(), []
    while at:
        if at in seen or len(out) >= MAX_PAGES:
            raise MalformedFile("the directories form a circle")
        seen.add(at)
        count = struct.unpack(order + "H", _take(raw, at, 2))[0]
        if count > MAX_FIELDS:
            raise MalformedFile("a directory has too many fields")
        page = Page(order)
        for i in range(count):
            tag, kind, n, _ = struct.unpack(order + "HHII", _take(raw, at + 2 + 12 * i, 12))
            size = _SIZES.get(kind, 0) * n
            if not size:
                continue
            where = at + 2 + 12 * i + 8
            if size > 4:
                where = struct.unpack(order + "I", _take(raw, where, 4))[0]
            data = _take(raw, where, size)
            if kind in (5, 10):
                parts = struct.unpack(order + ("I" if kind == 5 else "i") * (2 * n), data)
                page.tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True))
            elif kind in (2, 7):
                page.tags[tag] = (data,)
            else:
                page.tags[tag] = struct.unpack(order + _CODES[kind] * n, data)
        out.append(page)
        at = struct.unpack(order + "I", _take(raw, at + 2 + 12 * count, 4))[0]
    if not out:
        raise MalformedFile("the file has no pages")
    return out


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes are 9 to 12 bits, high bits first; the width grows one code early."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, width, bits, held, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == end:
            break
        if code == clear:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise MalformedFile("LZW data doesn't start with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise MalformedFile("an LZW code is out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        try:
            return zlib.decompress(data, -15)
        except zlib.error as error:
            raise MalformedFile("deflate data is damaged") from error


def sample_kind(page: Page) -> tuple[str, str]:
    if page.one(277, 1) != 1:
        raise MalformedFile("only one sample a pixel is supported")
    kind = SAMPLES.get((page.one(258, 1), page.one(339, 1)))
    if kind is None:
        raise MalformedFile(f"no sample type of {page.one(258, 1)} bits and format {page.one(339, 1)}")
    return kind


def decode_page(raw: bytes, page: Page) -> np.ndarray:
    width, height = page.one(256), page.one(257)
    _, code = sample_kind(page)
    kind = np.dtype(code).newbyteorder(page.order)
    compression, predictor = page.one(259, 1), page.one(317, 1)
    offsets, sizes = page.tags.get(273), page.tags.get(279)
    if not offsets or not sizes or len(offsets) != len(sizes):
        raise MalformedFile("strip tables are missing or differ")
    rows_per_strip = min(page.one(278, height), height)
    out, row = np.empty((height, width), kind.newbyteorder("=")), 0
    for at, size in zip(offsets, sizes, strict=True):
        rows = min(rows_per_strip, height - row)
        want, data = rows * width * kind.itemsize, _take(raw, at, size)
        if compression == 5:
            data = unpack_lzw(data, want)
        elif compression in (8, 32946):
            data = _inflate(data)
        elif compression == 32773:
            data = unpack_bits(data, want)
        elif compression != 1:
            raise MalformedFile(f"no decoder for compression {compression}")
        if rows <= 0 or len(data) != want:
            raise MalformedFile(f"a strip has {len(data)} bytes, not {want}")
        block = np.frombuffer(data, kind).reshape(rows, width).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        elif predictor != 1:
            raise MalformedFile(f"no predictor {predictor}")
        out[row : row + rows] = block
        row += rows
    if row != height:
        raise MalformedFile("strips don't cover the page")
    if page.one(262, 1) == 0 and out.dtype.kind in "iu":
        info = np.iinfo(out.dtype)
        out = (info.max - out.astype(np.int64) + info.min).astype(out.dtype)
    elif page.one(262, 1) not in (0, 1):
        raise MalformedFile("only grey images are supported")
    return out


def image_description(page: Page) -> dict[str, str]:
    text = page.tags.get(270, (b"",))[0].split(b"\0")[0].decode("latin-1")
    if not text.lower().startswith("imagej="):
        return {}
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line)
    return {key.strip().lower(): value.strip() for key, value in pairs}


@dataclass
class Stack:
    samples: np.ndarray  # (channels, depth, height, width), as stored
    grid: Grid
    voxel_type: str
    container: str


def read_stack(raw: bytes) -> Stack:
    """Full-size pages in file order, channel fastest, as a planar array."""
    full = [p for p in pages(raw) if not p.one(254, 0) & 1]
    if not full:
        raise MalformedFile("the file has thumbnails only")
    first = full[0]
    width, height = first.one(256), first.one(257)
    lsm, spacing, calibrated, unit, container = first.tags.get(LSM_TAG), (1.0, 1.0, 1.0), False, "pixel", "tiff"
    channels = 1
    if lsm:
        block = lsm[0] if isinstance(lsm[0], bytes) else bytes(x & 255 for x in lsm)
        if len(block) < 64 or struct.unpack("<I", block[:4])[0] not in LSM_MAGICS:
            raise MalformedFile("the LSM block is not valid")
        _, _, depth, channels, times = struct.unpack("<5i", block[8:28])
        if times > 1:
            raise MalformedFile("time series are not supported")
        metres = struct.unpack("<3d", block[40:64])
        if all(m > 0 for m in metres):
            spacing, calibrated, unit = tuple(m * 1e6 for m in metres), True, "um"
        container = "lsm"
        full = [p for p in full if (p.one(256), p.one(257)) == (width, height)]
    else:
        text = image_description(first)
        if int(text.get("frames", "1")) != 1:
            raise MalformedFile("time series are not supported")
        channels = int(text.get("channels", "1"))
        depth = int(text.get("slices", str(max(1, len(full) // max(1, channels)))))
        if text:
            container = "imagej-tiff"

            def size(tag: int, key: str) -> float:
                density = first.tags.get(tag, (0.0,))[0]
                return float(text[key]) if key in text else 1 / density if density > 0 else 1.0

            spacing = (size(282, "pixel_width"), size(283, "pixel_height"), float(text.get("spacing", "1")))
            unit = text.get("unit", "pixel").replace("\\u00B5m", "um").replace("micron", "um")
            calibrated = unit not in ("pixel", "")
    if channels < 1 or depth < 1 or len(full) != channels * depth:
        raise MalformedFile(f"{len(full)} pages for {channels} channels and {depth} slices")
    kinds = {(sample_kind(p), p.one(256), p.one(257)) for p in full}
    if len(kinds) != 1:
        raise MalformedFile("pages differ in size or type")
    planes = np.stack([decode_page(raw, p) for p in full])
    samples = planes.reshape(depth, channels, height, width).swapaxes(0, 1)
    return Stack(np.ascontiguousarray(samples), Grid(width, height, depth, channels, spacing=spacing, calibrated=calibrated, unit=unit or "pixel"), sample_kind(first)[0], container)


def normalised(stack: Stack) -> np.ndarray:
    """float32 samples, each channel divided by its greatest magnitude; non-finite samples are refused."""
    values = stack.samples.astype(np.float32)
    if not np.isfinite(values).all():
        raise MalformedFile("the file has samples that are not finite")
    peak = np.abs(values).max(axis=(1, 2, 3), keepdims=True)
    return np.where(peak > 0, values / np.where(peak > 0, peak, 1), values).astype(np.float32)


def check_budget(size: int, available: int, part: float = 0.75) -> None:
    if size > available * part:
        raise InvalidArgument(f"{size} bytes are above {part:.0%} of the {available} available")


def scan_stacks(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, width, height, depth, channels, voxel_type, container, sx, sy, sz, calibrated, unit, c, z, plane)
    of every stack under path: a row per plane, ``plane`` an array of normalised samples."""
    names = "volume_id width height depth channels voxel_type container sx sy sz calibrated unit c z plane".split()
    schema = "volume_id string, width int, height int, depth int, channels int, voxel_type string, container string, sx double, sy double, sz double, calibrated boolean, unit string, c int, z int, plane array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                stack = read_stack(raw.as_py())
                g, values = stack.grid, normalised(stack)
                for c in range(g.channels):
                    for z in range(g.depth):
                        row = [name.as_py(), g.width, g.height, g.depth, g.channels, stack.voxel_type, stack.container, *map(float, g.spacing), g.calibrated, g.unit, c, z]
                        types = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), *[pa.float64()] * 3, pa.bool_(), pa.string(), pa.int32(), pa.int32()]
                        arrays = [pa.array([v], t) for v, t in zip(row, types, strict=True)]
                        yield pa.RecordBatch.from_arrays([*arrays, pa.array([values[c, z].ravel()], pa.list_(pa.float32()))], names=names)

    # one file a batch, as a file is held whole
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def planes_to_voxels(planes: DataFrame) -> DataFrame:
    rows = planes.select("volume_id", "c", "z", "width", F.posexplode("plane").alias("i", "v"))
    return rows.select("volume_id", "c", "z", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def write_labels(labels: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), unit: str = "pixel", bits: int | None = None) -> tuple[bytes, int]:
    """A little-endian stack of signed labels, one strip a page, and its bits a sample."""
    depth, height, width = labels.shape
    fits = labels.size == 0 or (-32768 <= labels.min() and labels.max() <= 32767)
    bits = bits or (16 if fits else 32)
    if bits == 16 and not fits:
        raise InvalidArgument("a label doesn't fit 16 bits")
    text = f"ImageJ=1.53\nimages={depth}\nslices={depth}\nspacing={spacing[2]!r}\nunit={unit}\npixel_width={spacing[0]!r}\npixel_height={spacing[1]!r}\n".encode("ascii") + b"\0"
    text += b"\0" * (len(text) % 2)
    data = labels.astype("<i2" if bits == 16 else "<i4")
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for z in range(depth):
        entries = [(254, 4, 1, 0 if z == 0 else 2), (256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 1)]
        count = 16 if z == 0 else 15
        extra = len(out) + 2 + 12 * count + 4
        x_at, y_at = extra, extra + 8
        text_at = extra + 16
        pixels = text_at + (len(text) if z == 0 else 0)
        page = data[z].tobytes()
        if z == 0:
            entries.append((270, 2, len(text), text_at))
        entries += [(273, 4, 1, pixels), (274, 3, 1, 1), (277, 3, 1, 1), (278, 4, 1, height), (279, 4, 1, len(page)), (282, 5, 1, x_at), (283, 5, 1, y_at), (296, 3, 1, 1), (339, 3, 1, 2)]
        assert len(entries) == count
        out += struct.pack("<H", count)
        for tag, kind, n, value in entries:
            out += struct.pack("<HHII", tag, kind, n, value)
        end = pixels + len(page)
        out += struct.pack("<I", end if z + 1 < depth else 0)
        for size in spacing[:2]:
            scale = 1_000_000
            out += struct.pack("<II", max(1, round(scale / size)), scale)
        if z == 0:
            out += text
        out += page
    return bytes(out), bits


def read_labels(raw: bytes) -> tuple[np.ndarray, Stack]:
    stack = read_stack(raw)
    if stack.voxel_type not in ("int16", "int32") or stack.grid.channels != 1:
        raise MalformedFile("a label stack has one channel of signed integers")
    return stack.samples[0].astype(np.int32), stack


def decode_label_stacks(stacks: DataFrame) -> DataFrame:
    """stacks(volume_id, content binary) to (volume_id, z, y, x, label, bits, sx, sy, sz)."""
    from ..operators.volumes import from_arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                labels, stack = read_labels(raw.as_py())
                for z in range(len(labels)):
                    table = from_arrays(name, {"label": labels[z : z + 1]}, z).combine_chunks()
                    table = table.append_column("bits", pa.repeat(pa.scalar(16 if stack.voxel_type == "int16" else 32, pa.int32()), len(table)))
                    for axis, size in zip("xyz", stack.grid.spacing, strict=True):
                        table = table.append_column(f"s{axis}", pa.repeat(pa.scalar(float(size), pa.float64()), len(table)))
                    yield from table.to_batches()

    return stacks.mapInArrow(run, "volume_id string, z int, y int, x int, label int, bits int, sx double, sy double, sz double")
