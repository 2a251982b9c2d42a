"""Fill-in-the-middle transformation by a sparse checkpoint index.

A text is cut into units (white space and the word behind it).  While its units
are counted, block by block, the byte and code-point offset of every
``EVERY``-th unit is recorded.  A cut at unit u is then found by a binary search
among the checkpoints and a short scan from there, so neither the units nor
their offsets are ever listed and memory beyond the text itself is one block
and n / ``EVERY`` checkpoints.  Rows are independent: there is no shuffle.

The cuts and the form come from SHA-256 of the seed and the document's id, so
reruns agree.  The output is unambiguous: a text that contains a sentinel stays
as it is, so the sentinels in an output with parts are the ones put there, and
``restored`` gives the text back by expressions.

Defined cases: a null text is an empty one; empty texts have 0 units and stay
plain; a text of white space only is one unit; very long texts are read whole;
parts may be empty; a null id is hashed as the empty string; rows that repeat
an id get cuts from the same hash; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import code_points, text_chunks, unit_ends

SEED = 42
#: Units between two checkpoints.
EVERY = 256
#: Bytes scanned at a time.
BLOCK = 1 << 20
#: Of 100 documents, how many are transformed, and of those how many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of outputs sent at a time.
SEND_BYTES = 1 << 25


class Checkpoints:
    """Offsets of every ``every``-th unit of a text in UTF-8."""

    def __init__(self, data: np.ndarray, every: int = EVERY, block: int = BLOCK):
        self.data, self.every, self.block = data, every, block
        self.units, self.bytes, self.points = [0], [0], [0]
        self.n = 0
        at = points = 0
        for ends in self._blocks(0, len(data)):
            for end in ends[every - 1 - self.n % every :: every].tolist():
                points += code_points(data[at:end])
                at = end
                self.units.append(self.units[-1] + every)
                self.bytes.append(end)
                self.points.append(points)
            self.n += len(ends)

    def _blocks(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ends of the units that end in (start, stop]."""
        total = len(self.data)
        for a in range(start, stop, self.block):
            b = min(a + self.block, stop)
            # one byte more shows whether a word ends with the block
            yield a + unit_ends(self.data[a : min(b + 1, total)], last=b == total)

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before unit number ``unit``."""
        j = bisect_right(self.units, unit) - 1
        start, points, left = self.bytes[j], self.points[j], unit - self.units[j]
        if left == 0:
            return start, points
        stop = self.bytes[j + 1] if j + 1 < len(self.bytes) else len(self.data)
        for ends in self._blocks(start, stop):
            if left <= len(ends):
                end = int(ends[left - 1])
                return end, points + code_points(self.data[start:end])
            left -= len(ends)
        raise IndexError(f"unit {unit} of {self.n}")


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transform(data: np.ndarray, key: object, *, seed: int = SEED, every: int = EVERY, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, code points of the prefix, of the middle, output) of one text in UTF-8."""
    index = Checkpoints(data, every)
    raw = data.tobytes()
    h = draws(seed, key)
    if not raw or h[2] % 100 >= rate or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, raw
    (a, before), (b, upto) = (index.cut(unit) for unit in sorted(k % (index.n + 1) for k in h[:2]))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h[3] % 100 < suffix_first:
        form, out = "spm", b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    else:
        form, out = "psm", b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))
    return index.n, form, before, upto - before, out


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of docs."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"
    kinds = None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size, first = batch.column(0), [], 0, 0

            def send(rows, ids):
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
                # the parts are cut at whole code points of a valid text
                return pa.RecordBatch.from_arrays([ids, *columns[:-1], columns[-1].view(pa.string())], names=fields)

            for start, stop, data, offs in text_chunks(batch.column(1)):
                for k, key in enumerate(ids[start:stop].to_pylist()):
                    rows.append(transform(data[offs[k] : offs[k + 1]], key, **options))
                    size += len(rows[-1][-1])
                    if size > SEND_BYTES:
                        yield send(rows, ids[first : first + len(rows)])
                        first, rows, size = first + len(rows), [], 0
            if rows:
                yield send(rows, ids[first : first + len(rows)])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = (F.sha2(c.cast("binary"), 256).alias(name) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", restored(F.col("output"), F.col("form")))))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
