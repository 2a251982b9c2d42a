"""Packing of documents into token sequences by order-preserving dynamic programming.

The documents of a task are one stream of tokens, in their order.  The stream
is cut into windows of at most ``LENGTH`` tokens; a window is a sequence.  Cuts
stand at the ends of documents or sentences; only where a sentence is longer
than ``FREE_EVERY`` tokens, also after words in it.  Among all such cuts those
are chosen whose padding and penalties add up to the least: a sequence costs
``SEQUENCE`` and its padding, a cut ``SENTENCE`` or ``FREE`` if it parts a
document.  A window of a power of two needs no padding; any other is padded to
``LENGTH``.

For a cut at p the best window start s minimises cost(s) + (LENGTH - (p - s)),
that is cost(s) + s, over the starts in reach: the minimum of a sliding window,
which a monotone queue gives in constant time a cut.  Windows of a power of two,
from ``SHORTEST`` on, are looked up by their start.  Backward paths from all cuts still in reach meet
soon; what lies before their meeting point is final and is sent, so a task holds
a stretch of the stream only and the result is still the least of the whole
stream.  Tasks are independent: no text is shuffled, and each task but for its
last window fills its sequences.

Ids come from a tokenizer file.  A text is cut into units (white space and the
word behind it), at whose borders byte-level BPE always splits; the units of a
batch are hashed, each distinct one is encoded once and the ids are gathered, so
encoding costs little for words that recur.  Where two units share a hash,
their bytes differ and the batch is encoded unit by unit.

Defined cases: a null or empty text is the closing id alone; control strings in
a text are ordinary text; very long texts are encoded whole, in blocks; rows
that repeat an id are documents of their own; null ids are kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import _SPACE, span_hashes, text_chunks, trim_memory, unit_ends

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
LENGTH = 2048
#: What a sequence, a cut at a sentence's end and a cut inside a sentence cost, in tokens of padding.
SEQUENCE, SENTENCE, FREE = 16, 4, 32
#: The least window of a power of two that goes without padding.
SHORTEST = 64
#: Inside a sentence, cuts may stand after about so many tokens.
FREE_EVERY = 32
#: Tokens of the stream after which final windows are looked for.
STRETCH = 1 << 18
#: Distinct units whose ids a worker keeps, some 20 MB of them.
KEPT_UNITS = 1 << 19
SLOT_BITS = 20
#: Bytes of a long text encoded at a time, and bytes of ids sent at a time.
BLOCK, SEND_BYTES = 1 << 19, 1 << 22
#: Bytes of distinct units encoded behind one another.
JOINED_BYTES = 1 << 14
#: Sequence numbers of one task.
TASK_NUMBERS = 1 << 38

#: White space outside ASCII: a unit that ends in it is joined with the next.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Ends of sentences besides . ! and ?; behind them quotes and brackets may close.
_WIDE_STOPS = [c.encode() for c in "…。！？"]
_CLOSERS = np.zeros(256, bool)
_CLOSERS[list(b"\"')]}")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 13]] = True


def _ends_in(data: np.ndarray, ends: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Whether the bytes before each end are one of the marks."""
    found = np.zeros(len(ends), bool)
    for size in {len(m) for m in marks}:
        far = np.flatnonzero(ends >= size)
        code = np.zeros(len(far), np.int64)
        for k in range(size, 0, -1):
            code = code << 8 | data[ends[far] - k]
        found[far] |= np.isin(code, [int.from_bytes(m, "big") for m in marks if len(m) == size])
    return found


def _gather(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begins[k] .. begins[k] + sizes[k] - 1 of all k, one after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins - (upto - sizes), sizes)


class UnitEncoder:
    """Ids of texts by the distinct units in them; a table keeps the units met."""

    def __init__(self, raw: bytes):
        # Spark has a worker for each core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        # a byte-level token has one character for each byte
        size = self.tokenizer.get_vocab_size()
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        #: by the upper bits of a hash: the hash, and the number of the unit learned last with those bits
        self.tags, self.units = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
        #: begin and size of a unit's ids, and of its bytes
        self.where = np.zeros((0, 4), np.int64)
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, all ids)."""
        # units behind one another are split at their borders again, if they start with white space and don't end with it
        alone = _SPACE[data[ends - 1]]
        alone |= _ends_in(data, ends, _WIDE_SPACE) | np.isin(data[starts], [m[0] for m in _WIDE_SPACE])
        order = np.argsort(alone, kind="stable")
        starts, n_bytes = starts[order], (ends - starts)[order]
        # a line break is put before the others, which is an id of its own
        put = (~_SPACE[data[starts]] & ~alone[order]).astype(np.int64)
        sizes = n_bytes + put
        upto = np.cumsum(sizes)
        joined = np.full(upto[-1], ord("\n"), np.uint8)
        joined[_gather(upto - n_bytes, n_bytes)] = data[_gather(starts, n_bytes)]
        group = np.where(alone[order], len(joined) + np.arange(len(order)), upto // JOINED_BYTES)
        cuts = [0, *upto[np.flatnonzero(np.diff(group))].tolist(), len(joined)]
        found = self.tokenizer.encode_batch_fast([joined[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        last = np.searchsorted(np.cumsum(self.n_bytes[ids]), upto, "right")
        begins = np.concatenate(([0], last[:-1])) + put
        counts, back = last - begins, np.argsort(order)
        return counts[back], ids[_gather(begins[back], counts[back])]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new units."""
        n_ids, ids = self._encoded(data, starts, ends)
        n_bytes = ends - starts
        rows = np.stack((np.cumsum(n_ids) - n_ids + len(self.ids), n_ids, np.cumsum(n_bytes) - n_bytes + len(self.bytes), n_bytes), axis=1)
        numbers = np.arange(len(rows)) + len(self.where)
        self.where = np.concatenate((self.where, rows))
        self.ids, self.bytes = np.concatenate((self.ids, ids)), np.concatenate((self.bytes, data[_gather(starts, n_bytes)]))
        slots = hashes >> np.uint64(64 - SLOT_BITS)
        self.tags[slots], self.units[slots] = hashes, numbers
        return numbers

    def _unit_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, all ids); the units are all of data, in order."""
        if len(self.where) > KEPT_UNITS:
            self._clear()
        hashes = span_hashes(data, starts, ends, lower=False)
        slots = hashes >> np.uint64(64 - SLOT_BITS)
        numbers = self.units[slots]
        missing = np.flatnonzero((self.tags[slots] != hashes) | (hashes == 0))
        if len(missing):
            fresh, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            numbers[missing] = self._learn(fresh, data, starts[first], ends[first])[which]
        begins, sizes, byte_begins, n_bytes = self.where[numbers].T
        # units of one hash must be of the same bytes
        if not np.array_equal(n_bytes, ends - starts) or not np.array_equal(self.bytes[_gather(byte_begins, n_bytes)], data):
            return self._encoded(data, starts, ends)
        return sizes, self.ids[_gather(begins, sizes)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, their row offsets, ends of units in ids, which of those end a sentence); data isn't empty."""
        inside = ~_SPACE[data]
        border = np.append(inside[:-1] & ~inside[1:], False)
        border[offs[1:][offs[1:] > 0] - 1] = True
        ends = np.flatnonzero(border) + 1
        wide = np.flatnonzero(data[ends - 1] >= 128)
        joined = wide[_ends_in(data, ends[wide], _WIDE_SPACE)]
        ends = np.delete(ends, joined[~np.isin(ends[joined], offs)])
        starts = np.concatenate(([0], ends[:-1]))
        per, ids = self._unit_ids(data, starts, ends)
        # the ids of unit k stand at upto[k - 1] : upto[k]
        upto = np.cumsum(per)
        closed = ends.copy()
        for _ in range(3):
            closed -= _CLOSERS[data[np.maximum(closed - 1, 0)]] & (closed > 1)
        # a line break in the white space of a unit ends the sentence before it
        breaks = np.concatenate(([0], np.cumsum(_NEWLINE[data])))
        broken = np.append(breaks[ends[1:]] > breaks[starts[1:]], False)
        stops = broken
        last = data[closed - 1]
        stops |= (last == 46) | (last == 33) | (last == 63)
        high = np.flatnonzero(last >= 128)
        stops[high] |= _ends_in(data, closed[high], _WIDE_STOPS)
        return ids, np.concatenate(([0], upto))[np.searchsorted(ends, offs, "right")], upto, stops


def possible_cuts(rows: np.ndarray, units: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places inside rows of ids where a window may end, and their penalties; rows, units: offsets into the ids.

    Behind sentences, and in a sentence that is longer than ``FREE_EVERY`` ids
    behind the first word of each piece of that many, or at the piece's start if
    no word ends in it.
    """
    inner = units[stops]
    inner = inner[~np.isin(inner, rows)]
    fence = np.union1d(inner, rows)
    gap = np.diff(fence)
    many = np.maximum(gap - 1, 0) // FREE_EVERY
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    grid = np.repeat(fence[:-1], many) + place * FREE_EVERY
    if len(grid):
        word = units[np.minimum(np.searchsorted(units, grid), len(units) - 1)]
        grid = np.where((word >= grid) & (word < np.minimum(grid + FREE_EVERY, np.repeat(fence[1:], many))), word, grid)
    places = np.concatenate((inner, grid))
    order = np.argsort(places, kind="stable")
    return places[order], np.repeat([SENTENCE, FREE], [len(inner), len(grid)])[order]


def least_cost_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(cost, previous cut) of each place where a window may end; place 0 is the start.

    No two neighbouring places are more than ``length`` apart.
    """
    n = len(places)
    twins: dict[int, list[int]] = {}
    size = SHORTEST
    while size < length:
        at = np.minimum(np.searchsorted(places, places - size), n - 1)
        for j in np.flatnonzero(places[at] == places - size).tolist():
            twins.setdefault(j, []).append(int(at[j]))
        size *= 2
    where, extra = places.tolist(), (penalties + sequence).tolist()
    cost, back, keys = [0] * n, [-1] * n, where[:1] + [0] * (n - 1)
    queue, head = deque([0]), 0
    for j in range(1, n):
        here = where[j]
        while where[head] < here - length:
            # the least of the window left it
            queue.popleft()
            head = queue[0]
        least, best = keys[head] + length - here, head
        if j in twins:
            for i in twins[j]:
                if cost[i] < least:
                    least, best = cost[i], i
        cost[j], back[j] = least + extra[j], best
        keys[j] = key = least + extra[j] + here
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(j)
        head = queue[0]
    return np.array(cost), np.array(back)


def _meeting(back: np.ndarray, reach: np.ndarray) -> int:
    """The last place on all backward paths from the places in reach."""
    steps, seen = [-int(j) for j in reach], set(reach.tolist())
    heapq.heapify(steps)
    while len(steps) > 1:
        up = int(back[-heapq.heappop(steps)])
        if up not in seen:
            seen.add(up)
            heapq.heappush(steps, -up)
    return -steps[0]


class Packer:
    """Takes documents one by one and gives final pieces."""

    def __init__(self, length: int = LENGTH, stretch: int = STRETCH, sequence: int = SEQUENCE):
        self.length, self.stretch, self.sequence = length, stretch, sequence
        self.docs: list[tuple] = []
        #: where the stream's kept part starts in its first document, and its size
        self.skipped = self.size = self.sequences = 0
        self.checked = stretch

    def add(self, key, ids: np.ndarray, places: np.ndarray, penalties: np.ndarray) -> Iterator[tuple]:
        """One document; gives (key, start, length, ids, tokens, sequence, offset) of pieces that are final.

        A window may end at the places, rising to the document's end, which is the last.
        """
        self.docs.append((key, ids, places, penalties))
        self.size += len(ids)
        if self.size >= self.checked:
            yield from self._send(False)
            self.checked = self.size + self.stretch

    def end(self) -> Iterator[tuple]:
        if self.docs:
            yield from self._send(True)

    def _send(self, whole: bool) -> Iterator[tuple]:
        starts = np.cumsum([0, *(len(d[1]) for d in self.docs)]) - self.skipped
        places = np.concatenate([[0], *(d[2] + s for d, s in zip(self.docs, starts, strict=False))])
        penalties = np.concatenate([[0], *(d[3] for d in self.docs)])
        ahead = np.append(True, places[1:] > 0)
        places, penalties = places[ahead], penalties[ahead]
        _, back = least_cost_cuts(places, penalties, self.length, self.sequence)
        last = len(places) - 1
        if not whole:
            last = _meeting(back, np.flatnonzero(places >= places[-1] - self.length))
        path = [last]
        while path[-1] > 0:
            path.append(int(back[path[-1]]))
        windows = places[path[::-1]]
        if last == 0:
            return
        # pieces lie between neighbouring ends of windows and of documents
        done = int(windows[-1])
        borders = np.union1d(windows, starts[(starts > 0) & (starts < done)])
        of_doc = np.searchsorted(starts, borders[:-1], "right") - 1
        of_window = np.searchsorted(windows, borders[:-1], "right") - 1
        for a, b, d, w in zip(borders[:-1].tolist(), borders[1:].tolist(), of_doc.tolist(), of_window.tolist(), strict=True):
            key, ids, *_ = self.docs[d]
            first = a - int(starts[d])
            yield key, first, b - a, ids[first : first + b - a], len(ids), self.sequences + w, a - int(windows[w])
        self.sequences += len(windows) - 1
        kept = int(np.searchsorted(starts, done, "right")) - 1
        self.skipped = done - int(starts[kept])
        self.size -= done
        self.docs = self.docs[kept:]


_encoders: dict[int, UnitEncoder] = {}


def _encoder(raw: bytes) -> UnitEncoder:
    key = zlib.crc32(raw)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(raw)
    return _encoders[key]


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of a long text that end with a unit."""
    at, reach = 0, BLOCK
    while at < len(data):
        end = len(data)
        if at + reach < end:
            ends = unit_ends(data[at : at + reach], last=False)
            ends = at + ends[~_ends_in(data[at : at + reach], ends, _WIDE_SPACE)]
            if not len(ends):  # a unit longer than this
                reach *= 2
                continue
            end = int(ends[-1])
        yield at, end
        at, reach = end, BLOCK


def _documents(batch: pa.RecordBatch, encoder: UnitEncoder, end_id: int) -> Iterator[tuple]:
    """(key, ids, places where a window may end, penalties there) of each row."""
    close = np.array([end_id], np.uint32)
    for start, stop, data, offs in text_chunks(batch.column(1)):
        parts, n = [], 0
        # rows share a chunk, or one long row is encoded in blocks
        for a, b in [(0, len(data))] if stop - start > 1 else _blocks(data):
            if a < b:
                ids, rows, units, stops = encoder.encode(data[a:b], offs if stop - start > 1 else np.array([0, b - a]))
                if b < len(data) and _NEWLINE[data[b]]:
                    stops[-1] = True
                parts.append((ids, units + n, stops))
                n += len(ids)
        ids, units, stops = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (close[:0], np.zeros(0, np.int64), np.zeros(0, bool))
        if stop - start == 1 or not parts:
            rows = np.append(np.zeros(stop - start, np.int64), n)
        places, penalties = possible_cuts(rows, units, stops)
        of_rows = np.searchsorted(places, rows).tolist()
        for k, key in enumerate(batch.column(0)[start:stop].to_pylist()):
            first, last = int(rows[k]), int(rows[k + 1])
            own = slice(of_rows[k], of_rows[k + 1])
            yield key, np.concatenate((ids[first:last], close)), np.append(places[own] - first, last - first + 1), np.append(penalties[own], 0)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, **options) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row per piece.

    ``ids`` are little-endian unsigned 32-bit numbers.  Documents keep the order
    that docs has in each of its partitions.
    """
    # the driver reads the vocabulary, a file of a few megabytes, and sends it along
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or f"{TOKENIZER_DIR}/{VOCABULARY}").read_bytes())
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(shared.value), Packer(**options)
        base = TaskContext.get().partitionId() * TASK_NUMBERS
        rows, size, key_type = [], 0, None

        def send() -> pa.RecordBatch:
            key, start, length, ids, tokens, sequence, offset = zip(*rows, strict=True)
            columns = [pa.array(c, pa.int64()) for c in (start, length, tokens, [base + s for s in sequence], offset)]
            columns.insert(2, pa.array([i.astype("<u4", copy=False).tobytes() for i in ids], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(key, key_type), *columns], names=fields)

        def pieces() -> Iterator[tuple]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                for document in _documents(batch, encoder, end_id):
                    yield from packer.add(*document)
            yield from packer.end()

        for piece in pieces():
            rows.append(piece)
            size += 4 * piece[2] + 64
            if size > SEND_BYTES:
                yield send()
                rows, size = [], 0
        if rows:
            yield send()
        trim_memory()

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids, n_tokens, padding): the pieces of a sequence, at most ``length`` of them, put together."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    power = F.expr("(n_tokens & (n_tokens - 1)) = 0")
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"), "n_tokens", F.when(power, F.lit(0)).otherwise(F.lit(length) - F.col("n_tokens")).cast("long").alias("padding"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
