"""Vectorised text kernels on Arrow buffers.

Texts are hashed as bytes, a few hundred thousand at a time, with NumPy: no
Python object is made for a word.  A word hash is a polynomial over mixed byte
values modulo 2**64, finished with a multiply-xorshift; shingle hashes combine
word hashes with odd multipliers.  All functions are pure, so a task that is
run again gives the same values.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes that one pass works on, unless a single text is longer.
CHUNK_BYTES = 1 << 19


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


mix64 = _splitmix
_BYTE_VALUE = _splitmix(np.arange(256, dtype=U64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD_CHAR = np.zeros(256, bool)
_WORD_CHAR[128:] = True
for _r in ((48, 58), (65, 91), (97, 123)):
    _WORD_CHAR[_r[0] : _r[1]] = True
#: The k-th word of a shingle is multiplied by the k-th of these.
_PLACE = _splitmix(np.arange(1000, 1064, dtype=U64)) | U64(1)

def trim_memory() -> None:
    """Give freed memory back to the system; workers are reused and would keep their peak."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INV)):
                table = np.full(size, U64(base))
                table[0] = 1
                _powers[k] = np.multiply.accumulate(table, dtype=U64)
    return _powers[0], _powers[1]


def text_chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them); nulls are empty."""
    if pa.types.is_null(array.type):
        array = array.cast(pa.string())
    array = array.fill_null("") if array.null_count else array
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, stop, raw[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def word_spans(data: np.ndarray, offs: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offset of each row.

    A word is a longest run of bytes outside space, tab, LF, VT, FF and CR, or
    with ``letters_only`` of ASCII letters, digits and non-ASCII bytes.
    """
    inside = _WORD_CHAR[data] if letters_only else ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    begin[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def unit_ends(data: np.ndarray, last: bool = True) -> np.ndarray:
    """Byte ends of the units of one text: white space and the word behind it, or white space at the end.

    With ``last`` False the last byte is only looked at to see whether a word goes on.
    """
    inside = ~_SPACE[data]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return np.append(ends, len(data)) if last and len(data) else ends


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray, lower: bool = True):
    """64-bit hashes of byte spans, independent of where they stand.

    With several arrays of ends, a list of as many arrays of hashes.
    """
    power, inverse = _pow_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_VALUE[_LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
        base, scale = total[starts], inverse[starts]
        out = [_splitmix((total[end] - base) * scale) for end in ends]
    return out if len(out) != 1 else out[0]


def word_hashes(data: np.ndarray, offs: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offs, letters_only)
    return span_hashes(data, starts, ends), rows


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words, independent of where they stand."""
    power, inverse = _pow_tables(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * power[: len(words)], out=total[1:])
        return _splitmix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * _PLACE[63])


def ngram_hashes(words: np.ndarray, k: int, mask: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of each run of k words; mask names the places that count (default: all)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.full(n, _PLACE[63] * U64(k), U64)
        for j in range(k) if mask is None else mask:
            out += words[j : j + n] * _PLACE[j]
        return _splitmix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its k-word shingles.

    A row with fewer than k words has the hash of its whole sequence; a row
    without words has an empty set.
    """
    words, rows = word_hashes(data, offs)
    grams = ngram_hashes(words, k)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield ngram_hashes(words[a:b], b - a)
        else:
            yield grams[:0]
