"""Distance transforms in linear time: lower envelopes of parabolas along lines.

Along a line the least (q - s)**2 + f[s] over all s is the lower envelope of
parabolas with their feet at s.  One scan keeps those that are the least
somewhere as a stack of (foot, where it starts to be the least): a new parabola
takes away the ones it hides, each once.  A second scan reads the stack.  So a
line of n voxels costs n steps.  All lines of an Arrow batch go along together;
a task holds a batch of lines, and a line is bounded by the extent of the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import lines, spread

#: Numbers of one block of lines, which has a stack of that size twice.
BLOCK = 1 << 20


def lower_envelope(f: np.ndarray, square: float = 1.0) -> np.ndarray:
    """For f of (places, lines): the least square * (q - s)**2 + f[s] of each line at each q.

    Values that aren't finite are no parabolas.  A line without any is infinite,
    or NaN if it has NaN only.
    """
    length, n = f.shape
    finite = np.isfinite(f)
    feet, since = np.zeros((length, n), np.int32), np.zeros((length, n))
    top = np.full(n, -1)
    for q in range(length):
        new = np.flatnonzero(finite[q])
        first = np.full(n, -np.inf)
        open_ = new[top[new] >= 0]
        while open_.size:
            k = top[open_]
            s = feet[k, open_].astype(np.int64)
            cross = ((f[q, open_] - f[s, open_]) / square + (q * q - s * s)) / (2.0 * (q - s))
            hidden = (cross <= since[k, open_]) & (k > 0)
            first[open_[~hidden]] = cross[~hidden]
            open_ = open_[hidden]
            top[open_] -= 1
        top[new] += 1
        feet[top[new], new], since[top[new], new] = q, first[new]
    out = np.where(np.isnan(f).all(axis=0), np.nan, np.inf) + np.zeros((length, 1))
    lined = np.flatnonzero(top >= 0)
    k, last = np.zeros(lined.size, np.int64), top[lined]
    for q in range(length):
        on = np.arange(lined.size)
        while on.size:
            on = on[k[on] < last[on]]
            on = on[since[k[on] + 1, lined[on]] < q]
            k[on] += 1
        s = feet[k, lined]
        out[q, lined] = square * (q - s.astype(np.float64)) ** 2 + f[s, lined]
    return out


def _of_lists(lists: pa.ListArray, square: float) -> pa.ListArray:
    """The envelope of each list; lists of one length go together."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(len(values))
    for length in np.unique(lengths[lengths > 0]):
        rows = starts[:-1][lengths == length]
        step = max(1, BLOCK // int(length))
        for a in range(0, len(rows), step):
            at = rows[a : a + step] + np.arange(length)[:, None]
            out[at] = lower_envelope(values[at], square)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out))


def envelope(values: Column, scale: float = 1.0) -> Column:
    """For an array of doubles: at each place q, the least (scale * (q - s))**2 + values[s]."""
    square = scale * scale

    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        return _of_lists(lists, square)

    return run(values)


def min_plus(squares: DataFrame, axis: str, scale: float = 1.0, also: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Along each line, the least over s of (scale * (q - s))**2 + v[s]; columns in ``also`` likewise, ``keep`` unchanged.

    An infinite value is a place without a parabola.  One shuffle serves all columns.
    """
    lined = lines(squares, axis, [*also, *keep]).withColumns({name: envelope(F.col(name), scale) for name in ("vs", *also)})
    return spread(lined, axis, [*also, *keep])
