"""Volumes cut into boxes ("tiles"), for operators that no single task should see whole.

Two ways to give a tile what lies around it:

* ``deal`` sends each voxel to every tile within a halo of it, for kernels that
  read a bounded neighbourhood once.
* ``gather`` makes one row of a tile, with its arrays as bytes, for fixpoints.
  ``step`` runs a kernel on every tile and collects which border pieces changed;
  the pieces are sent to the neighbours and written into the halos there before
  the next step, until no piece changes (``settle``).  Only borders are
  shuffled by volume and tile; where they are small, Spark sends them to the
  tiles and not the tiles to them.  Each step's tiles are a durable table.

Tiles of one axis differ by one voxel at most and are never thinner than a halo.
A task holds one tile of each of its rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Grid, ResourceLimit
from ..plans.durable import DurableTable
from ..plans.progress import report

#: Voxels of a tile's side, unless a call says otherwise.
SIDE = 64
_AXES = ("z", "y", "x")
_AROUND = [d for d in product((-1, 0, 1), repeat=3) if any(d)]


def _extended(numbers: Column, span: Column, n: int) -> Column:
    """Each number times n plus each of span."""
    return F.flatten(F.transform(numbers, lambda before: F.transform(span, lambda k: before * n + k)))


@dataclass(frozen=True)
class Tiling:
    grid: Grid
    parts: tuple[int, int, int]
    halo: int = 1

    @staticmethod
    def of(grid: Grid, halo: int = 1, side: int | tuple[int, int, int] = SIDE) -> Tiling:
        sides = (side,) * 3 if isinstance(side, int) else side
        parts = (max(1, min(-(-n // s), n // max(halo, 1))) for n, s in zip((grid.depth, grid.height, grid.width), sides, strict=True))
        return Tiling(grid, tuple(parts), halo)

    @property
    def extents(self) -> tuple[int, int, int]:
        return self.grid.depth, self.grid.height, self.grid.width

    @property
    def count(self) -> int:
        return int(np.prod(self.parts))

    def place(self, tile: int) -> tuple[int, int, int]:
        return tuple(int(k) for k in np.unravel_index(tile, self.parts))

    def box(self, tile: int) -> list[tuple[int, int]]:
        """(first, end) on each axis."""
        return [(k * n // p, (k + 1) * n // p) for k, n, p in zip(self.place(tile), self.extents, self.parts, strict=True)]

    def reach(self, tile: int, halo: int) -> list[tuple[int, int]]:
        """The box with a halo, cut off at the volume's edge."""
        return [(max(0, a - halo), min(n, b + halo)) for (a, b), n in zip(self.box(tile), self.extents, strict=True)]

    def near(self, tile: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Neighbours and the way to them."""
        at = self.place(tile)
        for d in _AROUND:
            to = tuple(k + s for k, s in zip(at, d, strict=True))
            if all(0 <= k < p for k, p in zip(to, self.parts, strict=True)):
                yield int(np.ravel_multi_index(to, self.parts)), d

    def _part(self, axis: int, at: Column) -> Column:
        return F.floor(((at + 1) * self.parts[axis] - 1) / self.extents[axis]).cast("int")

    def tile(self, z: Column, y: Column, x: Column) -> Column:
        """The number of a coordinate's tile."""
        number = F.lit(0)
        for axis, at in enumerate((z, y, x)):
            number = number * self.parts[axis] + self._part(axis, at)
        return number

    def tiles_within(self, halo: int) -> Column:
        """Numbers of all tiles within ``halo`` of a row's z, y and x."""
        numbers = F.array(F.lit(0))
        for axis, name in enumerate(_AXES):
            lo = self._part(axis, F.greatest(F.col(name) - halo, F.lit(0)))
            hi = self._part(axis, F.least(F.col(name) + halo, F.lit(self.extents[axis] - 1)))
            numbers = _extended(numbers, F.sequence(lo, hi), self.parts[axis])
        return numbers

    def inner(self) -> tuple[slice, ...]:
        return (slice(self.halo, -self.halo or None),) * 3

    def border(self, shape: tuple[int, ...], d: tuple[int, ...]) -> tuple[slice, ...]:
        """In a padded array, the part of the tile that its neighbour in direction d needs."""
        w = self.halo
        return tuple(slice(w, n - w) if s == 0 else slice(w, 2 * w) if s < 0 else slice(n - 2 * w, n - w) for n, s in zip(shape, d, strict=True))

    def outer(self, shape: tuple[int, ...], d: tuple[int, ...]) -> tuple[slice, ...]:
        """In a padded array, the part of the halo in direction d."""
        w = self.halo
        return tuple(slice(w, n - w) if s == 0 else slice(0, w) if s < 0 else slice(n - w, n) for n, s in zip(shape, d, strict=True))


def deal(rows: DataFrame, tiling: Tiling, halo: int, columns: dict[str, type], kernel: Callable[..., dict[str, np.ndarray] | None], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """kernel(arrays with a halo cut off at the volume's edge, slices of the tile in them, first row) to columns.

    ``extra`` names columns that are constant in a volume.
    """
    dealt = rows.select("volume_id", *_AXES, *columns, *extra).withColumn("tile", F.explode(tiling.tiles_within(halo)))

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        reach, box = tiling.reach(first["tile"], halo), tiling.box(first["tile"])
        at = tuple(table.column(a).to_numpy() - lo for a, (lo, _) in zip(_AXES, reach, strict=True))
        arrays = {}
        for name, kind in columns.items():
            arrays[name] = np.zeros([b - a for a, b in reach], kind)
            arrays[name][at] = table.column(name).to_numpy(zero_copy_only=False)
        own = tuple(slice(a - lo, b - lo) for (a, b), (lo, _) in zip(box, reach, strict=True))
        found = kernel(arrays, own, first)
        n = len(next(iter(found.values())))
        return pa.table({"volume_id": pa.array([first["volume_id"]] * n, pa.string()), **{k: pa.array(v) for k, v in found.items()}})

    return dealt.groupBy("volume_id", "tile").applyInArrow(run, f"volume_id string, {schema}")


_OUT = "out array<struct<tile:int,d:int,piece:binary>>, n_out int, changed boolean"


class TileArrays:
    """Padded arrays of one kind of fixpoint: names, types, what fills them outside, and which are exchanged."""

    def __init__(self, tiling: Tiling, columns: dict[str, tuple[type, float]], exchanged: tuple[str, ...]):
        self.tiling, self.columns, self.exchanged = tiling, columns, exchanged

    @property
    def schema(self) -> str:
        return "volume_id string, tile int, " + "".join(f"{c} binary, " for c in self.columns) + _OUT

    def shape(self, tile: int) -> tuple[int, ...]:
        return tuple(b - a + 2 * self.tiling.halo for a, b in self.tiling.box(tile))

    def row(self, volume: str, tile: int, arrays: dict[str, np.ndarray], out: list, changed: bool) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("tile", pa.int32()), ("d", pa.int32()), ("piece", pa.binary())]))
        columns = [pa.array([volume], pa.string()), pa.array([tile], pa.int32()), *(pa.array([arrays[c].tobytes()], pa.binary()) for c in self.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([out], kind), pa.array([len(out)], pa.int32()), pa.array([changed])], names=["volume_id", "tile", *self.columns, "out", "n_out", "changed"])

    def load(self, batch: pa.RecordBatch, k: int, tile: int) -> dict[str, np.ndarray]:
        shape = self.shape(tile)
        return {c: np.frombuffer(batch.column(c)[k].as_buffer(), kind).reshape(shape).copy() for c, (kind, _) in self.columns.items()}

    def receive(self, arrays: dict[str, np.ndarray], inbox: list | None) -> None:
        for message in inbox or ():
            at = 0
            for name in self.exchanged:
                halo = arrays[name][self.tiling.outer(arrays[name].shape, _AROUND[message["d"]])]
                size = halo.size * halo.itemsize
                halo[...] = np.frombuffer(message["piece"], halo.dtype, halo.size, at).reshape(halo.shape)
                at += size

    def changes(self, tile: int, before: dict[str, np.ndarray] | None, arrays: dict[str, np.ndarray]) -> list:
        """Border pieces for the neighbours, all of them or those that differ from before."""
        out = []
        for to, d in self.tiling.near(tile):
            part = self.tiling.border(self.shape(tile), d)
            if before is None or any(not np.array_equal(before[c][part], arrays[c][part]) for c in self.exchanged):
                # the receiver sees it in the opposite direction
                out.append({"tile": to, "d": _AROUND.index(tuple(-s for s in d)), "piece": b"".join(arrays[c][part].tobytes() for c in self.exchanged)})
        return out


def gather(rows: DataFrame, kind: TileArrays, start: Callable[[dict[str, np.ndarray], int], None] | None = None) -> DataFrame:
    """One row per tile from rows with the arrays' columns; ``start`` may change the padded arrays of a tile.

    Columns that ``rows`` lacks are left to ``start``.  All border pieces are sent.
    """
    tiling = kind.tiling
    there = [c for c in kind.columns if c in rows.columns]
    parted = rows.select("volume_id", *_AXES, *there).withColumn("tile", tiling.tile(*(F.col(a) for a in _AXES)))

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        shape = kind.shape(tile)
        at = tuple(table.column(a).to_numpy() - lo + tiling.halo for a, (lo, _) in zip(_AXES, tiling.box(tile), strict=True))
        arrays = {}
        for name, (dtype, fill) in kind.columns.items():
            arrays[name] = np.full(shape, fill, dtype)
            if name in there:
                arrays[name][at] = table.column(name).to_numpy(zero_copy_only=False)
        if start is not None:
            start(arrays, tile)
        return pa.Table.from_batches([kind.row(table.column("volume_id")[0].as_py(), tile, arrays, kind.changes(tile, None, arrays), True)])

    return parted.groupBy("volume_id", "tile").applyInArrow(run, kind.schema)


def with_inbox(state: DataFrame) -> DataFrame:
    """The tiles with the pieces that their neighbours sent."""
    sent = state.where("n_out > 0").select("volume_id", F.explode("out").alias("m"))
    inbox = sent.groupBy("volume_id", F.col("m.tile").alias("tile")).agg(F.collect_list(F.struct("m.d", "m.piece")).alias("inbox"))
    return state.drop("out", "n_out").join(inbox, ["volume_id", "tile"], "left")


def step(state: DataFrame, kind: TileArrays, kernel: Callable[[dict[str, np.ndarray], int], bool | None], touched_only: bool = True) -> DataFrame:
    """The next state: pieces received, the kernel run (in place), changed borders sent.

    With ``touched_only`` a tile without received pieces stays as it is.  A tile has
    ``changed`` if the kernel says so, or if it says nothing and an exchanged array differs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                volume, tile, inbox = (batch.column(c)[k].as_py() for c in ("volume_id", "tile", "inbox"))
                arrays = kind.load(batch, k, tile)
                if touched_only and not inbox:
                    yield kind.row(volume, tile, arrays, [], False)
                    continue
                kind.receive(arrays, inbox)
                inner = kind.tiling.inner()
                before = {c: arrays[c].copy() for c in kind.exchanged}
                said = kernel(arrays, tile)
                differs = any(not np.array_equal(before[c][inner], arrays[c][inner]) for c in kind.exchanged)
                yield kind.row(volume, tile, arrays, kind.changes(tile, before, arrays) if differs else [], differs if said is None else said)

    return with_inbox(state).mapInArrow(run, kind.schema)


def settle(state: DurableTable, kind: TileArrays, kernel: Callable[[dict[str, np.ndarray], int], None], tag: str, max_rounds: int = 10_000) -> DurableTable:
    """Steps until no border piece changes; ``state`` is dropped."""
    for done in range(max_rounds):
        if state.df.where("n_out > 0").isEmpty():
            return state
        following = DurableTable(step(state.df, kind, kernel), tag)
        state.drop()
        state = following
        report(tag, done + 1)
    raise ResourceLimit("the tiles didn't settle")


def spread(tiles: DataFrame, kind: TileArrays, pick: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]], schema: str, keep: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """(volume_id, z, y, x, columns): a row per voxel, or per voxel that ``keep`` marks; ``pick`` gives arrays of the tile's shape."""
    tiling = kind.tiling
    more = [c for c in tiles.columns if c not in kind.columns and c not in ("volume_id", "tile", "out", "n_out", "changed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                volume, tile = (batch.column(c)[k].as_py() for c in ("volume_id", "tile"))
                arrays = kind.load(batch, k, tile) | {c: batch.column(c)[k].as_py() for c in more}
                made = pick(arrays, tile)
                where = np.nonzero(keep(made)) if keep is not None else tuple(a.ravel() for a in np.indices(next(iter(made.values())).shape))
                places = [pa.array((at + lo).astype(np.int32)) for at, (lo, _) in zip(where, tiling.box(tile), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([volume] * len(where[0]), pa.string()), *places, *(pa.array(a[where]) for a in made.values())], names=["volume_id", *_AXES, *made])

    return tiles.drop("out", "n_out", "changed").mapInArrow(run, f"volume_id string, z int, y int, x int, {schema}")
