"""Connected components of voxels.

Three engines give the same result.  "tiles": components inside tiles first, then
those of the graph of tile components that touch across borders, by
``plans.components`` in a logarithmic number of rounds; only borders and the
tile components at them are sent.  "rows": the graph of all voxels, whose edges
are equi-joins on shifted coordinates.  "kernel": each volume is one Arrow
group.  "auto" takes the kernel for grids of up to ``KERNEL_VOXELS`` voxels, a
bound of about 200 MB a task, and tiles beyond.  Ids are dense from 0 in the scan
order of each component's first voxel.  The numbering window runs over
components, not voxels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import BACKGROUND, Grid, InvalidArgument
from ..plans.components import connected_components
from ..plans.durable import DurableTable, durable
from . import dense
from .tiles import SIDE, TileArrays, Tiling, gather, spread, with_inbox

KERNEL_VOXELS = 1 << 22


def half_neighbours(connectivity: int) -> list[tuple[int, int, int]]:
    """(dz, dy, dx) before the centre in scan order."""
    most = {6: 1, 18: 2, 26: 3}.get(connectivity)
    if most is None:
        raise InvalidArgument("connectivity must be 6, 18 or 26")
    near = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return [d for d in near if 0 < sum(map(abs, d)) <= most and d < (0, 0, 0)]


def _roots_kernel(foreground: DataFrame, grid: Grid, connectivity: int, same: tuple[str, ...]) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        z, y, x = (table.column(c).to_numpy() for c in ("z", "y", "x"))
        there = np.zeros((grid.depth, grid.height, grid.width), bool)
        there[z, y, x] = True
        group = None
        if same:
            group = np.full(there.shape, -1, np.int64)
            group[z, y, x] = table.column(same[0]).to_numpy()
        roots = dense.components(there, connectivity, group)
        index = (z.astype(np.int64) * grid.height + y) * grid.width + x
        return table.append_column("idx", pa.array(index)).append_column("root", pa.array(roots[z, y, x].astype(np.int64)))

    chosen = foreground.select("volume_id", *(F.col(c).cast("int").alias(c) for c in ("z", "y", "x", *same)))
    return chosen.groupBy("volume_id").applyInArrow(run, f"volume_id string, z int, y int, x int, {''.join(f'{c} int, ' for c in same)}idx long, root long")


def _roots_tiles(foreground: DataFrame, tiling: Tiling, connectivity: int, same: tuple[str, ...]) -> DataFrame:
    grid = tiling.grid
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    #: root: the least index of the tile component, -1 off the foreground
    kind = TileArrays(tiling, {"root": (np.int64, -1), "own": (np.int64, -1)}, ("root", "own"))
    inner = tiling.inner()

    def start(arrays: dict[str, np.ndarray], tile: int) -> None:
        there, group = arrays["root"][inner] >= 0, arrays["own"][inner]
        found = dense.components(there, connectivity, group if same else None)
        z, y, x = np.unravel_index(np.maximum(found, 0), found.shape)
        (z0, _), (y0, _), (x0, _) = tiling.box(tile)
        arrays["root"][inner] = np.where(there, ((z + z0) * grid.height + y + y0) * grid.width + x + x0, -1)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                volume, tile, inbox = (batch.column(c)[k].as_py() for c in ("volume_id", "tile", "inbox"))
                arrays = kind.load(batch, k, tile)
                kind.receive(arrays, inbox)
                root, own = arrays["root"], arrays["own"]
                outside = np.ones(root.shape, bool)
                outside[inner] = False
                pairs = [np.zeros((0, 2), np.int64)]
                for d in product((-1, 0, 1), repeat=3):
                    if d > (0, 0, 0) and sum(map(abs, d)) <= most:
                        # each pair across a border is seen by one of its tiles, whose voxel is the earlier
                        there = tuple(slice(1 + s, n - 1 + s) for s, n in zip(d, root.shape, strict=True))
                        met = outside[there] & (root[inner] >= 0) & (root[there] >= 0) & (own[inner] == own[there])
                        pairs.append(np.unique(np.stack((root[inner][met], root[there][met]), axis=1), axis=0))
                both = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([volume] * len(both), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["volume_id", "u", "w"])

    rows = foreground.select("volume_id", "z", "y", "x", F.lit(0).alias("root"), *(F.col(c).cast("long").alias("own") for c in same))
    tiles = DurableTable(gather(rows, kind, start), "components")
    touching = with_inbox(tiles.df).mapInArrow(edges, "volume_id string, u long, w long")
    # nodes of the graph are numbered over all volumes by (volume, root), so one run of rounds serves every volume
    number = tiles.df.select("volume_id").distinct().withColumn("_vol", (F.rank().over(Window.orderBy("volume_id")) - 1).cast("long"))
    nodes = touching.join(number, "volume_id").select((F.col("_vol") * grid.voxels + F.col("u")).alias("u"), (F.col("_vol") * grid.voxels + F.col("w")).alias("w"))
    found = connected_components(nodes, "u", "w").where("node <> component").withColumn("_vol", F.floor(F.col("node") / grid.voxels))
    moved = found.join(number, "_vol").select("volume_id", (F.col("node") - F.col("_vol") * grid.voxels).alias("old"), (F.col("component") - F.col("_vol") * grid.voxels).alias("new"))
    z, y, x = F.floor(F.col("old") / (grid.height * grid.width)), F.floor(F.col("old") / grid.width) % grid.height, F.col("old") % grid.width
    # a tile's list has the components at its border at most
    lists = moved.withColumn("tile", tiling.tile(z, y, x)).groupBy("volume_id", "tile").agg(F.collect_list(F.struct("old", "new")).alias("moved"))

    def pick(arrays: dict, tile: int) -> dict[str, np.ndarray]:
        root = arrays["root"][inner].copy()
        changes = sorted((m["old"], m["new"]) for m in arrays["moved"] or ())
        if changes:
            old, new = np.array(changes).T
            at = np.minimum(np.searchsorted(old, root), len(old) - 1)
            root = np.where(old[at] == root, new[at], root)
        places = [np.arange(a, b) for a, b in tiling.box(tile)]
        index = (places[0][:, None, None] * grid.height + places[1][:, None]) * grid.width + places[2]
        return {**{c: arrays["own"][inner].astype(np.int32) for c in same}, "idx": index, "root": root}

    found_tiles = tiles.df.drop("out", "n_out", "changed").join(lists, ["volume_id", "tile"], "left")
    return spread(found_tiles, kind, pick, f"{''.join(f'{c} int, ' for c in same)}idx long, root long", keep=lambda made: made["root"] >= 0)


def _roots(foreground: DataFrame, grid: Grid, connectivity: int, same: tuple[str, ...] = (), engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """foreground(volume_id, z, y, x, *same) with ``idx`` and ``root``, the least idx of the component.

    Nodes of the graph are numbered over all volumes by (volume, idx), so one
    run of rounds serves every volume.
    """
    half_neighbours(connectivity)
    if engine == "kernel" or engine == "auto" and grid.voxels <= KERNEL_VOXELS:
        return _roots_kernel(foreground, grid, connectivity, same)
    if engine in ("tiles", "auto"):
        return _roots_tiles(foreground, Tiling.of(grid, 1, side), connectivity, same)
    marked = foreground.select("volume_id", "z", "y", "x", *same, grid.index().alias("idx"))
    number = marked.select("volume_id").distinct().withColumn("_vol", F.rank().over(Window.orderBy("volume_id")) - 1)
    nodes = durable(marked.join(F.broadcast(number) if number.count() <= 100_000 else number, "volume_id").withColumn("node", F.col("_vol").cast("long") * grid.voxels + F.col("idx")), "voxels")
    moves = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in half_neighbours(connectivity)])
    reach = nodes.select("volume_id", "node", *same, "z", "y", "x", F.explode(moves).alias("d"))
    reach = reach.select("volume_id", *same, (F.col("z") + F.col("d.z")).alias("z"), (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"), F.col("node").alias("u"))
    edges = reach.join(nodes.withColumnRenamed("node", "w"), ["volume_id", "z", "y", "x", *same]).select("u", "w")
    found = connected_components(edges, "u", "w")
    rooted = nodes.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return rooted.select("volume_id", "z", "y", "x", *same, "idx", F.coalesce(F.col("component") - F.col("_vol") * grid.voxels, F.col("idx")).alias("root"))


def label(field: DataFrame, grid: Grid, foreground: Column, connectivity: int, least_size: int, base: int = 0, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """Labels of every voxel of field; components smaller than ``least_size`` are background."""
    rooted = durable(_roots(field.where(foreground), grid, connectivity, engine=engine, side=side), "roots")
    sizes = rooted.groupBy("volume_id", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_size)
    ids = sizes.withColumn("label", (F.row_number().over(Window.partitionBy("volume_id").orderBy("root")) - 1 + base).cast("int"))
    kept = rooted.join(ids, ["volume_id", "root"]).select("volume_id", "z", "y", "x", "label")
    return field.select("volume_id", "z", "y", "x").join(kept, ["volume_id", "z", "y", "x"], "left").select("volume_id", "z", "y", "x", F.coalesce("label", F.lit(BACKGROUND)).alias("label"))


def connected(field: DataFrame, grid: Grid, level: float, connectivity: int = 6, least_size: int = 1, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """Components of v >= level.  A NaN level makes every voxel a component of its own."""
    if least_size < 1:
        raise InvalidArgument("the least size is 1")
    half_neighbours(connectivity)
    if level != level:
        return field.select("volume_id", "z", "y", "x", grid.index().cast("int").alias("label") if least_size == 1 else F.lit(BACKGROUND).alias("label"))
    return label(field, grid, F.col("v") >= float(level), connectivity, least_size, engine=engine, side=side)


def connected_low(field: DataFrame, grid: Grid, most: float, more_than: int, excluded: DataFrame | None = None, connectivity: int = 6, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """Components of v <= most with more than ``more_than`` voxels; labelled voxels of ``excluded`` are walls."""
    if more_than < 0:
        raise InvalidArgument("the size bound must not be negative")
    if excluded is not None:
        walls = excluded.where("label >= 0").select("volume_id", "z", "y", "x", F.lit(True).alias("_wall"))
        field = field.join(walls, ["volume_id", "z", "y", "x"], "left").withColumn("v", F.when(F.col("_wall"), F.lit(float("inf"))).otherwise(F.col("v"))).drop("_wall")
    return label(field, grid, F.col("v") <= float(most), connectivity, more_than + 1, engine=engine, side=side)


def label_components(labels: DataFrame, grid: Grid, connectivity: int, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """(volume_id, z, y, x, label, idx, root): components of equal labels >= 0."""
    return equal_components(labels.where("label >= 0"), grid, connectivity, engine, side)


def equal_components(labels: DataFrame, grid: Grid, connectivity: int, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """The same for all rows given, whatever their labels."""
    return _roots(labels, grid, connectivity, ("label",), engine, side)


def component_table(labels: DataFrame, field: DataFrame) -> DataFrame:
    """Size, bounding box and mean of v of each label; one partial aggregate."""
    met = labels.where("label >= 0").join(field, ["volume_id", "z", "y", "x"])
    return met.groupBy("volume_id", "label").agg(
        F.count(F.lit(1)).alias("size"), *[f(a).alias(f"{n}_{a}") for a in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))], F.avg("v").alias("mean")
    )
