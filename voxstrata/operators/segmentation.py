"""Iterative segmentation and fixpoints.

Volumes of up to ``components.KERNEL_VOXELS`` voxels are one task each (see
``dense``), many at a time; larger ones are cut into tiles (see ``tiles``), with
the same result.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.weights import ascending_schedule, descending_schedule, enforce, estimate
from ..model import BACKGROUND, LOW, MASK, Crop, Grid, InvalidArgument, InvalidState, Kernel
from ..plans.durable import DurableTable, durable
from ..plans.progress import report
from . import components, dense
from .directional import response
from .morphology import closing as ball_closing
from .pointwise import crop_mask
from .stencil import extreme_axis
from .tiles import SIDE, TileArrays, Tiling, deal, gather, settle, spread, step
from .volumes import per_volume, to_array



def _tiled(engine: str, grid: Grid) -> bool:
    return engine == "tiles" or engine == "auto" and grid.voxels > components.KERNEL_VOXELS


def h_minima(field: DataFrame, grid: Grid, h: float, check_interval: int = 50, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """MASK where a basin is not deeper than h.

    Engines: "kernel" (a volume a task), "tiles", "rows" (a loop over window minima).
    """
    if not 0 <= h <= 1 or not 1 <= check_interval <= 10_000:
        raise InvalidArgument("h is 0 to 1 and the interval 1 to 10000")
    if engine == "rows":
        return _h_minima_rows(field, grid, h)
    if _tiled(engine, grid):
        return _h_minima_tiles(field, Tiling.of(grid, 1, side), h)

    def run(_: str, table: pa.Table) -> dict[str, np.ndarray]:
        out = dense.reconstruct_minima(to_array(table, grid, "v", np.float32), h, check_interval)
        return {"v": np.where(out > 0, MASK, 0.0)}

    return per_volume(field, grid, run, "v double")


def _lower(arrays: dict[str, np.ndarray], _: int) -> None:
    """Reconstruction inside a tile, its halo held: sweeps along every axis, both ways, until nothing falls."""
    a, r = arrays["v"], arrays["r"]
    while True:
        before = r.copy()
        for axis in range(3):
            level, flood = np.moveaxis(a, axis, 0), np.moveaxis(r, axis, 0)
            n = len(flood) - 2
            for at, last in [(k, k - 1) for k in range(1, n + 1)] + [(k, k + 1) for k in range(n, 0, -1)]:
                low = np.minimum(np.minimum(flood[last][:-2], flood[last][1:-1]), flood[last][2:])
                low = np.minimum(np.minimum(low[:, :-2], low[:, 1:-1]), low[:, 2:])
                own = flood[at, 1:-1, 1:-1]
                np.maximum(level[at, 1:-1, 1:-1], np.minimum(own, low), out=own)
        if np.array_equal(before, r):
            return


def _h_minima_tiles(field: DataFrame, tiling: Tiling, h: float) -> DataFrame:
    """Tiles flood down on their own, borders are exchanged until none falls: the same least flood in any order."""
    kind = TileArrays(tiling, {"v": (np.float32, np.inf), "r": (np.float32, np.inf)}, ("r",))

    def start(arrays: dict[str, np.ndarray], tile: int) -> None:
        if np.isnan(arrays["v"]).any():
            raise InvalidArgument("H-minima need finite values")
        arrays["r"][...] = arrays["v"] + np.float32(h)
        _lower(arrays, tile)

    settled = settle(DurableTable(gather(field, kind, start), "h-minima"), kind, _lower, "h-minima")
    inner = tiling.inner()

    def pick(arrays: dict[str, np.ndarray], _: int) -> dict[str, np.ndarray]:
        return {"v": np.where(arrays["r"][inner] - arrays["v"][inner] < np.float32(1e-5), MASK, 0.0)}

    return spread(settled.df, kind, pick, "v double")


def _h_minima_rows(field: DataFrame, grid: Grid, h: float) -> DataFrame:
    source = durable(field.withColumn("i", F.col("v")).withColumn("v", F.col("v") + float(h)), "h-minima")
    for done in count(1):
        low = source
        for axis in ("x", "y", "z"):
            low = extreme_axis(low, axis, 1, False)
        kept = durable(source.withColumnRenamed("v", "before").join(low.select("volume_id", "z", "y", "x", "v"), ["volume_id", "z", "y", "x"]).withColumn("v", F.greatest("v", "i")), "h-minima")
        changed = kept.where("v <> before").limit(1).count()
        source = kept.drop("before")
        report("h-minima", done)
        if not changed:
            return source.select("volume_id", "z", "y", "x", F.when(F.col("v") - F.col("i") < 1e-5, F.lit(MASK)).otherwise(F.lit(0.0)).alias("v"))


def _outside(table: pa.Table, grid: Grid) -> np.ndarray:
    return to_array(table, grid, "outside", bool)


def _with_outside(rows: DataFrame, grid: Grid, crop: Crop | None) -> DataFrame:
    if crop is None:
        return rows.withColumn("outside", F.lit(False))
    keys = ["volume_id", "z", "y", "x"]
    marks = crop_mask(rows.select(*keys, F.lit(0.0).alias("v")), grid, crop, 1.0).select(*keys, (F.col("v") > 0).alias("outside"))
    return rows.join(marks, keys)


_NEVER = np.iinfo(np.int32).max


def _grow_within(arrays: dict[str, np.ndarray], allowed: np.ndarray) -> None:
    """Times and labels of the tile's voxels, growing from ``start`` and from the halo as it is.

    A voxel's time is the number of steps from what was labelled; its label is
    that of the first neighbour, in the fixed order, of one step less.
    """
    time, label, start = arrays["time"], arrays["label"], arrays["start"]
    inner = (slice(2, -2),) * 3
    shape = time.shape
    own_time, own_label = time[inner], label[inner]
    own_time[...] = np.where(start[inner] >= 0, 0, _NEVER)
    own_label[...] = start[inner]
    now = 0
    while now <= time[time < _NEVER].max(initial=-1):
        open_ = allowed & (own_time == _NEVER)
        for d in dense.NEIGHBOUR_ORDER:
            near = tuple(slice(2 + s, n - 2 + s) for s, n in zip(d, shape, strict=True))
            take = open_ & (time[near] == now) & (label[near] >= 0)
            own_label[take] = label[near][take]
            own_time[take] = now + 1
            open_ &= ~take
        now += 1


def _open_within(arrays: dict[str, np.ndarray], _: int) -> bool:
    """Labels opened by one voxel (with a halo of two); whether they differ from the level's start."""
    label = arrays["label"]
    ring = (slice(1, -1),) * 3
    opened = label[ring].copy()
    differs = np.zeros(opened.shape, bool)
    for d in dense.NEIGHBOUR_ORDER:
        near = label[tuple(slice(1 + s, n - 1 + s) for s, n in zip(d, label.shape, strict=True))]
        differs |= (near != dense.OUTSIDE) & (near != opened)
    opened[(opened >= 0) & differs] = BACKGROUND
    own = opened[ring].copy()
    open_ = own < 0
    for d in dense.NEIGHBOUR_ORDER:
        near = opened[tuple(slice(1 + s, n - 1 + s) for s, n in zip(d, opened.shape, strict=True))]
        take = open_ & (near >= 0)
        own[take] = near[take]
        open_ &= ~take
    inner = (slice(2, -2),) * 3
    label[inner] = own
    return not np.array_equal(own, arrays["start"][inner])


def _watershed_tiles(rows: DataFrame, tiling: Tiling, levels: int) -> DataFrame:
    """Level by level: times and labels settle across tiles, then one step opens the labels.

    Synchronous growth gives each voxel the label of a neighbour that is one step
    nearer, so it doesn't matter in which order tiles find the times.  Levels at
    which no voxel is added are skipped while nothing changes.
    """
    kind = TileArrays(tiling, {"v": (np.float32, np.inf), "label": (np.int32, dense.OUTSIDE), "time": (np.int32, _NEVER), "start": (np.int32, BACKGROUND)}, ("label", "time"))
    inner = tiling.inner()
    tops = (np.arange(1, levels + 1, dtype=np.float32) / np.float32(levels)).astype(np.float32)

    def met(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                v = kind.load(batch, k, batch.column("tile")[k].as_py())["v"][inner]
                found = np.unique(np.searchsorted(tops, v)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["level"])

    def grow(level: int, fresh: bool):
        def kernel(arrays: dict[str, np.ndarray], _: int) -> None:
            if fresh:
                arrays["start"][...] = arrays["label"]
                arrays["time"][...] = np.where(arrays["label"] >= 0, 0, _NEVER)
            _grow_within(arrays, arrays["v"][inner] <= tops[level - 1])

        return kernel

    state = DurableTable(gather(rows, kind), "watershed")
    new = {r.level for r in state.df.select("volume_id", "tile", *kind.columns).mapInArrow(met, "level int").distinct().collect()}

    def then(state: DurableTable, kernel) -> DurableTable:
        following = DurableTable(step(state.df, kind, kernel, touched_only=False), "watershed")
        state.drop()
        return following

    changed = True
    for level in range(1, levels + 1):
        if not changed and level not in new:
            continue
        state = settle(then(state, grow(level, True)), kind, grow(level, False), "watershed")
        state = then(state, _open_within)
        changed = not state.df.where("changed").isEmpty()
        report("watershed", level, levels)
    return spread(state.df, kind, lambda arrays, _: {"label": arrays["label"][inner]}, "label int")


def watershed(
    field: DataFrame, seeds: DataFrame, grid: Grid, selected: DataFrame, *, least_seed: int = 0, crop: Crop | None = None, levels: int = 256, engine: str = "auto", side: int | tuple[int, int, int] = SIDE
) -> DataFrame:
    """Labels grown from the selected seeds that have ``least_seed`` voxels; ids are kept.

    seeds(volume_id, z, y, x, label), selected(volume_id, label).  Engines: "kernel" (a volume a task), "tiles".
    """
    if least_seed < 0 or not 1 <= levels <= 65_535:
        raise InvalidArgument("the least seed size must not be negative, levels are 1 to 65535")
    sizes = seeds.where("label >= 0").groupBy("volume_id", "label").agg(F.count(F.lit(1)).alias("n")).join(selected, ["volume_id", "label"]).where(F.col("n") >= least_seed)
    sizes = durable(sizes, "seeds")
    if sizes.isEmpty():
        raise InvalidArgument("no selected seed is large enough")
    keys = ["volume_id", "z", "y", "x"]
    chosen = seeds.join(sizes.select("volume_id", "label"), ["volume_id", "label"]).select(*keys, "label")
    rows = _with_outside(field.join(chosen, keys, "left").withColumn("label", F.coalesce("label", F.lit(-1))), grid, crop)
    if _tiled(engine, grid):
        level = F.when(F.col("outside"), F.lit(float(np.finfo(np.float32).max))).otherwise(F.col("v"))
        return _watershed_tiles(rows.withColumn("v", level), Tiling.of(grid, 2, side), levels)

    def run(_: str, table: pa.Table) -> dict[str, np.ndarray]:
        level = np.where(_outside(table, grid), np.finfo(np.float32).max, to_array(table, grid, "v", np.float32))
        return {"label": dense.watershed(level, to_array(table, grid, "label", np.int32), levels)}

    return per_volume(rows, grid, run, "label int")


def _staged(rows: DataFrame, grid: Grid, masks_of, options: dict) -> DataFrame:
    def run(_: str, table: pa.Table) -> dict[str, np.ndarray]:
        outside = _outside(table, grid)
        labels, _, passes = dense.staged_segmentation(masks_of(table), outside.shape, outside=outside if outside.any() else None, **options)
        return {"label": labels, "passes": np.full(labels.shape, passes, np.int32)}

    return per_volume(rows, grid, run, "label int, passes int")


def _closed_invalid(arrays: dict[str, np.ndarray], own: tuple[slice, ...], first: dict) -> dict[str, np.ndarray]:
    """For each candidate near a tile, the tile's voxels that its closing adds though they are neither dark nor labelled."""
    radius, cand = first["thickness"] // 2, arrays["cand"]
    free = (cand < 0) & (arrays["label"] < 0)
    ids, compact = np.unique(cand, return_inverse=True)
    compact = compact.reshape(cand.shape) - int(ids[0] < 0)
    ids, counts = ids[ids >= 0], []
    tile = np.zeros(cand.shape, bool)
    tile[own] = True
    for c, box in enumerate(dense.label_boxes(compact)):
        box = tuple(slice(max(0, s.start - 2 * radius), s.stop + 2 * radius) for s in box)
        closed = dense.chunked((compact[box] == c).astype(np.float32), radius, False)
        counts.append(int(((closed > 0) & free[box] & tile[box]).sum()))
    return {"cand": ids.astype(np.int32), "n": np.array(counts, np.int64)}


def _staged_tiles(rows: DataFrame, grid: Grid, masks: list[Column], options: dict, side: int | tuple[int, int, int]) -> DataFrame:
    """A pass is one plan: mask, closing and wall thickness on tiles, components, all candidates checked at once, ids by rank.

    masks: MASK or 0 from the columns of rows.  Volumes that wait for nothing leave the loop.
    """
    keys, tiling = ["volume_id", "z", "y", "x"], Tiling.of(grid, 1, side)
    source = durable(rows, "staged")
    labels = durable(source.select(*keys, F.lit(BACKGROUND).alias("label")), "staged")
    volumes = durable(source.select("volume_id").distinct().select("volume_id", *(F.lit(0).alias(c) for c in ("thickness", "known", "passes")), F.lit(False).alias("done")), "staged")
    for number, mask in enumerate(masks):
        final = number == len(masks) - 1
        active = volumes.where(~F.col("done")).select("volume_id", F.col("thickness").alias("before"), "known")
        if active.isEmpty():
            break
        made = source.join(active, "volume_id").select(*keys, mask.alias("v"))
        closed = ball_closing(made, grid, options["closing_radius"]) if options["closing_radius"] else made
        facts = source.select(*keys, "outside").join(labels, keys).join(active, "volume_id").join(closed, keys)
        base = durable(facts.withColumn("v", F.when(F.col("label") >= 0, F.lit(0.0)).otherwise(F.col("v"))), "staged")
        walls = wall_thickness_tiles(base.select(*keys, F.when(F.col("outside"), F.lit(0.0)).otherwise(F.col("v")).alias("v")), tiling, active.select("volume_id", F.floor(F.col("before") / 2).cast("int").alias("start")))
        walls = durable(walls, "staged")
        dark = (F.col("v") <= LOW) & ~F.col("outside") & (F.col("label") < 0)
        found = components.label(base, grid, dark, 6, options["more_than"] + 1, engine="tiles", side=side).withColumnRenamed("label", "cand")
        joined = durable(base.select(*keys, "label", "known").join(found, keys).join(walls, "volume_id"), "staged")
        candidates = joined.where("cand >= 0").select("volume_id", "cand", "known", "thickness").distinct().withColumn("n", F.lit(0).cast("long"))
        if not final:
            reach = 2 * ((joined.agg(F.max("thickness")).first()[0] or 0) // 2)
            added = deal(joined, tiling, reach, {"cand": np.int32, "label": np.int32}, _closed_invalid, "cand int, n long", ("thickness",))
            added = added.groupBy("volume_id", "cand").agg(F.sum("n").alias("n"))
            candidates = candidates.drop("n").join(added, ["volume_id", "cand"])
        # in single precision, as a kernel's bound is
        bound = (F.lit(float(np.float32(options["invalid_area"]))).cast("float") * F.col("thickness").cast("float")).cast("double")
        checked = durable(candidates.withColumn("waits", F.lit(False) if final else F.col("n") > bound), "staged")
        taken = checked.where("not waits").select("volume_id", "cand", (F.row_number().over(Window.partitionBy("volume_id").orderBy("cand")) - 1 + F.col("known")).cast("int").alias("id"))
        grown = joined.join(taken, ["volume_id", "cand"], "left").select(*keys, F.coalesce("id", "label").alias("label"))
        kept = labels.join(volumes.where("done").select("volume_id"), "volume_id", "left_semi")
        sums = checked.groupBy("volume_id").agg(F.sum((~F.col("waits")).cast("int")).cast("int").alias("more"), F.max("waits").alias("waits"))
        following = active.join(walls, "volume_id").join(sums, "volume_id", "left").select(
            "volume_id", "thickness", (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"), F.lit(number + 1).alias("passes"), (~F.coalesce("waits", F.lit(False))).alias("done")
        )
        labels, volumes = durable(grown.unionByName(kept), "staged"), durable(following.unionByName(volumes.where("done")), "staged")
        report("segmentation", number + 1, len(masks))
    return labels.join(volumes.select("volume_id", "passes"), "volume_id")


def _options(closing: int, min_size: int, min_invalid_area: float) -> dict:
    if not 0 <= closing <= 64 or min_size < 0 or min_invalid_area < 0:
        raise InvalidArgument("closing is 0 to 64; sizes must not be negative")
    return {"closing_radius": closing, "more_than": min_size, "invalid_area": min_invalid_area}


def threshold_sweep(field: DataFrame, grid: Grid, low: float, high: float, step: float, *, closing: int = 2, min_size: int = 0, min_invalid_area: float = 100.0, crop: Crop | None = None, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """(volume_id, z, y, x, label, passes): segmentation over falling thresholds.

    Engines: "kernel" (a volume a task), "tiles".
    """
    schedule, options = descending_schedule(low, high, step), _options(closing, min_size, min_invalid_area)
    if _tiled(engine, grid):
        levels = [F.when(F.col("v").cast("float") >= F.lit(float(np.float32(t))).cast("float"), F.lit(MASK)).otherwise(F.lit(0.0)) for t in schedule]
        return _staged_tiles(_with_outside(field, grid, crop), grid, levels, options, side)

    def masks(table: pa.Table):
        v = to_array(table, grid, "v", np.float32)
        return [lambda t=t: np.where(v >= np.float32(t), np.float32(MASK), np.float32(0)) for t in schedule]

    return _staged(_with_outside(field, grid, crop), grid, masks, options)


def directional_segmentation(
    field: DataFrame, grid: Grid, *, radius: int, level: int = 2, kernel: Kernel = Kernel.GAUSSIAN, low: float, high: float, step: float, z_factor: float = 0.2, closing: int = 2, min_size: int = 0, min_invalid_area: float = 500.0, crop: Crop | None = None, engine: str = "auto", side: int | tuple[int, int, int] = SIDE
) -> DataFrame:
    """Segmentation over rising constants of the directional threshold; the response is made once, on slabs."""
    schedule, options = ascending_schedule(low, high, step), _options(closing, min_size, min_invalid_area)
    if z_factor < 0:
        raise InvalidArgument("the Z factor must not be negative")
    enforce(estimate(grid.width, grid.height, grid.depth, radius, level, schedule))
    found = durable(response(field, grid, radius, level, kernel), "response")
    return segmentation_from_response(found, grid, schedule, z_factor, options, crop, engine, side)


def segmentation_from_response(
    found: DataFrame, grid: Grid, schedule: list[float], z_factor: float, options: dict, crop: Crop | None = None, engine: str = "auto", side: int | tuple[int, int, int] = SIDE
) -> DataFrame:
    if _tiled(engine, grid):
        # in single precision, in a kernel's order
        v, least, alpha = (F.col(c).cast("float") for c in ("v", "least", "alpha"))

        def bent(c: float) -> Column:
            c32, z32 = np.float32(c), np.float32(z_factor)
            return F.lit(float(c32)).cast("float") * (F.lit(1.0).cast("float") - alpha) + F.lit(float(c32 * z32)).cast("float") * alpha

        levels = [F.when(v > least - bent(c), F.lit(MASK)).otherwise(F.lit(0.0)) for c in schedule]
        return _staged_tiles(_with_outside(found, grid, crop), grid, levels, options, side)

    def masks(table: pa.Table):
        v, least, alpha = (to_array(table, grid, c, np.float32) for c in ("v", "least", "alpha"))

        def mask(c: float) -> np.ndarray:
            c32, z32 = np.float32(c), np.float32(z_factor)
            return np.where(v > least - (c32 * (1 - alpha) + c32 * z32 * alpha), np.float32(MASK), np.float32(0))

        return [lambda c=c: mask(c) for c in schedule]

    return _staged(_with_outside(found, grid, crop), grid, masks, options)


#: Radii tried in one pass over the tiles.
RADII = 4


def _openings(arrays: dict[str, np.ndarray], own: tuple[slice, ...], first: dict) -> dict[str, np.ndarray]:
    """Sums of |v| over the tile: of the field (radius 0) and of its openings by some radii."""
    v = arrays["v"]
    radii = [r for r in range(first["start"], first["start"] + RADII) if r <= first["top"]]
    total = lambda a: float(np.abs(a[own].astype(np.float64)).sum())
    return {"radius": np.array([0, *radii], np.int32), "total": np.array([total(v), *(total(dense.chunked(v, r, True)) for r in radii)])}


def wall_thickness_tiles(field: DataFrame, tiling: Tiling, starts: DataFrame) -> DataFrame:
    """(volume_id, thickness) with starts(volume_id, start): some radii a pass, until each volume has its first."""
    top = max(tiling.extents)
    pending = durable(starts.select("volume_id", F.least(F.greatest("start", F.lit(1)), F.lit(top)).alias("start")), "thickness")
    found = []
    while (most := pending.agg(F.max("start")).first()[0]) is not None and most <= top:
        rows = field.join(pending, "volume_id").withColumn("top", F.lit(top))
        sums = deal(rows, tiling, 2 * min(most + RADII - 1, top), {"v": np.float32}, _openings, "radius int, total double", ("start", "top"))
        sums = durable(sums.groupBy("volume_id", "radius").agg(F.sum("total").alias("total")), "thickness")
        whole = sums.where("radius = 0").select("volume_id", F.col("total").alias("whole"))
        hit = sums.where("radius > 0").join(whole, "volume_id").where(F.col("total") <= F.col("whole") * 0.5).groupBy("volume_id").agg((F.min("radius") * 2).alias("thickness"))
        # a volume that has tried all radii has twice the largest
        state = durable(pending.join(hit, "volume_id", "left").withColumn("thickness", F.coalesce("thickness", F.when(F.col("start") + RADII > top, F.lit(2 * top)))), "thickness")
        found.append(state.where("thickness IS NOT NULL").select("volume_id", "thickness"))
        pending = state.where("thickness IS NULL").select("volume_id", (F.col("start") + RADII).alias("start"))
        report("wall thickness", min(most + RADII - 1, top), top)
    return reduce(DataFrame.unionByName, found) if found else pending.select("volume_id", F.lit(0).alias("thickness"))


def wall_thickness(field: DataFrame, grid: Grid, start_radius: int = 1, engine: str = "auto", side: int | tuple[int, int, int] = SIDE) -> DataFrame:
    """(volume_id, thickness): twice the first radius whose chunked opening leaves at most half of sum |v|.

    Engines: "kernel" (a volume a task), "tiles".
    """
    if _tiled(engine, grid):
        return wall_thickness_tiles(field, Tiling.of(grid, 1, side), field.select("volume_id").distinct().withColumn("start", F.lit(start_radius)))

    def run(table: pa.Table) -> pa.Table:
        found = dense.wall_thickness(to_array(table, grid, "v", np.float32), start_radius)
        return pa.table({"volume_id": pa.array([table.column("volume_id")[0].as_py()]), "thickness": pa.array([found], pa.int32())})

    return field.groupBy("volume_id").applyInArrow(run, "volume_id string, thickness int")


def require_labels(labels: DataFrame) -> None:
    if labels.where("label < -1").limit(1).count():
        raise InvalidState("labels are -1 or more")
