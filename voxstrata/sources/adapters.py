"""Volumes made of ordinary tables: counts or values over integer coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Grid

LINEITEM_GRID = Grid(50, 11, 7)
#: The least extents of the events' grid, and the number of types up to which they are broadcast.
EVENT_GRID = Grid(24, 30, 8, channels=5)
EVENT_TYPES = 10_000


def dense(sparse: DataFrame, grid: Grid, volume_ids: DataFrame, channels: bool = False) -> DataFrame:
    """Every coordinate of the grid, 0 where ``sparse`` has no row.

    The grid is a range that is split arithmetically, so it is generated in
    parallel; ``sparse`` is already aggregated to one row per coordinate.
    """
    n = grid.voxels * (grid.channels if channels else 1)
    # one list of numbers per volume, generated where the volume's row is
    spots = volume_ids.select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(grid.depth * (grid.channels if channels else 1) - 1))).alias("plane"))
    spots = spots.select("volume_id", "plane", F.explode(F.sequence(F.lit(0), F.lit(grid.width * grid.height - 1))).alias("i"))
    assert n > 0
    columns = [(F.col("plane") % grid.depth).cast("int").alias("z"), F.floor(F.col("i") / grid.width).cast("int").alias("y"), (F.col("i") % grid.width).cast("int").alias("x")]
    keys = ["volume_id", "z", "y", "x"]
    if channels:
        columns.insert(0, F.floor(F.col("plane") / grid.depth).cast("int").alias("c"))
        keys.insert(1, "c")
    return spots.select("volume_id", *columns).join(sparse, keys, "left").select(*keys, F.coalesce("v", F.lit(0.0)).cast("double").alias("v"))


def _single(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("volume_id"))


def lineitem_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over quantity (x), discount (y) and line number (z): 50 x 11 x 7."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cell = rows.groupBy((F.col("l_linenumber") - 1).cast("int").alias("z"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), (F.col("l_quantity") - 1).cast("int").alias("x"))
    counts = cell.agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("volume_id", F.lit("lineitem"))
    return dense(counts, LINEITEM_GRID, _single(spark, "lineitem"))


def event_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid of ``event_volume``: as many days and types as the table has, ``EVENT_GRID`` at least."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = rows.agg(F.max(F.dayofmonth("ts")).alias("days"), F.count_distinct("event_type").alias("kinds")).first()
    return EVENT_GRID.resized(height=max(EVENT_GRID.height, found.days or 0), channels=max(EVENT_GRID.channels, found.kinds))


def event_volume(spark: SparkSession, sf_dir: str, value: Column | None = None, grid: Grid | None = None) -> DataFrame:
    """Counts (or sums of value) over hour (x), day (y), user modulo 8 (z) and event type (c), on ``event_grid``.

    A row with a null among these is an error.
    """
    grid = grid or event_grid(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the numbering of the types: one row a type
    kinds = rows.select("event_type").distinct().withColumn("c", F.rank().over(Window.orderBy("event_type")) - 1)
    cell = rows.join(F.broadcast(kinds) if grid.channels <= EVENT_TYPES else kinds, "event_type", "left").groupBy(F.col("c").cast("int"), F.pmod("user_id", F.lit(8)).cast("int").alias("z"), (F.dayofmonth("ts") - 1).cast("int").alias("y"), F.hour("ts").cast("int").alias("x"))
    counts = cell.agg((F.count(F.lit(1)) if value is None else F.sum(value)).cast("double").alias("v")).withColumn("volume_id", F.lit("events"))
    # each coordinate is checked by itself: a join on it would drop a null before another's check sees the row
    outside = F.raise_error(F.lit("an event lies outside the grid of event_volume")).cast("int")
    counts = counts.withColumns({name: F.when(F.col(name).between(0, extent - 1), F.col(name)).otherwise(outside) for name, extent in (("c", grid.channels), ("z", grid.depth), ("y", grid.height), ("x", grid.width))})
    return dense(counts, grid, _single(spark, "events"), channels=True)


def embedding_volume(spark: SparkSession, sf_dir: str, rows_per_plane: int = 25) -> DataFrame:
    """Vector components: element (x), vec_id modulo (y) and divided by rows_per_plane (z)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spread = rows.select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return spread.select(F.lit("embeddings").alias("volume_id"), F.floor(F.col("vec_id") / rows_per_plane).cast("int").alias("z"), (F.col("vec_id") % rows_per_plane).cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))
