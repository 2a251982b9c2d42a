"""Collections as Parquet: partitioned by volume and channel, clustered by z.

A channel prunes partitions, a plane or a depth crop prunes row groups by their
z statistics, and operators read only the columns they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLLECTION_SCHEMA = "z int, y int, x int, v double, volume_id string, c int"


def write_collection(collection: DataFrame, path: str, mode: str = "error") -> None:
    """Rows of a volume and channel are spread by ranges of z, so a large volume has many files."""
    ordered = collection.select("volume_id", "c", "z", "y", "x", "v").repartitionByRange("volume_id", "c", "z").sortWithinPartitions("volume_id", "c", "z", "y", "x")
    ordered.write.mode(mode).partitionBy("volume_id", "c").parquet(path)


def read_collection(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """The collection; with ``view``, also a view of that name for SQL."""
    collection = spark.read.schema(COLLECTION_SCHEMA).parquet(path).select("volume_id", "c", "z", "y", "x", "v")
    if view:
        collection.createOrReplaceTempView(view)
    return collection
