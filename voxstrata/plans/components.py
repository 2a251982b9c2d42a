"""Connected components of an edge relation, in a logarithmic number of rounds.

Large-star and small-star steps alternate until the edges no longer change; the
edges are then stars around each component's least node.  Every step is a
partially aggregated minimum and an equi-join, so a node with very many
neighbours is pre-aggregated before the shuffle and its join partition can be
split by AQE.  Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import DurableTable
from .progress import report


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step; edges (u > v)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    below = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        large.join(below, "u")
        .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u != v")
        .distinct()
    )


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the least node of the component.  Null ends and loops are
    ignored.
    """
    start = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    table, mark = DurableTable(start, "cc"), None
    for done in range(max_rounds):
        now = table.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or now["n"] == 0:
            break
        mark = now
        following = DurableTable(_star(table.df), "cc")
        table.drop()
        table = following
        report("components", done + 1)
    else:
        raise RuntimeError("components did not settle")
    stars = table.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select("v", "v").distinct())
