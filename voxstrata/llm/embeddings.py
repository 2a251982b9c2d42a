"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference points (pivots), in
order of their numbers.  Two vectors are a candidate if they share at least
``SHARED`` pivots.  An inverted list holds, for each (label, length, pivot), the
vectors that have the pivot in their description; with the first
``NEAREST - SHARED + 1`` pivots posted such a pair meets, and it is handled in
the list of its least shared pivot only.  A list of more than ``SPLIT`` members is
cut by the next shared pivot into lists of two pivots, those again into lists of
three; this changes no candidate, as a pair that shares enough pivots has its
least ones in common.  So lists stay short although the number of pivots is
bounded.  Lists hold ids and descriptions; vectors are sent to a list's tasks
only.  Candidates are verified by cosine in double precision.

Pivots are a bounded sample of distinct vectors (``MAX_PIVOTS`` at most, about
4 * sqrt(n)), thinned so that no two of them are near each other; every vector
is indexed.  Equal vectors are one class before the search.  A list of more than
``BLOCK`` members is cut into blocks, and its pairs of blocks are separate
tasks.  Members that share a pivot below the list's own are handled elsewhere:
those with the list's most frequent such pivot are put into blocks of their own,
which aren't compared with each other.  A task returns for its members the number
of links and one edge to a local root, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label, link with nothing and are their own
component; vectors of different lengths don't link; rows that repeat a vector
are linked with each other; null ids count as rows but are nobody's component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.durable import durable

NEAREST = 8
SHARED = 3
MAX_PIVOTS = 8_192
MIN_PIVOTS = 16
THIN_COSINE = 0.9
BLOCK = 2_048
#: Lists of more members are cut by one more shared pivot.
SPLIT = 4 * BLOCK
SIMILARITY = 0.98


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to (vec_id, label, n, bytes); bytes are null if unusable."""
    for batch in batches:
        vectors = batch.column(2)
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        single = vectors.type.value_type == pa.float32()
        # nulls become NaN; -0.0 equals 0.0
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8") + (np.float32(0) if single else 0.0)
        row = np.repeat(np.arange(len(lengths)), lengths)
        bad = np.bincount(row[~np.isfinite(flat)], minlength=len(lengths)) > 0
        ok = ~bad & (np.bincount(row[flat != 0], minlength=len(lengths)) > 0)
        lengths = np.where(ok, lengths, 0)
        offsets = np.r_[0, np.cumsum(lengths * flat.itemsize)].astype(np.int32)
        parts = [pa.py_buffer(np.packbits(ok, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(flat[ok[row]])]
        raw = pa.Array.from_buffers(pa.binary(), len(lengths), parts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), raw], names=["vec_id", "label", "n", "raw"])


def _matrix(raw: pa.Array, n: int) -> np.ndarray:
    width = len(raw[0].as_py()) // n
    return np.frombuffer(b"".join(raw.to_pylist()), "<f4" if width == 4 else "<f8").astype(np.float64).reshape(-1, n)


def choose_pivots(classes: DataFrame, count: int, per_length: int = 2) -> dict[int, np.ndarray]:
    """Thinned unit pivots by vector length: a sample by hash of at most per_length * MAX_PIVOTS."""
    wanted = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 ** np.ceil(np.log2(4 * max(count, 1) ** 0.5)))))
    sample = classes.orderBy(F.xxhash64(F.lit(5), "n", "raw"), "n", "raw").limit(per_length * wanted).select("n", "raw").collect()
    pivots: dict[int, np.ndarray] = {}
    used: dict[int, int] = {}
    for row in sample:
        v = _unit(np.frombuffer(row.raw, "<f4" if len(row.raw) == 4 * row.n else "<f8").astype(np.float64)[None])[0]
        table = pivots.setdefault(row.n, np.zeros((wanted, row.n)))
        have = used.get(row.n, 0)
        if have < wanted and (have == 0 or float(np.max(table[:have] @ v)) < THIN_COSINE):
            table[have] = v
            used[row.n] = have + 1
    return {n: table[: used[n]] for n, table in pivots.items()}


def _describe(shared, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            lengths = batch.column("n").to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                points = pivots.get(int(n))
                if points is None:  # a length outside the sample: one list for all
                    described = np.zeros((len(rows), 1), np.int32)
                else:
                    m = min(nearest, len(points))
                    near = np.empty((len(rows), m), np.int32)
                    for a in range(0, len(rows), 4096):
                        similar = _unit(_matrix(batch.column("raw").take(pa.array(rows[a : a + 4096])), int(n))) @ points.T
                        near[a : a + 4096] = np.argpartition(-similar, m - 1, axis=1)[:, :m]
                    described = np.sort(near, axis=1)
                part = batch.take(pa.array(rows))
                ends = np.arange(len(rows) + 1, dtype=np.int32) * described.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(described.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("label"), part.column("n"), lists], names=["cls", "label", "n", "described"])

    return run


_LIST = ["label", "n", "pivots"]


def _deeper(members: DataFrame, level: int, needed: int) -> DataFrame:
    """Members in lists of ``level`` pivots, from lists of one pivot less (at: place of the last one)."""
    size = F.size("described")
    last = size - F.least(F.lit(needed), size) + level
    places = F.when(F.col("at") < last, F.sequence(F.col("at") + 1, last)).otherwise(F.array().cast("array<int>"))
    pivots = F.array_append("pivots", F.element_at("described", F.col("at")))
    return members.withColumn("at", F.explode(places)).withColumn("pivots", pivots).select("cls", *_LIST, "described", "at")


def _leaf_lists(described: DataFrame, needed: int, split: int) -> list[DataFrame]:
    """(cls, label, n, pivots, described, at, members): the lists to search, of one pivot and more."""
    members = described.withColumns({"pivots": F.array().cast("array<int>"), "at": F.lit(0)})
    leaves = []
    for level in range(1, needed + 1):
        members = durable(_deeper(members, level, needed), "pivot-lists")
        lists = durable(members.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "pivot-list-sizes")
        counted = members.join(lists, _LIST)
        more = (F.col("members") > split) & (F.least(F.lit(needed), F.size("described")) > level)
        leaves.append(counted.where(~more))
        if level == needed or lists.where(F.col("members") > split).isEmpty():
            break
        members = counted.where(more).drop("members")
    return leaves


def _tasks(leaf: DataFrame, block: int) -> DataFrame:
    """leaf with block, block_a, block_b: each member once for every task that it is in."""
    below = F.array_except(F.slice("described", 1, F.col("at") - 1), F.col("pivots"))
    large = leaf.where(F.col("members") > block)
    common = large.select(*_LIST, F.explode(below).alias("x")).groupBy(*_LIST, "x").agg(F.count(F.lit(1)).alias("having"))
    common = common.groupBy(*_LIST).agg(F.max(F.struct("having", "x")).alias("c")).select(*_LIST, F.col("c.x").alias("x"), F.col("c.having").alias("having"))
    shared = F.coalesce(F.array_contains(below, F.col("x")), F.lit(False))
    split_off = F.ceil(F.coalesce("having", F.lit(0)) / F.lit(block)).cast("int")
    others = F.ceil((F.col("members") - F.coalesce("having", F.lit(0))) / F.lit(block)).cast("int")
    placed = large.join(common, _LIST, "left").withColumns({"shared": shared, "first": split_off, "cuts": split_off + others})
    spot = F.xxhash64("cls")
    placed = placed.withColumn("block", F.when(F.col("shared"), F.pmod(spot, F.col("first"))).otherwise(F.col("first") + F.pmod(spot, F.col("cuts") - F.col("first"))).cast("int"))
    start = F.when(F.col("shared"), F.col("first")).otherwise(0)
    other = F.when(start < F.col("cuts"), F.sequence(start, F.col("cuts") - 1)).otherwise(F.array().cast("array<int>"))
    columns = ["cls", *_LIST, "described", "at", "block"]
    pairs = placed.withColumn("other", F.explode(other)).select(*columns, F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"))
    whole = leaf.where(F.col("members") <= block).withColumns({"block": F.lit(0), "block_a": F.lit(0), "block_b": F.lit(0)})
    return pairs.unionByName(whole.select(*columns, "block_a", "block_b"))


def _verify(needed: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, pivots = table.column("n")[0].as_py(), table.column("pivots")[0].as_py()
        a, b = table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py()
        ids = table.column("cls").to_numpy()
        weight = table.column("copies").to_numpy()
        side = table.column("block").to_numpy()
        unit = _unit(_matrix(table.column("raw").combine_chunks(), n))
        described = table.column("described").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        need = min(needed, described.shape[1])
        known, local = np.unique(described, return_inverse=True)
        local = local.reshape(described.shape)
        hot = np.zeros((len(ids), int(local.max()) + 1), np.float32)
        np.put_along_axis(hot, local, 1, axis=1)
        # pivots that a pair of this list doesn't share
        low = hot[:, (known < pivots[-1]) & ~np.isin(known, pivots)]
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        pairs_l, pairs_r = [], []
        for s in range(0, len(left), 1024):
            rows = left[s : s + 1024]
            ok = hot[rows] @ hot[right].T >= need
            if low.shape[1]:
                ok &= low[rows] @ low[right].T == 0
            if not ok.any():
                continue
            ok &= unit[rows] @ unit[right].T >= threshold
            if a == b:
                ok &= rows[:, None] != right[None, :]
            links[rows] += ok @ weight[right]
            if a != b:
                links[right] += weight[rows] @ ok
            i, j = np.nonzero(ok)
            # within the strip a member keeps one edge, to its least partner
            if len(i):
                first = np.minimum.reduceat(right[j], np.flatnonzero(np.r_[True, i[1:] != i[:-1]]))
                pairs_l.append(rows[np.unique(i)])
                pairs_r.append(first)
                order = np.argsort(j, kind="stable")
                jj = j[order]
                pairs_l.append(right[np.unique(jj)])
                pairs_r.append(np.minimum.reduceat(rows[i[order]], np.flatnonzero(np.r_[True, jj[1:] != jj[:-1]])))
                # the partners of a member are connected through it
                pairs_l.append(right[j])
                pairs_r.append(rows[i])
                root = _merge(root, np.concatenate(pairs_l), np.concatenate(pairs_r))
                pairs_l, pairs_r = [], []
        out = np.flatnonzero(links > 0)
        return pa.table({"cls": pa.array(ids[out]), "links": pa.array(links[out]), "root": pa.array(ids[root[out]])})

    return run


def _merge(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least-index roots after joining u and v."""
    root = root.copy()
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = SIMILARITY, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    packed = narrow.mapInArrow(_pack, "vec_id long, label string, n int, raw binary")
    usable = F.col("raw").isNotNull() & F.col("label").isNotNull()
    rows = durable(packed.withColumn("key", F.when(usable, F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.base64(F.encode("label", "UTF-8")), F.base64("raw")), 256))), "vectors")
    classes = durable(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("n").alias("n"), F.first("raw").alias("raw")).withColumn("cls", F.monotonically_increasing_id()),
        "vector-classes",
    )
    count = classes.count()
    points = spark.sparkContext.broadcast(choose_pivots(classes, count))
    described = durable(classes.select("cls", "label", "n", "raw").mapInArrow(_describe(points, nearest), "cls long, label string, n int, described array<int>"), "descriptions")
    tasks = reduce(DataFrame.unionByName, [_tasks(leaf, block) for leaf in _leaf_lists(described, shared, split)])
    # ids only up to here: a vector is sent once for each of its tasks
    members = tasks.join(classes.select("cls", "copies", "raw"), "cls")
    found = durable(members.groupBy(*_LIST, "block_a", "block_b").applyInArrow(_verify(shared, threshold), "cls long, links long, root long"), "vector-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("cls", "root"), "cls", "root")
    of_class = classes.select("key", "cls", "copies", "least").join(links, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "least", F.coalesce("component", "cls").alias("part"))
    least = of_class.groupBy("part").agg(F.min("least").alias("component_id"))
    facts = of_class.join(least, "part").select("key", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
