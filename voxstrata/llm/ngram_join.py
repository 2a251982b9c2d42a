"""N-gram Jaccard join of documents by grouped prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; two
documents link if their sets' Jaccard similarity is at least 3/4.

1. Documents with equal sets are one class.  A sketch of ``SKETCH`` counters
   (fixed size, summed over all documents) orders shingles from rare to common.
2. A class of n shingles has a prefix of its n - ceil(0.75 n) + 1 first
   shingles in that order; linked classes share a prefix shingle.  Classes with
   equal size and prefix are one group, and (shingle, group) pairs are joined.
3. Group pairs that share a shingle are filtered by size and by the places of
   the shingle in both orders, expanded to their member classes, and members are
   verified on their whole sets.

Components come first; a group of near copies may be large, so for them the
pairs of a list are not enumerated.  First every member of a list is
verified against the list's *hub*, the member that stands in most lists, and
what that connects is merged.  Then the rest is made whole: in every list that
still has several components, each pair of classes from different components is
verified, except pairs inside the list's largest component.  No link between
components can be missed by this: a linked pair is in some list, and it is
verified there unless its two classes are in one component already.

Links are counted, or given as pairs of classes, on the whole: every link lies
inside a component, so all pairs of a component's classes are verified on their
whole sets.  A component is cut into blocks of at most about ``BLOCK`` classes
and ``BLOCK_SHINGLES`` shingles; pairs of blocks are separate tasks, so a text
travels once for each block of its component.  Small components share tasks, a
task compares tiles of its blocks and returns numbers for its classes.

Defined cases: null or empty texts and texts without words have an empty set
and link with nothing; fewer than 5 words make one shingle; repeated rows are
one class; a null doc_id counts as a row, and a component has the least non-null
doc_id; an empty table gives an empty result; other columns are ignored.
Classes and shingles are 64-bit hashes: at 10**9 distinct sets the chance that
any two unequal sets are taken for equal is about 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.components import connected_components
from ..plans.durable import DurableTable, durable
from .textkernel import U64, mix64, shingle_sets, text_chunks, trim_memory

SHINGLE = 5
SKETCH = 1 << 21
_SKETCH_BLOCK = 1 << 13
#: Jaccard threshold as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Classes and shingles of a block of a component whose links are counted.
BLOCK, BLOCK_SHINGLES = 4_096, 1 << 21
#: A tile of a block, what is compared at a time, has a quarter of its classes and at most about so many shingles.
TILE_SHINGLES = 1 << 18
_COLUMNS = 4_096


def set_key(shingles: np.ndarray) -> int:
    """64-bit hash of a set, 0 for the empty one."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        total = mix64(shingles ^ U64(0x5DEECE66D)).sum(dtype=U64) * U64(len(shingles) * 2 + 1)
    return int(mix64(np.array([total], U64)).view(np.int64)[0]) or 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                cells = np.concatenate(list(shingle_sets(data, offs, k)))
                np.add.at(counts, (cells & U64(SKETCH - 1)).astype(np.int64), 1)
        yield from _blocks(counts)
        trim_memory()

    return run


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = [b for b in range(SKETCH // _SKETCH_BLOCK) if counts[b * _SKETCH_BLOCK : (b + 1) * _SKETCH_BLOCK].any()]
    parts = []
    for b in used:
        part = counts[b * _SKETCH_BLOCK : (b + 1) * _SKETCH_BLOCK]
        parts.append(part.astype("<u2" if part.max() < 1 << 16 else "<i8").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums blocks as they stream by; at most all blocks of one sketch are held."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, "<u2" if len(raw) == 2 * _SKETCH_BLOCK else "<i8").astype(np.int64)
            if block in counts:
                counts[block] += part
            else:
                counts[block] = part
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in counts.values()], pa.binary())], names=["block", "counts"])


def shingle_sketch(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> np.ndarray:
    """Counters of all documents' shingles; SKETCH numbers reach the driver whatever the input's size."""
    schema = "block int, counts binary"
    summed = docs.select(text).mapInArrow(_count(k), schema).repartition("block").mapInArrow(_add_blocks, schema)
    counts = np.zeros(SKETCH, np.int64)
    for row in summed.collect():
        counts[row.block * _SKETCH_BLOCK : (row.block + 1) * _SKETCH_BLOCK] += np.frombuffer(row.counts, "<i8")
    # logarithmic ranks of 16 bits keep frequent shingles apart from the rest at any size of the corpus
    return np.round(np.log2(counts + 1.0) * 1000).astype(np.uint16)


def prefix(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 shingles of a sorted set, rare ones first."""
    p = len(s) + NUMERATOR * len(s) // -DENOMINATOR + 1
    return s[np.argsort(ranks[(s & U64(SKETCH - 1)).astype(np.int64)], kind="stable")[:p]]


def group_key(first: np.ndarray, n: int) -> int:
    return set_key(np.append(np.sort(first), U64(n)))


def _prefixes(shared, k: int):
    """text to (token, grp, pos): one row per prefix shingle and its place.

    A task gives each class once; it remembers the keys of its own split's
    classes, some hundred bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, set()
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                tokens, groups, places = [], [], []
                for s in shingle_sets(data, offs, k):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    first = prefix(s, ranks)
                    tokens.append(first)
                    groups.append(np.full(len(first), group_key(first, len(s)), np.int64))
                    places.append(np.arange(len(first), dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(groups)), pa.array(np.concatenate(places))], names=["token", "grp", "pos"])
        trim_memory()

    return run


def _members(shared, k: int):
    """text to (grp, key, n, packed text): one row per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, ranks, seen = zstandard.ZstdCompressor(level=3), shared.value, set()
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                out = []
                for i, s in enumerate(shingle_sets(data, offs, k)):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    out.append((group_key(prefix(s, ranks), len(s)), key, len(s), pack.compress(data[offs[i] : offs[i + 1]].tobytes())))
                if out:
                    grp, keys, n, packed = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["grp", "key", "n", "packed"])
        trim_memory()

    return run


def _check_pairs(k: int):
    """(a, b, packed_a, packed_b) to the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        last: tuple[int | None, np.ndarray | None] = (None, None)

        def read(raw: bytes) -> np.ndarray:
            text = np.frombuffer(unpack.decompress(raw), np.uint8)
            return next(shingle_sets(text, np.array([0, len(text)]), k))

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, hub in enumerate(b):
                if hub != last[0]:
                    last = (hub, read(batch.column(3)[i].as_py()))
                keep.append(linked(read(batch.column(2)[i].as_py()), last[1]))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])
        trim_memory()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of classes that link; each distinct pair is read once."""
    left = texts.select(F.col("key").alias("a"), F.col("packed").alias("packed_a"))
    right = texts.select(F.col("key").alias("b"), F.col("packed").alias("packed_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "packed_a", "packed_b")
    return rows.mapInArrow(_check_pairs(k), "a long, b long")


def _may_link(a: str, b: str):
    """Sizes and places (n<a>, pos<a>), (n<b>, pos<b>) of a common prefix shingle leave room for a link.

    If it is the first common one, the common shingles are among those from its
    places on; of a linked pair it is the first one somewhere.
    """
    na, nb, pa_, pb = (F.col(c) for c in (f"n{a}", f"n{b}", f"pos{a}", f"pos{b}"))
    return F.least(na - pa_, nb - pb) * (NUMERATOR + DENOMINATOR) >= (na + nb) * NUMERATOR


def link_classes(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(node, component) for each class that links with another; see the module's text."""
    parts, texts = _linked(docs, text, k)
    texts.drop()
    return parts


def _linked(docs: DataFrame, text: str, k: int) -> tuple[DataFrame, DurableTable]:
    """What ``link_classes`` gives, and (grp, key, n, packed) of every class that may link."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(shingle_sketch(docs, text, k))
    raw = docs.select(text)
    postings = raw.mapInArrow(_prefixes(counts, k), "token long, grp long, pos int")
    by_token = Window.partitionBy("token")
    shared = postings.withColumns({"lo": F.min("grp").over(by_token), "hi": F.max("grp").over(by_token)}).where("lo <> hi").select("token", "grp", "pos").distinct()
    lists = DurableTable(shared, "ngram-lists")
    # members: classes of groups that share a shingle with another group, or of groups with several classes
    members = raw.mapInArrow(_members(counts, k), "grp long, key long, n long, packed binary")
    in_lists = lists.df.select("grp").distinct().withColumn("listed", F.lit(True))
    by_group = Window.partitionBy("grp")
    texts = DurableTable(
        members.join(in_lists, "grp", "left").withColumns({"klo": F.min("key").over(by_group), "khi": F.max("key").over(by_group)}).where("listed OR klo <> khi").groupBy("grp", "key").agg(F.first("n").alias("n"), F.first("packed").alias("packed")),
        "ngram-texts",
    )
    facts = texts.df.select("grp", "key", "n")
    # lists of classes: by shared prefix shingle, and by group
    expanded = DurableTable(lists.df.join(facts, "grp").select("token", "key", "n", "pos").unionAll(facts.select(F.col("grp").alias("token"), "key", "n", F.lit(0).alias("pos"))), "ngram-members")

    def spread(rows: DataFrame) -> DataFrame:
        """Only lists that still have several components."""
        two = rows.groupBy("token").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select("token")
        return rows.join(two, "token")

    # the hub of a list is the member that stands in most lists, as an original among its edited copies does
    weight = expanded.df.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    weighed = expanded.df.join(weight, "key")
    hubs = weighed.groupBy("token").agg(F.max(F.struct("weight", F.col("key").alias("hub"), F.col("n").alias("nh"), F.col("pos").alias("posh"))).alias("h")).select("token", "h.hub", "h.nh", "h.posh")
    pairs = expanded.df.join(hubs, "token").where((F.col("key") != F.col("hub")) & _may_link("", "h")).select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    parts = durable(connected_components(_verified(pairs, texts.df, k), "a", "b"), "ngram-parts")
    # the rest: pairs of different components in one list, without those inside its largest component
    placed = expanded.df.join(parts.withColumnsRenamed({"node": "key"}), "key", "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("part"))
    rows = DurableTable(spread(placed), "ngram-rest")
    sizes = rows.df.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("token").agg(F.max(F.struct("c", "part")).alias("m")).select("token", F.col("m.part").alias("major"))
    marked = rows.df.join(major, "token")
    minor = marked.where("part <> major").select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("posa"), F.col("part").alias("pa"))
    every = marked.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("posb"), F.col("part").alias("pb"), (F.col("part") == F.col("major")).alias("mb"))
    pairs = minor.join(every, "token").where((F.col("pa") != F.col("pb")) & (F.col("mb") | (F.col("a") < F.col("b"))) & _may_link("a", "b")).select("a", "b").distinct()
    more = DurableTable(_verified(pairs, texts.df, k), "ngram-links")
    if not more.df.isEmpty():
        edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more.df)
        parts = durable(connected_components(edges, "a", "b"), "ngram-parts")
    for table in (lists, expanded, rows, more):
        table.drop()
    return parts, texts


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of each set in left with each in right."""
    out = np.zeros((len(left), len(right)), np.float64)
    sides = []
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        held = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], row[held][order]))
    for c in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - c)
        hot = []
        for (at, row), n in zip(sides, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, [c, c + width])
            m = np.zeros((n, width), np.float32)
            m[row[a:b], at[a:b] - c] = 1
            hot.append(m)
        out += hot[0] @ hot[1].T
    return out


def _tiles(rows: np.ndarray, sizes: np.ndarray, tile: int) -> list[np.ndarray]:
    full = np.maximum(np.arange(len(rows)) // tile, np.cumsum(sizes[rows]) // TILE_SHINGLES)
    return np.split(rows, np.flatnonzero(np.diff(full)) + 1)


def _count_links(k: int, pairs: bool, tile: int):
    """Classes of a task's components and blocks to (key, links), or to the linked (a, b) with a < b."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        table = table.sort_by("part").combine_chunks()
        block_a, block_b = table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py()
        part, keys, copies, side = (table.column(c).to_numpy() for c in ("part", "key", "copies", "block"))
        unpack = zstandard.ZstdDecompressor()
        raw = pa.array([unpack.decompress(x.as_py()) for x in table.column("packed").combine_chunks()], pa.large_binary())
        sets = [s for _, _, data, offs in text_chunks(raw.cast(pa.large_string())) for s in shingle_sets(data, offs, k)]
        sizes = np.array([len(s) for s in sets], np.int64)
        links = np.zeros(len(keys), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            left, right = (lo + np.flatnonzero(side[lo:hi] == b) for b in (block_a, block_b))
            if not len(left) or not len(right):
                continue
            same = block_a == block_b
            parts_l, parts_r = _tiles(left, sizes, tile), _tiles(right, sizes, tile)
            for i, x in enumerate(parts_l):
                for j, y in enumerate(parts_r):
                    if same and j < i:
                        continue
                    common = _common([sets[r] for r in x], [sets[r] for r in y])
                    ok = DENOMINATOR * common >= NUMERATOR * (sizes[x][:, None] + sizes[y] - common)
                    if same and i == j:
                        np.fill_diagonal(ok, False)
                    if pairs:
                        u, v = np.nonzero(np.triu(ok) if same and i == j else ok)
                        found.append((keys[x[u]], keys[y[v]]))
                        continue
                    links[x] += ok @ copies[y]
                    if not (same and i == j):
                        links[y] += copies[x] @ ok
        trim_memory()
        if pairs:
            a, b = (np.concatenate([f[side] for f in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
            return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})
        out = np.flatnonzero(links)
        return pa.table({"key": pa.array(keys[out], pa.int64()), "links": pa.array(links[out], pa.int64())})

    return run


def _links(parts: DataFrame, texts: DataFrame, copies: DataFrame, k: int, *, pairs: bool = False, block: int = BLOCK) -> DataFrame:
    """All links inside components: copies(key, copies) to (key, links to copies of other classes), or the pairs (a, b) of classes."""
    # places first, without the texts, so that these are shuffled as seldom as can be
    members = texts.select("key", "n").join(parts.select(F.col("node").alias("key"), F.col("component").alias("part")), "key").join(copies, "key")
    full = F.greatest(F.col("_c") / F.lit(block), F.col("_s") / F.lit(BLOCK_SHINGLES))
    totals = members.groupBy("part").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s"))
    sized = durable(totals.select("part", full.alias("full"), F.ceil(full).cast("int").alias("cuts")), "ngram-cuts")
    shelves = int(np.ceil(sized.where("cuts = 1").agg(F.sum("full")).first()[0] or 0)) or 1
    # components of one block share tasks that hold about a block together
    shelf = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("part"), F.lit(shelves))).otherwise(F.col("part"))
    placed = members.join(sized, "part").select("key", "part", "copies", "cuts", shelf.alias("shelf"), F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int").alias("block"))
    # a plan for few classes and for many
    spots = durable(placed, "ngram-blocks").hint("merge").join(texts.select("key", "packed"), "key")
    tasks = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other"), "single": F.col("cuts") == 1})
    kept = tasks.select("single", "shelf", "block_a", "block_b", "part", "key", "copies", "block", "packed")
    found = kept.groupBy("single", "shelf", "block_a", "block_b").applyInArrow(_count_links(k, pairs, max(1, block // 4)), "a long, b long" if pairs else "key long, links long")
    return found if pairs else found.groupBy("key").agg(F.sum("links").alias("links"))


def linked_class_pairs(docs: DataFrame, text: str = "text", k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every pair of different classes, named by set_key, that links.

    The rows grow with the square of a group of near copies.
    """
    parts, texts = _linked(docs, text, k)
    return _links(parts, texts.df, texts.df.select("key", F.lit(1).cast("long").alias("copies")), k, pairs=True, block=block)


def _keyed(k: int, at: int, keep: bool):
    """Rows with the size and key of the set of their column ``at`` behind them, and that column only if it is to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, _, data, offs in text_chunks(batch.column(at)):
                for s in shingle_sets(data, offs, k):
                    sizes.append(len(s))
                    keys.append(set_key(s))
            rest = [i for i in range(batch.num_columns) if keep or i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=[*(batch.schema.names[i] for i in rest), "n_shingles", "set_key"])
        trim_memory()

    return run


def near_duplicate_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, count_links: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, set_key, part, component_id for each row of docs.

    ``part`` names the component, also where all its doc_ids are null.  With
    ``count_links`` also n_links, the number of other rows that the row links with.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    described = durable(narrow.mapInArrow(_keyed(k, 1, False), "doc_id long, n_shingles long, set_key long"), "ngram-docs")
    parts, texts = _linked(narrow, "_text", k)
    classes = described.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    placed = classes.join(parts, F.col("set_key") == F.col("node"), "left").select("set_key", "least", "copies", F.coalesce("component", "set_key").alias("part"))
    ids = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    of_class = placed.join(ids, "part").select(F.col("set_key").alias("k"), "part", "component_id", "copies")
    extra = []
    if count_links:
        links = durable(_links(parts, texts.df, classes.select(F.col("set_key").alias("key"), "copies"), k, block=block), "ngram-link-counts")
        of_class = of_class.join(links, F.col("k") == F.col("key"), "left")
        extra = [F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links")]
    texts.drop()
    out = described.join(of_class, (F.col("set_key") == F.col("k")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", "set_key", "part", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *extra)


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """The rows of docs, one of each component: that of the least doc_id.

    Documents without words are kept.  Of rows that repeat the kept document
    one stays.
    """
    found = durable(near_duplicate_components(docs, doc_id=doc_id, text=text, k=k).where("part IS NOT NULL").groupBy("part", "doc_id", "set_key").agg(F.count(F.lit(1)).alias("rows")), "ngram-kept")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"), F.col("set_key").alias("s"))
    keeper = found.groupBy("part").agg(F.min(order).alias("k"))
    fate = found.join(keeper, "part").select(F.col("doc_id").alias("_d"), F.col("set_key").alias("_s"), (order == F.col("k")).alias("_keep"), F.col("rows").alias("_rows"))
    drop = fate.where("NOT _keep")
    again = fate.where("_keep AND _rows > 1")
    # columns by place, so that their names can't clash with those in here
    names = docs.columns
    placed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_id = f"c{names.index(doc_id)}"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    keyed = placed.mapInArrow(_keyed(k, names.index(text), True), f"{fields}, n_shingles long, set_key long")
    same = F.col(own_id).cast("long").eqNullSafe(F.col("_d")) & (F.col("set_key") == F.col("_s"))
    left = keyed.join(drop, same, "left_anti")
    if not again.isEmpty():
        once = left.join(again, same, "left_semi").dropDuplicates([own_id, "set_key"])
        left = left.join(again, same, "left_anti").unionAll(once)
    return left.select(*placed.columns).toDF(*names)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_components(docs, count_links=True).select("doc_id", "n_shingles", "n_links", "component_id")
