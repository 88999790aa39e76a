"""Near-duplicate detection with HyperMinHash sketches.

A document's set of word shingles is hashed once; the top bits of a hash choose
one of 128 registers, and a register keeps its smallest hash as the count of
leading zeros plus ten mantissa bits: 16 bits.  Four registers packed in a long
are one band of the compressed sketch, 32 bands in all, so a pair of similarity
0.75 shares no band with probability (1 - 0.75^4)^32, about 5 in a million; an
empty register is a value like any other, which makes small sets meet more
often, never less.  Sets of a few shingles fill few bands, so sets of at most
SMALL shingles also meet on single shingles, without chance: of n shingles in
the order of their hashes a similar set holds one of the first
n - ceil(0.75 n) + 1.  Documents that share a band or such a shingle are
candidates; the sketches give a collision-corrected Jaccard estimate that drops
pairs six standard deviations below the threshold, and what is left is verified
on full sets.

No bucket is expanded into all its pairs.  Documents with equal sets are one
node.  In each bucket the nodes are first compared with one pivot, the node
that shares the most bands over all; links join nodes to components; buckets
that still hold several components can get more pivots.  What is left are nodes of different components that share a band,
mostly because of a passage that many documents hold.  These are completed by
an exact prefix filter: two sets of the wanted similarity share a shingle among
the rarest quarter of each, so nodes meet only on their rare shingles, and only
those outside a shingle's largest component meet its others.  Every pair that
shares a bucket is thus verified, already connected, or ruled out.

Defined cases: null, empty and blank texts have an empty set and are linked
with nothing; a text of fewer words than the shingle width is one shingle.
A node is a set, whatever the ids of its rows, so rows that share a doc_id or
have none are linked by their own texts; a component is named by its smallest
id, null if no row of it has one, and keeps the rows of that id with the
smallest key (hash of id and text).  An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.llm.common import connected_components, row_key, stage
from conductlens.llm.shingles import WordHashes, shingle_set

REGISTERS, BANDS, MANTISSA = 128, 32, 10
PER_BAND = REGISTERS // BANDS
BODY = np.uint64(57)  # bits of a hash below the register number
SMALL = 64  # shingles up to which a set also has its exact keys


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted set: 0 is empty, else 1 + (leading zeros << 10 | mantissa)."""
    out = np.zeros(REGISTERS, np.uint64)
    if not len(shingles):
        return out
    where = (shingles >> BODY).astype(np.int64)
    first = np.concatenate(([True], where[1:] != where[:-1]))  # sorted: the first hash of a register is its smallest
    low = shingles[first] & ((np.uint64(1) << BODY) - np.uint64(1))
    top = np.frexp((low >> np.uint64(8)).astype(np.float64))[1].astype(np.int64) + 7  # position of the highest set bit
    top = np.where(low < 256, np.frexp(np.maximum(low, 1).astype(np.float64))[1] - 1, top)
    zeros = np.uint64(56) - top.astype(np.uint64)
    shift = top - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64))
    out[where[first]] = np.uint64(1) + ((zeros << np.uint64(MANTISSA)) | (mantissa & np.uint64((1 << MANTISSA) - 1)))
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """32 longs of four packed registers; 0 where all four are empty."""
    four = regs.reshape(BANDS, PER_BAND)
    packed = four[:, 0]
    for k in range(1, PER_BAND):
        packed = (packed << np.uint64(16)) | four[:, k]
    return packed.view(np.int64)


def exact_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The smallest hashes of a sorted small set, of which every set of the wanted similarity holds one.

    The larger of two similar sets may be above SMALL only if the smaller has more than percent / 100 * SMALL shingles.
    """
    n = len(shingles)
    return shingles[: n + (-n * percent) // 100 + 1 if 0 < n <= SMALL else 0].view(np.int64)


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, kind))


def _sketch(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, cache) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    _lists([band_keys(registers(s)) for s in sets], pa.int64()),
                    _lists([exact_keys(s, percent) for s in sets], pa.int64()),
                ],
                ["id", "key", "n", "set_key", "bands", "rare"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, cache).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "hashes"])

    return run


def _accidents(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of two unrelated sets of n and m shingles agree by accident."""
    level = np.arange(58)
    at_least = lambda t: (1 - 0.5 ** (level + 1)) ** t[:, None] - np.where(level > 0, (1 - 0.5**level) ** t[:, None], 0.0)
    return (at_least(n / REGISTERS) * at_least(m / REGISTERS)).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimates, registers they rest on) of rows of band keys."""
    lanes = lambda x: np.ascontiguousarray(x).view(np.uint16).reshape(len(x), REGISTERS)
    x, y = lanes(a), lanes(b)
    used = ((x != 0) | (y != 0)).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    c = _accidents(n.astype(np.float64), m.astype(np.float64))
    return (same / np.maximum(used, 1) - c) / (1 - c), used


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = lambda k: batch.column(k).flatten().to_numpy().reshape(-1, BANDS)  # noqa: E731, B023
            near, used = estimate(matrix(4), matrix(5), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            spread = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            yield batch.select([0, 1]).filter(pa.array((near >= threshold - 6 * spread) | (used < 32)))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component, n, hash) rows of sets."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
            sizes = np.array([len(x) for x in sets])
            spread = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), sizes))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [spread(0), spread(1), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], ["node", "component", "n", "hash"]
            )


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the similarity.

    Of n shingles, rarest first, a similar set must hold one of the first
    n - ceil(percent / 100 * n) + 1.  Shingles that one node alone holds come
    first and match nothing; they are only counted.
    """
    rows = nodes.join(sets.withColumnRenamed("id", "node"), "node").select("node", "component", "hashes")
    rows = stage(rows.mapInArrow(_exploded, "node long, component long, n long, hash long"))
    # written, as are the tables per shingle below: Spark can then split the rows of a hot shingle in the joins
    held = stage(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1"))
    shared = rows.join(held, "hash")
    counted = shared.groupBy("node").agg(F.count(F.lit(1)).alias("many"))
    # places of the prefix that shared shingles can take
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("many"))
    open_ = shared.join(counted, "node").withColumn("room", room).where("room > 0")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "hash"))
    ranked = open_.withColumn("_r", rank).where("_r <= room and lo <> hi")
    # left: shingles from this one on; the ones before it are rarer
    prefix = stage(ranked.select("hash", "node", "component", "n", (F.col("many") - F.col("_r") + 1).alias("left")))
    sizes = prefix.groupBy("hash", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = stage(sizes.groupBy("hash").agg(F.max_by("component", F.struct("size", "component")).alias("largest")))
    outside = stage(prefix.join(largest, "hash").where("component <> largest").select("hash", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx")))
    # at the rarest shingle of both, the rest must be long enough for the overlap: (100 + p) * overlap >= p * (n + nx)
    near = F.least("left", "lx") * (100 + percent) >= (F.col("n") + F.col("nx")) * percent
    met = prefix.join(outside, "hash").where((F.col("component") != F.col("cx")) & near)
    return met.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, pivots: int = 0
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept, key."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    sketches = stage(texts.mapInArrow(_sketch(width, percent), "id long, key long, n long, set_key binary, bands array<long>, rare array<long>"))
    # documents with equal sets are one node, numbered once; its first row has the smallest id, null ids last
    first_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    nodes = stage(
        sketches.where("n > 0")
        .groupBy("set_key")
        .agg(first_row.alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("rare").alias("rare"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = F.transform("bands", lambda key, band: F.when(key != 0, F.xxhash64(band, key)))
    exact = F.transform("rare", lambda key: F.xxhash64(F.lit("shingle"), key))
    buckets = nodes.select("node", "n", F.explode(F.concat(banded, exact)).alias("bucket")).where("bucket is not null")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(buckets.join(shared, "bucket"))
    # the text that copies stem from shares the most bands: it is the best pivot
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    first = members.select("bucket", "node").join(degrees, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("pivot"))
    wanted = nodes.select("node", F.col("row.key").alias("key")).join(members.select("node").distinct(), "node", "left_semi")
    sets = stage(
        texts.select("key", "text").join(wanted, "key").select("node", "text").mapInArrow(_sets(width), "id long, hashes binary").dropDuplicates(["id"])
    )
    ratio = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    sketch = nodes.select("node", "n", "bands")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) pairs whose similarity on full sets reaches the threshold."""
        likely = (
            pairs.join(sketch.toDF("a", "na", "xa"), "a")
            .join(sketch.toDF("b", "nb", "xb"), "b")
            .where(ratio)
            .select("a", "b", "na", "nb", "xa", "xb")
            .mapInArrow(_likely(percent / 100), "a long, b long")
        )
        full = stage(likely).join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
        return stage(full.mapInArrow(_verified(percent), "a long, b long"))

    def components(links: DataFrame) -> DataFrame:
        return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = stage(members.join(first, "bucket").where("node <> pivot").select(*ordered("node", "pivot")).distinct())
    links = verified(tried)
    label = components(links)
    for step in range(pivots + 1):
        parts = members.select("bucket", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        torn = parts.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        parts = stage(parts.join(torn, "bucket", "left_semi"))
        if not parts.limit(1).count():
            break
        if step < pivots:
            # a pivot for each bucket, and the members of other components
            pivot = parts.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(step))).alias("p"))
            pairs = parts.join(pivot, "bucket").where("component <> p.component").select(*ordered(F.col("node"), F.col("p.node")))
        else:
            pairs = _prefix_pairs(parts.select("node", "component").distinct(), sets, percent)
        fresh = stage(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(fresh)
        more = verified(fresh)
        if more.limit(1).count():
            links = links.unionByName(more)
            label = components(links)
    reached = nodes.select("set_key", "row", "node").join(label, "node", "left").select("set_key", "row", F.coalesce("component", "node").alias("component"))
    named = reached.groupBy("component").agg(F.min("row").alias("top"))
    found = sketches.join(reached.select("set_key", "component").join(named, "component").select("set_key", "top"), "set_key", "left")
    linked = F.col("top").isNotNull()
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("top.id")).otherwise(F.col("id")).alias("component_id"),
        (~linked | (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("key") == F.col("top.key")))).alias("kept"),
        "key",
    )
