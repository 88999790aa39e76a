"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct beginning of conversations.  Beginnings are named by
running hashes (a segmented scan, so that a long conversation is not one task),
nodes are one aggregation of them.  Every node becomes an enter and an exit
arc; the arcs' successors make one list, the tour, which is ranked in
parallel; sums over a node's subtree are differences of prefix sums of the tour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductlens.functions.staging import Running, running, segmented, stage

SPLITTER_BITS = 5  # one of 2^5 arcs ends a first walk


def _digest(*columns):
    """Two longs of the SHA-256 of some columns; a text's length goes before it, so that neighbours cannot run together."""
    parts = [p for c in columns for p in (F.octet_length(c).cast("string"), F.lit(":"), c)]
    sha = F.sha2(F.concat(*parts), 256)
    half = lambda at: F.conv(F.substring(sha, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k0, k1, size): a hash of role and text for every turn, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    k0, k1 = _digest(role, text)
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), k0.alias("k0"), k1.alias("k1"), F.octet_length(text).cast("long").alias("size"))
    placed = segmented(rows, ["conv_id"], ["turn", "role", "k0", "k1"], {"pos": Running("sum", F.lit(1).cast("long"))})
    return stage(placed.select("conv_id", "pos", "k0", "k1", "size"))


def own_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as they are: conv_id, pos, k0, k1, size; and conv_id."""
    turns = _turns(conversations)
    return turns, turns.select("conv_id").distinct()


def rebuilt_conversations(conversations: DataFrame, groups: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The same after every conversation c has taken over the first crc32(c) % ``most`` turns of conversation c - c % ``groups``, in place of as many of its own."""
    turns = _turns(conversations)
    head = (F.crc32(F.col("conv_id").cast("string")) % most).alias("head")
    # the first turns of each group's first conversation: fewer than ``most`` rows a group
    first = turns.where((F.col("conv_id") % groups == 0) & (F.col("pos") < most - 1))
    sizes = first.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("n_base"))
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % groups).alias("base"), head)
    convs = stage(convs.join(sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0)))))
    given = first.select(F.col("conv_id").alias("base"), "pos", "k0", "k1", "size").join(convs.where("taken > 0"), "base").where("pos < taken")
    kept = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where("pos >= head")
    both = given.select("conv_id", "pos", "k0", "k1", "size").unionByName(kept.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "k0", "k1", "size"))
    return both, convs.select("conv_id")


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes with id, key, parent's key, depth, members; and for every conversation the key of its last node.

    A key is the depth and the xor of 128-bit hashes of (place, turn): it can be carried over partitions.
    """
    at = F.col("pos").cast("string")
    x0, x1 = _digest(at, F.col("k0").cast("string"), F.col("k1").cast("string"))
    rows = stage(turns.select("conv_id", F.col("pos") + 1, "size", x0.alias("x0"), x1.alias("x1")).toDF("conv_id", "depth", "size", "x0", "x1"))
    values = {"h0": Running("xor", F.col("x0"), own=True), "h1": Running("xor", F.col("x1"), own=True)}
    named = stage(segmented(rows, ["conv_id"], ["depth"], values))
    below = named.groupBy("depth", "h0", "h1").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"),
        F.first(F.col("h0").bitwiseXOR(F.col("x0"))).alias("p0"), F.first(F.col("h1").bitwiseXOR(F.col("x1"))).alias("p1"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("h0"), zero.alias("h1"), "n_convs", "conv_id", zero.alias("size"), none.alias("p0"), none.alias("p1"))
    nodes = stage(root.unionByName(below).withColumn("id", F.monotonically_increasing_id()))
    last = named.groupBy("conv_id").agg(F.max(F.struct("depth", "h0", "h1")).alias("e"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"e.{c}", zero).alias(c) for c in ("depth", "h0", "h1")])
    return nodes, ends


def _followers(nodes: DataFrame) -> DataFrame:
    """(arc, next) of the tour; a node's enter arc is 2 id, its exit arc 2 id + 1.

    Siblings follow each other by id.  A node's row gives the links that lead
    to its enter arc and away from its exit arc, so hot parents are not gathered.
    """
    children = nodes.where("parent is not null").select("parent", "id", "n_children", "n_siblings")
    placed = segmented(children, ["parent"], ["id"], {"elder": Running("last", F.col("id")), "nth": Running("sum", F.lit(1).cast("long"), own=True)})
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    link = lambda a, b: F.struct(a.alias("arc"), b.alias("next"))
    links = F.array(
        link(F.when(F.col("elder").isNull(), F.col("parent") * 2).otherwise(F.col("elder") * 2 + 1), enter),
        F.when(F.col("n_children") == 0, link(enter, leave)),
        F.when(F.col("nth") == F.col("n_siblings"), link(leave, F.col("parent") * 2 + 1)),
    )
    root = nodes.where("parent is null")
    top = F.array(F.when(F.col("n_children") == 0, link(enter, leave)), link(leave, F.lit(None).cast("long")))
    return placed.select(F.inline(F.array_compact(links))).unionByName(root.select(F.inline(F.array_compact(top))))


def _walked(arcs: DataFrame, through, going) -> DataFrame:
    """Pointer jumping: every arc's pointer doubles its length over the arcs that fulfil ``through``, until none is ``going`` on.

    A round joins only the pointers that still move; it is written, so plans stay short and a lost executor costs one round.
    """
    arcs = stage(arcs)
    while arcs.where(going).limit(1).count():
        to = arcs.where(through).select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("dist").alias("_dist"))
        moved = arcs.where(going).join(to, "next").select("arc", F.col("_next").alias("next"), (F.col("dist") + F.col("_dist")).alias("dist"))
        arcs = stage(arcs.where(~going).unionByName(moved))
    return arcs


def list_rank(links: DataFrame) -> DataFrame:
    """(arc, next) with one arc whose next is null -> (arc, left): how many arcs follow.

    Pointers first jump to the next splitter (arcs whose hash ends in zeros), which takes rounds as the logarithm of the longest
    gap; then splitters alone jump to the end; the others add their splitter's rank.
    """
    splits = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << SPLITTER_BITS) - 1)) == 0
    there = F.col("next").isNotNull()
    near = _walked(links.withColumn("dist", F.when(there, 1).otherwise(0).cast("long")), ~splits(F.col("arc")), there & ~splits(F.col("next")))
    far = _walked(near.where(splits(F.col("arc"))), F.lit(True), there).select(F.col("arc").alias("next"), F.col("dist").alias("_dist"))
    ended = near.where(~there).select("arc", F.col("dist").alias("left"))
    return stage(near.where(there).join(far, "next").select("arc", (F.col("dist") + F.col("_dist")).alias("left")).unionByName(ended))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, comma-joined, from rows sorted by node; only the running hash is held."""
    now, sha, out = None, None, []
    for batch in batches:
        for node, conv in zip(batch["id"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if node == now:
                sha.update(b",%d" % conv)
                continue
            if now is not None:
                out.append((now, sha.hexdigest()))
            now, sha = node, hashlib.sha256(b"%d" % conv)
        yield _pairs(out)
        out = []
    if now is not None:
        yield _pairs([(now, sha.hexdigest())])


def _pairs(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, pos from 0, k0, k1, size) and ``convs`` (conv_id, also those without turns) come from
    ``own_conversations`` or ``rebuilt_conversations``: null roles and texts are empty there, rows that share a turn follow
    each other by role and hash, repeated rows are turns of their own, rows without conv_id are left out, other columns are not
    read.  No conversation, no node.  ``saved_tokens`` is what a cache of the subtree's beginnings saves, in bytes.
    The hash over a node's ids is a stream through one task, of ids only, and holds none of them.
    """
    nodes, ends = _nodes(turns, convs)
    key = ["depth", "h0", "h1"]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h0").alias("p0"), F.col("h1").alias("p1"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = stage(nodes.join(parents, ["depth", "p0", "p1"], "left"))
    counts = stage(linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children")))
    linked = linked.join(counts, "id", "left").join(counts.toDF("parent", "n_siblings"), "parent", "left")
    linked = stage(linked.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    ranked = list_rank(_followers(linked))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    enters = ranked.where("arc % 2 = 0").join(linked.select((F.col("id") * 2).alias("arc"), leaf.alias("leaf"), saved.alias("saved")), "arc")
    exits = ranked.where("arc % 2 = 1").select("arc", "left", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    tour = enters.select("arc", "left", "leaf", "saved").unionByName(exits).withColumn("at", -F.col("left"))
    sums = running(tour, ["at"], {"leaves": F.col("leaf"), "savings": F.col("saved")})
    # a subtree is what lies between a node's arcs, its own enter arc included
    subtree = lambda c, own: F.max(c) - F.min(c) + F.max(own)
    sums = sums.groupBy(F.shiftright("arc", 1).alias("id")).agg(subtree("leaves", "leaf").alias("n_leaves"), subtree("savings", "saved").alias("saved_tokens"))
    # ids are dealt by node and sorted: one task sees a node's ids in order
    dealt = ends.join(linked.select(*key, "id"), key).select("id", "conv_id").repartition("id").sortWithinPartitions("id", "conv_id")
    hashes = dealt.mapInArrow(_hashed, "id long, ends_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return linked.join(sums, "id").join(hashes, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )
