"""Sharding by balanced label propagation.

Documents with equal texts are linked.  The few groups of more than a quarter
of a quota are packed first, largest first; every other document starts in a
shard chosen by a hash, in proportion to the room left.  Then, round by round, a
Spark join shows each document how many of its linked documents each shard
holds, and groups move to the shard with most of them as far as the quotas of
the shards allow; what leaves a full shard makes room in it, so full shards
swap.  The link structure of a group of equal texts is kept as counts per
(group, shard), so a hot group is combined before it is shuffled.  The last step
evens the shards out exactly: singles leave first, then whole groups, smallest
first, so that only groups at the edge of a quota are cut.

The law is ``rows``: shard sizes differ by one row at most.  A group larger
than a shard's quota has to be split; it fills one shard after the other.

Defined cases: null text has size 1 and counts as its own text value, distinct
from the empty text (null texts are linked with each other); rows with equal
ids are placed one by one; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.llm.common import stage

BUCKETS = 256  # numbering buckets per shard: no task numbers a whole shard
LARGE = 4  # groups of more than a LARGE-th of a quota are packed before the rounds


def _slots(df: DataFrame, order: list[str], name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each shard: rank in a hash bucket plus the sizes of the buckets before it."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    sizes = df.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # shards x BUCKETS rows: a fixed bound
    offsets = sizes.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("shard", "_b").orderBy(*order)) - 1
    return df.withColumn("_l", local).join(F.broadcast(offsets), ["shard", "_b"]).withColumn(name, F.col("_o") + F.col("_l")).drop("_b", "_l", "_o")


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, slack: float = 0.0
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    ``slack`` lets shards exceed their quota by that fraction while documents
    still move; the result is exactly even in any case.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows.withColumn("toss", F.xxhash64("id", "row", F.lit("shard"))))
    total = rows.count()
    quota = total / shards * (1 + slack)
    linked = stage(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("degree")))  # staged: a hot group's rows can be split in the join
    # less than LARGE x shards groups
    large = [(r["grp"], r["degree"]) for r in linked.where((F.col("degree") > 1) & (F.col("degree") > F.lit(total / shards / LARGE))).collect()]
    pieces, room = _packed(large, shards, total / shards)
    plan = F.broadcast(rows.sparkSession.createDataFrame(pieces, "grp string, lo double, hi double, piece int"))
    joined = rows.join(linked, "grp").withColumn("_u", F.pmod(F.xxhash64("row", F.lit("piece")), F.lit(1 << 30)) / (1 << 30))
    joined = joined.join(plan.withColumnRenamed("grp", "_g"), (F.col("grp") == F.col("_g")) & (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")), "left")
    at = stage(joined.select("id", "row", "grp", "toss", "degree", F.coalesce("piece", _start(room, shards)).cast("int").alias("shard")))
    small = (F.col("degree") > 1) & (F.col("degree") <= F.lit(total / shards / LARGE))

    for step in range(rounds):
        # links of a group per shard, combined in the map tasks
        held = at.where(small).groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
        tied = {r["shard"]: r["n"] for r in at.where("degree > 1").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        # written, as ``linked`` is: a hot group's rows can be split in the join
        best = stage(held.groupBy("grp").agg(F.max_by("shard", F.struct("n", F.xxhash64("grp", "shard"))).alias("to")))
        wish = at.where(small).join(best, "grp").where(F.col("shard") != F.col("to")).select("row", "grp", "to", F.col("shard").alias("from"))
        asked = {(r["from"], r["to"]): r["n"] for r in wish.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            break
        share = _shares(asked, tied, shards, quota)
        # what found no room by the last round moves all the same: the last step evens shards out by whole groups
        last = step == rounds - 1 or max(share.values()) < 0.05
        limit = F.lit(1.0) if last else F.element_at(F.create_map(*[F.lit(x) for t, v in share.items() for x in (t, float(v))]), F.col("to"))
        # a group's documents draw together, so a group moves whole
        draw = F.pmod(F.xxhash64("grp", F.lit(step)), F.lit(1_000_003))
        moves = wish.where(draw / 1_000_003 < limit).select("row", "to")
        at = stage(at.join(moves, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
        if last:
            break

    # exact quotas: the first rows of a shard stay, documents with links before singles
    low, more = divmod(total, shards)
    quotas = {s: low + (s < more) for s in range(shards)}
    loads = {r["shard"]: r["n"] for r in at.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    gaps = [(s, quotas[s] - loads.get(s, 0)) for s in range(shards) if quotas[s] > loads.get(s, 0)]
    give = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, loads.get(s, 0) - quotas[s]))]), F.col("shard"))
    # singles leave first; what is still missing comes from linked documents, group by group
    ranked = _rank_to_leave(at, max(64.0, total / shards / BUCKETS))
    leaving = ranked.where(F.col("rank") < give)
    before, first = 0, {}
    for s in range(shards):
        first[s] = before
        before += max(0, loads.get(s, 0) - quotas[s])
    number = F.element_at(F.create_map(*[F.lit(x) for s, v in first.items() for x in (s, v)]), F.col("shard")) + F.col("rank")
    place, upto = F.lit(None).cast("int"), sum(n for _, n in gaps)
    for s, n in reversed(gaps):
        place = F.when(number < upto, F.lit(s)).otherwise(place)
        upto -= n
    # the same walk, from the first gap on: later gaps are tested first and overwritten by earlier ones
    placed = leaving.select("row", place.alias("to"))
    even = at.join(placed, "row", "left").select("id", "row", F.coalesce("to", "shard").cast("int").alias("shard"))
    even = stage(even)
    slots = _slots(even, ["id", "row"])
    facts = rows.select("row", "size", "text_crc32")
    return slots.join(facts, "row").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _rank_to_leave(at: DataFrame, piece: float) -> DataFrame:
    """Order in which a shard's rows would leave: singles first, then small groups, a group's rows next to each other.

    Ranked in buckets of groups, as slots are; groups of more than ``piece`` rows are buckets of their own, in pieces.
    """
    heavy = F.col("degree") > F.lit(piece)
    keys = ["_level", "_b", "_g", "_p"]
    df = at.withColumns(
        {
            "_level": F.when(F.col("degree") < 64, F.col("degree")).otherwise(F.floor(F.log2("degree")) + 58).cast("int"),
            "_b": F.pmod(F.xxhash64("grp"), F.lit(BUCKETS)),
            "_g": F.when(heavy, F.col("grp")).otherwise(""),
            "_p": F.when(heavy, F.pmod("toss", F.ceil(F.col("degree") / F.lit(piece)))).otherwise(F.lit(0)),
        }
    )
    sizes = df.groupBy("shard", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # levels x BUCKETS rows a shard, and at most 2 x shards x BUCKETS for pieces
    offsets = sizes.select("shard", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("shard", *keys).orderBy("grp", "toss", "row")) - 1
    return df.withColumn("_l", local).join(offsets, ["shard", *keys]).withColumn("rank", F.col("_o") + F.col("_l")).drop("_l", "_o", *keys)


def _packed(groups: list[tuple[str, int]], shards: int, quota: float) -> tuple[list[tuple[str, float, float, int]], list[float]]:
    """((group, from, to, shard) by shares of the group, room left): largest first into the fullest shard that holds it."""
    room, pieces = [quota] * shards, []
    degree = dict(groups)
    heap = [(-float(n), g, 0.0) for g, n in groups]
    heapq.heapify(heap)
    while heap:
        size, g, done = heapq.heappop(heap)
        size = -size
        fits = [s for s in range(shards) if room[s] >= size]
        s = min(fits, key=lambda k: room[k]) if fits else max(range(shards), key=lambda k: room[k])
        take = size if fits or room[s] < 1e-6 else room[s]
        room[s] = max(room[s] - take, 0.0)
        rest = size - take
        pieces.append((g, done / degree[g], (done + take) / degree[g] if rest > 0 else 2.0, s))
        if rest > 0:
            heapq.heappush(heap, (-rest, g, done + take))
    return pieces, room


def _start(room: list[float], shards: int):
    """A shard by hash, in proportion to the room."""
    if max(room) == min(room):
        return F.pmod("toss", F.lit(shards))
    u, upto, out = F.pmod("toss", F.lit(1 << 30)) / (1 << 30), sum(room), F.lit(None).cast("int")
    for s in reversed(range(shards)):
        out = F.when(u < upto / sum(room), F.lit(s)).otherwise(out)
        upto -= room[s]
    return F.coalesce(out, F.pmod("toss", F.lit(shards)))


def _shares(asked: dict[tuple[int, int], int], tied: dict[int, int], shards: int, quota: float) -> dict[int, float]:
    """Share of its wishes that each shard grants: quota less its linked documents, plus what leaves under the shares granted."""
    share = dict.fromkeys(range(shards), 1.0)
    for _ in range(100):
        old = dict(share)
        for t in range(shards):
            into = sum(n for (_, to), n in asked.items() if to == t)
            out = sum(n * old[to] for (source, to), n in asked.items() if source == t)
            # singles give way in the last step, so a shard may take linked documents up to its quota
            share[t] = min(1.0, max(0.0, quota - tied.get(t, 0) + out) / into) if into else 0.0
        if max(abs(share[t] - old[t]) for t in share) < 1e-3:
            break
    return share


def cut_links(placed: DataFrame, group_col: str, shard_col: str = "shard") -> DataFrame:
    """Links cut, as pairs of equal texts in different shards, from counts per (group, shard)."""
    held = placed.groupBy(group_col, shard_col).agg(F.count(F.lit(1)).alias("n"))
    by = held.groupBy(group_col).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return by.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("inside")) / 2), F.lit(0)).cast("long").alias("cut"))
