"""Removal of byte strings that occur more than once, by sharded suffix arrays.

Every byte covered by a string of ``width`` bytes that also starts elsewhere is
removed.  A suffix array over the whole corpus would have to hold every suffix;
instead the suffixes are dealt to shards by a key that depends on their first
``width`` bytes only: the smallest hash among the ``gram``-byte strings in them
(their anchor).  Equal strings have equal anchors, so they meet in one shard.

1. One scan finds the anchors of all texts and, for each, the range of starts
   that it speaks for.  Anchors that occur once cannot belong to a repeat.
2. The stretch of text behind each repeated anchor (its starts plus ``width``
   bytes) is cut out.  Equal stretches are counted, not copied; an anchor with
   one distinct stretch that occurs twice is decided by that count.
3. Shards of anchors with several stretches are sorted by induced sorting; a
   start is repeated when its permuted common prefix with its predecessor, or
   its successor's with it, reaches ``width``, or when its stretch occurs twice.
4. Repeated starts are merged into spans per text, and the texts are cut.

An anchor with very many distinct stretches (a passage in many contexts) is
split by the text that ``SPLIT`` neighbouring starts have in common, and equal
parts are counted before they meet, so that no shard depends on how often a
passage occurs.

Defined cases: null counts as empty; matches never cross documents, and texts
shorter than ``width`` lose nothing; equal texts of at least ``width`` bytes
lose everything; rows with equal text are treated alike, whatever their id; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductlens.llm.common import partitions, stage
from conductlens.llm.induced import permuted_lcp, suffix_array
from conductlens.llm.shingles import mix

CHUNK = 1 << 20  # bytes that are hashed or sorted at a time
HOT = 2000  # distinct stretches from which an anchor is split
SPLIT = 8  # starts to a part when it is split
STEPS = np.random.default_rng(400).integers(1, 1 << 62, 16, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on (positions near the end see zeros)."""
    n, h, width, out, have = len(data), BYTES[data], 1, None, 0
    level = 0
    while True:
        if size & width:
            if out is None:
                out, have = h, width
            else:
                ahead = np.zeros(n, np.uint64)
                ahead[: max(n - width, 0)] = out[width:]
                out, have = h * STEPS[level + 8] + ahead, have + width
        if width * 2 > size:
            return mix(out)
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - width, 0)] = h[width:]
        h, width, level = h * STEPS[level] + ahead, width * 2, level + 1


def anchors(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, first start, last start, place of the anchor) of the starts of ``width``-byte strings, in order."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    none = np.zeros(0, np.int64)
    if not (lengths >= width).any():
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    bits = np.uint64(max(n.bit_length(), 20))
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    # smallest key among the grams of each window, by windows of doubling size
    span, have, least = width - gram + 1, 1, key
    while have * 2 <= span:
        least = np.concatenate((np.minimum(least[:-have], least[have:]), least[-have:]))
        have *= 2
    if have < span:
        least = np.concatenate((np.minimum(least[: n - (span - have)], least[span - have :]), least[n - (span - have) :]))
    of = np.repeat(np.arange(len(texts)), lengths)
    start = np.arange(n)
    start = start[start + width <= ends[of]]
    anchor = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[start[1:]] != of[start[:-1]])))
    first = start[new]
    last = start[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))]
    base = ends - lengths
    base = base[of[first]]
    return of[first], h[anchor[new]], first - base, last - base, anchor[new] - base


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


def _utf8(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _scan(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _utf8(batch.column(1))
            parts = [_shift(at, anchors(part, width, gram)) for at, part in _batches(texts)]
            if not parts:
                continue
            of, h, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((h.view(np.int64), pa.int64()), *((v, pa.int32()) for v in rest))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    *lists,
                ],
                ["id", "text_key", "n_bytes", "sha256", "h", "lo", "hi", "p"],
            )

    return run


def _shift(at: int, found: tuple) -> tuple:
    return (found[0] + at, *found[1:])


def _stretches(width: int):
    """Adds the hash of each candidate stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _utf8(batch.column(1))
            lists = batch.column(3)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            ph = np.zeros(len(lo), np.uint64)
            for k, t in enumerate(texts):
                for j in range(offsets[k] - offsets[0], offsets[k + 1] - offsets[0]):
                    ph[j] = xxhash.xxh3_64_intdigest(t[lo[j] : hi[j] + width])
            found = pa.StructArray.from_arrays(
                [*[flat.field(c) for c in ("h", "lo", "hi", "p")], pa.array(ph.view(np.int64))], ["h", "lo", "hi", "p", "ph"]
            )
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), found)],
                ["text_key", "text", "copies", "found"],
            )
            # another row of the same id may hold another text
            own = [xxhash.xxh3_128_digest(t) == k for t, k in zip(texts, batch.column(0).to_pylist(), strict=True)]
            yield out.filter(pa.array(own, pa.bool_()))

    return run


def _cut_out(width: int):
    """One row per chosen stretch: (anchor, stretch, weight, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (c["h"], c["ph"], c["weight"], t[c["lo"] : c["hi"] + width])
                for t, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for c in chosen
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["h", "part", "weight", "piece"])

    return run


def _split_hot(width: int):
    """Parts of hot anchors' stretches: (key, part, stretch, shift, weight, bytes).

    Starts are grouped by their distance to the anchor, SPLIT to a part; the
    bytes that all starts of a part have in common are its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c in chosen:
                    lo, hi, p = c["lo"], c["hi"], c["p"]
                    for q in range((p - hi) // SPLIT, (p - lo) // SPLIT + 1):
                        near, far = p - q * SPLIT, p - q * SPLIT - SPLIT + 1
                        key = xxhash.xxh3_64_intdigest(t[near : far + width], seed=q)
                        low, high = max(lo, far), min(hi, near)
                        piece = t[low : high + width]
                        part = xxhash.xxh3_64_intdigest(piece, seed=q * SPLIT + near - high)
                        rows.append((key, part, c["ph"], low - lo, c["weight"], piece))
            signed = lambda k: pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64))  # noqa: E731, B023
            rest = ((2, pa.int64()), (3, pa.int32()), (4, pa.int64()), (5, pa.binary()))
            yield pa.RecordBatch.from_arrays([signed(0), signed(1), *[pa.array([r[k] for r in rows], kind) for k, kind in rest]], ["h", "part", "ph", "shift", "weight", "piece"])

    return run


def _sort_shard(width: int):
    """Runs of repeated starts of each stretch; input sorted by anchor, anchors are kept together."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        pieces = [r[3] for r in rows]
        data = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8).astype(np.int64)
        sizes = np.array([len(p) for p in pieces])
        base = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        if any(b"\x00" in p for p in pieces):
            data += 1
            data[base + sizes] = 0
        sa = suffix_array(data, width)
        phi, plcp = permuted_lcp(data, sa)
        long = np.flatnonzero(plcp >= width)
        again = np.zeros(len(data), bool)
        again[long] = True
        again[phi[long]] = True
        out: list[tuple] = []
        for k, (_, part, weight, piece) in enumerate(rows):
            starts = len(piece) - width + 1
            flags = again[base[k] : base[k] + starts] if weight < 2 else np.ones(starts, bool)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
            out += [(part, int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[k] for r in out], pa.int32()) for k in (1, 2)]], ["part", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if row[0] != last and size > CHUNK:
                    if (found := solve(held)) is not None:
                        yield found
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held and (found := solve(held)) is not None:
            yield found

    return run


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, spans, digest, lists = [], [], [], []
            for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in runs):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b + width)
                    else:
                        merged.append([a, b + width])
                at, keep = 0, []
                for a, b in merged:
                    keep.append(t[at:a])
                    at = b
                keep.append(t[at:])
                gone.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                lists.append(merged)
                digest.append(hashlib.sha256(b"".join(keep)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(lists, pa.list_(pa.list_(pa.int32())))],
                ["text_key", "n_removed", "n_spans", "kept", "spans"],
            )

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, gram: int = 96) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans ([from, to) pairs)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = stage(
        texts.mapInArrow(_scan(width, gram), f"id {kind}, text_key binary, n_bytes long, sha256 string, h array<long>, lo array<int>, hi array<int>, p array<int>")
    )
    # equal texts are one text with a number of copies
    distinct = stage(
        scanned.where(F.size("h") > 0)
        .groupBy("text_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.first("sha256").alias("sha256"), F.first("h").alias("h"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("p").alias("p"))
    )
    each = distinct.select("text_key", "id", "sha256", "copies", F.inline(F.arrays_zip("h", "lo", "hi", "p")))
    # staged, as are other small sides below: Spark can then split a hot anchor's rows among tasks
    often = stage(each.groupBy("h").agg(F.sum("copies").alias("_n")).where("_n > 1").select("h"))
    where = (
        each.join(often, "h")
        .groupBy("text_key", "copies", F.col("id").alias("_id"), F.col("sha256").alias("_sha"))
        .agg(F.collect_list(F.struct("h", "lo", "hi", "p")).alias("found"))
    )
    cut = stage(
        # by digest and id: rows that share an id, or have none, meet only their own text
        texts.join(where, (F.sha2(F.col("text").cast("binary"), 256) == F.col("_sha")) & F.col("id").eqNullSafe(F.col("_id")))
        .select("text_key", "text", "copies", "found")
        .mapInArrow(_stretches(width), "text_key binary, text binary, copies long, found array<struct<h:long,lo:int,hi:int,p:int,ph:long>>")
    )
    members = cut.select("text_key", "copies", F.inline("found"))
    kinds = stage(members.groupBy("h", "ph").agg(F.sum("copies").alias("weight"), F.min(F.struct("text_key", "lo", "hi", "p")).alias("at")))
    groups = stage(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    several = kinds.join(groups.where("n > 1"), "h").select("h", "ph", "weight", "n", "at.*")

    def bytes_of(rows: DataFrame) -> DataFrame:
        chosen = rows.groupBy("text_key").agg(F.collect_list(F.struct("h", "ph", "weight", "lo", "hi", "p")).alias("chosen"))
        return cut.select("text_key", "text").join(chosen, "text_key").select("text", "chosen")

    def solved(pieces: DataFrame) -> DataFrame:
        sorted_ = pieces.repartition(partitions(spark), "h").sortWithinPartitions("h")
        return sorted_.mapInArrow(_sort_shard(width), "part long, a int, b int")

    runs = solved(bytes_of(several.where(F.col("n") <= HOT)).mapInArrow(_cut_out(width), "h long, part long, weight long, piece binary"))
    runs = runs.withColumnRenamed("part", "ph")
    # an anchor with one stretch: its copies are equal as a whole
    single = kinds.join(groups.where("n = 1"), "h").where("weight > 1").select("ph", F.lit(0).alias("a"), (F.col("at.hi") - F.col("at.lo")).alias("b"))
    runs = runs.unionByName(single)
    if groups.where(F.col("n") > HOT).limit(1).count():
        parts = stage(
            bytes_of(several.where(F.col("n") > HOT)).mapInArrow(_split_hot(width), "h long, part long, ph long, shift int, weight long, piece binary")
        )
        # equal parts are counted before they meet
        once = parts.groupBy("h", "part").agg(F.sum("weight").alias("weight"), F.first("piece").alias("piece"))
        hot = parts.select("part", "ph", "shift").join(solved(once), "part")
        runs = runs.unionByName(hot.select("ph", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))
    runs = stage(runs)
    spans = members.select("text_key", "lo", "ph").join(runs, "ph").select("text_key", F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")).alias("run"))
    spans = spans.groupBy("text_key").agg(F.collect_list("run").alias("runs"))
    result = cut.select("text_key", "text").join(spans, "text_key").mapInArrow(
        _kept(width), "text_key binary, n_removed long, n_spans long, kept string, spans array<array<int>>"
    )
    # rows of one id and text give a text twice; written once per text, so that Spark can split the copies' rows in the join
    result = stage(result.dropDuplicates(["text_key"]))
    return scanned.select("id", "text_key", "n_bytes", "sha256").join(result, "text_key", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array()).alias("spans"),
    )
