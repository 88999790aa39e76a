"""SentencePiece encoding and decoding as a relational lattice.

The vocabulary file gives a table of pieces and scores (tens of thousands of
rows, a fixed bound).  A text, with spaces written as U+2581 and one put in
front, falls into units: a run of U+2581 and what follows up to the next one.
No piece crosses units, so the best segmentation of a text is that of its units.

Units are encoded relationally: substrings of at most the longest piece's
length are exploded, equi-joined to the piece table, grouped by unit as a
lattice of edges, and folded with Spark's higher-order ``aggregate``.  A model
of type unigram is folded position by position over the best score of the
incoming edges (Viterbi), then along the way back.  In a model of type BPE the
scores are merge ranks, and the path of the highest sum is not what the library
gives; there the same lattice is folded merge by merge: of the edges that span
exactly two neighbouring tokens the best, leftmost one joins them.
A character without a piece is an edge of byte pieces.  The units that are
encoded this way are the ``dictionary_units`` most frequent ones of the corpus,
counted over all texts; their number bounds what is broadcast.  Rarer units are
met in the pass over the texts, which folds the same lattice for them there,
all rare units of a part of the texts at once (``MergeFold``): shuffling every
rare occurrence twice would move more than the texts.
The dictionary ends at a level of frequency, so it may hold somewhat fewer.

Defined cases: null and empty texts have no tokens and decode to the empty
text; U+2581 in a text decodes to a space, as in SentencePiece; repeated rows
are encoded one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conductlens.llm.common import stage

SPACE = "▁"
MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
UNIT = f"[\\n\\t]|{SPACE}+[^{SPACE}\\n\\t]*|[^{SPACE}\\n\\t]+"
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces of a model file: (text, id, score), byte pieces, and the bytes of every id."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces: list[tuple[str, int, float]] = []
        self.byte_ids = [-1] * 256
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.pieces.append((piece, i, float(model.get_score(i))))
                self.bytes_of.append(piece.encode())
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.unknown = min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY
        ranks = [s for _, _, s in self.pieces]
        #: merge ranks as scores mark a model of type BPE (a few added pieces have scores of their own)
        self.merges = sum(s == -k for k, s in enumerate(ranks)) > 0.9 * len(ranks)
        crossing = [p for p, _, _ in self.pieces if re.search(f"[^{SPACE}]{SPACE}|[\\n\\t]", p)]
        if crossing or min(self.byte_ids) < 0:
            raise ValueError("the model has pieces across words or lacks byte pieces")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pieces, "piece string, id int, score double")


def prepared(text: Column) -> Column:
    """A text as the lattice sees it."""
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))).otherwise(F.lit(""))


def units_of(text: str) -> list[str]:
    """The units (UNIT) of a text as the lattice sees it, cut at marks that are set before every one: quicker than matching them."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if "\0" in text:
        return re.findall(UNIT, text)
    text = text.replace(SPACE, "\0" + SPACE)
    while SPACE + "\0" + SPACE in text:
        text = text.replace(SPACE + "\0" + SPACE, SPACE + SPACE)
    for sign in "\n\t":
        text = text.replace(sign, f"\0{sign}\0")
    return list(filter(None, text.split("\0")))


def lattice(units: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """(unit, n, edges): the edges (end, start, score, id) of every unit; id -1 stands for byte pieces.

    ``pieces`` is the vocabulary, whose size is fixed: it is broadcast.
    """
    n = F.char_length("unit")
    starts = units.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select(
        "unit", "n", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + longest))).alias("end")
    )
    cut = spans.withColumn("piece", F.substr("unit", F.col("start") + 1, F.col("end") - F.col("start")))
    # a single character always is an edge
    met = cut.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | (F.col("end") == F.col("start") + 1))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    return met.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(n: Column, edges: Column) -> Column:
    """array<struct<score, start, id>>: for each position the best path's score, last piece's start and id."""
    node = "array<struct<score:double,start:int,id:int>>"
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id"))).cast(node)

    def step(acc: Column, at: Column) -> Column:
        into = F.filter(edges, lambda e: e["end"] == at)
        paths = F.transform(
            into,
            # the best score, then the longer last piece
            lambda e: F.struct((F.element_at(acc, e["start"] + 1)["score"] + e["score"]).alias("score"), (-e["start"]).alias("near"), e["id"].alias("id")),
        )
        best = F.array_max(paths)
        return F.concat(acc, F.array(F.struct(best["score"].alias("score"), (-best["near"]).alias("start"), best["id"].alias("id"))).cast(node))

    return F.aggregate(F.sequence(F.lit(1), n), origin, step)


def way_back(n: Column, nodes: Column) -> Column:
    """array<struct<start, id>> along the best path, from the nodes of ``viterbi`` (a stored column: it is read at every step)."""

    def back(acc: Column, _: Column) -> Column:
        here = F.element_at(nodes, acc["at"] + 1)
        return F.when(acc["at"] == 0, acc).otherwise(
            F.struct(here["start"].alias("at"), F.concat(F.array(F.struct(here["start"].alias("start"), here["id"].alias("id"))), acc["path"]).alias("path"))
        )

    begin = F.struct(n.alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), n), begin, back, lambda acc: acc["path"])


def merged(n: Column, edges: Column) -> Column:
    """Token borders, one bit a position, after all merges; for units of at most 60 characters."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    wide = F.transform(
        F.filter(edges, lambda e: e["end"] > e["start"] + 1),
        lambda e: F.struct(
            (-e["score"]).alias("rank"),
            e["start"].alias("start"),
            bit(e["start"]).bitwiseOR(bit(e["end"])).alias("ends"),
            (bit(e["end"]) - bit(e["start"] + 1)).alias("inner"),
        ),
    )
    ordered = F.array_sort(wide)

    def step(borders: Column, _: Column, ordered: Column) -> Column:
        fits = F.filter(
            ordered, lambda e: (borders.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(borders.bitwiseAND(e["inner"])) == 1)
        )
        return borders.bitwiseAND(F.bitwise_not(F.coalesce(F.get(fits, F.lit(0))["inner"], F.lit(0).cast("long"))))

    # one-element transform: the ordered edges are made once, not at every step
    return F.element_at(
        F.transform(F.array(ordered), lambda o: F.aggregate(F.sequence(F.lit(1), n), bit(n + 1) - 1, lambda acc, x: step(acc, x, o))), 1
    )


def between_borders(n: Column, edges: Column, borders: Column) -> Column:
    """array<struct<start, id>> of the tokens between borders."""
    at = F.filter(F.sequence(F.lit(0), n), lambda k: F.getbit(borders, k) == 1)
    ends = F.slice(at, 2, F.size(at) - 1)
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edge = lambda p: F.get(F.filter(edges, lambda e: (e["start"] == p["a"]) & (e["end"] == p["b"])), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(p["a"].alias("start"), edge(p)["id"].alias("id")))


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, ids) of distinct non-empty units by the relational lattice."""
    spark = units.sparkSession
    edges = lattice(units, vocabulary.table(spark), vocabulary.longest, vocabulary.unknown)
    n, e = F.col("n"), F.col("edges")
    if vocabulary.merges:
        paths = stage(edges.withColumn("borders", merged(n, e))).select("unit", between_borders(n, e, F.col("borders")).alias("path"))
    else:
        paths = stage(edges.select("unit", "n", viterbi(n, e).alias("nodes"))).select("unit", way_back(n, F.col("nodes")).alias("path"))
    # byte pieces of a character: the ids of its bytes
    hexa = lambda start: F.hex(F.encode(F.substr("unit", start + 1, F.lit(1)), "UTF-8"))
    by_hex = F.create_map(*[F.lit(x) for k, i in enumerate(vocabulary.byte_ids) for x in (f"{k:02X}", i)])
    bytes_of = lambda start: F.transform(
        F.sequence(F.lit(0), (F.length(hexa(start)) / 2).cast("int") - 1), lambda k: F.element_at(by_hex, F.substr(hexa(start), k * 2 + 1, F.lit(2)))
    )
    ids = F.flatten(F.transform("path", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(bytes_of(p["start"]))))
    return paths.select("unit", ids.alias("ids"))


class MergeFold:
    """The lattice of many units folded merge by merge at once, a row of symbols to a unit.

    Symbols are the pieces and the characters in pieces; 0 is a character that no piece holds.  An edge
    over two neighbouring symbols is looked up by their numbers.
    """

    WIDTHS = (8, 12, 16, 24, 40, 64)  # characters of a row
    CELLS = 1 << 17  # of a matrix: it stays in the cache
    NONE = np.iinfo(np.int32).max
    SLOTS, STEP = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        edges = {p: (s, i) for p, i, s in pieces}
        chars = sorted({c for p in edges for c in p} - edges.keys())
        symbol = {p: k for k, p in enumerate([*edges, *chars], 1)}
        self.n = len(symbol) + 1
        self.ids = np.array([-1, *(i for _, i in edges.values()), *[-1] * len(chars)], np.int32)
        # equal scores share a rank, so the leftmost of them is taken
        ranks = np.unique([-s for s, _ in edges.values()], return_inverse=True)[1]
        self.rank = np.concatenate(([self.NONE], ranks, [self.NONE] * len(chars))).astype(np.int32)
        self.bytes = np.array(byte_ids, np.int32)
        pairs = sorted(
            (a * self.n + b, symbol[p]) for p in edges for k in range(1, len(p)) if (a := symbol.get(p[:k])) and (b := symbol.get(p[k:]))
        )
        self.keys, self.joined = (np.array(x, kind) for x, kind in zip(zip(*pairs, strict=True) if pairs else ((), ()), (np.int64, np.int32), strict=True))
        # characters up to the last one of a piece, and one more for all others
        codes, symbols = zip(*((ord(p), k) for p, k in symbol.items() if len(p) == 1), strict=True)
        self.symbol_of = np.zeros(max(codes) + 2, np.int32)
        self.symbol_of[list(codes)] = symbols
        self.slots: tuple[np.ndarray, np.ndarray] | None = None

    def _fill(self) -> tuple[np.ndarray, np.ndarray]:
        """Made once a process, not sent.  A slot holds one pair, or -2 if several fall into it: these are searched in the sorted list."""
        at = self._slot(self.keys)
        key, joined = np.full(1 << self.SLOTS, -1), np.zeros(1 << self.SLOTS, np.int32)
        key[at], joined[at] = self.keys, self.joined
        key[np.bincount(at, minlength=1 << self.SLOTS) > 1] = -2
        return key, joined

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.STEP >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Symbol of the edge over both, 0 without one."""
        if self.slots is None:
            self.slots = self._fill()
        key = left.astype(np.int64) * self.n + right
        slot = self._slot(key)
        held = self.slots[0][slot]
        out = np.where(held == key, self.slots[1][slot], 0)
        many = np.flatnonzero(held == -2)
        if len(many):
            at = np.minimum(np.searchsorted(self.keys, key[many]), len(self.keys) - 1)
            out[many] = np.where(self.keys[at] == key[many], self.joined[at], 0)
        return out

    def __call__(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """(unit, ids as packed int32) of units of at most 64 characters, none of them empty."""
        units = sorted(units, key=len)
        sizes = np.array([len(u) for u in units])
        first = 0
        for width in self.WIDTHS:
            last = int(np.searchsorted(sizes, width, "right"))
            step = self.CELLS // (width + 1)
            for at in range(first, last, step):
                yield from self._fold(units[at : min(at + step, last)], width)
            first = last

    def _fold(self, units: list[str], width: int) -> Iterator[tuple[str, bytes]]:
        sizes = np.array([len(u) for u in units])
        wide, cells = width + 1, len(units) * (width + 1)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(np.arange(len(units)) * wide - begin, sizes)
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbol = np.zeros(cells, np.int32)
        symbol[place] = self.symbol_of[np.minimum(code, len(self.symbol_of) - 1)]
        there = np.zeros(cells, bool)
        there[place] = True
        # the last cell of a row is no character: it is before the first and after the last one
        after = np.arange(1, cells + 1, dtype=np.int32)
        before = np.arange(-1, cells - 1, dtype=np.int32)
        before[::wide] += wide
        joined = np.zeros(cells, np.int32)
        inner = place[:-1][np.diff(place) == 1]
        joined[inner] = self._join(symbol[inner], symbol[inner + 1])
        rank = self.rank[joined]
        rows, matrix = np.arange(len(units)), rank.reshape(len(units), wide)
        while True:
            at = matrix[rows].argmin(axis=1) + rows * wide  # the leftmost of the best
            live = rank[at] < self.NONE
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            gone, made, prior = after[at], joined[at], before[at]
            later = after[gone]
            symbol[at], after[at], before[later] = made, later, at
            there[gone], rank[gone] = False, self.NONE
            both = self._join(np.concatenate((made, symbol[prior])), np.concatenate((symbol[later], made)))
            ends = np.concatenate((at, prior))
            joined[ends] = both
            rank[ends] = self.rank[both]
        left = there[place]
        ids, code = self.ids[symbol[place[left]]], code[left]
        # a character without a piece: its bytes
        lone = ids < 0
        each = np.where(lone, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        flat = np.repeat(ids, each)
        flat[np.repeat(lone, each)] = self.bytes[np.frombuffer("".join(map(chr, code[lone].tolist())).encode(), np.uint8)]
        # tokens up to the end of every unit, in bytes of the packed ids
        counted = np.concatenate(([0], np.cumsum(each)))
        ends = (counted[np.cumsum(left)[begin + sizes - 1]] * 4).tolist()
        packed = flat.astype(np.int32).tobytes()
        for unit, a, b in zip(units, [0, *ends], ends, strict=False):
            yield unit, packed[a:b]


class Encoder(dict):
    """unit -> its ids as packed int32; missing units are folded here, by the same rule."""

    def __init__(
        self,
        known: dict[str, bytes],
        pieces: list[tuple[str, int, float]],
        byte_ids: list[int],
        longest: int,
        unknown: float,
        merges: bool,
        together: MergeFold | None = None,
    ):
        super().__init__(known)
        self.known, self.byte_ids, self.longest, self.unknown = known, byte_ids, longest, unknown
        self.fold = self.merge if merges else self.viterbi
        self.edges = {p: (s, i) for p, i, s in pieces}
        self.together = together if together is not None or not merges else MergeFold(pieces, byte_ids)

    def packed(self, units: list[str]) -> list[bytes]:
        """The ids of every unit; the missing ones are folded together."""
        if len(self) > len(self.known) + 200_000:
            self.clear()
            self.update(self.known)
        out = list(map(self.get, units))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if self.together is not None:
            self.update(self.together([u for u in {units[k] for k in missing} if len(u) <= MergeFold.WIDTHS[-1]]))
        for k in missing:
            out[k] = self[units[k]]
        return out

    def __missing__(self, unit: str) -> bytes:
        self[unit] = packed = array("i", self.fold(unit)).tobytes()
        return packed

    def ids_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def viterbi(self, unit: str) -> list[int]:
        n, get = len(unit), self.edges.get
        score, start, ids = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            best = None
            for at in range(max(0, end - self.longest), end):
                edge = get(unit[at:end])
                if edge is None:
                    if at != end - 1:
                        continue
                    edge = (self.unknown, -1)
                total = score[at] + edge[0]
                if best is None or total > best:  # a tie keeps the longer piece
                    best, start[end], ids[end] = total, at, edge[1]
            score[end] = best
        path: list[list[int]] = []
        at = n
        while at:
            path.append([ids[at]] if ids[at] >= 0 else self.ids_of(unit[at - 1]))
            at = start[at]
        return [i for part in reversed(path) for i in part]

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            edge = self.edges.get(p)
            out += [edge[1]] if edge is not None else self.ids_of(p)
        return out

    def merge(self, unit: str) -> list[int]:
        """One unit, by a heap: linear in its merges however long it is."""
        parts = list(unit)
        n, get = len(parts), self.edges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (edge := get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-edge[0], a, parts[a] + parts[b]))

        for k in range(n - 1):
            offer(k)
        gone = [False] * n
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = after[a]
            if gone[a] or b >= n or parts[a] + parts[b] != joined:
                continue
            parts[a], gone[b], after[a] = joined, True, after[b]
            if after[a] < n:
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return self._ids([p for p, g in zip(parts, gone, strict=True) if not g])


def parts(batch: pa.RecordBatch, most_rows: int = 200, most_chars: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows (id, text) of a batch, so many at a time that their units fit a task's memory however long the texts are."""
    for at in range(0, batch.num_rows, most_rows):
        part, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.slice(at, most_rows).columns), strict=True):
            part.append(row)
            size += len(row[1] or "")
            if size >= most_chars:
                yield part
                part, size = [], 0
        if part:
            yield part


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_file: str = MODEL,
    dictionary_units: int = 150_000,
    longest_unit: int = 48,
) -> DataFrame:
    """One row per document: id, n_tokens, token_ids, round_trip (the ids decode to the text)."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(model_file)
    text = prepared(F.coalesce(F.col(text_col), F.lit("")))
    units = docs.select(F.explode(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).alias("unit"))
    counted = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.char_length("unit") <= longest_unit)
    counted = stage(counted.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    # the lowest level of frequency from which on the units fit the dictionary: a table of about a thousand levels, no sort
    levels = sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, room = None, dictionary_units
    for level in levels:
        if level["n"] > room:
            break
        least, room = level["level"], room - level["n"]
    common = counted.where(F.lit(False) if least is None else F.col("level") >= least).select("unit")
    # at most dictionary_units rows of at most longest_unit characters
    known = encode_units(common.repartition("unit"), vocabulary).toPandas()
    sent = spark.sparkContext.broadcast(
        (
            {u: np.asarray(i, np.int32).tobytes() for u, i in zip(known["unit"], known["ids"], strict=True)},
            vocabulary.pieces,
            vocabulary.byte_ids,
            vocabulary.longest,
            vocabulary.unknown,
            vocabulary.merges,
            MergeFold(vocabulary.pieces, vocabulary.byte_ids) if vocabulary.merges else None,
            vocabulary.bytes_of,
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *rest, bytes_of = sent.value
        encoder = Encoder(known, *rest)
        for batch in batches:
            for part in parts(batch):
                packed, same = [], []
                found = [units_of(t or "") for _, t in part]
                ids = iter(encoder.packed(list(chain.from_iterable(found))))
                for (_, t), units in zip(part, found, strict=True):
                    t = t or ""
                    packed.append(np.frombuffer(b"".join(islice(ids, len(units))), np.int32))
                    same.append(decoded(packed[-1], bytes_of) == t.replace(SPACE, " "))
                flat = np.concatenate(packed)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, packed)]), pa.int32()), pa.array(flat, pa.int32()))
                ids_ = pa.array([i for i, _ in part], batch.column(0).type)
                yield pa.RecordBatch.from_arrays(
                    [ids_, pa.array([len(x) for x in packed], pa.int64()), lists, pa.array(same, pa.bool_())], ["id", "n_tokens", "token_ids", "round_trip"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, token_ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decoded(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    """The text of a list of ids: pieces joined, U+2581 as spaces, the space in front removed."""
    text = b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model_file: str = MODEL) -> DataFrame:
    """(id, text) of token lists; null lists give the empty text."""
    bytes_of = Vocabulary(model_file).bytes_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(np.asarray(x or [], np.int64), bytes_of) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
