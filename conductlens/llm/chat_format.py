"""Conversations as training texts in windows of bounded size, with a loss mask.

Prefix sums of turn tokens (a segmented scan, so that a long conversation is
not one task) cut a conversation into chunks of bounded size; within a chunk
turns fill one window after the other.  A window repeats the system turn and a
limited history before its own turns; only an assistant's own text is under the
loss mask, so that repeated targets do not count twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductlens.functions.staging import Running, ranged, scan, stage

OPEN, CLOSE, ESCAPE = "###", "</turn>", "\\"
CHUNK_WINDOWS = 64  # windows start anew after so many windows' tokens: the largest group that one task sees
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: Column, role: bool = False) -> Column:
    """A backslash before every backslash, every mark of an opening and every closing (in roles also before a colon)."""
    marks = {ESCAPE: ESCAPE * 2, OPEN: "".join(ESCAPE + c for c in OPEN), CLOSE: ESCAPE + CLOSE, **({":": ESCAPE + ":"} if role else {})}
    for found, instead in marks.items():
        text = F.replace(text, F.lit(found), F.lit(instead))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _bytes_over_four(role: Column, text: Column) -> Column:
    """The default size of a turn in tokens: a quarter of the bytes that it has in the template, rounded up."""
    return F.ceil((F.octet_length(role) + F.octet_length(text) + len(f"{OPEN} : {CLOSE}\n")) / 4).cast("long")


def _starts(positions: pd.Series, sizes: pd.Series, room: pd.Series) -> pd.Series:
    """For each turn of a chunk the position at which its window starts; turns are never cut, so one above the room stands alone."""
    out = []
    for places, tokens, most in zip(positions, sizes, room, strict=True):
        starts, used = [], 0
        for place, n in zip(places, tokens, strict=True):
            if not starts or used + n > most:
                start, used = place, 0
            starts.append(start)
            used += n
        out.append(starts)
    return pd.Series(out)


def _windows(placed: DataFrame, history_tokens: int, history_turns: int) -> DataFrame:
    """(conv, start, pos, at, own): the turns of every window; narrow rows only."""
    turn = F.struct("pos", "size", "ahead", "at")
    chunks = placed.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.first("room").alias("room"), F.first("system_at").alias("system_at"))
    starts = chunks.withColumn("s", F.pandas_udf(_starts, "array<long>")("t.pos", "t.size", "room"))
    own = stage(starts.select("conv", "system_at", F.inline(F.arrays_zip("t", F.col("s").alias("start")))).select("conv", "system_at", "start", "t.*"))
    heads = own.where("pos = start and start > 0").select("conv", "start", "system_at", F.col("ahead").alias("upto"))
    out = own.select("conv", "start", "pos", "at", F.lit(True).alias("own"))
    if history_turns > 0:
        back = heads.withColumn("pos", F.explode(F.sequence(F.lit(1), F.least(F.col("start"), F.lit(history_turns))))).withColumn("pos", F.col("start") - F.col("pos"))
        back = back.where(~((F.col("pos") == 0) & F.col("system_at").isNotNull()))
        known = own.select("conv", "pos", "at", "ahead")
        back = back.join(known, ["conv", "pos"]).where(F.col("upto") - F.col("ahead") <= history_tokens)
        out = out.unionByName(back.select("conv", "start", "pos", "at", F.lit(False).alias("own")))
    system = heads.where("system_at is not null").select("conv", "start", F.lit(0).cast("long").alias("pos"), F.col("system_at").alias("at"), F.lit(False).alias("own"))
    return out.unionByName(system)


def format_chats(
    conversations: DataFrame, budget: int = 2048, history_tokens: int = 256, history_turns: int = 4, tokens: Callable[[Column, Column], Column] = _bytes_over_four
) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv_id, conv, start, n_turns, n_repeated, n_tokens, over_budget, formatted, loss.

    ``start`` is the place of the window's first own turn; ``n_repeated`` turns before it (the system turn, which is a first
    turn of role ``system``, and at most ``history_turns`` turns of at most ``history_tokens`` together) are repeated.
    ``loss`` lists the code points [start, end) of the assistant's own texts, as they are escaped.  ``tokens`` gives a
    turn's size from role and text.  A window holds at most ``budget`` tokens, unless one turn or the system turn alone takes
    more: turns are not cut; ``over_budget`` tells.

    Turns are ordered by turn (null first), role and a hash of the text; repeated rows are turns of their own; null roles
    and texts are empty; rows without conv_id are one conversation, apart from all others by ``conv``; other columns are not
    read; an empty table gives no windows.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    rows = conversations.select(conv.alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    rows = rows.withColumn("size", tokens(escape(F.col("role"), True), escape(F.col("text"))).cast("long"))
    done = ranged(rows, ["conv", "turn", "role", "digest"])
    narrow = done.select("_part", "_at", "conv", "role", "size")
    placed = scan(narrow, ["conv"], {"pos": Running("sum", F.lit(1).cast("long")), "ahead": Running("sum", F.col("size"))})
    placed = stage(placed.select("conv", "pos", "ahead", "size", F.col("_at").alias("at"), "role"))
    system = placed.where("pos = 0 and role = 'system'").select("conv", F.col("at").alias("system_at"), F.col("size").alias("system_size"))
    placed = placed.join(system, "conv", "left")
    # a conversation's room is the same for all of its turns, so chunks are too
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.coalesce("system_size", F.lit(0)))
    placed = placed.withColumn("room", room.cast("long")).withColumn("chunk", F.floor(F.col("ahead") / (F.col("room") * CHUNK_WINDOWS)))
    members = _windows(placed, history_tokens, history_turns)
    texts = done.select(F.col("_at").alias("at"), "conv_id", "role", "text", "size")
    turn = F.struct("pos", "own", "role", "text", "size")
    gathered = members.join(texts, "at").groupBy("conv", "start").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(f"{OPEN} "), escape(t["role"], True), F.lit(": "))
    loss = lambda t: t["own"] & (t["role"] == "assistant")
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), loss(t).alias("loss")))
    written = gathered.withColumn("pieces", pieces)
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(f"{CLOSE}\n"))), "")
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = lambda acc, p: acc["at"] + F.length(p["head"])
    end = lambda acc, p: start(acc, p) + F.length(p["body"])
    span = lambda acc, p: F.array(F.struct(start(acc, p).alias("start"), end(acc, p).alias("end")))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, p: F.struct((end(acc, p) + len(CLOSE) + 1).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span(acc, p))).otherwise(acc["spans"]).alias("spans")),
    )
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["size"])
    return written.select(
        "conv_id", "conv", "start", F.size("turns").alias("n_turns"), F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_repeated"),
        n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"), formatted.alias("formatted"), spans["spans"].alias("loss"),
    )


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window; ValueError if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


READ = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_windows": pa.int64()}


class _Conversation:
    """What has been read of one conversation: counts and running hashes."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars, self.windows = conv_id, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, n_repeated: int, loss: list[dict]) -> None:
        for role, text in parse_window(formatted)[n_repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        self.windows += 1

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, open_one = None, None
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in ("conv", "conv_id", "formatted", "n_repeated", "loss")}
            if row["conv"] != key or open_one is None:
                out += [] if open_one is None else [open_one.row()]
                key, open_one = row["conv"], _Conversation(row["conv_id"])
            open_one.add(row["formatted"], row["n_repeated"], row["loss"])
        yield _batch(out)
    if open_one is not None:
        yield _batch([open_one.row()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(READ.values())], names=list(READ))


def read_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: what their own turns and their loss masks say, as counts and hashes.

    A conversation's windows are read in order by one task, as a hash over all of it asks for; the task holds one window
    and the running hashes.
    """
    dealt = windows.select("conv", "start", "conv_id", "formatted", "n_repeated", "loss").repartition("conv").sortWithinPartitions("conv", "start")
    return dealt.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
