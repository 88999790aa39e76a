"""Event sources of a user's own, as Spark data sources: read in parallel as a batch, followed as a stream, replayed after a restart.

A source is a log of numbered segments.  ``EventFeed`` asks a subclass for two
things: how far each segment reaches now, and its lines between two positions.
From these come partitions, offsets and replay.  Only the last segment of a log
may grow and new segments are named after all others, so an offset is one
segment and one position in it, however long the log is.

    class Queue(EventFeed):
        ...
    spark.dataSource.register(Queue)
    events, rejects = read_feed(spark, "queue", url="...")
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from conductlens.sources.store import parse_events

SCHEMA = "value string, segment string, at long"
START = {"segment": "", "at": 0}


class Segment(NamedTuple):
    name: str
    end: int  # the position after its last whole line


class Slice(NamedTuple):
    """The lines of a segment that begin from ``start`` up to ``end`` (exclusive)."""

    segment: str
    start: int
    end: int


class Run(InputPartition):
    """Slices that one task reads one after the other, each in pieces of ``size`` at most."""

    def __init__(self, size: int):
        self.size, self.slices = size, []

    def pieces(self) -> Iterator[Slice]:
        for name, start, end in self.slices:
            for k in range(start, end, self.size):
                yield Slice(name, k, min(k + self.size, end))


class EventFeed(DataSource):
    """A source of event lines; subclasses define ``name``, ``segments`` and ``lines``, which may use ``self.options``.

    ``segments`` runs on the driver for every batch; ``lines`` runs in tasks and
    must give the same lines whenever it is asked for the same positions.
    Option ``split`` is the largest piece of a segment that ``lines`` is asked
    for at once, in the units of its positions.  Each piece is a task of its own
    while there are fewer than option ``tasks`` (64) says; a task reads more of
    them, up to ``WHOLE``, if there are more.
    """

    WHOLE = 64 << 20  # so much is worth a task of its own, however many there are

    def segments(self, since: str) -> list[Segment]:
        """The segments from the one named ``since`` on (all, if empty), in any order."""
        raise NotImplementedError

    def lines(self, segment: str, start: int, end: int) -> Iterator[tuple[int, str]]:
        """(position, text) of the lines that begin in this span."""
        raise NotImplementedError

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)

    def slices(self, start: dict, end: dict | None) -> list[Slice]:
        """What lies between two offsets."""
        out = []
        for name, reach in sorted(self.segments(start["segment"])):
            if name < start["segment"] or (end is not None and name > end["segment"]):
                continue
            at = start["at"] if name == start["segment"] else 0
            stop = end["at"] if end is not None and name == end["segment"] else reach
            if at < stop:
                out.append(Slice(name, at, stop))
        return out

    def runs(self, start: dict, end: dict | None) -> list[Run]:
        """What lies between two offsets, dealt to tasks in its order."""
        size, slices, out, room = int(self.options.get("split", self.WHOLE)), self.slices(start, end), [], 0
        share = -(-sum(s.end - s.start for s in slices) // int(self.options.get("tasks", 64)))
        most = max(size, min(share, self.WHOLE))
        for name, at, stop in slices:
            while at < stop:
                if room < min(size, stop - at):  # the next piece finds no place
                    out.append(Run(size))
                    room = most
                to = min(stop, at + max(size, room // size * size))
                out[-1].slices.append(Slice(name, at, to))
                room -= to - at
                at = to
        return out

    def rows(self, run: Run) -> Iterator[tuple[str, str, int]]:
        for piece in run.pieces():
            for at, text in self.lines(*piece):
                yield text, piece.segment, at


class _Batch(DataSourceReader):
    def __init__(self, feed: EventFeed):
        self.feed = feed

    def partitions(self) -> list[Run]:
        return self.feed.runs(START, None) or [Run(1)]

    def read(self, partition: Run) -> Iterator[tuple]:
        return self.feed.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, feed: EventFeed):
        self.feed, self.seen = feed, ""

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        last = max(self.feed.segments(self.seen), default=Segment("", 0))
        self.seen = last.name or self.seen
        return {"segment": last.name, "at": last.end}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return self.feed.runs(start, end)

    def read(self, partition: Run) -> Iterator[tuple]:
        return self.feed.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is deleted: the log belongs to its writer."""


class LogFolder(EventFeed):
    """``event_log``: a folder of text files, one line an event, named so that later files sort after earlier ones.

    Option ``path`` is a path or URI that every executor reaches.  Files below it
    are segments by their relative names; those whose name, or whose folder's,
    begins with ``_`` or ``.`` are left out.  A last line without its line end is
    not there yet.  Bytes that are not UTF-8 become replacement characters.
    """

    TAIL = 1 << 16  # bytes that are read at once in looking for the end of the last line

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        system, root = arrow_fs.FileSystem.from_uri(self.options["path"])
        return system, root.rstrip("/")

    def segments(self, since: str) -> list[Segment]:
        system, root = self._open()
        found = []
        for info in system.get_file_info(arrow_fs.FileSelector(root, recursive=True)):
            name = info.path[len(root) :].lstrip("/")
            if info.is_file and name >= since and not any(part[0] in "_." for part in name.split("/")):
                found.append((name, info.size))
        last = max(found, default=("", 0))[0]  # only the last one can be in the middle of a line
        return [Segment(name, self._whole(system, f"{root}/{name}", size) if name == last else size) for name, size in found]

    def _whole(self, system: arrow_fs.FileSystem, path: str, size: int) -> int:
        with system.open_input_file(path) as f:
            end = size
            while end > 0:
                at = max(0, end - self.TAIL)
                cut = f.read_at(end - at, at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                end = at
        return 0

    def lines(self, segment: str, start: int, end: int) -> Iterator[tuple[int, str]]:
        system, root = self._open()
        with system.open_input_file(f"{root}/{segment}") as f:
            yield from _lines(f, start, end, f.size())


def _lines(f, start: int, end: int, size: int, block: int = 1 << 20, beyond: int = 1 << 14) -> Iterator[tuple[int, str]]:
    """The lines that begin in [start, end), read in blocks; a line may go on beyond ``end``, where blocks begin small."""
    # the byte before ``start`` tells whether a line begins there
    at = max(0, start - 1)
    skip, held, begins = start > 0, [], at
    while at < size and not (skip and at >= end):
        beyond *= 1 + (at >= end)
        data = f.read_at(min(block, size - at, max(end - at, beyond)), at)
        from_ = 0
        while (cut := data.find(b"\n", from_)) >= 0:
            held.append(data[from_:cut])
            if not skip:
                yield begins, b"".join(held).decode("utf-8", "replace")
            skip, held, from_, begins = False, [], cut + 1, at + cut + 1
            if begins >= end:
                return
        held.append(data[from_:] if not skip else b"")
        at += len(data)
    if held and not skip and begins < end and any(held):
        yield begins, b"".join(held).decode("utf-8", "replace")


def _options(spark: SparkSession, options: dict) -> dict:
    return {"tasks": 4 * spark.sparkContext.defaultParallelism, **options}


def _events(lines: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    return parse_events(lines.where(F.trim("value") != "").select("value", F.struct("segment", "at").alias("arrival")), strict)


def read_feed(spark: SparkSession, source: str, strict: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of all that a registered source holds now; ``arrival`` is the place in its log."""
    return _events(spark.read.format(source).options(**_options(spark, options)).load(), strict)


def stream_feed(spark: SparkSession, source: str, strict: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) as streams that follow a registered source."""
    return _events(spark.readStream.format(source).options(**_options(spark, options)).load(), strict)
