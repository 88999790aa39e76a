import io
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conductlens.sources.feed import EventFeed, LogFolder, Segment, _lines, read_feed, stream_feed
from conductlens.sources.store import events_to_json
from test_behaviour import event, frame, rows


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_every_line_is_in_one_piece(block):
    rng = random.Random(block)
    for _ in range(60):
        data = "".join(rng.choice(["a", "bé", "\n", "\n\n", "ccc"]) for _ in range(rng.randrange(12))).encode() + rng.choice([b"", b"\n"])
        want, at = [], 0
        for line in io.BytesIO(data):
            want.append((at, line.rstrip(b"\n").decode()))
            at += len(line)
        size = rng.randrange(1, 6)
        got = [x for k in range(0, len(data), size) for x in _lines(Bytes(data), k, min(k + size, len(data)), len(data), block)]
        assert got == want, data


def lines_of(spark, events):
    return "".join(r["value"] + "\n" for r in rows(events_to_json(frame(spark, events))))


def test_log_as_batch_and_as_stream(spark, tmp_path):
    """A growing file, a line that is not whole yet, later files, a restart: every event once, in the order of the log."""
    spark.dataSource.register(LogFolder)
    log, seen = tmp_path / "log", []
    (log / "a").mkdir(parents=True)
    (log / "_hidden").write_text("x\n")
    text = lines_of(spark, [event(k, seq=k) for k in range(1, 9)])
    cut = len(text) // 3
    steps = [("a/0", text[:cut]), ("a/0", text[cut:]), ("b", "\n  \n{broken\n" + lines_of(spark, [event(9, seq=9)])), ("c", "")]
    for n, (name, more) in enumerate(steps):
        with (log / name).open("a") as f:
            f.write(more)
        whole = read_feed(spark, "event_log", path=str(log), split=50)
        query = stream_feed(spark, "event_log", path=str(log), split=50)[0].writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        got = [r["sequence_position"] for r in rows(spark.read.parquet(str(tmp_path / "out")).orderBy("arrival"))]
        assert got == [r["sequence_position"] for r in rows(whole[0].orderBy("arrival"))], n
        seen.append(len(got))
    assert seen == [text[:cut].count("\n"), 8, 9, 9]
    assert [r["value"] for r in rows(whole[1])] == ["{broken"]
    assert rows(read_feed(spark, "event_log", path=tempfile.mkdtemp(dir=tmp_path))[0]) == []


def test_a_source_of_ones_own(spark):
    class Counter(EventFeed):
        @classmethod
        def name(cls):
            return "counter"

        def segments(self, since):
            return [Segment("only", int(self.options["n"]))]

        def lines(self, segment, start, end):
            return ((k, f"line {k}") for k in range(start, end))

    spark.dataSource.register(Counter)
    lines = spark.read.format("counter").options(n=10, split=4).load()
    assert lines.rdd.getNumPartitions() == 3 and sorted(r["at"] for r in rows(lines)) == list(range(10))
    assert len(rows(read_feed(spark, "counter", n=10)[1])) == 10


def test_many_pieces_are_dealt_to_few_tasks(spark):
    """Pieces keep their size and every position is read once; tasks do not grow with the number of pieces."""

    class Counted(EventFeed):
        @classmethod
        def name(cls):
            return "counted"

        def segments(self, since):
            return [Segment(f"{k:04}", k % 5) for k in range(800)] + [Segment("9999", 5000)]

        def lines(self, segment, start, end):
            return ((k, f"{end - start}") for k in range(start, end))

    spark.dataSource.register(Counted)
    lines = spark.read.format("counted").options(split=3, tasks=8).load()
    got = rows(lines)
    assert lines.rdd.getNumPartitions() <= 17
    assert sorted((r["segment"], r["at"]) for r in got) == sorted((f"{k:04}", at) for k in range(800) for at in range(k % 5)) + [("9999", at) for at in range(5000)]
    assert {r["value"] for r in got} == {"1", "2", "3"}


def test_log_in_many_pieces(spark, tmp_path):
    """A log of many more pieces than cores is read by few tasks, each with its share."""
    spark.dataSource.register(LogFolder)
    events = [event(k, seq=k) for k in range(1, 601)]
    (tmp_path / "log").mkdir()
    for k in range(3):
        (tmp_path / "log" / f"{k}").write_text(lines_of(spark, events[200 * k : 200 * k + 200]))
    read = read_feed(spark, "event_log", path=str(tmp_path / "log"), split=100)[0]
    places = read.withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert [r["sequence_position"] for r in rows(read.orderBy("arrival"))] == list(range(1, 601))
    most = 4 * spark.sparkContext.defaultParallelism
    assert len(rows(places)) <= 2 * most + 1 and max(r["count"] for r in rows(places)) <= 600 // most * 2


def test_pieces_read_little_beyond_their_end():
    class Counting(Bytes):
        read = 0

        def read_at(self, n, at):
            self.read += n
            return super().read_at(n, at)

    data = Counting(b"x" * 99 + b"\n")
    data.data *= 50_000
    assert sum(1 for k in range(0, 1_000_000, 100_000) for _ in _lines(data, k, k + 100_000, len(data.data))) == 10_000
    assert data.read < 1_300_000


def test_a_stream_of_many_pieces_writes_few_files(spark, tmp_path):
    """Two batches of a stream, the second from within a segment: few tasks and files, every line once."""
    spark.dataSource.register(LogFolder)
    (tmp_path / "log").mkdir()
    for n in (1, 301):
        with (tmp_path / "log" / "0").open("a") as f:
            f.write(lines_of(spark, [event(k, seq=k) for k in range(n, n + 300)]))
        feed = stream_feed(spark, "event_log", path=str(tmp_path / "log"), split=100)[0].writeStream.format("parquet")
        feed.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert [r["sequence_position"] for r in rows(spark.read.parquet(str(tmp_path / "out")).orderBy("arrival"))] == list(range(1, 601))
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= 2 * (8 * spark.sparkContext.defaultParallelism + 1)
