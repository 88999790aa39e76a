"""Live detection whose state lies in a store of layers: marks of sessions, last calls of agents, and the anomalies found.

A micro-batch is a batch job.  Replays are dropped by the sessions' marks, the
calls before an agent's first ones come from its last calls, and what was found
is published together with the new state, in one list of layers: a repeated
batch adds nothing and a lost one leaves nothing.  No task holds an agent or a
session: calls are ordered by range partitions, marks of busy sessions are carried
over them.  A batch writes its own sessions and agents, and reads their buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from conductlens.functions.staging import stage
from conductlens.operators.detect import DETECTORS, RECORD, Detector, agent_facts, attach_profile, graded, joined_calls
from conductlens.operators.profile import Profile
from conductlens.operators.sessions import accept_events, followed_calls, order_columns
from conductlens.schemas import EVENT_COLUMNS, EVENT_FIELDS
from conductlens.sources.layers import BUCKETS, Layer, Layers, bucket, to_fold, write_bucketed

SESSION = ["agent_id", "session_id"]
CLOCK = "clock of events"  # entry of the published list: the latest time of an event, in microseconds
LAST = "agent_id string, named boolean, session_id string, tool_name string, timestamp timestamp"
RECORD_TYPES = {"z_score": "double", "confidence": "double", "observed_num": "double", "baseline_mean": "double"}
TABLES = {
    "anomaly": ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in EVENT_FIELDS] + [f"{c} {RECORD_TYPES.get(c, 'string')}" for c in RECORD] + ["detector int"]),
    "mark": "agent_id string, session_id string, hwm long, seen timestamp",
    "last": LAST,
}


def _log(spark: SparkSession, root: str) -> Layers:
    return Layers(spark, f"{root}/live")


def _rows(log: Layers, layers: list[Layer], table: str, condition: Column | None = None) -> DataFrame:
    """A table's rows in all layers, with the place of the layer; ``condition`` is on bucket and reaches the scans."""
    out = log.spark.createDataFrame([], f"{TABLES[table]}, _layer int")
    for k, layer in enumerate(layers):
        df = log.spark.read.schema(f"{TABLES[table]}, bucket int").parquet(f"{log.path(layer)}/{table}")
        df = df if condition is None else df.where(condition)
        out = out.unionByName(df.drop("bucket").withColumn("_layer", F.lit(k)))
    return out


def _marks(log: Layers, layers: list[Layer], clock: int | None, ttl: str | None, condition: Column | None = None) -> DataFrame:
    """The marks of sessions that have not been silent for longer than ``ttl``, by the latest time of any event."""
    out = _rows(log, layers, "mark", condition).groupBy(*SESSION).agg(F.max("hwm").alias("hwm"), F.max("seen").alias("seen"))
    if ttl is None or clock is None:
        return out
    return out.where(F.col("seen").isNull() | (F.col("seen") >= F.timestamp_micros(F.lit(clock)) - F.expr(f"INTERVAL {ttl}")))


def _last(log: Layers, layers: list[Layer], condition: Column | None = None) -> DataFrame:
    """Of each agent the last call and the last named call that the newest layer with one holds."""
    newest = _rows(log, layers, "last", condition).groupBy("agent_id", "named").agg(F.max_by(F.struct("session_id", "tool_name", "timestamp"), "_layer").alias("c"))
    return newest.select("agent_id", "named", "c.*")


def _write(log: Layers, tables: dict[str, DataFrame]) -> Layer:
    folder = log.new_folder()
    for name, df in tables.items():
        write_bucketed(df, f"{log.path(folder)}/{name}")
    counts = [log.spark.read.schema(f"{schema}, bucket int").parquet(f"{log.path(folder)}/{name}").select(F.lit(1).alias("x")) for name, schema in TABLES.items()]
    return Layer(folder, reduce(DataFrame.union, counts).count())


def _fold(log: Layers, layers: list[Layer], clock: int | None, ttl: str | None) -> Layer:
    return _write(log, {"anomaly": _rows(log, layers, "anomaly").drop("_layer"), "mark": _marks(log, layers, clock, ttl), "last": _last(log, layers)})


def _followed(accepted: DataFrame, last: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(calls with the call before, last calls after them): the older last calls take part as rows before the agent's first one."""
    calls = accepted.where("event_type = 'ToolCall'").withColumn("_step", F.lit(2))
    older = last.withColumn("_step", F.when(F.col("named"), 0).otherwise(1)).drop("named")
    order = ["agent_id", "_step", *order]
    both = stage(older.unionByName(calls, allowMissingColumns=True))
    at, call = F.struct(*order), F.struct("session_id", "tool_name", "timestamp")
    name = F.col("tool_name").isNotNull()
    ends = both.groupBy("agent_id").agg(F.max_by(F.when(name, call), F.when(name, at)).alias("n"), F.max_by(call, at).alias("c"))
    each = F.array(F.struct(F.lit(True).alias("named"), F.col("n").alias("c")), F.struct(F.lit(False).alias("named"), F.col("c").alias("c")))
    ends = ends.select("agent_id", F.inline(each)).where("c is not null").select("agent_id", "named", "c.*")
    return followed_calls(both, ["agent_id"], order[1:]).where("_step = 2").drop("_step"), ends


def live_batch(
    batch: DataFrame,
    profile: Profile,
    root: str,
    name: str,
    threshold: float = 3.0,
    detectors: list[Detector] | None = None,
    mark_ttl: str | None = None,
    facts: DataFrame | None = None,
) -> None:
    """Detect in one micro-batch, named ``<feed>-<number>`` with growing numbers; a number that was published before adds nothing.

    Events that are not above their session's mark are replays and are not
    looked at again.  ``mark_ttl`` (such as ``30 days``) lets the marks of sessions
    expire that were last seen so long before the latest event of all: replays of
    these would be looked at again.  ``last`` calls do not expire: there are two an agent.
    """
    spark, log = batch.sparkSession, _log(batch.sparkSession, root)
    feed, _, number = name.rpartition("-")
    if not (feed and number.isdigit()):
        raise ValueError(f"a batch is named <feed>-<number>, not {name!r}")
    layers, feeds = log.current() or ([], {})
    if int(number) <= feeds.get(feed, -1):
        return
    order, clock = order_columns(batch), feeds.get(CLOCK)
    batch = stage(batch.select(*EVENT_COLUMNS, *[c for c in order if c not in EVENT_COLUMNS]))
    # one value a bucket, and the latest time
    about = batch.agg(F.collect_set(bucket(F.col("agent_id"))).alias("buckets"), F.max(F.unix_micros("timestamp")).alias("clock")).first()
    if not about.buckets:
        return
    clock = max(x for x in (clock, about.clock, -(1 << 62)) if x is not None)
    mine = F.col("bucket").isin(about.buckets) if len(about.buckets) < BUCKETS else None
    stored = _marks(log, layers, clock, mark_ttl, mine)
    accepted = stage(accept_events(batch, stored, order))
    marks = accepted.groupBy(*SESSION).agg(F.greatest(F.max("sequence_position"), F.lit(0)).alias("hwm"), F.max("timestamp").alias("seen"))
    agents = accepted.where("event_type = 'ToolCall'").select("agent_id").distinct()
    calls, ends = _followed(accepted, _last(log, layers, mine).join(agents, "agent_id", "left_semi"), order)
    listed = dict(enumerate(DETECTORS if detectors is None else detectors))
    calls = joined_calls(attach_profile(calls, profile), profile, {n for d in listed.values() for n in d.needs})
    found = graded(calls, agent_facts(profile) if facts is None else facts, threshold, EVENT_COLUMNS, listed)
    layers = [*layers, _write(log, {"anomaly": found, "mark": marks, "last": ends})]
    while n := to_fold(layers):
        layers = [*layers[:-n], _fold(log, layers[-n:], clock, mark_ttl)]
    log.publish(layers, feeds | {feed: int(number), CLOCK: clock})


def stream_live(
    stream: DataFrame,
    profile: Profile,
    root: str,
    checkpoint: str,
    threshold: float = 3.0,
    detectors: list[Detector] | None = None,
    mark_ttl: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Detect in a stream of events against a fixed profile, whose tables are written once; ``load_anomalies`` reads what is found."""
    profile = profile.staged()
    facts = stage(agent_facts(profile))

    def run(df: DataFrame, number: int) -> None:
        # the id of the query, which is in the checkpoint: batches of another checkpoint have other names
        feed = df.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        live_batch(df, profile, root, f"{feed}-{number:012d}", threshold, detectors, mark_ttl, facts)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load_anomalies(spark: SparkSession, root: str) -> DataFrame:
    """All anomalies that were published; ``anomaly_records`` nests them."""
    log = _log(spark, root)
    layers, _ = log.current() or ([], {})
    return _rows(log, layers, "anomaly").drop("_layer")


def live_marks(spark: SparkSession, root: str, mark_ttl: str | None = None) -> DataFrame:
    """(agent_id, session_id, hwm, seen): the marks that count now."""
    log = _log(spark, root)
    layers, feeds = log.current() or ([], {})
    return _marks(log, layers, feeds.get(CLOCK), mark_ttl)


def compact_live(spark: SparkSession, root: str, mark_ttl: str | None = None) -> None:
    """Fold all layers into one and drop the marks that have expired."""
    log = _log(spark, root)
    layers, feeds = log.current() or ([], {})
    if layers:
        log.publish([_fold(log, layers, feeds.get(CLOCK), mark_ttl)], feeds)
