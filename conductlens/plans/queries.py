"""Registered queries of the behaviour library, over the given tables through the adapter."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conductlens.functions.staging import shared_folder
from conductlens.operators.detect import (
    VOLUME_SPIKE,
    Detector,
    anomaly_records,
    detect,
    detection_summary,
    rate_spikes,
    record,
    unknown_sequences,
    unknown_tools,
    unprofiled_agents,
    volume_spikes,
)
from conductlens.operators.profile import Profile, build_profile, build_summary, document_to_profile, parts_to_profile, profile_to_document, profile_to_parts
from conductlens.operators.sessions import accept_events, session_runs
from conductlens.plans import oracles
from conductlens.plans.fixtures import agent_folders, behaviour_events, halves, replays, split, spoiled, transcript_lines, with_replays, write_transcripts
from conductlens.schemas import EVENT_COLUMNS, ORDERED_EVENT
from conductlens.sources.feed import LogFolder, read_feed, stream_feed
from conductlens.sources.store import (
    TEXT_TIME,
    anomalies_to_json,
    append_events,
    compact_profiles,
    events_to_json,
    list_agents,
    load_events,
    load_profile,
    parse_events,
    read_events,
    save_profile,
    stream_events,
)
from conductlens.sources.transcripts import parse_transcripts, read_transcripts
from conductlens.sources.transcripts import transcript_totals as totals_of
from conductlens.streaming.jobs import stream_build, stream_detect
from conductlens.streaming.live import live_marks, load_anomalies, stream_live

LIVE_FROM = "2024-01-25"
KEY = ["agent_id", "session_id", "sequence_position", "arrival"]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places; times without zone; lists as text: comparable across engines."""
    out = []
    for c, kind in df.dtypes:
        if kind == "double":
            out.append(F.round(c, 4).alias(c))
        elif kind == "timestamp":
            out.append(F.col(c).cast("timestamp_ntz").alias(c))
        elif kind == "array<string>":
            out.append(F.array_join(c, "|").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(behaviour_events(spark, sf_dir))[0]


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Profile]:
    train, score = split(behaviour_events(spark, sf_dir))
    return score, build_profile(train).staged()


def accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that replay dedup keeps, replays mixed in."""
    return _rounded(accept_events(with_replays(behaviour_events(spark, sf_dir))).select(*KEY, "timestamp", "event_type", "tool_name"))


def session_run_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sessions: first arrival, last arrival and size of each."""
    runs = session_runs(behaviour_events(spark, sf_dir))
    out = runs.groupBy("agent_id", "session_id", "run").agg(F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"), F.count(F.lit(1)).alias("n"))
    return out.drop("run")


def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one order over all agents."""
    runs = session_runs(behaviour_events(spark, sf_dir), [])
    out = runs.groupBy("session_id", "run").agg(F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"), F.count(F.lit(1)).alias("n"))
    return out.drop("run")


def agent_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_profile(_train(spark, sf_dir)).agent)


def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_profile(_train(spark, sf_dir)).hour


def known_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_profile(_train(spark, sf_dir)).resource


def tool_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_profile(_train(spark, sf_dir)).tool)


def param_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_profile(_train(spark, sf_dir)).param_set)


def tool_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_profile(_train(spark, sf_dir)).bigram


def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_profile(_train(spark, sf_dir)).hwm.drop("seen")


def _resumed(spark: SparkSession, sf_dir: str) -> Profile:
    first, second = halves(_train(spark, sf_dir))
    return build_profile(second, stored=build_profile(first))


def resumed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents' table after building on one part and resuming on the other."""
    return _rounded(_resumed(spark, sf_dir).agent)


def resumed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_resumed(spark, sf_dir).tool)


def resumed_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir).bigram


def unprofiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents of the score part without a profile; the profile leaves out agent-3."""
    score, profile = _trained(spark, sf_dir)
    return unprofiled_agents(score, profile.where(F.col("agent_id") != "agent-3"))


SHOWN = [*KEY, "tool_name", "anomaly_type", "severity", "z_score", "confidence", "observed_num", "baseline_mean"]


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return _rounded(df.select(*SHOWN, *more))


def unknown_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(unknown_tools(*_trained(spark, sf_dir)), "description", "baseline_value")


def unknown_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(unknown_sequences(*_trained(spark, sf_dir)), "description", "baseline_value")


def unknown_pairs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(unknown_sequences(*_trained(spark, sf_dir), scope="stream"), "description", "baseline_value")


def rate_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rate_spikes(*_trained(spark, sf_dir)))


def rate_anomalies_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rate_spikes(*_trained(spark, sf_dir), scope="stream"))


def volume_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(volume_spikes(*_trained(spark, sf_dir)))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anomalies of the score part against the train part."""
    return _shown(detect(*_trained(spark, sf_dir)), "detector")


def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, profile = _trained(spark, sf_dir)
    return detection_summary(score, detect(score, profile), profile)


def anomalies_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly records as JSON text, with their order."""
    lines = anomalies_to_json(anomaly_records(detect(*_trained(spark, sf_dir))))
    return lines.select(
        "arrival",
        "detector",
        F.get_json_object("value", "$.anomaly_type").alias("anomaly_type"),
        F.get_json_object("value", "$.evidence.event.session_id").alias("session_id"),
        F.get_json_object("value", "$.severity").alias("severity"),
    )


def anomaly_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole anomaly records, read back from their JSON text: the event, z-score and confidence of each."""
    records = anomaly_records(detect(*_trained(spark, sf_dir)))
    layout = records.drop("arrival", "detector").schema
    read = anomalies_to_json(records).select("arrival", "detector", F.from_json("value", layout, {"timestampFormat": TEXT_TIME}).alias("r"))
    event = [F.col(f"r.evidence.event.{c}").alias(c) for c in EVENT_COLUMNS]
    return _rounded(read.select(*event, "arrival", "detector", "r.anomaly_type", "r.severity", "r.evidence.z_score", "r.evidence.confidence"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_summary(build_profile(_train(spark, sf_dir))))


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts after a round trip through nested documents."""
    return document_to_profile(profile_to_document(build_profile(_train(spark, sf_dir)))).bigram


def profile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven tables after a round trip through documents of twenty rows at most or so."""
    p = parts_to_profile(profile_to_parts(_trained(spark, sf_dir)[1], rows=20))
    joined = lambda *c: F.concat_ws("|", *c)
    shown = {
        "agent": (p.agent, F.lit(""), F.col("event_count"), F.col("rate_mean")),
        "tool": (p.tool, F.col("tool_name"), F.col("call_count"), F.col("vol_mean")),
        "param_set": (p.param_set, joined("tool_name", "param_keys"), F.lit(1), F.lit(None)),
        "bigram": (p.bigram, joined("first", "second"), F.col("n"), F.lit(None)),
        "resource": (p.resource, F.col("resource_id"), F.lit(1), F.lit(None)),
        "hour": (p.hour, F.col("hour").cast("string"), F.col("n"), F.lit(None)),
        "hwm": (p.hwm, F.col("session_id"), F.col("hwm"), F.lit(None)),
    }
    tables = [df.select(F.lit(name).alias("component"), "agent_id", item.alias("item"), n.cast("long").alias("n"), x.cast("double").alias("x")) for name, (df, item, n, x) in shown.items()]
    return _rounded(reduce(DataFrame.unionByName, tables))


def events_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON text and read back strictly."""
    return _rounded(parse_events(events_to_json(behaviour_events(spark, sf_dir)))[0].select(*EVENT_COLUMNS))


def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = parse_transcripts(transcript_lines(spark, sf_dir))
    place = [F.col("arrival.file").alias("file"), F.col("arrival.line_no").alias("line_no"), F.col("arrival.block").alias("block")]
    return _rounded(events.select(*EVENT_COLUMNS, *place))


def transcript_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcript_lines(spark, sf_dir)
    return totals_of(lines)


def transcript_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transcripts from the files of a folder."""
    folder = write_transcripts(transcript_lines(spark, sf_dir), shared_folder(spark, "transcripts"))
    return _rounded(parse_transcripts(read_transcripts(spark, folder))[0].select(*EVENT_COLUMNS))


def transcript_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in one folder for each agent, whose id is in the path."""
    events, _ = parse_transcripts(agent_folders(transcript_lines(spark, sf_dir)), agent_pattern="/agents/([^/]+)/sessions/")
    return _rounded(events.select("agent_id", "session_id", "event_type", "tool_name", "sequence_position", F.col("arrival.line_no").alias("line_no"), F.col("arrival.block").alias("block")))


def _lenient(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = shared_folder(spark, "lines")
    spoiled(behaviour_events(spark, sf_dir), events_to_json).write.text(folder)
    return read_events(spark, folder, strict=False)


def lenient_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read from files in which every tenth line is cut off and every tenth blank."""
    return _rounded(_lenient(spark, sf_dir)[0].select(*EVENT_COLUMNS))


def lenient_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and number of the lines that are not events."""
    return _lenient(spark, sf_dir)[1].groupBy(F.length("value").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from a store that was written in two parts."""
    root = shared_folder(spark, "store")
    for part in halves(_train(spark, sf_dir)):
        append_events(part, root)
    return _rounded(load_events(spark, root).select(*EVENT_COLUMNS, "arrival"))


def stored_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents of a store that holds events of some and profiles of others."""
    root, train = shared_folder(spark, "store"), _train(spark, sf_dir)
    append_events(train.where("agent_id <> 'agent-1'"), root)
    save_profile(build_profile(train, agent_id="agent-1"), root)
    return list_agents(spark, root)


def _stored(spark: SparkSession, sf_dir: str) -> Profile:
    root = shared_folder(spark, "store")
    first, second = halves(_train(spark, sf_dir))
    save_profile(build_profile(first), root)
    save_profile(build_profile(second, stored=load_profile(spark, root)), root)
    # an agent's profile is replaced, the others stay
    save_profile(build_profile(second, agent_id="agent-2"), root)
    return load_profile(spark, root)


def stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools' table of a profile that was stored, resumed, stored, and replaced for agent-2 by its second half."""
    return _rounded(_stored(spark, sf_dir).tool)


def stored_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent's events of five days, from a store that nine named batches have filled, one of them repeated."""
    root, train = shared_folder(spark, "store"), _train(spark, sf_dir)
    for n in (*range(5), 4, *range(5, 9)):
        append_events(train.where(F.col("arrival") % 9 == n), root, f"feed-{n}")
    return _rounded(load_events(spark, root, "agent-1", since="2024-01-11", until="2024-01-16").select(*EVENT_COLUMNS, "arrival"))


def _continued(spark: SparkSession, sf_dir: str) -> Profile:
    """A profile whose agents are continued two by two, in layers of their own, and then folded."""
    root = shared_folder(spark, "store")
    first, second = halves(_train(spark, sf_dir))
    save_profile(build_profile(first), root)
    for pair in (("agent-0", "agent-1"), ("agent-2", "agent-3")):
        part = second.where(F.col("agent_id").isin(*pair))
        save_profile(build_profile(part, stored=load_profile(spark, root, agents=part.select("agent_id").distinct())), root)
    compact_profiles(spark, root)
    return load_profile(spark, root)


def continued_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter sets of tools, and resources, of the continued profile."""
    p = _continued(spark, sf_dir)
    keys = p.param_set.select("agent_id", "tool_name", F.array_join("param_keys", "|").alias("item"))
    return keys.unionByName(p.resource.select("agent_id", F.lit(None).cast("string").alias("tool_name"), F.col("resource_id").alias("item")))


def one_agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_profile(_train(spark, sf_dir), agent_id="agent-2").tool)


def one_agent_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(detect(*_trained(spark, sf_dir), agent_id="agent-1"), "detector")


def _large_call(threshold: float) -> Column:
    size = F.col("data_in_bytes")
    return record("LargeCall", F.lit("large call"), F.lit("90000"), size, F.lit(None), F.lit("Low"), (size, F.lit(None)))


#: A detector of a caller's own: calls with more than 90,000 bytes in.
LARGE_CALL = Detector("LargeCall", lambda _: F.col("data_in_bytes") > 90_000, _large_call)


def own_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of detectors with one of the caller's own, at a threshold of 2."""
    return _shown(detect(*_trained(spark, sf_dir), 2.0, [LARGE_CALL, VOLUME_SPIKE]), "detector")


TEXTS = ["arrival", "detector", "anomaly_type", "severity", "description", "baseline_value", "observed_value"]


def anomaly_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all anomalies at a threshold of 1, from their JSON form."""
    lines = anomalies_to_json(anomaly_records(detect(*_trained(spark, sf_dir), 1.0)))
    at = {"baseline_value": "$.evidence.baseline_value", "observed_value": "$.evidence.observed_value"}
    return lines.select("arrival", "detector", *[F.get_json_object("value", at.get(c, f"$.{c}")).alias(c) for c in TEXTS[2:]])


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of JSON lines."""
    folder, out = shared_folder(spark, "lines"), shared_folder(spark, "sink")
    events_to_json(behaviour_events(spark, sf_dir)).write.text(folder)
    feed, _ = stream_events(spark, folder)
    feed.writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
    return _rounded(spark.read.parquet(out).select(*EVENT_COLUMNS))


def _fed(spark: SparkSession, parts: list[DataFrame]) -> Profile:
    """The profile that a stream has built after each part arrived."""
    feed, root, checkpoint = shared_folder(spark, "feed"), shared_folder(spark, "store"), shared_folder(spark, "checkpoint")
    for part in parts:
        part.write.mode("append").parquet(feed)
        stream_build(spark.readStream.schema(ORDERED_EVENT).parquet(feed), root, checkpoint).awaitTermination()
    return load_profile(spark, root)


def streamed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents' table that a stream has built of two parts: the same as of the whole."""
    return _rounded(_fed(spark, list(halves(_train(spark, sf_dir)))).agent)


def streamed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and numbers of events after replays arrived in the stream."""
    events = behaviour_events(spark, sf_dir)
    p = _fed(spark, [events, replays(events)])
    return p.hwm.join(p.agent, "agent_id").select("agent_id", "session_id", "hwm", "event_count")


def streamed_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of the score part as live records."""
    score, profile = _trained(spark, sf_dir)
    feed = shared_folder(spark, "feed")
    score.write.parquet(feed)
    made = []
    for found in stream_detect(spark.readStream.schema(ORDERED_EVENT).parquet(feed), profile):
        made.append(shared_folder(spark, "sink"))
        found.writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "checkpoint")).trigger(availableNow=True).start(made[-1]).awaitTermination()
    both = spark.read.parquet(made[0]).unionByName(spark.read.parquet(made[1]))
    return _rounded(both.select(*[c for c in SHOWN if c != "arrival"], "detector", "description", "baseline_value"))


def _logged(spark: SparkSession, sf_dir: str) -> list[tuple[str, Callable[[], None]]]:
    """An event log that is written in two parts, as (folder, writer) pairs."""
    spark.dataSource.register(LogFolder)
    folder = shared_folder(spark, "log")
    parts = enumerate(halves(behaviour_events(spark, sf_dir)))
    return [(folder, lambda k=k, part=part: events_to_json(part).write.text(f"{folder}/{k}")) for k, part in parts]


def logged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a log that is read through the data source, in small pieces."""
    for folder, write in _logged(spark, sf_dir):
        write()
    return _rounded(read_feed(spark, "event_log", path=folder, split=100_000)[0].select(*EVENT_COLUMNS))


def followed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a log that a stream follows: it is stopped after the first part and begun again after the second."""
    out, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    for folder, write in _logged(spark, sf_dir):
        write()
        events, _ = stream_feed(spark, "event_log", path=folder, split=100_000)
        events.select(*EVENT_COLUMNS).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return _rounded(spark.read.parquet(out).select(*EVENT_COLUMNS))


def _live(spark: SparkSession, sf_dir: str) -> str:
    """A store of live detection that was fed the score part in two parts, then replays of both."""
    score, profile = _trained(spark, sf_dir)
    late = F.col("timestamp") >= F.lit(LIVE_FROM).cast("timestamp")
    feed, root, checkpoint = shared_folder(spark, "feed"), shared_folder(spark, "live"), shared_folder(spark, "checkpoint")
    for part in (score.where(~late), score.where(late), replays(score)):
        part.write.mode("append").parquet(feed)
        stream_live(spark.readStream.schema(ORDERED_EVENT).parquet(feed), profile, root, checkpoint).awaitTermination()
    return root


def live_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of a stream in which replays arrive: the same as of the score part alone."""
    found = load_anomalies(spark, _live(spark, sf_dir))
    return _rounded(found.select(*[c for c in SHOWN if c != "arrival"], "detector", "description", "baseline_value"))


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of the sessions that were seen in the last three days of that stream."""
    return live_marks(spark, _live(spark, sf_dir), "3 days").select("agent_id", "session_id", "hwm")


ALL = [
    accepted_events,
    session_run_sizes,
    stream_runs,
    agent_profile,
    hourly_activity,
    known_resources,
    tool_profile,
    param_patterns,
    tool_bigrams,
    high_water_marks,
    resumed_profile,
    resumed_tools,
    resumed_bigrams,
    unprofiled,
    unknown_tool_calls,
    unknown_pairs,
    unknown_pairs_stream,
    rate_anomalies,
    rate_anomalies_stream,
    volume_anomalies,
    anomalies,
    anomaly_summary,
    anomalies_json,
    anomaly_evidence,
    profile_summary,
    profile_documents,
    profile_parts,
    events_json_roundtrip,
    transcript_events,
    transcript_totals,
    transcript_folder,
    transcript_agents,
    lenient_events,
    lenient_rejects,
    stored_events,
    stored_agents,
    stored_profile,
    stored_span,
    continued_sets,
    one_agent_tools,
    one_agent_anomalies,
    own_detectors,
    anomaly_texts,
    streamed_events,
    streamed_profile,
    streamed_marks,
    streamed_anomalies,
    live_anomalies,
    live_sessions,
    logged_events,
    followed_log,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
