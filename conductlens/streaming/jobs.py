"""Streaming: continued profiles from a live feed, and live detection against fixed profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from conductlens.functions.staging import stage
from conductlens.operators.detect import DETECTORS, agent_facts, attach_profile, graded, joined_calls
from conductlens.operators.profile import Profile, build_profile, expire_marks, last_state_of
from conductlens.schemas import EVENT, EVENT_COLUMNS
from conductlens.sources.store import TEXT_TIME, append_events, load_profile, load_state, save_profile


def build_batch(batch: DataFrame, root: str, name: str | None = None, mark_ttl: str | None = None) -> None:
    """One micro-batch: accept, profile, merge, store.

    It may be repeated after an interruption at any point, under the same name:
    until the profile is published, with the agents' last calls, the same events
    are accepted, and added once; afterwards its marks accept none of them.
    Only the batch's agents are read from the profile store and written to it.
    ``mark_ttl`` (an interval such as ``30 days``) drops the marks of these
    agents' sessions that have been silent for so long.
    """
    spark = batch.sparkSession
    agents = stage(batch.select("agent_id").distinct())
    stored, latest = load_profile(spark, root, agents=agents), load_state(spark, root, agents)
    profile = build_profile(batch, stored, seam="continuous", last_state=latest)
    accepted = stage(profile.accepted)
    if not accepted.limit(1).count():
        return
    append_events(accepted, root, name)
    state = last_state_of(accepted, latest)
    save_profile(expire_marks(profile, mark_ttl) if mark_ttl else profile, root, state)


def stream_build(stream: DataFrame, root: str, checkpoint: str, mark_ttl: str | None = None, **trigger) -> StreamingQuery:
    """Keep the stored profiles up to date with a stream of events."""

    def run(df: DataFrame, number: int) -> None:
        # the id of the query, which is in the checkpoint: batches of another checkpoint have other names
        feed = df.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        build_batch(df, root, f"{feed}-{number:012d}", mark_ttl)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


STATE = "session string, tool string, rate_session string, time timestamp"
CALLS = "agent_id string, event string, before string, before_time timestamp"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An agent's calls with the named call before them in their run, and the time of the call before."""
    session, tool, rate_session, time = state.get if state.exists else (None, None, None, None)
    calls = pd.concat(list(batches)).sort_values("arrival", kind="stable")
    out = []
    for r in calls.itertuples():
        before = before_time = None
        if isinstance(r.tool_name, str):
            before = tool if session == r.session_id else None
            session, tool = r.session_id, r.tool_name
        if time is not None and rate_session == r.session_id:
            before_time = pd.Timestamp(time)
        rate_session, time = r.session_id, r.timestamp
        out.append((key[0], r.event, before, before_time))
    state.update((session, tool, rate_session, pd.Timestamp(time).to_pydatetime()))
    yield pd.DataFrame(out, columns=["agent_id", "event", "before", "before_time"])


def stream_calls(stream: DataFrame) -> DataFrame:
    """Tool calls with ``before`` and ``before_time``; the state of an agent is its last call.

    Calls of one micro-batch are ordered by ``arrival``.  An event passes the
    state as one text and is read again behind it.
    """
    event = F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false", "timestampFormat": TEXT_TIME})
    calls = stream.where("event_type = 'ToolCall'").select("agent_id", "session_id", "timestamp", "tool_name", "arrival", event.alias("event"))
    followed = calls.groupBy("agent_id").applyInPandasWithState(_follow, CALLS, STATE, "append", GroupStateTimeout.NoTimeout)
    return followed.select(F.from_json("event", EVENT, {"timestampFormat": TEXT_TIME}).alias("e"), "before", "before_time").select("e.*", "before", "before_time")


def stream_detect(stream: DataFrame, profile: Profile, threshold: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(anomalies of single calls, anomalies of consecutive calls): two streams of full records against a fixed profile.

    The first needs no state and joins the tool table; the second follows the
    order of calls, with one small state per agent, and holds an agent's calls
    of one micro-batch in one task; ``live.stream_live`` has no such bound.
    The profile's tables are written once, not made for every micro-batch.
    ``anomaly_records`` nests either.
    """
    profile = profile.staged()
    facts = stage(agent_facts(profile))
    sides = {False: stream.where("event_type = 'ToolCall' and tool_name is not null"), True: stream_calls(stream)}
    out = []
    for ordered, calls in sides.items():
        chosen = {k: d for k, d in enumerate(DETECTORS) if bool({"pair", "rate"} & {*d.needs}) is ordered}
        calls = joined_calls(attach_profile(calls, profile), profile, {n for d in chosen.values() for n in d.needs})
        out.append(graded(calls, facts, threshold, EVENT_COLUMNS, chosen))
    return out[0], out[1]
