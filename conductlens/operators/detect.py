"""Anomaly detectors: events against profiles.

The sequence detector looks at named calls only, the rate detector at all calls;
each has its own notion of a run.  A ``Detector`` is a test and a record, both
expressions, and says what has to be joined for them; ``detect`` runs all
detectors of a list in one pass over the tool calls of profiled agents.  The
built-in ones also stand alone as functions, and such a function may be in a list too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductlens.functions.stats import z_score
from conductlens.functions.text import fixed
from conductlens.operators.profile import Profile
from conductlens.operators.sessions import followed_calls, order_columns, previous, rate_per_minute, session_runs
from conductlens.schemas import EVENT_COLUMNS

FULL_CONFIDENCE = 100.0  # events of a profile from which its word counts fully
HIGH_ABOVE = 2.0  # a z-score this far above the threshold is severe


def _scope(scope: str) -> list[str]:
    if scope not in ("agent", "stream"):
        raise ValueError(f"scope is agent or stream, not {scope!r}")
    return ["agent_id"] if scope == "agent" else []


def attach_profile(events: DataFrame, profile: Profile) -> DataFrame:
    """Events of agents that have a profile, with its counters; Spark broadcasts the agent table when it is small."""
    about = profile.agent.select("agent_id", "event_count", "rate_count", "rate_mean", "rate_m2")
    return events.join(about, "agent_id")


def unprofiled_agents(events: DataFrame, profile: Profile) -> DataFrame:
    return events.join(profile.agent.select("agent_id"), "agent_id", "left_anti").groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))


def _calls(events: DataFrame, profile: Profile) -> DataFrame:
    return attach_profile(events, profile).where("event_type = 'ToolCall'")


def record(kind: str, description: Column, baseline: Column, observed: Column, z: Column, severity: Column, numbers: tuple[Column, Column]) -> Column:
    """One anomaly as a struct; ``baseline_value`` of an unknown tool or pair is completed from the agent's profile."""
    return F.struct(
        F.lit(kind).alias("anomaly_type"),
        severity.alias("severity"),
        description.alias("description"),
        baseline.cast("string").alias("baseline_value"),
        observed.cast("string").alias("observed_value"),
        z.cast("double").alias("z_score"),
        F.least(F.col("event_count") / FULL_CONFIDENCE, F.lit(1.0)).alias("confidence"),
        numbers[0].cast("double").alias("observed_num"),
        numbers[1].cast("double").alias("baseline_mean"),
    )


def _severity(z: Column, threshold: float) -> Column:
    return F.when(z > threshold + HIGH_ABOVE, "High").otherwise("Medium")


def _no_number() -> tuple[Column, Column]:
    return F.lit(None), F.lit(None)


def _event_columns(df: DataFrame) -> list[str]:
    return [c for c in [*EVENT_COLUMNS, "arrival"] if c in df.columns]


def _unknown_tool() -> Column:
    return record("UnknownTool", F.concat(F.lit("unknown tool: "), "tool_name"), F.lit(None), F.col("tool_name"), F.lit(None), F.lit("High"), _no_number())


def _unknown_sequence() -> Column:
    pair = F.concat("before", F.lit("->"), "tool_name")
    return record("UnknownSequence", F.concat(F.lit("unseen sequence: "), pair), F.lit(None), pair, F.lit(None), F.lit("Medium"), _no_number())


def _rate_spike(threshold: float) -> Column:
    z, rate = F.col("rate_z"), fixed(F.col("rate"), 1)
    return record(
        "RateSpike",
        F.concat(F.lit("rate spike: "), rate, F.lit(" calls/min (z="), fixed(z, 1), F.lit(")")),
        F.concat(fixed(F.col("rate_mean"), 1), F.lit(" calls/min (mean)")),
        F.concat(rate, F.lit(" calls/min")),
        z,
        _severity(z, threshold),
        (F.col("rate"), F.col("rate_mean")),
    )


def _volume_spike(threshold: float) -> Column:
    z, size = F.col("volume_z"), fixed(F.col("volume"), 0)
    return record(
        "VolumeSpike",
        F.concat(F.lit("volume spike on "), "tool_name", F.lit(": "), size, F.lit(" bytes (z="), fixed(z, 1), F.lit(")")),
        F.concat(fixed(F.col("vol_mean"), 0), F.lit(" bytes (mean)")),
        F.concat(size, F.lit(" bytes")),
        z,
        _severity(z, threshold),
        (F.col("volume"), F.col("vol_mean")),
    )


def rated(calls: DataFrame) -> DataFrame:
    """Adds ``rate`` and ``rate_z`` to calls with ``before_time`` and their agent's counters."""
    calls = calls.withColumn("rate", rate_per_minute(F.col("timestamp"), F.col("before_time")))
    return calls.withColumn("rate_z", z_score(F.col("rate"), F.col("rate_count"), F.col("rate_mean"), F.col("rate_m2")))


def moved(calls: DataFrame) -> DataFrame:
    """Adds ``volume`` and ``volume_z`` to calls with their tool's moments."""
    calls = calls.withColumn("volume", (F.col("data_in_bytes") + F.col("data_out_bytes")).cast("double"))
    return calls.withColumn("volume_z", z_score(F.col("volume"), F.col("vol_count"), F.col("vol_mean"), F.col("vol_m2")))


def known_tools(profile: Profile) -> DataFrame:
    return profile.tool.select("agent_id", "tool_name", F.lit(True).alias("known"), "vol_count", "vol_mean", "vol_m2")


def known_pairs(profile: Profile) -> DataFrame:
    return profile.bigram.select("agent_id", F.col("first").alias("before"), F.col("second").alias("tool_name"), F.lit(True).alias("seen"))


def agent_facts(profile: Profile, list_tools: bool = True) -> DataFrame:
    """(agent_id, _n, _tools): an agent's number of known pairs and the text of its known tools, null without ``list_tools``; one row an agent."""
    facts = profile.bigram.groupBy("agent_id").agg(F.count(F.lit(1)).alias("_n"))
    if not list_tools:
        return facts.withColumn("_tools", F.lit(None).cast("string"))
    tools = profile.tool.groupBy("agent_id").agg(F.array_join(F.sort_array(F.collect_list("tool_name")), ", ").alias("_tools"))
    return facts.join(tools, "agent_id", "full_outer").withColumn("_tools", F.coalesce("_tools", F.lit("")))


def _completed(found: DataFrame, facts: DataFrame, columns: list[str], list_tools: bool = True) -> DataFrame:
    """Adds what unknown tools and pairs are held against: texts made once for each agent, joined to the few anomalies."""
    found = found.join(facts, "agent_id", "left")
    known = F.concat(F.lit("known tools: ["), F.coalesce("_tools", F.lit("")), F.lit("]")) if list_tools else F.lit(None)
    text = F.when(F.col("anomaly_type") == "UnknownTool", known).when(
        F.col("anomaly_type") == "UnknownSequence", F.concat(F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" known bigrams"))
    )
    return found.withColumn("baseline_value", F.coalesce("baseline_value", text)).select(*columns, *RECORD)


RECORD = ["anomaly_type", "severity", "description", "baseline_value", "observed_value", "z_score", "confidence", "observed_num", "baseline_mean"]


def unknown_tools(events: DataFrame, profile: Profile, threshold: float = 3.0, scope: str = "agent", list_tools: bool = True) -> DataFrame:
    """Named calls of tools that the agent's profile does not hold.

    The list of known tools is made once per agent; ``list_tools=False`` leaves it out.
    """
    calls = _calls(events, profile).where("tool_name is not null")
    found = calls.join(profile.tool.select("agent_id", "tool_name"), ["agent_id", "tool_name"], "left_anti")
    return _completed(found.select("*", F.inline(F.array(_unknown_tool()))), agent_facts(profile, list_tools), _event_columns(events), list_tools)


def unknown_sequences(events: DataFrame, profile: Profile, threshold: float = 3.0, scope: str = "agent", method: str = "rank") -> DataFrame:
    """Pairs of consecutive named calls that the profile does not hold; calls without a name are invisible."""
    order = order_columns(events)
    named = session_runs(_calls(events, profile).where("tool_name is not null"), _scope(scope), order, method)
    pairs = named.withColumn("before", previous("tool_name", _scope(scope), order)).where("before is not null")
    found = pairs.join(known_pairs(profile), ["agent_id", "before", "tool_name"], "left_anti")
    return _completed(found.select("*", F.inline(F.array(_unknown_sequence()))), agent_facts(profile, False), _event_columns(events), list_tools=False)


def rate_spikes(events: DataFrame, profile: Profile, threshold: float = 3.0, scope: str = "agent", method: str = "rank") -> DataFrame:
    """Calls that follow the one before faster than the profile's rates allow."""
    order = order_columns(events)
    runs = session_runs(_calls(events, profile), _scope(scope), order, method)
    timed = rated(runs.withColumn("before_time", previous("timestamp", _scope(scope), order)))
    return timed.where(F.col("rate_z") > threshold).select(*_event_columns(events), F.inline(F.array(_rate_spike(threshold))))


def volume_spikes(events: DataFrame, profile: Profile, threshold: float = 3.0, scope: str = "agent") -> DataFrame:
    """Named calls that move more data than the tool's history allows."""
    calls = moved(_calls(events, profile).join(known_tools(profile), ["agent_id", "tool_name"]))
    return calls.where(F.col("volume_z") > threshold).select(*_event_columns(events), F.inline(F.array(_volume_spike(threshold))))


class Detector(NamedTuple):
    """A detector as expressions over a tool call; both take the threshold.

    ``test`` is true for the calls it reports and ``record`` makes their anomaly
    (``record(...)``).  ``needs`` names what is joined for them besides the
    event and its agent's counters: ``tool`` (known, vol_count, vol_mean, vol_m2,
    volume, volume_z), ``pair`` (before, seen), ``rate`` (before_time, rate, rate_z).
    """

    kind: str
    test: Callable[[float], Column]
    record: Callable[[float], Column]
    needs: tuple[str, ...] = ()


UNKNOWN_TOOL = Detector("UnknownTool", lambda _: F.col("tool_name").isNotNull() & F.col("known").isNull(), lambda _: _unknown_tool(), ("tool",))
UNKNOWN_SEQUENCE = Detector("UnknownSequence", lambda _: F.col("before").isNotNull() & F.col("seen").isNull(), lambda _: _unknown_sequence(), ("pair",))
RATE_SPIKE = Detector("RateSpike", lambda threshold: F.col("rate_z") > threshold, _rate_spike, ("rate",))
VOLUME_SPIKE = Detector("VolumeSpike", lambda threshold: F.col("tool_name").isNotNull() & (F.col("volume_z") > threshold), _volume_spike, ("tool",))
DETECTORS = (UNKNOWN_TOOL, UNKNOWN_SEQUENCE, RATE_SPIKE, VOLUME_SPIKE)
Listed = Detector | Callable[..., DataFrame]


def joined_calls(calls: DataFrame, profile: Profile, needs: set[str]) -> DataFrame:
    """Calls with the columns of the profile that are needed; the calls before are there already."""
    if "rate" in needs:
        calls = rated(calls)
    if "tool" in needs:
        calls = moved(calls.join(known_tools(profile), ["agent_id", "tool_name"], "left"))
    if "pair" in needs:
        calls = calls.join(known_pairs(profile), ["agent_id", "before", "tool_name"], "left")
    return calls


def graded(calls: DataFrame, facts: DataFrame, threshold: float, columns: list[str], detectors: dict[int, Detector], list_tools: bool = True) -> DataFrame:
    """Anomalies of calls whose profile columns are joined: the detectors, by their places in the list, are tested side by side in one pass."""
    # rows without any anomaly go before texts are made
    fires = F.array_compact(F.array(*[F.when(d.test(threshold), F.lit(k)) for k, d in detectors.items()]))
    calls = calls.withColumn("detector", F.explode(fires))
    entry = reduce(lambda acc, k: F.when(F.col("detector") == k, detectors[k].record(threshold)).otherwise(acc), detectors, F.lit(None))
    return _completed(calls.select("*", F.inline(F.array(entry))), facts, [*columns, "detector"], list_tools)


def detect(
    events: DataFrame,
    profile: Profile,
    threshold: float = 3.0,
    detectors: list[Listed] | None = None,
    scope: str = "agent",
    agent_id: str | None = None,
    list_tools: bool = True,
) -> DataFrame:
    """Anomalies of all detectors; ``detector`` is a detector's place in the list, for ordering by (arrival, detector).

    Every ``Detector`` of the list (by default the four built-in ones) is tested
    in one pass, which orders the calls only if one of them looks at the call
    before.  A function (events, profile, threshold, scope) -> anomalies with
    the columns of the built-in ones may be in the list too; each is a pass of
    its own.  An empty list finds nothing.  ``list_tools=False`` leaves out the
    list of known tools from the records of unknown ones.
    """
    if agent_id is not None:
        events = events.where(F.col("agent_id") == agent_id)
    listed = dict(enumerate(DETECTORS if detectors is None else detectors))
    found = [d(events, profile, threshold, scope).withColumn("detector", F.lit(k)) for k, d in listed.items() if not isinstance(d, Detector)]
    own = {k: d for k, d in listed.items() if isinstance(d, Detector)}
    if own or not found:
        calls = _calls(events, profile)
        needs = {n for d in own.values() for n in d.needs}
        if needs & {"pair", "rate"}:
            calls = followed_calls(calls, _scope(scope), order_columns(events))
        columns = _event_columns(events)
        tested = own or {0: Detector("", lambda _: F.lit(False), lambda _: _unknown_tool())}
        found.append(graded(joined_calls(calls, profile, needs), agent_facts(profile, list_tools), threshold, columns, tested, list_tools))
    return reduce(DataFrame.unionByName, found)


def anomaly_records(anomalies: DataFrame) -> DataFrame:
    """Anomalies in their nested form: the whole event is part of the evidence."""
    event = F.struct(*EVENT_COLUMNS)
    evidence = F.struct(event.alias("event"), "baseline_value", "observed_value", "z_score", "confidence")
    extra = [c for c in ("arrival", "detector") if c in anomalies.columns]
    return anomalies.select("timestamp", "severity", "anomaly_type", "description", evidence.alias("evidence"), *extra)


def detection_summary(events: DataFrame, anomalies: DataFrame, profile: Profile) -> DataFrame:
    """(metric, n): events scanned (of profiled agents), anomalies in total and by type.

    The anomalies are evaluated once, for their total and their types together;
    of the events only the agents are read.
    """
    count = F.count(F.lit(1)).alias("n")
    by_type = anomalies.rollup("anomaly_type").agg(count, F.grouping_id().alias("_total"))
    by_type = by_type.select(F.when(F.col("_total") == 1, "anomalies").otherwise(F.col("anomaly_type")).alias("metric"), "n")
    scanned = events.select("agent_id").join(profile.agent.select("agent_id"), "agent_id", "left_semi").agg(count)
    # the total is there without any anomaly, too
    first = scanned.select(F.inline(F.array(F.struct(F.lit("events_scanned").alias("metric"), "n"), F.struct(F.lit("anomalies").alias("metric"), F.lit(0).cast("long").alias("n")))))
    return first.unionByName(by_type).groupBy("metric").agg(F.sum("n").alias("n"))
