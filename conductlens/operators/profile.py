"""Behaviour profiles: seven tables per population of agents, built, merged and summarised.

A profile's tables are made when they are first asked for, so a caller pays for
what it reads; frames that several tables need are written on their second use.
Merging a stored profile is a full outer join per table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.functions.staging import Shared, stage
from conductlens.functions.stats import merge_moments, moments
from conductlens.operators.sessions import accept_events, order_columns, previous, rate_per_minute, session_runs
from conductlens.schemas import PROFILE_KEYS, PROFILE_SCHEMAS


class Profile:
    """The tables of many agents' profiles, as frames or as functions that make them, and the events accepted in building them."""

    def __init__(self, accepted: DataFrame | Callable[[], DataFrame] | None = None, **tables: DataFrame | Callable[[], DataFrame]):
        if tables.keys() != PROFILE_SCHEMAS.keys():
            raise ValueError(f"a profile has the tables {', '.join(PROFILE_SCHEMAS)}")
        self._frames = {**tables, "accepted": accepted}

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name not in frames:
            raise AttributeError(name)
        if callable(frames[name]):
            frames[name] = frames[name]()
        return frames[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in PROFILE_SCHEMAS}

    def where(self, condition) -> Profile:
        return Profile(**{k: (lambda k=k: getattr(self, k).where(condition)) for k in PROFILE_SCHEMAS})

    def staged(self) -> Profile:
        """The same tables, each written when it is first asked for: for readers that use a table several times."""
        return Profile(accepted=self._frames["accepted"], **{k: (lambda k=k: stage(getattr(self, k))) for k in PROFILE_SCHEMAS})


def empty_profile(spark) -> Profile:
    return Profile(**{k: spark.createDataFrame([], s) for k, s in PROFILE_SCHEMAS.items()})


def build_profile(
    events: DataFrame,
    stored: Profile | None = None,
    agent_id: str | None = None,
    seam: str = "reference",
    last_state: DataFrame | None = None,
    method: str = "rank",
    order_cols: list[str] | None = None,
) -> Profile:
    """Profile of the events, continued from ``stored``.

    ``seam="reference"`` starts a new session run with the first new event of
    an agent.  ``seam="continuous"`` takes the last session, tool and time of
    each agent from ``last_state`` (agent_id, session_id, tool_name, call_time),
    so that pairs, rates and session counts go on across the seam.
    """
    order = order_cols or order_columns(events)
    if agent_id is not None:
        events = events.where(F.col("agent_id") == agent_id)
    order_key = F.struct(*order)
    accepted = Shared(lambda: accept_events(events, stored.hwm if stored else None, order))
    runs = Shared(lambda: session_runs(accepted(), ["agent_id"], order, method))
    seamed = seam == "continuous" and last_state is not None

    def joined() -> DataFrame:
        """The first run of an agent goes on where its last event was, if the session is the same."""
        first = runs().groupBy("agent_id").agg(F.min_by(F.struct("session_id", "run"), order_key).alias("f"))
        both = first.join(last_state.withColumnRenamed("session_id", "last_session"), "agent_id").where("f.session_id = last_session")
        return both.select("agent_id", F.col("f.session_id").alias("session_id"), F.col("f.run").alias("run"), F.col("tool_name").alias("last_tool"), "call_time")

    def called() -> DataFrame:
        calls = runs().where("event_type = 'ToolCall'").withColumn("tool", F.coalesce("tool_name", F.lit("unknown")))
        calls = calls.withColumns({"before": previous("tool", ["agent_id"], order), "before_time": previous("timestamp", ["agent_id"], order)})
        if seamed:
            opening = F.row_number().over(Window.partitionBy("agent_id", "session_id", "run").orderBy(*order)) == 1
            calls = (
                calls.withColumn("opening", opening)
                .join(joined(), ["agent_id", "session_id", "run"], "left")
                .withColumn("before", F.when(F.col("opening"), F.col("last_tool")).otherwise(F.col("before")))
                .withColumn("before_time", F.when(F.col("opening"), F.col("call_time")).otherwise(F.col("before_time")))
            )
        calls = calls.withColumns(
            {"rate": rate_per_minute(F.col("timestamp"), F.col("before_time")), "volume": (F.col("data_in_bytes") + F.col("data_out_bytes")).cast("double")}
        )
        return calls.select("agent_id", "tool", "before", "rate", "volume", "timestamp", F.array_sort("param_keys").alias("param_keys"), *[c for c in order if c != "timestamp"])

    calls = Shared(called)
    named = lambda prefix, m: [c.alias(f"{prefix}_{k}") for k, c in zip(("count", "mean", "m2"), m, strict=True)]

    def agent() -> DataFrame:
        # runs are counted where they begin, next to the other totals: one aggregation a run, one an agent
        each = runs().groupBy("agent_id", "session_id", "run").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(order_key.alias("at"), "timestamp")).alias("first"), F.max(F.struct(order_key.alias("at"), "timestamp")).alias("last")
        )
        totals = each.groupBy("agent_id").agg(
            F.count(F.lit(1)).alias("session_count"), F.sum("n").alias("event_count"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        if seamed:
            totals = totals.join(joined().select("agent_id", F.lit(1).alias("_seam")), "agent_id", "left")
            totals = totals.withColumn("session_count", F.col("session_count") - F.coalesce("_seam", F.lit(0)))
        rates = calls().groupBy("agent_id").agg(*named("rate", moments(F.col("rate"))))
        out = totals.join(rates, "agent_id", "left").fillna(0, ["rate_count"]).fillna(0.0, ["rate_mean", "rate_m2"])
        return out.select(
            "agent_id", "session_count", "event_count", F.col("first.timestamp").alias("first_seen"), F.col("last.timestamp").alias("last_updated"), "rate_count", "rate_mean", "rate_m2"
        )

    new = Profile(
        accepted=accepted,
        agent=agent,
        tool=lambda: calls().groupBy("agent_id", F.col("tool").alias("tool_name")).agg(
            F.count(F.lit(1)).alias("call_count"),
            F.min_by("timestamp", order_key).alias("first_seen"),
            F.max_by("timestamp", order_key).alias("last_seen"),
            *named("vol", moments(F.col("volume"))),
        ),
        param_set=lambda: calls().select("agent_id", F.col("tool").alias("tool_name"), "param_keys").distinct(),
        bigram=lambda: calls().where("before is not null").groupBy("agent_id", F.col("before").alias("first"), F.col("tool").alias("second")).agg(F.count(F.lit(1)).alias("n")),
        resource=lambda: accepted().select("agent_id", F.explode("resource_ids").alias("resource_id")).distinct(),
        hour=lambda: accepted().groupBy("agent_id", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n")),
        hwm=lambda: accepted().groupBy("agent_id", "session_id").agg(F.greatest(F.max("sequence_position"), F.lit(0)).alias("hwm"), F.max("timestamp").alias("seen")),
    )
    return merge_profiles(stored, new) if stored else new


def last_state_of(accepted: DataFrame, older: DataFrame | None = None, order_cols: list[str] | None = None) -> DataFrame:
    """(agent_id, session_id, tool_name, call_time): where each agent's run stands after the accepted events."""
    order = F.struct(*(order_cols or order_columns(accepted)))
    last = accepted.groupBy("agent_id").agg(F.max_by("session_id", order).alias("session_id"))
    runs = stage(session_runs(accepted, ["agent_id"], order_cols))
    tail = runs.groupBy("agent_id").agg(F.max_by(F.struct("session_id", "run"), order).alias("t"))
    calls = (
        runs.where("event_type = 'ToolCall'")
        .join(tail, "agent_id")
        .where("session_id = t.session_id and run = t.run")
        .groupBy("agent_id")
        .agg(F.max_by(F.struct(F.coalesce("tool_name", F.lit("unknown")).alias("tool_name"), F.col("timestamp").alias("call_time")), order).alias("c"))
    )
    # a run that has no call yet may go on from the older state of the same session
    new = last.join(calls, "agent_id", "left").join(tail, "agent_id").join(runs.groupBy("agent_id").agg(F.min_by(F.struct("session_id", "run"), order).alias("f")), "agent_id")
    if older is None:
        return new.select("agent_id", "session_id", F.col("c.tool_name").alias("tool_name"), F.col("c.call_time").alias("call_time"))
    old = older.select("agent_id", F.col("session_id").alias("_s"), F.col("tool_name").alias("_t"), F.col("call_time").alias("_c"))
    both = new.join(old, "agent_id", "full_outer")
    goes_on = F.col("c").isNull() & (F.col("t") == F.col("f")) & (F.col("session_id") == F.col("_s"))
    untouched = F.col("session_id").isNull()
    return both.select(
        "agent_id",
        F.coalesce("session_id", "_s").alias("session_id"),
        F.when(untouched | goes_on, F.col("_t")).otherwise(F.col("c.tool_name")).alias("tool_name"),
        F.when(untouched | goes_on, F.col("_c")).otherwise(F.col("c.call_time")).alias("call_time"),
    )


def merge_profiles(old: Profile, new: Profile) -> Profile:
    """Counters add, sets unite, first comes from the old and last from the new profile, moments merge."""

    def pair(name: str) -> DataFrame:
        keys = PROFILE_KEYS[name]
        a, b = getattr(old, name), getattr(new, name)
        a = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys])
        b = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
        return a.join(b, keys, "full_outer")

    add = lambda c: (F.coalesce(f"a_{c}", F.lit(0)) + F.coalesce(f"b_{c}", F.lit(0))).alias(c)
    first = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    last = lambda c: F.coalesce(f"b_{c}", f"a_{c}").alias(c)

    def merged(prefix: str) -> list:
        side = lambda s: tuple(F.col(f"{s}_{prefix}_{k}") for k in ("count", "mean", "m2"))
        return [c.alias(f"{prefix}_{k}") for k, c in zip(("count", "mean", "m2"), merge_moments(side("a"), side("b")), strict=True)]

    union = lambda name: getattr(old, name).unionByName(getattr(new, name)).distinct()
    return Profile(
        accepted=lambda: new.accepted,
        agent=lambda: pair("agent").select("agent_id", add("session_count"), add("event_count"), first("first_seen"), last("last_updated"), *merged("rate")),
        tool=lambda: pair("tool").select("agent_id", "tool_name", add("call_count"), first("first_seen"), last("last_seen"), *merged("vol")),
        param_set=lambda: union("param_set"),
        bigram=lambda: pair("bigram").select("agent_id", "first", "second", add("n")),
        resource=lambda: union("resource"),
        hour=lambda: pair("hour").select("agent_id", "hour", add("n")),
        hwm=lambda: pair("hwm").select("agent_id", "session_id", F.greatest("a_hwm", "b_hwm").alias("hwm"), F.greatest("a_seen", "b_seen").alias("seen")),
    )


def expire_marks(profile: Profile, ttl: str) -> Profile:
    """Without the marks of sessions that were last seen more than ``ttl`` (an interval such as ``30 days``) before their agent's last event.

    Replays of such a session would count again.  Marks without a time stay.
    """
    def kept() -> DataFrame:
        last = profile.hwm.groupBy("agent_id").agg(F.max("seen").alias("_last"))
        old = F.col("seen") < F.col("_last") - F.expr(f"INTERVAL {ttl}")
        return profile.hwm.join(last, "agent_id").where(~F.coalesce(old, F.lit(False))).drop("_last")

    others = {k: (lambda k=k: getattr(profile, k)) for k in PROFILE_SCHEMAS if k != "hwm"}
    return Profile(accepted=lambda: profile.accepted, hwm=kept, **others)


def build_summary(profile: Profile) -> DataFrame:
    """Per agent: sessions, events, numbers of tools, resources and pairs, rate, first and last time."""
    count = lambda df, name: df.groupBy("agent_id").agg(F.count(F.lit(1)).alias(name))
    out = profile.agent
    for df, name in ((profile.tool, "n_tools"), (profile.resource, "n_resources"), (profile.bigram, "n_bigrams")):
        out = out.join(count(df, name), "agent_id", "left").fillna(0, [name])
    return out.select("agent_id", "session_count", "event_count", "n_tools", "n_resources", "n_bigrams", "rate_count", "rate_mean", "first_seen", "last_updated")


def profile_to_document(profile: Profile) -> DataFrame:
    """One nested document per agent (agent_id, document as JSON text); pair keys are written ``first->second``.

    This is an export for small profiles: a document holds an agent's whole profile; ``profile_to_parts`` has no such row.
    """

    def listed(df: DataFrame, name: str, *columns) -> DataFrame:
        return df.groupBy("agent_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    sets = profile.param_set.groupBy("agent_id", "tool_name").agg(F.sort_array(F.collect_list("param_keys")).alias("param_key_sets"))
    tools = profile.tool.join(sets, ["agent_id", "tool_name"], "left")
    moment = lambda p: F.struct(F.col(f"{p}_count").alias("count"), F.col(f"{p}_mean").alias("mean"), F.col(f"{p}_m2").alias("m2"))
    stats = F.struct("call_count", "first_seen", "last_seen", F.coalesce("param_key_sets", F.array().cast("array<array<string>>")).alias("param_key_sets"))
    parts = [
        listed(tools, "tool_stats", "tool_name", stats.alias("stats")),
        listed(profile.tool, "volume_stats", "tool_name", moment("vol").alias("stats")),
        listed(profile.bigram, "bigrams", F.concat("first", F.lit("->"), "second").alias("pair"), "n"),
        listed(profile.hwm, "processed_through", "session_id", "hwm"),
        listed(profile.hwm.where("seen is not null"), "processed_at", "session_id", "seen"),
        profile.resource.groupBy("agent_id").agg(F.sort_array(F.collect_list("resource_id")).alias("known_resources")),
        listed(profile.hour, "hours", "hour", "n"),
    ]
    out = profile.agent
    for part in parts:
        out = out.join(part, "agent_id", "left")
    at = lambda h: F.coalesce(F.get(F.filter("hours", lambda x: x["hour"] == h), F.lit(0))["n"], F.lit(0))
    document = F.struct(
        "agent_id",
        "session_count",
        "event_count",
        F.map_from_entries("tool_stats").alias("tool_stats"),
        F.map_from_entries("bigrams").alias("bigrams"),
        F.coalesce("known_resources", F.array().cast("array<string>")).alias("known_resources"),
        F.map_from_entries("volume_stats").alias("volume_stats"),
        F.transform(F.sequence(F.lit(0), F.lit(23)), at).alias("hourly_distribution"),
        moment("rate").alias("rate_stats"),
        "first_seen",
        "last_updated",
        F.map_from_entries("processed_through").alias("processed_through"),
        F.map_from_entries("processed_at").alias("processed_at"),
    )
    return out.select("agent_id", F.to_json(document, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("document"))


MOMENT = "struct<count:long,mean:double,m2:double>"
DOCUMENT = (
    "struct<agent_id:string,session_count:long,event_count:long,"
    "tool_stats:map<string,struct<call_count:long,first_seen:timestamp,last_seen:timestamp,param_key_sets:array<array<string>>>>,"
    "bigrams:map<string,long>,known_resources:array<string>,"
    f"volume_stats:map<string,{MOMENT}>,hourly_distribution:array<long>,rate_stats:{MOMENT},"
    "first_seen:timestamp,last_updated:timestamp,processed_through:map<string,long>,processed_at:map<string,timestamp>>"
)


def document_to_profile(documents: DataFrame) -> Profile:
    """The tables of nested documents; a pair key is split at its first ``->``."""
    d = documents.select(F.from_json("document", DOCUMENT).alias("d")).select("d.*")
    tools = d.select("agent_id", "volume_stats", F.explode("tool_stats").alias("tool_name", "s"))
    volume = F.element_at("volume_stats", F.col("tool_name"))
    return Profile(
        agent=d.select(
            "agent_id", "session_count", "event_count", "first_seen", "last_updated", *[F.col(f"rate_stats.{k}").alias(f"rate_{k}") for k in ("count", "mean", "m2")]
        ),
        tool=tools.select("agent_id", "tool_name", "s.call_count", "s.first_seen", "s.last_seen", *[volume[k].alias(f"vol_{k}") for k in ("count", "mean", "m2")]),
        param_set=tools.select("agent_id", "tool_name", F.explode("s.param_key_sets").alias("param_keys")),
        bigram=d.select("agent_id", F.explode("bigrams").alias("pair", "n")).select(
            "agent_id",
            F.substring_index("pair", "->", 1).alias("first"),
            F.expr("substring(pair, instr(pair, '->') + 2)").alias("second"),
            "n",
        ),
        resource=d.select("agent_id", F.explode("known_resources").alias("resource_id")),
        hour=d.select("agent_id", F.posexplode("hourly_distribution").alias("hour", "n")).where("n > 0"),
        hwm=d.select("agent_id", "processed_at", F.explode("processed_through").alias("session_id", "hwm")).select(
            "agent_id", "session_id", "hwm", F.try_element_at("processed_at", F.col("session_id")).alias("seen")
        ),
    )


PART_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PART_ROWS = 10_000


def _part_of(keys: list[str], parts: Column) -> Column:
    text = [F.array_join(c, "\x00") if c == "param_keys" else F.col(c).cast("string") for c in keys if c != "agent_id"]
    return F.pmod(F.xxhash64(*text), parts)


def profile_to_parts(profile: Profile, rows: int = PART_ROWS) -> DataFrame:
    """(agent_id, component, part, parts, n, document): profiles as JSON documents of bounded size.

    A component is one of the seven tables.  A hash of its key deals an agent's
    rows to so many parts that one holds ``rows`` / 2 on average, twice that only
    by a freak of the hash; a key's part can be found again from ``parts``.
    """

    def dealt(name: str) -> DataFrame:
        df, keys = getattr(profile, name), PROFILE_KEYS[name]
        if name == "agent":  # one row each
            df = df.withColumns({"parts": F.lit(1).cast("long"), "part": F.lit(0).cast("long")})
        else:
            sizes = df.groupBy("agent_id").agg(F.ceil(F.count(F.lit(1)) * 2 / rows).alias("parts"))
            df = df.join(sizes, "agent_id")
            df = df.withColumn("part", _part_of(keys, F.col("parts")))
        row = F.struct(*[c for c in getattr(profile, name).columns if c != "agent_id"])
        listed = df.groupBy("agent_id", "part").agg(F.first("parts").alias("parts"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
        document = F.to_json("rows", {"ignoreNullFields": "false", "timestampFormat": PART_TIME})
        return listed.select("agent_id", F.lit(name).alias("component"), "part", "parts", "n", document.alias("document"))

    return reduce(DataFrame.unionByName, map(dealt, PROFILE_SCHEMAS))


def parts_to_profile(parts: DataFrame) -> Profile:
    """The tables of documents in parts: of all, or of those that are given."""

    def table(name: str) -> DataFrame:
        columns = PROFILE_SCHEMAS[name].removeprefix("agent_id string, ")
        row = F.from_json("document", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in columns.split(', '))}>>", {"timestampFormat": PART_TIME})
        return parts.where(F.col("component") == name).select("agent_id", F.inline(row))

    return Profile(**{name: (lambda name=name: table(name)) for name in PROFILE_SCHEMAS})


def parts_with(parts: DataFrame, component: str, *key: Column | str) -> DataFrame:
    """The parts that hold a key (its values in the order of the table, without the agent) if any does: one for each agent."""
    values = [F.lit(v) if isinstance(v, str) else v for v in key]
    text = [F.array_join(v, "\x00") if c == "param_keys" else v.cast("string") for c, v in zip(PROFILE_KEYS[component][1:], values, strict=True)]
    return parts.where((F.col("component") == component) & (F.col("part") == F.pmod(F.xxhash64(*text), F.col("parts"))))
