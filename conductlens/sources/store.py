"""Events as JSON lines; event and profile stores that grow by layers of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductlens.functions.staging import stage
from conductlens.functions.text import Repeated, absent, in_line, kind_of, plain_json, plain_kind, strict_json
from conductlens.operators.profile import Profile
from conductlens.schemas import EVENT, EVENT_COLUMNS, EVENT_TYPES, OPTIONAL, PROFILE_SCHEMAS
from conductlens.sources.layers import BUCKETS, Layer, Layers, bucket, to_fold, write_bucketed

TEXT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


# --- events as JSON lines ---


def events_to_json(events: DataFrame) -> DataFrame:
    """One JSON text per event (column value): all fields in declared order, nulls written."""
    return events.select(F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false", "timestampFormat": TEXT_TIME}).alias("value"))


def anomalies_to_json(records: DataFrame) -> DataFrame:
    """One JSON text per anomaly record; order it by (arrival, detector) where the order matters."""
    fields = [c for c in records.columns if c not in ("arrival", "detector")]
    order = [c for c in ("arrival", "detector") if c in records.columns]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": TEXT_TIME})
    return records.select(text.alias("value"), *order)


STRICT_TYPES = {T.StringType: str, T.LongType: int, T.TimestampType: str}


def valid_event(line: str) -> bool:
    """Whether a JSON text is an event: fields there, of the right type, without coercion, each once."""
    try:
        raw = strict_json(line)
    except (ValueError, RecursionError):
        return False
    if not isinstance(raw, Repeated) or raw.twice & set(EVENT_COLUMNS):
        return False
    for field in EVENT.fields:
        value = raw.get(field.name)
        if value is None:
            if field.name not in OPTIONAL:
                return False
        elif isinstance(field.dataType, T.ArrayType):
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                return False
        elif isinstance(value, bool) or not isinstance(value, STRICT_TYPES[type(field.dataType)]):
            return False
        elif isinstance(value, int) and not 0 <= value < 1 << 63:
            return False
    return raw["event_type"] in EVENT_TYPES


def _valid(lines: pd.Series) -> pd.Series:
    return pd.Series([None if line is None else valid_event(line) for line in lines], dtype=object)


def _kinds(field: T.StructField) -> list[str]:
    kind = {T.LongType: ["BIGINT"], T.ArrayType: ["ARRAY<STRING>", "ARRAY<VOID>"]}.get(type(field.dataType), ["STRING"])
    return kind + ["VOID"] * (field.name in OPTIONAL)


#: The types of lines that are events with all their fields and no others.
WHOLE_EVENTS = [
    in_line(f"OBJECT<{', '.join(f'{name}: {kind}' for name, kind in zip(sorted(EVENT_COLUMNS), kinds, strict=True))}>")
    for kinds in product(*[_kinds(EVENT[c]) for c in sorted(EVENT_COLUMNS)])
]


def plain_event(v: Column) -> Column:
    """Whether a line is an event, of its VARIANT: fields there and of their types; null and false leave the decision to ``valid_event``."""
    tests = []
    for field in EVENT.fields:
        path, want = f"$.{field.name}", {T.LongType: "BIGINT"}.get(type(field.dataType), "STRING")
        kind = kind_of(v, path)
        if isinstance(field.dataType, T.ArrayType):
            tests.append(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(F.try_variant_get(v, path, "array<string>")) >= 0))
        else:
            tests.append((absent(v, path) | (kind == want)) if field.name in OPTIONAL else kind == want)
    return reduce(Column.__and__, tests)


def parse_events(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a frame with a column value; further columns are kept.

    ``strict`` also refuses values that JSON parsing would coerce, such as a
    number in a text field.
    """
    more = [c for c in lines.columns if c != "value"]
    # each line is decoded once: what a generator makes is not evaluated again wherever it is used
    decoded = {"e": F.from_json("value", EVENT, {"mode": "PERMISSIVE"})} | ({"_whole": plain_kind(F.col("value")).isin(WHOLE_EVENTS)} if strict else {})
    parsed = lines.select("*", F.inline(F.array(F.struct(*[x.alias(c) for c, x in decoded.items()]))))
    required = [f"e.{c}" for c in EVENT_COLUMNS if c not in OPTIONAL]
    ok = F.col("e").isNotNull() & F.col("e.event_type").isin(EVENT_TYPES)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    for c in ("data_in_bytes", "data_out_bytes", "duration_ms", "sequence_position"):
        ok = ok & (F.col(f"e.{c}") >= 0)
    ok = ok & (F.coalesce("e.token_count", F.lit(0)) >= 0)
    for c in ("param_keys", "resource_ids"):
        ok = ok & ~F.exists(f"e.{c}", lambda x: x.isNull())
    if strict:
        # Python gets the lines that the JVM does not read strictly, and nulls, which it gives back, for the others
        other = F.transform(F.array(plain_json(F.col("value"))), plain_event)[0]
        plain = F.when(F.col("_whole"), True).otherwise(F.coalesce(other, F.lit(False)))
        ok = ok & F.coalesce(F.pandas_udf(_valid, "boolean")(F.when(~plain, F.col("value"))), F.lit(True))
    marked = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return marked.where("_ok").select("e.*", *more), marked.where("not _ok").select("value", *more)


def read_events(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events with arrival, rejects) of JSON lines; blank lines are skipped.

    ``arrival`` is the file's name, the block and the row in the scan's order.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    at = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    )
    return parse_events(lines.select("value", at.alias("arrival")), strict)


def stream_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) streams over a folder of JSON lines."""
    return parse_events(spark.readStream.text(path).where(F.trim("value") != ""))


def _event_log(spark: SparkSession, root: str) -> Layers:
    return Layers(spark, f"{root}/events")


FILES = "agent_id string, file string, rows long, first timestamp, last timestamp"


def _write_events(log: Layers, events: DataFrame) -> Layer:
    """A layer: the events by bucket, and for each agent and file the number of events and their first and last time."""
    folder = log.new_folder()
    write_bucketed(events, f"{log.path(folder)}/data")
    written = log.spark.read.schema(f"{_ddl(events)}, bucket int").parquet(f"{log.path(folder)}/data")
    place = F.concat(F.lit("bucket="), F.col("bucket").cast("string"), F.lit("/"), F.col("_metadata.file_name"))
    files = written.groupBy("agent_id", place.alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    files.write.parquet(f"{log.path(folder)}/files")
    rows = log.spark.read.schema(FILES).parquet(f"{log.path(folder)}/files").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Layer(folder, rows, _ddl(events))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _layer_events(log: Layers, layers: list[Layer], files: dict[str, list[str]] | None = None) -> DataFrame:
    """The events of some layers, or of some of their files."""
    out = log.spark.createDataFrame([], EVENT)
    for layer in layers:
        data = f"{log.path(layer)}/data"
        paths = [data] if files is None else [f"{data}/{f}" for f in files.get(layer.folder, [])]
        if paths:
            df = log.spark.read.schema(layer.schema).parquet(*paths)
            out = out.unionByName(df.select(*EVENT_COLUMNS, *[c for c in ("arrival",) if c in df.columns]), allowMissingColumns=True)
    return out


def append_events(events: DataFrame, root: str, batch: str | None = None) -> None:
    """Add events to the store; an empty frame writes nothing.

    A call writes its own events, as a layer, and what it has to fold: small
    layers are joined to larger ones, so their number stays at the logarithm of
    the number of calls.  A caller that names its batch ``<feed>-<number>`` can
    repeat a call: a feed's numbers grow, and a number that is not above the
    feed's last one was added before and adds nothing.
    """
    spark = events.sparkSession
    log = _event_log(spark, root)
    layers, feeds = log.current() or ([], {})
    feed, _, number = (batch or "").rpartition("-")
    if batch is not None and not (feed and number.isdigit()):
        raise ValueError(f"a batch is named <feed>-<number>, not {batch!r}")
    if batch is not None and int(number) <= feeds.get(feed, -1):
        return
    if not events.limit(1).count():
        return
    kept = events.select(*EVENT_COLUMNS, *[c for c in ("arrival",) if c in events.columns])
    layers = [*layers, _write_events(log, kept)]
    while n := to_fold(layers):
        layers = [*layers[:-n], _write_events(log, _layer_events(log, layers[-n:]))]
    log.publish(layers, feeds | ({feed: int(number)} if batch is not None else {}))


def compact_events(spark: SparkSession, root: str) -> None:
    """Fold the store's layers into one for each layout of events."""
    log = _event_log(spark, root)
    layers, feeds = log.current() or ([], {})
    layouts = list(dict.fromkeys(layer.schema for layer in layers))
    if len(layers) > len(layouts):
        log.publish([_write_events(log, _layer_events(log, [x for x in layers if x.schema == layout])) for layout in layouts], feeds)


def event_files(spark: SparkSession, root: str) -> DataFrame:
    """(layer, agent_id, file, rows, first, last): which files of the store hold events of an agent, how many, and of what time."""
    log = _event_log(spark, root)
    layers, _ = log.current() or ([], {})
    out = spark.createDataFrame([], f"layer string, {FILES}")
    for layer in layers:
        out = out.unionByName(spark.read.schema(FILES).parquet(f"{log.path(layer)}/files").withColumn("layer", F.lit(layer.folder)))
    return out


def load_events(spark: SparkSession, root: str, agent_id: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored events, of one agent or of times from ``since`` up to ``until`` (exclusive) if these are given; none if nothing is stored.

    What is asked for is looked up in the table of files: only files that hold
    it are read, and no folder is listed.  An unreadable file is an error.
    """
    log = _event_log(spark, root)
    layers, _ = log.current() or ([], {})
    wanted = {
        "agent": agent_id is not None and (F.col("agent_id") == agent_id, F.col("agent_id") == agent_id),
        "since": since is not None and (F.col("last") >= F.lit(since).cast("timestamp"), F.col("timestamp") >= F.lit(since).cast("timestamp")),
        "until": until is not None and (F.col("first") < F.lit(until).cast("timestamp"), F.col("timestamp") < F.lit(until).cast("timestamp")),
    }
    tests = [x for x in wanted.values() if x]
    if not tests:
        return _layer_events(log, layers)
    of_file, of_event = (reduce(Column.__and__, side) for side in zip(*tests, strict=True))
    files: dict[str, list[str]] = {}
    for row in event_files(spark, root).where(of_file).select("layer", "file").distinct().collect():
        files.setdefault(row.layer, []).append(row.file)
    return _layer_events(log, layers, files).where(of_event)


# --- profiles ---

STATE = "agent_id string, session_id string, tool_name string, call_time timestamp"


TABLES = {**PROFILE_SCHEMAS, "state": STATE}


def _profile_log(spark: SparkSession, root: str) -> Layers:
    return Layers(spark, f"{root}/profiles")


def _tables(log: Layers, layers: list[Layer], condition: Column | None = None, agents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of some layers, as functions: of every agent the rows of the newest layer that holds it.

    ``condition`` is on agent_id and bucket and reaches the scans.
    """

    def rows(table: str, columns: str | None = None) -> DataFrame:
        out = None
        for k, layer in enumerate(layers):
            df = log.spark.read.schema(f"{TABLES[table]}, bucket int").parquet(f"{log.path(layer)}/{table}")
            df = df if condition is None else df.where(condition)
            df = df.select(columns or "*").withColumn("_layer", F.lit(k))
            out = df if out is None else out.unionByName(df)
        return out

    def merged(table: str) -> DataFrame:
        out = rows(table)
        if len(layers) > 1:
            newest = rows("agent", "agent_id").where("_layer > 0").groupBy("agent_id").agg(F.max("_layer").alias("_newest"))
            out = out.join(newest, "agent_id", "left").where(F.col("_layer") == F.coalesce("_newest", F.lit(0))).drop("_newest")
        out = out.drop("_layer", "bucket")
        return out if agents is None else out.join(agents, "agent_id", "left_semi")

    return {name: (lambda name=name: merged(name)) for name in TABLES}


def _write_profile(log: Layers, tables: dict[str, DataFrame]) -> Layer:
    folder = log.new_folder()
    for name, df in tables.items():
        write_bucketed(df, f"{log.path(folder)}/{name}")
    counts = [log.spark.read.schema(f"{schema}, bucket int").parquet(f"{log.path(folder)}/{name}").select(F.lit(1).alias("x")) for name, schema in TABLES.items()]
    return Layer(folder, reduce(DataFrame.union, counts).count())


def save_profile(profile: Profile, root: str, state: DataFrame | None = None) -> None:
    """Replace the profiles of the agents in ``profile``; other agents' stay and are not touched.

    A call writes the rows of its own agents, as a layer with all seven tables
    and, for streams, the agents' last calls; readers take every agent from the
    newest layer that holds it, and small layers are folded (``to_fold``).  All
    of it counts from one moment on, when the list of layers is put in place.
    """
    spark = profile.agent.sparkSession
    log = _profile_log(spark, root)
    layers, feeds = log.current() or ([], {})
    agents = stage(profile.agent.select("agent_id").distinct())
    state = spark.createDataFrame([], STATE) if state is None else state.join(agents, "agent_id", "left_semi")
    layers = [*layers, _write_profile(log, {**profile.tables(), "state": state})]
    while n := to_fold(layers):
        layers = [*layers[:-n], _write_profile(log, {k: make() for k, make in _tables(log, layers[-n:]).items()})]
    log.publish(layers, feeds)


def compact_profiles(spark: SparkSession, root: str) -> None:
    """Fold all layers of the profile store into one; readers that use the old ones can go on."""
    log = _profile_log(spark, root)
    layers, feeds = log.current() or ([], {})
    if len(layers) > 1:
        log.publish([_write_profile(log, {k: make() for k, make in _tables(log, layers).items()})], feeds)


def _loaded(spark: SparkSession, root: str, agent_id: str | None, agents: DataFrame | None) -> dict[str, Callable[[], DataFrame]] | None:
    log = _profile_log(spark, root)
    layers, _ = log.current() or ([], {})
    if not layers:
        return None
    condition = None
    if agent_id is not None:
        condition = (F.col("bucket") == bucket(F.lit(agent_id))) & (F.col("agent_id") == agent_id)
    elif agents is not None:  # there are few buckets
        found = [r.b for r in agents.select(bucket(F.col("agent_id")).alias("b")).distinct().collect()]
        condition = F.col("bucket").isin(found) if len(found) < BUCKETS else None
    return _tables(log, layers, condition, agents)


def load_state(spark: SparkSession, root: str, agents: DataFrame | None = None) -> DataFrame | None:
    """The agents' last calls that were published with the current profile; None if there is none."""
    tables = _loaded(spark, root, None, agents)
    return None if tables is None else tables["state"]()


def load_profile(spark: SparkSession, root: str, agent_id: str | None = None, on_corrupt: str = "fail", agents: DataFrame | None = None) -> Profile | None:
    """The stored profile, None if there is none; ``on_corrupt="fresh"`` treats an unreadable one as none.

    ``agent_id`` or a frame of ``agents`` (agent_id) restricts it to these; folders of other buckets are not read.
    """
    try:
        tables = _loaded(spark, root, agent_id, agents)
        if tables is None:
            return None
        out = Profile(**{name: tables[name] for name in PROFILE_SCHEMAS})
        if on_corrupt == "fresh":
            for df in out.tables().values():
                df.write.format("noop").mode("overwrite").save()
    except Exception:
        if on_corrupt == "fresh":
            return None
        raise
    return out


def list_agents(spark: SparkSession, root: str) -> DataFrame:
    """Sorted ids of the agents with events or a profile; of the events, only the table of files is read."""
    found = event_files(spark, root).select("agent_id")
    profile = load_profile(spark, root)
    if profile is not None:
        found = found.unionByName(profile.agent.select("agent_id"))
    return found.distinct().orderBy("agent_id")


def publish(events: DataFrame, profile: Profile, root: str) -> None:
    """Store accepted events and the profile built from them; the profile's marks make a repeated run add nothing."""
    append_events(events, root)
    save_profile(profile, root)


