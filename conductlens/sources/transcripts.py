"""Agent transcripts: reading lines and parsing them to behavioural events.

A line is decoded once, to a small struct (what kind of line, role, sizes,
calls): in the JVM where its parser reads the line as strictly as the format asks
for, else in Arrow batches.  What depends on the order of lines is a segmented
scan, so a large file is many tasks, and the state that the parser carries from
file to file is one row per file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.functions.staging import Running, ranged, scan, stage
from conductlens.functions.text import RESOURCE, Repeated, absent, compact_size, kind_of, looks_like_resource, plain_json, plain_numbers, strict_json, variant_size
from conductlens.schemas import EVENT_COLUMNS

CALL = "struct<event_type:string,tool_name:string,param_keys:array<string>,resource_ids:array<string>,data_in_bytes:long,data_out_bytes:long,token_count:long>"
OTHER = f"error string, kind string, id string, time string, events array<{CALL}>"
LINE = f"struct<kind:string,id:string,time:string,events:array<{CALL}>>"
MOST = (1 << 63) - 1
DEFAULT_AGENT = "openclaw"  # fixed value: the id that events get when none is named


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, line_no, value) of a file, or of the files of a folder (or of all folders that a pattern names) that end in .jsonl.

    A missing path is an error; a folder without such files gives no rows.
    Large files are split: lines are numbered by the block they are in and
    their place in it.  Blank lines are skipped.  Spark does not read files
    whose names begin with an underscore or a dot.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    if not found:
        raise FileNotFoundError(path)
    folders = [s.getPath() for s in found if s.isDirectory()]
    names = [s.getPath().getName() for f in folders for s in fs.listStatus(f)]
    if folders and not any(n.endswith(".jsonl") and n[0] not in "._" for n in names):
        return spark.createDataFrame([], "file string, line_no long, value string")
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter="*.jsonl" if folders else None).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value"
    )
    # a block is read by one task in order: lines of earlier blocks, which are one row a block, plus the place in the block
    blocks = lines.groupBy("file", "start").agg(F.min("row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_row")).alias("_from"))
    place = F.col("row") + F.col("_from")
    clean = F.regexp_replace("value", "\r$", "")
    return lines.join(blocks, ["file", "start"]).select("file", place.cast("long").alias("line_no"), clean.alias("value")).where(F.trim("value") != "")


class Rejected(ValueError):
    """The line does not fit the layout of transcript lines."""


def _field(owner: Repeated, name: str, kind: type, required: bool = False):
    value = owner.get(name)
    if name in owner.twice:
        raise Rejected(f"{name} is there twice")
    if value is None:
        if required:
            raise Rejected(f"{name} is missing")
        return None
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise Rejected(f"{name} has the wrong type")
    return value


def decode_line(line: str) -> tuple[str, str | None, str | None, list[tuple]]:
    """(kind, id, time, events) of one line; ValueError if it is rejected."""
    raw = strict_json(line)
    if not isinstance(raw, Repeated):
        raise Rejected("not an object")
    kind = _field(raw, "type", str, required=True)
    ident, time, message = _field(raw, "id", str), _field(raw, "timestamp", str), _field(raw, "message", Repeated)
    events: list[tuple] = []
    if message is not None:
        role = _field(message, "role", str, required=True)
        tool, usage, failed = _field(message, "toolName", str), _field(message, "usage", Repeated), _field(message, "isError", bool)
        if "content" in message.twice:
            raise Rejected("content is there twice")
        content = message.get("content")
        tokens = _field(usage, "totalTokens", int) if usage is not None else None
        if tokens is not None and not 0 <= tokens <= MOST:
            raise Rejected("totalTokens is out of range")
        if kind == "message":
            events = _events(role, content, tool, failed, tokens)
    return kind, ident, time, events


def _events(role: str, content, tool: str | None, failed: bool | None, tokens: int | None) -> list[tuple]:
    size = 0 if content is None else compact_size(content)
    if role == "user":
        return [("UserMessage", None, [], [], size, 0, None)]
    if role == "toolResult":
        return [("Error" if failed else "ToolResult", tool, [], [], 0, size, None)]
    if role != "assistant" or not isinstance(content, list):
        return []
    blocks = [b for b in content if isinstance(b, dict) and isinstance(b.get("type"), str)]
    calls = [_call(b, tokens) for b in blocks if b["type"] == "toolCall"]
    if not calls and any(b["type"] == "text" for b in blocks):
        return [("AgentMessage", None, [], [], 0, size, tokens)]
    return calls


def _call(block: dict, tokens: int | None) -> tuple:
    name, arguments = block.get("name"), block.get("arguments")
    name = name if isinstance(name, str) else None
    if not isinstance(arguments, dict):
        return ("ToolCall", name, [], [], 0, 0, tokens)
    keys = sorted(arguments, key=str.encode)
    texts = [arguments[k] for k in keys if isinstance(arguments[k], str)]
    return ("ToolCall", name, keys, [t for t in texts if looks_like_resource(t)], compact_size(arguments), 0, tokens)


FIELDS = ("event_type", "tool_name", "param_keys", "resource_ids", "data_in_bytes", "data_out_bytes", "token_count")


def _decode(values: pd.Series) -> pd.DataFrame:
    """``decode_line`` of the lines that are given, and its error; of others nothing."""
    rows = []
    for line in values:
        if line is None:
            rows.append((None, None, None, None, None))
            continue
        try:
            kind, ident, time, events = decode_line(line)
            rows.append((None, kind, ident, time, [dict(zip(FIELDS, e, strict=True)) for e in events]))
        except (ValueError, RecursionError) as why:
            rows.append((str(why)[:200], None, None, None, []))
    return pd.DataFrame(rows, columns=["error", "kind", "id", "time", "events"])


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _none() -> Column:
    return F.array().cast("array<string>")


def _event(kind, tool, keys, resources, size_in, size_out, tokens) -> Column:
    values = (kind, tool, keys, resources, size_in, size_out, tokens)
    return F.struct(*[v.alias(f) for v, f in zip(values, FIELDS, strict=True)]).cast(CALL)


def _plain_call(block: Column, tokens: Column) -> Column:
    """``_call`` in the JVM."""
    arguments = F.try_variant_get(block, "$.arguments", "map<string,variant>")
    keys = F.array_sort(F.map_keys(arguments))
    texts = F.transform(keys, lambda k: F.when(F.schema_of_variant(arguments[k]) == "STRING", _text(arguments[k], "$")))
    resources = F.filter(texts, lambda t: t.rlike(f"^({RESOURCE.pattern})"))
    name = F.when(kind_of(block, "$.name") == "STRING", _text(block, "$.name"))
    size = F.when(arguments.isNotNull(), variant_size(F.try_variant_get(block, "$.arguments", "variant"))).otherwise(0)
    return _event(F.lit("ToolCall"), name, F.coalesce(keys, _none()), F.coalesce(resources, _none()), size, F.lit(0), tokens)


def plain_line(v: Column) -> Column:
    """What ``decode_line`` gives for a line, of its VARIANT; null where a field is not of its type."""
    optional = lambda path, kind: absent(v, path) | (kind_of(v, path) == kind)
    is_object = lambda path: F.try_variant_get(v, path, "map<string,variant>").isNotNull()
    tokens = F.try_variant_get(v, "$.message.usage.totalTokens", "long")
    message = (
        is_object("$.message") & (kind_of(v, "$.message.role") == "STRING") & optional("$.message.toolName", "STRING") & optional("$.message.isError", "BOOLEAN")
        & (absent(v, "$.message.usage") | is_object("$.message.usage")) & optional("$.message.usage.totalTokens", "BIGINT") & (F.coalesce(tokens, F.lit(0)) >= 0)
    )
    fits = (kind_of(v, "$.type") == "STRING") & optional("$.id", "STRING") & optional("$.timestamp", "STRING") & (absent(v, "$.message") | message)

    content = F.try_variant_get(v, "$.message.content", "variant")
    size, nothing, none = variant_size(content), F.lit(None), _none()
    blocks = F.filter(F.try_variant_get(v, "$.message.content", "array<variant>"), lambda b: kind_of(b, "$.type") == "STRING")
    calls = F.transform(F.filter(blocks, lambda b: _text(b, "$.type") == "toolCall"), lambda b: _plain_call(b, tokens))
    role, failed = _text(v, "$.message.role"), F.coalesce(F.try_variant_get(v, "$.message.isError", "boolean"), F.lit(False))
    events = (
        F.when(role == "user", F.array(_event(F.lit("UserMessage"), nothing, none, none, size, F.lit(0), nothing)))
        .when(role == "toolResult", F.array(_event(F.when(failed, "Error").otherwise("ToolResult"), _text(v, "$.message.toolName"), none, none, F.lit(0), size, nothing)))
        .when((role == "assistant") & (F.size(calls) > 0), calls)
        .when((role == "assistant") & F.exists(blocks, lambda b: _text(b, "$.type") == "text"), F.array(_event(F.lit("AgentMessage"), nothing, none, none, F.lit(0), size, tokens)))
    )
    spoken = (_text(v, "$.type") == "message") & ~absent(v, "$.message")
    line = F.struct(
        _text(v, "$.type").alias("kind"), _text(v, "$.id").alias("id"), _text(v, "$.timestamp").alias("time"),
        F.coalesce(F.when(spoken, events), F.array().cast(f"array<{CALL}>")).alias("events"),
    )
    return F.when(fits, line.cast(LINE))


def decode_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded, rejects) of lines (file, line_no, value); Python gets only the lines that the JVM does not read strictly."""
    read = lines.select("file", "line_no", "value", F.when(plain_numbers(F.col("value")), plain_json(F.col("value"))).alias("v"))
    read = read.select("file", "line_no", "value", plain_line(F.col("v")).alias("line")).withColumn("value", F.when(F.col("line").isNull(), F.col("value")))
    # the text of a line that is decoded is not carried on
    read = stage(read.withColumn("other", F.pandas_udf(_decode, OTHER)("value")))
    good = read.where("value is null or other.error is null")
    decoded = good.select("file", "line_no", *[F.coalesce(f"line.{c}", f"other.{c}").alias(c) for c in ("kind", "id", "time", "events")])
    return decoded, read.where("other.error is not null").select("file", "line_no", "value", F.col("other.error").alias("error"))


def parse_transcripts(
    lines: DataFrame, agent_id: str = DEFAULT_AGENT, ingest_time: str = "1970-01-01 00:00:00", carry_over: bool = True, agent_pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(events with arrival, rejects) of transcript lines.

    Files follow each other in the order of their names.  With ``carry_over``
    the session and position at the end of a file go on into the next one.
    A missing or unreadable time becomes ``ingest_time``.  ``agent_pattern`` is
    a pattern whose first group takes the agent's id from a file's path, such as
    ``/agents/([^/]+)/sessions/``; files that it does not fit get ``agent_id``,
    and only files of the same agent follow each other.
    """
    agent = F.lit(agent_id)
    if agent_pattern is not None:
        agent = F.coalesce(F.nullif(F.regexp_extract("file", agent_pattern, 1), F.lit("")), agent)
    decoded, rejects = decode_lines(lines)
    done = ranged(decoded.withColumn("n_events", F.size("events").cast("long")), ["file", "line_no"])
    opens = F.col("kind") == "session"
    # narrow rows: the session's number and name, and the events of the file before the line, then those before its session
    first = scan(
        done.select("_part", "_at", "file", "kind", "id", "n_events"),
        ["file"],
        {"segment": Running("sum", opens.cast("long"), own=True), "named": Running("last", F.when(opens, F.col("id")), own=True), "so_far": Running("sum", F.col("n_events"))},
    )
    second = scan(stage(first), ["file"], {"opened": Running("last", F.when(opens, F.col("so_far")), own=True)})
    rows = stage(second.select("_at", "file", "segment", "named", "n_events", (F.col("so_far") - F.coalesce("opened", F.lit(0))).alias("before")))
    # the state at the end of each file: one row per file
    ends = rows.groupBy("file").agg(
        F.max("segment").alias("segments"), F.max_by("named", "_at").alias("end_named"), F.max_by(F.col("before") + F.col("n_events"), "_at").alias("tail")
    )
    # positions add up over files without a session line, from the last file of the agent that has one
    placed = ranged(ends.withColumn("agent_id", agent), ["agent_id", "file"])
    summed = scan(placed, ["agent_id"], {"through": Running("sum", F.col("tail"))})
    carried = scan(summed, ["agent_id"], {"start_named": Running("last", F.col("end_named")), "base": Running("last", F.when(F.col("segments") > 0, F.col("through")))})
    carried = carried.select("file", "start_named", (F.col("through") - F.coalesce("base", F.lit(0))).alias("offset"))
    spoken = done.where("n_events > 0").select("_at", "line_no", "time", "events")
    joined = rows.drop("n_events").join(carried, "file").join(spoken, "_at")
    lead = (F.col("segment") == 0) & F.lit(carry_over)
    joined = joined.select(
        "file",
        "line_no",
        "time",
        F.coalesce("named", F.when(F.lit(carry_over), F.col("start_named")), F.lit("")).alias("session_id"),
        (F.col("before") + F.when(lead, F.col("offset")).otherwise(0)).alias("before"),
        F.posexplode("events").alias("block", "e"),
    )
    stamp = F.when(F.col("time").rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"), F.expr("try_cast(upper(time) AS timestamp)"))
    events = joined.select(
        F.coalesce(stamp, F.lit(ingest_time).cast("timestamp")).alias("timestamp"),
        "session_id",
        agent.alias("agent_id"),
        *[F.col(f"e.{c}").alias(c) for c in FIELDS],
        F.lit(0).cast("long").alias("duration_ms"),
        (F.col("before") + F.col("block") + 1).cast("long").alias("sequence_position"),
        "file",
        "line_no",
        "block",
    )
    return events.select(*EVENT_COLUMNS, F.struct("file", "line_no", "block").alias("arrival")), rejects


def transcript_totals(lines: DataFrame) -> DataFrame:
    """(metric, n): files, events and rejected lines, from one decoding of the lines; a file counts by any of its lines."""
    decoded, rejects = decode_lines(lines)
    one = decoded.select("file", F.size("events").cast("long").alias("events"), F.lit(0).cast("long").alias("rejected_lines"))
    one = one.unionByName(rejects.select("file", F.lit(0).cast("long").alias("events"), F.lit(1).cast("long").alias("rejected_lines")))
    files = one.groupBy("file").agg(F.sum("events").alias("events"), F.sum("rejected_lines").alias("rejected_lines"))
    sums = files.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "rejected_lines")])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in sums.columns])))
