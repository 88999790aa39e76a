"""Adapter: the given ``events`` and ``conversations`` tables as behavioural events and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductlens.schemas import ORDERED_EVENT

SCORE_FROM = "2024-01-21"
PART_2_FROM = "2024-01-11"
REPLAY_SHIFT = 1_000_000


def behaviour_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` mapped to behavioural events; two sessions of an agent interleave each day."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    agent = F.concat(F.lit("agent-"), (F.col("user_id") % 4).cast("string"))
    df = raw.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value", k.alias("k")).select(
        "*",
        agent.alias("agent_id"),
        F.concat(agent, F.lit("/"), F.date_format("timestamp", "yyyy-MM-dd"), F.lit("/"), (F.floor(F.col("user_id") / 4) % 2).cast("string")).alias("session_id"),
    )
    kind = F.when(F.col("event_type") == "signup", "UserMessage").when(F.col("event_type") != "error", "ToolCall").when(F.col("k") % 2 == 0, "Error").otherwise("ToolResult")
    tool = (
        F.when((F.col("event_type") == "signup") | (F.col("k") == 97), F.lit(None).cast("string"))
        .when(F.col("k") % 50 == 49, F.concat(F.lit("rare_"), F.col("k").cast("string"), F.lit("_"), (F.col("user_id") % 7).cast("string")))
        .otherwise(F.concat("event_type", F.lit("_"), (F.col("k") % 3).cast("string")))
    )
    none = F.array().cast("array<string>")
    place = F.row_number().over(_session()).cast("long")
    out = df.select(
        "timestamp",
        "session_id",
        "agent_id",
        kind.alias("event_type"),
        tool.alias("tool_name"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("k"), F.lit("a"))).otherwise(F.array(F.lit("k"))).alias("param_keys"),
        F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("/k/"), F.col("k").cast("string")))).otherwise(none).alias("resource_ids"),
        F.round(F.col("value") * 100).cast("long").alias("data_in_bytes"),
        (F.col("k") * 10).cast("long").alias("data_out_bytes"),
        F.lit(0).cast("long").alias("duration_ms"),
        F.when(kind == "ToolCall", F.col("k")).cast("long").alias("token_count"),
        place.alias("sequence_position"),
        F.col("event_id").cast("long").alias("arrival"),
    )
    return out.select(*ORDERED_EVENT.fieldNames())


def _session():
    from pyspark.sql.window import Window

    return Window.partitionBy("agent_id", "session_id").orderBy("event_id")


def replays(events: DataFrame) -> DataFrame:
    """Every tenth event, to arrive after all others."""
    return events.where(F.col("arrival") % 10 == 0).withColumn("arrival", F.col("arrival") + REPLAY_SHIFT)


def with_replays(events: DataFrame) -> DataFrame:
    return events.unionByName(replays(events))


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, score)."""
    at = F.lit(SCORE_FROM).cast("timestamp")
    return events.where(F.col("timestamp") < at), events.where(F.col("timestamp") >= at)


def halves(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = F.lit(PART_2_FROM).cast("timestamp")
    return train.where(F.col("timestamp") < at), train.where(F.col("timestamp") >= at)


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as transcript lines (file, line_no, value).

    One file per conversation: a session line (none where conv_id % 10 = 9),
    one message line per turn, an assistant's every fourth turn with tool calls
    and a tool result line after it, and a garbage line where conv_id % 7 = 3.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn = F.col("conv_id"), F.col("turn")
    time = lambda seconds: F.date_format(
        F.timestamp_seconds(F.lit(1767225600) + conv * 60 + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    quoted = F.expr("substring(to_json(array(text)), 2, char_length(to_json(array(text))) - 2)")
    text_block = F.concat(F.lit('{"type":"text","text":'), quoted, F.lit("}"))
    call = lambda name: F.concat(
        F.lit('{"type":"toolCall","name":"' + name + '","arguments":{"path":"/c/'), conv.cast("string"), F.lit('","n":'), turn.cast("string"), F.lit("}}")
    )
    calls = F.when(turn % 8 == 7, F.concat(F.lit(","), call("read"), F.lit(","), call("write"))).otherwise(F.concat(F.lit(","), call("read")))
    message = lambda role, content, extra: F.concat(
        F.lit('{"type":"message","timestamp":"'), time(turn), F.lit('","message":{"role":"' + role + '","content":'), content, extra, F.lit("}}")
    )
    usage = F.concat(F.lit(',"usage":{"totalTokens":'), (conv % 100 + turn).cast("string"), F.lit("}"))
    none = F.lit("")
    line = (
        F.when(F.col("role") == "user", message("user", quoted, none))
        .when(
            F.col("role") == "assistant",
            message("assistant", F.concat(F.lit("["), text_block, F.when(turn % 4 == 3, calls).otherwise(none), F.lit("]")), usage),
        )
        .otherwise(message("system", quoted, none))
    )
    result = message("toolResult", quoted, F.lit(',"toolName":"read","isError":false'))
    entries = F.array_compact(
        F.array(
            F.struct((turn * 10 + 1).alias("line_no"), line.alias("value")),
            F.when((F.col("role") == "assistant") & (turn % 4 == 3), F.struct((turn * 10 + 2).alias("line_no"), result.alias("value"))),
            F.when((conv % 7 == 3) & (turn == 1), F.struct((turn * 10 + 3).alias("line_no"), F.lit("{garbage").alias("value"))),
            F.when((turn == 0) & (conv % 10 != 9), F.struct(F.lit(0).cast("long").alias("line_no"), F.concat(F.lit('{"type":"session","id":"conv-'), conv.cast("string"), F.lit('"}')).alias("value"))),
        )
    )
    return c.select(F.lpad(conv.cast("string"), 12, "0").alias("file"), F.inline(entries))


def write_transcripts(lines: DataFrame, folder: str) -> str:
    """Transcript lines as .jsonl files of many conversations each, in their order."""
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "file").sortWithinPartitions("file", "line_no").select("value").write.text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(path):  # one file for each partition
        name = s.getPath().getName()
        if name.startswith("part-"):
            fs.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name[5:10]}.jsonl"))
    return folder


def agent_folders(lines: DataFrame) -> DataFrame:
    """The conversations' files dealt to the folders of five agents."""
    agent = (F.col("file").cast("long") % 5).cast("string")
    return lines.withColumn("file", F.concat(F.lit("/data/agents/talker-"), agent, F.lit("/sessions/"), "file"))


def spoiled(events: DataFrame, to_json) -> DataFrame:
    """Events as JSON lines; where arrival ends in 3 a line is cut off after 40 characters, where it ends in 7 it is blank."""
    good, bad, blank = (to_json(events.where(c)) for c in ("arrival % 10 not in (3, 7)", "arrival % 10 = 3", "arrival % 10 = 7"))
    return good.unionByName(bad.select(F.substring("value", 1, 40).alias("value"))).unionByName(blank.select(F.lit("  ").alias("value")))
