"""Record layouts of the library."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = ["ToolCall", "ToolResult", "UserMessage", "AgentMessage", "Error"]  # fixed values

EVENT_FIELDS = [
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("param_keys", T.ArrayType(T.StringType())),
    T.StructField("resource_ids", T.ArrayType(T.StringType())),
    T.StructField("data_in_bytes", T.LongType()),
    T.StructField("data_out_bytes", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("token_count", T.LongType()),
    T.StructField("sequence_position", T.LongType()),
]
EVENT = T.StructType(EVENT_FIELDS)
EVENT_COLUMNS = EVENT.fieldNames()
OPTIONAL = ("tool_name", "token_count")

#: Events with the technical column that gives their total order of arrival.
ORDERED_EVENT = T.StructType([*EVENT_FIELDS, T.StructField("arrival", T.LongType())])

#: The profile of many agents: seven normalised tables and their keys.
PROFILE_KEYS = {
    "agent": ["agent_id"],
    "tool": ["agent_id", "tool_name"],
    "param_set": ["agent_id", "tool_name", "param_keys"],
    "bigram": ["agent_id", "first", "second"],
    "resource": ["agent_id", "resource_id"],
    "hour": ["agent_id", "hour"],
    "hwm": ["agent_id", "session_id"],
}
PROFILE_SCHEMAS = {
    "agent": "agent_id string, session_count long, event_count long, first_seen timestamp, last_updated timestamp, "
    "rate_count long, rate_mean double, rate_m2 double",
    "tool": "agent_id string, tool_name string, call_count long, first_seen timestamp, last_seen timestamp, "
    "vol_count long, vol_mean double, vol_m2 double",
    "param_set": "agent_id string, tool_name string, param_keys array<string>",
    "bigram": "agent_id string, first string, second string, n long",
    "resource": "agent_id string, resource_id string",
    "hour": "agent_id string, hour int, n long",
    "hwm": "agent_id string, session_id string, hwm long, seen timestamp",
}
