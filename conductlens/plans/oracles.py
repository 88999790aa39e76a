"""The registered queries as DuckDB SQL on the same tables, written from the definitions, not from the Spark plans."""

from __future__ import annotations

#: ``events`` as behavioural events (see fixtures.behaviour_events)
EVENTS = """
raw AS (
  SELECT event_id, user_id, ts, event_type AS kind, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
), named AS (
  SELECT *, 'agent-' || CAST(user_id % 4 AS VARCHAR) AS agent_id,
    'agent-' || CAST(user_id % 4 AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') || '/' || CAST((user_id // 4) % 2 AS VARCHAR) AS session_id
  FROM raw
), ev AS (
  SELECT event_id AS arrival, ts AS timestamp, agent_id, session_id,
    CASE WHEN kind = 'signup' THEN 'UserMessage' WHEN kind <> 'error' THEN 'ToolCall' WHEN k % 2 = 0 THEN 'Error' ELSE 'ToolResult' END AS event_type,
    CASE WHEN kind = 'signup' OR k = 97 THEN NULL
      WHEN k % 50 = 49 THEN 'rare_' || CAST(k AS VARCHAR) || '_' || CAST(user_id % 7 AS VARCHAR)
      ELSE kind || '_' || CAST(k % 3 AS VARCHAR) END AS tool_name,
    CASE WHEN k % 2 = 0 THEN ['k', 'a'] ELSE ['k'] END AS param_keys,
    CASE WHEN k % 5 = 0 THEN ['/k/' || CAST(k AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS resource_ids,
    CAST(round(value * 100) AS BIGINT) AS data_in_bytes, CAST(k * 10 AS BIGINT) AS data_out_bytes, k,
    row_number() OVER (PARTITION BY agent_id, session_id ORDER BY event_id) AS sequence_position
  FROM named
)"""
TRAIN = EVENTS + ", train AS (SELECT * FROM ev WHERE timestamp < TIMESTAMP '2024-01-21')"


def runs_of(source: str, name: str, scope: str = "agent_id") -> str:
    """Runs by a change of session in the scope's order of arrival."""
    part = f"PARTITION BY {scope} " if scope else ""
    order = f"OVER ({part}ORDER BY arrival)"
    return f"""
{name}_new AS (
  SELECT *, CASE WHEN lag(session_id) {order} IS NOT DISTINCT FROM session_id AND row_number() {order} > 1 THEN 0 ELSE 1 END AS is_new FROM {source}
), {name} AS (SELECT *, sum(is_new) {order} AS run FROM {name}_new)"""


def profile_of(source: str, p: str = "") -> str:
    """Tables {p}agent, {p}tool, {p}bigram of a source of accepted events."""
    moments = lambda x, n: (
        f"count({x}) AS {n}_count, coalesce(avg({x}), 0.0) AS {n}_mean, coalesce(var_pop({x}) * count({x}), 0.0) AS {n}_m2"
    )
    return f"""
{runs_of(source, p + "runs")}, {p}calls AS (
  SELECT *, coalesce(tool_name, 'unknown') AS tool,
    lag(coalesce(tool_name, 'unknown')) OVER w AS before,
    (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) // 1000 AS ms
  FROM {p}runs WHERE event_type = 'ToolCall'
  WINDOW w AS (PARTITION BY agent_id, run ORDER BY arrival)
), {p}rated AS (SELECT *, CASE WHEN ms > 0 THEN 60000.0 / ms END AS rate, CAST(data_in_bytes + data_out_bytes AS DOUBLE) AS volume FROM {p}calls),
{p}agent AS (
  SELECT a.*, coalesce(r.rate_count, 0) AS rate_count, coalesce(r.rate_mean, 0.0) AS rate_mean, coalesce(r.rate_m2, 0.0) AS rate_m2 FROM (
    SELECT agent_id, CAST(sum(is_new) AS BIGINT) AS session_count, count(*) AS event_count,
      arg_min(timestamp, arrival) AS first_seen, arg_max(timestamp, arrival) AS last_updated FROM {p}runs GROUP BY agent_id) a
  LEFT JOIN (SELECT agent_id, {moments("rate", "rate")} FROM {p}rated GROUP BY agent_id) r USING (agent_id)
), {p}tool AS (
  SELECT agent_id, tool AS tool_name, count(*) AS call_count, arg_min(timestamp, arrival) AS first_seen,
    arg_max(timestamp, arrival) AS last_seen, {moments("volume", "vol")} FROM {p}rated GROUP BY agent_id, tool
), {p}bigram AS (
  SELECT agent_id, before AS first, tool AS second, count(*) AS n FROM {p}rated WHERE before IS NOT NULL GROUP BY agent_id, before, tool
)"""


TRAINED = TRAIN + "," + profile_of("train")
ROUNDED_AGENT = (
    "agent_id, session_count, event_count, first_seen, last_updated, rate_count, round(rate_mean, 4) AS rate_mean, round(rate_m2, 4) AS rate_m2"
)
ROUNDED_TOOL = "agent_id, tool_name, call_count, first_seen, last_seen, vol_count, round(vol_mean, 4) AS vol_mean, round(vol_m2, 4) AS vol_m2"
SCORE = TRAINED + ", score AS (SELECT * FROM ev WHERE timestamp >= TIMESTAMP '2024-01-21')"
SHOWN = (
    "agent_id, session_id, sequence_position, arrival, tool_name, anomaly_type, severity, round(z, 4) AS z_score, "
    "least(event_count / 100.0, 1.0)::DOUBLE AS confidence, round(observed, 4) AS observed_num, round(base, 4) AS baseline_mean"
)


def spread(n: str, m2: str) -> str:
    return f"nullif(CASE WHEN {n} < 2 THEN 0.0 ELSE sqrt({m2} / ({n} - 1)) END, 0.0)"


KNOWN = """, u_tool AS (
  SELECT s.*, a.event_count, 'UnknownTool' AS anomaly_type, 'High' AS severity, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS observed,
    CAST(NULL AS DOUBLE) AS base, 0 AS detector
  FROM score s JOIN agent a USING (agent_id) WHERE s.event_type = 'ToolCall' AND s.tool_name IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM tool t WHERE t.agent_id = s.agent_id AND t.tool_name = s.tool_name)
)"""


def sequences(scope: str = "agent_id") -> str:
    part = "agent_id, " if scope else ""
    return f""", named_calls AS (SELECT s.* FROM score s JOIN agent USING (agent_id) WHERE s.event_type = 'ToolCall' AND s.tool_name IS NOT NULL),
{runs_of("named_calls", "nruns", scope)}, pairs AS (
  SELECT *, lag(tool_name) OVER (PARTITION BY {part}run ORDER BY arrival) AS prev FROM nruns
), u_pair AS (
  SELECT p.*, a.event_count, 'UnknownSequence' AS anomaly_type, 'Medium' AS severity, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS observed,
    CAST(NULL AS DOUBLE) AS base, 1 AS detector
  FROM pairs p JOIN agent a USING (agent_id) WHERE prev IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM bigram b WHERE b.agent_id = p.agent_id AND b.first = p.prev AND b.second = p.tool_name)
)"""


def rates(scope: str = "agent_id") -> str:
    part = "agent_id, " if scope else ""
    return f""", all_calls AS (SELECT s.* FROM score s JOIN agent USING (agent_id) WHERE s.event_type = 'ToolCall'),
{runs_of("all_calls", "cruns", scope)}, timed AS (
  SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY {part}run ORDER BY arrival))) // 1000 AS ms FROM cruns
), u_rated AS (
  SELECT t.*, a.event_count, 60000.0 / ms AS observed, a.rate_mean AS base, (60000.0 / ms - a.rate_mean) / {spread("a.rate_count", "a.rate_m2")} AS z
  FROM timed t JOIN agent a USING (agent_id) WHERE ms > 0
), u_rate AS (
  SELECT *, 'RateSpike' AS anomaly_type, CASE WHEN z > 5.0 THEN 'High' ELSE 'Medium' END AS severity, 2 AS detector FROM u_rated WHERE z > 3.0
)"""


VOLUMES = f""", u_moved AS (
  SELECT s.*, a.event_count, CAST(s.data_in_bytes + s.data_out_bytes AS DOUBLE) AS observed, t.vol_mean AS base,
    (s.data_in_bytes + s.data_out_bytes - t.vol_mean) / {spread("t.vol_count", "t.vol_m2")} AS z
  FROM score s JOIN agent a USING (agent_id) JOIN tool t ON t.agent_id = s.agent_id AND t.tool_name = s.tool_name WHERE s.event_type = 'ToolCall'
), u_volume AS (
  SELECT *, 'VolumeSpike' AS anomaly_type, CASE WHEN z > 5.0 THEN 'High' ELSE 'Medium' END AS severity, 3 AS detector FROM u_moved WHERE z > 3.0
)"""
ALL_FOUND = SCORE + KNOWN + sequences() + rates() + VOLUMES + ", found AS (" + " UNION ALL ".join(
    f"SELECT {SHOWN}, detector FROM {t}" for t in ("u_tool", "u_pair", "u_rate", "u_volume")
) + ")"

#: ``conversations`` as transcript messages and what they must become
TALK = """
talk AS (
  SELECT conv_id, turn, role, text, lpad(CAST(conv_id AS VARCHAR), 12, '0') AS file,
    TIMESTAMP '2026-01-01' + INTERVAL 1 MINUTE * conv_id + INTERVAL 1 SECOND * turn AS timestamp,
    strlen(CAST(to_json(text) AS VARCHAR)) AS quoted,
    '/c/' || CAST(conv_id AS VARCHAR) AS path,
    role = 'assistant' AND turn % 4 = 3 AS calls
  FROM conversations
), parts AS (
  SELECT *, turn * 10 + 1 AS line_no, 0 AS block, 'UserMessage' AS event_type, CAST(NULL AS VARCHAR) AS tool_name, '' AS param_keys, '' AS resource_ids,
    quoted AS data_in_bytes, 0 AS data_out_bytes, CAST(NULL AS BIGINT) AS token_count FROM talk WHERE role = 'user'
  UNION ALL
  SELECT *, turn * 10 + 1, 0, 'AgentMessage', NULL, '', '', 0, strlen('[{"type":"text","text":}]') + quoted, conv_id % 100 + turn FROM talk WHERE role = 'assistant' AND NOT calls
  UNION ALL
  SELECT talk.*, turn * 10 + 1, b, 'ToolCall', CASE b WHEN 0 THEN 'read' ELSE 'write' END, 'n|path', path,
    strlen('{"path":"","n":}') + strlen(path) + strlen(CAST(turn AS VARCHAR)), 0, conv_id % 100 + turn
  FROM talk, (SELECT 0 AS b UNION ALL SELECT 1) AS two WHERE calls AND (b = 0 OR turn % 8 = 7)
  UNION ALL
  SELECT *, turn * 10 + 2, 0, 'ToolResult', 'read', '', '', 0, quoted, NULL FROM talk WHERE calls
), placed AS (
  SELECT *, CASE WHEN min(turn) OVER (PARTITION BY conv_id) = 0 AND conv_id % 10 <> 9 THEN 1 ELSE 0 END AS opens FROM parts
), opened AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND conv_id % 10 <> 9
), spoken AS (
  SELECT p.*, (SELECT max(o.conv_id) FROM opened o WHERE o.conv_id <= p.conv_id) AS owner FROM parts p
)"""


#: the texts of anomalies at a threshold of 1
AT_ONE = lambda sql: sql.replace("z > 3.0", "z > 1.0").replace("z > 5.0", "z > 3.0")
EVENT_COLUMNS = """timestamp, session_id, agent_id, event_type, tool_name, array_to_string(param_keys, '|') AS param_keys,
  array_to_string(resource_ids, '|') AS resource_ids, data_in_bytes, data_out_bytes, CAST(0 AS BIGINT) AS duration_ms,
  CASE WHEN event_type = 'ToolCall' THEN CAST(k AS BIGINT) END AS token_count, sequence_position"""
LISTS = """, lists AS (SELECT agent_id, array_to_string(list_sort(list(tool_name)), ', ') AS names FROM tool GROUP BY agent_id),
sizes AS (SELECT agent_id, count(*) AS c FROM bigram GROUP BY agent_id)"""
#: (text of the anomaly, of the baseline, of what was observed) by table
SAID = {
    "u_tool": ("'unknown tool: ' || tool_name", "'known tools: [' || coalesce(names, '') || ']'", "tool_name"),
    "u_pair": ("'unseen sequence: ' || prev || '->' || tool_name", "CAST(coalesce(c, 0) AS VARCHAR) || ' known bigrams'", "prev || '->' || tool_name"),
    "u_rate": ("format('rate spike: {:.1f} calls/min (z={:.1f})', observed, z)", "format('{:.1f} calls/min (mean)', base)", "format('{:.1f} calls/min', observed)"),
    "u_volume": ("format('volume spike on {}: {:.0f} bytes (z={:.1f})', tool_name, observed, z)", "format('{:.0f} bytes (mean)', base)", "format('{:.0f} bytes', observed)"),
}


def all_said(columns: str, observed: bool) -> str:
    part = lambda t, d, b, o: f"SELECT {columns}, {d} AS description, {b} AS baseline_value{f', {o} AS observed_value' if observed else ''} FROM {t} LEFT JOIN lists USING (agent_id) LEFT JOIN sizes USING (agent_id)"
    return SCORE + KNOWN + sequences() + rates() + VOLUMES + LISTS + " " + " UNION ALL ".join(part(t, *texts) for t, texts in SAID.items())


def all_sql() -> dict[str, str]:
    shown = lambda t, more="": f"SELECT {SHOWN}{more} FROM {t}"
    tools = "array_to_string(list_sort(list(tool_name)), ', ')"
    return {
        "accepted_events": f"""WITH {EVENTS}, twice AS (
  SELECT * FROM ev UNION ALL SELECT * REPLACE (arrival + 1000000 AS arrival) FROM ev WHERE arrival % 10 = 0
), marked AS (
  SELECT *, max(sequence_position) OVER (PARTITION BY agent_id, session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM twice
) SELECT agent_id, session_id, sequence_position, arrival, timestamp, event_type, tool_name FROM marked WHERE mark IS NULL OR sequence_position > mark""",
        "session_run_sizes": f"""WITH {EVENTS}, {runs_of("ev", "runs")}
SELECT agent_id, session_id, min(arrival) AS first_arrival, max(arrival) AS last_arrival, count(*) AS n FROM runs GROUP BY agent_id, session_id, run""",
        "stream_runs": f"""WITH {EVENTS}, {runs_of("ev", "runs", "")}
SELECT session_id, min(arrival) AS first_arrival, max(arrival) AS last_arrival, count(*) AS n FROM runs GROUP BY session_id, run""",
        "agent_profile": f"WITH {TRAINED} SELECT {ROUNDED_AGENT} FROM agent",
        "hourly_activity": f"WITH {TRAIN} SELECT agent_id, CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS n FROM train GROUP BY ALL",
        "known_resources": f"WITH {TRAIN} SELECT DISTINCT agent_id, unnest(resource_ids) AS resource_id FROM train",
        "tool_profile": f"WITH {TRAINED} SELECT {ROUNDED_TOOL} FROM tool",
        "param_patterns": f"""WITH {TRAIN} SELECT DISTINCT agent_id, coalesce(tool_name, 'unknown') AS tool_name,
  array_to_string(list_sort(param_keys), '|') AS param_keys FROM train WHERE event_type = 'ToolCall'""",
        "tool_bigrams": f"WITH {TRAINED} SELECT * FROM bigram",
        "high_water_marks": f"WITH {TRAIN} SELECT agent_id, session_id, greatest(max(sequence_position), 0) AS hwm FROM train GROUP BY ALL",
        "resumed_profile": f"""WITH {TRAIN}, p1 AS (SELECT * FROM train WHERE timestamp < TIMESTAMP '2024-01-11'),
p2 AS (SELECT * FROM train WHERE timestamp >= TIMESTAMP '2024-01-11'), {profile_of("p1", "a_")}, {profile_of("p2", "b_")},
every AS (SELECT agent_id, rate FROM a_rated UNION ALL SELECT agent_id, rate FROM b_rated),
m AS (SELECT agent_id, count(rate) AS rate_count, coalesce(avg(rate), 0.0) AS rate_mean, coalesce(var_pop(rate) * count(rate), 0.0) AS rate_m2 FROM every GROUP BY agent_id)
SELECT agent_id, coalesce(a.session_count, 0) + coalesce(b.session_count, 0) AS session_count, coalesce(a.event_count, 0) + coalesce(b.event_count, 0) AS event_count,
  coalesce(a.first_seen, b.first_seen) AS first_seen, coalesce(b.last_updated, a.last_updated) AS last_updated,
  coalesce(m.rate_count, 0) AS rate_count, round(coalesce(m.rate_mean, 0.0), 4) AS rate_mean, round(coalesce(m.rate_m2, 0.0), 4) AS rate_m2
FROM a_agent a FULL JOIN b_agent b USING (agent_id) LEFT JOIN m USING (agent_id)""",
        "resumed_tools": f"""WITH {TRAIN} SELECT agent_id, coalesce(tool_name, 'unknown') AS tool_name, count(*) AS call_count,
  arg_min(timestamp, arrival) AS first_seen, arg_max(timestamp, arrival) AS last_seen, count(*) AS vol_count,
  round(avg(CAST(data_in_bytes + data_out_bytes AS DOUBLE)), 4) AS vol_mean,
  round(var_pop(CAST(data_in_bytes + data_out_bytes AS DOUBLE)) * count(*), 4) AS vol_m2
FROM train WHERE event_type = 'ToolCall' GROUP BY ALL""",
        "resumed_bigrams": f"""WITH {TRAIN}, p1 AS (SELECT * FROM train WHERE timestamp < TIMESTAMP '2024-01-11'),
p2 AS (SELECT * FROM train WHERE timestamp >= TIMESTAMP '2024-01-11'), {profile_of("p1", "a_")}, {profile_of("p2", "b_")}
SELECT agent_id, first, second, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a_bigram UNION ALL SELECT * FROM b_bigram) GROUP BY ALL""",
        "unprofiled": f"""WITH {TRAIN} SELECT agent_id, count(*) AS n FROM ev WHERE timestamp >= TIMESTAMP '2024-01-21'
  AND agent_id NOT IN (SELECT agent_id FROM train WHERE agent_id <> 'agent-3') GROUP BY agent_id""",
        "unknown_tool_calls": f"""WITH {SCORE}{KNOWN}, lists AS (SELECT agent_id, {tools} AS names FROM tool GROUP BY agent_id)
SELECT {SHOWN}, 'unknown tool: ' || tool_name AS description, 'known tools: [' || names || ']' AS baseline_value FROM u_tool JOIN lists USING (agent_id)""",
        "unknown_pairs": f"""WITH {SCORE}{sequences()}, sizes AS (SELECT agent_id, count(*) AS c FROM bigram GROUP BY agent_id)
SELECT {SHOWN}, 'unseen sequence: ' || prev || '->' || tool_name AS description, CAST(coalesce(c, 0) AS VARCHAR) || ' known bigrams' AS baseline_value FROM u_pair LEFT JOIN sizes USING (agent_id)""",
        "unknown_pairs_stream": f"""WITH {SCORE}{sequences("")}, sizes AS (SELECT agent_id, count(*) AS c FROM bigram GROUP BY agent_id)
SELECT {SHOWN}, 'unseen sequence: ' || prev || '->' || tool_name AS description, CAST(coalesce(c, 0) AS VARCHAR) || ' known bigrams' AS baseline_value FROM u_pair LEFT JOIN sizes USING (agent_id)""",
        "rate_anomalies": f"WITH {SCORE}{rates()} {shown('u_rate')}",
        "rate_anomalies_stream": f"WITH {SCORE}{rates('')} {shown('u_rate')}",
        "volume_anomalies": f"WITH {SCORE}{VOLUMES} {shown('u_volume')}",
        "anomalies": f"WITH {ALL_FOUND} SELECT * FROM found",
        "anomaly_summary": f"""WITH {ALL_FOUND} SELECT 'events_scanned' AS metric, count(*) AS n FROM score JOIN agent USING (agent_id)
UNION ALL SELECT 'anomalies', count(*) FROM found UNION ALL SELECT anomaly_type, count(*) FROM found GROUP BY anomaly_type""",
        "anomalies_json": f"WITH {ALL_FOUND} SELECT arrival, detector, anomaly_type, session_id, severity FROM found",
        "anomaly_evidence": f"""WITH {ALL_FOUND}, e AS (SELECT {EVENT_COLUMNS}, arrival FROM score),
f AS (SELECT arrival, detector, anomaly_type, severity, z_score, confidence FROM found) SELECT * FROM e JOIN f USING (arrival)""",
        "profile_summary": f"""WITH {TRAINED} SELECT agent_id, session_count, event_count,
  (SELECT count(*) FROM tool t WHERE t.agent_id = a.agent_id) AS n_tools,
  (SELECT count(DISTINCT r) FROM (SELECT agent_id AS g, unnest(resource_ids) AS r FROM train) x WHERE g = a.agent_id) AS n_resources,
  (SELECT count(*) FROM bigram b WHERE b.agent_id = a.agent_id) AS n_bigrams, rate_count, round(rate_mean, 4) AS rate_mean, first_seen, last_updated FROM agent a""",
        "profile_documents": f"WITH {TRAINED} SELECT * FROM bigram",
        "profile_parts": f"""WITH {TRAINED} SELECT 'agent' AS component, agent_id, '' AS item, CAST(event_count AS BIGINT) AS n, round(rate_mean, 4) AS x FROM agent
UNION ALL SELECT 'tool', agent_id, tool_name, call_count, round(vol_mean, 4) FROM tool
UNION ALL SELECT DISTINCT 'param_set', agent_id, coalesce(tool_name, 'unknown') || '|' || array_to_string(list_sort(param_keys), '|'), 1, NULL FROM train WHERE event_type = 'ToolCall'
UNION ALL SELECT 'bigram', agent_id, first || '|' || second, n, NULL FROM bigram
UNION ALL SELECT DISTINCT 'resource', agent_id, r, 1, NULL FROM (SELECT agent_id, unnest(resource_ids) AS r FROM train) x
UNION ALL SELECT 'hour', agent_id, CAST(hour(timestamp) AS VARCHAR), count(*), NULL FROM train GROUP BY ALL
UNION ALL SELECT 'hwm', agent_id, session_id, greatest(max(sequence_position), 0), NULL FROM train GROUP BY ALL""",
        "events_json_roundtrip": f"""WITH {EVENTS} SELECT timestamp, session_id, agent_id, event_type, tool_name, array_to_string(param_keys, '|') AS param_keys,
  array_to_string(resource_ids, '|') AS resource_ids, data_in_bytes, data_out_bytes, CAST(0 AS BIGINT) AS duration_ms,
  CASE WHEN event_type = 'ToolCall' THEN CAST(k AS BIGINT) END AS token_count, sequence_position FROM ev""",
        "transcript_events": f"""WITH {TALK} SELECT timestamp, coalesce('conv-' || CAST(owner AS VARCHAR), '') AS session_id, 'openclaw' AS agent_id,
  event_type, tool_name, param_keys, resource_ids, data_in_bytes, CAST(data_out_bytes AS BIGINT) AS data_out_bytes, CAST(0 AS BIGINT) AS duration_ms, token_count,
  row_number() OVER (PARTITION BY owner ORDER BY conv_id, line_no, block) AS sequence_position, file, line_no, CAST(block AS INTEGER) AS block FROM spoken""",
        "transcript_totals": f"""WITH {TALK} SELECT 'files' AS metric, count(DISTINCT conv_id) AS n FROM conversations
UNION ALL SELECT 'events', count(*) FROM parts UNION ALL SELECT 'rejected_lines', count(*) FROM conversations WHERE conv_id % 7 = 3 AND turn = 1""",
        "transcript_folder": f"""WITH {TALK} SELECT timestamp, coalesce('conv-' || CAST(owner AS VARCHAR), '') AS session_id, 'openclaw' AS agent_id,
  event_type, tool_name, param_keys, resource_ids, data_in_bytes, CAST(data_out_bytes AS BIGINT) AS data_out_bytes, CAST(0 AS BIGINT) AS duration_ms, token_count,
  row_number() OVER (PARTITION BY owner ORDER BY conv_id, line_no, block) AS sequence_position FROM spoken""",
        "transcript_agents": f"""WITH {TALK}, own AS (
  SELECT p.*, p.conv_id % 5 AS a, (SELECT max(o.conv_id) FROM opened o WHERE o.conv_id <= p.conv_id AND o.conv_id % 5 = p.conv_id % 5) AS owner FROM parts p
) SELECT 'talker-' || CAST(a AS VARCHAR) AS agent_id, coalesce('conv-' || CAST(owner AS VARCHAR), '') AS session_id, event_type, tool_name,
  row_number() OVER (PARTITION BY a, owner ORDER BY conv_id, line_no, block) AS sequence_position, line_no, CAST(block AS INTEGER) AS block FROM own""",
        "lenient_events": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM ev WHERE arrival % 10 NOT IN (3, 7)",
        "lenient_rejects": "SELECT CAST(40 AS INTEGER) AS length, count(*) AS n FROM events WHERE event_id % 10 = 3 HAVING count(*) > 0",
        "stored_events": f"WITH {TRAIN} SELECT {EVENT_COLUMNS}, arrival FROM train",
        "stored_agents": f"WITH {TRAIN} SELECT DISTINCT agent_id FROM train",
        "stored_profile": f"""WITH {TRAIN} SELECT agent_id, coalesce(tool_name, 'unknown') AS tool_name, count(*) AS call_count,
  arg_min(timestamp, arrival) AS first_seen, arg_max(timestamp, arrival) AS last_seen, count(*) AS vol_count,
  round(avg(CAST(data_in_bytes + data_out_bytes AS DOUBLE)), 4) AS vol_mean,
  round(var_pop(CAST(data_in_bytes + data_out_bytes AS DOUBLE)) * count(*), 4) AS vol_m2
FROM train WHERE event_type = 'ToolCall' AND (agent_id <> 'agent-2' OR timestamp >= TIMESTAMP '2024-01-11') GROUP BY ALL""",
        "stored_span": f"""WITH {TRAIN} SELECT {EVENT_COLUMNS}, arrival FROM train
WHERE agent_id = 'agent-1' AND timestamp >= TIMESTAMP '2024-01-11' AND timestamp < TIMESTAMP '2024-01-16'""",
        "continued_sets": f"""WITH {TRAIN} SELECT DISTINCT agent_id, coalesce(tool_name, 'unknown') AS tool_name, array_to_string(list_sort(param_keys), '|') AS item
FROM train WHERE event_type = 'ToolCall' UNION ALL SELECT DISTINCT agent_id, NULL, unnest(resource_ids) FROM train""",
        "one_agent_tools": f"WITH {TRAINED} SELECT {ROUNDED_TOOL} FROM tool WHERE agent_id = 'agent-2'",
        "one_agent_anomalies": f"WITH {ALL_FOUND} SELECT * FROM found WHERE agent_id = 'agent-1'",
        "own_detectors": f"""WITH {SCORE}{VOLUMES.replace("z > 3.0", "z > 2.0").replace("z > 5.0", "z > 4.0")}, u_large AS (
  SELECT s.*, a.event_count, 'LargeCall' AS anomaly_type, 'Low' AS severity, CAST(NULL AS DOUBLE) AS z, CAST(data_in_bytes AS DOUBLE) AS observed, CAST(NULL AS DOUBLE) AS base
  FROM score s JOIN agent a USING (agent_id) WHERE event_type = 'ToolCall' AND data_in_bytes > 90000
) SELECT {SHOWN}, 0 AS detector FROM u_large UNION ALL SELECT {SHOWN}, 1 FROM u_volume""",
        "anomaly_texts": "WITH " + AT_ONE(all_said("arrival, detector, anomaly_type, severity", True)),
        "streamed_events": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM ev",
        "streamed_profile": f"WITH {TRAINED} SELECT {ROUNDED_AGENT} FROM agent",
        "streamed_marks": f"""WITH {EVENTS}, n AS (SELECT agent_id, count(*) AS event_count FROM ev GROUP BY agent_id)
SELECT agent_id, session_id, greatest(max(sequence_position), 0) AS hwm, any_value(event_count) AS event_count FROM ev JOIN n USING (agent_id) GROUP BY agent_id, session_id""",
        "logged_events": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM ev",
        "followed_log": f"WITH {EVENTS} SELECT {EVENT_COLUMNS} FROM ev",
        "live_sessions": f"""WITH {SCORE} SELECT agent_id, session_id, greatest(max(sequence_position), 0) AS hwm FROM score
GROUP BY agent_id, session_id HAVING max(timestamp) >= (SELECT max(timestamp) FROM score) - INTERVAL 3 DAY""",
        "live_anomalies": "WITH " + all_said(SHOWN.replace("arrival, ", "") + ", detector", False),
        "streamed_anomalies": "WITH " + all_said(SHOWN.replace("arrival, ", "") + ", detector", False),
    }
