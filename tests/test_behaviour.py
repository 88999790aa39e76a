import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

import model
from conductlens.functions.stats import merge_moments, moments, z_score
from conductlens.functions.text import compact_size, fixed, float_text, looks_like_resource, strict_json
from conductlens.operators.detect import DETECTORS, Detector, detect, detection_summary, rate_spikes, record, unknown_sequences, unknown_tools, unprofiled_agents, volume_spikes
from conductlens.operators.profile import Profile, build_profile, build_summary, document_to_profile, empty_profile, last_state_of, parts_to_profile, parts_with, profile_to_document, profile_to_parts
from conductlens.operators.sessions import accept_events, session_runs
from conductlens.schemas import ORDERED_EVENT, PROFILE_SCHEMAS

T0 = dt.datetime(2032, 2, 29, 21, 47, 8)


def event(n, session="s1", tool="read", kind="ToolCall", at=0.0, agent="a", seq=None, size=(0, 0), keys=(), resources=()):
    return dict(
        timestamp=T0 + dt.timedelta(seconds=at),
        session_id=session,
        agent_id=agent,
        event_type=kind,
        tool_name=tool,
        param_keys=list(keys),
        resource_ids=list(resources),
        data_in_bytes=size[0],
        data_out_bytes=size[1],
        duration_ms=0,
        token_count=None,
        sequence_position=n if seq is None else seq,
        arrival=n,
    )


def frame(spark, events):
    return spark.createDataFrame([tuple(e[f] for f in ORDERED_EVENT.fieldNames()) for e in events], ORDERED_EVENT)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize(
    ("kind", "tool", "rows_of"),
    [
        ("ToolCall", "grep", {"tool": 1, "param_set": 1, "resource": 2}),
        ("ToolCall", None, {"tool": 1, "param_set": 1, "resource": 2}),
        ("ToolResult", "grep", {"resource": 2}),
        ("Error", "grep", {"resource": 2}),
        ("AgentMessage", None, {"resource": 2}),
    ],
)
def test_a_kind_of_event_touches_its_tables(spark, kind, tool, rows_of):
    """Whatever its kind, an event counts for its agent, its hour and its session's mark; only calls count for tools."""
    one = event(4, tool=tool, kind=kind, size=(7, 36), keys=["mode", "flags", "mode2"], resources=["~/etc", "ftp/x", "~/etc"])
    p = build_profile(frame(spark, [one]))
    expected = {"agent": 1, "hour": 1, "hwm": 1, "tool": 0, "param_set": 0, "resource": 0, "bigram": 0} | rows_of
    assert {name: df.count() for name, df in p.tables().items()} == expected
    assert rows(p.hour)[0]["hour"] == T0.hour and rows(p.hwm)[0]["hwm"] == 4 and rows(p.agent)[0]["first_seen"] == T0
    for r in rows(p.tool):
        assert (r["tool_name"], r["vol_count"], r["vol_mean"], r["vol_m2"]) == (tool or "unknown", 1, 7.0 + 36.0, 0.0)
    for r in rows(p.param_set):
        assert r["param_keys"] == ["flags", "mode", "mode2"]


def test_pairs_rates_and_sessions(spark):
    events = [
        event(1, tool="read", at=0),
        event(2, tool=None, kind="UserMessage", at=30),
        event(3, tool="write", at=60),
        event(4, session="s2", tool="read", at=120),
        event(5, session="s1", tool="read", at=180),
    ]
    p = build_profile(frame(spark, events))
    assert {(r["first"], r["second"]): r["n"] for r in rows(p.bigram)} == {("read", "write"): 1}
    agent = rows(p.agent)[0]
    assert (agent["session_count"], agent["rate_count"], agent["rate_mean"]) == (3, 1, 1.0)


def test_unnamed_calls_and_replays(spark):
    p = build_profile(frame(spark, [event(1, tool=None), event(2, seq=1), event(3, seq=2), event(4, seq=0, session="s0"), event(5, seq=0, session="s0")]))
    assert {r["tool_name"]: r["call_count"] for r in rows(p.tool)} == {"unknown": 1, "read": 2}
    assert sorted(r["arrival"] for r in rows(p.accepted)) == [1, 3, 4]


def test_resume_and_marks(spark):
    first = build_profile(frame(spark, [event(1), event(2)]))
    second = build_profile(frame(spark, [event(11, seq=1), event(12, seq=2), event(13, seq=3)]), stored=first)
    agent = rows(second.agent)[0]
    assert (agent["event_count"], agent["session_count"]) == (3, 2)
    assert {(r["first"], r["second"]): r["n"] for r in rows(second.bigram)} == {("read", "read"): 1}
    again = build_profile(frame(spark, [event(11, seq=1), event(12, seq=2)]), stored=second)
    assert rows(again.agent)[0]["event_count"] == 3


def test_continuous_seam(spark):
    events = [event(k, session=f"s{k // 4}", tool=f"t{k % 3}", at=k * 7) for k in range(1, 13)]
    whole = build_profile(frame(spark, events))
    for cut in (3, 4, 6):
        one = build_profile(frame(spark, events[:cut]))
        state = last_state_of(one.accepted)
        two = build_profile(frame(spark, events[cut:]), stored=one, seam="continuous", last_state=state)
        for name in ("agent", "bigram", "tool"):
            key = lambda r: str(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items()))
            assert sorted(map(key, rows(getattr(two, name)))) == sorted(map(key, rows(getattr(whole, name)))), (cut, name)


def test_no_events(spark):
    p = build_profile(frame(spark, []))
    assert rows(p.agent) == [] and rows(build_summary(p)) == []


def random_events(rng, n):
    out = []
    for k in range(n):
        out.append(
            event(
                k,
                session=rng.choice(["s1", "s2", "s3"]),
                tool=rng.choice([None, "a", "b", "c"]),
                kind=rng.choice(["ToolCall", "ToolCall", "ToolCall", "UserMessage", "Error"]),
                at=rng.choice([k, k, k - 1, k + 0.0004]),
                agent=rng.choice(["x", "y"]),
                seq=rng.randint(0, n),
                size=(rng.randint(0, 3), rng.choice([0, 0, 0, 500])),
                resources=rng.sample(["/a", "/b", "/a"], rng.randint(0, 2)),
            )
        )
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_the_model(spark, seed):
    rng = random.Random(seed)
    events = random_events(rng, 40)
    want = model.profiles(events)
    got = build_profile(frame(spark, events))
    for agent in rows(got.agent):
        p = want[agent["agent_id"]]
        assert (agent["event_count"], agent["session_count"], agent["first_seen"], agent["last_updated"]) == (p["events"], p["sessions"], p["first"], p["last"])
        assert agent["rate_count"] == len(p["rates"].values) and agent["rate_mean"] == pytest.approx(p["rates"].mean)
    assert {(r["agent_id"], r["first"], r["second"]): r["n"] for r in rows(got.bigram)} == {(a, *b): n for a, p in want.items() for b, n in p["bigrams"].items()}
    assert {(r["agent_id"], r["tool_name"]): r["call_count"] for r in rows(got.tool)} == {(a, t): n for a, p in want.items() for t, n in p["tools"].items()}
    assert sorted(r["arrival"] for r in rows(got.accepted)) == sorted(x for p in want.values() for x in p["accepted"])
    score = random_events(random.Random(seed + 100), 40)
    for e in score[::5]:
        e["tool_name"] = "new"
    for scope in ("agent", "stream"):
        found = sorted((r["arrival"], r["anomaly_type"]) for r in rows(detect(frame(spark, score), got, 1.0, scope=scope)))
        assert found == model.anomalies(score, want, 1.0, scope), scope


def test_rank_runs_equal_window_runs(spark):
    events = random_events(random.Random(9), 200)
    for scope in (["agent_id"], []):
        sets = []
        for method in ("rank", "window"):
            runs = session_runs(frame(spark, events), scope, method=method).groupBy(*scope, "session_id", "run").agg(F.sort_array(F.collect_list("arrival")).alias("a"))
            sets.append(sorted(tuple(r["a"]) for r in rows(runs)))
        assert sets[0] == sets[1]


def profile(spark, tools=("read", "write"), rate=(0, 0.0, 0.0), volume=(0, 0.0, 0.0), bigrams=(), events=200):
    tables = {k: spark.createDataFrame([], s) for k, s in PROFILE_SCHEMAS.items()}
    tables["agent"] = spark.createDataFrame([("a", 1, events, T0, T0, *rate)], PROFILE_SCHEMAS["agent"])
    tables["tool"] = spark.createDataFrame([("a", t, 10, T0, T0, *volume) for t in tools], PROFILE_SCHEMAS["tool"])
    if bigrams:
        tables["bigram"] = spark.createDataFrame([("a", x, y, 1) for x, y in bigrams], PROFILE_SCHEMAS["bigram"])
    return Profile(**tables)


def test_unknown_tool(spark):
    score = [event(1, tool="teleport"), event(2, tool="read"), event(3, tool=None), event(4, tool="READ"), event(5, tool="teleport", kind="ToolResult")]
    found = sorted(rows(unknown_tools(frame(spark, score), profile(spark, tools=("write", "read"), events=25))), key=lambda a: a["arrival"])
    assert [(a["arrival"], a["severity"], a["confidence"], a["description"], a["baseline_value"]) for a in found] == [
        (1, "High", 0.25, "unknown tool: teleport", "known tools: [read, write]"), (4, "High", 0.25, "unknown tool: READ", "known tools: [read, write]")
    ]


def test_one_pass_equals_single_detectors(spark):
    known = build_profile(frame(spark, random_events(random.Random(30), 60))).staged()
    score = random_events(random.Random(31), 80)
    for e in score[::7]:
        e["tool_name"] = "new"
    for scope in ("agent", "stream"):
        shown = lambda df: sorted(json.dumps(r, default=str, sort_keys=True) for r in rows(df))  # noqa: B023, E731
        alone = detect(frame(spark, score), known, 1.0, [unknown_tools, unknown_sequences, rate_spikes, volume_spikes], scope)
        assert shown(detect(frame(spark, score), known, 1.0, scope=scope)) == shown(alone) and alone.count() > 10


def test_detectors_of_a_list_are_one_pass(spark):
    """Expressions and functions side by side; calls are ordered only for detectors that look at the call before."""
    events, p = frame(spark, random_events(random.Random(9), 60)), build_profile(frame(spark, random_events(random.Random(8), 60))).staged()
    none = F.lit(None)
    own = Detector("Named", lambda least: F.col("tool_name").isNotNull() & (F.col("sequence_position") > least), lambda _: record("Named", F.lit("named"), none, F.col("sequence_position"), none, F.lit("Low"), (none, none)))
    key = lambda r: str(sorted(r.items()))
    got = rows(detect(events, p, 2.0, [own, volume_spikes, *DETECTORS]))
    assert sorted(key(r | {"detector": r["detector"] - 2}) for r in got if r["detector"] > 1) == sorted(map(key, rows(detect(events, p, 2.0))))
    named = [r for r in got if r["detector"] == 0]
    assert named and all(r["observed_value"] == str(r["sequence_position"]) and r["anomaly_type"] == "Named" for r in named)
    plan = lambda listed: detect(events, p, 2.0, listed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan([own]) and "Window" in plan([DETECTORS[1]])
    assert rows(detect(events, p, 2.0, [])) == [] and detect(events, p, 2.0, []).columns == detect(events, p).columns
    assert all(r["baseline_value"] is None for r in rows(detect(events, p, list_tools=False)) if r["anomaly_type"] == "UnknownTool")


def test_unknown_pair(spark):
    p = profile(spark, bigrams=[("read", "write")], events=50)
    assert rows(unknown_sequences(frame(spark, [event(1), event(2, tool="write"), event(3, session="s2")]), p)) == []
    found = rows(unknown_sequences(frame(spark, [event(1), event(2, tool=None), event(3, tool="exec")]), p))
    assert [(a["description"], a["baseline_value"], a["confidence"]) for a in found] == [("unseen sequence: read->exec", "1 known bigrams", 0.5)]


@pytest.mark.parametrize("threshold", [2.0, 3.0, 6.5])
def test_rates_are_graded_by_their_distance_from_the_mean(spark, threshold):
    """Gaps of 1 to 12 seconds against a history of mean 9 and deviation 2.5: fires above the threshold, severe above that plus two."""
    gaps = list(range(1, 13))
    calls, at = [event(0, at=0)], 0
    for n, gap in enumerate(gaps, 1):
        at += gap
        calls.append(event(n, at=at))
    z = {n: (60 / gap - 9) / 2.5 for n, gap in enumerate(gaps, 1)}
    found = rows(rate_spikes(frame(spark, calls), profile(spark, rate=(5, 9.0, 4 * 2.5**2)), threshold))
    assert {a["arrival"]: a["severity"] for a in found} == {n: "High" if x > threshold + 2 else "Medium" for n, x in z.items() if x > threshold}
    for a in found:
        rate = 60 / gaps[a["arrival"] - 1]
        assert a["z_score"] == pytest.approx(z[a["arrival"]]) and a["description"] == f"rate spike: {rate:.1f} calls/min (z={z[a['arrival']]:.1f})"
        assert (a["baseline_value"], a["observed_value"]) == ("9.0 calls/min (mean)", f"{rate:.1f} calls/min")


def test_a_history_without_spread_judges_nothing(spark):
    """One value, or the same one always: no deviation, so no distance from it."""
    calls = frame(spark, [event(k, at=k * k, size=(10**k, 0)) for k in range(6)])
    for moments_ in ((1, 8.0, 0.0), (40, 8.0, 0.0)):
        p = profile(spark, rate=moments_, volume=moments_)
        assert rows(rate_spikes(calls, p, 0.0)) == rows(volume_spikes(calls, p, 0.0)) == []


def test_volumes_at_the_thresholds(spark):
    """Both directions count together, and a threshold itself does not fire."""
    exact = profile(spark, volume=(3, 0.0, 2.0))  # deviation 1
    sizes = [(1, 2), (2, 3), (6, 0), (0, 6), (0, 0)]
    got = rows(volume_spikes(frame(spark, [event(k, size=z) for k, z in enumerate(sizes)]), exact))
    assert {a["arrival"]: (a["observed_num"], a["severity"]) for a in got} == {1: (5.0, "Medium"), 2: (6.0, "High"), 3: (6.0, "High")}
    assert {a["description"] for a in got} == {"volume spike on read: 5 bytes (z=5.0)", "volume spike on read: 6 bytes (z=6.0)"}


def test_agents_without_profile_and_summary(spark):
    p = profile(spark)
    events = frame(spark, [event(1), event(2, agent="b", tool="evil"), event(3, agent="b")])
    assert rows(unprofiled_agents(events, p)) == [{"agent_id": "b", "n": 2}]
    assert {r["metric"]: r["n"] for r in rows(detection_summary(events, detect(events, p), p))} == {"events_scanned": 1, "anomalies": 0}
    assert rows(detect(events, empty_profile(spark))) == []


def test_moments(spark):
    df = spark.createDataFrame([("c", 0.1), ("c", 0.1), ("c", 0.1), ("v", 1.0), ("v", 4.0), ("n", None)], "k string, x double")
    m = dict(zip(("n", "mean", "m2"), moments(F.col("x")), strict=True))
    got = {r["k"]: r for r in rows(df.groupBy("k").agg(*[c.alias(n) for n, c in m.items()]))}
    assert (got["c"]["mean"], got["c"]["m2"], got["n"]["n"], got["n"]["m2"]) == (0.1, 0.0, 0, 0.0)
    assert (got["v"]["mean"], got["v"]["m2"]) == (2.5, pytest.approx(4.5))
    pair = spark.createDataFrame([(2, 2.5, 4.5, 1, 7.0, 0.0), (2, 0.1, 0.0, 3, 0.1, 0.0), (None, None, None, 1, 7.0, 0.0)], "a long, b double, c double, d long, e double, f double")
    out = rows(pair.select(*[c.alias(n) for n, c in zip("nms", merge_moments((F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("e"), F.col("f"))), strict=True)]))
    assert (out[0]["n"], out[0]["m"], out[0]["s"]) == (3, 4.0, pytest.approx(18.0))
    assert (out[1]["m"], out[1]["s"]) == (0.1, 0.0) and (out[2]["n"], out[2]["m"], out[2]["s"]) == (1, 7.0, 0.0)
    assert rows(pair.select(z_score(F.lit(1.0), F.lit(1), F.lit(0.0), F.lit(0.0)).alias("z")))[0]["z"] is None


def test_document_round_trip(spark):
    p = build_profile(frame(spark, random_events(random.Random(3), 40)))
    back = document_to_profile(profile_to_document(p))
    for name, df in p.tables().items():
        key = lambda r: json.dumps(r, default=str, sort_keys=True)
        assert sorted(map(key, rows(df))) == sorted(map(key, rows(getattr(back, name).select(*df.columns)))), name


def test_parts_round_trip(spark):
    """Rows of every table come back, no document is large, and a key is found in one part an agent."""
    made = [event(k, agent="ab"[k % 3 == 0], session=f"s{k // 30}", tool=f"t{k * k % 11}", seq=k, at=k * 17, size=(k, 1), keys=["k", f"p{k % 4}"], resources=[f"/r/{k % 25}"]) for k in range(1, 121)]
    p = build_profile(frame(spark, made)).staged()
    parts = profile_to_parts(p, rows=6).persist()
    key = lambda r: json.dumps(r, default=str, sort_keys=True)
    back = parts_to_profile(parts)
    for name, df in p.tables().items():
        assert sorted(map(key, rows(df))) == sorted(map(key, rows(getattr(back, name).select(*df.columns)))), name
    sizes = [r["n"] for r in rows(parts)]
    assert max(sizes) <= 12 and len(sizes) > 7 and len({(r["agent_id"], r["component"], r["part"]) for r in rows(parts)}) == len(sizes)
    pair = rows(p.bigram)[0]
    found = parts_with(parts, "bigram", pair["first"], pair["second"]).where(F.col("agent_id") == pair["agent_id"])
    assert found.count() == 1 and pair in rows(parts_to_profile(found).bigram.select(*p.bigram.columns))
    whole = rows(p.param_set)[0]
    found = parts_with(parts, "param_set", whole["tool_name"], F.array(*map(F.lit, whole["param_keys"])).cast("array<string>"))
    assert whole in rows(parts_to_profile(found).param_set.select(*p.param_set.columns))
    assert profile_to_parts(empty_profile(spark)).count() == 0


def test_number_and_json_text(spark):
    df = spark.createDataFrame([(0.25, 2.5), (None, 3.5)], "x double, y double").select(fixed(F.col("x"), 1).alias("x"), fixed(F.col("y"), 0).alias("y"))
    assert rows(df) == [{"x": "0.2", "y": "2"}, {"x": None, "y": "4"}]
    assert [float_text(x) for x in (1.0, 1e16, 1e15, 1e-5, 1e-6, 1.5e-7, -0.0, 0.1)] == ["1.0", "1e16", "1000000000000000.0", "0.00001", "1e-6", "1.5e-7", "-0.0", "0.1"]
    assert compact_size("hello") == 7 and compact_size({"b": [1, 2.0, None], "a": "é\n"}) == len('{"b":[1,2.0,null],"a":"é\\n"}'.encode())
    assert compact_size("\U0001f600\x01") == 2 + 4 + 6
    for bad in ('{"a":1} x', '{"a":NaN}', '"\\ud800"'):
        with pytest.raises(ValueError):
            strict_json(bad)
    assert [looks_like_resource(t) for t in ("/usr", "~/x", "https://e", "http://l", "file.txt", "~x", "HTTP://x")] == [True] * 4 + [False] * 3


@pytest.mark.parametrize("marks", [False, True])
def test_busy_sessions_are_accepted_alike(spark, marks):
    events = frame(spark, random_events(random.Random(12), 120))
    hwm = spark.createDataFrame([("x", "s1", 60), ("y", "s9", 1)], "agent_id string, session_id string, hwm long") if marks else None
    # all sessions as windows, all but the larger ones, none
    by = [sorted(r["arrival"] for r in rows(accept_events(events, hwm, busy=n))) for n in (1000, 20, 0)]
    assert by[0] == by[1] == by[2] and 0 < len(by[0]) < 120


def test_accept_skips_late_positions(spark):
    kept = accept_events(frame(spark, [event(1, seq=3), event(2, seq=2), event(3, seq=4)]))
    assert sorted(r["arrival"] for r in rows(kept)) == [1, 3]
