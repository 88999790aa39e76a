import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from conductlens.operators.detect import anomaly_records, detect
from conductlens.operators.profile import build_profile, expire_marks
from conductlens.sources import layers, store
from conductlens.sources.layers import Layer, Layers, to_fold
from conductlens.sources.store import (
    append_events,
    compact_events,
    compact_profiles,
    event_files,
    events_to_json,
    list_agents,
    load_events,
    load_profile,
    load_state,
    parse_events,
    publish,
    read_events,
    save_profile,
    stream_events,
    valid_event,
)
from conductlens.functions.text import END, plain_json, plain_numbers
from conductlens.sources.transcripts import decode_line, decode_lines, parse_transcripts, plain_line, read_transcripts, transcript_totals
from conductlens.streaming import jobs
from conductlens.streaming.jobs import build_batch, stream_build, stream_detect
from conductlens.streaming.live import compact_live, live_batch, live_marks, load_anomalies, stream_live
from test_behaviour import T0, event, frame, rows


def message(role, content, time=None, **more):
    """A message line, built from the rules of the format."""
    stamp = {} if time is None else {"timestamp": time}
    return json.dumps({"type": "message", **stamp, "message": {"role": role, "content": content, **more}})


def block(name, arguments):
    return {"type": "toolCall", "name": name, "arguments": arguments}


def text(value):
    return {"type": "text", "text": value}


def session(ident=None):
    return json.dumps({"type": "session"} | ({} if ident is None else {"id": ident}))


SESSION = session("night-7")
USER = message("user", [text("zähle ab"), {"type": "image", "data": [1, {"x": None}]}], "2031-07-04T23:59:58.250+02:00")


def parsed(spark, files, **more):
    lines = [(f, n, v) for f, vs in files.items() for n, v in enumerate(vs)]
    events, rejects = parse_transcripts(spark.createDataFrame(lines, "file string, line_no long, value string"), **more)
    return sorted(rows(events), key=lambda r: tuple(r["arrival"].values())), rows(rejects)


def test_lines_of_all_kinds(spark):
    arguments = {"z": "~/notes", "deep": {"to": "/not/seen"}, "a": "https://x.test/é", "list": ["/neither"], "n": 1.50}
    lines = [
        SESSION,
        USER,
        message("assistant", [text("first"), block("grep", arguments), text("then"), block("ls", None), block("pwd", "/home")], "2031-07-05T00:00:01Z", usage={"totalTokens": 0}),
        message("toolResult", {"rows": [True, None]}, "yesterday", toolName="grep", isError=True),
        message("toolResult", "fine", toolName="ls", isError=False),
        message("assistant", [text("done")], usage={}),
        "{",
        json.dumps({"type": "thinking_level", "level": [1]}),
    ]
    events, rejects = parsed(spark, {"f": lines}, agent_id="night-watch", ingest_time="2000-02-03 04:05:06")
    assert [(e["event_type"], e["tool_name"], e["sequence_position"], e["token_count"]) for e in events] == [
        ("UserMessage", None, 1, None), ("ToolCall", "grep", 2, 0), ("ToolCall", "ls", 3, 0), ("ToolCall", "pwd", 4, 0),
        ("Error", "grep", 5, None), ("ToolResult", "ls", 6, None), ("AgentMessage", None, 7, None),
    ]
    compact = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())
    assert [e["data_in_bytes"] for e in events[:4]] == [compact([text("zähle ab"), {"type": "image", "data": [1, {"x": None}]}]), compact(arguments), 0, 0]
    assert [e["data_out_bytes"] for e in events[4:]] == [compact({"rows": [True, None]}), compact("fine"), compact([text("done")])]
    assert (events[1]["param_keys"], events[1]["resource_ids"]) == (["a", "deep", "list", "n", "z"], ["https://x.test/é", "~/notes"])
    assert {e["session_id"] for e in events} == {"night-7"} and {e["agent_id"] for e in events} == {"night-watch"}
    assert events[0]["timestamp"] == dt.datetime(2031, 7, 4, 21, 59, 58, 250_000)
    assert {e["timestamp"] for e in events[4:]} == {dt.datetime(2000, 2, 3, 4, 5, 6)}
    assert [r["value"] for r in rejects] == ["{"]


def test_state_goes_on_into_the_next_file(spark):
    files = {"a": [SESSION, USER], "b": [USER, USER], "c": [], "d": [USER, '{"type":"session"}', USER], "e": [USER]}
    events, _ = parsed(spark, files)
    assert [(e["arrival"]["file"], e["sequence_position"], e["session_id"]) for e in events] == [
        ("a", 1, "night-7"), ("b", 2, "night-7"), ("b", 3, "night-7"), ("d", 4, "night-7"), ("d", 1, "night-7"), ("e", 2, "night-7")
    ]
    alone, _ = parsed(spark, files, carry_over=False)
    assert [e["session_id"] for e in alone] == ["night-7", "", "", "", "", ""]


def test_agents_from_paths(spark):
    files = {
        "/r/agents/ann/sessions/1": [USER], "/r/agents/ann/sessions/2": [SESSION, USER, USER], "/r/agents/bob/sessions/1": [USER, USER],
        "/r/agents/bob/sessions/2": [USER], "/r/agents/cy/sessions/1": [session("c")], "/r/agents/cy/sessions/2": [USER], "/r/else": [USER],
    }
    events, _ = parsed(spark, files, agent_pattern="/agents/([^/]+)/sessions/", agent_id="nobody")
    assert [(e["agent_id"], e["session_id"], e["sequence_position"]) for e in events] == [
        ("ann", "", 1), ("ann", "night-7", 1), ("ann", "night-7", 2), ("bob", "", 1), ("bob", "", 2), ("bob", "", 3), ("cy", "c", 1), ("nobody", "", 1)
    ]


def test_lines():
    kind = lambda line: [e[0] for e in decode_line(line)[3]]
    message = lambda m: json.dumps({"type": "message", "message": m})
    assert kind(message({"role": "user", "content": "hello"})) == ["UserMessage"]
    assert decode_line(message({"role": "user", "content": "hello"}))[3][0][4] == 7
    assert kind(message({"role": "assistant", "content": "hello"})) == []
    assert kind(message({"role": "assistant", "content": None})) == []
    assert kind(message({"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": 1}, 5]})) == ["AgentMessage"]
    two = [{"type": "toolCall", "name": "a", "arguments": [1]}, {"type": "toolCall", "arguments": {"p": "/x", "q": {"r": "/y"}}}]
    got = decode_line(message({"role": "assistant", "content": two}))[3]
    assert [(e[1], e[2], e[3], e[4]) for e in got] == [("a", [], [], 0), (None, ["p", "q"], ["/x"], len('{"p":"/x","q":{"r":"/y"}}'))]
    assert kind(message({"role": "system", "content": "x"})) == []
    bad = ['{"type":5}', '{"id":"x"}', '{"type":"x","id":1}', '{"type":"x","type":"y"}', '{"type":"x"} y', '["session","id"]', message({"content": 1}), message({"role": "user", "isError": 1})]
    bad += [message({"role": "user", "usage": {"totalTokens": t}}) for t in (-1, 1.0, "1", True)]
    for line in bad:
        with pytest.raises(ValueError):
            decode_line(line)


def test_totals_count_files_without_events(spark):
    lines = spark.createDataFrame([("a", 1, USER), ("a", 2, "{broken"), ("b", 1, "[]"), ("c", 1, SESSION)], "file string, line_no long, value string")
    totals = lambda df: {r["metric"]: r["n"] for r in rows(transcript_totals(df))}
    assert totals(lines) == {"files": 3, "events": 1, "rejected_lines": 2}
    assert totals(lines.limit(0)) == {"files": 0, "events": 0, "rejected_lines": 0}


def test_folder_of_transcripts(spark, tmp_path):
    (tmp_path / "b.jsonl").write_bytes((SESSION + "\r\n\r\n" + USER + "\n").encode())
    (tmp_path / "a.jsonl").write_text(USER)
    (tmp_path / "c.txt").write_text(USER)
    lines = read_transcripts(spark, str(tmp_path))
    events, rejects = parse_transcripts(lines)
    assert [(e["sequence_position"], e["session_id"]) for e in sorted(rows(events), key=lambda r: tuple(r["arrival"].values()))] == [(1, ""), (1, "night-7")]
    assert {r["metric"]: r["n"] for r in rows(transcript_totals(lines))} == {"files": 2, "events": 2, "rejected_lines": 0}
    with pytest.raises(FileNotFoundError):
        read_transcripts(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert rows(read_transcripts(spark, str(tmp_path / "empty"))) == []


def test_large_files_are_split(spark, tmp_path):
    values = [f'{{"type":"x","n":{k}}}' if k % 9 else "" for k in range(4000)]
    (tmp_path / "big.jsonl").write_text("\n".join(values))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = read_transcripts(spark, str(tmp_path / "*"))
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
        assert sorted((r["line_no"], r["value"]) for r in rows(lines)) == [(k, v) for k, v in enumerate(values) if v]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_events_as_json(spark, tmp_path):
    events = frame(spark, [event(1, keys=["k"], resources=["/a"]), event(2, tool=None)])
    lines = [r["value"] for r in rows(events_to_json(events))]
    good = json.loads(lines[0])
    assert list(good) == ["timestamp", "session_id", "agent_id", "event_type", "tool_name", "param_keys", "resource_ids", "data_in_bytes", "data_out_bytes", "duration_ms", "token_count", "sequence_position"]
    wrong = [good | {"session_id": 5}, good | {"event_type": "Other"}, good | {"data_in_bytes": -1}, good | {"param_keys": [None]}, {k: v for k, v in good.items() if k != "agent_id"}]
    wrong = [json.dumps(w) for w in wrong] + ["{", lines[0] + " x"]
    (tmp_path / "e.jsonl").write_text("\n".join([*lines, "", *wrong]))
    back, rejects = read_events(spark, str(tmp_path / "e.jsonl"))
    assert sorted(r["sequence_position"] for r in rows(back)) == [1, 2] and len(rows(rejects)) == len(wrong)
    assert valid_event(lines[1]) and not any(map(valid_event, wrong))


def test_stores(spark, tmp_path):
    root = str(tmp_path / "store")
    assert load_profile(spark, root) is None and rows(load_events(spark, root)) == [] and rows(list_agents(spark, root)) == []
    p = build_profile(frame(spark, [event(1, agent="beta"), event(2, agent="alpha", size=(100, 200))]))
    publish(p.accepted, p, root)
    append_events(frame(spark, []), root)
    append_events(frame(spark, [event(3, agent="gamma")]), root)
    assert [r["agent_id"] for r in rows(list_agents(spark, root))] == ["alpha", "beta", "gamma"]
    assert len(rows(load_events(spark, root))) == 3 and len(rows(load_events(spark, root, "alpha"))) == 1
    more = build_profile(frame(spark, [event(5, agent="beta", seq=9)]), stored=load_profile(spark, root, "beta"))
    save_profile(more, root)
    loaded = load_profile(spark, root)
    assert {r["agent_id"]: r["event_count"] for r in rows(loaded.agent)} == {"alpha": 1, "beta": 2}
    for part in (tmp_path / "store/profiles/layers").glob("*/agent/*/*.parquet"):
        part.write_text("gone")
    with pytest.raises(Exception):  # noqa: B017
        load_profile(spark, root).agent.collect()
    assert load_profile(spark, root, on_corrupt="fresh") is None


def any_value(rng, depth=0):
    r = rng.random()
    if depth > 3 or r < 0.35:
        return rng.choice(["", "é", "😀x", 'a"b\\c/\n\t\x01\x7f ', "/p", "~/q", "https://x", "http:/", "toolCall", "text", END])
    if r < 0.5:
        return rng.choice([0, -1, 10**12, 10**17, 10**18, 1 << 63, 1.0, 2.5, -0.0, 1e30, True, False, None])
    if r < 0.7:
        return [any_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["type", "name", "arguments", "é", 'z"q', "b.c", "id"]): any_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def any_line(rng):
    """Transcript lines with all kinds of fields, right and wrong, some of them spoilt as text."""

    def part():
        arguments = rng.choice([{"path": "/x", "n": rng.choice([1, 2.5, "~/z"]), "A": "http://q"}, {}, [], None, "s", any_value(rng)])
        return rng.choice([{"type": "toolCall", "name": rng.choice(["run", None, 5]), "arguments": arguments}, text("é😀\n"), any_value(rng)])

    said = {"role": rng.choice(["user", "assistant", "assistant", "toolResult", "system", None, 3]), "content": rng.choice([any_value(rng), [part() for _ in range(rng.randint(0, 4))]])}
    more = {"toolName": ["t", None, 1], "isError": [True, False, None, "x"], "usage": [{"totalTokens": rng.choice([5, 0, None, -1, 1.0, 1 << 63, "x"])}, None, {}, 3]}
    said |= {k: rng.choice(v) for k, v in more.items() if rng.random() < 0.3}
    line = {"type": rng.choice(["message"] * 8 + ["session", "other", None, 4]), "message": said if rng.random() < 0.9 else rng.choice([None, [], "x", {}])}
    line |= {k: rng.choice(["x", None, 4]) for k in ("id", "timestamp") if rng.random() < 0.3}
    out, r = json.dumps(line, ensure_ascii=rng.random() < 0.3), rng.random()
    spoilt = [out + rng.choice([" x", "}", ", {}", "] [", f',"{END}"]', " "]), out[: rng.randint(0, len(out))], out.replace('"type"', '"type":"message","type"', 1), out.replace("{", "{ ", 1)]
    return out if r > 0.15 else rng.choice(spoilt)


def test_lines_are_decoded_the_same_in_the_jvm(spark):
    """Every line comes out as ``decode_line`` gives it, and most well-formed ones without Python."""
    rng = random.Random(5)
    lines = [any_line(rng) for _ in range(1500)] + ["null", "[1]", "7", message("user", "plain"), message("assistant", [block("run", {"b": "/x", "a": 1})], usage={"totalTokens": 3})]

    def want(line):
        try:
            return decode_line(line)
        except (ValueError, RecursionError):
            return None

    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string, line_no long, value string")
    decoded, rejects = decode_lines(df)
    got = {r.line_no: (r.kind, r.id, r.time, [tuple(e) for e in r.events]) for r in decoded.collect()} | {r.line_no: None for r in rejects.collect()}
    assert [n for n, x in enumerate(lines) if got[n] != want(x)] == [] and len(got) == len(lines)
    plain = df.select("line_no", plain_line(F.when(plain_numbers(F.col("value")), plain_json(F.col("value")))).isNotNull().alias("p")).where("p").count()
    assert plain > 200


def test_events_are_validated_the_same_in_the_jvm(spark):
    rng = random.Random(6)
    good = json.loads(rows(events_to_json(frame(spark, [event(1, keys=["k"]), event(2)])))[0]["value"])
    lines = []
    for _ in range(400):
        e = dict(good)
        for k in rng.sample(sorted(e), rng.randint(0, 2)):
            e[k] = rng.choice([None, "x", 5, -1, 1.0, True, [], ["a"], ["a", None], [1], {}, 1 << 63, "ToolCall"])
        if rng.random() < 0.2:
            e["more"] = any_value(rng)
        out = json.dumps(e, ensure_ascii=rng.random() < 0.3)
        lines.append(rng.choice([out] * 8 + [out + " x", out + ",{}", out.replace("{", '{"agent_id":"q",', 1)]))
    df = spark.createDataFrame([(x, n) for n, x in enumerate(lines)], "value string, n int")
    loose = {r.n for r in parse_events(df, strict=False)[0].collect()}
    got = {r.n for r in parse_events(df)[0].collect()}
    assert got == {n for n in loose if valid_event(lines[n])} and 50 < len(got) < 390


def test_a_large_file_is_many_tasks(spark):
    """No window over a file: its lines are spread over the range partitions, and the result is that of small files' rules."""
    lines = [("one", n, SESSION if n % 700 == 350 else message("user", f"line {n}")) for n in range(4000)]
    events, _ = parse_transcripts(spark.createDataFrame(lines, "file string, line_no long, value string"))
    got = {r.arrival.line_no: (r.session_id, r.sequence_position) for r in events.collect()}
    session_id, place = "", 0
    for _, n, line in lines:
        if line is SESSION:
            session_id, place = "night-7", 0
            continue
        place += 1
        assert got[n] == (session_id, place), n
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(file" not in plan


def test_small_layers_are_folded():
    """A thousand batches leave few layers, and a row is rewritten as often as the logarithm of the whole."""
    kept, written = [], 0
    for _ in range(1000):
        kept.append(Layer("x", 5))
        written += 5
        while n := to_fold(kept):
            total = sum(layer.rows for layer in kept[-n:])
            kept[-n:] = [Layer("x", total)]
            written += total
    assert len(kept) <= 4 * layers.FANOUT and sum(layer.rows for layer in kept) == 5000 and written <= 5 * 5000
    # a large layer is not touched by small ones, nor one with other columns
    assert to_fold([Layer("base", 10**6), *[Layer("x", 3)] * layers.FANOUT]) == layers.FANOUT
    assert to_fold([Layer("x", 3, "a int"), *[Layer("x", 3, "b int")] * (layers.FANOUT - 1)]) == 0


def test_events_are_folded_and_found_by_the_table_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "FANOUT", 3)
    root, day = str(tmp_path / "store"), 86_400
    parts = [[event(10 * d + k, agent=f"a{k}", session=f"d{d}", at=d * day + k) for k in range(3)] for d in range(7)]
    for d, part in enumerate(parts):
        append_events(frame(spark, part), root, f"feed-{d}")
        append_events(frame(spark, part), root, f"feed-{d}")  # a repeated call adds nothing
    found = lambda df: sorted((r["agent_id"], r["session_id"], r["arrival"]) for r in rows(df))
    everything = sorted((r["agent_id"], r["session_id"], r["arrival"]) for part in parts for r in rows(frame(spark, part)))
    assert found(load_events(spark, root)) == everything
    now = Layers(spark, f"{root}/events").current()
    assert len(now[0]) == 3 and now[1] == {"feed": 6}  # 3 + 3 + 1 batches
    one = load_events(spark, root, "a1", since=str(T0 + dt.timedelta(days=6)))
    assert found(one) == [x for x in everything if x[:2] == ("a1", "d6")]
    # the oldest layers hold no event of that day, and other agents' files are not read
    assert len(one.inputFiles()) == 1 and event_files(spark, root).select("layer", "file").distinct().count() > 3
    assert found(load_events(spark, root, until=str(T0 + dt.timedelta(days=1)))) == [x for x in everything if x[1] == "d0"]
    assert rows(load_events(spark, root, "nobody")) == []
    reader = load_events(spark, root)
    compact_events(spark, root)
    assert len(Layers(spark, f"{root}/events").current()[0]) == 1
    assert found(reader) == found(load_events(spark, root)) == everything  # a reader of the old layers goes on
    append_events(frame(spark, parts[0]), root, "feed-6")
    assert found(load_events(spark, root)) == everything
    with pytest.raises(ValueError):
        append_events(frame(spark, parts[0]), root, "no number")


def test_a_profile_is_saved_in_proportion_to_its_agents(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    many = build_profile(frame(spark, [event(k, agent=f"a{k}", session="s", seq=1) for k in range(300)]))
    save_profile(many, root)
    more = [event(1000, agent="a7", session="t", seq=1), event(1001, agent="a7", session="t", seq=2)]
    build_batch(frame(spark, more), root, "feed-0")
    log = Layers(spark, f"{root}/profiles")
    base, delta = log.current()[0]
    assert base.rows >= 4 * 300 and delta.rows < 20
    whole = lambda p: sorted(map(str, [r for n in ("agent", "tool", "hour", "hwm") for r in rows(getattr(p, n))]))
    want = build_profile(frame(spark, more), stored=many, seam="continuous")
    reader = load_profile(spark, root)
    assert whole(reader) == whole(want) and rows(load_profile(spark, root, "a7").agent)[0]["event_count"] == 3
    compact_profiles(spark, root)
    assert len(log.current()[0]) == 1 and whole(reader) == whole(load_profile(spark, root)) == whole(want)
    # an agent that is replaced loses the rows that it no longer has; the others keep theirs, also when layers are folded
    monkeypatch.setattr(layers, "FANOUT", 3)
    for k in range(4):
        save_profile(build_profile(frame(spark, [event(5 + k, agent="a9", tool=f"only{k}")])), root)
    assert [r["tool_name"] for r in rows(load_profile(spark, root, "a9").tool)] == ["only3"]
    assert load_profile(spark, root).agent.count() == 300 and len(log.current()[0]) <= 3
    # folders that no kept list names are gone
    assert len(list((tmp_path / "store/profiles/log").glob("*.json"))) == layers.KEPT and len(list((tmp_path / "store/profiles/layers").iterdir())) <= 6


def test_streams(spark, tmp_path):
    events = [event(k, session=f"s{k // 6}", tool=f"t{k % 4}" if k % 7 else None, at=k * 13) for k in range(1, 19)]
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    schema = frame(spark, events).schema
    for n, part in enumerate((events[:7], events[7:8], events[8:])):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        feed = spark.readStream.schema(schema).parquet(str(source))
        query = stream_build(feed, root, str(tmp_path / "check"))
        query.awaitTermination()
        assert query.exception() is None, n
    want, got = build_profile(frame(spark, events)), load_profile(spark, root)
    for name in ("agent", "bigram", "tool", "hwm"):
        key = lambda r: str(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items()))
        assert sorted(map(key, rows(getattr(got, name)))) == sorted(map(key, rows(getattr(want, name)))), name


def test_interrupted_batches_add_nothing(spark, tmp_path, monkeypatch):
    events = [event(k, session=f"s{k // 5}", tool=f"t{k % 3}", at=k * 11) for k in range(1, 15)]
    want = build_profile(frame(spark, events))
    shown = lambda p: sorted(str(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items())) for n in ("agent", "bigram", "hwm") for r in rows(getattr(p, n)))
    root = str(tmp_path / "store")

    def broken(*_, **__):
        raise OSError("lost")

    for n, part in enumerate((events[:6], events[6:])):
        # lost before the events are written, before they count, between the writes, before the profile counts; then once whole and once again
        for lost in ("append_events", "events", "save_profile", "profiles", None, None):
            with monkeypatch.context() as patched:
                if lost in ("events", "profiles"):
                    patched.setattr(Layers, "publish", lambda self, *a, lost=lost, real=Layers.publish: broken() if self.root.endswith(lost) else real(self, *a))
                elif lost is not None:
                    patched.setattr(jobs, lost, broken)
                try:
                    build_batch(frame(spark, part), root, f"feed-{n}")
                except OSError:
                    assert lost is not None
        assert len(rows(load_events(spark, root))) == (6, 14)[n]
    assert shown(load_profile(spark, root)) == shown(want)
    assert [(r["session_id"], r["tool_name"]) for r in rows(load_state(spark, root))] == [("s2", "t2")]
    # a new checkpoint begins its numbers anew: nothing is written over
    build_batch(frame(spark, [event(20, session="s9", seq=1)]), root, "other-0")
    assert len(rows(load_events(spark, root))) == 15


def test_marks_that_expire(spark, tmp_path):
    day = 86_400
    events = [event(1, session="old", at=0), event(2, session="new", at=40 * day), event(3, session="new", seq=9, at=41 * day), event(4, agent="b", session="old", at=0)]
    p = expire_marks(build_profile(frame(spark, events)), "30 days")
    assert sorted((r["agent_id"], r["session_id"], r["hwm"]) for r in rows(p.hwm)) == [("a", "new", 9), ("b", "old", 4)]
    assert rows(p.agent) and [r["seen"] for r in rows(p.hwm) if r["session_id"] == "new"] == [T0 + dt.timedelta(days=41)]
    build_batch(frame(spark, events), str(tmp_path / "s"), "x-0", mark_ttl="30 days")
    assert load_profile(spark, str(tmp_path / "s")).hwm.count() == 2


def test_stream_of_json_lines(spark, tmp_path):
    events = frame(spark, [event(1), event(2, tool=None, keys=["b", "a"])])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join([r["value"] for r in rows(events_to_json(events))] + ["", "{broken"]))
    found = []
    for k, feed in enumerate(stream_events(spark, str(tmp_path / "in"))):
        query = feed.writeStream.format("memory").queryName(f"lines{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        query.awaitTermination()
        found.append(rows(spark.table(f"lines{k}")))
    assert sorted(r["sequence_position"] for r in found[0]) == [1, 2] and [r["value"] for r in found[1]] == ["{broken"]


def test_live_detection(spark, tmp_path):
    known = build_profile(frame(spark, [event(1, tool="a", at=0), event(2, tool="b", at=60), event(3, tool="a", at=121), event(4, tool="b", at=180), event(5, tool="b", size=(3, 0), at=300)])).staged()
    score = [
        event(1, tool="a", at=0, session="n"), event(2, tool="a", at=1.5, session="n", keys=["k"]), event(3, tool="x", at=100, session="n"), event(4, tool=None, at=101, session="n"),
        event(5, tool="b", size=(10**6, 0), at=200, session="m", resources=["/p"]),
    ]
    source = tmp_path / "in"
    frame(spark, score).coalesce(1).write.parquet(str(source))
    feed = spark.readStream.schema(frame(spark, score).schema).parquet(str(source))
    found = []
    for k, stream in enumerate(stream_detect(feed, known)):
        query = stream.writeStream.format("memory").queryName(f"live{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        query.awaitTermination()
        found += rows(anomaly_records(spark.table(f"live{k}")))
    shown = lambda rs: sorted((json.dumps(r, default=str, sort_keys=True) for r in rs))
    want = [{k: v for k, v in r.items() if k != "arrival"} for r in rows(anomaly_records(detect(frame(spark, score), known)))]
    assert {r["anomaly_type"] for r in want} == {"UnknownTool", "UnknownSequence", "RateSpike", "VolumeSpike"}
    assert shown(found) == shown(want)


def shown(anomalies) -> list[str]:
    return sorted(json.dumps({k: v for k, v in r.items() if k != "arrival"}, default=str, sort_keys=True) for r in rows(anomaly_records(anomalies)))


def live_profile(spark):
    return build_profile(frame(spark, [event(k, tool="ab"[k % 2], at=k * 60 + k % 3, size=(k, 0)) for k in range(1, 9)])).staged()


def test_live_batches_find_what_one_detection_finds(spark, tmp_path):
    """Whatever the cuts between batches: calls before, named calls before and marks go on; replays are found once."""
    rng, known = random.Random(1), live_profile(spark)
    score = [event(k, session=rng.choice("mn"), tool=rng.choice(["a", "b", "x", None]), seq=k, at=1000 + k * rng.choice([1, 60]), size=(rng.choice([1, 10**6]), 0)) for k in range(1, 31)]
    cuts = [0, *sorted(rng.sample(range(1, 30), 2)), 30]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        again = [e | {"arrival": 100 * n + k} for k, e in enumerate(score[:a:3], 1)] if a else []
        live_batch(frame(spark, score[a:b] + again), known, str(tmp_path / "live"), f"f-{n}")
    want = shown(detect(frame(spark, score), known))
    assert want and shown(load_anomalies(spark, str(tmp_path / "live"))) == want
    assert {(r["session_id"], r["hwm"]) for r in rows(live_marks(spark, str(tmp_path / "live")))} == {(s, max(e["sequence_position"] for e in score if e["session_id"] == s)) for s in {e["session_id"] for e in score}}


def test_interrupted_live_batches(spark, tmp_path, monkeypatch):
    known, root = live_profile(spark), str(tmp_path / "live")
    parts = [[event(1, tool="x", at=900)], [event(2, tool="y", at=910), event(3, tool="a", at=911)]]
    monkeypatch.setattr(layers, "FANOUT", 2)
    for n, part in enumerate(parts):
        for lost in (True, False, False):  # lost before it counts; then whole, and once again
            with monkeypatch.context() as patched:
                if lost:
                    patched.setattr(Layers, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                try:
                    live_batch(frame(spark, part), known, root, f"f-{n}")
                except OSError:
                    assert lost
    want = shown(detect(frame(spark, sum(parts, [])), known))
    assert shown(load_anomalies(spark, root)) == want
    compact_live(spark, root)
    assert shown(load_anomalies(spark, root)) == want
    with pytest.raises(ValueError):
        live_batch(frame(spark, parts[0]), known, root, "nameless")
    live_batch(frame(spark, []), known, root, "f-9")
    assert shown(load_anomalies(spark, root)) == want


def test_live_marks_expire(spark, tmp_path):
    day, known, root = 86_400, live_profile(spark), str(tmp_path / "live")
    old = event(1, session="old", tool="x", at=0)
    send = lambda n, *events: live_batch(frame(spark, list(events)), known, root, f"f-{n}", mark_ttl="30 days")
    count = lambda: sum(r["anomaly_type"] == "UnknownTool" for r in rows(load_anomalies(spark, root)))
    send(0, old)
    send(1, old, event(2, session="new", tool="a", at=20 * day))
    assert count() == 1  # a replay
    send(2, event(3, session="new", tool="a", at=40 * day))
    assert [r["session_id"] for r in rows(live_marks(spark, root, "30 days"))] == ["new"]
    compact_live(spark, root, "30 days")
    assert [r["session_id"] for r in rows(live_marks(spark, root))] == ["new"]
    send(3, old)
    assert count() == 2  # its mark is gone, so it is looked at again


def test_live_stream(spark, tmp_path):
    known, source = live_profile(spark), tmp_path / "in"
    score = [event(1, tool="x", at=900), event(2, tool="b", at=901), event(3, tool="a", at=901.5, size=(10**6, 0))]
    for part in (score[:1], score[1:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        query = stream_live(spark.readStream.schema(frame(spark, score).schema).parquet(str(source)), known, str(tmp_path / "live"), str(tmp_path / "check"))
        query.awaitTermination()
    assert shown(load_anomalies(spark, str(tmp_path / "live"))) == shown(detect(frame(spark, score), known))


def test_a_line_of_events_is_decoded_once(spark):
    """Text around an event does not make it one, and no column decodes the line again."""
    good = rows(events_to_json(frame(spark, [event(1, keys=["k"])])))[0]["value"]
    spoilt = [',"x":1', "}", "} x", "}}", f',"{END}":0}}', f',"{END}":0', ",", " ", "\t", ' "x"', ',"line":1', ', {"a":1']
    repeated = [good.replace("{", '{"' + k + '":' + json.dumps(json.loads(good)[k]) + ",", 1) for k in json.loads(good)]
    lines = [good, *[good + x for x in spoilt], *[x + good for x in ("{", "[", " ", "1,", "x")], *repeated, good[:-1] + ',"more":[1]}', good[:-1]]
    df = spark.createDataFrame([(x, n) for n, x in enumerate(lines)], "value string, n int")
    events, rejects = parse_events(df)
    got = {r.n for r in events.collect()}
    assert {0} < got == {n for n, x in enumerate(lines) if valid_event(x)}
    assert {r.n for r in rejects.collect()} == {*range(len(lines))} - got
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
