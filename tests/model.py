"""A row-at-a-time model of the rules, as the oracle of the property tests."""

from __future__ import annotations

import collections
import math


def whole_ms(a, b):
    d = (b - a) / __import__("datetime").timedelta(microseconds=1)
    return int(d / 1000)


class Moments:
    def __init__(self):
        self.values = []

    @property
    def mean(self):
        return sum(self.values) / len(self.values) if self.values else 0.0

    @property
    def sd(self):
        n = len(self.values)
        if n < 2 or min(self.values) == max(self.values):
            return 0.0
        return math.sqrt(sum((v - self.mean) ** 2 for v in self.values) / (n - 1))

    def z(self, x):
        return (x - self.mean) / self.sd if self.sd else None


def profiles(events):
    """agent -> dict of what a profile holds; events in order of arrival."""
    out = {}
    for e in events:
        p = out.setdefault(
            e["agent_id"],
            dict(events=0, sessions=0, marks={}, session=None, tool=None, time=None, bigrams=collections.Counter(), tools=collections.Counter(), rates=Moments(), volumes=collections.defaultdict(Moments), hours=collections.Counter(), resources=set(), accepted=[]),
        )
        mark = p["marks"].get(e["session_id"])
        if mark is not None and e["sequence_position"] <= mark:
            continue
        p["marks"][e["session_id"]] = max(mark or 0, e["sequence_position"])
        p["accepted"].append(e["arrival"])
        if p["events"] == 0 or e["session_id"] != p["session"]:
            p["sessions"] += 1
            p["session"], p["tool"], p["time"] = e["session_id"], None, None
        p["events"] += 1
        p["first"] = p.get("first", e["timestamp"])
        p["last"] = e["timestamp"]
        p["hours"][e["timestamp"].hour] += 1
        p["resources"].update(e["resource_ids"])
        if e["event_type"] == "ToolCall":
            tool = e["tool_name"] or "unknown"
            p["tools"][tool] += 1
            p["volumes"][tool].values.append(float(e["data_in_bytes"] + e["data_out_bytes"]))
            if p["tool"] is not None:
                p["bigrams"][p["tool"], tool] += 1
            if p["time"] is not None and whole_ms(p["time"], e["timestamp"]) > 0:
                p["rates"].values.append(60000.0 / whole_ms(p["time"], e["timestamp"]))
            p["tool"], p["time"] = tool, e["timestamp"]
    return out


def anomalies(events, known, threshold, scope):
    """(arrival, type) of what the four detectors find."""
    found, seq, rate = [], {}, {}
    for e in events:
        if e["agent_id"] not in known or e["event_type"] != "ToolCall":
            continue
        p, name = known[e["agent_id"]], e["tool_name"]
        key = e["agent_id"] if scope == "agent" else None
        if name is not None:
            if name not in p["tools"]:
                found.append((e["arrival"], "UnknownTool"))
            session, before = seq.get(key, (None, None))
            if session == e["session_id"] and before is not None and (before, name) not in p["bigrams"]:
                found.append((e["arrival"], "UnknownSequence"))
            seq[key] = (e["session_id"], name)
        session, time = rate.get(key, (None, None))
        if session == e["session_id"] and time is not None and whole_ms(time, e["timestamp"]) > 0:
            z = p["rates"].z(60000.0 / whole_ms(time, e["timestamp"]))
            if z is not None and z > threshold:
                found.append((e["arrival"], "RateSpike"))
        rate[key] = (e["session_id"], e["timestamp"])
        if name is not None and name in p["volumes"]:
            z = p["volumes"][name].z(float(e["data_in_bytes"] + e["data_out_bytes"]))
            if z is not None and z > threshold:
                found.append((e["arrival"], "VolumeSpike"))
    return sorted(found)
