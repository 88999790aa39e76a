"""Chat formatting, lexical search and the prefix trie against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conductlens.llm import lexical_search as lexical
from conductlens.llm.chat_format import escape, format_chats, parse_window, read_digests, unescape
from conductlens.llm.lexical_search import lexical_search
from conductlens.llm.prefix_trie import list_rank, own_conversations, prefix_trie, rebuilt_conversations
from conductlens.llm.queries import op11_chat_format

TALK = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "###", "\\###", "</turn>", "\\</turn>", "</turn>\n### assistant: x</turn>\n", "#" * 7, "<</turn>", "a\\", "é😀\n\0\r", "### user: ", "x" * 9000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grouped(rows):
    """conv_id -> its turns in the defined order."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in by.items()}


def talks(rng, n, longest=9):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", None]) if turn else rng.choice(["system", "user"])
            rows.append((conv, turn, role, rng.choice([*NASTY[:-1], None, "ba de fi " * rng.randint(1, 60)])))
    return rows


# --- chat formatting ---


def expected_digests(rows):
    out = {}
    for conv, turns in grouped(rows).items():
        said = "".join(x for r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said))
    return out


def read(windows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_digests(windows).collect()}


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "s string")
    for text, plain, role in df.select("s", escape(F.col("s")), escape(F.col("s"), True)).collect():
        assert unescape(plain) == text and unescape(role) == text
        assert parse_window(f"### {role}: {plain}</turn>\n") == [(text, text)]
        assert not re.search(r"(?<!\\)(\\\\)*(###|</turn>)", plain)


@pytest.mark.parametrize("budget", [40, 300, 2048])
def test_windows_give_the_conversations_back(spark, budget):
    rng = random.Random(budget)
    rows = talks(rng, 30) + [(99, t, ["user", "assistant"][t % 2], f"turn {t} " * (t % 7)) for t in range(400)]
    # null ids, null turns, repeated rows, turns that share a number
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (50, None, "user", "x"), (50, None, "assistant", "y"), (50, 1, "user", "r"), (50, 1, "user", "r")]
    rows += [(60, 0, "system", "be brief " * 5), *[(60, t, "assistant", f"{t} yes") for t in range(1, 60)]]
    windows = format_chats(spark.createDataFrame(rows, TALK), budget, history_tokens=budget // 8).persist()
    assert read(windows) == expected_digests(rows)
    for w in windows.collect():
        assert w.n_tokens <= budget or w.over_budget and w.n_turns - w.n_repeated == 1
        turns = parse_window(w.formatted)
        assert len(turns) == w.n_turns and w.n_repeated <= 5
        whole = grouped(rows)[w.conv_id]
        own = turns[w.n_repeated :]
        assert whole[w.start : w.start + len(own)] == own
        repeated = turns[: w.n_repeated]
        if w.start and whole[0][0] == "system":
            assert repeated.pop(0) == whole[0]
        assert repeated == whole[w.start - len(repeated) : w.start]
        spans = [unescape(w.formatted[s.start : s.end]) for s in w.loss]
        assert spans == [x for r, x in own if r == "assistant"]


def test_chat_columns_and_empty_table(spark):
    rows = talks(random.Random(3), 5)
    df = spark.createDataFrame(rows, TALK)
    clashing = df.select("*", *[F.lit("mine").alias(c) for c in ("conv", "start", "pos", "size", "at", "digest", "_part", "chunk", "room")])
    assert read(format_chats(clashing)) == expected_digests(rows)
    assert format_chats(df.limit(0)).count() == 0 and read_digests(format_chats(df.limit(0))).count() == 0


def test_op11_reads_back_every_conversation(spark, tmp_path):
    rows = talks(random.Random(5), 20)
    spark.createDataFrame(rows, TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    said = "\\### Assistant: </turn> ok"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op11_chat_format(spark, str(tmp_path)).collect()}
    assert got == expected_digests([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


# --- lexical search ---

DOCS = "doc_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, k):
    """(item_id, rank, doc_id, score) sorted."""
    counted = [(i, collections.Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 50 + (50 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, rank, d if there else None, -s) for rank, (s, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["ba", "De", "fi", "gö", "lu1", "ra_se", "ti-no", "Ümu", "ka"]) + str(int(rng.paretovariate(0.5)) % 60) for _ in range(n))


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_is_brute_force(spark, monkeypatch, k):
    rng = random.Random(k)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 300]))) for i in range(300)]
    # repeated rows, equal texts, null and equal ids, null, empty and wordless texts, a very long one
    docs += docs[:20] + [(1000 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (None, prose(rng, 9)), (7, prose(rng, 9)), (901, None), (902, ""), (903, " ,\x00- "), (904, prose(rng, 20_000))]
    items = [(i, prose(rng, rng.choice([1, 4, 20]))) for i in range(12)] + [(50, None), (51, ""), (52, "unheard of"), (None, docs[5][1]), (53, docs[3][1]), (53, docs[3][1])]
    monkeypatch.setattr(lexical, "BLOCK", 40)
    monkeypatch.setattr(lexical, "CHUNK", 5)
    got = lexical_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, k)


def test_search_columns_and_empty_tables(spark):
    docs, items = [(1, "ba de"), (2, "ba"), (3, "fi")], [(1, "BA fi")]
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    more = lambda df: df.select("*", *[F.lit("mine").alias(c) for c in ("row", "n", "tid", "term", "item", "block", "terms", "score", "rank")])
    assert sorted(tuple(r) for r in lexical_search(more(d), more(q)).collect()) == brute_search(docs, items, 50)
    assert lexical_search(d.limit(0), q).count() == 0 and lexical_search(d, q.limit(0)).count() == 0


def test_trees_leave_subtrees_out(monkeypatch):
    """On documents in clusters a search opens few leaves, and its result is that of scoring all documents."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    tids = [list(range(10 * (d % 16), 10 * (d % 16) + 20)) for d in range(1600)]
    values = [[int(x) for x in rng.integers(900_000, 1_000_000, 20)] for _ in tids]
    table = pa.table({"block": [0] * 1600, "doc_id": list(range(1600)), "tids": tids, "values": values})
    made = lexical._build(table)
    tree = {c: np.asarray(made[c].combine_chunks().flatten()) for c in made.column_names if c != "block"}
    opened = []
    push = lexical.heapq.heappop
    monkeypatch.setattr(lexical.heapq, "heappop", lambda heap: opened.append(1) or push(heap))
    terms = np.array(tids[5], np.int64)
    docs, _, scores = lexical._best(tree, terms, 1, 3)
    whole = np.array([sum(v for t, v in zip(ts, vs, strict=True) if t in set(tids[5])) for ts, vs in zip(tids, values, strict=True)])
    best = np.lexsort((np.arange(1600), -whole))[:3]
    assert list(docs) == list(best) and list(scores) == list(whole[best])
    assert len(opened) < len(tree["low"]) / 2


# --- prefix trie ---


def brute_trie(rows, rebuilt=True):
    own = grouped([r for r in rows if r[0] is not None])
    # turns that share a number are ordered by other hashes there: tests do not let them differ
    head = {c: zlib.crc32(str(c).encode()) % 9 if rebuilt else 0 for c in own}
    base = lambda c: c - int(math.fmod(c, 5))
    talk = {c: own.get(base(c), [])[: head[c]] + own[c][head[c] :] for c in own}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in talk.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = collections.Counter(), collections.Counter(), collections.Counter()
    for path in members:
        children[path[:-1]] += bool(path)
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(
        repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))) for p, m in members.items()
    )


def trie(turns_and_convs):
    return sorted(repr(tuple(r)) for r in prefix_trie(*turns_and_convs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_brute_force(spark, seed):
    rng = random.Random(seed)
    starts = [[("user", "hi"), ("assistant", "é"), ("user", None)], [("user", "hi"), (None, "no")]]
    rows = []
    for conv in range(-6, 40):
        turns = rng.choice(starts)[: rng.randint(1, 3)] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "long " * 50])) for _ in range(rng.randint(0, 12))]
        rows += [(conv, t, r, x) for t, (r, x) in enumerate(turns)]
    # a null turn, a repeated row, rows without id, a group whose first conversation is absent, a very long conversation
    rows += [(100, None, "user", "first"), (100, 3, "user", "r"), (100, 3, "user", "r"), (None, 0, "user", "lost"), (117, 0, "user", "hi"), *[(205, t, "user", f"{t % 3}") for t in range(700)]]
    df = spark.createDataFrame(rows, TALK)
    assert trie(rebuilt_conversations(df)) == brute_trie(rows)
    clashing = df.select("*", *[F.lit("mine").alias(c) for c in ("pos", "depth", "k0", "h0", "id", "size", "base", "head")])
    assert trie(own_conversations(clashing)) == brute_trie(rows, rebuilt=False)


def test_empty_trie(spark):
    assert trie(rebuilt_conversations(spark.createDataFrame([], TALK))) == []


@pytest.mark.parametrize("n", [1, 2, 500])
def test_list_rank(spark, n):
    order = random.Random(n).sample(range(10 * n), n)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], None], strict=True)], "arc long, next long")
    assert {r.arc: r.left for r in list_rank(links).collect()} == {a: n - 1 - k for k, a in enumerate(order)}
