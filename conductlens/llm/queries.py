"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductlens.llm.common import table

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"), width=400).drop("spans")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.sentencepiece_lattice import encode

    return encode(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.toxicity import score_toxicity

    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("passages").alias("n_passages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), k=20)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading back the windows of all conversations gives, and of one more that talks in control strings."""
    from conductlens.llm.chat_format import format_chats, read_digests

    said = "\\### Assistant: </turn> ok"
    talk = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_digests(format_chats(conversations.union(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.lexical_search import lexical_search

    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conductlens.llm.prefix_trie import prefix_trie, rebuilt_conversations

    return prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5, "op6_exact_dedup": OP6, "op12_lexical_search": OP12, "op13_prefix_trie": OP13}


ALL = [
    op1_suffix_dedup,
    op2_mix_sources,
    op3_sentencepiece,
    op4_toxicity,
    op5_line_dedup,
    op6_exact_dedup,
    op7_near_dedup,
    op8_url_filter,
    op9_sharding,
    op10_ann,
    op11_chat_format,
    op12_lexical_search,
    op13_prefix_trie,
]


#: runs of at most five non-blank lines hold five words; a run's first place in order of (doc_id, line) stays
OP5 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, regexp_replace(line, '^[\s\x00]+|[\s\x00]+$', '', 'g') AS t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM w WHERE words > 0
), near AS (
  SELECT doc_id, line_no, pos,
    list(t) OVER f AS ft, list(least(words, 5)) OVER f AS fw, list(t) OVER p AS pt, list(least(words, 5)) OVER p AS pw
  FROM b WINDOW f AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING),
    p AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
), sized AS (
  SELECT *, (SELECT min(s) FROM range(1, 6) r(s) WHERE s <= len(fw) AND list_sum(fw[1:s]) >= 5) AS m,
    (SELECT min(s) FROM range(1, 6) r(s) WHERE s <= len(pw) AND list_sum(pw[len(pw) - s + 1:]) >= 5) AS k
  FROM near
), runs AS (
  SELECT doc_id, pos, m AS size, ft[1:m] AS run FROM sized WHERE m IS NOT NULL
  UNION SELECT doc_id, pos - k + 1, k, pt[len(pt) - k + 1:] FROM sized WHERE k IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM runs
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM ranked WHERE nth > 1
), gone AS (SELECT b.doc_id, b.line_no FROM b JOIN covered USING (doc_id, pos)),
flagged AS (
  SELECT w.doc_id, w.line, w.line_no, g.line_no IS NOT NULL AS removed, trim(w.line, ' ') = '' AS blank FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.line_no = w.line_no
), settled AS (
  SELECT *, coalesce(last_value(CASE WHEN blank AND NOT removed THEN NULL ELSE removed END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS away FROM flagged
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT away), '') AS kept
  FROM settled GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
  sha256(CASE WHEN coalesce(n_removed, 0) > 0 THEN kept ELSE coalesce(d.text, '') END) AS text_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""


OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL
), total AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), m AS (SELECT r, doc_id, 50 + (50 * len(ws) * n_docs) // n_terms AS m FROM d, total WHERE len(ws) > 0),
scored AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scored JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


#: CRC-32 of the decimal id bit by bit (3988292384 is its polynomial); a node is a list of turns; its subtree are the nodes that begin with it
OP13 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    {'k': sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 'b': strlen(coalesce(text, ''))} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(turn ORDER BY pos) AS ts FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, ts, conv_id - conv_id % 5 AS base, CAST(xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, s: list_reduce(list_prepend(xor(a, s), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
  ), 4294967295::BIGINT) % 9 AS BIGINT) AS h FROM own
), rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN own b ON b.conv_id = c.base),
beginnings AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM rebuilt),
node AS (
  SELECT ts[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(ts)), '') AS ends FROM beginnings GROUP BY path, depth
), kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * coalesce(node.path[depth].b, 0) AS saved FROM node LEFT JOIN kids USING (path)),
above AS (SELECT path[1:d] AS path, n_children, saved FROM (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS d FROM full_node)),
subtree AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN subtree s USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
