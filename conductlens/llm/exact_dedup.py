"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

A row leaves the comparison as soon as its length or its prefix is unique; only
groups that survive both are compared, by the SHA-256 digest of the whole text.
The digest is part of every row's result, so the one scan computes it for all.
No text is ever shuffled: the scan reduces each row to (id, length, prefix
hash, digest), and hot groups are combined in the map tasks before a shuffle.

Defined cases: a null text counts as the empty text, so all null and empty
texts form one group.  Rows with a null id can be dropped but never kept while
another row of the group has an id; a group of null ids only keeps all of them.
Repeated rows (same id, same text) all carry the same ``kept`` flag, since a
decision that is carried by ids cannot tell them apart, and count in
``group_size``.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductlens.llm.common import stage


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
            F.sha2(text, 256).alias("text_sha256"),
        )
    )

    def many(df: DataFrame, *keys: str) -> DataFrame:
        """Keys that more than one row has; staged, so that Spark can split a hot key's rows in the joins that follow."""
        return stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))

    by_length = many(rows, "n_bytes")
    by_prefix = many(rows.join(by_length, "n_bytes", "left_semi"), "n_bytes", "prefix")
    survivors = rows.join(by_prefix, ["n_bytes", "prefix"], "left_semi")
    groups = stage(
        survivors.groupBy("n_bytes", "prefix", "text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
        .where("group_size > 1")
    )
    out = rows.join(groups, ["n_bytes", "prefix", "text_sha256"], "left").select(
        "id",
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
