"""Helpers shared by the operators: table access, lineage cuts, global order, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductlens.functions.staging import global_index, stage

__all__ = ["ascii_lower", "connected_components", "global_index", "partitions", "row_key", "stage", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def row_key(id_col: str, text_col: str):
    """Hash of a row's id and text, by which an operator's decisions find their rows; never null."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u long, v long) undirected links -> (node, component): the smallest node reachable.

    Min-label hooking with pointer jumping.  Every round is written to the
    shared folder, so the plan stays short; rounds grow with the logarithm of
    the longest chain.  Links never reach the driver, only a count of changes.
    """
    both = stage(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    )
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        # the smallest label around each node; a hub's links are combined before the shuffle
        around = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(around, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        # the label's own label: halves the distance to the smallest node
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stage(
            hooked.join(jump, "label", "left").select(
                "node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"
            )
        )
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))

