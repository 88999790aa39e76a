"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words.  A document of size x in a source
with target/size ratio r is taken floor(r) times for sure and once more with
inclusion probability r - floor(r).  The extra copies are drawn by the cube
method: inclusion probabilities move along the null space of the balancing
constraints (words, documents) until they reach 0 or 1.  With two constraints
three documents span one null direction, the cross product of the constraint
rows, so each step settles at least one document and needs constant memory.
Blocks of documents fly independently in parallel; the at most two documents
left of each block meet in the next level's blocks, until one small landing
problem per source remains.  Its at most two documents are taken in part (that
many of their words), so that each source meets its target to within a word or
two; ``copies`` rounds them to the whole copies that come closest.

Documents are processed from large to small inside a block, so that what is
left for the landing is small.  All choices come from hashes of the ids: reruns
agree whatever the partitioning.

Defined cases: null text has size 0; null sources form one source, which is
last in order; a source of size 0 has target 0; documents of size 0 are taken
0 times; repeated rows are drawn one by one, rows that share an id by their
texts; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductlens.functions.staging import running
from conductlens.llm.common import global_index, row_key, stage

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Weights repeat over the sources in code-point order, null last.  A target
    stops at ``most`` times its source's size; water-filling in closed form:
    sources sorted by cap/weight are capped as long as the level that the rest
    would get is above their cap.  Order and sums run over range partitions, so
    there may be as many sources as web hosts.
    """
    per = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    per = global_index(per.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_k")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(pick, (F.col("_k") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * most)
    # from the highest cap/weight down: weights and caps of a source and of all that come after it in rising order
    falling = per.withColumns({"_ratio": -F.col("_cap") / F.col("weight"), "_at_k": -F.col("_k")})
    per = stage(running(falling, ["_ratio", "_at_k"], {"_weights": F.col("weight"), "_caps": F.col("_cap")}))
    level = (total - (total * most - F.col("_caps"))) / F.col("_weights")
    # the first source in rising order whose cap is above its share sets the level for itself and all that follow
    free = per.where(-F.col("_ratio") >= level).agg(F.min(F.struct(-F.col("_ratio"), "_k", level.alias("level"))).alias("free")).first()["free"]
    return per.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        "n_docs",
        (F.least("_cap", free["level"] * F.col("weight")) if free else F.col("_cap")).cast("double").alias("target"),
    )


def _fly(size: np.ndarray, pi: np.ndarray, toss: np.ndarray) -> np.ndarray:
    """Flight phase over documents in the given order: all but at most two of the results are 0 or 1."""
    pi = pi.copy()
    live: list[int] = []
    s, t = size.tolist(), toss.tolist()
    p = pi.tolist()
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            live.append(k)
        else:
            p[k] = float(round(p[k]))
        while len(live) == 3:
            a, b, c = live
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)  # equal sizes: the words constraint is the count constraint
            up = down = math.inf
            for i, d in zip(live, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
                elif d < 0:
                    up, down = min(up, -p[i] / d), min(down, -(1 - p[i]) / d)
            # up with probability down / (up + down): expectations do not move
            step = up if t[k] * (up + down) < down else -down
            for i, d in zip(live, u, strict=True):
                p[i] += step * d
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = float(round(p[i]))
            left = [i for i in live if 0 < p[i] < 1]
            live = left if len(left) < 3 else left[1:]
    return np.array(p)


def _flight(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "key", "id"], ascending=[False, True, True], kind="stable")
    toss = (pdf["key"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
    pi = _fly(pdf["size"].to_numpy(np.float64), pdf["pi"].to_numpy(np.float64), toss)
    return pdf.assign(pi=pi, share=pi)


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """The landing problem of a source: flight over what is left, then at most two documents stay between 0 and 1.

    ``share`` keeps their probability as the part of a copy that is taken, so
    the source's words meet its target; ``pi`` is the rounding to whole copies
    that comes closest to the words owed.
    """
    owed = float((pdf["pi"] * pdf["size"]).sum())
    pdf = _flight(pdf)
    p, s = pdf["pi"].to_numpy().copy(), pdf["size"].to_numpy(np.float64)
    share = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    done = float((p * s)[(p == 1)].sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(owed - done - sum(s[i] for b, i in enumerate(open_) if m >> b & 1)), m))
    for b, i in enumerate(open_):
        p[i] = float(best >> b & 1)
    return pdf.assign(pi=p, share=share)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    block_rows: int = 2_000,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, key.

    ``taken`` counts the words of whole copies and of the at most two partly
    taken documents per source; ``copies`` are whole copies only.
    """
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            row_key(id_col, text_col).alias("row_key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    targets = source_targets(rows, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = stage(
        rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("ratio", ratio)
        .withColumn("sure", F.when(F.col("size") > 0, F.floor(F.col("ratio") + EPS)).otherwise(0).cast("long"))
        .withColumn("pi", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - F.col("sure"))).otherwise(0.0))
        .withColumn("key", F.xxhash64("row_key", "source", "size", F.lit("cube")))
    )
    live = keyed.where((F.col("pi") > EPS)).select("id", "row", "source", "size", "pi", "key", "n_docs")
    live = live.withColumn("share", F.col("pi"))
    schema = live.schema
    largest = keyed.agg(F.max("n_docs")).first()[0] or 0
    settled = None
    level, left = 0, largest
    while left > block_rows:
        # a source's blocks hold block_rows documents on average, whatever its size
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_rows))
        flown = stage(
            live.withColumn("_block", F.pmod(F.xxhash64("key", F.lit(level)), blocks))
            .groupBy("source", "_block")
            .applyInPandas(lambda pdf: _flight(pdf.drop(columns="_block")), schema)
        )
        done = flown.where("pi in (0.0, 1.0)")
        settled = done if settled is None else settled.unionByName(done)
        live = flown.where("pi not in (0.0, 1.0)").withColumn("n_docs", F.ceil(F.col("n_docs") / block_rows) * 2)
        left, level = math.ceil(left / block_rows) * 2, level + 1
    landed = live.groupBy("source").applyInPandas(_land, schema)
    chosen = landed if settled is None else settled.unionByName(landed)
    extra = chosen.select("row", F.col("pi").cast("int").alias("extra"), "share")
    return keyed.join(extra, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"),
        (F.col("sure") * F.col("size") + F.floor(F.coalesce("share", F.lit(0.0)) * F.col("size") + 0.5)).cast("long").alias("taken"),
        F.col("row_key").alias("key"),
    )
