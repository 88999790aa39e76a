"""Approximate nearest neighbours on shifted Hilbert curves.

Vectors are normalised, projected on a few random orthonormal directions and
put on several Hilbert curves, each with its own projection and shift.  Spark
range-partitions every curve by its key; a query looks at the window of rows
around its own place on each curve, in blocks of bounded size, and the
candidates of all windows are merged and ranked again by the exact inner
product of the original vectors in double precision.

Curves and window are not guessed: a bounded sample of queries is compared with
all rows, which shows how far from the query its true neighbours lie on each
curve.  The cheapest choice that reaches the wanted recall on the sample is
used.  On clustered vectors that is a small window; on vectors without
structure, where no ordering of one dimension keeps neighbours together, the
window widens until it reaches the recall, up to all rows.

Equal vectors are one entry of the index with its smallest ids, so a vector
with very many copies is neither a hot block nor a source of lost ties.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; shorter vectors count as padded with zeros; a repeated
id with the same vector counts once; with fewer than ``k`` candidates all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.llm.common import global_index, stage


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of points with coordinates in 0..2^bits-1, one row a point.

    Gray-code walk from the highest bit down: reflect and exchange axes, then
    undo the Gray code and interleave the bits.
    """
    x = x.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, d - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _curve_keys(vectors: np.ndarray, curve: int, dims: int, bits: int) -> np.ndarray:
    rng = np.random.default_rng([curve, vectors.shape[1]])
    axes = np.linalg.qr(rng.standard_normal((vectors.shape[1], min(dims, vectors.shape[1]))))[0]
    shift = rng.random(axes.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = unit @ axes * np.sqrt(vectors.shape[1])  # of order 1 in each direction
    grid = np.clip((np.clip(at, -3.5, 3.5) + 4 + shift * 0.999) / 8 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_index(grid.astype(np.int64), bits)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last, so that they depend on the two vectors only."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _best(q: np.ndarray, x: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best of each row of ``scores``: score descending, then smaller id; -inf takes no part.

    ``scores`` are matrix products, right but for their last bits; what comes near a row's k-th is scored again.
    """
    n = scores.shape[1]
    edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    margin = 1e-12 * np.linalg.norm(q, axis=1) * max(np.linalg.norm(x, axis=1).max(initial=0.0), 1.0)
    near = (scores >= (edge - margin)[:, None]) & (scores > -np.inf)
    row, column = np.nonzero(near)
    exact = _products(q[row], x[column])
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], column[keep], exact[keep]


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) rows that take part, padded with zeros to the longest."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0))
    most = rows.agg(F.max(F.size(vec))).first()[0] or 0
    padded = F.concat(F.transform(vec, lambda x: x + F.lit(0).cast("float")), F.array_repeat(F.lit(0).cast("float"), F.lit(most) - F.size(vec)))
    return rows.select(F.col(id_col).cast("long").alias("id"), padded.alias("vec"))


def search(
    vectors: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_every: int = 20,
    curves: int = 3,
    dims: int = 8,
    bits: int = 6,
    block_rows: int = 4096,
    query_rows: int = 4096,
    recall: float = 0.95,
    sample: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``query_every``.

    ``sample`` bounds the queries that the window is fitted on.  Recall is
    measured on them against all rows.
    """
    spark = vectors.sparkSession
    rows = stage(usable_vectors(vectors, id_col, vec_col))
    # the k + 1 smallest ids of each distinct vector; Spark limits the groups before it shuffles them
    smallest = (
        rows.distinct()
        .withColumn("_r", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
        .where(F.col("_r") <= k + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    entries = stage(smallest.select(F.element_at("ids", 1).alias("entry"), "vec", "ids"))
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(F.col("id") % query_every == 0).select("id", "vec")
    # queries with equal vectors share one search
    query = stage(asked.join(entries.select("vec", "entry"), "vec").select("id", "entry").distinct())
    wanted = query.select("entry").distinct()

    @F.pandas_udf("array<long>")
    def keys(vec: pd.Series) -> pd.Series:
        m = _matrix(vec)
        return pd.Series(list(np.stack([_curve_keys(m, c, dims, bits) for c in range(curves)], axis=1)))

    keyed = entries.select("entry", "vec", keys("vec").alias("keys"))
    placed = keyed.select("entry", "vec", F.posexplode("keys").alias("curve", "key"))
    on = [
        global_index(placed.where(F.col("curve") == c).select("entry", "vec", "key"), ["key", "entry"], "pos") for c in range(curves)
    ]
    n_curves, window = _fit_window(entries, on, wanted, total, k, recall, sample)

    schema = "query long, entry long, score double"

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64", "score": "float64"})
        ids, theirs = left["entry"].to_numpy(), right["entry"].to_numpy()
        near = left["pos"].to_numpy()
        x, q, at = _matrix(left["vec"]), _matrix(right["vec"]), right["pos"].to_numpy()
        found = []
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            scores = part @ x.T
            scores[np.abs(at[i : i + 256, None] - near[None, :]) > window] = -np.inf
            row, column, score = _best(part, x, scores, ids, k + 1)
            found.append((theirs[i + row], ids[column], score))
        return pd.DataFrame(dict(zip(("query", "entry", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    met = None
    for c in range(n_curves):
        index = on[c].select("entry", "vec", "pos", F.floor(F.col("pos") / block_rows).alias("block"))
        mine = on[c].join(wanted, "entry", "left_semi").select("entry", "vec", "pos")
        mine = stage(mine.withColumn("chunk", F.floor(F.col("pos") / (query_rows * query_every))))
        reach = F.sequence(
            F.greatest(F.lit(0), F.floor((F.col("lo") - window) / block_rows)),
            F.least(F.lit((total - 1) // block_rows), F.floor((F.col("hi") + window) / block_rows)),
        )
        visits = mine.groupBy("chunk").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).select("chunk", F.explode(reach).alias("block"))
        left = index.join(visits, "block").select("chunk", "block", "entry", "vec", "pos")
        right = mine.join(visits, "chunk").selectExpr("chunk AS q_chunk", "block AS q_block", "entry", "vec", "pos").where(
            ((F.col("pos") + window) >= F.col("q_block") * block_rows)
            & ((F.col("pos") - window) < (F.col("q_block") + 1) * block_rows)
        )
        pairs = left.groupBy("chunk", "block").cogroup(right.groupBy("q_chunk", "q_block")).applyInPandas(
            lambda a, b: block(a.reset_index(drop=True), b.reset_index(drop=True)), schema
        )
        met = pairs if met is None else met.unionByName(pairs)

    if n_curves > 1:
        met = met.dropDuplicates(["query", "entry"])
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    merged = met.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= k + 1)
    copies = merged.join(entries.select("entry", "ids"), "entry").select("query", "score", "ids")
    # at most (k + 1) x (k + 1) ids for each searched vector
    lists = copies.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("l"))
    flat = F.flatten(F.transform("l", lambda e: F.transform(e["ids"], lambda i: F.struct(e["s"].alias("s"), i.alias("id")))))
    lists = lists.select(F.col("query").alias("entry"), F.slice(F.array_sort(flat), 1, k + 1).alias("best"))
    out = query.join(lists, "entry").select(
        F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best")
    )
    return out.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score")
    )


def _fit_window(entries: DataFrame, on: list[DataFrame], wanted: DataFrame, total: int, k: int, recall: float, sample: int) -> tuple[int, int]:
    """(curves, rows on either side) that reach the recall at least cost on a bounded sample of queries."""
    spark = entries.sparkSession
    picked = entries.join(wanted, "entry", "left_semi").orderBy(F.xxhash64("entry"), "entry").limit(sample).select("entry", "vec").toPandas()
    if not len(picked) or total <= 2 * k:
        return 1, total
    sent = spark.sparkContext.broadcast((picked["entry"].to_numpy(), _matrix(picked["vec"])))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = sent.value
        for pdf in batches:
            ids = pdf["entry"].to_numpy()
            x = _matrix(pdf["vec"])
            scores = q @ x.T
            scores[names[:, None] == ids[None, :]] = -np.inf
            row, column, score = _best(q, x, scores, ids, k)
            yield pd.DataFrame({"query": names[row], "entry": ids[column], "score": score})

    true = entries.select("entry", "vec").mapInPandas(exact, "query long, entry long, score double")
    true = true.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("_r") <= k)
    true = true.select("query", "entry")
    for c, curve in enumerate(on):
        place = curve.select("entry", F.col("pos").alias(f"a{c}"))
        true = true.join(place, "entry").join(place.select(F.col("entry").alias("query"), F.col(f"a{c}").alias(f"b{c}")), "query")
        true = true.withColumn(f"d{c}", F.abs(F.col(f"a{c}") - F.col(f"b{c}"))).drop(f"a{c}", f"b{c}")
    far = true.select(*[f"d{c}" for c in range(len(on))]).toPandas().to_numpy()  # sample x k rows at most
    best = None
    for c in range(1, len(on) + 1):
        window = int(np.quantile(far[:, :c].min(axis=1), recall)) + 1
        cost = c * min(2 * window + 1, total)
        if best is None or cost < best[0]:
            best = (cost, c, min(window, total))
    return best[1], best[2]
