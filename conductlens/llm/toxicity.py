"""Toxicity by maximum-scoring segments of token log-odds.

Training: how many labelled documents of each class hold a word, or a word
beginning with its first four or five letters (compounds and inflected
forms share them), counted over all labelled training rows.  These units are
counted exactly, each under its own 64-bit hash.  A unit's
log-odds use a Dirichlet prior that is proportional to the unit's count in both
classes together; a token gets the log-odds of its most significant unit, and
tokens without a significant one count as background, a small negative score.
Only significant units are sent to the executors, the most frequent 2^19 at
most; if there are more, the rest reach their documents by a join on (document,
unit), so the model in memory is bounded and no unit is lost.

Scoring: one linear scan over the tokens of a whole text finds all maximal
scoring segments.  Their scores are calibrated as extreme values: with the
scale that the background implies, a segment of score S in a text of n tokens
has the expected number K n exp(-scale S) of chance segments at least as good.
K comes from the segments that clean training documents hold by chance.
The evidence of a document is the sum of -log of these over its significant
segments; a logistic curve fitted on the training labels (as counts per
evidence bin) maps it to a probability.

Defined cases: null, empty and blank texts have no evidence and get the score
of documents without any; labels that are null are ignored, a document with
several labels is toxic if one says so; rows with a null id are scored and
count as held out = false; without labels of both classes the score of all
rows is the share of toxic labels.  An empty table gives no rows; repeated rows
are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductlens.llm.common import row_key, stage

MOST = 1 << 19  # telling units held in memory
WORDS = 1 << 20  # words of 64 bits of the filter for the rest
LEAST_ODDS = 2.5  # log-odds from which a unit is a toxic word and not a topic
BIN = 0.25  # width of an evidence bin
MOST_BINS = 4000
AROUND = string.punctuation + "«»“”„’…¿¡–—"  # what is stripped from a word


HEADS = (4, 5)  # letters of word beginnings


def tokens(text: str | None) -> list[str]:
    """Words of the whole text, in lower case, with the punctuation around them."""
    return (text or "").lower().split()


def units(token: str) -> list[int]:
    """Hashes of a token's units: the word itself, without punctuation, and its beginnings."""
    token = token.strip(AROUND)
    if not token:
        return []
    parts = [token, *(f"{token[:k]}*" for k in HEADS if len(token) >= k)]
    found = map(xxhash.xxh3_64_intdigest, parts)
    return [h - (1 << 64) if h >> 63 else h for h in found]  # as a signed long


class Units(dict):
    """token -> units, emptied when large."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        self[token] = found = tuple(units(token))
        return found


class Scores(dict):
    """token -> score, emptied when large; ``more`` holds a document's units that are not in the model."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.at = {u: i for i, u in enumerate(model.unit.tolist())}

    def rated(self, token: str, more: dict[int, tuple[float, float]]) -> float:
        best, z = self.model.background, 0.0
        for u in units(token):
            i = self.at.get(u)
            found = (self.model.score[i], self.model.z[i]) if i is not None else more.get(u)
            if found and abs(found[1]) > z:
                best, z = float(found[0]), abs(found[1])
        return best

    def __missing__(self, token: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[token] = score = self.rated(token, {})
        return score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, clean, toxic) of labelled texts, combined over stretches of about a million units."""
    cache = Units()
    found: list[np.ndarray] = []
    marks: list[int] = []
    held = 0

    def combined() -> pa.RecordBatch:
        unit, at = np.unique(np.concatenate(found), return_inverse=True)
        toxic = np.bincount(at, np.repeat(marks, [len(f) for f in found]), len(unit)).astype(np.int64)
        clean = np.bincount(at, minlength=len(unit)) - toxic
        return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(clean), pa.array(toxic)], ["unit", "clean", "toxic"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            here = set().union(*map(cache.__getitem__, set(tokens(text.as_py()))))
            found.append(np.fromiter(here, np.int64, len(here)))
            marks.append(toxic)
            held += len(here)
            if held > 1_000_000:
                yield combined()
                found, marks, held = [], [], 0
    if held:
        yield combined()


def _mentions(bits: Broadcast):
    """(key, unit) of the units of each text that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, words = Units(), bits.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keys, found = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    here = set().union(*map(cache.__getitem__, set(tokens(text.as_py()))))
                    u = np.fromiter(here, np.int64, len(here))
                    u = u[(words[u & (WORDS - 1)] >> ((u >> 20) & 63)) & 1 == 1]
                    keys.append(np.full(len(u), key, np.int64))
                    found.append(u)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found))], ["key", "unit"])

    return run


@dataclass
class Model:
    unit: np.ndarray  # telling units
    score: np.ndarray  # per unit
    z: np.ndarray  # significance of the unit's log-odds
    scale: float  # of the extreme-value law
    background: float = -0.02


def telling_units(counts: DataFrame, prior: float = 0.02, least_z: float = 5.0, least_odds: float = LEAST_ODDS) -> tuple[DataFrame, float]:
    """((unit, clean, toxic, odds, strength) of the units whose log-odds count, sum of all clean counts).

    ``prior`` is the weight of the Dirichlet prior as a share of all counts;
    log-odds below ``least_odds`` are topics rather than toxic words.
    """
    total = counts.agg(F.sum("clean").cast("double").alias("c"), F.sum("toxic").cast("double").alias("t")).first()
    both, alpha = F.col("clean") + F.col("toxic"), prior * (F.col("clean") + F.col("toxic"))
    y, z = F.col("toxic") + alpha, F.col("clean") + alpha
    n_y, n_z = total.t + prior * (total.c + total.t), total.c + prior * (total.c + total.t)
    odds = F.log(y / (n_y - y)) - F.log(z / (n_z - z))
    share = total.t / (total.c + total.t)
    chance = both * share  # toxic documents with the unit if it told nothing
    strength = (F.col("toxic") - chance) / F.sqrt(chance * (1 - share))
    rated = counts.select("unit", "clean", "toxic", odds.alias("odds"), strength.alias("strength"))
    return rated.where((F.abs("strength") >= least_z) & ((F.col("odds") < 0) | (F.col("odds") >= least_odds))), total.c


def split_units(telling: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the most frequent telling units, MOST at most, the rest or None), divided at a power of two of their counts."""
    level = F.floor(F.log2(F.col("clean") + F.col("toxic")))
    sizes = sorted(((r["level"], r["n"]) for r in telling.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        held += n
        if held > MOST:
            break
        least = at
    else:
        return telling, None
    often = level >= F.lit(least) if least is not None else F.lit(False)
    return telling.where(often), telling.where(~often)


def fit_scores(
    unit: np.ndarray, clean: np.ndarray, odds: np.ndarray, strength: np.ndarray, all_clean: float, rest_clean: np.ndarray, rest_odds: np.ndarray, drift: float = 0.02
) -> Model:
    """Scores per unit, and the scale of the extreme-value law of their segments; the rest counts for the scale only."""
    score, significance = (np.maximum(odds, -1.0) - drift).astype(np.float32), strength.astype(np.float32)
    # scale: the positive root of E exp(scale s) = 1 under the tokens of clean documents
    clean, s = np.append(clean, rest_clean), np.append(score.astype(np.float64), np.maximum(rest_odds, -1.0) - drift)
    weight = np.append(clean, max(all_clean - clean.sum(), 0.0)) / max(all_clean, 1.0)
    s = np.append(s, -drift)
    if not (weight * s).sum() < 0 or not (s[weight > 0] > 0).any():
        return Model(unit, score, significance, 1.0, -drift)
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (weight * np.exp(mid * s)).sum() > 1 else (mid, hi)
    return Model(unit, score, significance, hi, -drift)


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of scores, in linear time.

    Only positive scores can begin or end a segment, so the scan visits those
    and takes what lies between from prefix sums.
    """
    up = np.flatnonzero(x > 0)
    if not len(up):
        return []
    total = np.cumsum(x)
    left_of, right_of = (total[up] - x[up]).tolist(), total[up].tolist()
    # a stack of candidates (start, end, sum before, sum after, index of the closest candidate with a smaller sum before)
    stack: list[tuple[int, int, float, float, int]] = []
    for at, lo, hi in zip(up.tolist(), left_of, right_of, strict=True):
        start, before, after = at, lo, hi
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, at, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b + 1, r - l) for a, b, l, r, _ in stack]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    most: float = 1.0,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted, evidence, passages (start, end, score, evidence in tokens), key.

    Labels of rows whose crc32(id) mod ``folds`` is 0 are never read.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        .where(~held_out)
    )
    known = stage(known)
    tally = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not tally.n or tally.t in (0, tally.n):
        rate = F.lit(float(tally.t / tally.n) if tally.n else 0.0)
        none = F.lit(None).cast("array<struct<start:int,end:int,score:double,evidence:double>>")
        out = rows.select("id", held_out.alias("held_out"), rate.alias("score"), (rate >= 0.5).cast("int").alias("predicted"), F.lit(0.0).alias("evidence"), none.alias("passages"), "key")
        return out.withColumnRenamed("id", id_col)

    counts = stage(
        rows.where(~held_out & F.col("id").isNotNull())
        .select("id", "text")
        .join(known.hint("shuffle_hash"), "id")  # the small side is hashed, the other one need not be sorted
        .select("toxic", "text")
        .mapInArrow(_count, "unit long, clean long, toxic long")
        .groupBy("unit")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    telling, all_clean = telling_units(counts)
    telling = stage(telling)
    often, rest = split_units(telling)
    rows_of = often.orderBy("unit").toPandas()  # at most MOST rows
    # the rest, for the scale: means within 0.0001 of log-odds
    rest_of = rest.groupBy(F.round("odds", 4)).agg(F.sum("clean").alias("clean"), F.avg("odds").alias("odds")).toPandas() if rest else pd.DataFrame({"clean": [], "odds": []})
    model = fit_scores(*(rows_of[c].to_numpy() for c in ("unit", "clean", "odds", "strength")), all_clean, rest_of["clean"].to_numpy(np.float64), rest_of["odds"].to_numpy(np.float64))
    sent = spark.sparkContext.broadcast(
        (model.unit, model.score, model.z, model.scale, model.background)
    )  # 8 MB: 16 bytes for each of MOST units
    texts = rows.withColumn("more", F.lit(None).cast("array<struct<unit:long,score:double,z:double>>"))
    if rest is not None:
        word = F.col("unit").bitwiseAND(F.lit(WORDS - 1))
        bit = F.expr("shiftleft(1L, cast((shiftright(unit, 20) & 63) as int))")
        filled = rest.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most WORDS rows
        words = np.zeros(WORDS, np.int64)
        words[filled["word"].to_numpy()] = filled["bits"].to_numpy()
        mentions = rows.select("key", "text").mapInArrow(_mentions(spark.sparkContext.broadcast(words)), "key long, unit long").distinct()
        rated = rest.select("unit", (F.greatest("odds", F.lit(-1.0)) + model.background).alias("score"), F.col("strength").alias("z"))
        more = mentions.join(rated, "unit").groupBy("key").agg(F.collect_list(F.struct("unit", "score", "z")).alias("more"))  # a text's own units
        texts = rows.join(stage(more), "key", "left").select("id", "text", "key", "more")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = Model(*sent.value)
        cache = Scores(ready)

        def scores(text: str | None, more) -> np.ndarray:
            ws = tokens(text)
            if more is None:
                return np.fromiter(map(cache.__getitem__, ws), np.float64, len(ws))
            own = {m["unit"]: (m["score"], m["z"]) for m in more}
            memo = {w: cache.rated(w, own) for w in set(ws)}
            return np.fromiter(map(memo.__getitem__, ws), np.float64, len(ws))

        for pdf in batches:
            scored = [scores(t, m) for t, m in zip(pdf["text"], pdf["more"], strict=True)]
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "key": pdf["key"],
                    "n": [len(x) for x in scored],
                    "found": [[{"start": a, "end": b, "score": s} for a, b, s in segments(x)] for x in scored],
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = stage(texts.mapInPandas(scan, f"id {kind}, key long, n long, found array<struct<start:int,end:int,score:double>>"))
    # K: segments of clean training documents that reach the least score of a telling unit, against what the scale expects of their tokens
    reached = F.size(F.filter("found", lambda e: e["score"] >= LEAST_ODDS + model.background))
    clean = scanned.where(F.col("id").isNotNull()).join(known.where("toxic = 0"), "id").agg(F.sum(reached).alias("segments"), F.sum("n").alias("tokens")).first()
    offset = ((clean.segments or 0) + 1) * float(np.exp(model.scale * (LEAST_ODDS + model.background))) / max(clean.tokens or 0, 1)
    # -log of the chance count K n exp(-scale S), of the segments that chance gives at most ``most`` times
    rarity = lambda e: e["score"] * model.scale - F.log(F.col("n") * offset)
    passages = F.transform("found", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"), rarity(e).alias("evidence")))
    scanned = scanned.withColumn("passages", F.filter(passages, lambda e: e["evidence"] >= -float(np.log(most))))
    scanned = scanned.withColumn("evidence", F.aggregate("passages", F.lit(0.0), lambda acc, e: acc + e["evidence"])).drop("found", "n")
    # the logistic curve is fitted on counts per (evidence bin, label): a bounded table of sums over all training labels
    bin_ = F.least(F.floor(F.col("evidence") / BIN), F.lit(MOST_BINS)).cast("int")
    bins = (
        scanned.where(F.col("id").isNotNull()).select("id", bin_.alias("bin")).join(known, "id").groupBy("bin").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).toPandas()
    )
    a, b, knee = _logistic(bins["bin"].to_numpy(np.float64) * BIN, bins["t"].to_numpy(np.float64), bins["n"].to_numpy(np.float64))
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least(F.col("evidence"), F.lit(knee)) + F.col("evidence") * 1e-6)))
    return scanned.select("id", held_out.alias("held_out"), score.alias("score"), "evidence", "passages", "key").select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages", "key"
    )


def _logistic(x: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slope of a logistic curve on counts, slightly regularised; evidence beyond the knee adds nothing."""
    knee = 40.0
    x = np.minimum(x, knee)
    w = np.zeros(2)
    m = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (t - n * p) - 0.01 * w
        hess = (m * (n * p * (1 - p))[:, None]).T @ m + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0)), knee
